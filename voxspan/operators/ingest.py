"""Filters, normalisers and samplers between a source and the octree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import OBSTACLE, STAIR
from ..functions.components import written
from ..functions.geometry import d, is_finite, rotate


def finite(points: DataFrame) -> DataFrame:
    return points.where(is_finite("x") & is_finite("y") & is_finite("z"))


def normal_label(c: Column) -> Column:
    return F.when(c == OBSTACLE, OBSTACLE).when(c == STAIR, STAIR).otherwise(0)


def clamp_probability(c: Column) -> Column:
    return F.when(is_finite(c), F.greatest(F.lit(0.0), F.least(F.lit(1.0), d(c)))).otherwise(F.lit(0.0)).cast("float")


def normalised(samples: DataFrame) -> DataFrame:
    """Labels, probabilities and the cross-floor flag as the octree expects them; points that are not finite go."""
    out = finite(samples).withColumn("label", normal_label(F.col("label"))).withColumn("probability", clamp_probability(F.col("probability")))
    return out.withColumn("is_cross_floor", F.col("label") == STAIR)


def numbered(df: DataFrame, order: list, partition: list[str] | None = None, name: str = "seq") -> DataFrame:
    """A number from 0 within each partition; without one, ranks of ordered ranges are added up, so no task sorts all rows.

    The ranges are written once, because a second look at them may cut them elsewhere.
    """
    if partition:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)).cast("long") - 1)
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranked = written(parts.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long") - 1), "numbered")
    sizes = ranked.groupBy("_part").agg(F.max("_own").alias("_last"))
    # a row for each partition
    before = sizes.select("_part", F.coalesce(F.sum(F.col("_last") + 1).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranked.join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def stride_sample(df: DataFrame, most: int, seq: str = "seq", partition: list[str] | None = None) -> DataFrame:
    """Every ceil(n / most)th row; with 51 rows and at most 50 that is every second one."""
    n = df.groupBy(*(partition or [])).agg(F.count(F.lit(1)).alias("_n"))
    joined = df.join(n, partition) if partition else df.crossJoin(F.broadcast(n))  # one row
    return joined.where(F.pmod(F.col(seq), F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(float(most))))) == 0).drop("_n")


def linspace_sample(df: DataFrame, most: int, seq: str = "seq") -> DataFrame:
    """Rows floor(i * (n - 1) / (m - 1)) for i under m = min(most, n), for a sequence from 0."""
    n = df.agg(F.count(F.lit(1)).alias("_n")).select("_n", F.least(F.col("_n"), F.lit(most)).alias("_m"))
    at = n.select(F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("_m") - 1, F.lit(0)))).alias("_i"), "_n", "_m").where("_n > 0")
    at = at.select(F.floor(F.when(F.col("_m") > 1, F.col("_i") * (F.col("_n") - 1) / (F.col("_m") - 1)).otherwise(0)).alias(seq)).distinct()
    return df.join(at, seq, "left_semi")


def evenly(rank: Column, n: Column, count: Column) -> Column:
    """Whether rank r of n is one of floor(i * n / count), i under count: whole numbers only."""
    i = F.floor((rank * count + n - 1) / n).cast("long")
    return (count > 0) & F.when(count >= n, F.lit(True)).otherwise((i < count) & (i * n < (rank + 1) * count))


def semantic_rule(df: DataFrame, name: str = "scoped_name", kind: str = "geometry_type", key: str = "entity_key") -> DataFrame:
    """Label, probability and entity id of a scene entity, from its name and geometry; a floor that is named after stairs is a floor."""
    said = F.lower(F.col(name))
    floor = said.contains("floor") | said.contains("ground") | (F.col(kind) == "PLANE")
    stair = said.contains("stair")
    label = F.when(floor, 0).when(stair, STAIR).otherwise(OBSTACLE)
    probability = F.when(floor, 0.05).when(stair, 0.25).otherwise(0.95).cast("float")
    return df.withColumn("label", label).withColumn("probability", probability).withColumn("entity_id", F.col(key).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def to_world(points: DataFrame, poses: DataFrame, key: str = "entity_id") -> DataFrame:
    """Local points turned and moved by the pose of their entity (qw, qx, qy, qz, tx, ty, tz)."""
    joined = points.join(poses, key)
    q = tuple(d(c) for c in ("qw", "qx", "qy", "qz"))
    turned = rotate(q, (d("x"), d("y"), d("z")))
    moved = [(v + d(t)).cast("float").alias(a) for v, t, a in zip(turned, ("tx", "ty", "tz"), "xyz", strict=True)]
    rest = [c for c in points.columns if c not in ("x", "y", "z")]
    return joined.select(*rest, *moved)


def quota_sample(cloud: DataFrame, budget: int, seq: str = "seq") -> DataFrame:
    """At most `budget` rows: a quota for each entity (in order of entity_id), then stairs up to 1/5 and obstacles up to 2/5
    of the budget, then free points, then an even stride over all, then the first rows left; in the order of `seq`.

    Every stage ranks within entities or classes, and takes what the budget still has; `seq` counts from 0 over the cloud.
    """
    kind = F.when(F.col("label") == STAIR, 2).when((F.col("label") == OBSTACLE) | (d("probability") >= 0.5), 1).otherwise(0)
    total = cloud.agg(F.count(F.lit(1)).alias("_n"))
    base = cloud.withColumn("_kind", kind).crossJoin(F.broadcast(total))  # one row
    # counts of entities and classes: small tables, joined by key
    first = Window.partitionBy("entity_id").orderBy(seq)
    base = base.withColumn("_r", F.row_number().over(first).cast("long") - 1)
    entity = base.groupBy("entity_id").agg(F.count(F.lit(1)).alias("_e"), F.min_by("_kind", seq).alias("_first"))
    entity = entity.withColumn("_quota", F.least(F.when(F.col("_first") == 2, 96).when(F.col("_first") == 1, 64).otherwise(32).cast("long"), F.lit(10**18)))
    entity = numbered(entity, ["entity_id"], name="_at")
    # a quota is cut when the entities before have used up the budget
    entity = entity.withColumn("_used", F.least("_quota", "_e"))
    running = numbered_sum(entity, "_at", "_used")
    entity = running.withColumn("_count", F.greatest(F.lit(0).cast("long"), F.least("_quota", F.lit(budget) - F.col("_sum_before"))))
    base = base.join(entity.select("entity_id", "_e", "_count"), "entity_id")
    base = base.withColumn("_in", F.when(F.col("_n") <= budget, True).otherwise(evenly(F.col("_r"), F.col("_e"), F.col("_count"))))

    def stage(df: DataFrame, members: Column, target: Column) -> DataFrame:
        """Of the members, an even choice of as many as the target and the budget allow; those in already count as chosen."""
        df = written(df, "quota")  # each stage reads the one before three times
        taken = df.agg(F.sum(F.col("_in").cast("long")).alias("_taken"), F.sum(members.cast("long")).alias("_m"))
        df = df.crossJoin(F.broadcast(taken))  # one row
        own = numbered(df.where(members).select(seq), [seq], name="_k")
        df = df.join(own, seq, "left")
        count = F.least(target, F.lit(budget) - F.col("_taken"))
        want = members & evenly(F.col("_k"), F.col("_m"), count) & ~F.col("_in")
        df = df.withColumn("_in", F.col("_in") | F.coalesce(want, F.lit(False)))
        return df.drop("_taken", "_m", "_k")

    base = stage(base, F.col("_kind") == 2, F.least(F.col("_m"), F.lit(budget // 5).cast("long")))
    base = stage(base, F.col("_kind") == 1, F.least(F.col("_m"), F.lit(2 * budget // 5).cast("long")))
    base = stage(base, F.col("_kind") == 0, F.lit(budget).cast("long"))

    def fill(df: DataFrame, members: Column) -> DataFrame:
        """Members that are not in yet, in order, until the budget is full."""
        df = written(df, "quota")
        taken = df.agg(F.sum(F.col("_in").cast("long")).alias("_taken"))
        free = numbered(df.where(members & ~F.col("_in")).select(seq), [seq], name="_k")
        df = df.crossJoin(F.broadcast(taken)).join(free, seq, "left")
        return df.withColumn("_in", F.col("_in") | F.coalesce(F.col("_k") < F.lit(budget) - F.col("_taken"), F.lit(False))).drop("_taken", "_k")

    base = fill(base, evenly(F.col(seq), F.col("_n"), F.lit(budget).cast("long")))
    base = fill(base, F.lit(True))
    return base.where("_in").select(*cloud.columns)


def numbered_sum(df: DataFrame, at: str, value: str, blocks: int = 1024) -> DataFrame:
    """_sum_before: the sum of `value` over the rows before, by the number `at`: within blocks of rows, and over the blocks."""
    df = df.withColumn("_block", F.floor(F.col(at) / blocks))
    own = Window.partitionBy("_block").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0)))
    sums = df.groupBy("_block").agg(F.sum(value).alias("_s"))
    sums = sums.select("_block", F.coalesce(F.sum("_s").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_blocks_before"))
    return df.join(sums, "_block").withColumn("_sum_before", F.col("_own") + F.col("_blocks_before")).drop("_block", "_own", "_blocks_before")
