"""Links between leaves that touch, what they cost, and labels that spread along them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import OBSTACLE, STAIR, OctreeConfig
from ..functions.geometry import AXES, d, nearly_touches, place, ranges_overlap
from .octree import holding

#: How far outside a face it is probed; the order of directions is +x -x +y -y +z -z.
REACH, BLOCKED_COST = 1e-4, 1e6
KEY = ["frame_id", "depth", "path"]


def blocked(prefix: str, cfg: OctreeConfig) -> Column:
    return (F.col(f"{prefix}label") == OBSTACLE) | (d(f"{prefix}probability") >= cfg.blocked_probability)


def stair_like(prefix: str = "") -> Column:
    return (F.col(f"{prefix}label") == STAIR) | F.col(f"{prefix}is_cross_floor")


def face_probes(leaves: DataFrame) -> DataFrame:
    """Five points just outside each of the six faces of each leaf: the middle, and a quarter in along both other axes."""
    probes = []
    for direction in range(6):
        axis, up = AXES[direction // 2], direction % 2 == 0
        others = [a for a in AXES if a != axis]
        at = d(f"max_{axis}") + REACH if up else d(f"min_{axis}") - REACH
        for k in range(5):
            point = {axis: at} | {a: F.col(f"c{a}") for a in others}
            if k:
                a = others[(k - 1) // 2]
                quarter = (d(f"max_{a}") - d(f"min_{a}")) * 0.25
                point[a] = d(f"min_{a}") + quarter if k % 2 else d(f"max_{a}") - quarter
            probes.append(F.struct(F.lit(direction).alias("dir"), F.lit(k).alias("probe"), *[point[a].cast("float").alias(a) for a in AXES]))
    return leaves.withColumn("p", F.explode(F.array(*probes))).select("*", "p.*").drop("p")


#: What links need of a leaf, and what they carry of it.
FACTS = ["depth", "path", "label", "probability", "is_cross_floor", "room_id", *[f"{s}_{a}" for s in ("min", "max") for a in AXES], *[f"c{a}" for a in AXES]]
CARRIED = [*FACTS[:6], "dynamic", *FACTS[6:]]


def face_links(leaves: DataFrame, roots: DataFrame, cfg: OctreeConfig) -> DataFrame:
    """src_depth, src_path, dir, dst_depth, dst_path, distance, score and probe: for each direction, of the leaves probed and open, the nearest, deeper ones counting as farther off; the first probe wins ties."""
    at = place("depth", "path")
    probes = face_probes(leaves.select("frame_id", at.alias("src_place"), *FACTS)).select("frame_id", "src_place", "dir", "probe", *AXES)
    met = holding(probes, leaves, roots, cfg, ["frame_id", "src_place", "dir", "probe"]).where(F.col("src_place") != F.col("_place"))
    # several probes meet one leaf: the first of them counts
    met = met.groupBy("frame_id", "src_place", "dir", F.col("_place").alias("dst_place")).agg(F.min("probe").alias("probe"))
    for e in ("src", "dst"):
        met = met.join(leaves.select("frame_id", at.alias(f"{e}_place"), *[F.col(c).alias(f"{e}_{c}") for c in FACTS]).hint("merge"), ["frame_id", f"{e}_place"])
    same_room = F.col("src_room_id") == F.col("dst_room_id")
    lifted = (F.col("dir") >= 4) & stair_like("src_") & stair_like("dst_")
    touching = F.lit(False)
    for direction in range(6):
        axis = AXES[direction // 2]
        near, far = ("src_max", "dst_min") if direction % 2 == 0 else ("src_min", "dst_max")
        rest = [ranges_overlap("src_", "dst_", a) for a in AXES if a != axis]
        touching = touching | ((F.col("dir") == direction) & nearly_touches(F.col(f"{near}_{axis}"), F.col(f"{far}_{axis}")) & rest[0] & rest[1])
    ok = met.where(~blocked("dst_", cfg) & (same_room | lifted) & touching)
    x, y, z = (F.col(f"src_c{a}") - F.col(f"dst_c{a}") for a in AXES)
    away = F.sqrt(x * x + y * y + z * z)
    ok = ok.withColumn("distance", away).withColumn("score", away + F.col("dst_depth") * 0.02)
    best = ok.groupBy("frame_id", "src_depth", "src_path", "dir").agg(F.min_by(F.struct("dst_depth", "dst_path", "distance", "score", "probe"), F.struct("score", "probe")).alias("e"))
    return best.select("frame_id", "src_depth", "src_path", "dir", "e.*")


def face_neighbors(leaves: DataFrame, roots: DataFrame, cfg: OctreeConfig) -> DataFrame:
    """face_links() with the src_ and dst_ columns of the leaves at both ends."""
    out = face_links(leaves, roots, cfg)
    for e in ("src", "dst"):
        out = out.join(leaves.select("frame_id", *[F.col(c).alias(f"{e}_{c}") for c in CARRIED]).hint("merge"), ["frame_id", f"{e}_depth", f"{e}_path"])
    return out


def traversal_cost(cfg: OctreeConfig, prefix: str = "", allow_cross_floor: bool = True) -> Column:
    """The cost of a metre inside a leaf."""
    stair = F.when(F.col(f"{prefix}label") == STAIR, 1.75).otherwise(0.0)
    cross = F.when(F.col(f"{prefix}is_cross_floor") & F.lit(not allow_cross_floor), 5.0).otherwise(0.0)
    moving = F.when(F.col(f"{prefix}dynamic"), 0.75).otherwise(0.0)
    open_cost = 1.0 + d(f"{prefix}depth") * 0.08 + d(f"{prefix}probability") * 9.0 + stair + cross + moving
    return F.when(blocked(prefix, cfg), F.lit(BLOCKED_COST)).otherwise(open_cost)


def traversal_info(edges: DataFrame, cfg: OctreeConfig, allow_cross_floor: bool = True) -> DataFrame:
    """Edges that can be walked, with cost = distance * cost of a metre at the far end."""
    open_rooms = (F.col("src_room_id") == F.col("dst_room_id")) | (stair_like("src_") & stair_like("dst_"))
    return edges.where(~blocked("dst_", cfg) & open_rooms).withColumn("cost", F.col("distance") * traversal_cost(cfg, "dst_", allow_cross_floor))


def override_labels(leaves: DataFrame, labels: DataFrame) -> DataFrame:
    """Leaves with label, probability, room_id and is_cross_floor taken from `labels` (frame_id, depth, path and those) where it has them."""
    changed = ["label", "probability", "room_id", "is_cross_floor"]
    given = labels.select(*KEY, *[F.col(c).alias(f"_{c}") for c in changed])
    out = leaves.join(given, KEY, "left")
    for c in changed:
        out = out.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c)))
    out = out.withColumn("is_cross_floor", F.col("is_cross_floor") | (F.col("_label").isNotNull() & (F.col("label") == STAIR)))
    return out.drop(*[f"_{c}" for c in changed])


def apply_predictor(leaves: DataFrame, predicted: Column) -> DataFrame:
    """Leaves relabelled by a column of struct<label, probability, room_id, is_cross_floor>, an expression or a pandas UDF."""
    out = leaves.withColumn("_p", predicted)
    out = out.withColumn("label", F.col("_p.label")).withColumn("probability", F.greatest(F.lit(0.0), F.least(F.lit(1.0), d("_p.probability"))).cast("float"))
    return out.withColumn("room_id", F.col("_p.room_id")).withColumn("is_cross_floor", F.col("_p.is_cross_floor") | (F.col("label") == STAIR)).drop("_p")


def flood_fill(leaves: DataFrame, links: DataFrame, seeds: DataFrame, cfg: OctreeConfig) -> DataFrame:
    """Leaves after the labels of the seeds (frame_id, depth, path) have spread along links, at most flood_fill_max_depth away.

    An obstacle raises probabilities, less with each step, and makes obstacles from 0.7 on; a stair makes free leaves
    stairs. What several seeds do to a leaf is combined: the highest probability and an obstacle before a stair.
    """
    start = seeds.select(*KEY).distinct().join(leaves.select(*KEY, "label", "probability", "room_id", "is_cross_floor"), KEY)
    reach = start.select("frame_id", F.struct("depth", "path").alias("seed"), F.col("label").alias("s_label"), d("probability").alias("s_p"), F.col("room_id").alias("s_room"), F.col("is_cross_floor").alias("s_cross"), "depth", "path").withColumn("step", F.lit(0))
    steps = links.select("frame_id", F.col("src_depth").alias("depth"), F.col("src_path").alias("path"), F.col("dst_depth").alias("to_depth"), F.col("dst_path").alias("to_path"))
    facts = leaves.select("frame_id", F.col("depth").alias("to_depth"), F.col("path").alias("to_path"), F.col("room_id").alias("to_room"), F.col("is_cross_floor").alias("to_cross"))
    every, now = reach, reach
    carried = ["seed", "s_label", "s_p", "s_room", "s_cross"]
    for step in range(1, cfg.flood_fill_max_depth + 1):
        now = now.join(steps, KEY).join(facts, ["frame_id", "to_depth", "to_path"])
        now = now.where((F.col("to_room") == F.col("s_room")) | (F.col("s_cross") & F.col("to_cross")))
        now = now.select("frame_id", *carried, F.col("to_depth").alias("depth"), F.col("to_path").alias("path")).distinct().withColumn("step", F.lit(step))
        now = now.join(every.select("frame_id", "seed", "depth", "path"), ["frame_id", "seed", "depth", "path"], "left_anti").select(*every.columns)
        every = every.union(now)
    hit = every.where("step > 0").withColumn("lifted", F.when(F.col("s_label") == OBSTACLE, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s_p") * (1.0 - F.col("step") * 0.3)))))
    hit = hit.groupBy(*KEY).agg(F.max("lifted").alias("lifted"), F.bool_or(F.col("s_label") == STAIR).alias("stair"))
    out = leaves.join(hit, KEY, "left")
    p = F.greatest(d("probability"), F.coalesce("lifted", F.lit(0.0)))
    block = F.col("lifted").isNotNull() & (p >= 0.7)
    stair = F.coalesce("stair", F.lit(False)) & (F.col("label") == 0) & ~block
    out = out.withColumn("_p", F.when(stair, F.least(p, F.lit(0.35))).otherwise(p)).withColumn("_stair", stair).withColumn("_block", block)
    out = out.withColumn("label", F.when(F.col("_block"), OBSTACLE).when(F.col("_stair"), STAIR).otherwise(F.col("label")))
    return out.withColumn("is_cross_floor", F.col("is_cross_floor") | F.col("_stair")).withColumn("probability", F.col("_p").cast("float")).drop("_p", "_stair", "_block", "lifted", "stair")
