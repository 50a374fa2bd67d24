"""The adaptive octree as aggregations over cell paths.

A point's path at full depth fixes all cells above it, so the tree is: points counted by full path, prefixes exploded,
counts added up, a split flag for each prefix, and the first prefix that does not split as each path's leaf. Every cell
is known by (frame_id, depth, path); nothing recurses and nothing is collected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..config import OBSTACLE, STAIR, OctreeConfig
from ..functions.geometry import AXES, box_contains, cell_bounds, cell_code, cell_codes, d, extent, max_extent, morton, place

ROOT = [f"root_{side}_{a}" for side in ("min", "max") for a in AXES]


def root_bounds(samples: DataFrame, key: str = "frame_id") -> DataFrame:
    """The root box of each frame: what the points span, padded, in float32."""
    f = F.lit
    ends = samples.groupBy(key).agg(*[fn(a).alias(f"{side}_{a}") for side, fn in (("lo", F.min), ("hi", F.max)) for a in AXES])
    span = F.greatest(*[F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in AXES], f(1.0).cast("float"))
    pad = F.greatest(f(0.5).cast("float"), (f(0.02).cast("float") * span).cast("float"))
    ends = ends.withColumn("pad", pad)
    return ends.select(key, *[(F.col(f"lo_{a}") - F.col("pad")).cast("float").alias(f"root_min_{a}") for a in AXES], *[(F.col(f"hi_{a}") + F.col("pad")).cast("float").alias(f"root_max_{a}") for a in AXES])


#: The box of a cloud without points.
EMPTY_ROOT = {"root_min_x": 0.0, "root_min_y": 0.0, "root_min_z": 0.0, "root_max_x": 20.0, "root_max_y": 20.0, "root_max_z": 5.0}


def root_bounds_of(frames: DataFrame, samples: DataFrame, key: str = "frame_id") -> DataFrame:
    """The root box of every frame in `frames` (key), also of those without points."""
    own = root_bounds(samples, key)
    return frames.select(key).distinct().join(own, key, "left").select(key, *[F.coalesce(F.col(c), F.lit(v).cast("float")).alias(c) for c, v in EMPTY_ROOT.items()])


def with_root(df: DataFrame, roots: DataFrame) -> DataFrame:
    """A box for each frame is a small table; the optimizer sends it to all tasks where its size allows."""
    return df.join(roots, "frame_id")


def encoded(samples: DataFrame, roots: DataFrame, cfg: OctreeConfig) -> DataFrame:
    """Samples with their path at full depth."""
    return with_root(samples, roots).withColumn("code", cell_code(cfg.max_depth)(*AXES, *ROOT)).drop(*ROOT)


def _prefix(code, depth, cfg: OctreeConfig):
    return F.expr(f"shiftright({code}, cast(3 * ({cfg.max_depth} - {depth}) as int))")


def cells(samples: DataFrame, cfg: OctreeConfig) -> DataFrame:
    """Points and stair flag of each full path that has points."""
    stair = F.col("has_semantics") & ((F.col("label") == STAIR) | F.col("is_cross_floor"))
    return samples.groupBy("frame_id", "code").agg(F.count(F.lit(1)).alias("n"), F.bool_or(stair).alias("has_stair"))


def prefixes(full: DataFrame, cfg: OctreeConfig) -> DataFrame:
    """Counts of all cells at all depths."""
    every = full.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(cfg.max_depth)))).withColumn("path", _prefix("code", "depth", cfg))
    return every.groupBy("frame_id", "depth", "path").agg(F.sum("n").alias("n"), F.bool_or("has_stair").alias("has_stair"))


def with_bounds(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    out = with_root(nodes, roots).withColumn("b", cell_bounds()("path", F.col("depth").cast("long"), *ROOT))
    return out.select(*nodes.columns, *ROOT, "b.*")


def volume():
    return extent("x") * extent("y") * extent("z")


def splits(cfg: OctreeConfig):
    """Whether a cell with depth, n, has_stair and bounds splits."""
    size = max_extent()
    least = F.when(F.col("has_stair"), cfg.stair_min_voxel).otherwise(cfg.corridor_min_voxel)
    most = F.when(F.col("has_stair"), cfg.stair_max_voxel).otherwise(cfg.corridor_max_voxel)
    can = (F.col("depth") < cfg.max_depth) & (F.col("n") >= cfg.min_points_to_split) & (size > least.cast("float").cast("double"))
    dense = F.coalesce(F.try_divide(d("n"), volume()), F.lit(0.0)) > cfg.dense_points_per_m3
    return can & ((size > most.cast("float").cast("double")) | dense | (F.col("n") > cfg.dense_points_to_split))


def levels(full: DataFrame, roots: DataFrame, cfg: OctreeConfig) -> DataFrame:
    """All candidate cells with bounds and the split flag."""
    return with_bounds(prefixes(full, cfg), roots).withColumn("split", splits(cfg))


def leaf_depths(full: DataFrame, roots: DataFrame, cfg: OctreeConfig) -> DataFrame:
    """The depth of each full path's leaf: the first cell on it that does not split."""
    flags = levels(full, roots, cfg).where("not split").select("frame_id", "depth", "path")
    every = full.select("frame_id", "code", F.explode(F.sequence(F.lit(0), F.lit(cfg.max_depth))).alias("depth")).withColumn("path", _prefix("code", "depth", cfg))
    return every.join(flags.hint("merge"), ["frame_id", "depth", "path"]).groupBy("frame_id", "code").agg(F.min("depth").alias("leaf_depth"))


def assigned(samples: DataFrame, roots: DataFrame, cfg: OctreeConfig) -> DataFrame:
    """Samples with the depth and path of their leaf."""
    coded = encoded(samples, roots, cfg)
    depths = leaf_depths(cells(coded, cfg), roots, cfg)
    out = coded.join(depths.hint("merge"), ["frame_id", "code"]).withColumnRenamed("leaf_depth", "depth")
    return out.withColumn("path", _prefix("code", "depth", cfg))


def nodes(samples: DataFrame, roots: DataFrame, cfg: OctreeConfig) -> DataFrame:
    """All nodes of the tree, leaves flagged, numbered in depth-first order."""
    coded = encoded(samples, roots, cfg)
    full = cells(coded, cfg)
    depths = leaf_depths(full, roots, cfg)
    every = full.join(depths, ["frame_id", "code"]).select("frame_id", "n", "has_stair", "code", "leaf_depth", F.explode(F.sequence(F.lit(0), F.col("leaf_depth"))).alias("depth"))
    every = every.withColumn("path", _prefix("code", "depth", cfg))
    tree = every.groupBy("frame_id", "depth", "path").agg(F.sum("n").alias("n"), F.bool_or(F.col("depth") == F.col("leaf_depth")).alias("leaf"))
    return with_index(with_bounds(tree, roots), cfg)


def with_index(tree: DataFrame, cfg: OctreeConfig) -> DataFrame:
    """node_index: a cell comes before what is below it, and cells at one place by octant."""
    return in_order(tree, cfg, "node_index")


#: Cells are numbered by blocks of the order, the cells of this depth, so that no task sorts a frame.
BLOCK_DEPTH = 5


def in_order(tree: DataFrame, cfg: OctreeConfig, name: str) -> DataFrame:
    """The depth-first rank of each cell in its frame: its rank in its block, and the sizes of the blocks before."""
    at = F.expr(f"shiftleft(path, cast(3 * ({cfg.max_depth} - depth) as int))")
    down = 3 * max(0, cfg.max_depth - BLOCK_DEPTH)
    placed = tree.withColumn("_at", at).withColumn("_block", F.shiftright("_at", down))
    sizes = placed.groupBy("frame_id", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("frame_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("frame_id", "_block", F.coalesce(before, F.lit(0)).alias("_before"))  # at most 8 ** BLOCK_DEPTH rows for a frame
    own = F.row_number().over(Window.partitionBy("frame_id", "_block").orderBy("_at", "depth")) - 1
    return placed.withColumn("_own", own).join(sizes, ["frame_id", "_block"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_at", "_block", "_own", "_before")


def octal_path(depth: str = "depth", path: str = "path"):
    return F.when(F.col(depth) == 0, "").otherwise(F.lpad(F.conv(F.col(path).cast("string"), 10, 8), F.col(depth), F.lit("0")))


def votes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Label, probability, room, entity and cross-floor flag of each group, by its samples with semantics.

    Ties: stairs before obstacles before free; the smallest room and entity.
    """
    return voted(rows.where("has_semantics"), keys).drop("n")


def voted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """votes() and n, the number of all samples, in one aggregation; a group without semantics has null votes."""
    said = F.col("has_semantics")
    counts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(said & (F.col("label") == i)).alias(f"n{i}") for i in (0, OBSTACLE, STAIR)],
        F.avg(F.when(said, d("probability"))).alias("p"),
        F.bool_or(said & F.col("is_cross_floor")).alias("cross"),
        *[F.mode(F.when(said, F.col(c)), True).alias(c) for c in ("room_id", "entity_id")],
    )
    label = F.when((F.col("n2") >= F.col("n1")) & (F.col("n2") >= F.col("n0")), STAIR).when(F.col("n1") >= F.col("n0"), OBSTACLE).otherwise(0)
    some = F.col("p").isNotNull()
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p"))).cast("float")
    return counts.select(*keys, "n", F.when(some, label).alias("label"), F.when(some, clamped).alias("probability"), F.when(some, F.col("cross") | (F.col("n2") > 0)).alias("is_cross_floor"), "room_id", "entity_id")


def leaves(samples: DataFrame, cfg: OctreeConfig, roots: DataFrame | None = None) -> DataFrame:
    """Leaves with bounds, counts, votes and centre."""
    roots = root_bounds(samples) if roots is None else roots
    own = assigned(samples, roots, cfg)
    keys = ["frame_id", "depth", "path"]
    out = with_bounds(voted(own, keys), roots)
    zero = {"label": 0, "probability": 0.0, "is_cross_floor": False, "room_id": 0, "entity_id": 0}
    out = out.fillna(zero).withColumn("dynamic", F.lit(False))
    return out.select("*", *[((d(f"min_{a}") + d(f"max_{a}")) * 0.5).alias(f"c{a}") for a in AXES])


def with_morton(tree: DataFrame, cfg: OctreeConfig) -> DataFrame:
    """morton_code: the long with the code's bits (not a key: neighbouring cells can share one)."""
    half = F.lit(0.5).cast("float")
    centre = tuple((half * (F.col(f"min_{a}") + F.col(f"max_{a}"))).cast("float") for a in AXES)
    return tree.withColumn("morton_code", morton(F.col("depth"), cfg.max_depth, centre))


def eigen():
    """A column function (six second moments) -> eigenvalues, smallest first, and the direction of the smallest."""

    @pandas_udf("e0 double, e1 double, e2 double, nx double, ny double, nz double")
    def _eigen(xx: pd.Series, yy: pd.Series, zz: pd.Series, xy: pd.Series, xz: pd.Series, yz: pd.Series) -> pd.DataFrame:
        m = np.zeros((len(xx), 3, 3))
        for (i, j), s in zip(((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)), (xx, yy, zz, xy, xz, yz), strict=True):
            m[:, i, j] = m[:, j, i] = s.fillna(0).to_numpy()
        values, vectors = np.linalg.eigh(m)
        normal = vectors[:, :, 0]
        # the sign that makes z, or else y, or else x positive
        lead = np.where(np.abs(normal[:, 2]) > 1e-12, normal[:, 2], np.where(np.abs(normal[:, 1]) > 1e-12, normal[:, 1], normal[:, 0]))
        normal = normal * np.where(lead < 0, -1.0, 1.0)[:, None]
        return pd.DataFrame(np.concatenate([np.maximum(values, 0), normal], 1), columns=["e0", "e1", "e2", "nx", "ny", "nz"])

    return _eigen


def pca(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Centroid, eigenvalues of the covariance, normal and shape measures of each group of points.

    Under three points there is a centroid only; where the points coincide the normal is zero.
    """
    x, y, z = (d(a) for a in AXES)
    moments = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(d(a)).alias(f"centroid_{a}") for a in AXES],
        F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.var_pop(z).alias("zz"),
        F.covar_pop(x, y).alias("xy"), F.covar_pop(x, z).alias("xz"), F.covar_pop(y, z).alias("yz"),
    )
    out = moments.withColumn("g", eigen()("xx", "yy", "zz", "xy", "xz", "yz")).select(*keys, "n", *[f"centroid_{a}" for a in AXES], "g.*")
    enough = F.col("n") >= 3
    total = F.col("e0") + F.col("e1") + F.col("e2")
    shaped = enough & (total >= 1e-8) & (F.col("e2") >= 1e-8)

    def ratio(a, b):
        return F.when(shaped, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(a, b)))).otherwise(F.lit(0.0))

    zero = F.lit(0.0)
    return out.select(
        *keys, "n", *[f"centroid_{a}" for a in AXES],
        *[F.when(enough, F.col(f"e{i}")).otherwise(zero).alias(f"eigenvalue_{i}") for i in range(3)],
        *[F.when(shaped, F.col(f"n{a}")).otherwise(zero).alias(f"normal_{a}") for a in AXES],
        ratio(F.col("e2") - F.col("e1"), F.col("e2")).alias("linearity"),
        ratio(F.col("e1") - F.col("e0"), F.col("e2")).alias("flatness"),
        ratio(F.col("e0"), F.col("e2")).alias("roughness"),
        ratio(F.col("e0"), total).alias("curvature"),
    )


#: Points meet leaves in cells of this depth: a leaf above it is dealt to the cells below, of which a frame has 8 ** HELD_DEPTH.
HELD_DEPTH = 4


def _find(batches):
    """key columns, _place and _order of each point (_kind 1) of a lot (frame_id, _block) that one of the lot's leaves holds, which come first (_kind 0).

    A leaf is the codes from _codes[0] to _codes[1], and no two leaves share a code: the one that holds a code is the
    last that begins at it or before.
    """
    lot, kept = None, None
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("frame_id", "_block", "_kind")}
        change = np.concatenate([[(c["frame_id"][0], c["_block"][0]) != lot], (c["frame_id"][1:] != c["frame_id"][:-1]) | (c["_block"][1:] != c["_block"][:-1])])
        of = np.cumsum(change)  # 0: the lot that the batch before ended in
        ends, codes = batch.column("_codes").offsets.to_numpy(), batch.column("_codes").values.to_numpy()
        at = np.stack([batch.column(f"_{a}").to_numpy(zero_copy_only=False).astype(float) for a in AXES], 1)
        leaf, point = np.flatnonzero(c["_kind"] == 0), np.flatnonzero(c["_kind"] == 1)
        own = (of[leaf], *(codes[ends[leaf] + i] for i in range(3)), at[leaf])
        if kept is not None:
            own = tuple(np.concatenate([a, b]) for a, b in zip(kept, own, strict=True))
        last = own[0] == of[-1]
        lot, kept = (c["frame_id"][-1], c["_block"][-1]), (np.zeros(last.sum(), np.int64), *(x[last] for x in own[1:]))
        many = np.diff(ends)[point]
        row = np.repeat(point, many)
        code = codes[np.repeat(ends[point] - (np.cumsum(many) - many), many) + np.arange(len(row))]
        lots, first, until, place_of, upper = own
        if len(lots) == 0 or len(row) == 0:
            continue
        order = np.lexsort((np.repeat([0, 1], [len(lots), len(row)]), np.concatenate([first, code]), np.concatenate([lots, of[row]])))
        before = np.maximum.accumulate(np.where(order < len(lots), np.arange(len(order)), -1))
        asked = order >= len(lots)
        near, k = np.where(before[asked] >= 0, order[before[asked]], 0), order[asked] - len(lots)
        ok = (before[asked] >= 0) & (lots[near] == of[row[k]]) & (code[k] <= until[near])
        near, k = near[ok], k[ok]
        octant = ((at[row[k]] < upper[near]) * np.array([1, 2, 4])).sum(1)
        rank = np.where(octant == 7, -1, octant)
        by = np.lexsort((near, rank, row[k]))
        best = by[np.concatenate([[True], np.diff(row[k][by]) > 0])] if len(by) else by
        out = batch.drop_columns(["_block", "_kind", "_codes", *[f"_{a}" for a in AXES]]).take(pa.array(row[k][best]))
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(place_of[near][best]), pa.array(rank[best].astype(np.int32))], names=[*out.schema.names, "_place", "_order"])


def dealt(points: DataFrame, tree_leaves: DataFrame, roots: DataFrame, cfg: OctreeConfig, keys: list[str]) -> DataFrame:
    """Points (_kind 1) and leaves (_kind 0) by the cell (frame_id, _block) in which they meet: a row for a point, and some more for one on the cuts between these cells."""
    up = 3 * max(0, cfg.max_depth - HELD_DEPTH)
    carried = list(dict.fromkeys(["frame_id", *keys]))
    kind = dict(points.dtypes)
    kind |= {f"_{a}": kind[a] if kind[a] in ("float", "double") else "double" for a in AXES}
    inside = with_root(points.select(*dict.fromkeys([*carried, *AXES])), roots).where(box_contains()).withColumn("_codes", cell_codes(cfg.max_depth)(*AXES, *ROOT))
    inside = inside.withColumn("_block", F.explode(F.array_distinct(F.transform("_codes", lambda c: F.shiftright(c, up)))))
    asked = inside.select(*carried, "_block", F.lit(1).alias("_kind"), "_codes", *[F.col(a).cast(kind[f"_{a}"]).alias(f"_{a}") for a in AXES])
    first, until = (F.expr(f"shiftleft(path + {i}, cast(3 * ({cfg.max_depth} - depth) as int)) - {i}") for i in (0, 1))
    own = tree_leaves.withColumn("_codes", F.array(first, until, place("depth", "path")))
    own = own.withColumn("_block", F.explode(F.sequence(F.shiftright(first, up), F.shiftright(until, up))))
    own = own.select("frame_id", *[F.lit(None).cast(kind[c]).alias(c) for c in carried[1:]], "_block", F.lit(0).alias("_kind"), "_codes", *[F.col(f"max_{a}").cast(kind[f"_{a}"]).alias(f"_{a}") for a in AXES])
    return own.unionByName(asked)


def holding(points: DataFrame, tree_leaves: DataFrame, roots: DataFrame, cfg: OctreeConfig, keys: list[str]) -> DataFrame:
    """keys and _place, the place of the leaf that holds the point (frame_id, x, y, z, and keys, which tell points apart); points in no leaf are left out.

    Of several leaves whose boxes hold a point, the one wins whose upper ends are beyond it on all axes, and then the one
    with the lowest octant: the bits of the axes on which its upper end is beyond. That is told by the leaf's own box,
    because a point may lie on a cut that is finer than the leaf.
    """
    both = dealt(points, tree_leaves, roots, cfg, keys)
    fields = {f.name: f.dataType.simpleString() for f in both.schema}
    carried = list(dict.fromkeys(["frame_id", *keys]))
    both = both.repartition("frame_id", "_block").sortWithinPartitions("frame_id", "_block", "_kind")
    met = both.mapInArrow(_find, ", ".join([*(f"`{c}` {fields[c]}" for c in carried), "_place long, _order int"]))
    return met.groupBy(*keys).agg(F.min_by("_place", "_order").alias("_place"))


def locate(points: DataFrame, tree_leaves: DataFrame, roots: DataFrame, cfg: OctreeConfig, carry: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """points (frame_id, x, y, z) with the leaf that holds them: an equi-join on path prefixes; leaf columns get the prefix leaf_.

    A point on a cut belongs to the upper cell, or to the other where no leaf is there. Points outside the root box or in
    no leaf have nulls. keys: columns that tell the points apart, frame_id among them.
    """
    carry = carry or ["depth", "path"]
    keys = keys or [c for c in points.columns]
    own = tree_leaves.select("frame_id", place("depth", "path").alias("_place"), F.struct(*carry).alias("leaf"))
    best = holding(points, tree_leaves, roots, cfg, keys).join(own.hint("merge"), ["frame_id", "_place"]).select(*keys, "leaf")
    out = points.join(best, keys, "left")
    return out.select(*points.columns, *[F.col(f"leaf.{c}").alias(f"leaf_{c}") for c in carry])
