"""The planner's graph: stairs, obstacles, edge costs, and the search over it.

Radius joins meet in grid cells: one side lies in its cell, the other is dealt to the cells around, and the exact
predicate follows, so every join is an equi-join. Only the search itself runs in Python, one (frame, query) at a time.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import OBSTACLE, STAIR, OctreeConfig, PlannerConfig
from ..functions.components import smallest_reachable, written
from ..functions.geometry import AXES, d, extent, max_extent
from .neighbors import stair_like, traversal_info
from .octree import in_order, locate

NODE = ["leaf_id", "label", "probability", "is_cross_floor", "room_id", "entity_id", "dynamic", "depth", *[f"{s}_{a}" for s in ("min", "max") for a in AXES], *[f"c{a}" for a in AXES]]


def with_leaf_id(leaves: DataFrame, cfg: OctreeConfig) -> DataFrame:
    """leaf_id: numbers in depth-first order, so that the smallest id is the first leaf."""
    return in_order(leaves, cfg, "leaf_id")


def traversable(cfg: PlannerConfig, prefix: str = "") -> Column:
    return (F.col(f"{prefix}label") != OBSTACLE) & (d(f"{prefix}probability") < cfg.obstacle_block_probability)


def _side(df: DataFrame, prefix: str, columns: list[str] | None = None) -> DataFrame:
    return df.select("frame_id", *[F.col(c).alias(f"{prefix}{c}") for c in columns or NODE])


def _cell(c: Column | str, size: float) -> Column:
    return F.floor(d(c) / size).cast("long")


def _gap(a: str, b: str) -> Column:
    x, y, z = (F.col(f"{a}c{k}") - F.col(f"{b}c{k}") for k in AXES)
    return F.sqrt(x * x + y * y + z * z)


def within_radius(a: DataFrame, b: DataFrame, radius: float, axes: str = "xyz", left: str = "src_", right: str = "dst_") -> DataFrame:
    """Pairs of rows of one frame whose cells of size `radius` touch: all pairs within it, and some more."""
    own = [_cell(f"{left}c{k}", radius).alias(f"_{k}") for k in axes]
    near = b
    for k in axes:
        cell = _cell(f"{right}c{k}", radius)
        near = near.withColumn(f"_{k}", F.explode(F.array(cell - 1, cell, cell + 1)))
    # dealt cells are many times what the optimizer takes them for: they are never gathered in the driver
    return a.select("*", *own).join(near.hint("merge"), ["frame_id", *[f"_{k}" for k in axes]]).drop(*[f"_{k}" for k in axes])


# --- endpoints ------------------------------------------------------------------------------------------------------


def endpoint_snap(queries: DataFrame, leaves: DataFrame, roots: DataFrame, octree: OctreeConfig, cfg: PlannerConfig) -> DataFrame:
    """queries (query_id, frame_id, x, y, z) with leaf_id, snapped and snap_distance: the leaf that holds the point if it
    can be walked, or else the nearest that can within the snap radius (the first on ties); null if there is none."""
    spots = queries.select("frame_id", *AXES).distinct()  # queries that share a point share its leaf
    at = ["frame_id", *AXES]
    inside = locate(spots, leaves, roots, octree, ["leaf_id", "label", "probability"], at).withColumn("_in", F.col("leaf_leaf_id").isNotNull() & F.coalesce(traversable(cfg, "leaf_"), F.lit(False)))
    if not cfg.snap_endpoints:
        found = inside.select(*at, F.col("leaf_leaf_id").alias("leaf_id"), F.lit(False).alias("snapped"), F.lit(0.0).alias("snap_distance"))
    else:
        asked = inside.where("not _in").select(*at, *[d(a).alias(f"src_c{a}") for a in AXES])
        free = _side(leaves.where(traversable(cfg)), "dst_", ["leaf_id", "cx", "cy", "cz"])
        near = within_radius(asked, free, max(cfg.endpoint_snap_radius, 1e-6)).withColumn("gap", _gap("src_", "dst_")).where(F.col("gap") <= max(0.0, cfg.endpoint_snap_radius))
        best = near.groupBy(*at).agg(F.min(F.struct("gap", "dst_leaf_id")).alias("best"))
        found = inside.join(best, at, "left").select(
            *at,
            F.when(F.col("_in"), F.col("leaf_leaf_id")).otherwise(F.col("best.dst_leaf_id")).alias("leaf_id"),
            (~F.col("_in") & F.col("best").isNotNull()).alias("snapped"),
            F.when(F.col("_in"), 0.0).otherwise(F.coalesce(F.col("best.gap"), F.lit(0.0))).alias("snap_distance"),
        )
    out = queries.select("query_id", *at).join(found, at, "left")
    return out.select("query_id", *at, "leaf_id", F.coalesce("snapped", F.lit(False)).alias("snapped"), F.coalesce("snap_distance", F.lit(0.0)).alias("snap_distance"))


# --- stairs ---------------------------------------------------------------------------------------------------------


def stairs_connect(cfg: PlannerConfig, a: str = "src_", b: str = "dst_") -> Column:
    """Whether two stair leaves belong together: near, of one entity or of none, and not too steep."""
    entity = (F.col(f"{a}entity_id") == 0) | (F.col(f"{b}entity_id") == 0) | (F.col(f"{a}entity_id") == F.col(f"{b}entity_id"))
    rise = F.abs(F.col(f"{a}cz") - F.col(f"{b}cz"))
    steep = F.greatest(F.lit(cfg.stair_step_max_vertical), F.greatest(extent("z", a), extent("z", b)) * 1.5)
    out = (_gap(a, b) <= cfg.stair_connection_radius) & entity
    return out & (rise <= steep) if cfg.constrain_stair_transitions else out


def stair_nodes(leaves: DataFrame, cfg: PlannerConfig) -> DataFrame:
    return leaves.where(stair_like() & traversable(cfg))


def stair_pairs(leaves: DataFrame, cfg: PlannerConfig) -> DataFrame:
    """frame_id, a, b: stair leaves that belong together, a < b."""
    own = stair_nodes(leaves, cfg)
    met = within_radius(_side(own, "src_"), _side(own, "dst_"), cfg.stair_connection_radius)
    return met.where((F.col("src_leaf_id") < F.col("dst_leaf_id")) & stairs_connect(cfg)).select("frame_id", F.col("src_leaf_id").alias("a"), F.col("dst_leaf_id").alias("b"))


def stair_components(leaves: DataFrame, cfg: PlannerConfig) -> DataFrame:
    """frame_id, leaf_id, component (the smallest leaf_id of the staircase)."""
    found = smallest_reachable(stair_nodes(leaves, cfg).select("frame_id", F.col("leaf_id").alias("id")), stair_pairs(leaves, cfg))
    return found.withColumnRenamed("id", "leaf_id")


def component_stats(leaves: DataFrame, components: DataFrame, cfg: PlannerConfig) -> DataFrame:
    """Of each staircase: size, heights, the centres of both ends, the direction up, and half widths at the ends."""
    own = leaves.join(components.hint("merge"), ["frame_id", "leaf_id"])
    ends = own.groupBy("frame_id", "component").agg(F.count(F.lit(1)).alias("count"), F.min("cz").alias("min_z"), F.max("cz").alias("max_z"))
    own = own.select("frame_id", "component", "cx", "cy", "cz", (F.greatest(extent("x"), extent("y")) * 0.5).alias("half")).join(ends.hint("merge"), ["frame_id", "component"])
    low, high = F.col("cz") <= F.col("min_z") + cfg.end_band, F.col("cz") >= F.col("max_z") - cfg.end_band
    own = own.withColumn("_low", low).withColumn("_high", high)
    middle = own.groupBy("frame_id", "component").agg(*[F.avg(F.when(F.col(f"_{e}"), F.col(f"c{a}"))).alias(f"{e}_{a}") for e in ("low", "high") for a in AXES])
    dx, dy = F.col("high_x") - F.col("low_x"), F.col("high_y") - F.col("low_y")
    run = F.sqrt(dx * dx + dy * dy)
    middle = middle.withColumn("up_x", F.when(run >= 1e-5, dx / run).otherwise(0.0)).withColumn("up_y", F.when(run >= 1e-5, dy / run).otherwise(0.0))
    middle = middle.withColumn("has_direction", run >= 1e-5)
    wide = own.join(middle.hint("merge"), ["frame_id", "component"])

    def half_width(e: str) -> Column:
        across = F.abs((F.col("cy") - F.col(f"{e}_y")) * F.col("up_x") - (F.col("cx") - F.col(f"{e}_x")) * F.col("up_y"))
        return F.coalesce(F.max(F.when(F.col(f"_{e}") & F.col("has_direction"), across + F.col("half"))), F.lit(0.0)).alias(f"{e}_half_width")

    widths = wide.groupBy("frame_id", "component").agg(half_width("low"), half_width("high"))
    return ends.join(middle.hint("merge"), ["frame_id", "component"]).join(widths.hint("merge"), ["frame_id", "component"])


def floor_gap(z: Column, cfg: PlannerConfig) -> Column:
    """How far a height is from the nearest floor surface; halves round away from zero."""
    story, first = max(cfg.story_height, 1e-3), cfg.floor_z + cfg.floor_surface_offset
    return F.abs(z - (F.round((z - first) / story) * story + first))


def near_floor(z: Column, cfg: PlannerConfig) -> Column:
    return floor_gap(z, cfg) <= max(0.0, cfg.stair_floor_exit_tolerance) if cfg.constrain_stair_exits else F.lit(True)


def _enters(cfg: PlannerConfig, s: str, f: str) -> Column:
    """Whether walking between a stair leaf (columns s) and a free leaf (columns f) follows the staircase (columns st_)."""
    reach = F.greatest(F.lit(cfg.stair_endpoint_tolerance), extent("z", s) * 1.5)
    floor_reach = F.greatest(F.lit(cfg.stair_floor_connection_max_vertical), extent("z", f) * 1.5)
    at_low = (F.col(f"{s}cz") <= F.col("st_min_z") + reach) & (F.col(f"{f}cz") <= F.col("st_min_z") + floor_reach)
    at_high = (F.col(f"{s}cz") >= F.col("st_max_z") - reach) & (F.col(f"{f}cz") >= F.col("st_max_z") - floor_reach)
    # out of the staircase, from its leaf to the free one
    ox, oy = F.col(f"{f}cx") - F.col(f"{s}cx"), F.col(f"{f}cy") - F.col(f"{s}cy")
    run = F.sqrt(ox * ox + oy * oy)
    along_up = F.try_divide(ox * F.col("st_up_x") + oy * F.col("st_up_y"), run)
    # the foot is left against the direction up, the head along it, and both are entered the other way round
    follows = F.when(at_low, -along_up).otherwise(along_up) >= cfg.stair_direction_dot_min

    def beside(e: str, sign: int) -> Column:
        rx, ry = F.col(f"{f}cx") - F.col(f"st_{e}_x"), F.col(f"{f}cy") - F.col(f"st_{e}_y")
        lateral = F.abs(ry * F.col("st_up_x") - rx * F.col("st_up_y"))
        forward = rx * F.col("st_up_x") + ry * F.col("st_up_y")
        return (lateral <= F.greatest(F.col(f"st_{e}_half_width"), F.lit(0.25)) + cfg.stair_entry_lateral_margin) & (forward * sign >= -cfg.stair_entry_forward_margin)

    place = F.when(at_low, beside("low", -1)).when(at_high, beside("high", 1)).otherwise(F.lit(False))
    free = ~F.col("st_has_direction") | (run < 1e-5)
    return free | (place & follows) if cfg.constrain_stair_direction else F.lit(True)


def _mixed(cfg: PlannerConfig, s: str, f: str) -> Column:
    """Whether an edge between a stair leaf (columns s, and st_ for its staircase) and a free leaf (columns f) may be walked."""
    rise = F.abs(F.col("src_cz") - F.col("dst_cz"))
    step = F.greatest(F.lit(cfg.stair_floor_connection_max_vertical), F.greatest(extent("z", "src_"), extent("z", "dst_")) * 1.5)
    reach = F.greatest(F.lit(cfg.stair_endpoint_tolerance), extent("z", s) * 1.5)
    end = (F.col(f"{s}cz") <= F.col("st_min_z") + reach) | (F.col(f"{s}cz") >= F.col("st_max_z") - reach)
    band = cfg.stair_floor_connection_max_vertical
    near = (F.col(f"{f}cz") <= F.col("st_min_z") + band) | (F.col(f"{f}cz") >= F.col("st_max_z") - band)
    floors = near_floor(F.col(f"{f}cz"), cfg) & near_floor(F.col(f"{s}cz"), cfg)
    return F.col("st_min_z").isNotNull() & end & near & floors & _enters(cfg, s, f) & (rise <= step)


def allowed_transition(cfg: PlannerConfig) -> Column:
    """Whether an edge (src_, dst_, and st_ for the staircase of its one stair end, if it has one) may be walked at all."""
    if not cfg.constrain_stair_transitions:
        return F.lit(True)
    a, b = stair_like("src_"), stair_like("dst_")
    return F.coalesce(F.when(~a & ~b, True).when(a & b, stairs_connect(cfg)).when(a, _mixed(cfg, "src_", "dst_")).otherwise(_mixed(cfg, "dst_", "src_")), F.lit(False))


#: What a leaf carries of its staircase.
STAIRCASE = ["min_z", "max_z", *[f"{e}_{a}" for e in ("low", "high") for a in AXES], "up_x", "up_y", "has_direction", "low_half_width", "high_half_width"]


def staircases(components: DataFrame, stats: DataFrame) -> DataFrame:
    """frame_id, leaf_id and the st_ columns of each stair leaf's staircase."""
    return components.join(stats.hint("merge"), ["frame_id", "component"]).select("frame_id", "leaf_id", *[F.col(c).alias(f"st_{c}") for c in STAIRCASE])


def with_staircase(edges: DataFrame, by_leaf: DataFrame) -> DataFrame:
    """Edges with the st_ columns of the staircase at their one stair end."""
    one = F.when(stair_like("src_") & ~stair_like("dst_"), F.col("src_leaf_id")).when(stair_like("dst_") & ~stair_like("src_"), F.col("dst_leaf_id"))
    return edges.withColumn("_stair", one).join(by_leaf.withColumnRenamed("leaf_id", "_stair").hint("merge"), ["frame_id", "_stair"], "left").drop("_stair")


def _within_stair_radius(a: DataFrame, b: DataFrame, cfg: PlannerConfig) -> DataFrame:
    met = within_radius(a, b, cfg.stair_connection_radius)
    met = met.where((F.col("src_leaf_id") != F.col("dst_leaf_id")) & (_gap("src_", "dst_") <= cfg.stair_connection_radius))
    if not cfg.allow_cross_floor:
        met = met.where(F.abs(F.col("src_cz") - F.col("dst_cz")) <= F.greatest(extent("z", "src_"), extent("z", "dst_")))
    return met


def stair_edges(leaves: DataFrame, cfg: PlannerConfig) -> DataFrame:
    """src_ and dst_ of pairs within the stair radius with a stair at one end or both, both open: candidates for virtual edges."""
    free = leaves.where(traversable(cfg))
    return _within_stair_radius(_side(free, "src_"), _side(free, "dst_"), cfg).where(stair_like("src_") | stair_like("dst_"))


def walkable_stair_edges(leaves: DataFrame, by_leaf: DataFrame, cfg: PlannerConfig) -> DataFrame:
    """The stair_edges() that allowed_transition() lets pass: pairs of stairs, and of stairs with free leaves either way.

    Each kind has a join of its own, whose conditions on one end alone thin out that end before pairs are made.
    """
    if not cfg.constrain_stair_transitions:
        return stair_edges(leaves, cfg)
    free = leaves.where(traversable(cfg))
    stair, plain = free.where(stair_like()), free.where(~stair_like())
    placed = stair.join(by_leaf.hint("merge"), ["frame_id", "leaf_id"])
    own = [c for c in by_leaf.columns if c.startswith("st_")]

    def ends(prefix: str) -> DataFrame:
        return placed.select("frame_id", *[F.col(c).alias(f"{prefix}{c}") for c in NODE], *own)

    out = _within_stair_radius(_side(stair, "src_"), _side(stair, "dst_"), cfg).where(stairs_connect(cfg))
    leave = _within_stair_radius(ends("src_"), _side(plain, "dst_"), cfg).where(_mixed(cfg, "src_", "dst_"))
    enter = _within_stair_radius(_side(plain, "src_"), ends("dst_"), cfg).where(_mixed(cfg, "dst_", "src_"))
    return out.unionByName(leave.drop(*own)).unionByName(enter.drop(*own))


# --- obstacles ------------------------------------------------------------------------------------------------------


def obstacles(leaves: DataFrame, cfg: PlannerConfig) -> DataFrame:
    """Blocked leaves with their grid cell and radii."""
    size = cfg.obstacle_cell
    w, dep, h = extent("x"), extent("y"), extent("z")
    return leaves.where(~traversable(cfg)).select(
        "frame_id", "leaf_id", "cx", "cy", "cz", h.alias("height"),
        (F.greatest(w, dep) * 0.5).alias("planar_radius"), (F.sqrt(w * w + dep * dep + h * h) * 0.5).alias("radius"),
        _cell("cx", size).alias("cell_x"), _cell("cy", size).alias("cell_y"),
    )


def obstacle_cells(leaves: DataFrame, cfg: PlannerConfig) -> DataFrame:
    """Blocked leaves by grid cell."""
    return obstacles(leaves, cfg).groupBy("frame_id", "cell_x", "cell_y").agg(F.count(F.lit(1)).alias("obstacles"), F.max("planar_radius").alias("max_radius"))


def clearance(leaves: DataFrame, cfg: PlannerConfig) -> DataFrame:
    """frame_id, leaf_id of leaves that stand too near a blocked one: a semi-join by grid cells. Stairs never do."""
    size = cfg.obstacle_cell
    block = obstacles(leaves, cfg).select("frame_id", *[F.col(c).alias(f"o_{c}") for c in ("leaf_id", "cx", "cy", "cz", "height", "planar_radius")], F.col("cell_x").alias("_x"), F.col("cell_y").alias("_y"))
    widest = block.groupBy("frame_id").agg(F.max("o_planar_radius").alias("_widest"))
    free = leaves.where((F.col("label") != OBSTACLE) & ~stair_like()).select("frame_id", "leaf_id", "cx", "cy", "cz", extent("z").alias("height"), (F.greatest(extent("x"), extent("y")) * 0.5).alias("planar_radius"))
    if not cfg.enable_obstacle_clearance or cfg.obstacle_clearance_radius <= 0:
        return free.select("frame_id", "leaf_id").where(F.lit(False))
    free = free.join(widest, "frame_id")
    # only cells that the reach touches
    reach = F.col("planar_radius") + F.col("_widest") + cfg.obstacle_clearance_radius
    for k in "xy":
        free = free.withColumn(f"_{k}", F.explode(F.sequence(_cell(F.col(f"c{k}") - reach, size), _cell(F.col(f"c{k}") + reach, size))))
    met = free.join(block.hint("merge"), ["frame_id", "_x", "_y"])
    tall = F.greatest(F.lit(cfg.obstacle_clearance_z_tolerance), (F.col("height") + F.col("o_height")) * 0.5)
    x, y = F.col("cx") - F.col("o_cx"), F.col("cy") - F.col("o_cy")
    near = (F.abs(F.col("cz") - F.col("o_cz")) <= tall) & (F.sqrt(x * x + y * y) <= F.col("planar_radius") + F.col("o_planar_radius") + cfg.obstacle_clearance_radius)
    return met.where(near).select("frame_id", "leaf_id").distinct()


def _cut(src: np.ndarray, dst: np.ndarray, src_id: np.ndarray, dst_id: np.ndarray, block: dict[str, np.ndarray], size: float, grown: float) -> np.ndarray:
    """Which lines (src, dst: points by row) pass one of the blocked leaves, which come largest first.

    Distances of all pairs come from matrix products; those too near the limit for these are taken again step by step.
    Lines that are cut are not held against smaller leaves.
    """
    cut, left = np.zeros(len(src), bool), np.arange(len(src))
    at = block["c"].mean(0)
    centre, reach, ids = block["c"] - at, block["radius"] + grown, block["id"]
    wide, cells = block["widest"][0], block["cell"]
    low, high = (np.floor((f(src[:, :2], dst[:, :2]) + w) / size) for f, w in ((np.minimum, -wide), (np.maximum, wide)))
    own = np.isin(src_id, ids).any() or np.isin(dst_id, ids).any()
    slack = 1e-9 * max(1.0, float(np.abs(centre).max() + reach[0] + np.abs(src - at).max() + np.abs(dst - at).max())) ** 2
    start, width = 0, 32
    while start < len(ids) and len(left):
        part = slice(start, start + width)
        p, r = centre[part], reach[part]
        step = max(1, 100_000 // len(p))
        for some in [left[i : i + step] for i in range(0, len(left), step)]:
            s, along = src[some] - at, dst[some] - src[some]
            square = (along * along).sum(1)
            dot = along @ p.T - (s * along).sum(1)[:, None]
            t = np.where(square[:, None] < 1e-8, 0.0, np.clip(dot / np.maximum(square, 1e-300)[:, None], 0.0, 1.0))
            over = (p * p).sum(1) + (s * s).sum(1)[:, None] - 2 * (s @ p.T) + t * (t * square[:, None] - 2 * dot) - r * r
            hit = over < -slack
            i, j = np.nonzero(np.abs(over) <= slack)
            if len(i):
                a, o = src[some[i]], block["c"][part][j]
                along, to = dst[some[i]] - a, o - a
                square = along[:, 0] * along[:, 0] + along[:, 1] * along[:, 1] + along[:, 2] * along[:, 2]
                dot = to[:, 0] * along[:, 0] + to[:, 1] * along[:, 1] + to[:, 2] * along[:, 2]
                t = np.where(square < 1e-8, 0.0, np.maximum(0.0, np.minimum(1.0, dot / np.where(square < 1e-8, 1.0, square))))
                off = to - t[:, None] * along
                hit[i, j] = np.sqrt(off[:, 0] * off[:, 0] + off[:, 1] * off[:, 1] + off[:, 2] * off[:, 2]) <= r[j]
            if own:
                hit &= (ids[part] != src_id[some][:, None]) & (ids[part] != dst_id[some][:, None])
            if r[0] > wide * (1 - 1e-9):  # only then may a leaf be near enough and out of the cells
                for k in range(2):
                    hit &= (cells[part, k] >= low[some, k][:, None]) & (cells[part, k] <= high[some, k][:, None])
            cut[some] = hit.any(1)
        left = left[~cut[left]]
        start, width = start + width, min(width * 4, 2048)
    return cut


def blocked_segments(edges: DataFrame, leaves: DataFrame, cfg: PlannerConfig, longest: float | None = None) -> DataFrame:
    """frame_id, src_leaf_id, dst_leaf_id of edges (each pair once) whose straight line passes a blocked leaf that is not at its ends.

    Only blocked leaves with their centre in a grid cell of the line's box, grown by the largest planar radius, count.
    A line lies in the lot of its middle; lots of longer lines are larger. Blocked leaves are dealt to all lots that they
    can reach, and each lot's lines stream past its blocked leaves. longest: how long edges are at most, if that is known.
    """
    if not cfg.block_edges_through_obstacles:
        return edges.select("frame_id", "src_leaf_id", "dst_leaf_id").where(F.lit(False))
    size, grown, unit = cfg.obstacle_cell, max(0.0, cfg.edge_obstacle_clearance_radius), max(cfg.stair_connection_radius, 0.25) / 2
    line = edges.select("frame_id", *[f"{e}_{c}" for e in ("src", "dst") for c in ("leaf_id", "cx", "cy", "cz")])
    half = _gap("src_", "dst_") * 0.5
    line = line.withColumn("_level", F.when(half <= unit, 0).otherwise(F.ceil(F.log2(half / unit))).cast("int"))
    span = F.pow(F.lit(2.0), F.col("_level")) * unit
    block = obstacles(leaves, cfg)
    block = block.join(block.groupBy("frame_id").agg(F.max("planar_radius").alias("_widest")), "frame_id")
    if longest is not None and longest <= 2 * unit:
        block = block.withColumn("_level", F.lit(0))
    else:
        block = block.join(line.select("frame_id", "_level").distinct(), "frame_id")
    far = span * (1 + 1e-9) + F.col("radius") + grown + 1e-9
    for k in AXES:
        block = block.withColumn(f"_{k}", F.explode(F.sequence(F.floor((F.col(f"c{k}") - far) / span), F.floor((F.col(f"c{k}") + far) / span))))
        line = line.withColumn(f"_{k}", F.floor((F.col(f"src_c{k}") + F.col(f"dst_c{k}")) * 0.5 / span))
    lot = ["frame_id", "_level", *[f"_{k}" for k in AXES]]
    columns = ["a", "b", *[f"{e}{k}" for e in "pq" for k in AXES], "cell_x", "cell_y"]
    own = block.select(*lot, F.lit(0).alias("kind"), F.col("leaf_id").alias("a"), F.lit(0).cast("long").alias("b"), *[F.col(f"c{k}").alias(f"p{k}") for k in AXES], F.col("radius").alias("qx"), F.col("_widest").alias("qy"), F.lit(0.0).alias("qz"), "cell_x", "cell_y")
    asked = line.select(*lot, F.lit(1).alias("kind"), F.col("src_leaf_id").alias("a"), F.col("dst_leaf_id").alias("b"), *[F.col(f"{e}_c{k}").alias(f"{n}{k}") for e, n in (("src", "p"), ("dst", "q")) for k in AXES], *[F.lit(0).cast("long").alias(f"cell_{k}") for k in "xy"])
    both = own.union(asked).repartition(*lot).sortWithinPartitions(*lot, "kind")
    frame = dict(edges.dtypes)["frame_id"]

    def run(batches):
        held, key, block = [], None, None
        for batch in batches:
            c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in (*lot, "kind", *columns)}
            first = np.concatenate([[True], np.any([c[n][1:] != c[n][:-1] for n in (*lot, "kind")], axis=0)])
            ends = [*np.flatnonzero(first).tolist(), batch.num_rows]
            found = np.zeros(batch.num_rows, bool)
            for i, j in zip(ends[:-1], ends[1:], strict=True) if batch.num_rows else ():
                now = tuple(c[n][i] for n in lot)
                if now != key:
                    held, key, block = [], now, None
                if c["kind"][i] == 0:
                    held.append(np.column_stack([c[n][i:j].astype(float) for n in ("px", "py", "pz", "qx", "qy", "cell_x", "cell_y")]))
                    held.append(c["a"][i:j])
                    continue
                if not held:
                    continue
                if block is None:
                    rows, ids = np.concatenate(held[::2]), np.concatenate(held[1::2])
                    by = np.argsort(-rows[:, 3], kind="stable")
                    rows = rows[by]
                    block = {"c": rows[:, :3].copy(), "radius": rows[:, 3], "widest": rows[:, 4], "cell": rows[:, 5:], "id": ids[by]}
                p, q = (np.column_stack([c[f"{e}{k}"][i:j] for k in AXES]) for e in "pq")
                found[i:j] = _cut(p, q, c["a"][i:j], c["b"][i:j], block, size, grown)
            if found.any():
                yield batch.select(["frame_id", "a", "b"]).filter(pa.array(found))

    return both.mapInArrow(run, f"frame_id {frame}, a long, b long").select("frame_id", F.col("a").alias("src_leaf_id"), F.col("b").alias("dst_leaf_id"))


# --- edges and their cost -------------------------------------------------------------------------------------------


def graph_edges(leaves: DataFrame, faces: DataFrame, cfg: PlannerConfig) -> DataFrame:
    """All edges that may be walked: face links in order of direction, then virtual stair edges by leaf; each pair once.

    leaves: with leaf_id; faces: links between leaves with src_depth, src_path, dst_depth, dst_path and dir.
    """
    ids = leaves.select("frame_id", "depth", "path", "leaf_id")
    links = faces.select("frame_id", "src_depth", "src_path", "dst_depth", "dst_path", "dir")
    for e in ("src", "dst"):
        links = links.join(ids.select("frame_id", F.col("depth").alias(f"{e}_depth"), F.col("path").alias(f"{e}_path"), F.col("leaf_id").alias(f"{e}_leaf_id")).hint("merge"), ["frame_id", f"{e}_depth", f"{e}_path"])
    pairs = links.groupBy("frame_id", "src_leaf_id", "dst_leaf_id").agg(F.min("dir").cast("long").alias("ord"))
    components = stair_components(leaves, cfg)
    by_leaf = written(staircases(components, component_stats(leaves, components, cfg)), "staircases")
    edges = pairs
    for e in ("src", "dst"):
        edges = edges.join(_side(leaves, f"{e}_").hint("merge"), ["frame_id", f"{e}_leaf_id"])
    edges = with_staircase(edges, by_leaf).where(allowed_transition(cfg)).drop(*[f"st_{c}" for c in STAIRCASE])
    if cfg.enable_stair_edges and cfg.stair_connection_radius > 0:
        # virtual edges are judged where they are found, because few of them may be walked; a face link comes before one
        more = walkable_stair_edges(leaves, by_leaf, cfg).withColumn("ord", F.col("dst_leaf_id") + 6)
        edges = edges.unionByName(more.join(pairs.hint("merge"), ["frame_id", "src_leaf_id", "dst_leaf_id"], "left_anti"))
    return edges.withColumn("distance", _gap("src_", "dst_"))


def edge_costs(edges: DataFrame, leaves: DataFrame, octree: OctreeConfig, cfg: PlannerConfig) -> DataFrame:
    """Edges of finite cost. Lines are tested against obstacles only where the ends are farther apart than neighbours are."""
    open_edges = traversal_info(edges, octree, cfg.allow_cross_floor).where(traversable(cfg, "dst_"))
    rise = F.abs(F.col("src_cz") - F.col("dst_cz"))
    open_edges = open_edges.where(stair_like("src_") | stair_like("dst_") | (rise <= max(0.0, cfg.max_non_stair_vertical_step)))
    long_edge = F.col("distance") > F.greatest(max_extent("src_"), max_extent("dst_")) * 1.75
    cut = blocked_segments(open_edges.where(long_edge), leaves, cfg)
    kept = open_edges.join(cut.hint("merge"), ["frame_id", "src_leaf_id", "dst_leaf_id"], "left_anti")
    tight = clearance(leaves, cfg).select("frame_id", F.col("leaf_id").alias("dst_leaf_id"), F.lit(True).alias("tight"))
    kept = kept.join(tight.hint("merge"), ["frame_id", "dst_leaf_id"], "left")
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), d("dst_probability")))
    metre = p * p * cfg.probability_weight + F.when(F.col("tight"), 4.0 + cfg.probability_weight).otherwise(0.0)
    metre = metre + F.when(F.col("dst_label") == STAIR, cfg.stair_weight).otherwise(0.0) + F.when(F.col("dst_is_cross_floor"), cfg.cross_floor_weight).otherwise(0.0)
    return kept.withColumn("cost", F.col("cost") + F.col("distance") * metre + rise * cfg.vertical_weight).drop("tight")


def heuristic(cfg: PlannerConfig, a: str = "src_", goal: str = "dst_") -> Column:
    """The estimate from a leaf to the goal; it is weighted and may exceed the true cost."""
    rise = F.abs(F.col(f"{a}cz") - F.col(f"{goal}cz"))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), d(f"{a}probability")))
    label = F.when(F.col(f"{a}label") == STAIR, cfg.stair_weight).when(F.col(f"{a}label") == OBSTACLE, 1000.0).otherwise(0.0)
    floors = F.when((rise > F.greatest(extent("z", a), extent("z", goal))) & ~stair_like(a), cfg.cross_floor_weight).otherwise(0.0)
    return (_gap(a, goal) * (p * cfg.probability_weight + 1.0) + rise * cfg.vertical_weight + label + floors) * cfg.heuristic_weight


# --- search ---------------------------------------------------------------------------------------------------------

PATH_SCHEMA = (
    "frame_id int, query_id long, success boolean, message string, start_leaf long, goal_leaf long, total_cost double, expanded long, "
    "leaf_ids array<long>, waypoints array<struct<leaf_id:long,x:double,y:double,z:double,label:int,probability:double,is_cross_floor:boolean,room_id:int>>"
)


def _keeps(prev: dict, now: dict, after: dict) -> bool:
    """Whether a waypoint between two others has to stay."""
    three = (prev, now, after)
    if any(x["label"] == STAIR or x["is_cross_floor"] for x in three) or len({(x["label"], x["room_id"]) for x in three}) > 1:
        return True
    a, b = (np.array([y[k] - x[k] for k in AXES]) for x, y in ((prev, now), (now, after)))
    if abs(a[2]) > 0.15 or abs(b[2]) > 0.15:
        return True
    na, nb = np.linalg.norm(a), np.linalg.norm(b)
    return bool(na < 1e-5 or nb < 1e-5 or a @ b / (na * nb) <= 0.995)


def smooth(waypoints: list[dict]) -> list[dict]:
    """Waypoints without those on a straight, level, even stretch; each is held against the last one kept."""
    if len(waypoints) <= 2:
        return waypoints
    out = waypoints[:1]
    for now, after in zip(waypoints[1:-1], waypoints[2:], strict=True):
        if _keeps(out[-1], now, after):
            out.append(now)
    return [*out, waypoints[-1]]


#: What a search says.
NO_START, NO_GOAL = "Start point cannot be resolved to a traversable leaf", "Goal point cannot be resolved to a traversable leaf"
OUT_OF_RANGE = "Start or goal node index is out of range"
START_BLOCKED, GOAL_BLOCKED = "Start node is not traversable", "Goal node is not traversable"
FOUND, NO_PATH, NOT_REBUILT, CAPPED = "Path found", "No path found", "Failed to reconstruct path", "A* stopped because max_expansions was reached"


def snap_note(start: float | None, goal: float | None) -> str:
    """What follows the message of a path whose ends were snapped by so much (None: not at all)."""
    parts = [f"{name} snapped {gap:.6f}m" for name, gap in (("start", start), ("goal", goal)) if gap is not None]
    return f" ({', '.join(parts)})" if parts else ""


def smoothed(paths: DataFrame) -> DataFrame:
    """paths (with waypoints array<struct<..>>) with smooth() waypoints; a path is one row."""
    kind = paths.schema["waypoints"].dataType

    @F.pandas_udf(kind)
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda w: smooth([dict(x) for x in w]))

    return paths.withColumn("waypoints", run("waypoints"))


def _way(start: int, goal: int, came: dict[int, int]) -> list[int]:
    """The leaves from start to goal; empty if a step is not known."""
    path = [goal]
    while path[-1] != start:
        if path[-1] not in came:
            return []
        path.append(came[path[-1]])
    return path[::-1]


def _search(start: int, goal: int | None, out: dict[int, list[tuple[int, float]]], estimate, most: int, seen: dict | None = None) -> tuple[str, float, int, list[int]]:
    """Best-first by cost so far + estimate, then by the larger cost so far, then by age; closed leaves stay closed.

    seen gets what the search has closed (a number in order, from 1), and costs and steps to it; without a goal that is
    all that can be reached, or as much as may be expanded.
    """
    if start == goal:
        return FOUND, 0.0, 0, [start]
    best, came, closed = {start: 0.0}, {}, {}
    if seen is not None:
        seen |= {"best": best, "came": came, "closed": closed}
    queue, pushed, expanded = [(estimate(start), -0.0, 0, start)], 1, 0
    while queue:
        _, _, _, leaf = heapq.heappop(queue)
        if leaf in closed:
            continue
        expanded += 1
        closed[leaf] = expanded
        if leaf == goal:
            path = _way(start, goal, came)
            return (FOUND, best[goal], expanded, path) if path else (NOT_REBUILT, math.inf, expanded, [])
        if expanded >= most:
            return CAPPED, math.inf, expanded, []
        for to, cost in out.get(leaf, ()):
            g = best[leaf] + cost
            if to not in closed and g < best.get(to, math.inf):
                best[to], came[to] = g, leaf
                heapq.heappush(queue, (g + estimate(to), -g, pushed, to))
                pushed += 1
    return NO_PATH, math.inf, expanded, []


class _Searches:
    """Searches over one graph. What a search has told about its start is not searched again."""

    def __init__(self, out: dict[int, list[tuple[int, float]]], cfg: PlannerConfig):
        self.out, self.cfg, self.known, self.spread = out, cfg, {}, {}

    def path(self, start: int, goal: int, estimate) -> tuple[str, float, int, list[int]]:
        if (start, goal) not in self.known:
            self.known[start, goal] = self._path(start, goal, estimate)
        return self.known[start, goal]

    def _path(self, start: int, goal: int, estimate) -> tuple[str, float, int, list[int]]:
        most = self.cfg.max_expansions
        if start == goal:
            return _search(start, goal, self.out, estimate, most)
        if self.cfg.heuristic_weight == 0 and start not in self.spread:  # the goal does not lead the search: one serves all goals
            seen: dict = {}
            self.spread[start] = (seen, _search(start, None, self.out, lambda _: 0.0, most, seen))
        if self.cfg.heuristic_weight == 0:
            seen, (message, cost, expanded, _) = self.spread[start]
            if goal not in seen["closed"]:
                return message, cost, expanded, []
            path = _way(start, goal, seen["came"])
            return (FOUND, seen["best"][goal], seen["closed"][goal], path) if path else (NOT_REBUILT, math.inf, seen["closed"][goal], [])
        if start in self.spread and goal not in self.spread[start][0]:
            return self.spread[start][1]
        seen = {}
        found = _search(start, goal, self.out, estimate, most, seen)
        if found[0] == NO_PATH:  # all that the start reaches is closed, whatever the goal
            self.spread[start] = (seen["closed"], found)
        return found


#: Different searches of a frame that one task makes; each further lot of them gets a copy of the frame's graph.
QUERIES_AT_ONCE = 256


def find_paths(leaves: DataFrame, costs: DataFrame, queries: DataFrame, cfg: PlannerConfig) -> DataFrame:
    """A path for each query (frame_id, query_id, start_leaf, goal_leaf; null where no leaf was found).

    Queries may have start_snap and goal_snap, how far an end was moved to its leaf (null: not at all). A frame's queries
    are dealt to lots, and each lot is a task with the frame's graph. Queries with the same ends share a search, and
    without an estimate those with the same start.
    """
    for c in ("start_snap", "goal_snap"):
        queries = queries if c in queries.columns else queries.withColumn(c, F.lit(None).cast("double"))
    ends = ["start_leaf"] if cfg.heuristic_weight == 0 else ["start_leaf", "goal_leaf"]
    lots = queries.groupBy(F.col("frame_id").alias("frame_id")).agg(F.least(F.count_distinct(F.struct(*ends)), F.ceil(F.count_distinct(F.struct("start_leaf", "goal_leaf")) / QUERIES_AT_ONCE)).alias("_lots"))  # a row for each frame
    lots = lots.select(*[F.col(c).alias(c) for c in lots.columns])
    queries = queries.join(lots, "frame_id").withColumn("lot", F.pmod(F.xxhash64(*ends), F.col("_lots"))).drop("_lots")
    facts = leaves.select("frame_id", F.lit(0).alias("kind"), F.col("leaf_id").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("cost"), F.lit(0).cast("long").alias("ord"), "label", d("probability").alias("probability"), "is_cross_floor", "room_id", "cx", "cy", "cz", extent("z").alias("height"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("label", "int"), ("probability", "double"), ("is_cross_floor", "boolean"), ("room_id", "int"), ("cx", "double"), ("cy", "double"), ("cz", "double"), ("height", "double"))]
    links = costs.select("frame_id", F.lit(1).alias("kind"), F.col("src_leaf_id").alias("a"), F.col("dst_leaf_id").alias("b"), "cost", F.col("ord").cast("long").alias("ord"), *none)
    graph = facts.unionByName(links).join(lots, "frame_id").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_lots") - 1))).drop("_lots")

    def run(graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        nodes = {int(r.a): r for r in graph[graph.kind == 0].itertuples()}
        out: dict[int, list[tuple[int, float]]] = {}
        ways = graph[graph.kind == 1].sort_values(["a", "ord"])
        for a, b, cost in zip(ways.a.tolist(), ways.b.astype("int64").tolist(), ways.cost.tolist(), strict=True):
            out.setdefault(a, []).append((b, cost))
        rows, searches, drawn = [], _Searches(out, cfg), {}
        for q in asked.sort_values("query_id").itertuples():
            row = {"frame_id": q.frame_id, "query_id": q.query_id, "success": False, "total_cost": None, "expanded": 0, "leaf_ids": [], "waypoints": []}
            ends = [None if pd.isna(x) else int(x) for x in (q.start_leaf, q.goal_leaf)]
            row |= {"start_leaf": ends[0], "goal_leaf": ends[1]}
            if None in ends:
                rows.append(row | {"message": NO_START if ends[0] is None else NO_GOAL})
                continue
            if any(e not in nodes for e in ends):
                rows.append(row | {"message": OUT_OF_RANGE})
                continue
            barred = [nodes[e].label == OBSTACLE or nodes[e].probability >= cfg.obstacle_block_probability for e in ends]
            if any(barred):
                rows.append(row | {"message": START_BLOCKED if barred[0] else GOAL_BLOCKED})
                continue
            goal = nodes[ends[1]]

            def estimate(i: int, goal=goal) -> float:
                n = nodes[i]
                rise = abs(n.cz - goal.cz)
                p = min(1.0, max(0.0, n.probability))
                stair = n.label == STAIR or n.is_cross_floor
                extra = cfg.stair_weight if n.label == STAIR else 1000.0 if n.label == OBSTACLE else 0.0
                if rise > max(n.height, goal.height) and not stair:
                    extra += cfg.cross_floor_weight
                return cfg.heuristic_weight * (math.dist((n.cx, n.cy, n.cz), (goal.cx, goal.cy, goal.cz)) * (1 + cfg.probability_weight * p) + cfg.vertical_weight * rise + extra)

            message, cost, expanded, path = searches.path(ends[0], ends[1], estimate)
            if path:
                message += snap_note(*[None if pd.isna(x) else float(x) for x in (q.start_snap, q.goal_snap)])
            if tuple(ends) not in drawn:
                points = [{"leaf_id": i, "x": nodes[i].cx, "y": nodes[i].cy, "z": nodes[i].cz, "label": int(nodes[i].label), "probability": nodes[i].probability, "is_cross_floor": bool(nodes[i].is_cross_floor), "room_id": int(nodes[i].room_id)} for i in path]
                drawn[tuple(ends)] = smooth(points) if cfg.smooth_waypoints else points
            rows.append(row | {"success": bool(path), "message": message, "total_cost": cost if path else None, "expanded": expanded, "leaf_ids": path, "waypoints": drawn[tuple(ends)]})
        return pd.DataFrame(rows, columns=["frame_id", "query_id", "success", "message", "start_leaf", "goal_leaf", "total_cost", "expanded", "leaf_ids", "waypoints"])

    # columns of their own, in case queries and leaves come from one table
    asked = queries.select(*[F.col(c).alias(c) for c in ("frame_id", "lot", "query_id", "start_leaf", "goal_leaf", "start_snap", "goal_snap")])
    return graph.groupBy("frame_id", "lot").cogroup(asked.groupBy("frame_id", "lot")).applyInPandas(run, PATH_SCHEMA)


def segments(points: DataFrame, keys: list[str], order: str = "ord", shortest: float = 1e-4) -> DataFrame:
    """Cylinders between consecutive waypoints (keys, order, x, y, z): middle, length and direction; very short ones go."""
    w = Window.partitionBy(*keys).orderBy(order)
    ends = points.select(*keys, order, *[d(a).alias(a) for a in AXES], *[F.lead(d(a)).over(w).alias(f"to_{a}") for a in AXES]).where("to_x is not null")
    x, y, z = (F.col(f"to_{a}") - F.col(a) for a in AXES)
    ends = ends.withColumn("length", F.sqrt(x * x + y * y + z * z)).where(F.col("length") >= shortest)
    return ends.select(*keys, order, *[((F.col(a) + F.col(f"to_{a}")) * 0.5).alias(f"mid_{a}") for a in AXES], "length", *[((F.col(f"to_{a}") - F.col(a)) / F.col("length")).alias(f"dir_{a}") for a in AXES])
