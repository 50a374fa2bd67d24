"""Queries over the planner's graph of the small cloud, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import OctreeConfig, PlannerConfig
from ..functions.components import written
from ..functions.geometry import AXES, d
from ..operators import graph, neighbors, octree, view
from ..sources import adapters
from ..streaming import state
from .clouds import EMBEDDINGS, held_order_sql, octree_sql, r4

CFG = OctreeConfig()
PLAN = PlannerConfig()
IDS = ["src_leaf_id", "dst_leaf_id"]


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _tree_of(adapters.embedding_cloud(spark, sf_dir))


def _tree_of(cloud: DataFrame) -> tuple[DataFrame, DataFrame]:
    roots = written(octree.root_bounds(cloud), "roots")  # a row for each frame, which every later stage reads
    return graph.with_leaf_id(octree.leaves(cloud, CFG, roots), CFG), roots


def _side(prefix: str, source: str = "leaf") -> str:
    cols = ["leaf_id", "label", "probability", "is_cross_floor", "room_id", "entity_id", "depth", "cx", "cy", "cz", *[f"{s}_{a}" for s in ("min", "max") for a in AXES]]
    return ", ".join(f"{source}.{c} AS {prefix}{c}" for c in cols)


def _gap(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"({a}c{k} - {b}c{k}) * ({a}c{k} - {b}c{k})" for k in AXES) + ")"


def _ext(axis: str, p: str = "") -> str:
    return f"(CAST({p}max_{axis} AS DOUBLE) - CAST({p}min_{axis} AS DOUBLE))"


def _stair(p: str = "") -> str:
    return f"({p}label = 2 OR {p}is_cross_floor)"


def _open(p: str = "", most: float = PLAN.obstacle_block_probability) -> str:
    return f"({p}label <> 1 AND CAST({p}probability AS DOUBLE) < {most})"


LEAVES = octree_sql(EMBEDDINGS, CFG)
PAIRS = f", pair AS (SELECT {_side('s_', 'a')}, {_side('t_', 'b')}, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) + (a.cz - b.cz) * (a.cz - b.cz)) AS gap FROM leaf a, leaf b WHERE a.leaf_id <> b.leaf_id)"


def _faces_sql() -> str:
    """face: the link of each leaf and direction, by probing just outside the faces."""
    rows = []
    for direction in range(6):
        axis, up = AXES[direction // 2], direction % 2 == 0
        others = [a for a in AXES if a != axis]
        at = f"CAST(max_{axis} AS DOUBLE) + {neighbors.REACH}" if up else f"CAST(min_{axis} AS DOUBLE) - {neighbors.REACH}"
        for k in range(5):
            p = {axis: at} | {a: f"c{a}" for a in others}
            if k:
                a = others[(k - 1) // 2]
                q = f"(CAST(max_{a} AS DOUBLE) - CAST(min_{a} AS DOUBLE)) * 0.25"
                p[a] = f"CAST(min_{a} AS DOUBLE) + {q}" if k % 2 else f"CAST(max_{a} AS DOUBLE) - {q}"
            rows.append(f"SELECT leaf_id, {direction} AS dir, {k} AS probe, {', '.join(f'CAST({p[a]} AS FLOAT) AS p{a}' for a in AXES)} FROM leaf")
    touch = []
    for direction in range(6):
        axis = AXES[direction // 2]
        near, far = ("s_max", "t_min") if direction % 2 == 0 else ("s_min", "t_max")
        rest = " AND ".join(f"greatest(CAST(s_min_{a} AS DOUBLE), CAST(t_min_{a} AS DOUBLE)) <= least(CAST(s_max_{a} AS DOUBLE), CAST(t_max_{a} AS DOUBLE)) + 0.0002" for a in AXES if a != axis)
        touch.append(f"(dir = {direction} AND abs(CAST({near}_{axis} AS DOUBLE) - CAST({far}_{axis} AS DOUBLE)) <= 0.0002 AND {rest})")
    return f""", probe AS MATERIALIZED ({' UNION ALL '.join(rows)}),
held AS MATERIALIZED (SELECT p.leaf_id, p.dir, p.probe, l.leaf_id AS other, row_number() OVER (PARTITION BY p.leaf_id, p.dir, p.probe ORDER BY {held_order_sql('px', 'py', 'pz')}) AS k FROM probe p JOIN leaf l ON px BETWEEN l.min_x AND l.max_x AND py BETWEEN l.min_y AND l.max_y AND pz BETWEEN l.min_z AND l.max_z),
met AS (SELECT dir, probe, {_side('s_', 'a')}, {_side('t_', 'b')} FROM held h JOIN leaf a ON h.leaf_id = a.leaf_id JOIN leaf b ON h.other = b.leaf_id WHERE k = 1 AND h.leaf_id <> h.other),
ok AS (SELECT *, {_gap('s_', 't_')} AS distance FROM met WHERE {_open('t_', CFG.blocked_probability)} AND (s_room_id = t_room_id OR (dir >= 4 AND {_stair('s_')} AND {_stair('t_')})) AND ({' OR '.join(touch)})),
face AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s_leaf_id, dir ORDER BY distance + t_depth * 0.02::DOUBLE, probe) AS rk FROM ok) WHERE rk = 1)"""


FACES = _faces_sql()


def face_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, roots = _tree(spark, sf_dir)
    out = neighbors.face_links(written(tree, "tree"), roots, CFG)
    return out.select("src_depth", "src_path", "dir", "dst_depth", "dst_path", r4("distance", "distance"))


FACE_NEIGHBORS = LEAVES + FACES + " SELECT a.depth AS src_depth, a.path AS src_path, f.dir, b.depth AS dst_depth, b.path AS dst_path, round(f.distance, 4) AS distance FROM face f JOIN leaf a ON f.s_leaf_id = a.leaf_id JOIN leaf b ON f.t_leaf_id = b.leaf_id"
_COST = "CASE WHEN {p}label = 1 OR CAST({p}probability AS DOUBLE) >= 0.95 THEN 1000000.0::DOUBLE ELSE 1.0 + {p}depth * 0.08::DOUBLE + CAST({p}probability AS DOUBLE) * 9.0 + CASE WHEN {p}label = 2 THEN 1.75 ELSE 0.0 END END"


def traversal_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, _ = _tree(spark, sf_dir)
    return tree.select("leaf_id", r4(neighbors.traversal_cost(CFG), "cost"))


TRAVERSAL_COST = LEAVES + f"SELECT leaf_id, round({_COST.format(p='')}, 4) AS cost FROM leaf"


def traversal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, roots = _tree(spark, sf_dir)
    out = neighbors.traversal_info(neighbors.face_neighbors(written(tree, "tree"), roots, CFG), CFG)
    return out.select("src_depth", "src_path", "dir", r4("distance", "distance"), r4("cost", "cost"))


TRAVERSAL_EDGES = LEAVES + FACES + f" SELECT a.depth AS src_depth, a.path AS src_path, dir, round(distance, 4) AS distance, round(distance * ({_COST.format(p='t_')}), 4) AS cost FROM face JOIN leaf a ON s_leaf_id = a.leaf_id WHERE {_open('t_', 0.95)} AND (s_room_id = t_room_id OR ({_stair('s_')} AND {_stair('t_')}))"


def flood_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, roots = _tree(spark, sf_dir)
    tree = written(tree, "tree")
    links = written(neighbors.face_links(tree, roots, CFG), "links")
    seeds = tree.where((F.col("label") != 0) & (F.col("leaf_id") % 5 == 0))
    out = neighbors.flood_fill(tree, links, seeds, CFG)
    return out.select("leaf_id", "label", r4("probability", "probability"), "is_cross_floor")


FLOOD_FILL = LEAVES + FACES + """, seed AS (SELECT leaf_id AS seed, label AS sl, CAST(probability AS DOUBLE) AS sp, room_id AS sr, is_cross_floor AS sc FROM leaf WHERE label <> 0 AND leaf_id % 5 = 0),
one AS (SELECT DISTINCT seed, sl, sp, sr, sc, t_leaf_id AS place FROM seed JOIN face ON seed = s_leaf_id WHERE (t_room_id = sr OR (sc AND t_is_cross_floor)) AND t_leaf_id <> seed),
two AS (SELECT DISTINCT o.seed, sl, sp, t_leaf_id AS place FROM one o JOIN face ON o.place = s_leaf_id WHERE (t_room_id = sr OR (sc AND t_is_cross_floor)) AND t_leaf_id <> o.seed AND NOT EXISTS (SELECT 1 FROM one x WHERE x.seed = o.seed AND x.place = t_leaf_id)),
hit AS (SELECT place, max(CASE WHEN sl = 1 THEN sp * f END) AS lifted, bool_or(sl = 2) AS st FROM (SELECT seed, sl, sp, place, CAST(0.7 AS DOUBLE) AS f FROM one UNION ALL SELECT seed, sl, sp, place, CAST(1.0 AS DOUBLE) - 2 * CAST(0.3 AS DOUBLE) FROM two) GROUP BY place),
v AS (SELECT leaf_id, label, is_cross_floor, lifted, coalesce(st, false) AS st, greatest(CAST(probability AS DOUBLE), coalesce(lifted, 0.0)) AS p FROM leaf LEFT JOIN hit ON leaf_id = place),
w AS (SELECT *, lifted IS NOT NULL AND p >= 0.7 AS blk, st AND label = 0 AND NOT (lifted IS NOT NULL AND p >= 0.7) AS mk FROM v)
SELECT leaf_id, CASE WHEN blk THEN 1 WHEN mk THEN 2 ELSE label END AS label, round(CAST(CAST(CASE WHEN mk THEN least(p, 0.35) ELSE p END AS FLOAT) AS DOUBLE), 4) AS probability, is_cross_floor OR mk AS is_cross_floor FROM w"""


def obstacle_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, _ = _tree(spark, sf_dir)
    return graph.obstacle_cells(tree, PLAN).select("cell_x", "cell_y", "obstacles", r4("max_radius", "max_radius"))


_OBST = f", obst AS MATERIALIZED (SELECT leaf_id AS o_id, cx AS ox, cy AS oy, cz AS oz, {_ext('z')} AS oh, greatest({_ext('x')}, {_ext('y')}) * 0.5 AS opr, sqrt({_ext('x')} * {_ext('x')} + {_ext('y')} * {_ext('y')} + {_ext('z')} * {_ext('z')}) * 0.5 AS orad, CAST(floor(cx / {PLAN.obstacle_cell}) AS BIGINT) AS gx, CAST(floor(cy / {PLAN.obstacle_cell}) AS BIGINT) AS gy FROM leaf WHERE NOT {_open()})"
OBSTACLE_CELLS = LEAVES + _OBST + " SELECT gx AS cell_x, gy AS cell_y, count(*) AS obstacles, round(max(opr), 4) AS max_radius FROM obst GROUP BY 1, 2"


def clearance_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, _ = _tree(spark, sf_dir)
    return graph.clearance(tree, PLAN).select("leaf_id")


_TIGHT = f", tight AS MATERIALIZED (SELECT DISTINCT leaf_id FROM leaf, obst WHERE label <> 1 AND NOT {_stair()} AND abs(cz - oz) <= greatest(1.5, ({_ext('z')} + oh) * 0.5) AND sqrt((cx - ox) * (cx - ox) + (cy - oy) * (cy - oy)) <= greatest({_ext('x')}, {_ext('y')}) * 0.5 + opr + 0.15::DOUBLE)"
CLEARANCE_SEMIJOIN = LEAVES + _OBST + _TIGHT + " SELECT leaf_id FROM tight"


def segment_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = written(_tree(spark, sf_dir)[0], "tree")
    return graph.blocked_segments(graph.stair_edges(tree, PLAN), tree, PLAN, PLAN.stair_connection_radius).select(*IDS)


_NEAR = PAIRS + f", near AS MATERIALIZED (SELECT * FROM pair WHERE gap <= 1.25 AND {_open('s_')} AND {_open('t_')} AND ({_stair('s_')} OR {_stair('t_')}))"
_CUT = """, wide AS (SELECT max(opr) AS w FROM obst),
line AS (SELECT s_leaf_id, t_leaf_id, ax, ay, az, ox - s_cx AS px, oy - s_cy AS py, oz - s_cz AS pz, orad, ax * ax + ay * ay + az * az AS q FROM (SELECT *, t_cx - s_cx AS ax, t_cy - s_cy AS ay, t_cz - s_cz AS az FROM {edges}) e, obst, wide
  WHERE o_id <> s_leaf_id AND o_id <> t_leaf_id AND gx BETWEEN floor((least(s_cx, t_cx) - w) / {c}) AND floor((greatest(s_cx, t_cx) + w) / {c}) AND gy BETWEEN floor((least(s_cy, t_cy) - w) / {c}) AND floor((greatest(s_cy, t_cy) + w) / {c})),
cut AS MATERIALIZED (SELECT DISTINCT s_leaf_id, t_leaf_id FROM (SELECT *, CASE WHEN q < 1e-8 THEN 0.0 ELSE greatest(0.0, least(1.0, (px * ax + py * ay + pz * az) / q)) END AS t FROM line) WHERE sqrt((px - t * ax) * (px - t * ax) + (py - t * ay) * (py - t * ay) + (pz - t * az) * (pz - t * az)) <= orad + 0.03::DOUBLE)"""
SEGMENT_BLOCK = LEAVES + _OBST + _NEAR + _CUT.format(edges="near", c=PLAN.obstacle_cell) + " SELECT s_leaf_id AS src_leaf_id, t_leaf_id AS dst_leaf_id FROM cut"


def stair_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, _ = _tree(spark, sf_dir)
    return graph.stair_edges(tree, PLAN).select(*IDS)


STAIR_EDGES = LEAVES + _NEAR + " SELECT s_leaf_id AS src_leaf_id, t_leaf_id AS dst_leaf_id FROM near"
_CONNECT = f"(s_entity_id = 0 OR t_entity_id = 0 OR s_entity_id = t_entity_id) AND gap <= 1.25 AND abs(s_cz - t_cz) <= greatest(0.8, greatest({_ext('z', 's_')}, {_ext('z', 't_')}) * 1.5)"
_COMP = f""", link AS MATERIALIZED (SELECT s_leaf_id AS a, t_leaf_id AS b FROM near WHERE {_stair('s_')} AND {_stair('t_')} AND {_CONNECT}),
reach(leaf_id, place) AS (SELECT leaf_id, leaf_id FROM leaf WHERE {_stair()} AND {_open()} UNION SELECT r.leaf_id, l.b FROM reach r JOIN link l ON r.place = l.a),
comp AS MATERIALIZED (SELECT leaf_id, min(place) AS component FROM reach GROUP BY 1)"""


def stair_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, _ = _tree(spark, sf_dir)
    return graph.stair_components(tree, PLAN).select("leaf_id", "component")


STAIR_COMPONENTS = LEAVES + _NEAR + _COMP + " SELECT leaf_id, component FROM comp"
_STATS = f""", ends AS (SELECT component, count(*) AS count, min(cz) AS ez0, max(cz) AS ez1 FROM comp JOIN leaf USING (leaf_id) GROUP BY 1),
ownl AS (SELECT component, cx, cy, cz, greatest({_ext('x')}, {_ext('y')}) * 0.5 AS half, cz <= ez0 + {PLAN.end_band}::DOUBLE AS lo, cz >= ez1 - {PLAN.end_band}::DOUBLE AS hi FROM comp JOIN leaf USING (leaf_id) JOIN ends USING (component)),
midl AS (SELECT *, CASE WHEN run >= 1e-5 THEN (hx - lx) / run ELSE 0.0 END AS ux, CASE WHEN run >= 1e-5 THEN (hy - ly) / run ELSE 0.0 END AS uy, run >= 1e-5 AS dir FROM (SELECT *, sqrt((hx - lx) * (hx - lx) + (hy - ly) * (hy - ly)) AS run FROM (SELECT component, avg(cx) FILTER (lo) AS lx, avg(cy) FILTER (lo) AS ly, avg(cx) FILTER (hi) AS hx, avg(cy) FILTER (hi) AS hy FROM ownl GROUP BY 1))),
stat AS MATERIALIZED (SELECT component, e.count, ez0 AS min_z, ez1 AS max_z, lx, ly, hx, hy, ux, uy, dir, lw, hw FROM ends e JOIN midl USING (component) JOIN (SELECT o.component, coalesce(max(CASE WHEN lo AND dir THEN abs((cy - ly) * ux - (cx - lx) * uy) + half END), 0.0) AS lw, coalesce(max(CASE WHEN hi AND dir THEN abs((cy - hy) * ux - (cx - hx) * uy) + half END), 0.0) AS hw FROM ownl o JOIN midl USING (component) GROUP BY 1) USING (component))"""


def stair_component_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, _ = _tree(spark, sf_dir)
    out = graph.component_stats(tree, graph.stair_components(tree, PLAN), PLAN)
    return out.select("component", "count", *[r4(c, c, 3) for c in ("min_z", "max_z", "low_x", "high_x", "up_x", "up_y", "low_half_width", "high_half_width")], "has_direction")


STAIR_COMPONENT_STATS = LEAVES + _NEAR + _COMP + _STATS + " SELECT component, count, round(min_z, 3) AS min_z, round(max_z, 3) AS max_z, round(lx, 3) AS low_x, round(hx, 3) AS high_x, round(ux, 3) AS up_x, round(uy, 3) AS up_y, round(lw, 3) AS low_half_width, round(hw, 3) AS high_half_width, dir AS has_direction FROM stat"


def floor_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, _ = _tree(spark, sf_dir)
    return tree.select("leaf_id", r4(graph.floor_gap(F.col("cz"), PLAN), "gap"), graph.near_floor(F.col("cz"), PLAN).alias("near_floor"))


def _floor(z: str) -> str:
    return f"abs({z} - (round(({z} - 1.0) / 4.0) * 4.0 + 1.0))"


FLOOR_GATE = LEAVES + f"SELECT leaf_id, round({_floor('cz')}, 4) AS gap, {_floor('cz')} <= 0.45 AS near_floor FROM leaf"


def _allowed_sql() -> str:
    def mixed(s: str, f: str) -> str:
        reach = f"greatest(0.6, {_ext('z', s)} * 1.5)"
        wide = f"greatest(1.2, {_ext('z', f)} * 1.5)"
        run = f"sqrt(({f}cx - {s}cx) * ({f}cx - {s}cx) + ({f}cy - {s}cy) * ({f}cy - {s}cy))"
        up = f"((({f}cx - {s}cx) * ux + ({f}cy - {s}cy) * uy) / nullif({run}, 0))"
        low = f"({s}cz <= min_z + {reach} AND {f}cz <= min_z + {wide})"
        high = f"({s}cz >= max_z - {reach} AND {f}cz >= max_z - {wide})"

        def beside(e: str, sign: int) -> str:
            rx, ry = f"({f}cx - {e}x)", f"({f}cy - {e}y)"
            return f"(abs({ry} * ux - {rx} * uy) <= greatest({e}w, 0.25) + 0.25 AND ({rx} * ux + {ry} * uy) * {sign} >= -0.55)"

        way = f"(NOT dir OR {run} < 1e-5 OR CASE WHEN {low} THEN {beside('l', -1)} AND -{up} >= 0.5 WHEN {high} THEN {beside('h', 1)} AND {up} >= 0.5 ELSE false END)"
        end = f"({s}cz <= min_z + {reach} OR {s}cz >= max_z - {reach}) AND ({f}cz <= min_z + 1.2::DOUBLE OR {f}cz >= max_z - 1.2::DOUBLE)"
        return f"(min_z IS NOT NULL AND {end} AND {_floor(f + 'cz')} <= 0.45 AND {_floor(s + 'cz')} <= 0.45 AND {way} AND abs(s_cz - t_cz) <= greatest(1.2, greatest({_ext('z', 's_')}, {_ext('z', 't_')}) * 1.5))"

    return f"CASE WHEN NOT {_stair('s_')} AND NOT {_stair('t_')} THEN true WHEN {_stair('s_')} AND {_stair('t_')} THEN {_CONNECT} WHEN {_stair('s_')} THEN {mixed('s_', 't_')} ELSE {mixed('t_', 's_')} END"


_GRAPH = f""", cands AS (SELECT s_leaf_id, t_leaf_id, min(o) AS ord FROM (SELECT s_leaf_id, t_leaf_id, dir AS o FROM face UNION ALL SELECT s_leaf_id, t_leaf_id, t_leaf_id + 6 FROM near) GROUP BY 1, 2),
edge AS MATERIALIZED (SELECT * FROM (SELECT p.*, c.ord, st.* FROM cands c JOIN pair p ON c.s_leaf_id = p.s_leaf_id AND c.t_leaf_id = p.t_leaf_id
  LEFT JOIN comp k ON k.leaf_id = CASE WHEN {_stair('p.s_')} AND NOT {_stair('p.t_')} THEN p.s_leaf_id WHEN {_stair('p.t_')} AND NOT {_stair('p.s_')} THEN p.t_leaf_id END LEFT JOIN stat st ON k.component = st.component) WHERE {_allowed_sql()})"""


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, roots = _tree(spark, sf_dir)
    tree = written(tree, "tree")
    return graph.graph_edges(tree, neighbors.face_links(tree, roots, CFG), PLAN).select(*IDS, "ord", r4("distance", "distance"))


GRAPH_EDGES = LEAVES + FACES + _NEAR + _COMP + _STATS + _GRAPH + " SELECT s_leaf_id AS src_leaf_id, t_leaf_id AS dst_leaf_id, ord, round(gap, 4) AS distance FROM edge"


def _costs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return _costs_of(adapters.embedding_cloud(spark, sf_dir))


def _costs_of(cloud: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leaves, roots and costed edges; what several later stages read is written once."""
    tree, roots = _tree_of(cloud)
    tree = written(tree, "tree")
    faces = written(neighbors.face_links(tree, roots, CFG), "faces")
    edges = written(graph.graph_edges(tree, faces, PLAN), "edges")
    return tree, roots, graph.edge_costs(edges, tree, CFG, PLAN)


def edge_cost_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs over the dense cloud of all years, a graph for each; its pairs are too many for SQL without the grid of cells."""
    tree, _, costs = _costs_of(adapters.lineitem_cloud(spark, sf_dir))
    return costs.groupBy("frame_id").agg(F.count(F.lit(1)).alias("edges"), r4(F.sum("cost"), "cost", 0))


def edge_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _costs(spark, sf_dir)[2].select(*IDS, r4("cost", "cost", 3))


_BIG = {p: f"greatest({_ext('x', p)}, {_ext('y', p)}, {_ext('z', p)})" for p in ("s_", "t_")}
_FREE = f""", free AS MATERIALIZED (SELECT * FROM edge WHERE {_open('t_')} AND {_open('t_', 0.95)} AND (s_room_id = t_room_id OR ({_stair('s_')} AND {_stair('t_')})) AND ({_stair('s_')} OR {_stair('t_')} OR abs(s_cz - t_cz) <= 0.35)),
far AS (SELECT * FROM free WHERE gap > greatest({_BIG['s_']}, {_BIG['t_']}) * 1.75)"""
_COSTED = f""", cost AS (SELECT s_leaf_id, t_leaf_id, gap * ({_COST.format(p='t_')}) + gap * (CAST(t_probability AS DOUBLE) * CAST(t_probability AS DOUBLE) * 6.0 + CASE WHEN t_leaf_id IN (SELECT leaf_id FROM tight) THEN 10.0 ELSE 0.0 END + CASE WHEN t_label = 2 THEN 1.25 ELSE 0.0 END + CASE WHEN t_is_cross_floor THEN 2.0 ELSE 0.0 END) + abs(s_cz - t_cz) * 0.75 AS cost FROM free f WHERE NOT EXISTS (SELECT 1 FROM cut WHERE cut.s_leaf_id = f.s_leaf_id AND cut.t_leaf_id = f.t_leaf_id))"""
_ALL = LEAVES + FACES + _NEAR + _COMP + _STATS + _GRAPH + _OBST + _TIGHT + _FREE + _CUT.format(edges="far", c=PLAN.obstacle_cell) + _COSTED
EDGE_COST = _ALL + " SELECT s_leaf_id AS src_leaf_id, t_leaf_id AS dst_leaf_id, round(cost, 3) AS cost FROM cost"


def heuristic_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, _ = _tree(spark, sf_dir)
    goal = tree.where("leaf_id = 0").select("frame_id", *[F.col(c).alias(f"dst_{c}") for c in graph.NODE])
    sides = tree.select("frame_id", *[F.col(c).alias(f"src_{c}") for c in graph.NODE]).join(F.broadcast(goal), "frame_id")  # one leaf
    return sides.select(F.col("src_leaf_id").alias("leaf_id"), r4(graph.heuristic(PLAN), "estimate"))


HEURISTIC_COST = LEAVES + f""", p AS (SELECT a.leaf_id, a.label, a.is_cross_floor, CAST(a.probability AS DOUBLE) AS p, abs(a.cz - g.cz) AS rise, sqrt((a.cx - g.cx) * (a.cx - g.cx) + (a.cy - g.cy) * (a.cy - g.cy) + (a.cz - g.cz) * (a.cz - g.cz)) AS gap, greatest(CAST(a.max_z AS DOUBLE) - CAST(a.min_z AS DOUBLE), CAST(g.max_z AS DOUBLE) - CAST(g.min_z AS DOUBLE)) AS tall FROM leaf a, leaf g WHERE g.leaf_id = 0)
SELECT leaf_id, round((gap * (p * 6.0 + 1.0) + rise * 0.75 + CASE label WHEN 2 THEN 1.25 WHEN 1 THEN 1000.0 ELSE 0.0 END + CASE WHEN rise > tall AND NOT (label = 2 OR is_cross_floor) THEN 2.0 ELSE 0.0 END) * 1.15::DOUBLE, 4) AS estimate FROM p"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query from every supplier: its balance and nation make the point."""
    t = adapters.table(spark, sf_dir, "supplier")
    return t.select(F.col("s_suppkey").alias("query_id"), F.lit(0).alias("frame_id"), ((F.col("s_suppkey") % 9) * 0.7 - 2.8).cast("float").alias("x"), ((F.col("s_nationkey") % 7) * 0.9 - 2.7).cast("float").alias("y"), ((F.col("s_suppkey") % 5) * 0.8 - 1.6).cast("float").alias("z"))


_ASKED = "SELECT s_suppkey AS query_id, CAST((s_suppkey % 9) * CAST(0.7 AS DOUBLE) - CAST(2.8 AS DOUBLE) AS FLOAT) AS x, CAST((s_nationkey % 7) * CAST(0.9 AS DOUBLE) - CAST(2.7 AS DOUBLE) AS FLOAT) AS y, CAST((s_suppkey % 5) * CAST(0.8 AS DOUBLE) - CAST(1.6 AS DOUBLE) AS FLOAT) AS z FROM supplier"


def endpoint_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, roots = _tree(spark, sf_dir)
    out = graph.endpoint_snap(_asked(spark, sf_dir), tree, roots, CFG, PLAN)
    return out.select("query_id", "leaf_id", "snapped", r4("snap_distance", "snap_distance"))


ENDPOINT_SNAP = LEAVES + f""", asked AS ({_ASKED}), inside AS (SELECT query_id, leaf_id, label, probability, row_number() OVER (PARTITION BY query_id ORDER BY {held_order_sql('x', 'y', 'z')}) AS k FROM asked, leaf l WHERE x BETWEEN l.min_x AND l.max_x AND y BETWEEN l.min_y AND l.max_y AND z BETWEEN l.min_z AND l.max_z),
ok AS (SELECT query_id, leaf_id FROM inside WHERE k = 1 AND {_open()}),
gaps AS (SELECT query_id, leaf_id, sqrt((cx - x) * (cx - x) + (cy - y) * (cy - y) + (cz - z) * (cz - z)) AS gap FROM (SELECT query_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM asked) a, leaf WHERE {_open()}),
best AS (SELECT query_id, leaf_id, gap FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gap, leaf_id) AS k FROM gaps WHERE gap <= 1.5) WHERE k = 1)
SELECT a.query_id, coalesce(o.leaf_id, b.leaf_id) AS leaf_id, o.leaf_id IS NULL AND b.leaf_id IS NOT NULL AS snapped, round(CASE WHEN o.leaf_id IS NULL THEN coalesce(b.gap, 0.0) ELSE 0.0 END, 4) AS snap_distance FROM asked a LEFT JOIN ok o USING (query_id) LEFT JOIN best b USING (query_id)"""


def astar_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, roots, costs = _costs(spark, sf_dir)
    ends = graph.endpoint_snap(_asked(spark, sf_dir), tree, roots, CFG, PLAN)
    goal = ends.select(((F.col("query_id") % 10) + 1).alias("_next"), F.col("query_id").alias("_goal_query"), F.col("leaf_id").alias("goal_leaf")).where("_goal_query <= 10")
    asked = ends.join(goal, F.col("query_id") % 10 + 1 == F.col("_next")).select("frame_id", "query_id", F.col("leaf_id").alias("start_leaf"), "goal_leaf")
    out = graph.find_paths(tree, written(costs, "costs"), asked, PLAN)
    return out.select("query_id", "success", F.regexp_replace("message", r" \(.*", "").alias("message"), "start_leaf", "goal_leaf", r4("total_cost", "total_cost", 3), "expanded", F.size("leaf_ids").alias("steps"), F.size("waypoints").alias("waypoints"))


def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search without an estimate, which makes every path the shortest: from twenty leaves to every fifth one, blocked ones too, and some ends that are not there."""
    tree, roots, costs = _costs(spark, sf_dir)
    plan = PlannerConfig(heuristic_weight=0.0)
    ends = tree.where("leaf_id < 20").select("frame_id", F.col("leaf_id").alias("start_leaf"))
    goals = tree.where("leaf_id % 5 = 0").agg(F.collect_list("leaf_id").alias("goals"))  # one row
    ends = ends.join(F.broadcast(goals)).withColumn("goal_leaf", F.explode("goals"))
    asked = ends.select("frame_id", (F.col("start_leaf") * 1_000_000 + F.col("goal_leaf")).alias("query_id"), "start_leaf", F.when(F.col("goal_leaf") % 50 == 0, F.lit(999_999)).otherwise(F.col("goal_leaf")).cast("long").alias("goal_leaf"))
    asked = asked.withColumn("goal_leaf", F.when(F.col("query_id") % 35 != 0, F.col("goal_leaf"))).withColumn("start_snap", F.when(F.col("start_leaf") % 3 == 0, 0.25)).withColumn("goal_snap", F.when(F.col("start_leaf") % 2 == 0, 1.5))
    out = graph.find_paths(tree, written(costs, "costs"), asked, plan)
    return out.select("query_id", "success", "message", r4("total_cost", "total_cost", 3))


_REACHED = """, reached(s, node, cost) USING KEY (s, node) AS (SELECT leaf_id, leaf_id, 0.0::DOUBLE FROM leaf WHERE leaf_id < 20
 UNION SELECT n.s, n.t, n.c FROM (SELECT r.s, e.t_leaf_id AS t, min(r.cost + e.cost) AS c FROM reached r JOIN cost e ON e.s_leaf_id = r.node GROUP BY 1, 2) n LEFT JOIN recurring.reached o ON o.s = n.s AND o.node = n.t WHERE o.cost IS NULL OR n.c < o.cost)"""
_PATH_ENDS = """, wish AS (SELECT a.leaf_id AS s, CASE WHEN (a.leaf_id * 1000000 + b.leaf_id) % 35 <> 0 THEN CASE WHEN b.leaf_id % 50 = 0 THEN 999999 ELSE b.leaf_id END END AS g, a.leaf_id * 1000000 + b.leaf_id AS query_id FROM leaf a, leaf b WHERE a.leaf_id < 20 AND b.leaf_id % 5 = 0),
told AS (SELECT e.query_id, e.s, r.cost, CASE WHEN g IS NULL THEN 'Goal point cannot be resolved to a traversable leaf' WHEN b.leaf_id IS NULL THEN 'Start or goal node index is out of range' WHEN NOT {a} THEN 'Start node is not traversable' WHEN NOT {b} THEN 'Goal node is not traversable' WHEN r.cost IS NULL THEN 'No path found' ELSE 'Path found' END AS message
 FROM wish e JOIN leaf a ON e.s = a.leaf_id LEFT JOIN leaf b ON e.g = b.leaf_id LEFT JOIN reached r ON r.s = e.s AND r.node = e.g)
SELECT query_id, message = 'Path found' AS success, CASE WHEN message <> 'Path found' THEN message WHEN s % 6 = 0 THEN 'Path found (start snapped 0.250000m, goal snapped 1.500000m)' WHEN s % 3 = 0 THEN 'Path found (start snapped 0.250000m)' WHEN s % 2 = 0 THEN 'Path found (goal snapped 1.500000m)' ELSE message END AS message, CASE WHEN message = 'Path found' THEN round(cost, 3) END AS total_cost FROM told""".format(a=_open("a."), b=_open("b."))
SHORTEST_PATHS = _ALL + _REACHED + _PATH_ENDS


def leaf_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, _ = _tree(spark, sf_dir)
    by_depth = view.colours(tree, "depth").select("leaf_id", *[r4(c, f"depth_{c}", 3) for c in "rgb"])
    by_label = view.colours(tree, "label").select("leaf_id", *[r4(c, f"label_{c}", 3) for c in "rgb"])
    return view.colours(tree).select("leaf_id", *[r4(c, c, 3) for c in "rgb"]).join(by_depth, "leaf_id").join(by_label, "leaf_id")


LEAF_COLOURS = LEAVES + f""", c AS (SELECT leaf_id, {_stair()} AS st, label = 1 OR CAST(probability AS DOUBLE) >= 0.7 AS blk, least(1.0, depth / 9.0) AS t, greatest(0.0, least(1.0, CAST(probability AS DOUBLE))) AS p FROM leaf)
SELECT leaf_id, round(CASE WHEN st THEN 1.0 WHEN p < 0.5 THEN 0.18 + 0.82 * p * 2 ELSE 1.0 END, 3) AS r, round(CASE WHEN st THEN 0.0 WHEN p < 0.5 THEN 0.72 + 0.18 * p * 2 ELSE 0.9 - 0.78 * (p * 2 - 1) END, 3) AS g, round(CASE WHEN st THEN 0.95 WHEN p < 0.5 THEN 0.95 - 0.85 * p * 2 ELSE 0.1 - 0.04 * (p * 2 - 1) END, 3) AS b,
 round(CASE WHEN st THEN 1.0 ELSE 0.15 + 0.85 * t END, 3) AS depth_r, round(CASE WHEN st THEN 0.0 ELSE 0.85 - 0.55 * t END, 3) AS depth_g, round(CASE WHEN st THEN 0.95 ELSE 1.0 - 0.75 * t END, 3) AS depth_b,
 CASE WHEN st OR blk THEN 1.0 ELSE 0.12 END AS label_r, CASE WHEN st THEN 0.0 WHEN blk THEN 0.2 ELSE 0.85 END AS label_g, CASE WHEN st THEN 0.95 WHEN blk THEN 0.12 ELSE 0.35 END AS label_b FROM c"""


def render_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, _ = _tree(spark, sf_dir)
    return view.render_cap(written(tree, "tree"), 150).select("leaf_id", "label")


RENDER_CAP = LEAVES + f""", n AS (SELECT count(*) FILTER ({_stair()}) AS s, count(*) AS n FROM leaf), w AS (SELECT s, n - s AS f, least(n, 150) AS room, least(s, 150) AS m1, greatest(0, least(n, 150) - s) AS m0 FROM n),
p AS (SELECT DISTINCT true AS st, CAST(floor(i * (CAST(s AS DOUBLE) / m1)) AS BIGINT) AS at_ FROM w, unnest(range(m1)) AS t(i) UNION SELECT DISTINCT false, CAST(floor(i * (CAST(f AS DOUBLE) / m0)) AS BIGINT) FROM w, unnest(range(m0)) AS t(i)),
k AS (SELECT leaf_id, label, {_stair()} AS st, row_number() OVER (PARTITION BY {_stair()} ORDER BY leaf_id) - 1 AS at_ FROM leaf) SELECT leaf_id, label FROM k JOIN p USING (st, at_)"""


def endpoint_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, roots = _tree(spark, sf_dir)
    ends = graph.endpoint_snap(_asked(spark, sf_dir), tree, roots, CFG, PLAN).select("query_id", "frame_id", "leaf_id", "snapped", "snap_distance")
    shown = ends.join(tree.select("frame_id", "leaf_id", "cx", "cy", "cz", "label", "probability"), ["frame_id", "leaf_id"], "left")
    return shown.select("query_id", view.endpoint_line("start").alias("line"))


_SNAPPED = f""", asked AS ({_ASKED}), inside AS (SELECT query_id, leaf_id, label, probability, row_number() OVER (PARTITION BY query_id ORDER BY {held_order_sql('x', 'y', 'z')}) AS k FROM asked, leaf l WHERE x BETWEEN l.min_x AND l.max_x AND y BETWEEN l.min_y AND l.max_y AND z BETWEEN l.min_z AND l.max_z),
ok AS (SELECT query_id, leaf_id FROM inside WHERE k = 1 AND {_open()}),
gaps AS (SELECT query_id, leaf_id, sqrt((cx - x) * (cx - x) + (cy - y) * (cy - y) + (cz - z) * (cz - z)) AS gap FROM (SELECT query_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM asked) a, leaf WHERE {_open()}),
best AS (SELECT query_id, leaf_id, gap FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gap, leaf_id) AS k FROM gaps WHERE gap <= 1.5) WHERE k = 1),
snap AS MATERIALIZED (SELECT a.query_id, coalesce(o.leaf_id, b.leaf_id) AS leaf_id, o.leaf_id IS NULL AND b.leaf_id IS NOT NULL AS snapped, CASE WHEN o.leaf_id IS NULL THEN coalesce(b.gap, 0.0) ELSE 0.0 END AS snap_distance FROM asked a LEFT JOIN ok o USING (query_id) LEFT JOIN best b USING (query_id))"""
ENDPOINT_LINES = LEAVES + _SNAPPED + """ SELECT s.query_id, CASE WHEN l.leaf_id IS NULL THEN 'start_node=none' ELSE concat('start_node=', s.leaf_id, printf(' start_center=(%.3f,%.3f,%.3f)', cx, cy, cz), ' start_label=', CASE label WHEN 0 THEN 'free' WHEN 1 THEN 'obstacle' WHEN 2 THEN 'stair' ELSE 'unknown' END, printf(' start_prob=%.3f', CAST(probability AS DOUBLE)), CASE WHEN snapped THEN printf(' start_snapped=%.3fm', snap_distance) ELSE '' END) END AS line FROM snap s LEFT JOIN leaf l USING (leaf_id)"""


def path_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, roots, costs = _costs(spark, sf_dir)
    ends = graph.endpoint_snap(_asked(spark, sf_dir), tree, roots, CFG, PLAN).select("frame_id", "query_id", F.col("leaf_id").alias("start_leaf"), F.col("leaf_id").alias("goal_leaf"))
    return view.path_markers(graph.find_paths(tree, written(costs, "costs"), ends, PLAN)).groupBy("kind").agg(F.count(F.lit(1)).alias("markers"), F.sum(F.size("points")).alias("points"))


# a path from a leaf to itself is that leaf, and where there is no leaf there is nothing to draw
PATH_MARKERS = LEAVES + _SNAPPED + " SELECT kind, count(*) AS markers, CAST(sum(CASE kind WHEN 'delete' THEN 0 ELSE 1 END) AS BIGINT) AS points FROM snap, unnest(CASE WHEN leaf_id IS NULL THEN ['delete'] ELSE ['line', 'start', 'goal'] END) AS t(kind) GROUP BY kind"


def path_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = adapters.table(spark, sf_dir, "events")
    points = t.select((F.col("event_id") % 50).alias("path_id"), F.col("event_id").alias("ord"), ((F.col("user_id") % 40) * 0.25).alias("x"), (F.col("value") % 20.0).alias("y"), (1.0 + 4.0 * (F.col("event_id") % 3)).alias("z"))
    return graph.segments(points, ["path_id"]).select("path_id", "ord", *[r4(c, c) for c in ("mid_x", "mid_y", "mid_z", "length", "dir_x", "dir_y", "dir_z")])


PATH_SEGMENTS = """WITH p AS (SELECT event_id % 50 AS path_id, event_id AS ord, (user_id % 40) * 0.25::DOUBLE AS x, value % 20.0::DOUBLE AS y, 1.0::DOUBLE + 4.0 * (event_id % 3) AS z FROM events),
n AS (SELECT *, lead(x) OVER w AS tx, lead(y) OVER w AS ty, lead(z) OVER w AS tz FROM p WINDOW w AS (PARTITION BY path_id ORDER BY ord)),
l AS (SELECT *, sqrt((tx - x) * (tx - x) + (ty - y) * (ty - y) + (tz - z) * (tz - z)) AS len FROM n WHERE tx IS NOT NULL)
SELECT path_id, ord, round((x + tx) * 0.5, 4) AS mid_x, round((y + ty) * 0.5, 4) AS mid_y, round((z + tz) * 0.5, 4) AS mid_z, round(len, 4) AS length, round((tx - x) / len, 4) AS dir_x, round((ty - y) / len, 4) AS dir_y, round((tz - z) / len, 4) AS dir_z FROM l WHERE len >= 1e-4"""


def path_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = adapters.table(spark, sf_dir, "orders")
    point = F.struct((F.col("o_orderkey") % 3).cast("double").alias("x"), F.lit(0.0).alias("y"), (F.col("o_orderkey") % 2 * 0.04).alias("z"))
    paths = t.select((F.col("o_custkey") % 100).alias("path_id"), F.col("o_orderkey").alias("frame"), F.array(point, point).alias("waypoints"))
    return state.changed_paths(paths, ["path_id"], "frame").groupBy("path_id").agg(F.count(F.lit(1)).alias("frames"), F.count_if("changed").alias("changes"))


PATH_CHANGES = """WITH p AS (SELECT o_custkey % 100 AS path_id, o_orderkey AS frame, CAST(o_orderkey % 3 AS DOUBLE) AS x, o_orderkey % 2 * 0.04::DOUBLE AS z FROM orders),
n AS (SELECT *, lag(x) OVER w AS bx, lag(z) OVER w AS bz FROM p WINDOW w AS (PARTITION BY path_id ORDER BY frame))
SELECT path_id, count(*) AS frames, count(*) FILTER (bx IS NULL OR sqrt((x - bx) * (x - bx) + (z - bz) * (z - bz)) > 0.05) AS changes FROM n GROUP BY 1"""

NAMES = ["face_neighbors", "traversal_cost", "traversal_edges", "flood_fill", "obstacle_cells", "clearance_semijoin", "segment_block", "stair_edges", "stair_components", "stair_component_stats", "floor_gate", "graph_edges", "edge_cost", "edge_cost_dense", "heuristic_cost", "endpoint_snap", "leaf_colours", "render_cap", "endpoint_lines", "path_markers", "astar_path", "shortest_paths", "path_segments", "path_changes"]
QUERIES = {n: globals()[n] for n in NAMES}
SQL = {n: globals()[n.upper()] for n in NAMES if n.upper() in globals()}
