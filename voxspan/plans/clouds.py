"""Queries over point clouds, and their SQL: ingest, octree, features and updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import OctreeConfig
from ..functions.geometry import AXES, d, unsigned
from ..operators import features, ingest, octree
from ..sources import adapters, shapes
from ..streaming import state

CFG = OctreeConfig()
SHALLOW = OctreeConfig(max_depth=6)
KEY = ["frame_id", "depth", "path"]

# --- SQL parts ------------------------------------------------------------------------------------------------------

LINEITEM = """SELECT CAST(l_quantity * CAST(0.4 AS DOUBLE) AS FLOAT) AS x, CAST((l_partkey % 97) * CAST(0.2 AS DOUBLE) AS FLOAT) AS y,
 CAST(l_linenumber * CAST(1.3 AS DOUBLE) + l_discount * CAST(4.0 AS DOUBLE) AS FLOAT) AS z, l_suppkey AS entity_id, CAST(l_suppkey % 4 AS INTEGER) AS room_id,
 CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 0 END AS label,
 CAST(CASE l_returnflag WHEN 'A' THEN 0.95 WHEN 'R' THEN 0.25 ELSE 0.05 END AS FLOAT) AS probability,
 l_returnflag = 'R' AS is_cross_floor, CAST(year(l_shipdate) AS INTEGER) AS frame_id, row_number() OVER () AS id FROM lineitem"""

EMBEDDINGS = """SELECT CAST(CAST(embedding[1] AS DOUBLE) * CAST(10.0 AS DOUBLE) AS FLOAT) AS x, CAST(CAST(embedding[2] AS DOUBLE) * CAST(10.0 AS DOUBLE) AS FLOAT) AS y,
 CAST(CAST(embedding[3] AS DOUBLE) * CAST(10.0 AS DOUBLE) AS FLOAT) AS z, vec_id % 50 AS entity_id, 0 AS room_id, CAST(label % 3 AS INTEGER) AS label,
 CAST(CASE label % 3 WHEN 1 THEN 0.95 WHEN 2 THEN 0.25 ELSE 0.05 END AS FLOAT) AS probability, label % 3 = 2 AS is_cross_floor, 0 AS frame_id, vec_id AS id FROM embeddings"""

F32 = "CAST({} AS FLOAT)"


def roots_sql(points: str = "pts") -> str:
    ends = ", ".join(f"min({a}) AS lo_{a}, max({a}) AS hi_{a}" for a in AXES)
    span = "greatest(" + ", ".join(f"hi_{a} - lo_{a}" for a in AXES) + ", CAST(1.0 AS FLOAT))"
    pad = f"greatest(CAST(0.5 AS FLOAT), CAST(0.02 AS FLOAT) * {span})"
    sides = ", ".join(f"lo_{a} - pad AS root_min_{a}, hi_{a} + pad AS root_max_{a}" for a in AXES)
    return f"SELECT frame_id, {sides} FROM (SELECT *, {pad} AS pad FROM (SELECT frame_id, {ends} FROM {points} GROUP BY frame_id))"


def encode_sql(points: str, roots: str, depth: int) -> str:
    """A row for each point (frame_id, id) and level with the path and bounds of its cell, by halving the root box."""
    start = ", ".join(f"root_min_{a} AS min_{a}, root_max_{a} AS max_{a}" for a in AXES)
    mid = {a: f"(CAST(0.5 AS FLOAT) * (e.min_{a} + e.max_{a}))" for a in AXES}
    code = " + ".join(f"(CASE WHEN e.{a} >= {mid[a]} THEN {1 << i} ELSE 0 END)" for i, a in enumerate(AXES))
    cut = ", ".join(f"CASE WHEN e.{a} >= {mid[a]} THEN {mid[a]} ELSE e.min_{a} END, CASE WHEN e.{a} >= {mid[a]} THEN e.max_{a} ELSE {mid[a]} END" for a in AXES)
    return f"""SELECT p.frame_id, p.id, p.x, p.y, p.z, 0 AS depth, CAST(0 AS BIGINT) AS path, {start} FROM {points} p JOIN {roots} r USING (frame_id)
 UNION ALL SELECT e.frame_id, e.id, e.x, e.y, e.z, e.depth + 1, e.path * 8 + {code}, {cut} FROM enc e WHERE e.depth < {depth}"""


def held_order_sql(px: str, py: str, pz: str, leaf: str = "l") -> str:
    """The leaf that holds a point on cuts: that of the upper halves, then by octant."""
    upper = [f"({p} < {leaf}.max_{a})" for p, a in zip((px, py, pz), AXES, strict=True)]
    octant = " + ".join(f"{1 << i} * CAST({u} AS INTEGER)" for i, u in enumerate(upper))
    return f"({' AND '.join(upper)}) DESC, {octant}, {leaf}.depth"


def size_sql(prefix: str = "") -> str:
    return "greatest(" + ", ".join(f"CAST({prefix}max_{a} AS DOUBLE) - CAST({prefix}min_{a} AS DOUBLE)" for a in AXES) + ")"


def octree_sql(cloud: str, cfg: OctreeConfig) -> str:
    """WITH parts pts, roots, enc, cand (cells with their split flag), own (each point's leaf) and leaf (leaves with votes)."""
    box = ", ".join(f"any_value(e.{s}_{a}) AS {s}_{a}" for s in ("min", "max") for a in AXES)
    volume = " * ".join(f"(CAST(max_{a} AS DOUBLE) - CAST(min_{a} AS DOUBLE))" for a in AXES)
    least = f"CAST(CAST(CASE WHEN has_stair THEN {cfg.stair_min_voxel} ELSE {cfg.corridor_min_voxel} END AS FLOAT) AS DOUBLE)"
    most = f"CAST(CAST(CASE WHEN has_stair THEN {cfg.stair_max_voxel} ELSE {cfg.corridor_max_voxel} END AS FLOAT) AS DOUBLE)"
    split = f"depth < {cfg.max_depth} AND n >= {cfg.min_points_to_split} AND {size_sql()} > {least} AND ({size_sql()} > {most} OR n / ({volume}) > {cfg.dense_points_per_m3} OR n > {cfg.dense_points_to_split})"
    centre = ", ".join(f"(CAST(min_{a} AS DOUBLE) + CAST(max_{a} AS DOUBLE)) * 0.5 AS c{a}" for a in AXES)
    return f"""WITH RECURSIVE pts AS MATERIALIZED ({cloud}), roots AS MATERIALIZED ({roots_sql()}), enc AS ({encode_sql('pts', 'roots', cfg.max_depth)}),
cand AS MATERIALIZED (SELECT *, {split} AS split FROM (SELECT e.frame_id, e.depth, e.path, count(*) AS n, bool_or(p.label = 2 OR p.is_cross_floor) AS has_stair, {box}
  FROM enc e JOIN pts p ON e.frame_id = p.frame_id AND e.id = p.id GROUP BY 1, 2, 3)),
own AS MATERIALIZED (SELECT e.frame_id, e.id, min(e.depth) AS leaf_depth, min_by(e.path, e.depth) AS leaf_path FROM enc e JOIN cand c ON e.frame_id = c.frame_id AND e.depth = c.depth AND e.path = c.path WHERE NOT c.split GROUP BY 1, 2),
voted AS (SELECT o.frame_id, o.leaf_depth AS depth, o.leaf_path AS path, count(*) AS n, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 2) AS n2, avg(CAST(probability AS DOUBLE)) AS p, bool_or(is_cross_floor) AS is_cross
  FROM own o JOIN pts USING (frame_id, id) GROUP BY 1, 2, 3),
rooms AS (SELECT frame_id, depth, path, min_by(room_id, -k * 1000000.0 + room_id) AS room_id FROM (SELECT o.frame_id, o.leaf_depth AS depth, o.leaf_path AS path, room_id, count(*) AS k FROM own o JOIN pts USING (frame_id, id) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
ents AS (SELECT frame_id, depth, path, min_by(entity_id, -k * 100000000.0 + entity_id) AS entity_id FROM (SELECT o.frame_id, o.leaf_depth AS depth, o.leaf_path AS path, entity_id, count(*) AS k FROM own o JOIN pts USING (frame_id, id) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
leaf AS MATERIALIZED (SELECT *, {centre}, row_number() OVER (PARTITION BY frame_id ORDER BY path << (3 * ({cfg.max_depth} - depth)), depth) - 1 AS leaf_id FROM (
 SELECT v.frame_id, v.depth, v.path, v.n, CASE WHEN n2 >= n1 AND n2 >= n0 THEN 2 WHEN n1 >= n0 THEN 1 ELSE 0 END AS label, CAST(greatest(0.0, least(1.0, p)) AS FLOAT) AS probability, (is_cross OR n2 > 0) AS is_cross_floor, room_id, entity_id, false AS dynamic,
 c.min_x, c.min_y, c.min_z, c.max_x, c.max_y, c.max_z FROM voted v JOIN rooms USING (frame_id, depth, path) JOIN ents USING (frame_id, depth, path) JOIN cand c USING (frame_id, depth, path)))
"""


def r4(c, name: str | None = None, digits: int = 4):
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c.cast("double"), digits)
    return out.alias(name) if name else out


# --- queries --------------------------------------------------------------------------------------------------------


def root_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = octree.root_bounds(adapters.lineitem_cloud(spark, sf_dir))
    return out.select("frame_id", *[r4(c, c) for c in out.columns if c != "frame_id"])


ROOT_BOUNDS = f"WITH pts AS ({LINEITEM}) SELECT frame_id, " + ", ".join(f"round(CAST(root_{s}_{a} AS DOUBLE), 4) AS root_{s}_{a}" for s in ("min", "max") for a in AXES) + f" FROM ({roots_sql()})"


def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = adapters.event_frames(spark, sf_dir)
    rows = events.withColumn("seq", F.col("frame_id"))
    return ingest.finite(ingest.stride_sample(rows, 1500)).select("frame_id", r4("x", "x"), r4("y", "y"), r4("z", "z"))


_FRAMES = "SELECT event_id AS frame_id, ts, event_type, CAST((user_id % 40) * CAST(0.25 AS DOUBLE) AS FLOAT) AS x, CAST(value % CAST(20.0 AS DOUBLE) AS FLOAT) AS y, CAST(1.0 + 4.0 * (event_id % 3) AS FLOAT) AS z FROM events"
STRIDE_SAMPLE = f"SELECT frame_id, round(CAST(x AS DOUBLE), 4) AS x, round(CAST(y AS DOUBLE), 4) AS y, round(CAST(z AS DOUBLE), 4) AS z FROM ({_FRAMES}) WHERE frame_id % greatest(1, CAST(ceil((SELECT count(*) FROM events) / 1500.0) AS BIGINT)) = 0 AND isfinite(x) AND isfinite(y) AND isfinite(z)"


def linspace_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = ingest.numbered(adapters.event_frames(spark, sf_dir), ["frame_id"])
    return ingest.linspace_sample(events, 777).select("frame_id", "seq")


LINSPACE_SAMPLE = """WITH e AS (SELECT event_id AS frame_id, row_number() OVER (ORDER BY event_id) - 1 AS seq, count(*) OVER () AS n FROM events),
m AS (SELECT max(n) AS n, least(max(n), 777) AS m FROM e), w AS (SELECT DISTINCT CAST(floor(CAST(i * (n - 1) AS DOUBLE) / (m - 1)) AS BIGINT) AS seq FROM m, unnest(range(CAST(m AS BIGINT))) AS t(i))
SELECT frame_id, seq FROM e WHERE seq IN (SELECT seq FROM w)"""

_NAMES = {"EUROPE": "floor", "ASIA": "stairs"}


def semantic_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = adapters.table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 10 == 0, "PLANE").otherwise("BOX")
    name = F.concat_ws("::", F.when(F.col("p_size") % 7 == 1, "Ground").when(F.col("p_size") % 7 == 2, "main_Stairs").otherwise("wall"), "p_name")
    out = ingest.semantic_rule(t.select("p_partkey", name.alias("scoped_name"), kind.alias("geometry_type"), (F.col("p_partkey") + F.lit(1 << 33)).alias("entity_key")))
    return out.select("p_partkey", "label", r4("probability", "probability"), "entity_id")


SEMANTIC_RULE = """WITH s AS (SELECT p_partkey, lower(concat_ws('::', CASE p_size % 7 WHEN 1 THEN 'Ground' WHEN 2 THEN 'main_Stairs' ELSE 'wall' END, p_name)) AS name, p_size % 10 = 0 AS plane FROM part),
t AS (SELECT p_partkey, CASE WHEN name LIKE '%floor%' OR name LIKE '%ground%' OR plane THEN 0 WHEN name LIKE '%stair%' THEN 2 ELSE 1 END AS label FROM s)
SELECT p_partkey, label, CASE label WHEN 0 THEN 0.05::DOUBLE WHEN 2 THEN 0.25::DOUBLE ELSE 0.95::DOUBLE END AS probability, (p_partkey + 8589934592) & 4294967295 AS entity_id FROM t"""


def normalised_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = adapters.table(spark, sf_dir, "orders")
    raw = t.select("o_orderkey", "o_custkey", (F.col("o_totalprice") % 50).cast("float").alias("x"), F.lit(1.0).cast("float").alias("y"), F.when(F.col("o_orderkey") % 11 == 0, F.lit(float("nan"))).otherwise(F.lit(2.0)).cast("float").alias("z"), (F.col("o_orderkey") % 5).cast("int").alias("label"), (F.col("o_orderkey") % 7 / 4.0 - 0.5).cast("float").alias("probability"))
    out = ingest.normalised(raw)
    return out.groupBy("label", "is_cross_floor").agg(F.count(F.lit(1)).alias("rows"), r4(F.avg(d("probability")), "mean_probability"), r4(F.max(d("x")), "max_x", 3))


NORMALISED_SAMPLES = """WITH r AS (SELECT CAST(o_totalprice % 50 AS FLOAT) AS x, CASE WHEN o_orderkey % 5 IN (1, 2) THEN CAST(o_orderkey % 5 AS INTEGER) ELSE 0 END AS label, greatest(0.0, least(1.0, CAST(CAST(o_orderkey % 7 AS DOUBLE) / 4.0 - 0.5 AS DOUBLE))) AS p FROM orders WHERE o_orderkey % 11 <> 0)
SELECT label, label = 2 AS is_cross_floor, count(*) AS rows, round(avg(p), 4) AS mean_probability, round(CAST(max(x) AS DOUBLE), 3) AS max_x FROM r GROUP BY label"""


def label_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = octree.leaves(adapters.lineitem_cloud(spark, sf_dir), SHALLOW)
    return out.select(*KEY, "n", "label", r4("probability", "probability"), "is_cross_floor", "room_id", "entity_id")


LABEL_VOTES = octree_sql(LINEITEM, SHALLOW) + "SELECT frame_id, depth, path, n, label, round(CAST(probability AS DOUBLE), 4) AS probability, is_cross_floor, room_id, entity_id FROM leaf"


def octant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = adapters.lineitem_cloud(spark, sf_dir)
    own = octree.encoded(cloud, octree.root_bounds(cloud), OctreeConfig(max_depth=3))
    return octree.prefixes(octree.cells(own, OctreeConfig(max_depth=3)), OctreeConfig(max_depth=3)).select(*KEY, "n", "has_stair")


OCTANT_COUNTS = octree_sql(LINEITEM, OctreeConfig(max_depth=3)) + "SELECT frame_id, depth, path, n, has_stair FROM cand"


def octree_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = adapters.lineitem_cloud(spark, sf_dir)
    tree = octree.nodes(cloud, octree.root_bounds(cloud), CFG)
    return tree.groupBy("frame_id", "depth").agg(F.count(F.lit(1)).alias("nodes"), F.count_if("leaf").alias("leaves"), F.sum("n").alias("points"), F.sum("node_index").alias("index_sum"))


_TREE = """, live AS (SELECT DISTINCT e.frame_id, e.depth, e.path, e.depth = o.leaf_depth AS leaf FROM enc e JOIN own o USING (frame_id, id) WHERE e.depth <= o.leaf_depth),
node AS (SELECT l.*, c.n, row_number() OVER (PARTITION BY l.frame_id ORDER BY l.path << (3 * ({depth} - l.depth)), l.depth) - 1 AS node_index FROM live l JOIN cand c USING (frame_id, depth, path)) """
OCTREE_LEVELS = octree_sql(LINEITEM, CFG) + _TREE.format(depth=CFG.max_depth) + "SELECT frame_id, depth, count(*) AS nodes, count(*) FILTER (leaf) AS leaves, CAST(sum(n) AS BIGINT) AS points, CAST(sum(node_index) AS BIGINT) AS index_sum FROM node GROUP BY 1, 2"


def octree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = octree.leaves(adapters.lineitem_cloud(spark, sf_dir), CFG)
    return out.select(*KEY, octree.octal_path().alias("octants"), "n", *[r4(f"{s}_{a}", f"{s}_{a}") for s in ("min", "max") for a in AXES])


# a leaf is a cell that does not split under cells that all do
OCTREE_LEAVES = octree_sql(LINEITEM, CFG) + (
    ", shut AS (SELECT frame_id, depth, path FROM cand WHERE NOT split), below AS (SELECT DISTINCT c.frame_id, c.depth, c.path FROM shut c, unnest(range(c.depth)) AS u(up) JOIN shut s ON s.frame_id = c.frame_id AND s.depth = u.up AND s.path = c.path >> (3 * (c.depth - u.up))),"
    " top AS (SELECT c.* FROM cand c JOIN (SELECT * FROM shut EXCEPT SELECT * FROM below) USING (frame_id, depth, path))"
    " SELECT frame_id, depth, path, CASE WHEN depth = 0 THEN '' ELSE array_to_string(list_transform(range(depth), lambda i: CAST((path >> (3 * (depth - 1 - i))) & 7 AS VARCHAR)), '') END AS octants, n, "
    + ", ".join(f"round(CAST({s}_{a} AS DOUBLE), 4) AS {s}_{a}" for s in ("min", "max") for a in AXES)
    + " FROM top"
)


def morton_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = octree.with_morton(octree.leaves(adapters.embedding_cloud(spark, sf_dir), CFG), CFG)
    return out.select(*KEY, unsigned(F.col("morton_code")).cast("string").alias("morton_code"))


def _morton_sql(cfg: OctreeConfig) -> str:
    grid = (1 << cfg.max_depth) - 1
    cells = ", ".join(
        f"CAST(trunc(greatest(CAST(0 AS FLOAT), least(CAST({grid} AS FLOAT), (CAST(0.5 AS FLOAT) * (min_{a} + max_{a}) - root_min_{a}) * (CAST({grid} AS FLOAT) / (root_max_{a} - root_min_{a}))))) AS BIGINT) AS q{a}" for a in AXES
    )
    bits = " + ".join(f"(((CAST(q{a} AS UBIGINT) >> {b}) & 1) << {3 * b + i})" for b in range(cfg.max_depth) for i, a in enumerate(AXES))
    return f"SELECT frame_id, depth, path, CAST(CAST({bits} AS HUGEINT) + CAST(depth AS HUGEINT) * 1152921504606846976 AS VARCHAR) AS morton_code FROM (SELECT l.*, {cells} FROM leaf l JOIN roots USING (frame_id))"


MORTON_CODES = octree_sql(EMBEDDINGS, CFG) + _morton_sql(CFG)


def point_in_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = adapters.lineitem_cloud(spark, sf_dir)
    roots = octree.root_bounds(cloud)
    tree = octree.leaves(cloud, SHALLOW, roots)
    asked = adapters.event_frames(spark, sf_dir).select(F.col("frame_id").alias("event_id"), (F.col("frame_id") % 7 + 1995).cast("int").alias("frame_id"), *AXES)
    out = octree.locate(asked, tree, roots, SHALLOW, ["depth", "path", "n"], ["event_id", "frame_id", *AXES])
    return out.select("event_id", "frame_id", F.col("leaf_depth").cast("long").alias("leaf_depth"), "leaf_path", "leaf_n")


POINT_IN_LEAF = octree_sql(LINEITEM, SHALLOW) + f""", asked AS (SELECT frame_id AS event_id, CAST(frame_id % 7 + 1995 AS INTEGER) AS frame_id, x, y, z FROM ({_FRAMES})),
hit AS (SELECT a.event_id, l.depth, l.path, l.n, row_number() OVER (PARTITION BY a.event_id ORDER BY {held_order_sql('a.x', 'a.y', 'a.z')}) AS k FROM asked a JOIN leaf l ON a.frame_id = l.frame_id AND a.x BETWEEN l.min_x AND l.max_x AND a.y BETWEEN l.min_y AND l.max_y AND a.z BETWEEN l.min_z AND l.max_z)
SELECT a.event_id, a.frame_id, CAST(h.depth AS BIGINT) AS leaf_depth, h.path AS leaf_path, h.n AS leaf_n FROM asked a LEFT JOIN hit h ON a.event_id = h.event_id AND h.k = 1"""


def _shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of the small cloud with stand-ins for the normal, so that the projections have an exact oracle."""
    tree = octree.with_morton(octree.leaves(adapters.embedding_cloud(spark, sf_dir), CFG), CFG)
    p = F.col("path")
    return tree.select("*", *[((p % m) / 40.0 - 0.2).alias(f"normal_{a}") for a, m in zip(AXES, (13, 17, 31), strict=True)], *[((p % m) / 50.0).alias(f"eigenvalue_{i}") for i, m in enumerate((7, 11, 19))], *[((p % m) / 20.0).alias(k) for k, m in (("linearity", 23), ("flatness", 29), ("roughness", 5), ("curvature", 3))])


_SHAPED = octree_sql(EMBEDDINGS, CFG) + ", shaped AS (SELECT l.*, " + ", ".join(f"CAST(l.path % {m} AS DOUBLE) / 40.0 - 0.2 AS n{a}" for a, m in zip(AXES, (13, 17, 31), strict=True)) + ", CAST(l.path % 29 AS DOUBLE) / 20.0 AS flatness, " + ", ".join(f"CAST(max_{a} AS DOUBLE) - CAST(min_{a} AS DOUBLE) AS d{a}" for a in AXES) + " FROM leaf l)"
_FEATURES = ["num_points", "voxel_volume", "density", "log_density", "surface_density", "voxel_size", "normalized_depth", "center_x", "center_y", "center_z", "story_index", "story_local_z", "relative_height_from_floor", "relative_distance_to_ceiling", "height_ratio", "is_near_floor", "is_near_ceiling", "normal_magnitude", "verticality", "horizontality", "slope_angle_rad", "roughness_proxy", "aabb_flatness", "aabb_linearity", "aabb_anisotropy", "xy_area", "z_extent", "label", "obstacle_probability"]


def leaf_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.leaf_features(_shaped(spark, sf_dir), keep=["path"])
    return out.select("depth", "path", *[r4(c, c) for c in _FEATURES])


_LEAF_FEATURES = {
    "num_points": "n", "voxel_volume": "vol", "density": "n / vol", "log_density": "ln(1 + n / vol)",
    "surface_density": "CASE WHEN 2 * (dx * dy + dy * dz + dx * dz) > 1e-6 THEN n / (2 * (dx * dy + dy * dz + dx * dz)) ELSE 0 END",
    "voxel_size": "dx", "normalized_depth": "depth / 32.0", "center_x": "cx", "center_y": "cy", "center_z": "cz", "story_index": "floor(cz / 4.0)",
    "story_local_z": "loc", "relative_height_from_floor": "loc - 1.0", "relative_distance_to_ceiling": "4.0 - loc", "height_ratio": "greatest(0.0, least(1.0, (loc - 1.0) / 3.0))",
    "is_near_floor": "CASE WHEN abs(loc - 1.0) <= 0.4 THEN 1 ELSE 0 END", "is_near_ceiling": "CASE WHEN abs(4.0 - loc) <= 0.4 THEN 1 ELSE 0 END",
    "normal_magnitude": "sqrt(nx * nx + ny * ny + nz * nz)", "verticality": "abs(nz)", "horizontality": "sqrt(nx * nx + ny * ny)", "slope_angle_rad": "acos(greatest(0.0, least(1.0, abs(nz))))",
    "roughness_proxy": "greatest(0.0, least(1.0, 1.0 - sqrt(nx * nx + ny * ny + nz * nz)))", "aabb_flatness": "lo / hi", "aabb_linearity": "hi / greatest(mid, 1e-6)", "aabb_anisotropy": "(hi - lo) / hi",
    "xy_area": "dx * dy", "z_extent": "dz", "label": "label", "obstacle_probability": "greatest(0.0, least(1.0, CAST(probability AS DOUBLE)))",
}
LEAF_FEATURES = _SHAPED + ", f AS (SELECT *, greatest(1e-6, dx * dy * dz) AS vol, cz - floor(cz / 4.0) * 4.0 AS loc, least(dx, dy, dz) AS lo, greatest(dx, dy, dz, 1e-6) AS hi, dx + dy + dz - least(dx, dy, dz) - greatest(dx, dy, dz) AS mid FROM shaped) SELECT depth, path, " + ", ".join(f"round(CAST({e} AS DOUBLE), 4) AS {k}" for k, e in _LEAF_FEATURES.items()) + " FROM f"


def weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.weak_labels(_shaped(spark, sf_dir)).select("depth", "path", "label", r4("probability", "probability"))


WEAK_LABELS = _SHAPED + """, w AS (SELECT *, CASE WHEN sqrt(nx * nx + ny * ny + nz * nz) > 1e-6 THEN abs(nz) / sqrt(nx * nx + ny * ny + nz * nz) ELSE 0.0 END AS up, cz - floor(cz / 4.0) * 4.0 AS loc FROM shaped),
v AS (SELECT depth, path, CASE WHEN n >= 3 AND abs(loc - 1.0) <= 0.35 AND up >= cos(0.30::DOUBLE) AND flatness >= 0.35 THEN 0 WHEN n >= 3 AND loc - 1.0 >= 0.08 AND loc <= 4.0 AND acos(up) BETWEEN 0.25 AND 0.90 AND flatness >= 0.25 THEN 2 WHEN n >= 3 AND loc - 1.0 > 0.35 THEN 11 WHEN n >= 3 THEN 12 ELSE 13 END AS k, up FROM w)
SELECT depth, path, CASE WHEN k > 2 THEN 1 ELSE k END AS label, CASE WHEN k = 0 THEN 0.05::DOUBLE WHEN k = 2 THEN 0.25::DOUBLE WHEN k = 11 AND up < 0.45 THEN 0.90::DOUBLE WHEN k = 11 THEN 0.75::DOUBLE WHEN k = 12 THEN 0.65::DOUBLE ELSE 0.50::DOUBLE END AS probability FROM v"""


def pca_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = adapters.lineitem_cloud(spark, sf_dir)
    own = octree.assigned(cloud, octree.root_bounds(cloud), OctreeConfig(max_depth=4))
    out = octree.pca(own, KEY)
    # the centre of a leaf with three points or more; what the eigenvalues sum and multiply to; whether the normal is a unit vector
    e0, e1, e2 = (F.col(f"eigenvalue_{i}") for i in range(3))
    size = F.sqrt(sum(F.col(f"normal_{a}") * F.col(f"normal_{a}") for a in AXES))
    unit = F.when(size > 0, F.abs(size - 1) < 1e-9)
    lies = F.when(size > 0, (F.col("linearity") + F.col("flatness") + F.col("roughness")).between(0.999999, 1.000001))
    return out.select(
        *KEY, "n", *[r4(f"centroid_{a}", f"centroid_{a}", 3) for a in AXES], r4(e0 + e1 + e2, "trace", 3), r4(e0 * e1 + e0 * e2 + e1 * e2, "minors", 3), r4(e0 * e1 * e2, "determinant", 3),
        ((e0 <= e1) & (e1 <= e2)).cast("int").alias("ordered"), unit.cast("int").alias("unit_normal"), lies.cast("int").alias("shares_add_up"), r4(F.when(size > 0, F.col("curvature") * (e0 + e1 + e2) - e0), "curvature_rest", 6),
    )


_MOMENTS = ", ".join([f"avg(CAST({a} AS DOUBLE)) AS c{a}, var_pop(CAST({a} AS DOUBLE)) AS {a}{a}" for a in AXES] + [f"covar_pop(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS {a}{b}" for a, b in ("xy", "xz", "yz")])
PCA_LEAVES = octree_sql(LINEITEM, OctreeConfig(max_depth=4)) + f""", g AS (SELECT o.frame_id, o.leaf_depth AS depth, o.leaf_path AS path, count(*) AS n, {_MOMENTS} FROM own o JOIN pts USING (frame_id, id) GROUP BY 1, 2, 3),
m AS (SELECT *, xx + yy + zz AS tr, xx * yy + xx * zz + yy * zz - xy * xy - xz * xz - yz * yz AS mi, xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) AS det FROM g)
SELECT frame_id, depth, path, n, round(cx, 3) AS centroid_x, round(cy, 3) AS centroid_y, round(cz, 3) AS centroid_z, round(CASE WHEN n >= 3 THEN tr ELSE 0.0 END, 3) AS trace, round(CASE WHEN n >= 3 THEN mi ELSE 0.0 END, 3) AS minors, round(CASE WHEN n >= 3 THEN det ELSE 0.0 END, 3) AS determinant,
 1 AS ordered, CASE WHEN n >= 3 AND tr >= 1e-8 THEN 1 END AS unit_normal, CASE WHEN n >= 3 AND tr >= 1e-8 THEN 1 END AS shares_add_up, CASE WHEN n >= 3 AND tr >= 1e-8 THEN 0.0::DOUBLE END AS curvature_rest FROM m"""


def empty_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of all years up to 2010, also of those without points."""
    frames = spark.range(1990, 2011).select(F.col("id").cast("int").alias("frame_id"))
    out = octree.root_bounds_of(frames, adapters.lineitem_cloud(spark, sf_dir))
    return out.select("frame_id", *[r4(c, c) for c in out.columns if c != "frame_id"])


EMPTY_ROOTS = f"WITH pts AS ({LINEITEM}), r AS ({roots_sql()}) SELECT f.frame_id, " + ", ".join(f"round(CAST(coalesce(r.{c}, {v}) AS DOUBLE), 4) AS {c}" for c, v in octree.EMPTY_ROOT.items()) + " FROM (SELECT CAST(i AS INTEGER) AS frame_id FROM unnest(range(1990, 2011)) AS t(i)) f LEFT JOIN r USING (frame_id)"


def leaf_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves of the tree by their number among all nodes."""
    cloud = adapters.lineitem_cloud(spark, sf_dir)
    return octree.nodes(cloud, octree.root_bounds(cloud), SHALLOW).where("leaf").select("node_index", *KEY, "n")


LEAF_NUMBERS = octree_sql(LINEITEM, SHALLOW) + _TREE.format(depth=SHALLOW.max_depth) + "SELECT node_index, frame_id, depth, path, n FROM node WHERE leaf"


def cloud_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = adapters.lineitem_cloud(spark, sf_dir)
    return cloud.groupBy("frame_id").agg(F.count(F.lit(1)).alias("points"), *[r4(fn(d(a)), f"{s}_{a}") for s, fn in (("min", F.min), ("max", F.max)) for a in AXES])


CLOUD_EXTENTS = f"SELECT frame_id, count(*) AS points, " + ", ".join(f"round(CAST({s}({a}) AS DOUBLE), 4) AS {s}_{a}" for s in ("min", "max") for a in AXES) + f" FROM ({LINEITEM}) GROUP BY frame_id"


def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = adapters.embedding_cloud(spark, sf_dir).withColumn("seq", F.col("vec_id"))
    return ingest.quota_sample(cloud, 300).select("seq", "entity_id", "label")


QUOTA_SAMPLE = f"""WITH RECURSIVE b AS (SELECT id AS seq, entity_id, label, CASE WHEN label = 2 THEN 2 WHEN label = 1 OR probability >= 0.5 THEN 1 ELSE 0 END AS kind, row_number() OVER (PARTITION BY entity_id ORDER BY id) - 1 AS r, count(*) OVER (PARTITION BY entity_id) AS e, count(*) OVER () AS n, 300 AS budget FROM ({EMBEDDINGS})),
q AS (SELECT entity_id, max(e) AS e, CASE arg_min(kind, seq) WHEN 2 THEN 96 WHEN 1 THEN 64 ELSE 32 END AS quota FROM b GROUP BY 1),
q2 AS (SELECT *, greatest(0, least(quota, 300 - coalesce(sum(least(quota, e)) OVER (ORDER BY entity_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS cnt FROM q),
s0 AS (SELECT b.*, n <= budget OR (cnt > 0 AND (cnt >= q2.e OR r IN (SELECT (i * q2.e) // nullif(cnt, 0) FROM unnest(range(CAST(cnt AS BIGINT))) AS t(i)))) AS chosen FROM b JOIN q2 USING (entity_id)),
""" + "".join(
    f"""k{k} AS (SELECT *, CASE WHEN kind = {kind} THEN count(*) FILTER (kind = {kind}) OVER (ORDER BY seq) - 1 END AS rk, count(*) FILTER (kind = {kind}) OVER () AS m, count(*) FILTER (chosen) OVER () AS taken FROM s{k - 1}),
t{k} AS (SELECT *, least({target}, budget - taken) AS cnt FROM k{k}),
s{k} AS (SELECT seq, entity_id, label, kind, n, budget, chosen OR (kind = {kind} AND cnt > 0 AND (cnt >= m OR CAST(ceil(CAST(rk * cnt AS DOUBLE) / m) AS BIGINT) * m // nullif(cnt, 0) = rk AND CAST(ceil(CAST(rk * cnt AS DOUBLE) / m) AS BIGINT) < cnt)) AS chosen FROM t{k}),
"""
    for k, kind, target in ((1, 2, "least(m, 60)"), (2, 1, "least(m, 120)"), (3, 0, "300"))
) + """k4 AS (SELECT *, seq IN (SELECT (i * (SELECT max(n) FROM s3)) // 300 FROM unnest(range(300)) AS t(i)) OR n <= budget AS w FROM s3),
t4 AS (SELECT *, count(*) FILTER (w AND NOT chosen) OVER (ORDER BY seq) - 1 AS rk, count(*) FILTER (chosen) OVER () AS taken FROM k4),
s4 AS (SELECT seq, entity_id, label, budget, chosen OR (w AND rk < budget - taken) AS chosen FROM t4),
t5 AS (SELECT *, count(*) FILTER (NOT chosen) OVER (ORDER BY seq) - 1 AS rk, count(*) FILTER (chosen) OVER () AS taken FROM s4)
SELECT seq, entity_id, label FROM t5 WHERE chosen OR rk < budget - taken"""


# --- scenes and shapes ----------------------------------------------------------------------------------------------


def scene_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.scene_collisions(*adapters.scene(spark, sf_dir)).select("collision_id", "link_id", "model_id", "scoped_name")


SCENE_JOIN = "SELECT s_suppkey AS collision_id, n_nationkey AS link_id, r_regionkey AS model_id, concat_ws('::', r_name, n_name, s_name) AS scoped_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def entity_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = adapters.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_key"))
    return shapes.entity_delta(keys.where(F.col("entity_key") % 2 == 0), keys.where(F.col("entity_key") % 3 != 0))


ENTITY_DELTA = "SELECT s_suppkey AS entity_key, 'added' AS change FROM supplier WHERE s_suppkey % 2 = 0 AND NOT s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey, 'removed' FROM supplier WHERE s_suppkey % 3 <> 0 AND NOT s_suppkey % 2 = 0"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = adapters.table(spark, sf_dir, "part")
    size = F.col("p_size")
    return t.select("p_partkey", (size % 5 * 0.3 + 0.2).alias("size_x"), (size % 3 * 0.4 + 0.3).alias("size_y"), (size % 2 * 0.5 + 0.25).alias("size_z"), (size % 4 * 0.1 + 0.1).alias("radius"), (size % 3 * 0.4 + 0.3).alias("length"), F.lit(0.0).alias("normal_x"), ((size % 3) * 0.5).alias("normal_y"), F.lit(1.0).alias("normal_z"))


_PARTS = "SELECT p_partkey, p_size % 5 * CAST(0.3 AS DOUBLE) + CAST(0.2 AS DOUBLE) AS size_x, p_size % 3 * CAST(0.4 AS DOUBLE) + CAST(0.3 AS DOUBLE) AS size_y, p_size % 2 * CAST(0.5 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS size_z, p_size % 4 * CAST(0.1 AS DOUBLE) + CAST(0.1 AS DOUBLE) AS radius, p_size % 3 * CAST(0.4 AS DOUBLE) + CAST(0.3 AS DOUBLE) AS length, (p_size % 3) * CAST(0.5 AS DOUBLE) AS normal_y FROM part"


def _summed(points: DataFrame) -> DataFrame:
    return points.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("points"), *[r4(F.sum(d(a) * d(a)), f"square_{a}", 3) for a in AXES])


_SUMMED = "SELECT p_partkey, count(*) AS points, " + ", ".join(f"round(sum(CAST({a} AS DOUBLE) * CAST({a} AS DOUBLE)), 3) AS square_{a}" for a in AXES) + " FROM pts GROUP BY 1"


def box_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(shapes.sample_box(_parts(spark, sf_dir), 0.25, ["p_partkey"]))


def _face_sql(u: str, v: str, w: str) -> str:
    at = {u: f"size_{u} * i / nu - size_{u} * 0.5", v: f"size_{v} * j / nv - size_{v} * 0.5", w: f"size_{w} * s"}
    return f"SELECT p_partkey, {', '.join(f'CAST({at[a]} AS FLOAT) AS {a}' for a in AXES)} FROM (SELECT *, greatest(1, CAST(ceil(size_{u} / 0.25) AS BIGINT)) AS nu, greatest(1, CAST(ceil(size_{v} / 0.25) AS BIGINT)) AS nv FROM parts), unnest(range(nu + 1)) AS a(i), unnest(range(nv + 1)) AS b(j), (VALUES (-0.5), (0.5)) AS c(s)"


BOX_SAMPLES = f"WITH parts AS ({_PARTS}), pts AS ({' UNION ALL '.join(_face_sql(*f) for f in (('x', 'y', 'z'), ('x', 'z', 'y'), ('y', 'z', 'x')))}) {_SUMMED}"


def sphere_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(shapes.sample_sphere(_parts(spark, sf_dir), 0.1, ["p_partkey"]))


SPHERE_SAMPLES = f"""WITH parts AS ({_PARTS}), s AS (SELECT *, greatest(32, CAST(ceil(radius * radius * (4.0 * pi()) / (CAST(0.1 AS DOUBLE) * CAST(0.1 AS DOUBLE))) AS BIGINT)) AS n FROM parts),
g AS (SELECT *, 1.0 - (i * 2.0::DOUBLE + 1.0) / n AS up, i * (pi() * (3.0 - sqrt(5.0::DOUBLE))) AS t FROM s, unnest(range(n)) AS a(i)),
pts AS (SELECT p_partkey, CAST(radius * sqrt(greatest(0.0, 1.0 - up * up)) * cos(t) AS FLOAT) AS x, CAST(radius * sqrt(greatest(0.0, 1.0 - up * up)) * sin(t) AS FLOAT) AS y, CAST(radius * up AS FLOAT) AS z FROM g) {_SUMMED}"""


def cylinder_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(shapes.sample_cylinder(_parts(spark, sf_dir), 0.1, ["p_partkey"]))


CYLINDER_SAMPLES = f"""WITH parts AS ({_PARTS}),
side AS (SELECT p_partkey, radius AS r, length * i / nz - length * 0.5 AS z, 2 * pi() * j / nt AS t FROM (SELECT *, greatest(1, CAST(ceil(length / 0.1::DOUBLE) AS BIGINT)) AS nz, greatest(12, CAST(ceil(radius * (2 * pi()) / 0.1::DOUBLE) AS BIGINT)) AS nt FROM parts), unnest(range(nz + 1)) AS a(i), unnest(range(nt)) AS b(j)),
ring AS (SELECT p_partkey, r, length * s AS z, greatest(8, CAST(ceil(r * (2 * pi()) / 0.1::DOUBLE) AS BIGINT)) AS nt FROM (SELECT *, radius * i / nr AS r FROM (SELECT *, greatest(1, CAST(ceil(radius / 0.1::DOUBLE) AS BIGINT)) AS nr FROM parts), unnest(range(1, nr + 1)) AS a(i)), (VALUES (-0.5), (0.5)) AS c(s)),
every AS (SELECT * FROM side UNION ALL SELECT p_partkey, r, z, 2 * pi() * j / nt FROM ring, unnest(range(nt)) AS b(j) UNION ALL SELECT p_partkey, 0, length * s, 0 FROM parts, (VALUES (-0.5), (0.5)) AS c(s)),
pts AS (SELECT p_partkey, CAST(r * cos(t) AS FLOAT) AS x, CAST(r * sin(t) AS FLOAT) AS y, CAST(z AS FLOAT) AS z FROM every) {_SUMMED}"""


def plane_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(shapes.sample_plane(_parts(spark, sf_dir), 0.25, ["p_partkey"]))


# the normal lies in the plane of y and z: a turn about the x axis
PLANE_SAMPLES = f"""WITH parts AS ({_PARTS}), g AS (SELECT *, size_x * i / nu - size_x * 0.5 AS u, size_y * j / nv - size_y * 0.5 AS v, sqrt(normal_y * normal_y + 1.0) AS len FROM (SELECT *, greatest(1, CAST(ceil(size_x / 0.25) AS BIGINT)) AS nu, greatest(1, CAST(ceil(size_y / 0.25) AS BIGINT)) AS nv FROM parts), unnest(range(nu + 1)) AS a(i), unnest(range(nv + 1)) AS b(j)),
pts AS (SELECT p_partkey, CAST(u AS FLOAT) AS x, CAST(v / len AS FLOAT) AS y, CAST(-v * normal_y / len AS FLOAT) AS z FROM g) {_SUMMED}"""


def triangle_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = adapters.table(spark, sf_dir, "part")
    s = F.col("p_size")
    corners = [F.lit(0.0).alias(f"a{k}") for k in AXES] + [(s % 5 * 0.3).alias("bx"), F.lit(0.5).alias("by"), F.lit(0.0).alias("bz"), F.lit(0.0).alias("cx"), (s % 4 * 0.4).alias("cy"), F.lit(1.0).alias("cz")]
    return _summed(shapes.sample_triangles(t.select("p_partkey", *corners), 0.25, ["p_partkey"]))


TRIANGLE_SAMPLES = f"""WITH t AS (SELECT p_partkey, p_size % 5 * CAST(0.3 AS DOUBLE) AS bx, 0.5::DOUBLE AS by_, p_size % 4 * CAST(0.4 AS DOUBLE) AS cy FROM part),
l AS (SELECT *, greatest(sqrt(bx * bx + by_ * by_), sqrt(cy * cy + 1.0), sqrt(bx * bx + (cy - by_) * (cy - by_) + 1.0)) AS longest FROM t),
g AS (SELECT *, CAST(i AS DOUBLE) / n AS u, CAST(j AS DOUBLE) / n AS v FROM (SELECT *, greatest(1, CAST(ceil(longest / 0.25::DOUBLE) AS BIGINT)) AS n FROM l), unnest(range(n + 1)) AS a(i), unnest(range(n - i + 1)) AS b(j)),
pts AS (SELECT p_partkey, CAST(u * bx AS FLOAT) AS x, CAST(u * by_ + v * cy AS FLOAT) AS y, CAST(v AS FLOAT) AS z FROM g) {_SUMMED}"""


def world_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = adapters.embedding_cloud(spark, sf_dir)
    poses = spark.range(50).select(F.col("id").alias("entity_id"), F.cos(F.col("id") * 0.05).alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(F.col("id") * 0.05).alias("qz"), (F.col("id") * 0.5).alias("tx"), F.lit(1.0).alias("ty"), (F.col("id") % 3 * 1.0).alias("tz"))
    out = ingest.to_world(cloud.select("vec_id", "entity_id", *AXES), poses)
    return out.select("vec_id", *[r4(a, a, 3) for a in AXES])


WORLD_POINTS = f"""WITH p AS (SELECT id AS vec_id, entity_id AS e, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, 2 * (entity_id * CAST(0.05 AS DOUBLE)) AS t FROM ({EMBEDDINGS}))
SELECT vec_id, round(CAST(CAST(x * cos(t) - y * sin(t) + e * 0.5 AS FLOAT) AS DOUBLE), 3) AS x, round(CAST(CAST(x * sin(t) + y * cos(t) + 1.0 AS FLOAT) AS DOUBLE), 3) AS y, round(CAST(CAST(z + e % 3 AS FLOAT) AS DOUBLE), 3) AS z FROM p"""


# --- updates and throttles ------------------------------------------------------------------------------------------


def dynamic_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = adapters.table(spark, sf_dir, "events")
    leaf = (F.col("user_id") % 97).alias("leaf")
    said = (F.col("event_id") % 13 == 0).alias("has_semantics")
    hits = t.select(leaf, F.col("event_id").alias("seq"), said, (F.col("event_id") % 3).cast("int").alias("label"), (F.col("event_id") % 4).cast("int").alias("room_id"), (F.col("event_id") % 10 / 10.0).alias("probability"))
    start = spark.range(100).select(F.col("id").alias("leaf"), (F.col("id") % 20).alias("n"), F.lit(0).alias("label"), F.lit(0).alias("room_id"), F.lit(0.9).alias("probability"), F.lit(False).alias("is_cross_floor"))
    out = state.update_leaves(start, hits)
    return out.select("leaf", "n", "label", "room_id", r4("probability", "probability"), "is_cross_floor", "dynamic")


DYNAMIC_UPDATE = """WITH h AS (SELECT user_id % 97 AS leaf, event_id AS seq, event_id % 13 = 0 AS s, CAST(event_id % 3 AS INTEGER) AS label, CAST(event_id % 4 AS INTEGER) AS room_id, CAST(event_id % 10 AS DOUBLE) / 10.0 AS p FROM events),
g AS (SELECT leaf, count(*) AS hits, max(seq) FILTER (s) AS at FROM h GROUP BY 1),
l AS (SELECT h.leaf, h.label, h.room_id, h.p FROM h JOIN g ON h.leaf = g.leaf AND h.seq = g.at),
a AS (SELECT h.leaf, count(*) AS plain FROM h JOIN g USING (leaf) WHERE g.at IS NULL OR h.seq > g.at GROUP BY 1),
st AS (SELECT i AS leaf, i % 20 AS n FROM unnest(range(100)) AS t(i))
SELECT st.leaf, st.n + coalesce(hits, 0) AS n, coalesce(l.label, 0) AS label, coalesce(l.room_id, 0) AS room_id, round(CASE WHEN plain > 0 THEN greatest(coalesce(l.p, 0.9::DOUBLE) * pow(0.8::DOUBLE, plain), 0.35::DOUBLE) ELSE coalesce(l.p, 0.9::DOUBLE) END, 4) AS probability, coalesce(l.label = 2, false) AS is_cross_floor, g.leaf IS NOT NULL AS dynamic
FROM st LEFT JOIN g USING (leaf) LEFT JOIN l USING (leaf) LEFT JOIN a USING (leaf)"""


def publish_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = adapters.table(spark, sf_dir, "events").select("event_type", "ts", "event_id")
    return state.throttle(events, "event_type", 7200.0).select("event_type", "event_id")


PUBLISH_THROTTLE = """WITH RECURSIVE e AS MATERIALIZED (SELECT event_type, ts, event_id FROM events),
c AS (SELECT event_type, min(struct_pack(ts := ts, event_id := event_id)) AS x FROM e GROUP BY 1
 UNION ALL SELECT event_type, y FROM (SELECT c.event_type, (SELECT min(struct_pack(ts := e.ts, event_id := e.event_id)) FROM e WHERE e.event_type = c.event_type AND e.ts >= c.x.ts + INTERVAL 7200 SECOND) AS y FROM c) WHERE y IS NOT NULL)
SELECT event_type, x.event_id AS event_id FROM c"""


def tumbling_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = adapters.table(spark, sf_dir, "events").select("event_type", "ts", "event_id")
    return state.tumbling_first(events, "event_type", "1 hour").select("event_type", "event_id")


TUMBLING_FIRST = "SELECT event_type, min_by(event_id, struct_pack(ts := ts, event_id := event_id)) AS event_id FROM events GROUP BY event_type, time_bucket(INTERVAL 1 HOUR, ts)"


def latest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = state.latest_frame(adapters.lineitem_cloud(spark, sf_dir))
    return out.groupBy("frame_id", "label").agg(F.count(F.lit(1)).alias("points"))


LATEST_FRAME = f"WITH p AS ({LINEITEM}) SELECT frame_id, label, count(*) AS points FROM p WHERE frame_id = (SELECT max(frame_id) FROM p) GROUP BY 1, 2"


def entity_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = adapters.table(spark, sf_dir, "events")
    live = events.select(F.floor(F.col("event_id") / 200).alias("batch"), (F.col("user_id") % 60).alias("entity_key"))
    return state.entity_batches(live)


ENTITY_BATCHES = """WITH s AS (SELECT DISTINCT event_id // 200 AS batch, user_id % 60 AS entity_key FROM events), g AS (SELECT batch + 1 AS batch, entity_key FROM s)
SELECT batch, entity_key, 'added' AS change FROM (SELECT * FROM s EXCEPT SELECT * FROM g) UNION ALL SELECT batch, entity_key, 'removed' FROM (SELECT * FROM g EXCEPT SELECT * FROM s) WHERE batch <= (SELECT max(batch) FROM s)"""

NAMES = ["root_bounds", "stride_sample", "linspace_sample", "semantic_rule", "normalised_samples", "label_votes", "octant_counts", "octree_levels", "octree_leaves", "leaf_numbers", "empty_roots", "morton_codes", "point_in_leaf", "leaf_features", "weak_labels", "pca_leaves", "cloud_extents", "quota_sample", "scene_join", "entity_delta", "box_samples", "sphere_samples", "cylinder_samples", "plane_samples", "triangle_samples", "world_points", "dynamic_update", "publish_throttle", "tumbling_first", "latest_frame", "entity_batches"]
QUERIES = {n: globals()[n] for n in NAMES}
SQL = {n: globals()[n.upper()] for n in NAMES if n.upper() in globals()}
