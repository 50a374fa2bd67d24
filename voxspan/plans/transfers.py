"""Queries that go through files, frames, models and streams and back, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FeatureConfig, OctreeConfig, PlannerConfig, from_names, parse_point
from ..functions.components import shared_path, written
from ..functions.geometry import AXES, d
from ..operators import features, forest, graph, neighbors, octree, report, view
from ..sources import adapters, files, packed, shapes
from ..streaming import jobs, state
from .clouds import _PARTS, _SHAPED, _SUMMED, BOX_SAMPLES, CYLINDER_SAMPLES, EMBEDDINGS, LINEITEM, PLANE_SAMPLES, SHALLOW, SPHERE_SAMPLES, _parts, _shaped, _summed, octree_sql, r4, roots_sql
from .reports import RUNS, SMALL_FOREST, SUMMARY

CFG = OctreeConfig()

# --- packed frames --------------------------------------------------------------------------------------------------


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five packed frames of the small cloud, in order of vec_id."""
    cloud = adapters.embedding_cloud(spark, sf_dir)
    return packed.encode_packed(cloud.withColumn("frame_id", (F.col("vec_id") % 5).cast("long")).withColumn("seq", F.col("vec_id")))


_PLACED = f"SELECT *, id % 5 AS frame, row_number() OVER (PARTITION BY id % 5 ORDER BY id) - 1 AS seq, count(*) OVER (PARTITION BY id % 5) AS n FROM ({EMBEDDINGS})"


def packed_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packed.decode_packed(_packed(spark, sf_dir), max_points=60)
    return out.select("frame_id", "seq", "source_points", *[r4(a, a) for a in AXES], "entity_id", "room_id", "label", r4("probability", "probability"), "has_semantics", "is_cross_floor")


PACKED_DECODE = f"SELECT frame AS frame_id, seq, n AS source_points, {', '.join(f'round(CAST({a} AS DOUBLE), 4) AS {a}' for a in AXES)}, entity_id, 0 AS room_id, label, round(CAST(probability AS DOUBLE), 4) AS probability, true AS has_semantics, label = 2 AS is_cross_floor FROM ({_PLACED}) WHERE seq % CAST(ceil(n / 60.0) AS BIGINT) = 0"


def packed_xyz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with one field for all coordinates and some that are not finite, which go before the choice of points."""
    cloud = adapters.embedding_cloud(spark, sf_dir)
    x = F.when(F.col("vec_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("x")).cast("float")
    frames = packed.encode_packed(cloud.withColumn("x", x).withColumn("frame_id", (F.col("vec_id") % 5).cast("long")).withColumn("seq", F.col("vec_id")))
    one = F.array(F.struct(F.lit("xyz").alias("name"), F.lit(0).alias("offset"), F.lit("FLOAT32").alias("datatype")))
    out = packed.decode_packed(frames.withColumn("fields", one), max_points=40, finite_first=True)
    return out.select("frame_id", "seq", *[r4(a, a) for a in AXES], "has_semantics", "label")


PACKED_XYZ = f"""WITH p AS ({_PLACED}), f AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY seq) - 1 AS k, count(*) OVER (PARTITION BY frame) AS m FROM p WHERE id % 7 <> 0)
SELECT frame AS frame_id, seq, {', '.join(f'round(CAST({a} AS DOUBLE), 4) AS {a}' for a in AXES)}, false AS has_semantics, 0 AS label FROM f WHERE k % CAST(ceil(m / 40.0) AS BIGINT) = 0"""


def point_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = adapters.with_defaults(adapters.event_frames(spark, sf_dir).select("frame_id", *AXES))
    return points.groupBy("entity_id", "room_id", "label", "has_semantics", "is_cross_floor").agg(F.count(F.lit(1)).alias("points"), r4(F.max(d("probability")), "probability"))


POINT_SAMPLES = "SELECT CAST(0 AS BIGINT) AS entity_id, 0 AS room_id, 0 AS label, false AS has_semantics, false AS is_cross_floor, count(*) AS points, 0.0::DOUBLE AS probability FROM events"


def demo_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.demo_grid(spark).select(*[r4(a, a) for a in AXES])


DEMO_GRID = "SELECT CAST(i % 10 AS DOUBLE) AS x, CAST(i // 10 AS DOUBLE) AS y, 1.0::DOUBLE AS z FROM unnest(range(100)) AS t(i)"


def pcd_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = files.pcd_files(adapters.lineitem_cloud(spark, sf_dir))
    text = F.substring_index(F.decode("content", "ISO-8859-1"), "DATA binary\n", 1)
    return out.select("frame_id", F.length("content").cast("long").alias("bytes"), text.alias("head"))


PCD_FILES = f"""WITH c AS (SELECT frame_id, count(*) AS n FROM ({LINEITEM}) GROUP BY 1), h AS (SELECT *, concat('# .PCD v0.7 - Point Cloud Data file format', chr(10), 'VERSION 0.7', chr(10), 'FIELDS x y z', chr(10), 'SIZE 4 4 4', chr(10), 'TYPE F F F', chr(10), 'COUNT 1 1 1', chr(10), 'WIDTH ', n, chr(10), 'HEIGHT 1', chr(10), 'VIEWPOINT 0 0 0 1 0 0 0', chr(10), 'POINTS ', n, chr(10)) AS head FROM c)
SELECT frame_id, length(head) + 12 + 12 * n AS bytes, head FROM h"""

# --- feature files --------------------------------------------------------------------------------------------------

_NUMBERS = ["center_x", "center_y", "center_z", "density", "obstacle_probability"]


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows of the small cloud with a number for each leaf."""
    tree = graph.with_leaf_id(_shaped(spark, sf_dir), CFG).withColumn("node_index", F.col("leaf_id").cast("int"))
    return features.leaf_features(tree)


def feature_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf features written as CSV, read back as text, and the inputs among the columns."""
    path = shared_path(spark, "features")
    files.write_features(_indexed(spark, sf_dir), path)
    back = files.read_features(spark, path)
    rows = forest.training_rows(back, _NUMBERS[:-1])
    inputs = len(files.feature_columns_of(back.columns, set(features.NOT_INPUTS) | {"source_file"}))
    return rows.groupBy(F.col("depth").cast("int").alias("depth")).agg(F.count(F.lit(1)).alias("rows"), F.count_if("valid").alias("valid_rows"), F.lit(inputs).alias("inputs"), *[r4(F.sum(d(c)), f"sum_{c}", 2) for c in _NUMBERS])


_IN_FILE = {"center_x": "cx", "center_y": "cy", "center_z": "cz", "density": "n / greatest(1e-6, dx * dy * dz)", "obstacle_probability": "greatest(0.0, least(1.0, CAST(probability AS DOUBLE)))"}
FEATURE_FILE = _SHAPED + f"SELECT depth, count(*) AS rows, count(*) AS valid_rows, {len(forest.INPUTS)} AS inputs, " + ", ".join(f"round(sum(round({e}, 6)), 2) AS sum_{c}" for c, e in _IN_FILE.items()) + " FROM shaped GROUP BY depth"


def weak_feature_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training file with weak labels: written under its name for a frame, and counted by label."""
    base = files.output_path(f"{shared_path(spark, 'weak')}/leaves.csv", frame=3, train=True)
    files.write_features(features.leaf_features(features.weak_labels(graph.with_leaf_id(_shaped(spark, sf_dir), CFG)).withColumn("node_index", F.col("leaf_id").cast("int"))), base)
    back = files.read_features(spark, base)
    named = F.regexp_extract("source_file", r"(train_leaves_frame\d+\.csv)", 1)
    return back.groupBy(F.col("label").cast("int").alias("label"), named.alias("file")).agg(F.count(F.lit(1)).alias("rows"), r4(F.sum(d("obstacle_probability")), "sum_probability", 2))


WEAK_FEATURE_FILE = _SHAPED + """, w AS (SELECT *, CASE WHEN sqrt(nx * nx + ny * ny + nz * nz) > 1e-6 THEN abs(nz) / sqrt(nx * nx + ny * ny + nz * nz) ELSE 0.0 END AS up, cz - floor(cz / 4.0) * 4.0 AS loc FROM shaped),
v AS (SELECT CASE WHEN n >= 3 AND abs(loc - 1.0) <= 0.35 AND up >= cos(0.30::DOUBLE) AND flatness >= 0.35 THEN 0 WHEN n >= 3 AND loc - 1.0 >= 0.08 AND loc <= 4.0 AND acos(up) BETWEEN 0.25 AND 0.90 AND flatness >= 0.25 THEN 2 WHEN n >= 3 AND loc - 1.0 > 0.35 THEN 11 WHEN n >= 3 THEN 12 ELSE 13 END AS k, up FROM w)
SELECT CASE WHEN k > 2 THEN 1 ELSE k END AS label, 'train_leaves_frame000003.csv' AS file, count(*) AS rows, round(sum(CASE WHEN k = 0 THEN 0.05::DOUBLE WHEN k = 2 THEN 0.25::DOUBLE WHEN k = 11 AND up < 0.45 THEN 0.90::DOUBLE WHEN k = 11 THEN 0.75::DOUBLE WHEN k = 12 THEN 0.65::DOUBLE ELSE 0.50::DOUBLE END), 2) AS sum_probability FROM v GROUP BY 1"""


def external_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(_indexed(spark, sf_dir), "features")
    labels = rows.select("node_index", (F.col("node_index") % 3).alias("label"), (F.col("node_index") % 8 / 8.0).alias("obstacle_probability"))
    out = files.with_external_labels(rows, labels)
    return out.select("node_index", "label", r4("obstacle_probability", "obstacle_probability"), r4("center_z", "center_z", 3))


EXTERNAL_LABELS = octree_sql(EMBEDDINGS, CFG) + "SELECT CAST(leaf_id AS INTEGER) AS node_index, CAST(leaf_id % 3 AS INTEGER) AS label, leaf_id % 8 / 8.0::DOUBLE AS obstacle_probability, round(cz, 3) AS center_z FROM leaf"


def prediction_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a folder's files are predicted, in order."""
    t = adapters.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    name = F.concat(F.lit("data/"), F.when(k % 5 == 0, "train_").when(k % 7 == 0, "predicted_").otherwise(""), F.lit("leaves"), F.lpad(k.cast("string"), 6, "0"), F.when(k % 11 == 0, ".txt").otherwise(".csv"))
    names = t.select(name.alias("name"))
    return files.prediction_listing(names, names.where(F.col("name").endswith("3.csv")))


PREDICTION_LISTING = """WITH n AS (SELECT concat('data/', CASE WHEN p_partkey % 5 = 0 THEN 'train_' WHEN p_partkey % 7 = 0 THEN 'predicted_' ELSE '' END, 'leaves', lpad(CAST(p_partkey AS VARCHAR), 6, '0'), CASE WHEN p_partkey % 11 = 0 THEN '.txt' ELSE '.csv' END) AS name FROM part)
SELECT row_number() OVER (ORDER BY name) - 1 AS at, name FROM n WHERE name LIKE '%.csv' AND name NOT LIKE '%3.csv' AND name NOT LIKE 'data/train%' AND name NOT LIKE 'data/predicted%'"""


def feature_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features in the order a model names them; a name that is not known counts as 0."""
    rows = _indexed(spark, sf_dir)
    x = features.feature_vector(rows, ["center_z", "no_such_feature", "num_points", "depth"])
    return rows.select("node_index", *[r4(x[i], f"x{i}", 3) for i in range(4)])


FEATURE_INPUTS = octree_sql(EMBEDDINGS, CFG) + "SELECT CAST(leaf_id AS INTEGER) AS node_index, round(cz, 3) AS x0, 0.0::DOUBLE AS x1, CAST(n AS DOUBLE) AS x2, CAST(depth AS DOUBLE) AS x3 FROM leaf"

# --- models and predictions -----------------------------------------------------------------------------------------


def forest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest with a tree for each nation and each region, through its text form."""
    n = F.col("k")
    nation = adapters.table(spark, sf_dir, "nation").select(F.lit("classifier").alias("forest"), F.col("n_nationkey").alias("k"))
    region = adapters.table(spark, sf_dir, "region").select(F.lit("regressor").alias("forest"), F.col("r_regionkey").alias("k"))
    none = F.array().cast("array<float>")
    share = F.when(F.col("forest") == "classifier", F.array(n / 32.0, F.lit(0.5), F.lit(0.5) - n / 64.0)).otherwise(F.array(n / 8.0))
    rest = F.when(F.col("forest") == "classifier", F.array(F.lit(0.25), n / 64.0, F.lit(0.125))).otherwise(F.array(n / 16.0))

    def node(i, left, right, feature, threshold, values):
        return F.struct(F.lit(i).alias("node"), F.lit(left).alias("left"), F.lit(right).alias("right"), feature.cast("int").alias("feature"), threshold.cast("float").alias("threshold"), values.cast("array<float>").alias("values"))

    three = F.array(node(0, 1, 2, n % 4, n * 0.5, none), node(1, -1, -1, F.lit(-1), F.lit(0.0), share), node(2, -1, -1, F.lit(-1), F.lit(0.0), rest))
    table = nation.unionByName(region).select("forest", F.col("k").cast("int").alias("tree"), F.explode(three).alias("x")).select("forest", "tree", "x.*")
    path = shared_path(spark, "forest")
    files.write_forest(table, ["a", "b", "c", "d"], path)
    inputs, back = files.read_forest(spark, path)
    return back.select("forest", "tree", "node", "left", "right", "feature", r4("threshold", "threshold"), F.round(F.aggregate("values", F.lit(0.0), lambda s, v: s + v.cast("double")), 4).alias("mass"), F.lit(",".join(inputs)).alias("inputs"))


FOREST_TEXT = """WITH t AS (SELECT 'classifier' AS forest, n_nationkey AS k FROM nation UNION ALL SELECT 'regressor', r_regionkey FROM region)
SELECT forest, k AS tree, node, CASE node WHEN 0 THEN 1 ELSE -1 END AS "left", CASE node WHEN 0 THEN 2 ELSE -1 END AS "right", CASE node WHEN 0 THEN CAST(k % 4 AS INTEGER) ELSE -1 END AS feature, CASE node WHEN 0 THEN k * 0.5::DOUBLE ELSE 0.0 END AS threshold,
 round(CASE WHEN node = 0 THEN 0.0::DOUBLE WHEN forest = 'classifier' AND node = 1 THEN k / 32.0 + 1.0 - k / 64.0 WHEN forest = 'classifier' THEN 0.375 + k / 64.0 WHEN node = 1 THEN k / 8.0 ELSE k / 16.0 END, 4) AS mass, 'a,b,c,d' AS inputs FROM t, unnest([0, 1, 2]) AS u(node)"""


def forest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.facts(spark.createDataFrame(SMALL_FOREST, forest.FOREST_SCHEMA))


FOREST_FACTS = "SELECT * FROM (VALUES ('classifier', CAST(2 AS BIGINT), CAST(8 AS BIGINT), CAST(5 AS BIGINT), 1), ('regressor', 1, 3, 2, 0)) AS t(forest, trees, nodes, leaves, highest_feature)"


def predicted_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for text rows, some with inputs that are no numbers, written as CSV and read back."""
    t = adapters.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    rows = t.select("o_orderkey", F.when(k % 9 == 0, "n/a").when(k % 10 == 0, "").otherwise(F.col("o_totalprice").cast("string")).alias("a"), F.dayofmonth("o_orderdate").cast("string").alias("b"))
    path = shared_path(spark, "predicted")
    forest.predict_rows(rows, SMALL_FOREST, ["a", "b"]).write.option("header", True).csv(path)
    back = spark.read.option("header", True).csv(path)
    return back.groupBy(F.col("predicted_label").cast("int").alias("predicted_label"), F.col("predicted_obstacle_probability").cast("double").alias("predicted_obstacle_probability")).agg(F.count(F.lit(1)).alias("rows"), F.count("a").alias("with_text"))


PREDICTED_FILE = """WITH x AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN 1 WHEN o_orderkey % 10 = 0 THEN 2 ELSE 0 END AS bad, CAST(o_totalprice AS FLOAT) AS a, day(o_orderdate) AS b FROM orders),
v AS (SELECT bad, CASE WHEN a <= 150000 THEN [0.7, 0.2, 0.1] WHEN b <= 15 THEN [0.1, 0.8, 0.1] ELSE [0.2, 0.2, 0.6] END AS t0, CASE WHEN b <= 10 THEN [0.5, 0.25, 0.25] ELSE [0.25, 0.25, 0.5] END AS t1, CASE WHEN a <= 90000 THEN 0.125::DOUBLE ELSE 0.75::DOUBLE END AS p FROM x),
s AS (SELECT bad, t0[1] + t1[1] AS a, t0[2] + t1[2] AS b, t0[3] + t1[3] AS c, p FROM v)
SELECT CASE WHEN bad > 0 THEN NULL WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS predicted_label, CASE WHEN bad = 0 THEN p END AS predicted_obstacle_probability, count(*) AS rows, count(*) FILTER (bad < 2) AS with_text FROM s GROUP BY 1, 2"""


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = adapters.lineitem_cloud(spark, sf_dir)
    out = forest.split_rows(cloud.where("label <> 1 or entity_id % 3 = 0"), 0.2, ["x", "y", "z", "entity_id"])
    return out.groupBy("label", "test").agg(F.count(F.lit(1)).alias("rows"))


STRATIFIED_SPLIT = f"""WITH c AS (SELECT label, count(*) AS n FROM ({LINEITEM}) WHERE label <> 1 OR entity_id % 3 = 0 GROUP BY 1), e AS (SELECT *, ceil(sum(n) OVER () * 0.2::DOUBLE) AS t, n * ceil(sum(n) OVER () * 0.2::DOUBLE) / sum(n) OVER () AS x FROM c),
q AS (SELECT label, n, CAST(floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, label) <= t - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS k FROM e)
SELECT label, true AS test, k AS rows FROM q UNION ALL SELECT label, false, n - k FROM q"""


def top_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = adapters.table(spark, sf_dir, "part")
    rows = t.select(F.when(F.col("p_partkey") % 2 == 0, "classifier").otherwise("regressor").alias("forest"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("feature"), (F.col("p_partkey") % 40 / 80.0).alias("importance"))
    return forest.top_inputs(rows).select("forest", "feature", r4("importance", "importance"))


TOP_INPUTS = "SELECT forest, feature, round(importance, 4) AS importance FROM (SELECT *, row_number() OVER (PARTITION BY forest ORDER BY importance DESC, feature) AS k FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'classifier' ELSE 'regressor' END AS forest, concat('f', p_partkey) AS feature, p_partkey % 40 / 80.0::DOUBLE AS importance FROM part)) WHERE k <= 15"

# --- runs and reports -----------------------------------------------------------------------------------------------


def runs_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs appended in two lots, with texts that need quotes, and read back."""
    runs = adapters.benchmark_rows(spark, sf_dir).withColumn("message", F.concat(F.lit('said "'), F.col("frame").cast("string"), F.lit('", twice')))
    path = shared_path(spark, "runs")
    for part in (0, 1):
        files.append_runs(runs.where(F.col("frame") % 2 == part), path)
    back = files.read_runs(spark, path)
    return back.groupBy("mode", "path_success").agg(F.count(F.lit(1)).alias("rows"), F.sum("frame").alias("frames"), r4(F.sum("plan_ms"), "plan_ms", 2), F.sum(F.length("message")).cast("long").alias("text"))


RUNS_FILE = f"SELECT mode, path_success, count(*) AS rows, CAST(sum(frame) AS BIGINT) AS frames, round(sum(plan_ms), 2) AS plan_ms, CAST(sum(length(concat('said \"', frame, '\", twice'))) AS BIGINT) AS text FROM ({RUNS}) GROUP BY 1, 2"


def summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "summary")
    files.write_summary(report.bench_summary(adapters.benchmark_rows(spark, sf_dir)), path)
    back = spark.read.schema("modes map<string,struct<frames:long,mean_plan_ms:double,raw_pointcloud_kb:double>>, assumptions struct<raw_point_bytes:double,point_graph_bytes:double>").json(path)
    return back.select(F.explode("modes").alias("mode", "s"), "assumptions.*").select("mode", "s.frames", r4("s.mean_plan_ms", "mean_plan_ms", 3), r4("s.raw_pointcloud_kb", "raw_pointcloud_kb", 3), "raw_point_bytes", "point_graph_bytes")


SUMMARY_JSON = SUMMARY + " SELECT mode, frames, round(mean_plan_ms, 3) AS mean_plan_ms, round(raw_pointcloud_kb, 3) AS raw_pointcloud_kb, 24.0::DOUBLE AS raw_point_bytes, 96.0::DOUBLE AS point_graph_bytes FROM summary"


def markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.markdown(report.bench_comparison(report.bench_summary(adapters.benchmark_rows(spark, sf_dir))).where(F.col("metric").isin("mean_plan_ms", "planning_hz")))
    return spark.createDataFrame(list(enumerate(out.splitlines())), "at long, line string")


MARKDOWN_LINES = SUMMARY + """, m AS (SELECT 'mean_plan_ms' AS metric, max(mean_plan_ms) FILTER (mode = 'semantic_octree_astar') AS b, max(mean_plan_ms) FILTER (mode = 'rf_octree_astar') AS o, false AS rate FROM summary UNION ALL SELECT 'planning_hz', max(planning_hz) FILTER (mode = 'semantic_octree_astar'), max(planning_hz) FILTER (mode = 'rf_octree_astar'), true FROM summary)
SELECT CAST(0 AS BIGINT) AS at, '| metric | base | other | change | speedup |' AS line UNION ALL SELECT 1, '|---|---|---|---|---|'
UNION ALL SELECT CASE WHEN rate THEN 3 ELSE 2 END, concat('| ', metric, printf(' | %.2f | %.2f | %+.2f%% | ', b, o, CASE WHEN rate THEN o - b ELSE b - o END / b * 100.0), CASE WHEN rate THEN 'N/A' ELSE printf('%.2fx', b / o) END, ' |') FROM m"""


def first_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.first_frames(adapters.lineitem_cloud(spark, sf_dir), 3).groupBy("frame_id").agg(F.count(F.lit(1)).alias("points"))


FIRST_FRAMES = f"SELECT frame_id, count(*) AS points FROM ({LINEITEM}) GROUP BY 1 ORDER BY 1 LIMIT 3"


def named_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = {"PATH_BLOCK_PROBABILITY": "0.8", "PATH_VERTICAL_WEIGHT": "2", "FEATURE_STORY_HEIGHT": "3.5", "NOT_KNOWN": "1"}
    plan, feature = from_names(PlannerConfig, given), from_names(FeatureConfig, given)
    points = {t: parse_point(t) for t in ("1,2,3.5", "1,2", "a,b,c", " 4, -5,6e1")}
    rows = [("obstacle_block_probability", plan.obstacle_block_probability), ("vertical_weight", plan.vertical_weight), ("probability_weight", plan.probability_weight), ("plan_story_height", plan.story_height), ("feature_story_height", feature.story_height), ("feature_floor_z", feature.floor_z)]
    rows += [(f"{t}:{a}", p[i] if p else None) for t, p in points.items() for i, a in enumerate(AXES)]
    return spark.createDataFrame(rows, "name string, value double")


NAMED_SETTINGS = "SELECT * FROM (VALUES ('obstacle_block_probability', 0.8::DOUBLE), ('vertical_weight', 2.0), ('probability_weight', 6.0), ('plan_story_height', 3.5), ('feature_story_height', 3.5), ('feature_floor_z', 0.0), ('1,2,3.5:x', 1.0), ('1,2,3.5:y', 2.0), ('1,2,3.5:z', 3.5), ('1,2:x', NULL), ('1,2:y', NULL), ('1,2:z', NULL), ('a,b,c:x', NULL), ('a,b,c:y', NULL), ('a,b,c:z', NULL), (' 4, -5,6e1:x', 4.0), (' 4, -5,6e1:y', -5.0), (' 4, -5,6e1:z', 60.0)) AS t(name, value)"

# --- shapes ---------------------------------------------------------------------------------------------------------


def _meshes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and indices of a mesh for each region: two triangles over the x axis; one submesh has no indices."""
    r = adapters.table(spark, sf_dir, "region").select(F.concat(F.lit("m"), F.col("r_regionkey").cast("string")).alias("uri"), (F.col("r_regionkey") * 0.5 + 1.0).alias("w"))
    corner = F.array(*[F.struct(F.lit(i).alias("vertex"), x.alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z")) for i, (x, y, z) in enumerate([(F.lit(0.0), 0.0, 0.0), (F.col("w"), 0.0, 0.0), (F.lit(0.0), 1.0, 0.0), (F.lit(0.0), 0.0, 1.0)])])
    vertices = r.withColumn("submesh", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("c", F.explode(corner)).select("uri", "submesh", "c.*")
    indices = r.select("uri", F.lit(0).alias("submesh"), F.posexplode(F.array(*[F.lit(i) for i in (0, 1, 2, 0, 1, 3)])).alias("at", "vertex"))
    return vertices, indices


def _with_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = adapters.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return t.select("p_partkey", F.lit("MESH").alias("geometry_type"), F.when(k % 9 == 0, "gone").when(k % 10 == 0, "").otherwise(F.concat(F.lit("m"), (k % 5).cast("string"))).alias("uri"), F.lit(1.0).alias("scale_x"), (k % 2 + 1.0).alias("scale_y"), F.lit(2.0).alias("scale_z"))


def mesh_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of meshes by file and scale; the submesh without indices takes its vertices three in a row."""
    return _summed(shapes.sample_meshes(_with_mesh(spark, sf_dir), *_meshes(spark, sf_dir), 0.25, ["p_partkey"]))


_MESH_PARTS = "SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN -1 WHEN p_partkey % 10 = 0 THEN -1 ELSE p_partkey % 5 END AS m, p_partkey % 2 + 1.0::DOUBLE AS sy FROM part"
MESH_SAMPLES = f"""WITH p AS ({_MESH_PARTS}), t AS (SELECT p_partkey, r_regionkey * 0.5::DOUBLE + 1.0 AS w, u.y * sy AS cy, u.z * 2.0 AS cz FROM p JOIN region ON m = r_regionkey, (VALUES (1.0::DOUBLE, 0.0::DOUBLE), (0.0, 1.0), (1.0, 0.0)) AS u(y, z)),
g AS (SELECT *, CAST(i AS DOUBLE) / n AS a, CAST(j AS DOUBLE) / n AS b FROM (SELECT *, greatest(1, CAST(ceil(greatest(w, sqrt(cy * cy + cz * cz), sqrt(w * w + cy * cy + cz * cz)) / 0.25::DOUBLE) AS BIGINT)) AS n FROM t), unnest(range(n + 1)) AS x(i), unnest(range(n - i + 1)) AS y(j)),
pts AS (SELECT p_partkey, CAST(a * w AS FLOAT) AS x, CAST(b * cy AS FLOAT) AS y, CAST(b * cz AS FLOAT) AS z FROM g) {_SUMMED}"""


def shape_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by geometry type: every part is one of the five, or of a type that gives none."""
    k = F.col("p_partkey") % 6
    kind = F.when(k == 0, "BOX").when(k == 1, "CYLINDER").when(k == 2, "SPHERE").when(k == 3, "PLANE").when(k == 4, "MESH").otherwise("TORUS")
    rows = _parts(spark, sf_dir).join(_with_mesh(spark, sf_dir).drop("geometry_type"), "p_partkey").withColumn("geometry_type", kind)
    return _summed(shapes.sample_shapes(rows, 0.25, ["p_partkey"], *_meshes(spark, sf_dir)))


def _only(sql: str, parts: str, k: int) -> str:
    # the other samplers' SQL stands at a spacing of 0.1
    return "SELECT * FROM (" + sql.replace(parts, f"{parts} WHERE p_partkey % 6 = {k}").replace("/ 0.1::DOUBLE", "/ 0.25::DOUBLE").replace("(CAST(0.1 AS DOUBLE) * CAST(0.1 AS DOUBLE))", "(CAST(0.25 AS DOUBLE) * CAST(0.25 AS DOUBLE))") + ")"


SHAPE_DISPATCH = " UNION ALL ".join(_only(sql, parts, k) for k, (sql, parts) in enumerate([(BOX_SAMPLES, _PARTS), (CYLINDER_SAMPLES, _PARTS), (SPHERE_SAMPLES, _PARTS), (PLANE_SAMPLES, _PARTS), (MESH_SAMPLES, _MESH_PARTS)]))

# --- labels and updates ---------------------------------------------------------------------------------------------


def leaf_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves relabelled by a rule: those with many points are in the way, high ones are stairs."""
    tree = octree.leaves(adapters.embedding_cloud(spark, sf_dir), CFG)
    label = F.when(F.col("n") > 1, 1).when(F.col("cz") > 0, 2).otherwise(0)
    said = F.struct(label.alias("label"), (F.col("n") * 0.3).alias("probability"), (F.col("depth") % 3).cast("int").alias("room_id"), (F.col("cx") > 0).alias("is_cross_floor"))
    out = neighbors.apply_predictor(tree, said)
    return out.select("depth", "path", "label", r4("probability", "probability"), "room_id", "is_cross_floor")


_RULE = "CASE WHEN n > 1 THEN 1 WHEN cz > 0 THEN 2 ELSE 0 END"
LEAF_PREDICTOR = octree_sql(EMBEDDINGS, CFG) + f"SELECT depth, path, {_RULE} AS label, round(CAST(CAST(least(1.0, n * 0.3::DOUBLE) AS FLOAT) AS DOUBLE), 4) AS probability, CAST(depth % 3 AS INTEGER) AS room_id, (cx > 0 OR {_RULE} = 2) AS is_cross_floor FROM leaf"


def label_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = octree.leaves(adapters.embedding_cloud(spark, sf_dir), CFG)
    given = tree.where(F.col("path") % 3 == 0).select("frame_id", "depth", "path", (F.col("path") % 2 + 1).cast("int").alias("label"), F.lit(0.5).cast("float").alias("probability"), F.lit(9).alias("room_id"), F.lit(False).alias("is_cross_floor"))
    out = neighbors.override_labels(tree, given)
    return out.select("depth", "path", "label", r4("probability", "probability"), "room_id", "is_cross_floor")


LABEL_OVERRIDE = octree_sql(EMBEDDINGS, CFG) + "SELECT depth, path, CASE WHEN path % 3 = 0 THEN CAST(path % 2 + 1 AS INTEGER) ELSE label END AS label, CASE WHEN path % 3 = 0 THEN 0.5::DOUBLE ELSE round(CAST(probability AS DOUBLE), 4) END AS probability, CASE WHEN path % 3 = 0 THEN 9 ELSE room_id END AS room_id, CASE WHEN path % 3 = 0 THEN path % 2 = 1 ELSE is_cross_floor END AS is_cross_floor FROM leaf"


def touched_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.touched(adapters.table(spark, sf_dir, "events").select((F.col("user_id") * F.col("event_id") % 977).alias("leaf")))


TOUCHED_LEAVES = "SELECT DISTINCT user_id * event_id % 977 AS leaf FROM events"


def rebuilt_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which years' trees have to be built anew for points that lie outside."""
    roots = octree.root_bounds(adapters.lineitem_cloud(spark, sf_dir))
    asked = adapters.event_frames(spark, sf_dir).select((F.col("frame_id") % 7 + 1995).cast("int").alias("frame_id"), (F.col("x") + (F.col("frame_id") % 7 == 3).cast("int") * F.lit(50)).cast("float").alias("x"), "y", "z")
    return state.outside_root(asked, roots)


REBUILT_FRAMES = f"""WITH pts AS ({LINEITEM}), roots AS ({roots_sql()}), a AS (SELECT CAST(event_id % 7 + 1995 AS INTEGER) AS frame_id, CAST(CAST((user_id % 40) * CAST(0.25 AS DOUBLE) AS FLOAT) + CASE WHEN event_id % 7 = 3 THEN 50 ELSE 0 END AS FLOAT) AS x, CAST(value % CAST(20.0 AS DOUBLE) AS FLOAT) AS y, CAST(1.0 + 4.0 * (event_id % 3) AS FLOAT) AS z FROM events)
SELECT frame_id, bool_or(NOT ({' AND '.join(f'{a} BETWEEN root_min_{a} AND root_max_{a}' for a in AXES)})) AS rebuilt FROM a JOIN roots USING (frame_id) GROUP BY 1"""

# --- paths ----------------------------------------------------------------------------------------------------------


def smoothed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waypoints on stretches of a grid, with changes of height and label now and then."""
    e = F.col("event_id")
    t = adapters.table(spark, sf_dir, "events").select((e % 50).alias("path_id"), F.floor(e / 50).alias("at"))
    turn = (F.col("at") / 7).cast("long") % 2
    x = F.when(turn == 0, F.col("at") * 0.5).otherwise(0.0)
    y = F.when(turn == 1, F.col("at") * 0.5).otherwise(0.0)
    points = t.select("path_id", "at", F.struct(F.col("at").alias("leaf_id"), x.alias("x"), y.alias("y"), F.when(F.col("at") % 23 == 5, 1.5).otherwise(1.0).alias("z"), F.when(F.col("at") % 29 == 11, 2).otherwise(0).alias("label"), F.lit(0.1).alias("probability"), F.lit(False).alias("is_cross_floor"), F.lit(0).alias("room_id")).alias("w"))
    paths = points.groupBy("path_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "w"))), lambda p: p["w"]).alias("waypoints"))
    out = graph.smoothed(paths)
    return out.select("path_id", F.explode("waypoints").alias("w")).select("path_id", F.col("w.leaf_id").alias("pos"))


SMOOTHED_PATHS = """WITH RECURSIVE p AS (SELECT path_id, pos, CASE WHEN (pos // 7) % 2 = 0 THEN pos * 0.5::DOUBLE ELSE 0.0 END AS x, CASE WHEN (pos // 7) % 2 = 1 THEN pos * 0.5::DOUBLE ELSE 0.0 END AS y, CASE WHEN pos % 23 = 5 THEN 1.5::DOUBLE ELSE 1.0 END AS z, CASE WHEN pos % 29 = 11 THEN 2 ELSE 0 END AS label, row_number() OVER (PARTITION BY path_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY path_id) AS n FROM (SELECT event_id % 50 AS path_id, event_id // 50 AS pos FROM events)),
w AS (SELECT path_id, i, pos, n, x, y, z, label, true AS keep, x AS kx, y AS ky, z AS kz, label AS kl FROM p WHERE i = 1
 UNION ALL SELECT path_id, i, pos, n, x, y, z, label, keep, CASE WHEN keep THEN x ELSE kx END, CASE WHEN keep THEN y ELSE ky END, CASE WHEN keep THEN z ELSE kz END, CASE WHEN keep THEN label ELSE kl END FROM (
  SELECT b.path_id, b.i, b.pos, b.n, b.x, b.y, b.z, b.label, w.kx, w.ky, w.kz, w.kl, b.i = b.n OR w.kl = 2 OR b.label = 2 OR c.label = 2 OR abs(b.z - w.kz) > 0.15 OR abs(c.z - b.z) > 0.15
   OR sqrt((b.x - w.kx) ** 2 + (b.y - w.ky) ** 2 + (b.z - w.kz) ** 2) < 1e-5 OR sqrt((c.x - b.x) ** 2 + (c.y - b.y) ** 2 + (c.z - b.z) ** 2) < 1e-5
   OR ((b.x - w.kx) * (c.x - b.x) + (b.y - w.ky) * (c.y - b.y) + (b.z - w.kz) * (c.z - b.z)) / (sqrt((b.x - w.kx) ** 2 + (b.y - w.ky) ** 2 + (b.z - w.kz) ** 2) * sqrt((c.x - b.x) ** 2 + (c.y - b.y) ** 2 + (c.z - b.z) ** 2)) <= 0.995 AS keep
  FROM w JOIN p b ON b.path_id = w.path_id AND b.i = w.i + 1 LEFT JOIN p c ON c.path_id = b.path_id AND c.i = b.i + 1))
SELECT path_id, pos FROM w WHERE keep"""

# --- streams --------------------------------------------------------------------------------------------------------


def stream_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed frames that arrive as files: each micro-batch builds its trees anew and adds its leaves to a table."""
    frames, out, checkpoint = (shared_path(spark, f"stream-{x}") for x in ("frames", "leaves", "checkpoint"))
    _packed(spark, sf_dir).repartition(3, "frame_id").write.parquet(frames)

    def each(samples: DataFrame, batch: int) -> None:
        octree.leaves(samples, SHALLOW).select("frame_id", "depth", "path", "n", "label").write.mode("append").parquet(out)

    query = jobs.run_frames(jobs.frame_stream(spark, frames, files_per_trigger=1), each, checkpoint, once=True)
    query.awaitTermination()
    return spark.read.schema("frame_id long, depth int, path long, n long, label int").parquet(out)


_FIVE = EMBEDDINGS.replace("0 AS frame_id", "vec_id % 5 AS frame_id")
STREAM_LEAVES = octree_sql(_FIVE, SHALLOW) + "SELECT frame_id, depth, path, n, label FROM leaf"

NAMES = [
    "packed_decode", "packed_xyz", "point_samples", "demo_grid", "pcd_files", "feature_file", "weak_feature_file", "external_labels", "prediction_listing", "feature_inputs", "forest_text", "forest_facts", "predicted_file", "stratified_split",
    "top_inputs", "runs_file", "summary_json", "markdown_lines", "first_frames", "named_settings", "mesh_samples", "shape_dispatch", "leaf_predictor", "label_override", "touched_leaves", "rebuilt_frames", "smoothed_paths", "stream_leaves",
]
QUERIES = {n: globals()[n] for n in NAMES}
SQL = {n: globals()[n.upper()] for n in NAMES}
