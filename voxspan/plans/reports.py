"""Queries over benchmark runs, labels and predictions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forest, report, view
from ..sources import adapters, files
from .clouds import r4

RUNS = """SELECT o_custkey AS frame, CASE WHEN o_orderkey % 2 = 0 THEN 'semantic_octree_astar' ELSE 'rf_octree_astar' END AS mode, o_orderkey % 50000 + 1000 AS source_points, o_orderkey % 25000 + 500 AS used_points,
 o_totalprice / 10000.0 AS parse_ms, o_totalprice / 1000.0 AS build_ms, o_totalprice / 500.0 AS plan_ms, o_totalprice / 10000.0 + o_totalprice / 1000.0 + o_totalprice / 500.0 AS total_ms,
 o_orderkey % 9000 + 100 AS node_count, o_orderkey % 7000 + 80 AS leaf_count, (o_orderkey % 9000 + 100) * 0.25::DOUBLE AS estimated_node_memory_kb, o_orderkey % 4096 + 1024 AS rss_kb_after, o_orderkey % 8192 + 2048 AS peak_rss_kb,
 o_orderkey % 1500 AS expanded_nodes, o_orderkey % 40 AS waypoints, o_totalprice / 300.0 AS path_cost, o_orderstatus = 'F' AS path_success FROM orders"""
_MEASURED = ", ".join(f"{f}(CAST({m} AS DOUBLE)) AS {n}_{m}" for m in report.MEASURES for n, f in (("mean", "avg"), ("min", "min"), ("max", "max")))
SUMMARY = f"""WITH runs AS ({RUNS}), s0 AS (SELECT mode, count(*) AS frames, avg(CAST(path_success AS INTEGER)) AS success_rate, {_MEASURED} FROM runs GROUP BY mode),
s1 AS (SELECT *, mean_used_points * 24.0 / 1024.0 AS raw_pointcloud_kb, mean_used_points * 96.0 / 1024.0 AS point_graph_kb FROM s0),
summary AS (SELECT *, (raw_pointcloud_kb - mean_estimated_node_memory_kb) / nullif(raw_pointcloud_kb, 0) * 100.0 AS raw_reduction_percent, (point_graph_kb - mean_estimated_node_memory_kb) / nullif(point_graph_kb, 0) * 100.0 AS graph_reduction_percent,
 1000.0 / nullif(mean_plan_ms, 0) AS planning_hz, 1000.0 / nullif(mean_total_ms, 0) AS end_to_end_hz, mean_expanded_nodes * 1000.0 / nullif(mean_plan_ms, 0) AS expanded_nodes_per_second FROM s1)"""
_COLUMNS = ["success_rate", *[f"{n}_{m}" for m in report.MEASURES for n in ("mean", "min", "max")], "raw_pointcloud_kb", "point_graph_kb", "raw_reduction_percent", "graph_reduction_percent", *report.RATES]


def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.bench_summary(adapters.benchmark_rows(spark, sf_dir))
    return out.select("mode", "frames", *[r4(c, c, 3) for c in _COLUMNS])


BENCH_SUMMARY = SUMMARY + " SELECT mode, frames, " + ", ".join(f"round(CAST({c} AS DOUBLE), 3) AS {c}" for c in _COLUMNS) + " FROM summary"


def bench_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.bench_comparison(report.bench_summary(adapters.benchmark_rows(spark, sf_dir)))
    return out.select("metric", *[r4(c, c, 3) for c in ("base_value", "other_value", "delta", "change_percent", "ratio", "speedup")])


_METRICS = [f"mean_{m}" for m in report.COMPARED] + report.RATES
_LONG = " UNION ALL ".join(f"SELECT '{m}' AS metric, {m in report.RATES} AS rate, (SELECT {m} FROM summary WHERE mode = 'semantic_octree_astar') AS b, (SELECT {m} FROM summary WHERE mode = 'rf_octree_astar') AS o" for m in _METRICS)
BENCH_COMPARISON = SUMMARY + f", m AS ({_LONG}) SELECT metric, round(b, 3) AS base_value, round(o, 3) AS other_value, round(o - b, 3) AS delta, round(CASE WHEN rate THEN (o - b) ELSE (b - o) END / nullif(b, 0) * 100.0, 3) AS change_percent, round(o / nullif(b, 0), 3) AS ratio, round(CASE WHEN NOT rate THEN b / nullif(o, 0) END, 3) AS speedup FROM m WHERE b IS NOT NULL AND o IS NOT NULL"


def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.bench_comparison(report.bench_summary(adapters.benchmark_rows(spark, sf_dir)))
    return out.select("metric", report.number_text(F.col("base_value")).alias("base_text"), report.percent_text(F.col("change_percent")).alias("change_text"), report.duration_text(F.col("other_value")).alias("duration_text"), report.speedup_text(F.col("speedup")).alias("speedup_text"))


_CHANGE = "CASE WHEN rate THEN (o - b) ELSE (b - o) END / nullif(b, 0) * 100.0"
REPORT_TEXT = SUMMARY + f", m AS ({_LONG}) SELECT metric, format('{{:.2f}}', b) AS base_text, coalesce(format('{{:+.2f}}%', {_CHANGE}), 'N/A') AS change_text, CASE WHEN abs(o) >= 1000 THEN format('{{:.2f}} s', o / 1000.0) ELSE format('{{:.1f}} ms', o) END AS duration_text, coalesce(CASE WHEN NOT rate THEN format('{{:.2f}}x', b / nullif(o, 0)) END, 'N/A') AS speedup_text FROM m"


def run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.benchmark_rows(spark, sf_dir).select(view.run_line().alias("line"))


RUN_LINES = f"SELECT concat('[benchmark] frame=', frame, ' mode=', mode, ' points=', used_points, ' leaves=', leaf_count, ' path=', CASE WHEN path_success THEN 'success' ELSE 'failed' END, ' expanded=', expanded_nodes, ' waypoints=', waypoints, format(' total_ms={{:.6f}}', total_ms)) AS line FROM ({RUNS})"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows as a feature file gives them: some labels and numbers are no numbers."""
    t = adapters.table(spark, sf_dir, "lineitem")
    k = F.col("l_partkey")
    label = F.when(k % 17 == 0, "x").when(k % 5 == 0, "4").otherwise(F.concat((k % 3).cast("string"), F.lit(".7")))
    number = F.when(k % 19 == 0, "nan").when(k % 23 == 0, "").otherwise(F.col("l_quantity").cast("string"))
    return t.select(label.alias("label"), number.alias("density"), (k % 13 / 10.0).cast("string").alias("obstacle_probability"), F.col("l_linestatus").alias("source_file"))


_ROWS = """SELECT CASE WHEN l_partkey % 17 = 0 THEN NULL WHEN l_partkey % 5 = 0 THEN 4 ELSE CAST(l_partkey % 3 AS INTEGER) END AS label, CASE WHEN l_partkey % 19 = 0 OR l_partkey % 23 = 0 THEN NULL ELSE l_quantity END AS density, l_partkey % 13 / 10.0 AS p, l_linestatus AS source_file FROM lineitem"""


def training_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forest.training_rows(_rows(spark, sf_dir), ["density"])
    return rows.where("valid").groupBy("label").agg(F.count(F.lit(1)).alias("rows"), r4(F.avg("density"), "mean_density"), r4(F.avg("obstacle_probability"), "mean_probability"))


TRAINING_FILTER = f"SELECT label, count(*) AS rows, round(avg(density), 4) AS mean_density, round(avg(greatest(0.0, least(1.0, p))), 4) AS mean_probability FROM ({_ROWS}) WHERE label IN (0, 1, 2) AND density IS NOT NULL GROUP BY label"


def rows_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.rows_by_file(forest.training_rows(_rows(spark, sf_dir), ["density"]))


ROWS_BY_FILE = f"SELECT source_file, count(*) AS rows, count(*) FILTER (label IN (0, 1, 2) AND density IS NOT NULL) AS valid_rows FROM ({_ROWS}) GROUP BY 1"


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.label_counts(adapters.lineitem_cloud(spark, sf_dir))


LABEL_COUNTS = "SELECT CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 0 END AS label, count(*) AS rows FROM lineitem GROUP BY 1"


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = adapters.table(spark, sf_dir, "embeddings")
    truth = (F.col("label") % 3).cast("int")
    return t.select(truth.alias("truth"), F.when(F.col("vec_id") % 7 == 0, (truth + 1) % 3).otherwise(truth).cast("int").alias("predicted"), (F.col("label") / 10.0).alias("p_truth"), (F.col("label") / 10.0 + F.col("vec_id") % 5 * 0.02).alias("p_predicted"))


_PREDICTED = "SELECT CAST(label % 3 AS INTEGER) AS truth, CAST(CASE WHEN vec_id % 7 = 0 THEN (label % 3 + 1) % 3 ELSE label % 3 END AS INTEGER) AS predicted, CAST(label AS DOUBLE) / 10.0 AS pt, CAST(label AS DOUBLE) / 10.0 + vec_id % 5 * 0.02::DOUBLE AS pp FROM embeddings"


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.confusion_matrix(_predicted(spark, sf_dir))


CONFUSION_MATRIX = f"SELECT truth, predicted, count(*) AS rows FROM ({_PREDICTED}) GROUP BY 1, 2"


def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.class_metrics(_predicted(spark, sf_dir)).select("class", "support", *[r4(c, c) for c in ("precision", "recall", "f1")])


CLASS_METRICS = f"""WITH p AS ({_PREDICTED}), c AS (SELECT k, count(*) FILTER (truth = k) AS t, count(*) FILTER (predicted = k) AS p, count(*) FILTER (truth = k AND predicted = k) AS h FROM p, unnest([0, 1, 2]) AS u(k) GROUP BY k),
m AS (SELECT k, t, p, h, coalesce(h / nullif(CAST(p AS DOUBLE), 0), 0) AS pr, coalesce(h / nullif(CAST(t AS DOUBLE), 0), 0) AS re FROM c),
f AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1 FROM m)
SELECT CAST(k AS VARCHAR) AS class, CAST(t AS BIGINT) AS support, round(pr, 4) AS precision, round(re, 4) AS recall, round(f1, 4) AS f1 FROM f
UNION ALL SELECT 'macro avg', CAST(sum(t) AS BIGINT), round(avg(pr), 4), round(avg(re), 4), round(avg(f1), 4) FROM f
UNION ALL SELECT 'weighted avg', CAST(sum(t) AS BIGINT), round(sum(pr * t) / sum(t), 4), round(sum(re * t) / sum(t), 4), round(sum(f1 * t) / sum(t), 4) FROM f
UNION ALL SELECT 'accuracy', CAST(sum(t) AS BIGINT), round(sum(h) / CAST(sum(t) AS DOUBLE), 4), round(sum(h) / CAST(sum(t) AS DOUBLE), 4), round(sum(h) / CAST(sum(t) AS DOUBLE), 4) FROM f"""


def prob_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = forest.probability_errors(_predicted(spark, sf_dir), "p_truth", "p_predicted")
    return out.select("rows", *[r4(c, c) for c in ("mae", "rmse", "r2")])


PROB_ERROR = f"SELECT count(*) AS rows, round(avg(abs(pt - pp)), 4) AS mae, round(sqrt(avg((pt - pp) * (pt - pp))), 4) AS rmse, round(1.0 - sum((pt - pp) * (pt - pp)) / (var_pop(pt) * count(*)), 4) AS r2 FROM ({_PREDICTED})"

#: A small forest: two trees for the label and one for the probability, over o_totalprice (0) and the day of the order (1).
SMALL_FOREST = [
    ("classifier", 0, 0, 1, 2, 0, 150000.0, []), ("classifier", 0, 1, -1, -1, -1, 0.0, [0.7, 0.2, 0.1]), ("classifier", 0, 2, 3, 4, 1, 15.0, []),
    ("classifier", 0, 3, -1, -1, -1, 0.0, [0.1, 0.8, 0.1]), ("classifier", 0, 4, -1, -1, -1, 0.0, [0.2, 0.2, 0.6]),
    ("classifier", 1, 0, 1, 2, 1, 10.0, []), ("classifier", 1, 1, -1, -1, -1, 0.0, [0.5, 0.25, 0.25]), ("classifier", 1, 2, -1, -1, -1, 0.0, [0.25, 0.25, 0.5]),
    ("regressor", 0, 0, 1, 2, 0, 90000.0, []), ("regressor", 0, 1, -1, -1, -1, 0.0, [0.125]), ("regressor", 0, 2, -1, -1, -1, 0.0, [0.75]),
]


def rf_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = adapters.table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("a"), F.dayofmonth("o_orderdate").alias("b"))
    out = forest.predict_rows(t, SMALL_FOREST, ["a", "b"])
    return out.groupBy("predicted_label", "predicted_obstacle_probability").agg(F.count(F.lit(1)).alias("rows"))


RF_PREDICT = """WITH x AS (SELECT CAST(o_totalprice AS FLOAT) AS a, day(o_orderdate) AS b FROM orders),
v AS (SELECT CASE WHEN a <= 150000 THEN [0.7, 0.2, 0.1] WHEN b <= 15 THEN [0.1, 0.8, 0.1] ELSE [0.2, 0.2, 0.6] END AS t0, CASE WHEN b <= 10 THEN [0.5, 0.25, 0.25] ELSE [0.25, 0.25, 0.5] END AS t1, CASE WHEN a <= 90000 THEN 0.125::DOUBLE ELSE 0.75::DOUBLE END AS p FROM x),
s AS (SELECT t0[1] + t1[1] AS a, t0[2] + t1[2] AS b, t0[3] + t1[3] AS c, p FROM v)
SELECT CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS predicted_label, p AS predicted_obstacle_probability, count(*) AS rows FROM s GROUP BY 1, 2"""


def rf_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forests fitted on the cloud's points, measured on held-out rows."""
    cloud = adapters.lineitem_cloud(spark, sf_dir).select("x", "y", "z", "label", F.col("probability").cast("double").alias("obstacle_probability"), "entity_id")
    rows = forest.split_rows(cloud, 0.2, ["x", "y", "z", "entity_id"])
    model = forest.train(rows.where("not test"), ["x", "y", "z"], trees=5, depth=5)
    table = [tuple(r) for r in forest.forest_table(model, spark).collect()]  # the model
    out = forest.predict_rows(rows.where("test").withColumnRenamed("label", "truth"), table, ["x", "y", "z"])
    return forest.class_metrics(out.withColumnRenamed("predicted_label", "predicted")).select("class", "support", *[r4(c, c) for c in ("precision", "recall", "f1")])


NAMES = ["bench_summary", "bench_comparison", "report_text", "run_lines", "training_filter", "rows_by_file", "label_counts", "confusion_matrix", "class_metrics", "prob_error", "rf_predict", "rf_train"]
QUERIES = {n: globals()[n] for n in NAMES}
SQL = {n: globals()[n.upper()] for n in NAMES if n.upper() in globals()}
