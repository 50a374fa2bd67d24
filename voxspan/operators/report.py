"""Summaries of benchmark runs, their comparison, and their text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The measured columns of a run.
MEASURES = ["source_points", "used_points", "parse_ms", "build_ms", "plan_ms", "total_ms", "node_count", "leaf_count", "estimated_node_memory_kb", "rss_kb_after", "peak_rss_kb", "expanded_nodes", "waypoints", "path_cost"]
RAW_POINT_BYTES, POINT_GRAPH_BYTES = 24.0, 96.0
COMPARED = ["total_ms", "build_ms", "plan_ms", "expanded_nodes", "waypoints", "path_cost"]
RATES = ["planning_hz", "end_to_end_hz", "expanded_nodes_per_second"]


def reduction(base: Column, now: Column) -> Column:
    return F.try_divide(base - now, base) * 100.0


def bench_summary(runs: DataFrame, raw_point_bytes: float = RAW_POINT_BYTES, point_graph_bytes: float = POINT_GRAPH_BYTES) -> DataFrame:
    """A row for each mode: frames, success rate, mean, least and most of each measure, memory estimates and rates."""
    numbers = [f(F.col(m).cast("double")).alias(f"{name}_{m}") for m in MEASURES for name, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    out = runs.groupBy("mode").agg(F.count(F.lit(1)).alias("frames"), F.avg(F.col("path_success").cast("int")).alias("success_rate"), *numbers)
    out = out.withColumn("raw_pointcloud_kb", F.col("mean_used_points") * raw_point_bytes / 1024.0).withColumn("point_graph_kb", F.col("mean_used_points") * point_graph_bytes / 1024.0)
    memory = F.col("mean_estimated_node_memory_kb")
    return out.select(
        "*",
        reduction(F.col("raw_pointcloud_kb"), memory).alias("raw_reduction_percent"),
        reduction(F.col("point_graph_kb"), memory).alias("graph_reduction_percent"),
        F.try_divide(F.lit(1000.0), F.col("mean_plan_ms")).alias("planning_hz"),
        F.try_divide(F.lit(1000.0), F.col("mean_total_ms")).alias("end_to_end_hz"),
        F.try_divide(F.col("mean_expanded_nodes") * 1000.0, F.col("mean_plan_ms")).alias("expanded_nodes_per_second"),
    )


def bench_comparison(summary: DataFrame, base: str = "semantic_octree_astar", other: str = "rf_octree_astar") -> DataFrame:
    """metric, base_value, other_value, delta, improvement or gain in percent, ratio and speedup: null where a divisor is zero."""
    measures = [f"mean_{m}" for m in COMPARED] + RATES
    long = summary.where(F.col("mode").isin(base, other)).select("mode", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in measures])).alias("m")).select("mode", "m.*")
    wide = long.groupBy("metric").agg(F.max(F.when(F.col("mode") == base, F.col("value"))).alias("base_value"), F.max(F.when(F.col("mode") == other, F.col("value"))).alias("other_value"))
    b, o = F.col("base_value"), F.col("other_value")
    rate = F.col("metric").isin(*RATES)
    wide = wide.where(b.isNotNull() & o.isNotNull())
    return wide.select("metric", "base_value", "other_value", (o - b).alias("delta"), F.when(rate, F.try_divide(o - b, b) * 100.0).otherwise(reduction(b, o)).alias("change_percent"), F.try_divide(o, b).alias("ratio"), F.when(~rate, F.try_divide(b, o)).alias("speedup"))


def _or_na(c: Column, text: Column) -> Column:
    return F.when(c.isNull(), F.lit("N/A")).otherwise(text)


def number_text(c: Column, digits: int = 2) -> Column:
    return _or_na(c, F.format_string(f"%.{digits}f", c.cast("double")))


def percent_text(c: Column) -> Column:
    return _or_na(c, F.format_string("%+.2f%%", c.cast("double")))


def duration_text(c: Column) -> Column:
    """Milliseconds, or seconds from a thousand on."""
    return _or_na(c, F.when(F.abs(c) >= 1000, F.format_string("%.2f s", c.cast("double") / 1000.0)).otherwise(F.format_string("%.1f ms", c.cast("double"))))


def speedup_text(c: Column) -> Column:
    return _or_na(c, F.format_string("%.2fx", c.cast("double")))


def markdown(comparison: DataFrame) -> str:
    """The comparison (a row for each metric) as a table."""
    rows = comparison.select("metric", number_text(F.col("base_value")).alias("b"), number_text(F.col("other_value")).alias("o"), percent_text(F.col("change_percent")).alias("c"), speedup_text(F.col("speedup")).alias("s")).orderBy("metric").collect()
    return "\n".join(["| metric | base | other | change | speedup |", "|---|---|---|---|---|", *("| " + " | ".join(r) + " |" for r in rows)]) + "\n"


def nested(summary: DataFrame) -> DataFrame:
    """One row: a map from mode to its summary, for a JSON file."""
    body = F.struct(*[c for c in summary.columns if c != "mode"])
    return summary.agg(F.map_from_entries(F.collect_list(F.struct("mode", body))).alias("modes")).withColumn("assumptions", F.struct(F.lit(RAW_POINT_BYTES).alias("raw_point_bytes"), F.lit(POINT_GRAPH_BYTES).alias("point_graph_bytes")))
