"""Operator inputs from the star-schema tables: point clouds, frames, benchmark rows, scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import OBSTACLE, STAIR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_defaults(points: DataFrame) -> DataFrame:
    """Samples without semantics from points (x, y, z)."""
    return points.select(
        "*",
        F.lit(0).cast("long").alias("entity_id"),
        F.lit(0).alias("room_id"),
        F.lit(0).alias("label"),
        F.lit(0.0).cast("float").alias("probability"),
        F.lit(False).alias("has_semantics"),
        F.lit(False).alias("is_cross_floor"),
    )


def lineitem_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense semantic cloud, one frame for each ship year."""
    t = table(spark, sf_dir, "lineitem")
    label = F.when(F.col("l_returnflag") == "A", OBSTACLE).when(F.col("l_returnflag") == "R", STAIR).otherwise(0)
    return t.select(
        (F.col("l_quantity") * 0.4).cast("float").alias("x"),
        ((F.col("l_partkey") % 97) * 0.2).cast("float").alias("y"),
        (F.col("l_linenumber") * 1.3 + F.col("l_discount") * 4.0).cast("float").alias("z"),
        F.col("l_suppkey").alias("entity_id"),
        (F.col("l_suppkey") % 4).cast("int").alias("room_id"),
        label.alias("label"),
        F.when(label == OBSTACLE, 0.95).when(label == STAIR, 0.25).otherwise(0.05).cast("float").alias("probability"),
        F.lit(True).alias("has_semantics"),
        (label == STAIR).alias("is_cross_floor"),
        F.year("l_shipdate").alias("frame_id"),
    )


def embedding_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse semantic cloud in one room: the first three components of each vector."""
    t = table(spark, sf_dir, "embeddings")
    v = F.col("embedding")
    label = (F.col("label") % 3).cast("int")
    return t.select(
        *[(v[i].cast("double") * 10.0).cast("float").alias(a) for i, a in enumerate("xyz")],
        (F.col("vec_id") % 50).alias("entity_id"),
        F.lit(0).alias("room_id"),
        label.alias("label"),
        F.when(label == OBSTACLE, 0.95).when(label == STAIR, 0.25).otherwise(0.05).cast("float").alias("probability"),
        F.lit(True).alias("has_semantics"),
        (label == STAIR).alias("is_cross_floor"),
        F.lit(0).alias("frame_id"),
        "vec_id",
    )


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in event time, one frame for each event."""
    t = table(spark, sf_dir, "events")
    return t.select(
        F.col("event_id").alias("frame_id"),
        "ts",
        "event_type",
        ((F.col("user_id") % 40) * 0.25).cast("float").alias("x"),
        (F.col("value") % 20.0).cast("float").alias("y"),
        (1.0 + 4.0 * (F.col("event_id") % 3)).cast("float").alias("z"),
    )


def benchmark_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two planner modes, from orders."""
    t = table(spark, sf_dir, "orders")
    p, k = F.col("o_totalprice"), F.col("o_orderkey")
    return t.select(
        F.col("o_custkey").alias("frame"),
        F.when(k % 2 == 0, "semantic_octree_astar").otherwise("rf_octree_astar").alias("mode"),
        (k % 50000 + 1000).alias("source_points"),
        (k % 25000 + 500).alias("used_points"),
        (p / 10000.0).alias("parse_ms"),
        (p / 1000.0).alias("build_ms"),
        (p / 500.0).alias("plan_ms"),
        (p / 10000.0 + p / 1000.0 + p / 500.0).alias("total_ms"),
        (k % 9000 + 100).alias("node_count"),
        (k % 7000 + 80).alias("leaf_count"),
        ((k % 9000 + 100) * 0.25).alias("estimated_node_memory_kb"),
        (k % 4096 + 1024).alias("rss_kb_after"),
        (k % 8192 + 2048).alias("peak_rss_kb"),
        (k % 1500).alias("expanded_nodes"),
        (k % 40).alias("waypoints"),
        (p / 300.0).alias("path_cost"),
        (F.col("o_orderstatus") == "F").alias("path_success"),
    )


def scene(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Models, links and collisions: regions, nations and suppliers."""
    models = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("model_id"), F.col("r_name").alias("model_name"))
    links = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("link_id"), F.col("n_name").alias("link_name"), F.col("n_regionkey").alias("model_id"))
    collisions = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("collision_id"), F.col("s_name").alias("collision_name"), F.col("s_nationkey").alias("link_id"), F.col("s_acctbal").alias("size"))
    return models, links, collisions
