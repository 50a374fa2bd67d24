"""Tables in the shared folder, and connected components over them.

A written table counts as no larger than its compressed files, which can be a small part of its rows in memory. So tables
that grow with the input are joined with the hint "merge": the optimizer would gather them in the driver to send them.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:  # as in tests
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="voxspan-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/voxspan/{tag}-{uuid.uuid4().hex}"


def release_driver(spark: SparkSession) -> None:
    """Collect the driver's garbage once it takes a quarter of the heap; the JVM would fill all of its heap with plans and task results of stages that are done."""
    runtime = spark._jvm.Runtime.getRuntime()
    if runtime.totalMemory() - runtime.freeMemory() > runtime.maxMemory() // 4:
        gc.collect()  # what only Python's garbage refers to goes as well
        runtime.gc()


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder, and read back: the lineage ends there."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    release_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def smallest_reachable(nodes: DataFrame, links: DataFrame, key: str = "frame_id", most: int = 60) -> DataFrame:
    """key, id, component: the smallest id reachable by links (key, a, b, taken both ways) for each node (key, id).

    Labels spread to neighbours and then jump to the label of their label, so a chain of n nodes takes about log n rounds.
    """
    both = written(links.select(key, "a", "b").union(links.select(key, F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    now = written(nodes.select(key, "id", F.col("id").alias("component")).distinct(), "labels")
    for _ in range(most):
        near = both.join(now.select(key, F.col("id").alias("b"), F.col("component").alias("c")).hint("merge"), [key, "b"]).groupBy(key, "a").agg(F.min("c").alias("c"))
        spread = now.join(near.withColumnRenamed("a", "id").hint("merge"), [key, "id"], "left").select(key, "id", F.col("component").alias("was"), F.least("component", F.coalesce("c", "component")).alias("component"))
        jumped = spread.join(now.select(key, F.col("id").alias("component"), F.col("component").alias("c")).hint("merge"), [key, "component"], "left")
        # one table a round, which also says whether a label has moved
        now = written(jumped.select(key, "id", F.least("component", F.coalesce("c", "component")).alias("component"), "was"), "labels")
        if now.where("component <> was").isEmpty():
            return now.select(key, "id", "component")
    raise RuntimeError(f"components did not settle in {most} rounds")
