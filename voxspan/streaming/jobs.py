"""Structured Streaming jobs: frames in, leaves, features or paths out, rebuilt for each micro-batch."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import FeatureConfig, OctreeConfig, PlannerConfig
from ..operators import features, graph, neighbors, octree
from ..sources.packed import FRAME_SCHEMA, decode_packed


def frame_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None, latest_first: bool = False) -> DataFrame:
    """Packed frames from Parquet files as they arrive; latest_first takes the newest files first when it falls behind."""
    reader = spark.readStream.schema(FRAME_SCHEMA).option("latestFirst", latest_first)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


class Pace:
    """Lets a callback run at most once a period, and never twice at a time: calls that come too early or while it runs are dropped."""

    def __init__(self, each: Callable[[DataFrame, int], None], period_s: float, clock: Callable[[], float] = time.monotonic):
        self.each, self.period, self.clock = each, period_s, clock
        self.last: float | None = None
        self.ran = self.dropped = 0
        self.busy = threading.Lock()

    def __call__(self, df: DataFrame, batch: int) -> None:
        now = self.clock()
        if (self.last is not None and now - self.last < self.period) or not self.busy.acquire(blocking=False):
            self.dropped += 1
            return
        try:
            self.last = now
            self.each(df, batch)
            self.ran += 1
        finally:
            self.busy.release()


def run_frames(frames: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, every: str | None = None) -> StreamingQuery:
    """`each` on the samples of every micro-batch. once: what is there now, and stop; every: at most so often."""
    writer = frames.writeStream.foreachBatch(lambda df, batch: each(decode_packed(df), batch)).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    return writer.start()


def leaf_features_of(samples: DataFrame, cfg: OctreeConfig = OctreeConfig(), feature: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Feature rows of each frame's leaves."""
    roots = octree.root_bounds(samples)
    own = octree.assigned(samples, roots, cfg)
    keys = ["frame_id", "depth", "path"]
    tree = octree.leaves(samples, cfg, roots)
    shape = octree.pca(own, keys).drop("n")
    index = octree.nodes(samples, roots, cfg).where("leaf").select(*keys, "node_index")
    full = octree.with_morton(tree.join(shape, keys).join(index, keys), cfg)
    return features.leaf_features(full, feature, ["frame_id"])


def paths_of(samples: DataFrame, queries: DataFrame, cfg: OctreeConfig = OctreeConfig(), plan: PlannerConfig = PlannerConfig()) -> DataFrame:
    """Paths for queries (query_id, frame_id, x, y, z, goal_x, goal_y, goal_z) over each frame's leaves."""
    roots = octree.root_bounds(samples)
    tree = graph.with_leaf_id(octree.leaves(samples, cfg, roots), cfg)
    faces = neighbors.face_neighbors(tree, roots, cfg)
    costs = graph.edge_costs(graph.graph_edges(tree, faces, plan), tree, cfg, plan)
    start = graph.endpoint_snap(queries.select("query_id", "frame_id", "x", "y", "z"), tree, roots, cfg, plan)
    goal = graph.endpoint_snap(queries.select("query_id", "frame_id", *[F.col(f"goal_{a}").alias(a) for a in "xyz"]), tree, roots, cfg, plan)
    ends = start.select("frame_id", "query_id", F.col("leaf_id").alias("start_leaf")).join(goal.select("frame_id", "query_id", F.col("leaf_id").alias("goal_leaf")), ["frame_id", "query_id"])
    return graph.find_paths(tree, costs, ends, plan)
