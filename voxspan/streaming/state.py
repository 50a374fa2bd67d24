"""State over streams of frames: throttles, per-leaf updates, entity life cycles and changes of paths.

Each has a batch form that streams sorted rows, and the keyed ones a form for Structured Streaming; both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import d
from ..sources.shapes import entity_delta

FLOOR = 0.35  # fixed value: repeated hits without semantics lower a probability to this at most


def throttle(events: DataFrame, key: str, period_s: float, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Events that a publisher lets through: the first of each key, and then each that is `period_s` or more after the last one.

    Rows are dealt by key and sorted; a task holds one row of state, whatever a key's size.
    """
    names = events.columns
    period = pd.Timedelta(seconds=period_s)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, last = None, None
        for frame in frames:
            keep = []
            for k, t in zip(frame[key], frame[ts], strict=True):
                if k != own:
                    own, last = k, None
                keep.append(last is None or t >= last + period)
                if keep[-1]:
                    last = t
            yield frame[keep]

    return events.repartition(key).sortWithinPartitions(key, ts, tie).mapInPandas(run, events.schema).select(*names)


def throttle_stream(events: DataFrame, key: str, period_s: float, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """throttle() on a stream: the state of a key is the time of its last event let through."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    period = int(period_s * 1_000_000)

    def step(k, frames, state):
        last = state.get[0] if state.exists else None
        for frame in frames:
            keep = []
            for t in frame.sort_values([ts, tie]).itertuples():
                now = pd.Timestamp(getattr(t, ts)).value // 1000
                if last is None or now >= last + period:
                    last = now
                    keep.append(t.Index)
            yield frame.loc[keep]
        if last is not None:
            state.update((last,))

    return events.groupBy(key).applyInPandasWithState(step, events.schema, "last long", "append", GroupStateTimeout.NoTimeout)


def tumbling_first(events: DataFrame, key: str, width: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The first event of each key and window: a throttle that needs no order between rows."""
    return events.groupBy(key, F.window(ts, width).alias("w")).agg(F.min_by(tie, F.struct(ts, tie)).alias(tie)).select(key, F.col("w.start").alias("start"), tie)


def update_leaves(state: DataFrame, hits: DataFrame, decay: float = 0.80, seq: str = "seq") -> DataFrame:
    """Leaf state (leaf, n, label, room_id, probability, is_cross_floor) after hits (leaf, seq, has_semantics, label, room_id, probability).

    The last hit with semantics sets label, room and probability; each one without after that lowers the probability by
    `decay`, to FLOOR at least. Both are aggregates: the last writer by max_by, and the count of hits after it.
    """
    when = F.when(F.col("has_semantics"), F.struct("label", "room_id", d("probability").alias("probability")))
    last = hits.groupBy("leaf").agg(F.count(F.lit(1)).alias("hits"), F.max_by(when, F.when(F.col("has_semantics"), F.col(seq))).alias("said"), F.max(F.when(F.col("has_semantics"), F.col(seq))).alias("at"))
    after = hits.join(last.select("leaf", "at"), "leaf").where(F.col("at").isNull() | (F.col(seq) > F.col("at"))).groupBy("leaf").agg(F.count(F.lit(1)).alias("plain"))
    out = state.join(last, "leaf", "left").join(after, "leaf", "left")
    told = F.col("said").isNotNull()
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("said.probability", d("probability"))))
    plain = F.coalesce("plain", F.lit(0))
    label = F.coalesce("said.label", "label")
    return out.select(
        "leaf",
        (F.col("n") + F.coalesce("hits", F.lit(0))).alias("n"),
        label.alias("label"),
        F.coalesce("said.room_id", "room_id").alias("room_id"),
        F.when(plain > 0, F.greatest(p * F.pow(F.lit(decay), plain), F.lit(FLOOR))).otherwise(p).alias("probability"),
        F.when(told, label == 2).otherwise(F.col("is_cross_floor")).alias("is_cross_floor"),
        F.col("hits").isNotNull().alias("dynamic"),
    )


def touched(hits: DataFrame) -> DataFrame:
    return hits.select("leaf").distinct()


def outside_root(points: DataFrame, roots: DataFrame) -> DataFrame:
    """frame_id, rebuilt: whether a batch has a point outside its root box, so that the tree starts anew from the batch alone."""
    from ..functions.geometry import box_contains

    return points.join(roots, "frame_id").groupBy("frame_id").agg(F.bool_or(~box_contains()).alias("rebuilt"))


def latest_frame(frames: DataFrame, order: str = "frame_id") -> DataFrame:
    """Rows of the newest frame: what a viewer shows."""
    newest = frames.agg(F.max(order).alias("_newest"))
    return frames.join(F.broadcast(newest), F.col(order) == F.col("_newest")).drop("_newest")  # one row


def changed_paths(paths: DataFrame, keys: list[str], order: str, tolerance: float = 0.05) -> DataFrame:
    """paths (keys, order, waypoints array<struct<x, y, z, ..>>) with `changed`: not the same points, within tolerance, as the one before."""
    before = F.lag("waypoints").over(Window.partitionBy(*keys).orderBy(order))
    out = paths.withColumn("_before", before)

    def near(a, b):
        x, y, z = (d(a[k]) - d(b[k]) for k in ("x", "y", "z"))
        return F.sqrt(x * x + y * y + z * z) <= tolerance

    same = (F.size("_before") == F.size("waypoints")) & F.forall(F.zip_with("_before", "waypoints", near), lambda v: v)
    return out.withColumn("changed", ~F.coalesce(same, F.lit(False))).drop("_before")


def entity_batches(live_by_batch: DataFrame, batch: str = "batch", key: str = "entity_key") -> DataFrame:
    """Entities that appear or go between one batch and the next: batch, key, change."""
    seen = live_by_batch.select(batch, key).distinct()
    gone = seen.select((F.col(batch) + 1).alias(batch), key)
    ends = seen.agg(F.max(batch).alias("_last"))
    added = seen.join(gone, [batch, key], "left_anti").withColumn("change", F.lit("added"))
    removed = gone.join(seen, [batch, key], "left_anti").join(F.broadcast(ends), F.col(batch) <= F.col("_last")).drop("_last").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


__all__ = ["changed_paths", "entity_batches", "entity_delta", "latest_frame", "outside_root", "throttle", "throttle_stream", "touched", "tumbling_first", "update_leaves"]
