"""Shared parts of the text operators: staged tables, word hashing, grouped streaming, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_libc = ctypes.CDLL(None) if hasattr(ctypes.CDLL(None), "malloc_trim") else None
#: Texts are hashed in chunks of about so many bytes, which bounds a worker's memory.
CHUNK_BYTES = 1_000_000
#: Spans are hashed so many bytes at a time.
SPAN_BYTES = 1 << 18


#: Rows of an Arrow batch; documents are long, so Spark's default of 10,000 rows makes batches of tens of MB.
ARROW_ROWS = 2000


#: Bytes of an Arrow batch.
ARROW_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, unless they are bounded below already.

    Plans read these settings when they run, after the operator has returned, so they stay.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = int(str(spark.conf.get(key)).lower().rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of its own only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="voxspan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/voxspan/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release_driver(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    if _scratch:
        _scratch[-1].add(path)
    return out


#: The tables written within each open scratch().
_scratch: list[set[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are staged within are removed at its end, but for those that the given function was called with."""
    own: set[str] = set()
    _scratch.append(own)

    def keep(df: DataFrame) -> DataFrame:
        own.discard(df._staged_path)
        return df

    try:
        yield keep
    finally:
        _scratch.remove(own)
        for path in own:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def unstage(df: DataFrame) -> None:
    """Remove a staged table that no later plan reads."""
    path = getattr(df, "_staged_path", None)
    if path:
        _delete(df.sparkSession, path)


def release() -> None:
    """Give freed memory back to the system at the end of a task: idle workers stay, and others share the executor's limit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def release_driver(spark: SparkSession) -> None:
    """Collect the driver's garbage once it takes a quarter of the heap: plans and task results of stages that are done.

    Left alone the JVM fills all of its heap with these before it looks, and does not give it back.
    """
    runtime = spark._jvm.Runtime.getRuntime()
    if runtime.totalMemory() - runtime.freeMemory() > runtime.maxMemory() // 4:
        gc.collect()  # what only Python's garbage refers to goes as well
        runtime.gc()


def release_executors(spark: SparkSession) -> None:
    """Collect the garbage of all executors, between stages: a heap that earlier ones filled leaves Python workers no room.

    The first tasks of a job go to all free cores, so each executor gets some.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()  # a row a core


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def random_odd(n: int, seed: int) -> np.ndarray:
    return mixed((np.arange(n, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    values = random_odd(256, 11)
    values[65:91] = values[97:123]  # A-Z count as a-z
    return blank, values


BLANK, BYTE_VALUES = _byte_tables()
_powers = random_odd(1 << 10, 23)


def _position_values(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = random_odd(max(n, 2 * len(_powers)), 23)
    return _powers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def split_words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of words before each row (rows + 1 entries). cuts: where words are cut besides."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~blank[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    if cuts is not None:
        edge[cuts] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z as a-z with the default values)."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    lens = ends - starts
    stop = np.cumsum(lens)
    if int(stop[-1]) > SPAN_BYTES and len(starts) > 1:  # some spans at a time, which bounds what is held
        cuts = np.unique(np.concatenate([[0], np.searchsorted(stop, np.arange(SPAN_BYTES, int(stop[-1]), SPAN_BYTES)) + 1, [len(starts)]]))
        if len(cuts) > 2:
            return np.concatenate([hash_spans(data, starts[a:b], ends[a:b], values) for a, b in zip(cuts[:-1], cuts[1:])])
    first = stop - lens
    pos = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(first, lens)
    at = pos + np.repeat(starts, lens)
    terms = values[data[at]] * _position_values(int(lens.max()))[pos]
    return mixed(np.add.reduceat(terms, first) + lens.astype(U64))


def batches_of(column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]]:
    """Turn Arrow batches into bounded slices with the bytes and offsets of one text column."""

    def gen(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
            for lo, hi in chunks(offsets):
                part = offsets[lo : hi + 1]
                yield batch.slice(lo, hi - lo), data[part[0] : part[-1]], part - part[0]
        release()

    return gen


def run_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """fn over the rows of each key, streamed: rows are dealt and sorted by key, and a worker holds one group and one batch."""
    arrow = [f.name for f in df.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        outs: list[pa.Table] = []
        waiting = 0

        def close():
            if held and (out := fn(pa.Table.from_batches(held))) is not None and out.num_rows:
                outs.append(out)
            held.clear()

        last = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cols = [batch.column(arrow.index(k)).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows, bool)
            now = tuple(c[0] for c in cols)
            change[0] = last is not None and now != last
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            last = tuple(c[-1] for c in cols)
            at = 0
            for cut in np.flatnonzero(change):
                if cut > at:
                    held.append(batch.slice(at, cut - at))
                close()
                at = int(cut)
            held.append(batch.slice(at))
            waiting = sum(t.num_rows for t in outs)
            if waiting > 2000:
                yield from pa.concat_tables(outs).combine_chunks().to_batches()
                outs.clear()
        close()
        if outs:
            yield from pa.concat_tables(outs).combine_chunks().to_batches()
            outs.clear()
        release()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def block_pairs(df: DataFrame, key: list[str], member: str, blocks: str) -> DataFrame:
    """Deal each group's rows to pairs of blocks, so that any two rows of a group meet in one pair and no task holds a large group.

    `blocks` is the column with the group's number of blocks. Adds lo, hi (the pair) and side (this row's block).
    """
    side = F.pmod(F.xxhash64(member), F.col(blocks)).cast("int")
    return (
        df.withColumn("side", side)
        .withColumn("_o", F.explode(F.expr(f"sequence(0, cast({blocks} as int) - 1)")))
        .withColumn("lo", F.least("side", "_o"))
        .withColumn("hi", F.greatest("side", "_o"))
        .drop("_o")
    )


#: A node of a graph is a hub from so many neighbours on, and so that at most HUBS of them are.
HUB, HUBS = 1000, 100_000


def _to_least(edges: DataFrame, end: str, least: DataFrame, limit: int) -> DataFrame:
    """a, b, m of edges: with what least (u, m, n neighbours) says of one end. Hubs, a bounded number, are sent to all tasks; a join deals the rest."""
    hubs = F.broadcast(least.where(F.col("n") > limit).select("u", "m"))
    met = edges.join(hubs, F.col(end) == F.col("u"))
    rest = edges.join(hubs, F.col(end) == F.col("u"), "left_anti")
    return met.select("a", "b", "m").union(rest.join(least.where(F.col("n") <= limit).select("u", "m"), F.col(end) == F.col("u")).select("a", "b", "m"))


def components(edges: DataFrame, tag: str = "cc", most: int = 60) -> DataFrame:
    """(id, component) for every end of the edges (a, b): the smallest id reachable.

    Alternating large and small stars; each round is written to the shared folder, so lineage stays short.
    Minima are pre-aggregated, and hubs meet theirs without a shuffle. Raises if it has not settled after `most` rounds.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = staged(e, tag)
    before = None
    for _ in range(most):
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark[0] == 0 or mark == before:
            break
        before = mark
        limit = max(HUB, -(-2 * mark[0] // HUBS))
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"), "n")
        # large star: each larger neighbour moves to the smallest one
        large = _to_least(e, "b", low, limit).select("a", F.col("m").alias("b")).where("a <> b").union(low.where("u <> m").select("u", "m")).distinct()
        # small star: each end below moves to the smallest one below
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumnRenamed("a", "u")
        small = _to_least(large, "a", least, limit).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        after = staged(small, tag)
        unstage(e)
        e = after
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    ends = e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    return ends.union(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
