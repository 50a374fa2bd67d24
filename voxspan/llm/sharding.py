"""Uniform shuffling into shards of exact sizes, by a hypergeometric communication matrix.

Rows are dealt to source partitions by a hash. How many rows of each source go to each target block is drawn exactly:
the multivariate hypergeometric law of a uniform shuffle, given the sizes of both. Then each source permutes its rows and
cuts them by its row of the matrix, the blocks are exchanged, and each block is permuted again. A shard is several
blocks of known sizes, so its slots are known without another count and no task holds a whole shard.

The matrix (sources x blocks numbers) is drawn on the driver from the sources' counts; rows never leave the executors.
All of it is DataFrame functions.

Edge cases: null texts have size 1 and the checksum of no bytes; a null doc_id is a row like any other; rows that repeat
each get a slot of their own (equal rows are interchangeable); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: About so many rows for each source partition and each block.
ROWS_AT_ONCE, MOST_SOURCES, MOST_BLOCKS = 200_000, 2048, 64
#: Weights of the law that are smaller than this against its mode are left out.
LEAST_WEIGHT = 1e-20


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` rows out of good + bad are good, to the precision of doubles at any size.

    Weights of the law relative to that of its mode, by their ratios, outwards until they vanish; then the inverse of their sums.
    """
    lo, hi = max(0, draws - bad), min(draws, good)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))
    above, below, w, k = [], [], 1.0, mode
    while k < hi and w > LEAST_WEIGHT:
        w *= (good - k) / (k + 1) * ((draws - k) / (bad - draws + k + 1))
        k += 1
        above.append(w)
    w, k = 1.0, mode
    while k > lo and w > LEAST_WEIGHT:
        w *= k / (good - k + 1) * ((bad - draws + k) / (draws - k + 1))
        k -= 1
        below.append(w)
    u = rng.random() * (1.0 + math.fsum(above) + math.fsum(below)) - 1.0
    if u < 0:
        return mode
    for step, side in ((1, above), (-1, below)):
        for i, x in enumerate(side, 1):
            u -= x
            if u < 0:
                return mode + step * i
    return mode  # what rounding has left over


def communication_matrix(sources: list[int], targets: list[int], seed: int) -> list[list[int]]:
    """Rows of sources[i] to each target, uniformly among all shuffles; sums of rows and columns are exact."""
    rng = random.Random(seed)
    room, out = list(targets), []
    for n in sources:
        row, left, total = [], n, sum(room)
        for j, size in enumerate(room):
            total -= size
            k = hypergeometric(rng, size, total, left) if left else 0
            row.append(k)
            left -= k
        room = [a - b for a, b in zip(room, row, strict=True)]
        out.append(row)
    return out


def even(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def shuffle_into_shards(df: DataFrame, keys: list[str], shards: int = 8, seed: int = 7) -> DataFrame:
    """df with shard and slot (gapless from 0 in each shard), which replace columns of these names. keys: columns that order the rows; equal keys are interchangeable."""
    df = df.drop(*[c for c in ("shard", "slot") if c not in keys])
    n = df.count()
    sources = max(1, min(MOST_SOURCES, -(-n // ROWS_AT_ONCE) * 8))
    per_shard = max(1, min(MOST_BLOCKS, -(-n // (shards * ROWS_AT_ONCE))))
    # the source depends on all keys, so that neither a hot key nor a null gathers rows unless whole rows repeat
    rows = df.withColumn("__source", F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(sources)).cast("int"))
    counts = {r[0]: r[1] for r in rows.groupBy("__source").count().collect()}  # one number for each source
    sizes = [counts.get(i, 0) for i in range(sources)]
    blocks = [b for s in even(n, shards) for b in even(s, per_shard)]
    matrix = communication_matrix(sizes, blocks, seed)
    cuts = json.dumps([[sum(row[: j + 1]) for j in range(len(row))] for row in matrix])
    before = json.dumps([sum(blocks[i - i % per_shard : i]) for i in range(len(blocks))])
    table, offsets = F.from_json(F.lit(cuts), "array<array<bigint>>"), F.from_json(F.lit(before), "array<bigint>")

    def order(salt: int) -> list:
        return [F.xxhash64(F.lit(salt), *keys), *keys]

    rows = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("__source").orderBy(*order(seed + 1))) - 1)
    rows = rows.withColumn("__block", F.size(F.filter(F.get(table, F.col("__source")), lambda x: x <= F.col("__rank"))))
    rows = rows.withColumn("__place", F.row_number().over(Window.partitionBy("__block").orderBy(*order(seed + 2))) - 1)
    rows = rows.withColumn("shard", F.floor(F.col("__block") / per_shard).cast("int")).withColumn("slot", (F.get(offsets, F.col("__block")) + F.col("__place")).cast("long"))
    return rows.drop("__source", "__rank", "__block", "__place")


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: shards of equal numbers of rows, one apart at most."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shuffle_into_shards(rows, ["doc_id", "size", "text_crc32"], shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
