"""Contexts that cross words: passages of a text, what followed them in the training texts, and the bits that say so.

A text is cut into passages at places that its words choose: after a pair of words whose hash is 0 modulo PLACE. Before
each passage up to two bits are told: whether it is one that followed the passage before it in the training texts, and if
not, whether it is a passage of the training texts at all. A passage that is neither is spelled word by word. So a
passage's contexts are all the words of the passage before it, and its own place.

Each bit is predicted from several contexts: how often the passage before has been seen, how the last two passages of the
text came, and both. A context's counts of the bit over all training texts, each taken without the passage in question,
give a prediction; predictions are mixed in the logistic domain by weights that the last passage selects, and the mix is
refined by the counts of all contexts together. All passages of all training texts are counted, by joins on their hash.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mixed, random_odd, release, staged

#: One of so many pairs of words ends a passage.
PLACE = 24
#: How a passage came: spelled, known, or following the one before; and what stands before the first.
SPELLED, KNOWN, FOLLOWS, BEGIN = range(4)
#: Passages that make up this share of all or more meet their counts without a shuffle: there are HOT of them at most.
HOT = 100_000
#: Buckets of how often the passage before has been seen: none, and then powers of two.
SIZES = 8
_A, _B, _C, _END, _START = (int(x) for x in random_odd(5, 701))


def cut(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The passage of each word and the first passage of each text. words: hashes; a text has one passage at least, and its end is in the last."""
    n = len(first) - 1
    ends = np.zeros(len(words), bool)
    if len(words):
        ends[1:] = mixed(words[:-1] * U64(_A) + words[1:]) % U64(PLACE) == 0
        ends[first[:-1][np.diff(first) > 0]] = False  # a text's first word follows none
    before = np.concatenate([[0], np.cumsum(ends)])
    count = before[first[1:]] - before[first[:-1]] + 1
    at = np.concatenate([[0], np.cumsum(count)])
    own = before[:-1] - np.repeat(before[first[:-1]], np.diff(first)) + np.repeat(at[:-1], np.diff(first))
    return own, at


def hashes(words: np.ndarray, own: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each passage, and of each with the one before it. own, at: what cut() gives."""
    total = int(at[-1])
    size = np.bincount(own, minlength=total)
    place = np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size)
    sums = np.zeros(total, U64)
    some = np.flatnonzero(size)
    if len(some):
        sums[some] = np.add.reduceat(mixed(words + place.astype(U64) * U64(_B)), (np.cumsum(size) - size)[some])
    last = np.zeros(total, bool)
    last[at[1:] - 1] = True
    seg = mixed(sums + size.astype(U64) + np.where(last, U64(_END), U64(0)))
    prev = np.concatenate([[U64(_START)], seg[:-1]])
    prev[at[:-1]] = U64(_START)
    return seg, mixed(seg * U64(_C) ^ mixed(prev))


def counted(passages: DataFrame, n_passages: int) -> DataFrame:
    """row, seen: for each text with passages that others have, a list of at (2 * passage, and one more for it after the one before) and c (how often in training texts).

    passages: row, idx, training, seg, pair. A hash that is there once needs no count; seg and pair are hashes of their own kinds.
    """
    both = F.array(F.struct((F.col("idx") * 2).alias("at"), F.col("seg").alias("key")), F.struct((F.col("idx") * 2 + 1).alias("at"), F.col("pair").alias("key")))
    keys = passages.select("row", "training", F.explode(both).alias("k")).select("row", "training", "k.*")
    counts = keys.groupBy("key").agg(F.sum(F.col("training").cast("int")).alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1 and c > 0")
    counts = staged(counts, "lm-passage-counts")
    limit = max(1000, 2 * n_passages // HOT)
    hot = F.broadcast(counts.where(F.col("n") > limit).select(F.col("key").alias("hot"), "c"))
    met = keys.join(hot, F.col("key") == F.col("hot")).select("row", "at", "c", "training")
    rest = keys.join(hot, F.col("key") == F.col("hot"), "left_anti").join(counts.where(F.col("n") <= limit).select("key", "c"), "key").select("row", "at", "c", "training")
    without_own = F.col("c") - F.col("training").cast("int")
    seen = met.union(rest).select("row", "at", without_own.alias("c")).where("c > 0")
    return seen.groupBy("row").agg(F.collect_list(F.struct("at", "c")).alias("seen"))  # of one text


def decisions(texts: DataFrame, seen: DataFrame, n_texts: int) -> DataFrame:
    """row, idx, training, cost, c_seg, c_pair, n_prev, came, and the cell (size, last, before) of each passage.

    texts: row, training, costs (of its passages); seen: as counted() gives it. A text's passages stay together.
    """
    whole = texts.join(seen, "row", "left").select("row", "training", "costs", "seen.at", "seen.c")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                row, training = part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                n = pc.list_value_length(part.column(2)).to_numpy()
                told = pc.fill_null(pc.list_value_length(part.column(3)), 0).to_numpy()
                begin = np.cumsum(n) - n
                c = np.zeros(2 * int(n.sum()), np.int64)
                c[part.column(3).flatten().to_numpy() + 2 * np.repeat(begin, told)] = part.column(4).flatten().to_numpy()
                c_seg, c_pair = c[::2], c[1::2]
                came = np.where(c_pair > 0, FOLLOWS, np.where(c_seg > 0, KNOWN, SPELLED)).astype(np.int32)
                text = np.repeat(np.arange(len(n)), n)
                idx = np.arange(len(text)) - begin[text]
                back = lambda x, k, first: np.where(idx >= k, np.concatenate([np.zeros(k, x.dtype), x])[: len(x)], first)
                n_prev = back(c_seg, 1, n_texts - training[text])
                size = np.where(n_prev > 0, np.minimum(SIZES - 1, np.frexp(np.maximum(n_prev, 1).astype(float))[1]), 0)  # powers of two
                cells = [x.astype(np.int32) for x in (back(came, 1, BEGIN), back(came, 2, BEGIN), size)]
                cols = [row[text], idx.astype(np.int32), training[text].astype(bool), part.column(2).flatten(), c_seg, c_pair, n_prev, came, *cells]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["row", "idx", "training", "cost", "c_seg", "c_pair", "n_prev", "came", "last", "before", "size"])
        release()

    return whole.mapInArrow(run, "row long, idx int, training boolean, cost double, c_seg long, c_pair long, n_prev long, came int, last int, before int, size int")


@dataclass
class Bit:
    """The probability of a one in each cell (size, last, before)."""

    p: np.ndarray

    @staticmethod
    def of(ones: np.ndarray, zeros: np.ndarray, rounds: int = 400, step: float = 0.5) -> Bit:
        """From the counts of ones and zeros in each cell: context predictions, gated mixing and refinement."""

        def stretch(axes: tuple[int, ...]) -> np.ndarray:
            a, b = (x.sum(axes, keepdims=True) if axes else x for x in (ones, zeros))
            return np.broadcast_to(np.log((a + 0.4) / (b + 0.4)), ones.shape)

        x = np.stack([stretch((1, 2)), stretch((0,)), stretch((2,)), stretch(()), np.full(ones.shape, 0.3)])
        w = np.zeros((ones.shape[1], len(x)))  # the last passage selects the weights
        w[:, :4] = 0.25
        seen = ones + zeros
        share = seen / np.maximum(1.0, seen.sum((0, 2), keepdims=True))
        rate = np.divide(ones, seen, out=np.zeros(ones.shape), where=seen > 0)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(np.einsum("kslb,lk->slb", x, w), -16, 16)))
            w -= step * np.einsum("kslb,slb->lk", x, share * (p - rate)) / np.maximum(1.0, np.einsum("kslb,slb->lk", x * x, share))
        p = 1 / (1 + np.exp(-np.clip(np.einsum("kslb,lk->slb", x, w), -16, 16)))
        return Bit(np.clip((ones + 20 * p) / (seen + 20), 1e-5, 1 - 1e-5))


def bits_of(told: DataFrame) -> tuple[Bit, Bit]:
    """The bits `follows` and `known`, learned on all passages of training texts."""
    cells = told.where("training").groupBy("size", "last", "before").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("came") == FOLLOWS).alias("f"), F.count_if(F.col("came") == KNOWN).alias("k"))
    n, f, k = (np.zeros((SIZES, 4, 4)) for _ in range(3))
    for r in cells.collect():  # SIZES * 16 rows at most
        n[r["size"], r["last"], r["before"]], f[r["size"], r["last"], r["before"]], k[r["size"], r["last"], r["before"]] = r["n"], r["f"], r["k"]
    # where the passage before has not been seen, the first bit is not told
    first = np.arange(SIZES)[:, None, None] > 0
    return Bit.of(np.where(first, f, 0), np.where(first, n - f, 0)), Bit.of(k, n - f - k)


def passage_scores(told: DataFrame, follows: Bit, known: Bit, n_passages: int) -> DataFrame:
    """told with told_score: log10 of the probability of the bits of a passage, and of the passage itself where it is not spelled."""
    rows = [(*c, math.log10(follows.p[c]), math.log10(1 - follows.p[c]), math.log10(known.p[c]), math.log10(1 - known.p[c])) for c in itertools.product(range(SIZES), range(4), range(4))]
    cells = told.sparkSession.createDataFrame([tuple(map(int, r[:3])) + tuple(map(float, r[3:])) for r in rows], "size int, last int, before int, f1 double, f0 double, k1 double, k0 double")
    out = told.join(F.broadcast(cells), ["size", "last", "before"])  # SIZES * 16 rows
    zero = F.lit(0.0)
    not_next = F.when(F.col("n_prev") > 0, F.col("f0")).otherwise(zero)
    total = F.lit(n_passages) - F.col("training").cast("long")
    by_follow = F.col("f1") + F.log10(F.col("c_pair").cast("double") / F.greatest("n_prev", "c_pair"))
    by_known = not_next + F.col("k1") + F.log10(F.col("c_seg").cast("double") / F.greatest(total, F.col("c_seg")))
    return out.withColumn("told_score", F.when(F.col("came") == FOLLOWS, by_follow).when(F.col("came") == KNOWN, by_known).otherwise(not_next + F.col("k0")))
