"""Language-model scores by logistic context mixing over bits: of passages, and of the words that no passage tells.

A text is a sequence of tokens: its words and one end. They are told in passages of some PLACE words (see passages.py): two
bits say whether a passage followed the one before it in the training texts, or is known from them at all. These bits see
across words, and a text that repeats others costs little. All other passages are spelled.

Each token is spelled byte by byte (a word ends with a space, the end is a line feed), and each bit is predicted from
several hashed contexts: the place in the word, the last one, two, three and five bytes, and all of the word so far, each
with the state, and once more all of the word without it. The state is the class of text that the words before it in the
same text speak for by their endings; classes come from how word endings follow each other in all training texts. Counts
of the contexts of all of the word are exact: words are dealt to ranges of their order, where the words that share a
beginning stand together, and the mass of all other ranges is added along the ranges' ends. The other contexts have hashed
tables, sized by the distinct pairs of context and bit. A context's counts of zeros and ones give one prediction; they are
mixed in the logistic domain with weights that a gate selects by how much the longest contexts have seen, and the mix is
refined by an adaptive table over gate and prediction. Weights and refinement are learned online, step by step over the
training words in the order of a shuffle, each taken as if it had been seen once less and as often as it occurs. All
tokens of all training texts are counted.

Bits depend on the state alone of what precedes a word in its passage, so each word is spelled once for each state it
occurs in. Frequent ones (at most TOP of them, by count) reach all workers in one table; the others meet their tokens in a join.

Edge cases: null and empty texts are their end token alone; a very long text is scored whole; repeated rows get equal
scores; a table without training rows scores with untrained weights; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import math
import pickle
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import passages
from .common import U64, batches_of, hash_spans, mixed, random_odd, release, run_groups, split_words, staged, unstage

#: A word counts as frequent from a 1/TOP of all tokens on, so there are at most TOP of them.
TOP = 1 << 20
#: log2 of the slots of each context's table, at least. The first HASHED grow with the input; the last two, of whole words, are for words outside a range.
BITS, HASHED = (12, 16, 20, 21, 21, 22, 21), 5
ORDERS = len(BITS)
BASE = np.concatenate([[0], np.cumsum([1 << b for b in BITS])]).astype(np.int64)
#: One of so many contexts is looked at to size the tables. Rows of a range, ends drawn for each, bytes of an end, bytes of an Arrow batch of ranges.
SIZED_BY, RANGE_ROWS, DRAWN, END_BYTES, BATCH_BYTES = 64, 10_000, 40, 256, 16 << 20
SLICES, PARTS, WORDS_AT_ONCE = 64, 64, 2048
#: Word endings are hashed to so many; texts are in one of so many classes, and before its first word in none.
ENDINGS, CLASSES = 512, 6
START = CLASSES
GATES, CELLS = 25, 33
END = b"\n"
_C1, _C2 = random_odd(2, 501)
_SALT = random_odd(ORDERS, 503)
_BYTES = random_odd(256, 505)
_PLACES = random_odd(1 << 12, 507)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _end_hash() -> int:
    return int(hash_spans(np.frombuffer(END, np.uint8), np.array([0]), np.array([1]))[0].astype(np.int64))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


_STATES = random_odd(CLASSES + 1, 511)


def endings(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The hashed ending (two bytes) of each word."""
    last = _LOWER[data[stops - 1]].astype(np.int64)
    before = np.where(stops - starts > 1, _LOWER[data[np.maximum(stops - 2, 0)]], 0).astype(np.int64)
    return (mixed((last * 256 + before).astype(U64)) & U64(ENDINGS - 1)).astype(np.int64)


def ending_pairs(docs: DataFrame, training: str) -> np.ndarray:
    """(ENDINGS, ENDINGS) counts of how endings follow each other in all training texts."""

    def run(batches):
        total = np.zeros(ENDINGS * ENDINGS, np.int64)
        for batch, data, offsets in batches_of("text")(batches):
            starts, stops, first = split_words(data, offsets)
            if len(starts) > 1:
                e = endings(data, starts, stops)
                same = np.ones(len(e), bool)
                same[first[:-1][np.diff(first) > 0]] = False
                total += np.bincount((e[:-1] * ENDINGS + e[1:])[same[1:]], minlength=ENDINGS * ENDINGS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    rows = docs.where(F.col(training)).select(F.col("text").cast("string").alias("text")).mapInArrow(run, "pair long, n long")
    found = rows.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most ENDINGS squared rows
    out = np.zeros(ENDINGS * ENDINGS)
    out[found["pair"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(ENDINGS, ENDINGS)


def ending_classes(pairs: np.ndarray, rounds: int = 60, tries: int = 8) -> np.ndarray:
    """(CLASSES, ENDINGS) log probability of an ending in each class: both ends of a pair are drawn from one class."""
    s = pairs + pairs.T
    best, best_fit = np.zeros((CLASSES, ENDINGS)), -np.inf
    if not s.sum():
        return best
    s /= s.sum()
    for seed in range(tries):
        rng = np.random.default_rng(seed)
        phi = (s.sum(0) + 1e-6) * rng.uniform(0.5, 1.5, (CLASSES, ENDINGS))
        phi /= phi.sum(1, keepdims=True)
        share = np.full(CLASSES, 1 / CLASSES)
        for _ in range(rounds):
            model = (phi.T * share) @ phi + 1e-12
            ratio = s / model
            new = share[:, None] * phi * (phi @ ratio)
            share = new.sum(1)
            phi = (new + 1e-9) / (new + 1e-9).sum(1, keepdims=True)
        fit = (s * np.log((phi.T * share) @ phi + 1e-12)).sum()
        if fit > best_fit:
            best, best_fit = np.log(phi + 1e-5), fit
    return best


def states(classes: np.ndarray, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state at each word, and at the end of each text."""
    n = np.diff(first)
    if not len(starts):
        return np.zeros(0, np.int64), np.full(len(n), START)
    sums = np.concatenate([np.zeros((CLASSES, 1)), np.cumsum(classes[:, endings(data, starts, stops)], 1)], 1)
    at = sums[:, :-1] - np.repeat(sums[:, first[:-1]], n, 1)
    own = at.argmax(0)
    own[first[:-1][n > 0]] = START
    end = (sums[:, first[1:]] - sums[:, first[:-1]]).argmax(0)
    end[n == 0] = START
    return own, end


def word_counts(docs: DataFrame, classes: np.ndarray, training: str = "training") -> DataFrame:
    """h (hash of word), z (state), word, c (count in training texts), n (count in all texts), c_word (c in all states), lead (one row of each word). docs: text, and a boolean column."""

    def run(batches):
        held: list[tuple] = []
        size = 0
        ends = np.zeros((2, CLASSES + 1), np.int64)

        def flush():
            h, c, n = (np.concatenate([x[i] for x in held]) for i in range(3))
            words = pa.concat_arrays([x[3] for x in held])
            z = np.concatenate([x[4] for x in held])
            u, at, inv = np.unique(h ^ _STATES[z], return_index=True, return_inverse=True)
            h, z = h[at], z[at]
            held.clear()
            c, n = np.bincount(inv, c, len(u)).astype(np.int64), np.bincount(inv, n, len(u)).astype(np.int64)
            for lo in range(0, len(u), 50_000):
                part = slice(lo, lo + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(h[part])), pa.array(z[part]), words.take(pa.array(at[part])), pa.array(c[part]), pa.array(n[part])], names=["h", "z", "word", "c", "n"])

        for batch, data, offsets in batches_of("text")(batches):
            train = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            starts, stops, first = split_words(data, offsets)
            z, z_end = states(classes, data, starts, stops, first)
            ends += np.stack([np.bincount(z_end, train, CLASSES + 1).astype(np.int64), np.bincount(z_end, minlength=CLASSES + 1)])
            if not len(starts):
                continue
            own = np.repeat(train, np.diff(first))
            h = hash_spans(data, starts, stops)
            u, at, inv = np.unique(h ^ _STATES[z], return_index=True, return_inverse=True)
            lens = (stops - starts)[at]
            o = np.concatenate([[0], np.cumsum(lens)])
            flat = _LOWER[data[np.arange(int(o[-1])) - np.repeat(o[:-1], lens) + np.repeat(starts[at], lens)]]
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(u), [None, pa.py_buffer(o.astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())]).cast(pa.binary())
            held.append((h[at], np.bincount(inv, own, len(u)), np.bincount(inv, minlength=len(u)).astype(float), words, z[at]))
            size += len(u)
            if size > 1_500_000:
                yield from flush()
                size = 0
        if held:
            yield from flush()
        z = np.flatnonzero(ends[1])
        yield pa.RecordBatch.from_arrays([pa.array([_end_hash()] * len(z), pa.int64()), pa.array(z), pa.array([END] * len(z), pa.binary()), pa.array(ends[0, z]), pa.array(ends[1, z])], names=["h", "z", "word", "c", "n"])

    rows = docs.select(F.col("text").cast("string"), F.coalesce(F.col(training), F.lit(False)).alias("training"))
    found = rows.mapInArrow(run, "h long, z long, word binary, c long, n long")
    found = found.groupBy("h", "z").agg(F.min("word").alias("word"), F.sum("c").alias("c"), F.sum("n").alias("n"))
    found = found.groupBy("h").agg(F.min("word").alias("word"), F.sum("c").alias("c_word"), F.collect_list(F.struct("z", "c", "n")).alias("by"))  # a row for each state
    return found.select("h", "word", "c_word", F.posexplode("by").alias("i", "x")).select("h", "x.z", "word", "x.c", "x.n", "c_word", (F.col("i") == 0).alias("lead"))


@dataclass
class Spelling:
    """The bytes of some words with their ends, and what each context says there."""

    data: np.ndarray
    of: np.ndarray  # number of the word
    contexts: np.ndarray  # (ORDERS, bytes) hashes


def spelling(words: list[bytes], z: np.ndarray) -> Spelling:
    ends = [w if w[-1:] in (b" ", END) else w + b" " for w in words]
    lens = np.array([len(w) for w in ends])
    data = np.frombuffer(b"".join(ends), np.uint8)
    first = np.cumsum(lens) - lens
    of = np.repeat(np.arange(len(words)), lens)
    pos = np.arange(len(data)) - first[of]
    places = _PLACES if int(lens.max(initial=1)) <= len(_PLACES) else random_odd(int(lens.max()), 507)
    last = []
    for k in range(1, 6):
        x = np.zeros(len(data), U64)
        x[k:] = data[:-k].astype(U64) + U64(1)
        x[pos < k] = 0
        last.append(x)
    sums = np.cumsum(_BYTES[data] * places[pos], dtype=U64)
    before = np.concatenate([[U64(0)], sums[:-1]]) if len(sums) else sums
    whole = before - before[first][of] if len(data) else before
    c = np.zeros((ORDERS, len(data)), U64)
    c[0] = np.minimum(pos, 15).astype(U64)
    c[1] = last[0]
    c[2] = c[1] + (last[1] << U64(9))
    c[3] = c[2] + (last[2] << U64(18))
    c[4] = c[3] + (last[3] << U64(27)) + (last[4] << U64(36))
    c[5] = c[6] = whole + pos.astype(U64)
    state = _STATES[z][of]
    for k in range(ORDERS):
        c[k] = mixed(c[k] + _SALT[k]) ^ (state if k < 6 else U64(0))
    return Spelling(data, of, c)


def slots_at(s: Spelling, bit: int, bits: tuple[int, ...] = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(tables, bytes) slots for one of the eight bits, and the bits."""
    node = ((1 << bit) | (s.data.astype(np.int64) >> (8 - bit))).astype(U64) * _C1
    out = np.empty((len(bits), len(s.data)), np.int64)
    base = 0
    for k, b in enumerate(bits):
        out[k] = (((s.contexts[k] ^ node) * _C2) >> U64(64 - b)).astype(np.int64) + base
        base += 1 << b
    return out, (s.data >> (7 - bit)) & 1


def table_bits(words: DataFrame) -> tuple[int, ...]:
    """log2 of the slots of each hashed table: as many as there are distinct pairs of context and bit in training words, or more."""

    def run(batches):
        for batch in batches:
            ws, zs = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for lo in range(0, len(ws), 4 * WORDS_AT_ONCE):
                s = spelling(ws[lo : lo + 4 * WORDS_AT_ONCE], zs[lo : lo + 4 * WORDS_AT_ONCE])
                for k in range(HASHED):
                    # the few contexts of low order are all looked at
                    at = np.flatnonzero(s.contexts[k] % U64(SIZED_BY) == 0) if k > 1 else np.arange(len(s.data))
                    c, x = s.contexts[k][at], s.data[at].astype(np.int64)
                    nodes = [(c ^ (((1 << bit) | (x >> (8 - bit))).astype(U64) * _C1)) * _C2 for bit in range(8)]
                    found = _signed(np.unique(np.concatenate(nodes)))
                    for i in range(0, len(found), 50_000):
                        part = found[i : i + 50_000]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k)), pa.array(part)], names=["k", "node"])

    rows = words.select("word", "z").mapInArrow(run, "k long, node long").distinct().groupBy("k").count().collect()  # HASHED rows
    n = {r["k"]: r["count"] * (SIZED_BY if r["k"] > 1 else 1) for r in rows}
    return tuple(max(BITS[k], math.ceil(math.log2(n.get(k, 1)))) for k in range(HASHED))


def full(word: bytes) -> bytes:
    """A word with its end, as it is spelled and ordered."""
    return word if word == END else word + b" "


def common_bits(words: list[bytes]) -> np.ndarray:
    """How many leading bits each word shares with the one before it (0 for the first); no word begins another one."""
    n = len(words)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    data = np.frombuffer(b"".join(words) + b"\0", np.uint8)
    lens = np.array([len(w) for w in words])
    first = np.cumsum(lens) - lens
    shorter = np.minimum(lens[1:], lens[:-1])
    at, pos = np.arange(1, n), 0
    while len(at):
        x = data[first[at] + pos] ^ data[first[at - 1] + pos]
        out[at[x > 0]] = 8 * pos + 8 - np.frexp(x[x > 0].astype(float))[1]
        pos += 1
        done = (x == 0) & (shorter[at - 1] <= pos)
        out[at[done]] = 8 * pos
        at = at[(x == 0) & ~done]
    return out


def masses(near: np.ndarray, z: np.ndarray, c: np.ndarray) -> dict[int, np.ndarray]:
    """The tokens by state, for each number of bits shared with the end of a range."""
    out = {}
    for depth in np.unique(near[c > 0]):
        own = (near == depth) & (c > 0)
        out[int(depth)] = np.bincount(z[own], c[own], CLASSES + 1)
    return out


@dataclass
class Range:
    """Words of one range in order, a row for each state: h, z, c, n, c_word, the words with their ends and the masses at both sides."""

    words: list[bytes]
    h: np.ndarray
    z: np.ndarray
    c: np.ndarray
    n: np.ndarray
    c_word: np.ndarray


def read_range(batch: pa.RecordBatch, i: int) -> Range:
    get = lambda k: np.frombuffer(batch.column(batch.schema.get_field_index(k))[i].as_py(), np.int64)
    data, stops = batch.column(batch.schema.get_field_index("data"))[i].as_py(), np.cumsum(get("lens")).tolist()
    return Range([data[a:b] for a, b in zip([0, *stops], stops)], *(get(k) for k in ("h", "z", "c", "n", "c_word")))


def word_ranges(words: DataFrame, n_rows: int) -> tuple[DataFrame, dict]:
    """A row for each range of the words' order, and for each range the (word, tokens by state) that stand for all words outside it."""
    ends: list[bytes] = []
    if n_rows > RANGE_ROWS:
        drawn = words.where(F.pmod(F.xxhash64("h"), F.lit(max(1, RANGE_ROWS // DRAWN))) == 0).select("word").toArrow()["word"].to_pylist()  # DRAWN for each range
        ends = sorted({full(w)[:END_BYTES] for w in sorted(drawn, key=full)[DRAWN::DRAWN]})

    def place(batches):
        for batch in batches:
            g = np.array([bisect.bisect_right(ends, full(w)) for w in batch.column(2).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(g), *batch.columns], names=["g", *batch.schema.names])

    def pack(group: pa.Table) -> pa.Table:
        g = group["g"][0].as_py()
        ws, z = [full(w) for w in group["word"].to_pylist()], group["z"].to_numpy()
        order = sorted(range(len(ws)), key=lambda i: (ws[i], z[i]))
        ws, cols = [ws[i] for i in order], {k: group[k].to_numpy()[order] for k in ("h", "z", "c", "n", "c_word")}
        out = {"g": pa.array([g]), "data": pa.array([b"".join(ws)], pa.binary()), "lens": pa.array([np.array([len(w) for w in ws], np.int64).tobytes()], pa.binary())}
        out |= {k: pa.array([np.ascontiguousarray(v, np.int64).tobytes()], pa.binary()) for k, v in cols.items()}
        # the bits shared with an end are the least bits that neighbours share on the way there
        for side, end in (("left", ends[g - 1] if g else None), ("right", ends[g] if g < len(ends) else None)):
            found = {}
            if end is not None:
                way = [end, *ws] if side == "left" else [*ws, end]
                same = np.array([False] + [a == b for a, b in zip(way, way[1:])])
                shared = np.where(same, 1 << 40, common_bits(way))[1:]
                near = np.minimum.accumulate(shared) if side == "left" else np.minimum.accumulate(shared[::-1])[::-1]
                found = masses(np.minimum(near, 8 * len(end)), cols["z"], cols["c"])
            out[side] = pa.array([pickle.dumps(found)], pa.binary())
        return pa.table(out)

    names = ["g", "data", "lens", "h", "z", "c", "n", "c_word", "left", "right"]
    schema = "g long, " + ", ".join(f"{k} binary" for k in names[1:])
    placed = words.select("h", "z", "word", "c", "n", "c_word").mapInArrow(place, "g long, h long, z long, word binary, c long, n long, c_word long")
    ranges = staged(run_groups(placed, ["g"], pack, schema), "lm-ranges")
    sides = {r["g"]: (pickle.loads(r["left"]), pickle.loads(r["right"])) for r in ranges.select("g", "left", "right").collect()}  # a row for each range
    outside: dict[int, list] = {g: [] for g in range(len(ends) + 1)}
    shared = lambda a, b: int(common_bits([a, b])[1])
    held: dict[int, np.ndarray] = {}
    for g in range(1, len(ends) + 1):  # all words before this range, by the bits shared with its first end
        moved: dict[int, np.ndarray] = {}
        if g > 1:
            q = shared(ends[g - 2], ends[g - 1])
            for depth, mass in held.items():
                moved[min(depth, q)] = moved.get(min(depth, q), 0) + mass
        for depth, mass in sides.get(g - 1, ({}, {}))[1].items():
            moved[depth] = moved.get(depth, 0) + mass
        held = moved
        outside[g] += [(beginning(ends[g - 1], depth, 0), mass) for depth, mass in held.items()]
    held = {}
    for g in range(len(ends) - 1, -1, -1):  # all words after it
        moved = {}
        if g < len(ends) - 1:
            q = shared(ends[g], ends[g + 1])
            for depth, mass in held.items():
                moved[min(depth, q)] = moved.get(min(depth, q), 0) + mass
        for depth, mass in sides.get(g + 1, ({}, {}))[0].items():
            moved[depth] = moved.get(depth, 0) + mass
        held = moved
        outside[g] += [(beginning(ends[g], depth, 1), mass) for depth, mass in held.items()]
    return ranges.drop("left", "right"), outside


def beginning(end: bytes, depth: int, bit: int) -> bytes:
    """The first bits of an end, and one more bit; the end itself where no bits are left."""
    if depth >= 8 * len(end):
        return end
    out = bytearray(end[: depth // 8 + 1])
    place = 7 - depth % 8
    out[-1] = (out[-1] >> (place + 1) << (place + 1)) | bit << place
    return bytes(out)


def whole_counts(r: Range, outside: list) -> tuple[np.ndarray, np.ndarray]:
    """(2, bytes, 8) exact training counts of the bit that each word has and of the other one, after the same beginning: in the word's state, and in all states."""
    kinds = CLASSES + 2
    names = sorted({*r.words, *(w for w, _ in outside)})
    number = {w: i for i, w in enumerate(names)}
    of = np.array([number[w] for w in r.words], np.int64)
    own = np.zeros((len(names), kinds))
    np.add.at(own, (of, r.z), r.c)
    for w, mass in outside:
        own[number[w], :-1] += mass
    own[:, -1] = own[:, :-1].sum(1)
    before = np.concatenate([np.zeros((1, kinds)), np.cumsum(own, 0)])
    shared = common_bits(names)
    lens = np.array([len(w) for w in r.words])
    first = 8 * (np.cumsum(lens) - lens)
    other = np.zeros((2, 8 * int(lens.sum())))
    rows = np.arange(len(of))
    lo, hi = np.zeros(1, np.int64), np.array([len(names)])
    while len(lo):  # words that share a beginning: they part at the least bits that neighbours share
        keep = hi - lo > 1
        lo, hi = lo[keep], hi[keep]
        if not len(lo):
            break
        size = hi - lo - 1
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo + 1, size)
        least = np.minimum.reduceat(shared[at], np.cumsum(size) - size)
        mid = at[shared[at] == np.repeat(least, size)]
        node = np.searchsorted(lo, of[rows], "right") - 1
        inside = (node >= 0) & (of[rows] < hi[np.maximum(node, 0)])
        rows, node = rows[inside], node[inside]
        sides = np.stack([before[mid] - before[lo], before[hi] - before[mid]])
        far = 1 - (of[rows] >= mid[node])
        to = first[rows] + least[node]
        other[0, to], other[1, to] = sides[far, node, r.z[rows]], sides[far, node, -1]
        lo, hi = np.stack([lo, mid], 1).ravel(), np.stack([mid, hi], 1).ravel()
    total = np.stack([before[-1, r.z], before[-1, np.full(len(of), kinds - 1)]])
    gone = np.cumsum(other, 1)
    gone -= np.repeat(gone[:, first] - other[:, first], 8 * lens, 1)
    same = np.repeat(total, 8 * lens, 1) - gone
    return same.reshape(2, -1, 8), other.reshape(2, -1, 8)


def context_counts(words: DataFrame, bits: tuple[int, ...]) -> np.ndarray:
    """Counts of zeros (low half) and ones (high half) of each slot, as uint32: made smaller together where one of them would not fit."""
    width = -(-sum(1 << b for b in bits) // SLICES)

    def run(batches):
        counts = np.zeros(2 * SLICES * width, np.float32)
        for batch in batches:
            ws, cs, zs = batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(np.float32), batch.column(2).to_numpy()
            for lo in range(0, len(ws), 4 * WORDS_AT_ONCE):
                s = spelling(ws[lo : lo + 4 * WORDS_AT_ONCE], zs[lo : lo + 4 * WORDS_AT_ONCE])
                c = cs[lo : lo + 4 * WORDS_AT_ONCE][s.of]
                for bit in range(8):
                    at, y = slots_at(s, bit, bits)
                    at = 2 * at + y
                    for k in range(len(bits)):
                        np.add.at(counts, at[k], c)
        counts = counts.reshape(-1, 2)
        for i in range(SLICES):
            part = counts[i * width : (i + 1) * width]
            at = np.flatnonzero(part.any(1)).astype(np.int32)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([at.tobytes()], pa.binary()), pa.array([part[at].tobytes()], pa.binary())], names=["slice", "at", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros((width, 2), np.float64)
        for at, part in zip(group["at"].to_pylist(), group["counts"].to_pylist(), strict=True):
            at = np.frombuffer(at, np.int32)
            total[at] += np.frombuffer(part, np.float32).reshape(-1, 2)
        big = np.maximum(1.0, total.max(1, keepdims=True) / 65535)
        out = np.where(total > 0, np.maximum(np.floor(total / big), 1), 0).astype("<u2")
        return pa.table({"slice": pa.array([group["slice"][0].as_py()]), "counts": pa.array([out.tobytes()], pa.binary())})

    parts = words.select("word", "c", "z").coalesce(PARTS).mapInArrow(run, "slice long, at binary, counts binary")
    out = np.zeros(SLICES * width, np.uint32)
    for row in run_groups(parts, ["slice"], add, "slice long, counts binary").collect():  # the model: SLICES rows
        out[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["counts"], "<u4")
    return out


@dataclass
class Mixer:
    counts: np.ndarray
    weights: np.ndarray  # (GATES, ORDERS + 1)
    ones: np.ndarray  # (GATES, CELLS) of the refinement
    seen: np.ndarray
    bits: tuple[int, ...]

    def __getstate__(self):  # most slots are empty on small inputs
        return self.__dict__ | {"counts": zlib.compress(self.counts.tobytes(), 1)}

    def __setstate__(self, state):
        self.__dict__.update(state | {"counts": np.frombuffer(zlib.decompress(state["counts"]), np.uint32)})


def new_mixer(counts: np.ndarray, scale: float, bits: tuple[int, ...] = BITS) -> Mixer:
    """Untrained weights times scale. bits: of the tables in counts."""
    # more weight on the whole word, the more of it has been seen; by level of the whole word, then of the last five bytes
    w = np.zeros((5, 5, ORDERS + 1))
    w[0, :, :5] = [0.0, 0.05, 0.1, 0.3, 0.6]
    w[0, :, 6] = 0.1
    for level, (five, whole, bare) in enumerate([(0.4, 0.4, 0.1), (0.2, 0.75, 0.05), (0.05, 0.95, 0.0), (0.0, 1.0, 0.0)], 1):
        w[level, :, 4:7] = five, whole, bare
    return Mixer(counts, scale * w.reshape(GATES, ORDERS + 1), np.zeros((GATES, CELLS)), np.zeros((GATES, CELLS)), bits)


def _level(n: np.ndarray) -> np.ndarray:
    return (n > 0).astype(np.int64) + (n > 2) + (n > 15) + (n > 200)


def bit_inputs(m: Mixer, at: np.ndarray, y: np.ndarray | None, known: np.ndarray, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ORDERS + 1, bytes) stretched predictions and the gates. With y each count is taken without one sight of y.

    whole: the counts of zeros and of ones in the contexts of whole words, where the tables do not have them.
    """
    both = m.counts[at]
    n0, n1 = (both & np.uint32(0xFFFF)).astype(np.float32), (both >> np.uint32(16)).astype(np.float32)
    if whole is not None:
        n0, n1 = np.concatenate([n0, whole[0]]), np.concatenate([n1, whole[1]])
    if y is not None:
        n0 -= (y == 0) & (n0 > 0)
        n1 -= (y == 1) & (n1 > 0)
    n0[-2:, ~known] = 0
    n1[-2:, ~known] = 0
    x = np.log((n1 + 0.4) / (n0 + 0.4))
    total = n0[4:6] + n1[4:6]
    return np.concatenate([x, np.full((1, x.shape[1]), 0.3, np.float32)]), _level(total[1]) * 5 + _level(total[0])


def mix(m: Mixer, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
    return np.clip(np.einsum("kn,nk->n", x, m.weights[gate].astype(np.float32)), -11, 11)


def refined(m: Mixer, s: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """The final probability of a one, from the mix s in the logistic domain."""
    cell = (s + 11) * ((CELLS - 1) / 22)
    lo = np.minimum(cell.astype(np.int64), CELLS - 2)
    part = cell - lo
    centre = 1 / (1 + np.exp(-(np.arange(CELLS) * (22 / (CELLS - 1)) - 11)))
    table = (m.ones + 20 * centre) / (m.seen + 20)
    p = table[gate, lo] * (1 - part) + table[gate, lo + 1] * part
    return np.clip((1 / (1 + np.exp(-s)) + p) / 2, 1e-6, 1 - 1e-6)


def sides_of(same: np.ndarray, other: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(2, 2, bytes) counts of zeros and of ones, from those of the bits y and of their opposites."""
    return np.stack([np.where(y == 0, same, other), np.where(y == 0, other, same)]).astype(np.float32)


def learn(ranges: DataFrame, outside: dict, m: Mixer) -> Mixer:
    """Weights and refinement, learned online over all training words in each part; parts are averaged by their tokens."""
    sent, around = (ranges.sparkSession.sparkContext.broadcast(x) for x in (m, outside))

    def run(batches):
        own = Mixer(sent.value.counts, sent.value.weights.copy(), np.zeros((GATES, CELLS)), np.zeros((GATES, CELLS)), sent.value.bits)
        m1, m2, step, tokens = np.zeros_like(own.weights), np.zeros_like(own.weights), 0, 0.0
        for r, same, other, first in with_counts(batches, around.value):
            rows = np.flatnonzero(r.c > 0)
            np.random.default_rng(len(rows)).shuffle(rows)
            for lo in range(0, len(rows), WORDS_AT_ONCE):
                part = rows[lo : lo + WORDS_AT_ONCE]
                s = spelling([r.words[i] for i in part], r.z[part])
                at_byte = np.arange(len(s.data)) - np.searchsorted(s.of, s.of) + first[part][s.of]
                c = r.c[part].astype(np.float64)[s.of]
                tokens += r.c[part].sum()
                weight = c / c.sum()
                for bit in range(8):
                    at, y = slots_at(s, bit, own.bits)
                    x, gate = bit_inputs(own, at, y, np.ones(len(y), bool), sides_of(same[:, at_byte, bit], other[:, at_byte, bit], y))
                    z = mix(own, x, gate)
                    cell = np.rint((z + 11) * ((CELLS - 1) / 22)).astype(np.int64) + gate * CELLS
                    own.ones += np.bincount(cell, c * y, GATES * CELLS).reshape(GATES, CELLS)
                    own.seen += np.bincount(cell, c, GATES * CELLS).reshape(GATES, CELLS)
                    d = (1 / (1 + np.exp(-z)) - y) * weight
                    g = np.stack([np.bincount(gate, d * row, GATES) for row in x], 1)
                    step += 1
                    m1 += 0.1 * (g - m1)
                    m2 += 0.02 * (g * g - m2)
                    own.weights -= 0.015 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.98**step)) + 1e-5)
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([tokens])] + [pa.array([a.astype(np.float64).tobytes()], pa.binary()) for a in (own.weights, own.ones, own.seen)], names=["tokens", "weights", "ones", "seen"])

    rows = ranges.coalesce(PARTS).mapInArrow(run, "tokens double, weights binary, ones binary, seen binary").collect()  # a row for each part
    if not rows:
        return m
    total = sum(r["tokens"] for r in rows)
    get = lambda r, k, shape: np.frombuffer(r[k], np.float64).reshape(shape)
    weights = sum(get(r, "weights", (GATES, ORDERS + 1)) * (r["tokens"] / total) for r in rows)
    ones, seen = (sum(get(r, k, (GATES, CELLS)) for r in rows) for k in ("ones", "seen"))
    return Mixer(m.counts, weights, ones, seen, m.bits)


def with_counts(batches, outside: dict):
    """Each range with the counts of whole words and the first byte of each of its rows."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = read_range(batch, i)
            lens = np.array([len(w) for w in r.words])
            yield r, *whole_counts(r, outside[batch.column(0)[i].as_py()]), np.cumsum(lens) - lens
    release()


def spell_costs(m: Mixer, r: Range, same: np.ndarray, other: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 probability of each word of a range in its state."""
    out = np.zeros(len(r.words))
    for lo in range(0, len(r.words), 4 * WORDS_AT_ONCE):
        own = slice(lo, lo + 4 * WORDS_AT_ONCE)
        s = spelling(r.words[own], r.z[own])
        n, here = len(r.words[own]), slice(first[lo], first[lo] + len(s.data))
        for bit in range(8):
            at, y = slots_at(s, bit, m.bits)
            x, gate = bit_inputs(m, at, None, np.ones(len(y), bool), sides_of(same[:, here, bit], other[:, here, bit], y))
            p = refined(m, mix(m, x, gate), gate)
            out[lo : lo + n] += np.bincount(s.of, np.log10(np.where(y == 1, p, 1 - p)), n)
    return out


def scores(docs: DataFrame, training: str = "training") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each document. docs: doc_id, text and the boolean column."""
    spark = docs.sparkSession
    classes = ending_classes(ending_pairs(docs, training))
    words = staged(word_counts(docs, classes, training), "lm-words")
    total = words.agg(F.sum("c"), F.sum("n"), F.sum((F.col("lead") & (F.col("c_word") > 0)).cast("long")), F.count(F.lit(1))).first()
    n_train, n_all, v, n_rows = (int(x or 0) for x in total)
    trained = words.where("c > 0")
    bits = table_bits(trained)
    counts = context_counts(trained, bits)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, min(BATCH_BYTES, int(spark.conf.get(key, str(BATCH_BYTES)).lower().rstrip("b"))))
    ranges, outside = word_ranges(words, n_rows)
    unstage(words)
    model = learn(ranges, outside, new_mixer(counts, 1.0, bits))
    sent, around = (spark.sparkContext.broadcast(x) for x in (model, outside))
    norm = math.log10(n_train + v + 1)

    def cost(batches):
        for r, same, other, first in with_counts(batches, around.value):
            p = spell_costs(sent.value, r, same, other, first)
            key = _signed(r.h.view(U64) ^ _STATES[r.z])
            for lo in range(0, len(p), 50_000):
                part = slice(lo, lo + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in (key, r.c_word, r.n, np.log10(r.c_word + 1.0) - norm, p)], names=["h", "c", "n", "base", "cost"])

    priced = staged(ranges.mapInArrow(cost, "h long, c long, n long, base double, cost double"), "lm-costs")
    top = priced.where(F.col("n") >= n_all / TOP).select("h", "c", "base", "cost").toArrow().sort_by("h")  # at most TOP rows: their counts add up to n_all at most
    table = spark.sparkContext.broadcast(tuple(top[k].to_numpy() for k in ("h", "c", "base", "cost")))

    def add(batches):
        h, c, base, price = table.value
        row = TaskContext.get().partitionId() << 40
        for batch, data, offsets in batches_of("text")(batches):
            starts, stops, first = split_words(data, offsets)
            n = len(first) - 1
            z, z_end = states(classes, data, starts, stops, first)
            doc = np.concatenate([np.repeat(np.arange(n), np.diff(first)), np.arange(n)])
            words = hash_spans(data, starts, stops)
            passage, begins = passages.cut(words, first)
            seg, pair = passages.hashes(words, passage, begins)
            passage = np.concatenate([passage, begins[1:] - 1])  # a text's end is in its last passage
            own = _signed(np.concatenate([words, np.full(n, _end_hash()).view(U64)]) ^ _STATES[np.concatenate([z, z_end])])
            at = np.minimum(np.searchsorted(h, own), max(0, len(h) - 1))
            hit = h[at] == own if len(h) else np.zeros(len(own), bool)
            d, a = doc[hit], at[hit]
            known = np.bincount(d, c[a] > 0, n).astype(np.int64)
            cost = np.bincount(passage[hit], price[a], int(begins[-1]))
            order = np.argsort(doc[~hit], kind="stable")
            place = (passage - begins[doc])[~hit][order].astype(np.int32)
            rest = pa.StructArray.from_arrays([pa.array(place), pa.array(own[~hit][order])], names=["idx", "h"])
            lens = np.bincount(doc[~hit], minlength=n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), rest)
            parts = pa.StructArray.from_arrays([pa.array(_signed(seg)), pa.array(_signed(pair)), pa.array(cost)], names=["seg", "pair", "cost"])
            parts = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), parts)
            ids = pa.array(np.arange(row, row + n))
            row += n
            yield pa.RecordBatch.from_arrays([ids, batch.column(0), batch.column(2), pa.array(np.diff(first) + 1), pa.array(np.diff(offsets)), pa.array(known), pa.array(np.bincount(d, base[a], n)), parts, lists], names=["row", "doc_id", "training", "n_tokens", "n_bytes", "n_known", "base", "passages", "rest"])

    schema = "row long, doc_id long, training boolean, n_tokens long, n_bytes long, n_known long, base double, passages array<struct<seg:long,pair:long,cost:double>>, rest array<struct<idx:int,h:long>>"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.col(training), F.lit(False)).alias("training"))
    part = staged(rows.mapInArrow(add, schema), "lm-documents")
    n_all_passages, n_passages, n_texts = (int(x or 0) for x in part.agg(F.sum(F.size("passages")), F.sum(F.when(F.col("training"), F.size("passages"))), F.count_if("training")).first())
    each = part.select("row", "training", F.posexplode("passages").alias("idx", "p")).select("row", "idx", "training", "p.*")
    texts = part.select("row", "training", F.transform("passages", lambda p: p["cost"]).alias("costs"))
    told = staged(passages.decisions(texts, passages.counted(each, n_all_passages), n_texts), "lm-told")
    scored = passages.passage_scores(told, *passages.bits_of(told), n_passages)
    spelled = F.col("came") == passages.SPELLED
    by_row = scored.groupBy("row").agg(F.sum("told_score").alias("told"), F.sum(F.when(spelled, F.col("cost"))).alias("cost"), F.collect_list(F.when(~spelled, F.col("idx"))).alias("not_spelled"))  # of one text
    by_row = staged(by_row, "lm-rows")
    rest = part.select("row", "rest").join(by_row.where(F.size("not_spelled") > 0).select("row", "not_spelled"), "row", "left")
    rest = rest.select("row", "not_spelled", F.explode("rest").alias("r")).select("row", "r.h", (~F.coalesce(F.array_contains("not_spelled", F.col("r.idx")), F.lit(False))).alias("counts"))
    rest = rest.join(priced.where(F.col("n") < n_all / TOP), "h")
    rest = rest.groupBy("row").agg(F.sum((F.col("c") > 0).cast("long")).alias("k"), F.sum("base").alias("b"), F.sum(F.when(F.col("counts"), F.col("cost"))).alias("s"))
    zero = F.lit(0.0)
    out = part.drop("passages", "rest", "training").join(by_row.drop("not_spelled"), "row").join(rest, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero)).alias("base_score"),
        (F.col("told") + F.coalesce("cost", zero) + F.coalesce("s", zero)).alias("score"),
        "n_bytes",
    )
    return out.withColumn("bits_per_byte", F.try_divide(-F.col("score") * math.log2(10), F.col("n_bytes"))).drop("n_bytes")
