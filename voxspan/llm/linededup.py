"""Line deduplication by a segment-partition edit join.

Lines (stripped of blanks at both ends) within edit distance tau of each other share a segment: a line of length l is cut
into tau + 1 segments, and a line that is at most tau longer has one of them at a place that its number and the
difference in length allow. So segments are posted under (length, number, hash), each line probes the substrings that
can match, and what meets is verified by a banded bit-parallel edit distance over code points.

A distinct line takes part once; lines are told apart by a cryptographic digest of 128 bits of their whole text, near ones
by their texts. Of equal lines only the first occurrence stays, by doc_id, hash of the document's text and line number;
a line with a near copy that occurs earlier goes everywhere. Lines under min_chars code points always stay.

Edge cases: null texts stay null and empty ones empty; rows with equal doc_id and text count as one document, so none of
them loses lines to the other; a null doc_id comes before all others; other columns are passed on, but for n_lines and
n_removed, which are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import text_slices
from .common import U64, block_pairs, mixed, random_odd, release, run_groups, staged

TAU, MIN_CHARS, FEW_LINES, BLOCK_LINES = 2, 20, 24, 1024
#: Up to so many rows of candidate hashes, or bytes of line numbers, are sent to all tasks; more are joined by a shuffle.
SEND_ROWS, SEND_BYTES = 500_000, 48_000_000

#: Code points that count as blank.
_BLANKS = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_BLANK_TEXT = "".join(map(chr, _BLANKS.tolist()))
_SOLID = np.ones(int(_BLANKS.max()) + 2, bool)  # by code point; all after the last blank are like the one after it
_SOLID[_BLANKS] = False
_G = int(random_odd(1, 601)[0])
_G_INVERSE = pow(_G, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables = [_powers(_G, 1 << 16), _powers(_G_INVERSE, 1 << 16)]


def digest(points: bytes) -> bytes:
    """Of a line as UTF-32."""
    return hashlib.blake2b(points, digest_size=16).digest()


class Lines:
    """The lines of some texts, as spans of one array of code points."""

    def __init__(self, texts: list[str]):
        self.raw = "\n".join(texts).encode("utf-32-le", "surrogatepass")
        self.points = np.frombuffer(self.raw, np.uint32)
        cuts = np.flatnonzero(self.points == 10)
        self.per_text = np.array([t.count("\n") + 1 for t in texts])
        begin, end = np.concatenate([[0], cuts + 1]), np.append(cuts, len(self.points))
        solid = np.flatnonzero(_SOLID[np.minimum(self.points, len(_SOLID) - 1)])
        lo, hi = np.searchsorted(solid, begin), np.searchsorted(solid, end)
        some = hi > lo
        self.start = begin.copy()
        self.start[some] = solid[lo[some]]
        self.length = np.zeros(len(begin), np.int64)
        self.length[some] = solid[hi[some] - 1] + 1 - self.start[some]
        self.number = np.arange(len(begin)) - np.repeat(np.cumsum(self.per_text) - self.per_text, self.per_text)

    @cached_property
    def sums(self) -> np.ndarray:
        """What hashes() takes differences of; digests need none."""
        if len(self.points) >= len(_tables[0]):
            _tables[:] = [_powers(_G, 2 * len(self.points)), _powers(_G_INVERSE, 2 * len(self.points))]
        terms = mixed(self.points.astype(U64) + U64(0x51ED27)) * _tables[0][: len(self.points)]
        return np.concatenate([[U64(0)], np.cumsum(terms, dtype=U64)])

    def hashes(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hash of the code points at each span; equal wherever it stands. For candidates only: different spans may share it."""
        return (self.sums[start + length] - self.sums[start]) * _tables[1][start]

    def digests(self, own) -> np.ndarray:
        """(lines, 2) longs of a cryptographic digest of each line."""
        start = 4 * self.start[own]
        spans = zip(start.tolist(), (start + 4 * self.length[own]).tolist())
        return np.frombuffer(b"".join([digest(self.raw[s:e]) for s, e in spans]), "<i8").reshape(-1, 2)

    def said(self, own) -> list[str]:
        return [self.points[s : s + n].tobytes().decode("utf-32-le", "surrogatepass") for s, n in zip(self.start[own].tolist(), self.length[own].tolist())]


def segment(l: np.ndarray, i: int, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i (from 0) of lines of length l: the longer segments come last."""
    q, r = l // (tau + 1), l % (tau + 1)
    longer = np.maximum(i - (tau + 1 - r), 0)
    return i * q + longer, q + (i >= tau + 1 - r)


def keys_of(lines: Lines, own: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """(lines, tau + 1) keys to post and (lines, probes) keys to probe; a probe that does not fit repeats the first post key of its length."""
    start, length = lines.start[own], lines.length[own]

    def key(l, i, at, n):
        return mixed(mixed(lines.hashes(at, n) + n.astype(U64)) ^ (l.astype(U64) * U64(64) + U64(i)))

    post, probe = [], []
    for i in range(tau + 1):
        p, n = segment(length, i, tau)
        post.append(key(length, i, start + p, n))
    for d in range(tau + 1):
        l = length - d
        for i in range(tau + 1):
            p, n = segment(l, i, tau)
            # the shifts that both the edits left of the segment and those right of it allow
            for shift in range(max(-i, d - (tau - i)), min(i, d + (tau - i)) + 1):
                at = np.clip(p + shift, 0, length - n)
                probe.append(key(l, i, start + at, n))
    return np.stack(post, 1), np.stack(probe, 1)


def within(a: list[str], b: list[str], tau: int) -> np.ndarray:
    """Whether the edit distance of each pair is at most tau (tau < 32).

    A register of vertical differences slides down the diagonal; only its top 2 * tau + 1 bits, the band, see matches.
    """
    n = len(a)
    longer = [x if len(x) >= len(y) else y for x, y in zip(a, b, strict=True)]
    shorter = [y if len(x) >= len(y) else x for x, y in zip(a, b, strict=True)]
    l1, l2 = np.array([len(x) for x in longer]), np.array([len(x) for x in shorter])
    out = np.zeros(n, bool)
    order = np.argsort(l1, kind="stable")
    lo = 0
    while lo < n:  # shorter pairs first; a batch is bounded in cells
        hi = min(n, lo + 2048)
        while hi - lo > 1 and (hi - lo) * l1[order[hi - 1]] > 2_000_000:
            hi = lo + (hi - lo) // 2
        rows, lo = order[lo:hi], hi
        m1, m2 = l1[rows], l2[rows]
        width = int(m1.max(initial=0)) + 2 * tau + 1
        p = np.full((len(rows), width + tau), 0xFFFFFFFF, np.uint32)
        t = np.full((len(rows), width), 0xFFFFFFFE, np.uint32)
        for k, r in enumerate(rows):
            p[k, tau : tau + l1[r]] = np.frombuffer(longer[r].encode("utf-32-le", "surrogatepass"), np.uint32)
            t[k, : l2[r]] = np.frombuffer(shorter[r].encode("utf-32-le", "surrogatepass"), np.uint32)
        p, t = np.ascontiguousarray(p.T), np.ascontiguousarray(t.T)
        one = U64(1)
        vp = np.full(len(rows), (0xFFFFFFFFFFFFFFFF << (63 - tau)) & 0xFFFFFFFFFFFFFFFF, U64)
        vn = np.zeros(len(rows), U64)
        dist = np.full(len(rows), tau)
        for i in range(int(m2.max(initial=0))):
            x = np.zeros(len(rows), U64)
            for d in range(-tau, tau + 1):
                x |= (p[i + tau + d] == t[i]).astype(U64) << U64(63 - tau + d)
            d0 = (((x & vp) + vp) ^ vp) | x | vn
            hp = vn | ~(d0 | vp)
            hn = d0 & vp
            live = i < m2
            below = i < m1 - tau
            step = np.where(below, 1 - (d0 >> U64(63)).astype(np.int64), 0)
            bit = np.clip(62 - (i - (m1 - tau)), 0, 63).astype(U64)
            side = ((hp >> bit) & one).astype(np.int64) - ((hn >> bit) & one).astype(np.int64)
            dist = dist + np.where(live, np.where(below, step, side), 0)
            down = d0 >> one
            vp = np.where(live, hn | ~(down | hp), vp)
            vn = np.where(live, down & hp, vn)
        # lines no longer than tau never leave the first column
        out[rows] = np.where(m1 <= tau, np.maximum(m1, m2) <= tau, dist <= tau) & (m1 - m2 <= tau)
    return out


def line_rows(docs: DataFrame, tau: int, min_chars: int) -> DataFrame:
    """doc_id, t (hash of the text), line (number), h and g (digest), keys (what to post, then what to probe; 8 bytes each) for each line of min_chars or more."""

    def run(batches):
        for batch in batches:
            for lo, texts in text_slices(batch, 1, 500_000):
                lines = Lines(texts)
                own = np.flatnonzero(lines.length >= max(min_chars, tau + 1))
                of = pa.array(np.repeat(np.arange(len(texts)), lines.per_text)[own])
                ids, t = (batch.column(i).slice(lo, len(texts)).take(of) for i in (0, 2))
                h = lines.digests(own)
                keys = np.ascontiguousarray(np.concatenate(keys_of(lines, own, tau), 1)).astype("<u8")
                blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * keys.shape[1]), len(own), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([ids, t, pa.array(lines.number[own].astype(np.int32)), pa.array(h[:, 0]), pa.array(h[:, 1]), blob], names=["doc_id", "t", "line", "h", "g", "keys"])
        release()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("t", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, t long, line int, h long, g long, keys binary")


def posted(classes: DataFrame, tau: int, probes: bool) -> DataFrame:
    """key, h: the keys that each distinct line posts, or those it probes."""

    def run(batches):
        for batch in batches:
            h = batch.column(0).to_numpy()
            if not len(h):
                continue
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8").reshape(len(h), -1)
            keys = keys[:, tau + 1 :] if probes else keys[:, : tau + 1]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(h, keys.shape[1]))], names=["key", "h"])

    return classes.select("h", "keys").mapInArrow(run, "key long, h long")


def _texts_of(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """h, g, line text of the wanted digests (h), of lines of `least` code points or more."""

    def run(batches):
        for batch in batches:
            for _, texts in text_slices(batch, 0, 500_000):
                lines = Lines(texts)
                own = np.flatnonzero(lines.length >= least)
                h = lines.digests(own)
                _, at = np.unique(h[:, 0] ^ h[:, 1] << 1, return_index=True) if len(own) else (None, own)
                yield pa.RecordBatch.from_arrays([pa.array(h[at, 0]), pa.array(h[at, 1]), pa.array(lines.said(own[at]), pa.string())], names=["h", "g", "said"])
        release()

    every = docs.select(F.col("text").cast("string")).where("text is not null").mapInArrow(run, "h long, g long, said string")
    few = wanted.count() <= SEND_ROWS
    return every.join(F.broadcast(wanted) if few else wanted, "h").groupBy("h", "g").agg(F.min("said").alias("said"))  # equal texts


def later_of(said: list[str], posts: np.ndarray, side: np.ndarray | None, tau: int) -> np.ndarray:
    """Whether each line has one before it within tau, one of the two being posted and, with sides, both from different ones."""
    n = len(said)
    length = np.array([len(x) for x in said])
    goes = np.zeros(n, bool)
    ahead = np.zeros(n, np.int64)  # the next earlier line to compare with
    while True:
        pairs_i, pairs_j = [], []
        for j in np.flatnonzero(~goes & (ahead < np.arange(n))):
            k = np.arange(ahead[j], min(j, ahead[j] + 4 + ahead[j]))  # more at a time, the longer it takes
            ahead[j] = k[-1] + 1
            ok = (np.abs(length[k] - length[j]) <= tau) & (posts[k] | posts[j])
            if side is not None:
                ok &= side[k] != side[j]
            k = k[ok]
            pairs_i.append(k)
            pairs_j.append(np.full(len(k), j))
        if not pairs_i:
            return goes
        i, j = np.concatenate(pairs_i), np.concatenate(pairs_j)
        for lo in range(0, len(i), 16_384):
            a, b = i[lo : lo + 16_384], j[lo : lo + 16_384]
            goes[b[within([said[x] for x in a], [said[x] for x in b], tau)]] = True


def near_lines(docs: DataFrame, classes: DataFrame, tau: int, least: int = 1) -> DataFrame:
    """h, g of the distinct lines that have a line within tau whose first occurrence is earlier.

    Keys that one line alone has are left out first. Candidates are known by h; texts and results by h and g.
    least: how many code points each line has at least.
    """
    post, probe = posted(classes, tau, False), posted(classes, tau, True)
    other = post.select(F.col("key").alias("own"), F.col("h").alias("its")).hint("shuffle_hash")
    found = staged(probe.join(other, (F.col("key") == F.col("own")) & (F.col("h") != F.col("its")), "left_semi").distinct(), "lines-met")
    keys = found.select(F.col("key").alias("own")).distinct()
    few = keys.count() <= SEND_ROWS
    met = found.withColumn("post", F.lit(False)).union(post.join(F.broadcast(keys) if few else keys, F.col("key") == F.col("own"), "left_semi").withColumn("post", F.lit(True)))
    met = staged(met.groupBy("key", "h").agg(F.max("post").alias("post")), "lines-meeting")
    wanted = met.select("h").distinct()
    first = classes.select("h", "g", "first.*")
    said = staged(_texts_of(docs, wanted, least).join(first, ["h", "g"]), "lines-said")
    crowd = met.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    met = met.join(crowd, "key")
    return few_lines(met, said, tau).union(many_lines(met, said, tau)).distinct()


def few_lines(met: DataFrame, said: DataFrame, tau: int) -> DataFrame:
    """h, g of the later lines, from keys with few lines: their pairs are compared once each, in large batches."""
    groups = met.where(F.col("n") <= FEW_LINES).groupBy("key").agg(F.collect_list(F.struct("h", "post")).alias("x"))
    pairs = groups.select("x", F.posexplode("x").alias("i", "a")).select("a", F.explode(F.expr(f"slice(x, i + 2, {FEW_LINES})")).alias("b")).where("a.post or b.post")
    pairs = pairs.select(F.least("a.h", "b.h").alias("ha"), F.greatest("a.h", "b.h").alias("hb")).distinct()
    for e in "ab":
        pairs = pairs.join(said.select(F.col("h").alias(f"h{e}"), F.col("said").alias(f"said_{e}"), F.struct("doc_id", "t", "line", "h", "g").alias(f"at_{e}")), f"h{e}")
    pairs = pairs.select(F.greatest("at_a", "at_b").alias("at"), "said_a", "said_b").select("at.h", "at.g", "said_a", "said_b")

    def check(batches):
        for batch in batches:
            ok = pa.array(within(batch.column(2).to_pylist(), batch.column(3).to_pylist(), tau))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(ok) for i in (0, 1)], names=["h", "g"])

    return pairs.mapInArrow(check, "h long, g long")


def many_lines(met: DataFrame, said: DataFrame, tau: int) -> DataFrame:
    """h, g of the later lines, from keys with many lines: in pairs of blocks, which give a row for each line at most."""
    entries = met.where(F.col("n") > FEW_LINES).select("key", "h", "post", F.ceil(F.col("n") / BLOCK_LINES).alias("blocks")).join(said, "h")
    dealt = block_pairs(entries, ["key"], "h", "blocks").select("key", "lo", "hi", "side", "h", "g", "post", "doc_id", "t", "line", "said")

    def check(group: pa.Table) -> pa.Table | None:
        if group.num_rows < 2:
            return None
        # nulls come before all other doc_ids
        group = group.sort_by([(c, "ascending") for c in ("t", "line", "h", "g")])
        ids = group["doc_id"].fill_null(np.iinfo(np.int64).min).to_numpy()
        group = group.take(pa.array(np.argsort(ids, kind="stable")))
        side = group["side"].to_numpy() if group["lo"][0].as_py() != group["hi"][0].as_py() else None
        goes = later_of(group["said"].to_pylist(), group["post"].to_numpy(), side, tau)
        return pa.table({c: group[c].to_numpy()[goes] for c in "hg"}) if goes.any() else None

    return run_groups(dealt, ["key", "lo", "hi"], check, "h long, g long")


def removed_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, t, line, h, g of every line that goes."""
    lines = staged(line_rows(docs, tau, min_chars), "lines")
    classes = staged(lines.groupBy("h", "g").agg(F.min(F.struct("doc_id", "t", "line")).alias("first"), F.count(F.lit(1)).alias("times"), F.max("keys").alias("keys")), "lines-classes")
    later = near_lines(docs, classes, tau, max(min_chars, tau + 1)).withColumn("goes", F.lit(True))
    touched = classes.select("h", "g", "first", "times").join(later, ["h", "g"], "left").where("times > 1 or goes")
    touched = staged(touched, "lines-touched")
    found = lines.select("doc_id", "t", "line", "h", "g").join(F.broadcast(touched) if touched.count() <= SEND_ROWS else touched, ["h", "g"])
    return found.where(F.coalesce("goes", F.lit(False)) | ~F.struct("doc_id", "t", "line").eqNullSafe(F.col("first"))).select("doc_id", "t", "line", "h", "g").distinct()


def dedup_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the lines taken out of `text`, and n_lines, n_removed."""
    gone = removed_lines(docs, tau, min_chars).groupBy("doc_id", "t").agg(F.sort_array(F.collect_list(F.struct("line", "h", "g"))).alias("_gone"))  # of one text
    gone = staged(gone.withColumnRenamed("doc_id", "_gone_of").withColumnRenamed("t", "_gone_text"), "lines-gone")
    size = gone.agg(F.sum(F.size("_gone") * 32 + 40)).first()[0] or 0
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_gone_of")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_gone_text"))
    joined = docs.drop("_gone", "_gone_of", "_gone_text").join(F.broadcast(gone) if size <= SEND_BYTES else gone, same, "left").drop("_gone_of", "_gone_text")
    joined = joined.drop("n_lines", "n_removed")  # columns of these names are replaced
    names = joined.columns
    text_at, gone_at = names.index("text"), names.index("_gone")
    passed = [i for i, c in enumerate(names) if c not in ("text", "_gone")]
    schema = ", ".join([f"`{names[i]}` {joined.schema[names[i]].dataType.simpleString()}" for i in passed] + ["text string, n_lines int, n_removed int"])

    def run(batches):
        for batch in batches:
            texts, lists = batch.column(text_at), batch.column(gone_at)
            n = pc.add(pc.fill_null(pc.count_substring(texts, "\n"), -1), 1).cast(pa.int32())
            listed, ends = lists.values, lists.offsets.to_numpy()
            line, said = listed.field("line").to_numpy(), np.stack([listed.field(c).to_numpy() for c in "hg"], 1).astype("<i8").tobytes()
            r, hit, left = np.zeros(len(texts), np.int32), np.zeros(len(texts), bool), []
            for k in np.flatnonzero(pc.and_(lists.is_valid(), texts.is_valid()).to_numpy(zero_copy_only=False)).tolist():
                parts = texts[k].as_py().split("\n")
                at = range(ends[k], ends[k + 1])
                drop = {i for i, j in zip(line[ends[k] : ends[k + 1]].tolist(), at) if i < len(parts) and digest(parts[i].strip(_BLANK_TEXT).encode("utf-32-le", "surrogatepass")) == said[16 * j : 16 * j + 16]}
                if drop:
                    r[k], hit[k] = len(drop), True
                    left.append("\n".join([x for i, x in enumerate(parts) if i not in drop]))
            if left:
                texts = pc.replace_with_mask(texts, pa.array(hit), pa.array(left, texts.type))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in passed] + [texts, n, pa.array(r)], names=[names[i] for i in passed] + ["text", "n_lines", "n_removed"])
        release()

    return joined.withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)
