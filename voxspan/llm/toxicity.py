"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Every word becomes a step with character inputs (the strongest and mean log-odds of the character n-grams in it) and a
word input (the word's own log-odds); the log-odds tables are fitted on the training rows, and the network sees each
training text through tables that were fitted without its fold. A text is scored over all its overlapping windows of
words; its logit is that of its worst window, and training follows that window.

The classifier is fitted on at most TRAIN_DOCS labelled texts of at most TRAIN_CHARS characters each and TRAIN_SUM in all
(a documented bound; texts that do not fit are left out); scoring covers all texts and all their windows.

Edge cases: null and empty texts are scored as a window without words; a very long text is many windows; repeated rows
get equal scores; without labelled rows of both classes every score is the share of label 1 (0.0 if no row has a label);
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, U64, batches_of, hash_spans, mixed, random_odd, release, release_driver, split_words

TRAIN_DOCS, TRAIN_CHARS, TRAIN_SUM = 3000, 50_000, 20_000_000
WINDOW, STRIDE = 32, 16
HIDDEN, CHANNELS, SLOTS = 8, 5, 1 << 20
GRAMS = (4, 6)
FOLDS, EPOCHS, SHRINK = 4, 12, 4.0
THRESHOLD = 0.7

_NOT_WORD = np.ones(256, bool)
_NOT_WORD[48:58] = _NOT_WORD[65:91] = _NOT_WORD[97:123] = _NOT_WORD[128:] = False
_GRAM_VALUES = BYTE_VALUES.copy()
_GRAM_VALUES[_NOT_WORD] = U64(0x1234567)  # all that ends a word is alike


@dataclass
class Words:
    """The words of some texts: their offsets by text, the distinct ones, and the slots of their features."""

    first: np.ndarray
    of: np.ndarray  # number of the distinct word
    slots: np.ndarray  # of the distinct words
    gram_slots: tuple[np.ndarray, ...]
    gram_first: tuple[np.ndarray, ...]


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    starts, ends, first = split_words(data, offsets, _NOT_WORD)
    hashes = hash_spans(data, starts, ends)
    distinct, at, of = np.unique(hashes, return_index=True, return_inverse=True)
    starts, lens = starts[at], (ends - starts)[at]
    wide = lens + 2  # with what stands before and after
    pos = np.repeat(starts - 1, wide) + np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide)
    outside = (pos < 0) | (pos >= len(data))
    values = _GRAM_VALUES[data[np.clip(pos, 0, max(0, len(data) - 1))]] if len(data) else np.zeros(0, U64)
    edge = np.zeros(len(values), bool)
    ends_at = np.cumsum(wide)
    if len(values):
        edge[ends_at - 1] = edge[ends_at - wide] = True
    values[outside | edge] = U64(0x1234567)
    slots, firsts = [], []
    for n in GRAMS:
        factor = random_odd(n, 300 + n)
        count = np.maximum(wide - n + 1, 0)
        f = np.concatenate([[0], np.cumsum(count)])
        p = np.arange(int(f[-1])) - np.repeat(f[:-1], count) + np.repeat(ends_at - wide, count)
        h = np.zeros(len(p), U64)
        for i in range(n):
            h += values[p + i] * factor[i]
        slots.append((mixed(h) & U64(SLOTS - 1)).astype(np.int32))
        firsts.append(f)
    return Words(first, of.astype(np.int32), (mixed(distinct) & U64(SLOTS - 1)).astype(np.int64), tuple(slots), tuple(firsts))


def channels_of(w: Words, tables: list[np.ndarray]) -> np.ndarray:
    """(CHANNELS, distinct words) inputs; one more column of zeros stands for padding."""
    n = len(w.slots)
    out = np.zeros((CHANNELS, n + 1), np.float32)
    out[0, :n] = tables[0][w.slots]
    for k in range(len(GRAMS)):
        values, f = tables[1 + k][w.gram_slots[k]].astype(np.float32), w.gram_first[k]
        own = np.flatnonzero(np.diff(f))
        if len(own):
            out[1 + k, own] = np.maximum.reduceat(values, f[own])
            if k == len(GRAMS) - 1:
                out[3, own] = np.add.reduceat(values, f[own]) / np.diff(f)[own]
    out[4, :n] = 1
    out[:4] = np.clip(out[:4] / 2, -2, 3)
    return out


def windows_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end word of each window, and each text's first window; a text has one window at least."""
    n = np.diff(first)
    count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
    win = np.concatenate([[0], np.cumsum(count)])
    start = (np.arange(int(win[-1])) - np.repeat(win[:-1], count)) * STRIDE + np.repeat(first[:-1], count)
    return start, np.minimum(start + WINDOW, np.repeat(first[1:], count)), win


def inputs(chan: np.ndarray, of: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(WINDOW, CHANNELS, windows) inputs and the (WINDOW, windows) mask."""
    at = start[None, :] + np.arange(WINDOW)[:, None]
    mask = at < end[None, :]
    word = np.where(mask, np.append(of, 0)[np.minimum(at, len(of))], chan.shape[1] - 1)
    return np.ascontiguousarray(chan[:, word].transpose(1, 0, 2)), mask.astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_weights(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {}
    for d in "fb":
        w["W" + d] = rng.normal(0, 0.4, (3 * HIDDEN, CHANNELS))
        w["U" + d] = rng.normal(0, 0.3, (3 * HIDDEN, HIDDEN))
        w["c" + d] = np.zeros((3 * HIDDEN, 1))
    w |= {"A": rng.normal(0, 0.4, (HIDDEN, 2 * HIDDEN)), "v": rng.normal(0, 0.4, (HIDDEN, 1)), "u": rng.normal(0, 0.4, (2 * HIDDEN, 1)), "b": np.zeros((1, 1))}
    return {k: x.astype(np.float32) for k, x in w.items()}


def forward(w: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows; with keep also what backward() needs."""
    steps, _, n = x.shape
    h2, saved = 2 * HIDDEN, {}
    states = np.zeros((steps, h2, n), np.float32)
    for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        own = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, h2)
        h = np.zeros((HIDDEN, n), np.float32)
        for t in order:
            g = w["W" + d] @ x[t] + w["c" + d]
            a = w["U" + d] @ h
            zr = _sigmoid(g[:h2] + a[:h2])
            z, r = zr[:HIDDEN], zr[HIDDEN:]
            m = np.tanh(g[h2:] + r * a[h2:])
            step = mask[t] * (1 - z)
            if keep:
                saved[d, t] = (h, z, r, m, a[h2:])
            h = h + step * (m - h)
            states[t, own] = h
    e = np.tanh(w["A"] @ states.transpose(1, 0, 2).reshape(h2, -1)).reshape(HIDDEN, steps, n)
    s = np.tensordot(w["v"][:, 0], e, 1) + (mask - 1) * 30
    s = np.exp(s - s.max(0))
    alpha = s / s.sum(0)
    pooled = np.einsum("tn,thn->hn", alpha, states)
    logit = (w["u"][:, 0] @ pooled) + w["b"][0, 0]
    return (logit, (states, e, alpha, pooled, saved)) if keep else logit


def backward(w: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, kept, d_logit: np.ndarray) -> dict[str, np.ndarray]:
    states, e, alpha, pooled, saved = kept
    steps, _, n = x.shape
    h2 = 2 * HIDDEN
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["u"][:, 0], g["b"][0, 0] = pooled @ d_logit, d_logit.sum()
    d_pooled = w["u"] * d_logit
    d_states = alpha[:, None, :] * d_pooled[None]
    d_alpha = np.einsum("hn,thn->tn", d_pooled, states)
    d_s = alpha * (d_alpha - (alpha * d_alpha).sum(0))
    g["v"][:, 0] = np.einsum("tn,htn->h", d_s, e)
    d_e = w["v"][:, :, None] * d_s[None] * (1 - e * e)
    flat = states.transpose(1, 0, 2).reshape(h2, -1)
    g["A"] = d_e.reshape(HIDDEN, -1) @ flat.T
    d_states = d_states + (w["A"].T @ d_e.reshape(HIDDEN, -1)).reshape(h2, steps, n).transpose(1, 0, 2)
    for d, order in (("f", range(steps - 1, -1, -1)), ("b", range(steps))):
        own = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, h2)
        dh = np.zeros((HIDDEN, n), np.float32)
        for t in order:
            h, z, r, m, an = saved[d, t]
            dh = dh + d_states[t, own]
            d_step = dh * mask[t]
            dz = -d_step * (m - h) * z * (1 - z)
            dm = d_step * (1 - z) * (1 - m * m)
            dr = dm * an * r * (1 - r)
            dg = np.concatenate([dz, dr, dm])
            da = np.concatenate([dz, dr, dm * r])
            g["W" + d] += dg @ x[t].T
            g["c" + d] += dg.sum(1, keepdims=True)
            g["U" + d] += da @ h.T
            dh = dh * (1 - mask[t] * (1 - z)) + w["U" + d].T @ da
    return g


@dataclass
class Model:
    tables: list[np.ndarray]  # log-odds of words, then of each length of n-grams
    weights: dict[str, np.ndarray]
    scale: float
    shift: float
    constant: float | None = None

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all windows, and each text's first window."""
        w = words_of(data, offsets)
        chan = channels_of(w, self.tables)
        start, end, win = windows_of(w.first)
        out = np.empty(len(start), np.float32)
        for lo in range(0, len(start), 4096):
            out[lo : lo + 4096] = forward(self.weights, *inputs(chan, w.of, start[lo : lo + 4096], end[lo : lo + 4096]))
        return out, win

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and number of windows of each text."""
        logit, win = self.logits(data, offsets)
        n = np.diff(win)
        if self.constant is not None:
            return np.full(len(n), self.constant), n
        worst = np.maximum.reduceat(logit, win[:-1]) if len(n) else logit
        return 1 / (1 + np.exp(-np.clip(self.scale * worst.astype(float) + self.shift, -60, 60))), n


def _as_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def fit(texts: list[str], labels: np.ndarray, seed: int = 5) -> Model:
    """labels: 0 or 1."""
    empty = [np.zeros(SLOTS, np.float16)] * (1 + len(GRAMS))
    rate = float(labels.mean()) if len(labels) else 0.0
    if len(labels) == 0 or rate in (0.0, 1.0):
        return Model(empty, new_weights(seed), 1.0, 0.0, rate)
    rng = np.random.default_rng(seed)
    fold = rng.permutation(len(texts)) % FOLDS
    # a chunk of texts of one fold at a time
    parts = [np.flatnonzero(fold == f)[lo : lo + 100] for f in range(FOLDS) for lo in range(0, (fold == f).sum(), 100)]
    words = [words_of(*_as_bytes([texts[i] for i in p])) for p in parts]
    counts = np.zeros((FOLDS, 2, 1 + len(GRAMS), SLOTS), np.uint16)
    for p, w in zip(parts, words, strict=True):
        doc = np.repeat(np.arange(len(p)), np.diff(w.first))
        pair = np.unique(doc.astype(np.int64) * (1 << 32) + w.of)
        doc, word = pair >> 32, pair & 0xFFFFFFFF
        for k in range(1 + len(GRAMS)):
            if k == 0:
                d, s = doc, w.slots[word]
            else:
                n = np.diff(w.gram_first[k - 1])[word]
                d = np.repeat(doc, n)
                s = w.gram_slots[k - 1][np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(w.gram_first[k - 1][word], n)]
            once = np.unique(d * SLOTS + s)
            for y in (0, 1):
                own = once[labels[p[once // SLOTS]] == y] % SLOTS
                counts[fold[p[0]], y, k] += np.bincount(own, minlength=SLOTS).astype(np.uint16)

    def tables(without: int | None) -> list[np.ndarray]:
        keep = [f for f in range(FOLDS) if f != without]
        n1 = sum((labels[fold == f] == 1).sum() for f in keep)
        n0 = sum((labels[fold == f] == 0).sum() for f in keep)
        p = (n1 + 1) / (n1 + n0 + 2)
        d = counts[keep].sum(0, dtype=np.float32)
        return list((np.log((d[1] + SHRINK * p) / (d[0] + SHRINK * (1 - p))) - np.log(p / (1 - p))).astype(np.float16))

    seen = []
    for f in range(FOLDS):
        own = tables(f)
        for p, w in zip(parts, words, strict=True):
            if fold[p[0]] == f:
                seen.append((p, Words(w.first, w.of, w.slots, (), ()), channels_of(w, own), windows_of(w.first)))
    full = tables(None)
    del counts, words
    weights = new_weights(seed)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    weight_of = np.where(labels == 1, 0.5 / rate, 0.5 / (1 - rate)).astype(np.float32)
    step = 0

    def worst(w, chan, first_windows, of) -> tuple[np.ndarray, np.ndarray]:
        start, end, win = first_windows
        logit = np.concatenate([forward(w, *inputs(chan, of, start[lo : lo + 4096], end[lo : lo + 4096])) for lo in range(0, len(start), 4096)])
        top = np.maximum.reduceat(logit, win[:-1])
        hit = np.flatnonzero(logit == np.repeat(top, np.diff(win)))
        return top, hit[np.searchsorted(hit, win[:-1])]

    for epoch in range(EPOCHS):
        rate_of = 0.02 * (1 - epoch / EPOCHS) + 0.001
        for k in rng.permutation(len(seen)):
            p, w, chan, wins = seen[k]
            if epoch == 0:  # at first the window with the strongest inputs
                start, end, win = wins
                strong = np.concatenate([[0], np.cumsum(np.maximum(chan[:4, w.of].sum(0), 0))])
                sums = strong[end] - strong[start]
                top = np.maximum.reduceat(sums, win[:-1])
                hit = np.flatnonzero(sums == np.repeat(top, np.diff(win)))
                at = hit[np.searchsorted(hit, win[:-1])]
            else:
                _, at = worst(weights, chan, wins, w.of)
            x, mask = inputs(chan, w.of, wins[0][at], wins[1][at])
            for _ in range(2):
                logit, kept = forward(weights, x, mask, keep=True)
                d = (_sigmoid(logit) - labels[p]) * weight_of[p] / len(p)
                g = backward(weights, x, mask, kept, d.astype(np.float32))
                step += 1
                for name, (m1, m2) in state.items():
                    m1 += 0.1 * (g[name] - m1)
                    m2 += 0.01 * (g[name] ** 2 - m2)
                    weights[name] = weights[name] - rate_of * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
    top = np.zeros(len(texts))
    for p, w, chan, wins in seen:
        top[p] = worst(weights, chan, wins, w.of)[0]
    # logistic scale and shift on the worst windows, with a little shrinkage
    a, b = 1.0, 0.0
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(a * top + b, -40, 40)))
        r, v = q - labels, np.maximum(q * (1 - q), 1e-4)
        grad = np.array([(r * top).sum() + 0.05 * (a - 1), r.sum() + 0.05 * b])
        hess = np.array([[(v * top * top).sum() + 0.05, (v * top).sum()], [(v * top).sum(), v.sum() + 0.05]])
        da, db = np.clip(np.linalg.solve(hess, grad), -0.5, 0.5)
        a, b = a - da, b - db
    return Model(full, weights, max(float(a), 0.05), float(b))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, chars: int = TRAIN_CHARS, total: int = TRAIN_SUM) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Fits on at most `most` labelled texts, chosen by a hash of doc_id; a row that repeats counts once."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    # labels of texts that are missing or too long leave room for others
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= chars)
    rows = rows.join(F.broadcast(known), "doc_id").withColumn("t", F.xxhash64("text"))  # at most 2 * most rows of two numbers
    picked, room = {}, total
    for r in rows.select("doc_id", "t", "toxic", F.length("text").alias("n")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "t").limit(most).collect():  # numbers
        if r["n"] <= room:
            picked[r["doc_id"], r["t"]] = min(1, max(0, r["toxic"]))
            room -= r["n"]
    if not picked:
        return fit([], np.zeros(0, np.int64))
    wanted = docs.sparkSession.createDataFrame(list(picked), "doc_id long, t long")
    texts = {(r["doc_id"], r["t"]): r["text"] for r in rows.select("doc_id", "t", "text").join(F.broadcast(wanted), ["doc_id", "t"]).dropDuplicates(["doc_id", "t"]).collect()}  # `total` characters at most
    release_driver(docs.sparkSession)  # the driver's JVM and its Python are full at different times
    model = fit([texts[k] for k in picked], np.array(list(picked.values())))
    release()
    return model


def score(docs: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """doc_id, score, n_windows of every document. With keep: all of its columns, and the score as toxicity_score (a column of that name is replaced)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    if keep:
        rows = docs.drop("toxicity_score").withColumn("text", F.col("text").cast("string"))
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "toxicity_score double"])
    else:
        rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        schema = "doc_id long, score double, n_windows long"
    names = [*rows.columns, "toxicity_score"] if keep else ["doc_id", "score", "n_windows"]

    def run(batches):
        m = sent.value
        for batch, data, offsets in batches_of("text")(batches):
            s, n = m.scores(data, offsets)
            made = pa.array(s.astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, made] if keep else [batch.column(0), made, pa.array(n.astype(np.int64))], names=names)

    return rows.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id", folds: int = 3, own: int = 1):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == own, F.lit(False))
