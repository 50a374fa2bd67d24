"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each word holds a segment tree whose leaves are the ranks of its adjacent pairs. The root is the lowest rank at its
leftmost place; a merge changes three leaves and the nodes above them, so a word of n symbols costs O(n log n).
Words of similar length are run side by side, as the rows of one array of trees; long words run alone.

Edge cases: null and empty texts give no ids; a text of any length is encoded whole; special tokens inside a text
become their ids, as the tokenizers library has it; repeated rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, hash_spans, split_words

#: The characters that the pattern engine's \s matches (Unicode White_Space).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Trees of at most so many leaves run side by side; a cache generation holds so many words.
SIDE_BY_SIDE, CACHE_WORDS = 128, 250_000
NONE = np.int64(1) << np.int64(62)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class Vocabulary:
    """A tokenizers JSON file with a byte-level BPE model with word ends, read for encoding and decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = token
        letters = byte_letters()
        self.inner = np.array([self.ids[x] for x in letters], np.int64)
        self.last = np.array([self.ids[x + self.end] for x in letters], np.int64)
        pairs = [(p.split(" ") if isinstance(p, str) else p) for p in model["merges"]]
        key = np.array([self.ids[a] << 20 | self.ids[b] for a, b in pairs], np.int64)
        made = np.array([self.ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made
        self.rank_of = {int(k): int(r) for k, r in zip(self.keys, self.ranks, strict=True)}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern.replace(r"\s", SPACE))
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def normalized(text: str) -> str:
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


def merge_alone(v: Vocabulary, word: bytes) -> list[int]:
    """One word of any length, by a segment tree in plain lists."""
    n = len(word)
    sym = [int(v.inner[b]) for b in word[:-1]] + [int(v.last[word[-1]])]
    size = 1 << max(1, (n - 1).bit_length())
    none = (1 << 62, 0)
    tree = [none] * (2 * size)
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]

    def leaf(i: int) -> tuple[int, int]:
        j = after[i]
        r = v.rank_of.get(sym[i] << 20 | sym[j]) if j < n else None
        return none if r is None else (r, i)

    def put(i: int, x: tuple[int, int]) -> None:
        i += size
        tree[i] = x
        while i > 1:
            i >>= 1
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

    for i in range(n):
        tree[size + i] = leaf(i)
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    while tree[1] is not none:
        rank, i = tree[1]
        j = after[i]
        sym[i] = int(v.made[rank])
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        put(j, none)
        put(i, leaf(i))
        if before[i] >= 0:
            put(before[i], leaf(before[i]))
    out, i = [], 0
    while i < n:
        out.append(sym[i])
        i = after[i]
    return out


def _merge_rows(v: Vocabulary, words: list[bytes], width: int) -> list[np.ndarray]:
    """Words of at most `width` (a power of two) bytes, each a row of trees."""
    rows = len(words)
    lens = np.array([len(w) for w in words])
    data = np.frombuffer(b"".join(words), np.uint8)
    first = np.cumsum(lens) - lens
    row = np.repeat(np.arange(rows), lens)
    col = np.arange(len(data)) - np.repeat(first, lens)
    # two spare columns: width stands for "after the last", width + 1 for "before the first"
    sym = np.full((rows, width + 2), -1, np.int64)
    sym[row, col] = v.inner[data]
    sym[np.arange(rows), lens - 1] = v.last[data[first + lens - 1]]
    after = np.tile(np.arange(1, width + 3), (rows, 1))
    after[np.arange(rows), lens - 1] = width
    before = np.tile(np.arange(-1, width + 1), (rows, 1))
    before[:, 0] = width + 1
    live = np.zeros((rows, width), bool)
    live[row, col] = True
    tree = np.full((rows, 2 * width), NONE, np.int64)
    inner = col < lens[row] - 1
    r, c = row[inner], col[inner]
    rank = v.pair_ranks(sym[r, c], sym[r, c + 1])
    tree[r, width + c] = np.where(rank == NONE, NONE, rank * width + c)
    at = width >> 1
    while at:
        tree[:, at : 2 * at] = np.minimum(tree[:, 2 * at : 4 * at : 2], tree[:, 2 * at + 1 : 4 * at : 2])
        at >>= 1

    def put(r: np.ndarray, c: np.ndarray, x: np.ndarray) -> None:
        at = c + width
        tree[r, at] = x
        while at[0] > 1:
            at = at >> 1
            tree[r, at] = np.minimum(tree[r, 2 * at], tree[r, 2 * at + 1])

    def leaf(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        j = after[r, c]
        rank = np.where(j < width, v.pair_ranks(sym[r, c], np.maximum(sym[r, j], 0)), NONE)
        return np.where(rank == NONE, NONE, rank * width + c)

    r = np.flatnonzero(tree[:, 1] < NONE)
    while len(r):
        root = tree[r, 1]
        i = root % width
        j = after[r, i]
        sym[r, i] = v.made[root // width]
        k = after[r, j]
        after[r, i] = k
        before[r, k] = i
        live[r, j] = False
        put(r, j, np.full(len(r), NONE))
        put(r, i, leaf(r, i))
        p = before[r, i]
        has = p < width
        if has.any():
            put(r[has], p[has], leaf(r[has], p[has]))
        r = r[tree[r, 1] < NONE]
    flat = sym[:, :width][live]
    return np.split(flat, np.cumsum(live.sum(1))[:-1])


def merge_words(v: Vocabulary, words: list[bytes]) -> list[np.ndarray]:
    """The ids of each word (its bytes; not empty), by segment trees."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
    by_width: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        width = max(2, 1 << (len(w) - 1).bit_length())
        if width > SIDE_BY_SIDE:
            out[k] = np.array(merge_alone(v, w), np.int64)
        else:
            by_width.setdefault(width, []).append(k)
    for width, ks in by_width.items():
        step = max(1, 400_000 // width)
        for lo in range(0, len(ks), step):
            part = ks[lo : lo + step]
            for k, ids in zip(part, _merge_rows(v, [words[k] for k in part], width), strict=True):
                out[k] = ids
    return out


_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[97:123] = True


class ChunkCache:
    """Ids, as little-endian uint32 bytes, of pieces between white space; two generations of bounded size.

    A full stop or comma between a letter or digit and white space is a piece of its own. Pieces are known by a 64-bit hash.
    """

    def __init__(self, encode):
        self.encode, self.young, self.old = encode, {}, {}

    def texts(self, texts: list[str]) -> list[bytes]:
        """texts: normalized."""
        raw = [t.encode() for t in texts]
        whole = b"".join(raw)
        data = np.frombuffer(whole, np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        if not len(data):
            return [b""] * len(texts)
        stop = np.flatnonzero((data == 46) | (data == 44))
        ends_there = np.append(BLANK[data], True)
        ends_there[offsets[1:]] = True
        stop = stop[ends_there[stop + 1] & (stop > 0) & _ALNUM[data[np.maximum(stop - 1, 0)]]]
        starts, ends, first = split_words(data, offsets, cuts=stop)
        u, at, of = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        young, keys = self.young, u.tolist()
        got = list(map(young.get, keys))
        missed = [i for i, x in enumerate(got) if x is None]
        if missed:
            fresh = []
            for i in missed:
                got[i] = self.old.get(keys[i])
                if got[i] is None:
                    fresh.append(i)
            made = self.encode([whole[a:b].decode() for a, b in zip(starts[at[fresh]].tolist(), ends[at[fresh]].tolist(), strict=True)]) if fresh else []
            for i, x in zip(fresh, made, strict=True):
                got[i] = x
            young.update((keys[i], got[i]) for i in missed)
            if len(young) > CACHE_WORDS:
                self.old, self.young = young, {}
        lens = np.fromiter(map(len, got), np.int64, len(got)) // 4
        flat = np.frombuffer(b"".join(got), "<u4")
        begin = (np.cumsum(lens) - lens)[of]
        n = lens[of]
        out_at = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.arange(int(out_at[-1])) - np.repeat(out_at[:-1], n) + np.repeat(begin, n)].tobytes()
        cut = (4 * out_at[first]).tolist()
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


class Encoder:
    """Whole texts to ids."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.cache = ChunkCache(self._chunks)

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        parts = [self.v.pattern.findall(c) for c in chunks]
        words = sorted({w for p in parts for w in p})
        ids = dict(zip(words, (x.astype("<u4").tobytes() for x in merge_words(self.v, [w.encode() for w in words])), strict=True)) if words else {}
        return [b"".join(map(ids.__getitem__, p)) for p in parts]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        special = [i for i, t in enumerate(texts) if "<" in t and self.v.split_special and self.v.split_special.search(t)]
        out = self.cache.texts([normalized(t) for t in texts])
        for i in special:
            made = []
            for part in self.v.split_special.split(texts[i]):
                made.append(np.array([self.v.special[part]], "<u4").tobytes() if part in self.v.special else self.cache.texts([normalized(part)])[0])
            out[i] = b"".join(made)
        return out

    def decode(self, ids: bytes) -> str:
        """The tokens of the ids with a space between; the vocabulary file states no decoder."""
        return " ".join(map(self.v.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def text_slices(batch: pa.RecordBatch, column: int, most: int = 2_000_000):
    """(first row, texts) in slices of about `most` characters; null counts as empty."""
    texts = [x or "" for x in batch.column(column).to_pylist()]
    lo = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield lo, texts[lo : i + 1]
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, texts[lo:]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>), decoded (string) for each document."""

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for lo, texts in text_slices(batch, 1):
                ids = enc.encode_batch(texts)
                lens = np.array([len(x) // 4 for x in ids])
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), lists, pa.array([enc.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what encode() gives, as digests made beside it, so ids need not leave the worker."""

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for lo, texts in text_slices(batch, 1):
                ids = enc.encode_batch(texts)
                cols = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(enc.decode(x).encode()).hexdigest() for x in ids])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), *cols], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
