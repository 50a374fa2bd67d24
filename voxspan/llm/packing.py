"""Packing documents into sequences by the sum-of-squares rule.

A bin's gap is the room left in it; N(g) counts the open bins with gap g. Each piece goes where the sum of N(g)^2 over
all gaps becomes smallest, opening a bin included; ties go to the smallest gap. Pieces come in an order given by a hash,
which suits the rule, except that the shortest LATE of them come last, in decreasing length, and fill what is left.

Documents are dealt to blocks of bounded size by a hash, and each block is packed alone, so no task sees all pieces;
a block leaves one or two sequences part empty, of thousands.

Edge cases: a null or empty text is its end token alone; only documents longer than a sequence are cut; repeated rows
are packed once each; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ChunkCache, normalized, text_slices
from .common import U64, mixed, release, run_groups, staged

SEQUENCE, BLOCK_PIECES, END_ID, LATE = 4096, 32_768, 1, 0.15


class _Library:
    """Ids by the tokenizers library. Pieces between white space are encoded apart from each other, and kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = ChunkCache(self.encode)

    def encode(self, chunks: list[str]) -> list[bytes]:
        """Words of letters alone are encoded in one text, which costs less than one by one."""
        out: list[bytes | None] = [None] * len(chunks)
        plain = [i for i, c in enumerate(chunks) if c.isascii() and c.isalpha() or c.isalpha() and c.islower()]
        for lo in range(0, len(plain), 4096):
            own = plain[lo : lo + 4096]
            e = self.tokenizer.encode(" ".join([chunks[i] for i in own]), add_special_tokens=False)
            word = np.array(e.word_ids)
            if int(word[-1]) + 1 != len(own):  # a word that the pattern cuts
                continue
            ids, cut = np.array(e.ids, "<u4").tobytes(), (4 * np.searchsorted(word, np.arange(len(own) + 1))).tolist()
            for k, i in enumerate(own):
                out[i] = ids[cut[k] : cut[k + 1]]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([chunks[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        out = self.cache.texts([normalized(t) for t in texts])
        for i, t in enumerate(texts):
            if "<" in t and any(s in t or s in t.lower() for s in self.special):  # what looks like a special token, before or after normalization
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        return out


_libraries: dict[str, _Library] = {}


def _library(path: str) -> _Library:
    if path not in _libraries:
        _libraries[path] = _Library(path)
    return _libraries[path]


def token_pieces(docs: DataFrame, path: str, most: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids and its end id, cut into pieces of at most `most`."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        lib = _library(path)
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for lo, texts in text_slices(batch, 1):
                cols: list[list] = [[], [], [], [], []]
                for i, ids in zip(ids_of[lo : lo + len(texts)], lib.encode_batch(texts), strict=True):
                    ids += end
                    for p, at in enumerate(range(0, len(ids) // 4, most)):
                        own = ids[4 * at : 4 * (at + most)]
                        for c, x in zip(cols, (i, p, at, len(own) // 4, zlib.crc32(own)), strict=True):
                            c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, most: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece (in the given order), and the number of bins."""
    count = np.zeros(most + 1, np.int64)  # open bins by gap; a bin without gap is closed
    stacks: list[list[int]] = [[] for _ in range(most + 1)]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    n = 0
    never = np.int64(1) << 60
    for k, s in enumerate(lengths.tolist()):
        # change of the sum if a bin with gap g moves to gap g - s
        change = 2 * (count[: most + 1 - s] - count[s:]) + 2
        change[0] = 1 - 2 * count[s]
        change[count[s:] == 0] = never
        change[most - s] = 2 * count[most - s] + 1 if s < most else 0  # a new bin
        g = int(change.argmin()) + s
        if g == most:
            b, n = n, n + 1
        else:
            b = stacks[g].pop()
            count[g] -= 1
        bins[k], offsets[k] = b, most - g
        if g > s:
            stacks[g - s].append(b)
            count[g - s] += 1
    return bins, offsets, n


def packing_order(doc_ids: np.ndarray, piece: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Row numbers in the order of packing."""
    order = np.lexsort([piece, doc_ids, mixed(mixed(doc_ids.astype(U64)) + piece.astype(U64))])
    late = lengths[order] < np.quantile(lengths, LATE)
    short = order[late]
    return np.concatenate([order[~late], short[np.argsort(-lengths[short], kind="stable")]])


def pack(piece_rows: DataFrame, most: int = SEQUENCE, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length; they replace columns of these names."""
    rows = staged(piece_rows.drop("sequence_id", "offset", "__block"), "packing-pieces")
    blocks = max(1, -(-rows.count() // block_pieces))
    names = rows.columns

    def run(group: pa.Table) -> pa.Table:
        group = group.take(pa.array(packing_order(group["doc_id"].fill_null(-1).to_numpy(), group["piece"].to_numpy(), group["length"].to_numpy())))
        bins, offsets, _ = sum_of_squares(group["length"].to_numpy(), most)
        block = group["__block"][0].as_py()
        return group.select(names).append_column("sequence_id", pa.array(bins + (block << 24))).append_column("offset", pa.array(offsets))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long"
    # the place in the written table keeps rows that repeat, or have no doc_id, from gathering in a block
    block = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(blocks)).cast("long")
    return run_groups(rows.withColumn("__block", block), ["__block"], run, schema)
