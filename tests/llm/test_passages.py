"""The language model against scalar versions: passages and their bits, the spelling of words, and the query's contract."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("voxspan.llm")

from voxspan.llm import common, lm, passages  # noqa: E402

M = (1 << 64) - 1
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def mix64(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
    return x ^ (x >> 31)


def words_of(text):
    return WORD.findall((text or "").encode().lower())


def word_hash(w):
    data = np.frombuffer(w, np.uint8)
    return int(common.hash_spans(data, np.array([0]), np.array([len(w)]))[0])


def cut_text(words):
    out, own = [], []
    for i, w in enumerate(words):
        own.append(w)
        if i and mix64((word_hash(words[i - 1]) * passages._A + word_hash(w)) & M) % passages.PLACE == 0:
            out.append(tuple(own))
            own = []
    return [*out, (*own, None)]  # the end of the text


def stretch(a, b):
    return math.log((a + 0.4) / (b + 0.4))


def scalar_bit(ones, zeros):
    """Bit.of() with one number at a time."""
    cells = [(s, l, b) for s in range(passages.SIZES) for l in range(4) for b in range(4)]

    def total(t, keep):
        return sum(t.get(c, 0) for c in cells if keep(c))

    x = {}
    for s, l, b in cells:
        x[s, l, b] = [
            stretch(total(ones, lambda c: c[0] == s), total(zeros, lambda c: c[0] == s)),
            stretch(total(ones, lambda c: c[1:] == (l, b)), total(zeros, lambda c: c[1:] == (l, b))),
            stretch(total(ones, lambda c: c[:2] == (s, l)), total(zeros, lambda c: c[:2] == (s, l))),
            stretch(ones.get((s, l, b), 0), zeros.get((s, l, b), 0)),
            0.3,
        ]
    out = {}
    for gate in range(4):
        own = [c for c in cells if c[1] == gate]
        seen = {c: ones.get(c, 0) + zeros.get(c, 0) for c in own}
        every = max(1.0, sum(seen.values()))
        w = [0.25, 0.25, 0.25, 0.25, 0.0]

        def p(c):
            return 1 / (1 + math.exp(-max(-16, min(16, sum(a * b for a, b in zip(w, x[c]))))))

        used = [c for c in own if seen[c]]
        for _ in range(400):
            d = {c: p(c) - ones.get(c, 0) / seen[c] for c in used}
            w = [w[k] - 0.5 * sum(x[c][k] * seen[c] / every * d[c] for c in used) / max(1.0, sum(x[c][k] ** 2 * seen[c] / every for c in used)) for k in range(5)]
        for c in own:
            out[c] = min(1 - 1e-5, max(1e-5, (ones.get(c, 0) + 20 * p(c)) / (seen[c] + 20)))
    return out


def scalar_passages(texts, training):
    """(came, log10 of what is told) of each passage of each text."""
    cuts = [cut_text(words_of(t)) for t in texts]
    segs, pairs = {}, {}
    for c, t in zip(cuts, training):
        for prev, seg in zip([0, *c], c) if t else ():
            segs[seg] = segs.get(seg, 0) + 1
            pairs[prev, seg] = pairs.get((prev, seg), 0) + 1
    rows = []
    for c, t in zip(cuts, training):
        own, last, before, n_prev = [], 3, 3, sum(training) - t
        for prev, seg in zip([0, *c], c):
            cs, cp = segs.get(seg, 0) - t, pairs.get((prev, seg), 0) - t
            came = 2 if cp > 0 else 1 if cs > 0 else 0
            size = 0 if n_prev <= 0 else min(passages.SIZES - 1, int(math.log2(n_prev)) + 1)
            own.append((came, max(cs, 0), max(cp, 0), n_prev, (size, last, before)))
            last, before, n_prev = came, last, max(cs, 0)
        rows.append(own)
    f1, f0, k1, k0 = {}, {}, {}, {}
    for own, t in zip(rows, training):
        for came, _, _, _, cell in own if t else ():
            if cell[0]:
                (f1 if came == 2 else f0)[cell] = (f1 if came == 2 else f0).get(cell, 0) + 1
            if came < 2:
                (k1 if came else k0)[cell] = (k1 if came else k0).get(cell, 0) + 1
    follows, known = scalar_bit(f1, f0), scalar_bit(k1, k0)
    n = sum(len(c) for c, t in zip(cuts, training) if t)
    out = []
    for own, t in zip(rows, training):
        told = []
        for came, cs, cp, n_prev, cell in own:
            miss = math.log10(1 - follows[cell]) if n_prev > 0 else 0.0
            if came == 2:
                told.append((came, math.log10(follows[cell]) + math.log10(cp / n_prev)))
            elif came == 1:
                told.append((came, miss + math.log10(known[cell]) + math.log10(cs / max(n - t, cs))))
            else:
                told.append((came, miss + math.log10(1 - known[cell])))
        out.append(told)
    return out


def sample_texts():
    rng = random.Random(3)
    vocabulary = ["the", "of", "and", *[f"w{i}" for i in range(60)]]
    shared = [" ".join(rng.choice(vocabulary) for _ in range(90)) for _ in range(4)]
    texts = []
    for _ in range(40):
        own = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 120)))]
        if rng.random() < 0.6:
            own.insert(rng.randint(0, 1), rng.choice(shared))
        texts.append(" ".join(own))
    return [*texts, texts[0], texts[1].upper(), None, "", "one", "x x x x x x x x", " ".join(["x"] * 3000)]


@pytest.mark.parametrize("hot", [100_000, 1])
def test_passages_are_those_of_a_scalar_version(spark, monkeypatch, hot):
    monkeypatch.setattr(passages, "HOT", hot)
    texts = sample_texts()
    training = [i % 7 != 2 for i in range(len(texts))]
    rows = []
    for i, t in enumerate(texts):
        h = np.array([word_hash(w) for w in words_of(t)], np.uint64)
        own, at = passages.cut(h, np.array([0, len(h)]))
        seg, pair = (x.view(np.int64).tolist() for x in passages.hashes(h, own, at))
        rows += [(i, k, training[i], s, p, 0.0) for k, (s, p) in enumerate(zip(seg, pair))]
    each = spark.createDataFrame(rows, "row long, idx int, training boolean, seg long, pair long, cost double")
    texts_of = each.groupBy("row").agg(F.first("training").alias("training"), F.collect_list("cost").alias("costs"))
    told = common.staged(passages.decisions(texts_of, passages.counted(each, len(rows)), sum(training)), "t")
    n = sum(r[2] for r in rows)
    got = {(r.row, r.idx): (r.came, r.told_score) for r in passages.passage_scores(told, *passages.bits_of(told), n).collect()}
    want = scalar_passages(texts, [int(t) for t in training])
    assert len(got) == sum(map(len, want)) and len({c for own in want for c, _ in own}) == 3
    for i, own in enumerate(want):
        for k, (came, score) in enumerate(own):
            assert got[i, k][0] == came and abs(got[i, k][1] - score) < 1e-6


def test_spelling_is_that_of_a_scalar_version():
    """Costs of words from counts of all beginnings, hashed contexts, gates, weights and refinement, one bit at a time."""
    rng = np.random.default_rng(2)
    words = sorted({bytes(rng.choice(list(b"abc\xc3"), rng.integers(1, 7))) for _ in range(60)})
    z = rng.integers(0, lm.CLASSES + 1, len(words))
    c = rng.integers(0, 5, len(words))
    full = [lm.full(w) for w in words]
    order = sorted(range(len(words)), key=lambda i: (full[i], z[i]))
    full, z, c = [full[i] for i in order], z[order], c[order]
    r = lm.Range(full, np.zeros(len(full), np.int64), z, c, c, c)
    bits = (8, 9, 9, 9, 9)
    table = rng.integers(0, 9, 2 * sum(1 << b for b in bits)).astype(np.uint16).view(np.uint32)
    m = lm.new_mixer(table, 0.9, bits)
    m.ones, m.seen = rng.random((lm.GATES, lm.CELLS)) * 5, np.full((lm.GATES, lm.CELLS), 9.0)
    same, other = lm.whole_counts(r, [])
    lens = np.array([len(w) for w in full])
    got = lm.spell_costs(m, r, same, other, np.cumsum(lens) - lens)
    salt, state = [int(x) for x in lm._SALT], [int(x) for x in lm._STATES]
    c1, c2 = int(lm._C1), int(lm._C2)
    text = ["".join(f"{b:08b}" for b in w) for w in full]
    for w, own, zi, total in zip(full, text, z.tolist(), got):
        want = 0.0
        for i, byte in enumerate(w):
            back = [w[i - k] + 1 if i >= k else 0 for k in range(1, 6)]
            ctx = [min(i, 15), back[0], back[0] + (back[1] << 9), back[0] + (back[1] << 9) + (back[2] << 18)]
            ctx.append(ctx[3] + (back[3] << 27) + (back[4] << 36))
            ctx = [mix64((x + salt[k]) & M) ^ state[zi] for k, x in enumerate(ctx)]
            for bit in range(8):
                at, y = 8 * i + bit, int(own[8 * i + bit])
                node = ((1 << bit) | (byte >> (8 - bit))) * c1 & M
                n0, n1, base = [], [], 0
                for k, b in enumerate(bits):
                    both = int(table[((((ctx[k] ^ node) * c2) & M) >> (64 - b)) + base])
                    n0.append(both & 0xFFFF)
                    n1.append(both >> 16)
                    base += 1 << b
                for states in ({zi}, set(range(lm.CLASSES + 1))):
                    begun = [(t[at], n) for t, zz, n in zip(text, z.tolist(), c.tolist()) if zz in states and len(t) > at and t[:at] == own[:at]]
                    n0.append(sum(n for x, n in begun if x == "0"))
                    n1.append(sum(n for x, n in begun if x == "1"))
                x = [math.log((b + 0.4) / (a + 0.4)) for a, b in zip(n0, n1)] + [0.3]
                level = [sum(n0[k] + n1[k] > t for t in (0, 2, 15, 200)) for k in (4, 5)]
                gate = level[1] * 5 + level[0]
                s = max(-11.0, min(11.0, sum(a * b for a, b in zip(x, m.weights[gate]))))
                cell = (s + 11) * (lm.CELLS - 1) / 22
                lo = min(int(cell), lm.CELLS - 2)
                t = [(m.ones[gate, j] + 20 / (1 + math.exp(-(j * 22 / (lm.CELLS - 1) - 11)))) / (m.seen[gate, j] + 20) for j in (lo, lo + 1)]
                p = (1 / (1 + math.exp(-s)) + t[0] * (1 - cell + lo) + t[1] * (cell - lo)) / 2
                p = max(1e-6, min(1 - 1e-6, p))
                want += math.log10(p if y else 1 - p)
        assert abs(total - want) < 1e-4 * max(1, abs(want))


def test_query_keeps_its_contract(spark, tmp_path):
    """Columns, folds, counts; a copied text is told apart; extra and clashing columns; nulls; an empty table."""
    from voxspan.llm import queries

    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(300)) for _ in range(60)]
    texts += [texts[3], texts[3], None, ""]
    rows = [(i, t, "x", 1.0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, training string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op9_context_mixing(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    fold = {i: zlib.crc32(str(i).encode()) % 7 for i in got}
    count = {}
    for i, t in enumerate(texts):
        for w in [*words_of(t), b"\n"] if fold[i] != 2 else []:
            count[w] = count.get(w, 0) + 1
    n = sum(count.values())
    for i, t in enumerate(texts):
        own = [*words_of(t), b"\n"]
        base = sum(math.log10((count.get(w, 0) + 1) / (n + len(count) + 1)) for w in own)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold[i] == 2, len(own), sum(w in count for w in own), n)
        assert abs(r.base_score - base) < 1e-6 and r.score < 0
    copies = [i for i in (3, 60, 61)]
    if sum(fold[i] != 2 for i in copies) > 1:
        others = [got[i].score / got[i].n_tokens for i in range(60) if i != 3]
        assert all(got[i].score / got[i].n_tokens > max(others) / 2 for i in copies)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op9_context_mixing(spark, f"{tmp_path}/none").count() == 0
