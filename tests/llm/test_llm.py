"""The text operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("voxspan.llm")

from voxspan.llm import bpe, caps, chat, common, linededup, lm, minhash, packing, sharding, topk, toxicity  # noqa: E402
from voxspan.llm.queries import vocabulary  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0) for i, t in zip(ids, texts)], DOCS)


def odd_texts():
    rng = random.Random(4)
    words = ["the", "of", "alpha", "Béta", "gamma,", "delta."] + [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(12)]
    near = [b.replace(" of ", " off ", 1) for b in base[:6]]
    return [*base, *near, base[0], base[0].upper(), None, "", "   \n ", "one", "one two three", "x" * 5000, " ".join(f"u{i}" for i in range(4000)), base[1] + "\n" + base[2]]


# --- components -----------------------------------------------------------------------------------------------------


def test_components_of_chains_and_hubs(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(50))
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 8 --------------------------------------------------------------------------------------------------------------


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_groups(texts, k, percent=80):
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_are_those_of_brute_force(spark, k):
    texts = odd_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(spark, texts), k=k).collect()}
    assert got == dict(enumerate(brute_groups(texts, k)))


def test_near_duplicates_of_hot_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 8)
    monkeypatch.setattr(minhash, "SEND_IDS", 0)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(100)]
    texts = [" ".join(base)] + [" ".join(w if j != rng.randrange(100) else f"e{n}" for j, w in enumerate(base)) for n in range(60)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, texts), k=4).collect()}
    assert got == {i: c for i, (_, c) in enumerate(brute_groups(texts, 4))}


def test_near_duplicates_edge_tables(spark):
    assert minhash.near_duplicates(docs(spark, []), k=5).count() == 0
    twice = docs(spark, ["a b c d e f", "a b c d e f", None], [3, 3, None])
    got = minhash.near_duplicates(twice.withColumn("tokens", F.lit(1)), k=4).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(3, 3), (3, 3)] and len(got) == 3


def test_near_duplicates_in_long_lists(spark, monkeypatch):
    """Lists of many blocks, with groups that do not connect and some that connect by their middle alone."""
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 8)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 230)  # four documents of 57
    rng = random.Random(8)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for n in range(70):
        words = list(base)
        for j in rng.sample(range(60), rng.choice([1, 2, 3, 6, 9])):
            words[j] = f"e{n}.{j}"
        texts.append(" ".join(words))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, texts), k=4).collect()}
    want = {i: c for i, (_, c) in enumerate(brute_groups(texts, 4))}
    assert 3 < len(set(want.values())) < 60 and sum(got[i] != want[i] for i in want) == 0


def test_collisions_are_those_of_brute_force():
    rng = np.random.default_rng(0)
    sig = rng.integers(0, 3, (80, 12))
    sig[40:60] = sig[:20]
    got = {(i, j) for i, js in minhash.collisions(sig, 7) for j in js.tolist()}
    assert got == {(i, j) for i in range(80) for j in range(i + 1, 80) if (sig[i] == sig[j]).sum() >= 7}


def test_one_row_of_each_group_stays(spark, monkeypatch):
    """By rows, not by ids: ids repeat and are null; whole rows repeat."""
    a, b, c = ("a b c d e f g h i j", "k l m n o p q r s t", "u v w x y z 1 2 3 4")
    rows = docs(spark, [a, b, a, a, c, c, None, "", b, c], [1, 1, 2, 2, 3, 3, 4, 4, None, None])
    for sent in (100, 0):
        monkeypatch.setattr(minhash, "SEND_IDS", sent)
        got = minhash.first_of_each(rows.withColumn("times", F.lit(1)).withColumn("component", F.lit("x")))
        assert sorted((r.doc_id, r.text or "") for r in got.collect()) == [(1, a), (1, b), (3, c), (4, ""), (4, "")]
        assert got.columns == [*rows.columns, "times", "component"]
    assert minhash.first_of_each(rows.where("false")).count() == 0


# --- 2 --------------------------------------------------------------------------------------------------------------


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def random_pairs(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(45)))
        b = list(a)
        for _ in range(rng.randrange(5)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "c"])
        yield a, "".join(b)


@pytest.mark.parametrize("tau", [0, 1, 2, 4])
def test_banded_distance_and_keys(tau):
    pairs = list(random_pairs(800, tau))
    want = np.array([edit(a, b) <= tau for a, b in pairs])
    assert (linededup.within([a for a, _ in pairs], [b for _, b in pairs], tau) == want).all()
    for (a, b), near in zip(pairs, want, strict=True):
        if near and min(len(a), len(b)) > tau:
            long, short = (a, b) if len(a) >= len(b) else (b, a)
            lines = linededup.Lines([long, short])
            post, probe = linededup.keys_of(lines, np.arange(2), tau)
            assert set(probe[0]) & set(post[1])


def brute_lines(texts, tau=2, least=20):
    first = {}
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            if len(s := line.strip()) >= least:
                first.setdefault(s, (i, k))
    lines = sorted(first, key=first.get)
    gone = {b for j, b in enumerate(lines) if any(abs(len(a) - len(b)) <= tau and edit(a, b) <= tau for a in lines[:j])}
    out = []
    for i, t in enumerate(texts):
        if t is None:
            out.append(None)
            continue
        kept = [x for k, x in enumerate(t.split("\n")) if len(s := x.strip()) < least or (s not in gone and first[s] == (i, k))]
        out.append("\n".join(kept))
    return out


@pytest.mark.parametrize("few", [24, 1])
def test_lines_are_those_of_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(linededup, "FEW_LINES", few)
    monkeypatch.setattr(linededup, "BLOCK_LINES", 4)
    rng = random.Random(few)
    base = ["".join(rng.choice("abcdefg ") for _ in range(rng.randint(15, 40))) for _ in range(12)]
    texts = [None, "", "\n\n"]
    for _ in range(30):
        lines = []
        for _ in range(4):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                line[rng.randrange(len(line))] = rng.choice("xyz")
            lines.append("  " * rng.randrange(2) + "".join(line))
        texts.append("\n".join(lines))
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts)
    assert linededup.dedup_lines(docs(spark, [])).count() == 0


def test_lines_that_share_a_polynomial_hash_stay(spark, monkeypatch):
    """Thue-Morse lines have equal hashes modulo 2^64 and differ in every place."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    lines = linededup.Lines([a, b])
    assert lines.hashes(lines.start, lines.length)[0] == lines.hashes(lines.start, lines.length)[1]
    got = {r.doc_id: (r.text, r.n_removed) for r in linededup.dedup_lines(docs(spark, [a, b, a])).collect()}
    assert got == {0: (a, 0), 1: (b, 0), 2: ("", 1)}


@pytest.mark.parametrize("sent", [1000, 0])
def test_lines_of_rows_without_or_with_equal_ids(spark, monkeypatch, sent):
    monkeypatch.setattr(linededup, "SEND_ROWS", sent)
    monkeypatch.setattr(linededup, "SEND_BYTES", sent)
    x, y = "a line that is long enough", "and some other line of the text"
    rows = docs(spark, [x, x + "\n" + y, y, "z\n" + x, x, x], [None, None, 5, 5, 7, 7])
    got = linededup.dedup_lines(rows.withColumn("n_lines", F.lit("old")).withColumn("_gone", F.lit(1)))
    told = sorted((r.doc_id or 0, r.text) for r in got.collect())
    assert "".join(t for _, t in told).count(x) == 1 and "".join(t for _, t in told).count(y) == 1 and len(told) == 6
    assert "n_lines" in got.columns and "lang" in got.columns


# --- 10 and 7 -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def strange_texts():
    rng = random.Random(9)
    fixed = ["", " ", "it's DON'T 've", "a\x1cb", "ΑΣ ΟΔΟΣ", "İstanbul ﬁ", "é ́x\xa0y", "<|endoftext|>hello <|startoftext|> x<|ENDOFTEXT|>", "a" * 3000, "😀👍🏽" * 30 + "!!..", "١٢٣ ½", "中文。", "a. b, c.. d., e_."]
    return fixed + ["".join(rng.choice("abcétion \n\t'sLL<|>.,́Σİ1२\x1c") for _ in range(rng.randint(1, 60))) for _ in range(200)]


def test_bpe_is_that_of_the_library(tokenizer):
    texts = strange_texts()
    enc, lib = bpe.Encoder(vocabulary()), packing._Library(vocabulary())
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = enc.encode_batch(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert [np.frombuffer(x, "<u4").tolist() for x in lib.encode_batch(texts)] == want
    assert [enc.decode(x) for x in got] == [tokenizer.decode(w, skip_special_tokens=False) for w in want]


def test_bpe_digests(spark, tokenizer):
    texts = [*strange_texts()[:20], None]
    got = {r.doc_id: r for r in bpe.digests(docs(spark, texts), vocabulary()).collect()}
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    full = {r.doc_id: list(r.ids) for r in bpe.encode(docs(spark, texts), vocabulary()).collect()}
    assert len(full[8]) == got[8].n_tokens
    assert bpe.digests(docs(spark, []), vocabulary()).count() == 0


def test_sequences_are_whole_and_gapless(spark, tokenizer):
    texts = ["word " * n for n in (0, 1, 5000, 9000, 4095, 4096)] + [None, "x y z"] * 20
    rows = packing.pack(packing.token_pieces(docs(spark, texts), vocabulary())).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.length for r in own] == [min(4096, len(ids) - a) for a in range(0, len(ids), 4096)]
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own)
    assert packing.pack(packing.token_pieces(docs(spark, []), vocabulary())).count() == 0


def test_packing_is_near_the_bound():
    x = np.random.default_rng(0).gamma(2, 500, 8000).astype(int).clip(1, 4096)
    order = packing.packing_order(np.arange(len(x)), np.zeros(len(x), int), x)
    bins, _, n = packing.sum_of_squares(x[order])
    assert np.bincount(bins, x[order]).max() <= 4096 and n <= -(-x.sum() // 4096) * 1.01


# --- 6 --------------------------------------------------------------------------------------------------------------


def test_shards_are_exact_and_gapless(spark):
    texts = [None, "", "a", "a"] + [f"é{i % 50}" for i in range(499)]
    rows = sharding.shard_documents(docs(spark, texts, [None, *range(len(texts) - 1)])).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        t = next((x for i, x in enumerate(texts[1:]) if i == r.doc_id), None) or ""
        assert r.size == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode())
    sizes = [len(v) for v in slots.values()]
    assert len(rows) == len(texts) and max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_documents(docs(spark, [])).count() == 0


def test_hypergeometric_law():
    rng = random.Random(1)
    draws = np.array([sharding.hypergeometric(rng, 30, 70, 40) for _ in range(20_000)])
    assert abs(draws.mean() - 12) < 0.1 and abs(draws.var() - 40 * 0.3 * 0.7 * 60 / 99) < 0.2
    big = sharding.hypergeometric(rng, 10**11, 3 * 10**11, 10**9)
    assert abs(big - 250_000_000) < 200_000
    m = sharding.communication_matrix([5, 0, 7], [4, 4, 4], 3)
    assert [sum(r) for r in m] == [5, 0, 7] and [sum(c) for c in zip(*m)] == [4, 4, 4]


# --- 3 --------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", r"<\|turn|> <|turn|> \< [\\INST] <<SYS>> \ ", "", None, "a\nb<|end|>", "<|im_start|>user"]
    rows = [(c, k, ("user", "assistant", "sys\ntem")[k % 3] if k != 4 else None, t) for c in (1, 2) for k, t in enumerate(said)]
    df = chat.format_records(chat.records_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = chat.conversation_digests(df).collect()
    turns = [(r or "", t or "") for _, _, r, t in rows[: len(said)]]
    loss = "".join(t for r, t in turns if r == "assistant")
    for r in got:
        assert r.n_turns == len(said) and r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    text = df.first().formatted
    assert text.count("<|turn|>") == text.count("<|end|>") == len(said) and "[INST]" not in text and "</s>" not in text


def test_chat_of_a_very_long_turn_and_rows_without_conversation(spark):
    part, n = 'a"b\n</s> \\x', 2_300_000
    rows = spark.range(1).select(F.lit(7).alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit(part), n).alias("text"))
    none = spark.createDataFrame([(None, 0, "assistant", "x"), (None, 0, "assistant", "x"), (None, 1, None, None)], "conv_id int, turn int, role string, text string")
    got = chat.conversation_digests(chat.format_records(chat.records_of(rows.union(none)))).collect()
    long = next(r for r in got if r.conv_id == 7)
    assert (long.n_turns, long.loss_chars) == (1, len(part) * n) and long.loss_sha256 == hashlib.sha256((part * n).encode()).hexdigest()
    assert sorted(r.loss_chars for r in got if r.conv_id is None) == [0, 1, 1]


def test_chat_layouts(spark):
    records = {
        '{"messages":[{"role":"human","content":"a","x":{"y":1}},{"role":"bot","content":null}],"id":3}': ("messages", ["user", "assistant"]),
        '{"conversations":[{"from":"human","value":"hi"}]}': ("conversations", ["user"]),
        '{"instruction":"i","input":"x","output":"o"}': ("instruction_input", ["system", "user", "assistant"]),
        '{"prompt":"p","completion":"c","meta":{"prompt":1,"response":"x"}}': ("prompt_completion", ["user", "assistant"]),
        '{"messages":[]}': ("messages", []),
        "no json": (None, None),
        '{"meta":{"messages":[{"role":"a","content":"b"}]}}': (None, None),
        '{"messages":[{"content":"a","meta":{"a":{"b":[{"c":{"d":1}}]}},"role":"user"},{"role":"bot","content":["x",":"]}]}': ("messages", ["user", "assistant"]),
        '{"x":{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":{"i":{"j":1}}}}}}}}}},"prompt":"a, \\"response\\": {","response":"r"}': ("prompt_response", ["user", "assistant"]),
        '{"prompt":"p","response":"cut': (None, None),
        '{"messages":7}': (None, None),
        '[{"prompt":"p","response":"r"}]': (None, None),
        None: (None, None),
    }
    df = spark.createDataFrame([(r, "x", 1) for r in records], "record string, layout string, turns int")
    out = chat.format_records(df)
    for r in out.collect():
        assert (r.layout, r.turns and [t.role for t in r.turns] if r.turns else r.turns) == records[r.record], r.record
    assert sorted(out.columns) == ["fingerprint", "formatted", "layout", "loss_spans", "record", "turns"]
    assert chat.format_records(df.where("false")).count() == 0
    told = spark.createDataFrame([('{"a":[{"b":[[{"c":1}]],"d":"x\\"{"}],"e":{}}',)], "r string").select(chat.field_paths(F.col("r"))).first()[0]
    assert told == ["a", "a[]", "a[].b", "a[].b[]", "a[].b[][]", "a[].b[][].c", "a[].d", "e"]
    same = [r[0] for r in spark.createDataFrame([('{"a":1,"b":[{"c":"x"}]}',), ('{"b":[{"c":"y"}],"a":2}',)], "r string").select(chat.fingerprint(F.col("r"))).collect()]
    assert same[0] == same[1]


# --- 4 and 5 --------------------------------------------------------------------------------------------------------


def vectors():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16))
    x[200:300] = x[:100] + rng.normal(size=(100, 16)) * 0.05
    x[300:360] = x[7] + rng.normal(size=(60, 16)) * 0.05
    rows = [(int(i), v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    return [*rows, (400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [None] * 16), (404, rows[3][1]), (404, rows[3][1]), (405, [1.0, 2.0])]


def test_links_of_embeddings(spark, monkeypatch):
    monkeypatch.setattr(caps, "BLOCK_VECTORS", 16)
    rng = np.random.default_rng(6)
    short = rng.normal(size=(30, 5))
    short[10:20] = short[:10] + rng.normal(size=(10, 5)) * 0.01
    rows = [*vectors(), *[(500 + i, v.astype(np.float32).tolist()) for i, v in enumerate(short)], (540, []), (541, [-3.0, 4.0]), (542, [2.0])]
    table = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, embedding array<float>, dim int, filter int, component string")
    got = caps.link(table).collect()
    assert len(got) == len(rows)
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    near = np.zeros((len(good), len(good)), bool)
    for a, (_, v) in enumerate(good):
        for b, (_, w) in enumerate(good):
            near[a, b] = a != b and len(v) == len(w) and v @ w >= 0.9 * np.linalg.norm(v) * np.linalg.norm(w)
    ids = np.array([i for i, _ in good])
    want, root = near.sum(1), ids.copy()
    for _ in range(len(ids)):
        root = np.minimum(root, np.where(near, root[None, :], 1 << 40).min(1))
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    for i in (400, 401, 402, 403, 540, 541, 542):
        assert by[i] == [(0, i, True)]
    found = {int(i): by[int(i)][0][0] for i in ids}
    assert 0.97 * want.sum() <= sum(by[int(i)][0][0] for i in ids) <= want.sum()
    whole = all(found[int(i)] == n for i, n in zip(ids, want))
    for i, n, c in zip(ids, want, root):
        assert found[int(i)] <= n and by[int(i)][0][2] == (by[int(i)][0][1] == i) and (not whole or by[int(i)][0][1] == c)
    assert sum(found[i] for i in range(500, 530)) == near[ids >= 500].sum()


def test_filters_keep_their_recall(monkeypatch):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(300, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=(300, 64))
    b -= (b * a).sum(1)[:, None] * a
    b = 0.9 * a + math.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1)[:, None]
    for n in (500, 50_000, 2_000_000):
        met = np.zeros(300, bool)
        for i in range(caps.CODES):
            code = caps.ProductCode(64, n, 19 + i)
            mine, theirs = (set(zip(*map(np.ndarray.tolist, code.filters(x)))) for x in (a, b))
            met[[r for r, _ in mine & theirs]] = True
        assert met.mean() > 0.94, n


def same_top_k(spark, rows, kind):
    """Against brute force in Python's integers."""
    names = "vec_id long, embedding array<%s>, shard string, score int, dim double" % kind
    got = {}
    for r in topk.top_k(spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], names), F.col("vec_id") % 4 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    z = [(i, [math.floor(Fraction(float(x)) * 256) for x in v]) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    for i, q in z:
        if i % 4 == 0:
            want = sorted({(-sum(a * b for a, b in zip(q, v)), j) for j, v in z if j != i and len(v) == len(q)})[:5]
            assert sorted(got.get(i, [])) == [(k, j, max(-topk.LONG, min(topk.LONG, -s))) for k, (s, j) in enumerate(want, 1)]


@pytest.mark.parametrize("size", [1e6, 1e8, 1e13, 1e200, 1e308])
def test_top_k_of_large_components(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "SHARD_ROWS", 16)
    monkeypatch.setattr(topk, "LEAF_ROWS", 4)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3)) * np.where(rng.random((60, 1)) < 0.5, 1.0, size / 4)
    x = np.clip(x, -1.7e308, 1.7e308)
    same_top_k(spark, [(i, v.tolist()) for i, v in enumerate([*x, *(x[:6] * (1 + 1e-15))])], "double")


def test_top_k_is_exact(spark, monkeypatch):
    for name, small in (("SHARD_ROWS", 64), ("LEAF_ROWS", 8), ("BOXES", 3), ("ASKED", 4), ("ASKS", 2), ("SAMPLE", 100)):
        monkeypatch.setattr(topk, name, small)
    rows = [*vectors(), (408, []), (412, []), (416, [])]
    same_top_k(spark, rows, "float")
    monkeypatch.setattr(topk, "SEND_BYTES", 0)
    same_top_k(spark, rows, "float")
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    assert caps.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- 1 --------------------------------------------------------------------------------------------------------------


def labelled(n, seed):
    rng = random.Random(seed)
    clean = ["".join(rng.choice(["ta", "ri", "mo", "ne", "lu", "ska"]) for _ in range(3)) for _ in range(300)]
    texts, labels = [], []
    for _ in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 120))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = "vequ" + rng.choice(["ta", "ri", "mo"]) if rng.random() < 0.5 else "grolk"
        texts.append(" ".join(words))
        labels.append(int(bad))
    return texts, np.array(labels)


def test_toxicity_held_out():
    texts, labels = labelled(500, 1)
    model = toxicity.fit(texts[:350], labels[:350])
    s, n = model.scores(*toxicity._as_bytes(texts[350:]))
    assert (((s >= toxicity.THRESHOLD) == labels[350:]).mean() > 0.95) and (n >= 1).all()


def test_toxicity_network_is_that_of_a_scalar_version():
    """Two gated recurrent networks, attention and pooling, with one number at a time."""
    import math

    rng = np.random.default_rng(3)
    w = {k: v.astype(np.float64) for k, v in toxicity.new_weights(2).items()}
    steps, H = 5, toxicity.HIDDEN
    x = rng.normal(size=(steps, toxicity.CHANNELS, 2))
    mask = (np.arange(steps)[:, None] < np.array([5, 3])).astype(float)
    got = toxicity.forward(w, x, mask)
    sig = lambda v: 1 / (1 + math.exp(-v))
    for k in range(2):
        states = [[0.0] * (2 * H) for _ in range(steps)]
        for d, order, off in (("f", range(steps), 0), ("b", range(steps - 1, -1, -1), H)):
            h = [0.0] * H
            for t in order:
                g = [sum(w["W" + d][i, c] * x[t, c, k] for c in range(toxicity.CHANNELS)) + w["c" + d][i, 0] for i in range(3 * H)]
                a = [sum(w["U" + d][i, j] * h[j] for j in range(H)) for i in range(3 * H)]
                if mask[t, k]:
                    new = []
                    for i in range(H):
                        z, r = sig(g[i] + a[i]), sig(g[H + i] + a[H + i])
                        new.append(z * h[i] + (1 - z) * math.tanh(g[2 * H + i] + r * a[2 * H + i]))
                    h = new
                states[t][off : off + H] = h
        e = [sum(w["v"][i, 0] * math.tanh(sum(w["A"][i, j] * s[j] for j in range(2 * H))) for i in range(H)) - (0 if mask[t, k] else 30) for t, s in enumerate(states)]
        share = [math.exp(v) / sum(map(math.exp, e)) for v in e]
        want = sum(w["u"][j, 0] * sum(p * s[j] for p, s in zip(share, states)) for j in range(2 * H)) + w["b"][0, 0]
        assert abs(got[k] - want) < 1e-5


def test_toxicity_is_fitted_on_a_bounded_sum(spark):
    texts, labels = labelled(40, 3)
    rows = docs(spark, [*texts, texts[0]], [*range(40), 0])
    known = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)], "doc_id long, toxic int")
    seen = []
    own, toxicity.fit = toxicity.fit, lambda t, y: seen.append((t, y))
    try:
        toxicity.train(rows, known, total=2000)
        toxicity.train(rows, known)
    finally:
        toxicity.fit = own
    assert sum(map(len, seen[0][0])) <= 2000 < sum(map(len, seen[1][0])) and sorted(seen[1][0]) == sorted(texts)
    assert all(labels[texts.index(t)] == y for t, y in zip(*seen[1]))


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in toxicity.new_weights(1).items()}
    x = rng.normal(size=(6, toxicity.CHANNELS, 3))
    mask = (np.arange(6)[:, None] < np.array([6, 3, 1])).astype(float)
    up = rng.normal(size=3)
    _, kept = toxicity.forward(w, x, mask, keep=True)
    g = toxicity.backward(w, x, mask, kept, up)
    for name in w:
        at = tuple(rng.integers(0, d) for d in w[name].shape)
        moved = {k: v.copy() for k, v in w.items()}
        sides = []
        for e in (1e-4, -1e-4):
            moved[name][at] = w[name][at] + e
            sides.append((toxicity.forward(moved, x, mask) * up).sum())
        assert abs((sides[0] - sides[1]) / 2e-4 - g[name][at]) < 2e-3, name


def test_toxicity_edge_cases(spark):
    texts, labels = labelled(120, 2)
    rows = docs(spark, [*texts, None, "", "grolk " * 30_000])
    known = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)] + [(5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(rows.withColumn("score", F.lit("x")), toxicity.train(rows, known)).collect()}
    assert len(got) == 123 and all(0 <= r.score <= 1 for r in got.values()) and got[122].n_windows > 1000
    none = toxicity.train(rows, known.where("false"))
    assert {r.score for r in toxicity.score(rows, none).collect()} == {0.0}
    assert toxicity.score(rows, none, keep=True).columns == [*rows.columns, "toxicity_score"]
    assert toxicity.score(rows.where("false"), none).count() == 0


# --- 9 --------------------------------------------------------------------------------------------------------------


def test_language_model(spark):
    texts = [*odd_texts(), *[" ".join(f"w{(i * j) % 40}" for j in range(80)) for i in range(40)]]
    rows = docs(spark, texts).withColumn("training", F.col("doc_id") % 4 != 0)
    got = {r.doc_id: r for r in lm.scores(rows).collect()}
    tokens = [[*WORD.findall((t or "").translate(LOWER)), "\n"] for t in texts]
    count: dict[str, int] = {}
    for i, words in enumerate(tokens):
        for w in words if i % 4 else []:
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, words in enumerate(tokens):
        base = sum(np.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in words)
        assert got[i].n_tokens == len(words) and got[i].train_tokens == n and got[i].n_known == sum(w in count for w in words)
        assert abs(got[i].base_score - base) < 1e-6 and got[i].score < 0
    assert lm.scores(rows.where("false")).count() == 0


def test_bits_make_a_distribution():
    """The probabilities of all bytes after a prefix add up to one."""
    m = lm.new_mixer(np.random.default_rng(0).integers(0, 9, 2 * int(lm.BASE[-1])).astype(np.uint16).view(np.uint32), 1.0)
    words = [bytes([97, b]) for b in range(256)]
    s = lm.spelling(words, np.zeros(256, int))
    total = np.zeros(256)
    for bit in range(8):
        at, y = lm.slots_at(s, bit)
        x, gate = lm.bit_inputs(m, at, None, np.ones(len(y), bool))
        p = lm.refined(m, lm.mix(m, x, gate), gate)
        second = np.arange(len(s.data)) - np.searchsorted(s.of, s.of) == 1
        total += np.log(np.where(y == 1, p, 1 - p))[second]
    assert abs(np.exp(total).sum() - 1) < 1e-4


# --- pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    rows = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in rows.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "MinHash near-dedup", "best-fit packing"]
    lines = common.staged(stages["line dedup"](spark, rows, sf), "t")
    want = dict(zip(sorted(before), brute_exact_lines([before[i] for i in sorted(before)])))
    got = {r.doc_id: r.text for r in lines.collect()}
    assert lines.columns == rows.columns and all(want[i] == t for i, t in got.items())
    assert all(not want[i].strip() for i in before if i not in got)
    near = stages["MinHash near-dedup"](spark, rows, sf)
    ids = sorted(before)
    groups = brute_groups([before[i] for i in ids], 5)
    assert sorted(r.doc_id for r in near.collect()) == [i for k, i in enumerate(ids) if groups[k][1] == k]
    larger = "/root/testdata/sf0.01"  # with labels enough to learn from
    rows, before = spark.read.parquet(f"{larger}/documents.parquet"), range(1000)
    kept = stages["toxicity"](spark, rows, larger)
    assert kept.columns == rows.columns and 0.8 * len(before) < kept.count() < len(before)
    assert stages["best-fit packing"](spark, rows, larger).select("doc_id").distinct().count() == len(before)


def brute_exact_lines(texts):
    """brute_lines() for real texts: pairs are compared only where a quick bound on the distance allows."""
    from collections import Counter

    first = {}
    for i, t in enumerate(texts):
        for k, line in enumerate(t.split("\n")):
            if len(s := line.strip()) >= 20:
                first.setdefault(s, (i, k))
    lines = sorted(first, key=len)
    bags = [Counter(x) for x in lines]
    gone = set()
    for j, b in enumerate(lines):
        for i in range(j - 1, -1, -1):
            if len(b) - len(lines[i]) > 2:
                break
            if sum(((bags[i] - bags[j]) + (bags[j] - bags[i])).values()) <= 4 and edit(lines[i], b) <= 2:
                gone.add(max(lines[i], b, key=first.get))
    return ["\n".join(x for k, x in enumerate(t.split("\n")) if len(s := x.strip()) < 20 or (s not in gone and first[s] == (i, k))) for i, t in enumerate(texts)]


def test_digests_need_no_hashes_of_code_points():
    lines = linededup.Lines(["　 twelve  words ", "a\n\n  b\t", "\U0001f600 end"])
    want = ["twelve  words", "a", "", "b", "\U0001f600 end"]
    assert lines.digests(np.arange(5)).tobytes() == b"".join(linededup.digest(x.encode("utf-32-le")) for x in want)
    assert "sums" not in vars(lines)
    assert lines.hashes(lines.start, lines.length).tolist()[1:3] == linededup.Lines(["a", ""]).hashes(np.array([0, 2]), np.array([1, 0])).tolist()


def test_the_driver_gives_back_what_it_no_longer_needs(monkeypatch):
    calls, mb = [], {"max": 800, "total": 600, "free": 500}

    class Runtime:
        maxMemory, totalMemory, freeMemory = (lambda self, k=k: mb[k] for k in ("max", "total", "free"))

        def gc(self):
            calls.append(mb["free"])

    class Session:
        class _jvm:
            class Runtime:
                getRuntime = staticmethod(lambda: None)

    Session._jvm.Runtime.getRuntime = staticmethod(Runtime)
    for mb["free"] in (500, 300):
        common.release_driver(Session)
    assert calls == [300]


def test_executors_collect_their_garbage(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    before = sum(b.getCollectionCount() for b in beans)
    common.release_executors(spark)
    assert sum(b.getCollectionCount() for b in beans) > before
