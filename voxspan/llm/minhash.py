"""Near-duplicate documents by a signature-coordinate inverted join.

Every document gets a MinHash signature of `coords` coordinates over its word shingles. Each (coordinate, value) pair
is a token under which documents are posted. Two documents whose signatures agree in at least `matches` coordinates
share a token among their coords - matches + 1 rarest ones (the prefix), so only those are posted, and tokens that
one document alone has are skipped altogether.

Inside a posting list, collisions are counted by merging the lists of all coordinates: the shorter ones are merged, the
matches - 1 longest are skipped, and only what the short ones bring often enough is looked up in them. A pair above the
match threshold is retained under the first token that both have posted, and nowhere else; a list keeps the documents of
its retained pairs, never the pairs. There links are confirmed on full shingle sets, and a pair that confirmed links
connect already is not compared.

Equal shingle sets are one class from the start. A list of many documents or shingles is dealt to pairs of bounded blocks, in two rounds: first
each block by itself and with the list's first block, then, after the components of what was confirmed, the other pairs
of blocks, but only for documents that are not yet connected. So a large group of near copies costs two rows for each.

Edge cases: null or blank texts have an empty set and link with nothing; texts under k words are one shingle;
repeated rows are copies of each other, and so are rows without doc_id; different texts under one doc_id are different
documents; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HUB, HUBS, U64, _to_least, batches_of, block_pairs, components, hash_spans, mixed, random_odd, run_groups, split_words, staged

#: With 32 coordinates a pair at similarity 0.8 agrees in fewer than 16 once in 15,000 times.
COORDS, MATCHES = 32, 16
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 300_000
#: Lists of so few documents have nothing worth skipping.
FEW = 32
#: Up to so many ids of documents to look up are sent to all tasks; more meet the texts by a shuffle.
SEND_IDS = 500_000


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all k-word shingles, row by row, and each row's offsets. Rows of 1 to k - 1 words have one."""
    starts, ends, first = split_words(data, offsets)
    words = hash_spans(data, starts, ends)
    n_words = np.diff(first)
    n = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    out_first = np.concatenate([[0], np.cumsum(n)])
    factor = random_odd(k, 37)
    if len(words) >= k:
        every = words[: len(words) - k + 1] * factor[0]
        for i in range(1, k):
            every = every + words[i : len(words) - k + 1 + i] * factor[i]
    else:
        every = np.zeros(0, U64)
    at = np.arange(int(out_first[-1])) - np.repeat(out_first[:-1], n) + np.repeat(first[:-1], n)
    out = np.zeros(len(at), U64)
    whole = np.repeat(n_words >= k, n)
    out[whole] = mixed(every[at[whole]])
    for row in np.flatnonzero((n_words > 0) & (n_words < k)):
        w = words[first[row] : first[row + 1]]
        out[out_first[row]] = mixed(np.array([int((w * factor[: len(w)]).sum() + U64(len(w)))], U64))[0]
    return out, out_first


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _set_of(values: np.ndarray) -> tuple[np.ndarray, int, int]:
    own = np.unique(values)
    a, b = own.sum(dtype=U64), (mixed(own ^ U64(0x5851F42D4C957F2D))).sum(dtype=U64)
    return own, int(a.astype(np.int64)), int(b.astype(np.int64))


SIGNATURE_SCHEMA = "doc_id long, t long, row long, n_shingles long, set_a long, set_b long, tokens array<long>"


def signatures(docs: DataFrame, k: int, coords: int = COORDS) -> DataFrame:
    """doc_id, t (hash of text), row (hash of the row), n_shingles (set size), set_a and set_b (a 128-bit hash of the set), tokens (one for each coordinate; null if empty)."""
    factor, shift = random_odd(coords, 101), random_odd(coords, 103)
    salt = random_odd(coords, 107)

    def run(batches):
        for batch, data, offsets in batches_of("text")(batches):
            sh, first = shingle_hashes(data, offsets, k)
            rows = len(first) - 1
            full = np.flatnonzero(np.diff(first))
            tokens = np.zeros((len(full), coords), U64)
            for j in range(coords if len(full) else 0):
                tokens[:, j] = np.minimum.reduceat((sh ^ shift[j]) * factor[j], first[full])
            tokens = mixed(tokens + salt)
            n, a, b = (np.zeros(rows, np.int64) for _ in range(3))
            for r in full:
                own, a[r], b[r] = _set_of(sh[first[r] : first[r + 1]])
                n[r] = len(own)
            lens = np.zeros(rows, np.int64)
            lens[full] = coords
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), _signed(tokens.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(n), pa.array(a), pa.array(b), lists], names=["doc_id", "t", "row", "n_shingles", "set_a", "set_b", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash().alias("t"), row_hash(docs).alias("row"))
    return rows.mapInArrow(run, SIGNATURE_SCHEMA)


def text_hash():
    return F.xxhash64(F.col("text").cast("string"))


def row_hash(docs: DataFrame):
    """A hash of all columns that can be hashed."""
    return F.xxhash64(F.lit(1), *[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"])


def _flat(column, width: int | None = None) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, width) if width else flat


def _edges(ids: np.ndarray, comp: np.ndarray) -> pa.Table | None:
    moved = np.flatnonzero(comp != np.arange(len(comp)))
    return pa.table({"a": ids[moved], "b": ids[comp[moved]]}) if len(moved) else None


def collisions(sig: np.ndarray, matches: int):
    """(i, js) for each row i: the later rows that agree with it in at least `matches` coordinates."""
    m, coords = sig.shape
    if m <= FEW:  # all lists are short: they are merged at once
        count = (sig[:, None] == sig[None]).sum(2)
        for i in range(m - 1):
            found = i + 1 + np.flatnonzero(count[i, i + 1 :] >= matches)
            if len(found):
                yield i, found
        return
    members, first, number = [], [], np.empty((m, coords), np.int64)
    for c in range(coords):
        order = np.argsort(sig[:, c], kind="stable")
        new = np.append(True, sig[order[1:], c] != sig[order[:-1], c])
        number[order, c] = np.cumsum(new) - 1
        members.append(order)
        first.append(np.append(np.flatnonzero(new), m))
    length = np.stack([np.diff(first[c])[number[:, c]] for c in range(coords)], 1)
    by_length = np.argsort(length, 1, kind="stable")
    for i in range(m - 1):
        if (length[i] > 1).sum() < matches:
            continue
        short, long = by_length[i, : coords - matches + 1], by_length[i, coords - matches + 1 :]
        lists = []
        for c in short:
            at = number[i, c]
            own = members[c][first[c][at] : first[c][at + 1]]
            lists.append(own[np.searchsorted(own, i, "right") :])
        found, count = np.unique(np.concatenate(lists), return_counts=True)
        if len(found):
            count = count + (sig[found][:, long] == sig[i, long]).sum(1)
            found = found[count >= matches]
        if len(found):
            yield i, found


def posting_lists(reps: DataFrame, matches: int, coords: int) -> DataFrame:
    """token, cid, n_shingles, tokens, before (tokens that the document has posted ahead of this one), posts, total (shingles of its documents)."""
    posted = reps.select("cid", "n_shingles", F.explode("tokens").alias("token"))
    common = posted.groupBy("token").agg(F.count(F.lit(1)).alias("posts"), F.sum("n_shingles").alias("total")).where("posts > 1")
    prefix = coords - matches + 1
    own = posted.drop("n_shingles").join(common, "token").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("posts", "token", "total"))).alias("posted"))  # coords at most
    # a token that is posted once stands before all others in the prefix, and joins with nothing
    own = own.select("cid", F.expr(f"slice(posted, 1, greatest(0, {prefix} - ({coords} - size(posted))))").alias("posted")).where("size(posted) > 0")
    entries = own.join(reps.select("cid", "n_shingles", "tokens"), "cid").select("cid", "n_shingles", "tokens", F.col("posted.token").alias("all"), F.posexplode("posted").alias("i", "p"))
    return entries.select("cid", "n_shingles", "tokens", F.slice("all", F.lit(1), F.col("i")).alias("before"), "p.token", "p.posts", "p.total")


def retained(dealt: DataFrame, matches: int, coords: int, percent: int) -> DataFrame:
    """token, lo, hi, side, cid: the documents of each dealt list that are in a pair above the match threshold, under its first token.

    dealt: token, lo, hi, side, cid, n_shingles, tokens, before, comp (null, or a component: pairs within one are left out).
    """

    def count(group: pa.Table) -> pa.Table | None:
        m = group.num_rows
        if m < 2:
            return None
        size, side, sig = group["n_shingles"].to_numpy(), group["side"].to_numpy(), _flat(group["tokens"], coords)
        across = group["lo"][0].as_py() != group["hi"][0].as_py()
        comp = group["comp"].fill_null(-1).to_numpy()
        before = group["before"].combine_chunks()
        lens = np.diff(before.offsets.to_numpy())
        ahead = np.zeros((m, max(1, int(lens.max(initial=1)))), np.int64)
        ahead[np.arange(ahead.shape[1]) < lens[:, None]] = before.flatten().to_numpy()
        keep = np.zeros(m, bool)
        for i, js in collisions(sig, matches):
            if keep[i]:
                js = js[~keep[js]]
            ok = 100 * np.minimum(size[js], size[i]) >= percent * np.maximum(size[js], size[i])
            ok &= (comp[js] != comp[i]) | (comp[i] < 0)
            if across:
                ok &= side[js] != side[i]
            js = js[ok]
            if len(js) and lens[i]:
                js = js[~((ahead[js][:, :, None] == ahead[i, : lens[i]]) & (np.arange(ahead.shape[1]) < lens[js][:, None])[:, :, None]).any((1, 2))]
            if len(js):
                keep[i] = True
                keep[js] = True
        if not keep.any():
            return None
        own = np.flatnonzero(keep)
        return group.select(["token", "lo", "hi", "side", "cid"]).take(pa.array(own))

    return run_groups(dealt, ["token", "lo", "hi"], count, "token long, lo int, hi int, side int, cid long")


def link_sets(sets: list[np.ndarray], side: np.ndarray | None, percent: int) -> np.ndarray:
    """Smallest index reachable by links with 100 * intersection >= percent * union. Pairs that are connected already are not compared."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    first = np.cumsum(size) - size
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(int(codes.max()) + 1, bool)
    comp = np.arange(n)
    for i in range(n - 1):
        rest = np.arange(i + 1, n)
        ok = (100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])) & (comp[rest] != comp[i])
        if side is not None:
            ok &= side[rest] != side[i]
        rest = rest[ok]
        if not len(rest):
            continue
        mark[codes[first[i] : first[i] + size[i]]] = True
        if 8 * len(rest) < n:
            both = np.array([mark[codes[first[j] : first[j] + size[j]]].sum() for j in rest])
        else:
            both = np.add.reduceat(mark[codes].astype(np.int32), first)[rest]
        mark[codes[first[i] : first[i] + size[i]]] = False
        rest = rest[100 * both >= percent * (size[rest] + size[i] - both)]
        if len(rest):
            seen = np.unique(comp[np.append(rest, i)])
            comp[np.isin(comp, seen)] = seen[0]
    return comp


def confirmed(docs: DataFrame, members: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Edges (a, b) of confirmed links that connect the same classes as all confirmed links inside the lists do. members: as retained() gives them, staged."""
    wanted = staged(members.select("cid").distinct().join(reps.select("cid", "rep.doc_id", "rep.t", "set_a", "set_b"), "cid").withColumnRenamed("doc_id", "its_id").withColumnRenamed("t", "its_t"), "minhash-wanted")
    sent = F.broadcast(wanted) if wanted.count() <= SEND_IDS else wanted
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(sent, (F.xxhash64("text") == F.col("its_t")) & F.col("doc_id").eqNullSafe(F.col("its_id"))).select("cid", "text", "set_a", "set_b")

    def sets(batches):
        for batch, data, offsets in batches_of("text")(batches):
            sh, first = shingle_hashes(data, offsets, k)
            a, b = batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()
            blobs = []
            for r in range(len(first) - 1):
                own, own_a, own_b = _set_of(sh[first[r] : first[r + 1]])
                blobs.append(own.tobytes() if (own_a, own_b) == (a[r], b[r]) else None)  # another text with this hash
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(blobs, pa.binary())], names=["cid", "shingles"])

    found = rows.mapInArrow(sets, "cid long, shingles binary").where("shingles is not null")
    dealt = members.join(found.groupBy("cid").agg(F.first("shingles").alias("shingles")), "cid").select("token", "lo", "hi", "side", "cid", "shingles")

    def link(group: pa.Table) -> pa.Table | None:
        ids = group["cid"].to_numpy()
        if len(ids) < 2:
            return None
        side = group["side"].to_numpy() if group["lo"][0].as_py() != group["hi"][0].as_py() else None
        return _edges(ids, link_sets([np.frombuffer(x, U64) for x in group["shingles"].to_pylist()], side, percent))

    return run_groups(dealt, ["token", "lo", "hi"], link, "a long, b long")


def linked_classes(docs: DataFrame, reps: DataFrame, k: int, percent: int, coords: int, matches: int) -> DataFrame:
    """id, component of the classes that have a link."""
    lists = posting_lists(reps, matches, coords).withColumn("blocks", F.greatest(F.ceil(F.col("posts") / BLOCK_DOCS), F.ceil(F.col("total") / BLOCK_SHINGLES))).withColumn("comp", F.lit(None).cast("long"))
    columns = ["token", "lo", "hi", "side", "cid", "n_shingles", "tokens", "before", "comp"]
    side = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    # first round: a block with itself, and with the first one; those of the first block meet all others
    first = lists.withColumn("side", side)
    with_first = F.when(F.col("side") == 0, F.expr("sequence(0, cast(blocks as int) - 1)")).otherwise(F.array(F.lit(0), F.col("side")))
    first = first.withColumn("o", F.explode(with_first)).withColumn("lo", F.least("side", "o")).withColumn("hi", F.greatest("side", "o"))
    first = first.where((F.col("o") != F.col("side")) | (F.col("lo") == F.col("hi")))
    members = staged(retained(first.select(*columns), matches, coords, percent), "minhash-members")
    edges = staged(confirmed(docs, members, reps, k, percent), "minhash-edges")
    joined = staged(components(edges, "minhash-links"), "minhash-joined")
    long = lists.where("blocks > 2")
    if long.isEmpty():
        return joined
    # second round: the other pairs of blocks, in the lists that hold more than one component
    long = long.drop("comp").join(joined.withColumnRenamed("id", "cid").withColumnRenamed("component", "comp"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    mixed_lists = long.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("token")
    dealt = block_pairs(long.join(mixed_lists, "token", "left_semi"), ["token"], "cid", "blocks").where("lo > 0 and lo < hi")
    members = staged(retained(dealt.select(*columns), matches, coords, percent), "minhash-members")
    return staged(components(edges.union(confirmed(docs, members, reps, k, percent)), "minhash-links"), "minhash-joined")


def classified(docs: DataFrame, k: int = 5, percent: int = 80, coords: int = COORDS, matches: int = MATCHES) -> DataFrame:
    """A row for each document: doc_id, t, row, n_shingles, component (a number for each group of linked documents; null for empty sets), component_id."""
    sigs = staged(signatures(docs, k, coords), "minhash-signatures")
    reps = sigs.where("n_shingles > 0").groupBy("n_shingles", "set_a", "set_b").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("rep"), F.max("tokens").alias("tokens"))
    reps = staged(reps.withColumn("cid", F.monotonically_increasing_id()), "minhash-classes")  # written, so the numbers stay
    joined = linked_classes(docs, reps, k, percent, coords, matches)
    least = joined.join(reps.select(F.col("cid").alias("id"), "rep.doc_id"), "id").groupBy("component").agg(F.min("doc_id").alias("m"), F.count(F.lit(1)).alias("n")).withColumnRenamed("component", "u")
    limit = max(HUB, -(-joined.count() // HUBS))
    ids = _to_least(joined.select(F.col("id").alias("a"), F.col("component").alias("b")), "b", least, limit).select(F.col("a").alias("cid"), F.col("b").alias("component"), F.col("m").alias("least"))
    classes = reps.select("n_shingles", "set_a", "set_b", "cid", "rep.doc_id").join(ids, "cid", "left")
    classes = classes.select("n_shingles", "set_a", "set_b", F.coalesce("component", "cid").alias("component"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
    out = sigs.drop("tokens").join(classes, ["n_shingles", "set_a", "set_b"], "left")
    return out.select("doc_id", "t", "row", "n_shingles", "component", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, coords: int = COORDS, matches: int = MATCHES) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id = component_id): a row for each document."""
    out = classified(docs, k, percent, coords, matches).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def first_of_each(docs: DataFrame, k: int = 5, percent: int = 80, coords: int = COORDS, matches: int = MATCHES) -> DataFrame:
    """docs with one row of each group: the one with the smallest doc_id (null last), then row hash. Rows with empty sets all stay."""
    found = staged(classified(docs, k, percent, coords, matches).where("component is not null").groupBy("component", "doc_id", "t", "row").agg(F.count(F.lit(1)).alias("times")), "minhash-rows")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t", "row")).alias("first"), F.sum("times").alias("of")).where("of > 1")
    marks = found.join(first, "component").select("doc_id", "t", "row", (F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t", "row") == F.col("first")).alias("stays"), "times")
    marks = staged(marks.where("not stays or times > 1").select(F.col("doc_id").alias("_its_id"), F.col("t").alias("_its_t"), F.col("row").alias("_its_row"), F.col("stays").alias("_stays")), "minhash-marks")
    sent = F.broadcast(marks) if marks.count() <= SEND_IDS else marks
    same = (row_hash(docs) == F.col("_its_row")) & (text_hash() == F.col("_its_t")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_its_id"))
    met = docs.join(sent, same, "left")
    # rows that are the same in all columns are there once
    once = met.where("_stays").dropDuplicates(["_its_id", "_its_t", "_its_row"])
    return met.where("_its_row is null").unionByName(once).select(*[F.col(f"`{c}`") for c in docs.columns])
