"""Exact top-k inner products by a KD-tree for each shard of vectors.

Vectors become integers, floor(256 * x). A coarse KD-tree, median splits of a bounded sample (SAMPLE rows), deals every
row to a cell of space; a cell with more than SHARD_ROWS rows is dealt on to several shards by a hash. Each shard is a
KD-tree of its own: median splits along the widest side, down to leaves, every node with a tight bounding box. A query
visits nodes best first: a box bounds the inner product by the sum over dimensions of the larger of q * low and q * high,
and a node is left out when its bound is under the kth score so far, or equals it with no smaller id to gain.

A first round searches each query's own shard; its kth score is a floor for all that follows. Before anything meets, the
boxes of all other shards are held against those floors, and a query is sent only to the shards whose box may hold a
better row. A shard travels once, with the queries that ask for it after it; one that very many ask for is copied to
several tasks.

Scores are exact: sums below 2^53 are taken in doubles, below 2^63 in 64-bit integers, and beyond in Python's integers. A
score outside a long is ranked by its true value and returned as the nearest long.

Edge cases: vectors that are null, or hold null or non-finite components, take no part; zero and empty vectors do; with
fewer than k candidates all are returned; ties go to the smaller vec_id; a query never meets its own row, repeated rows
with its vec_id included; rows without vec_id take no part; vectors of another length than the query are not candidates
of it; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, run_groups, staged

SHARD_ROWS, LEAF_ROWS, SAMPLE, CELLS = 16_384, 256, 8192, 1024
#: Boxes that travel in one row, queries in one row of a request, and requests that one copy of a shard answers.
BOXES, ASKED, ASKS = 512, 512, 256
#: Boxes of so many bytes in all are sent to all tasks; more meet the queries by a join on parts of both.
SEND_BYTES = 64_000_000
LONG = (1 << 63) - 1
LEAST = -(1 << 62)
_WIDE = 10**700


class Numbers:
    """Integer vectors: as int32 where all fit, else as the doubles x they come from. z holds floor(256 * x)."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.most = float(np.abs(x).max(initial=0.0)) if x.dtype != np.int32 else float(np.abs(x.astype(np.int64)).max(initial=0)) / 256
        if x.dtype == np.int32:
            self.z = x.astype(np.float64)
        elif self.most < 2.0**900:
            self.z = np.floor(x * 256)
        else:
            self.z = None

    def take(self, at) -> Numbers:
        return Numbers(self.x[at])

    def exact(self) -> np.ndarray:
        """Python integers."""
        flat = [int(v) for v in self.x.ravel()] if self.x.dtype == np.int32 else [int(v) * 256 if abs(v) >= 2.0**60 else int(np.floor(v * 256)) for v in self.x.ravel().tolist()]
        out = np.empty(len(flat), object)
        out[:] = flat
        return out.reshape(self.x.shape)


def _mode(a: Numbers, b: Numbers) -> int:
    """How products of two sets are summed: 0 in doubles, 1 in 64-bit integers, 2 in Python's integers."""
    top = (a.most * 256 + 1) * (b.most * 256 + 1) * max(1, a.x.shape[1])
    return 0 if top < 2.0**53 else 1 if top < 2.0**62 else 2


class Tree:
    """A KD-tree; nodes in arrays, rows reordered so that a node's are together."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int | None = None):
        leaf = leaf or LEAF_ROWS
        order = np.argsort(ids, kind="stable")
        spans, kids, lows, highs, todo = [], [], [], [], [(0, len(ids), None)]
        while todo:
            lo, hi, parent = todo.pop()
            own = x[order[lo:hi]]
            low, high = own.min(0), own.max(0)
            node = len(spans)
            spans.append((lo, hi))
            kids.append([])
            lows.append(low)
            highs.append(high)
            if parent is not None:
                kids[parent].append(node)
            if hi - lo > leaf and (high > low).any():
                axis, mid = int((high / 2 - low / 2).argmax()), (hi - lo) // 2
                part = np.argpartition(own[:, axis], mid)
                order[lo:hi] = order[lo:hi][part]
                todo += [(lo, lo + mid, node), (lo + mid, hi, node)]
        self.ids, self.rows = ids[order], Numbers(x[order])
        self.spans, self.kids = spans, kids
        self.low, self.high = Numbers(np.array(lows)), Numbers(np.array(highs))
        self.least_id = np.array([self.ids[a:b].min() for a, b in spans])
        self.whole = {0: self.rows.z}

    def integers(self, mode: int) -> np.ndarray:
        if mode not in self.whole:
            self.whole[mode] = self.rows.z.astype(np.int64) if mode == 1 else self.rows.exact()
        return self.whole[mode]

    def search(self, q: np.ndarray, q_id: int, mode: int, bound: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """Best-first search: a heap of (score, -id). Scores under floor are of no use. q: as the mode wants it."""
        x, best = self.integers(mode), []
        heap = [(-bound[0], 0)]
        while heap:
            up, node = heapq.heappop(heap)
            kth = max(best[0][0], floor) if len(best) == k else floor
            if -up < kth:
                break
            if len(best) == k and -up == kth == best[0][0] and self.least_id[node] >= -best[0][1]:
                continue
            if self.kids[node]:
                for kid in self.kids[node]:
                    if bound[kid] >= kth:
                        heapq.heappush(heap, (-bound[kid], kid))
                continue
            a, b = self.spans[node]
            score = x[a:b] @ q if x.shape[1] else np.zeros(b - a)
            useful = np.flatnonzero(score >= kth)
            for i in useful[np.lexsort([self.ids[a + useful], -score[useful]])] if mode < 2 else sorted(useful, key=lambda i: (-score[i], self.ids[a + i])):
                own = int(self.ids[a + i])
                item = (int(score[i]), -own)
                if own == q_id or item in best:
                    continue
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
                else:
                    break
        return best


def bounds(q: Numbers, low: Numbers, high: Numbers) -> np.ndarray:
    """(queries, boxes) at least the largest inner product that each box allows."""
    if not q.x.shape[1]:
        return np.zeros((len(q.x), len(low.x)))
    most = max(low.most, high.most)
    if q.z is None or low.z is None or high.z is None or (q.most * 256 + 1) * (most * 256 + 1) * q.x.shape[1] > 1e300:
        return np.full((len(q.x), len(low.x)), np.inf)
    up = np.maximum(q.z, 0) @ high.z.T + np.minimum(q.z, 0) @ low.z.T
    if (q.most * 256 + 1) * (most * 256 + 1) * q.x.shape[1] >= 2.0**53:  # rounding must not make a bound too small
        up = up + (np.abs(q.z) @ np.maximum(np.abs(low.z), np.abs(high.z)).T) * (4 * q.x.shape[1] * 2.0**-52)
    return up


def finite_vectors(vectors: DataFrame) -> DataFrame:
    """The different vec_id, v (doubles), dim of the vectors without null or non-finite components."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(good).distinct().withColumn("dim", F.size("v"))  # a row that occurs twice is one candidate


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _blob(x: np.ndarray) -> tuple[bytes, int]:
    z = np.floor(x * 256) if not x.size or np.abs(x).max() < 2.0**22 else None
    return (z.astype("<i4").tobytes(), 4) if z is not None else (x.astype("<f8").tobytes(), 8)


def _unblob(x: bytes, wide: int, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(x, np.int32 if wide == 4 else np.float64).reshape(rows, dim)


@dataclass
class Cells:
    """A coarse KD-tree: for each node the axis, the value and the two nodes below, or a cell."""

    nodes: list[tuple]

    @staticmethod
    def of(x: np.ndarray, cells: int) -> Cells:
        nodes: list[tuple] = [()]
        n, todo = 0, [(0, x, cells)]
        while todo:
            at, own, want = todo.pop()
            wide = own.max(0) / 2 - own.min(0) / 2 if own.size else np.zeros(1)
            cut = None
            if want > 1 and len(own) > 1 and wide.max() > 0:
                axis = int(wide.argmax())
                cut = float(np.median(own[:, axis]))
                left = own[:, axis] < cut
                if not left.any():
                    cut = float(own[own[:, axis] > cut, axis].min())
                    left = own[:, axis] < cut
            if cut is None:
                nodes[at] = (n,)
                n += 1
                continue
            nodes[at] = (axis, cut, len(nodes), len(nodes) + 1)
            todo += [(len(nodes), own[left], want // 2), (len(nodes) + 1, own[~left], want - want // 2)]
            nodes += [(), ()]
        return Cells(nodes)

    def place(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            if len(node) == 1 or not len(rows):
                out[rows] = node[0] if len(node) == 1 else 0
                continue
            left = x[rows, node[0]] < node[1]
            todo += [(node[2], rows[left]), (node[3], rows[~left])]
        return out


def dealt_rows(rows: DataFrame) -> DataFrame:
    """rows with shard: cells of space, and hashed parts of the crowded ones."""
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(64).collect()}
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).select("dim", "v").toArrow()  # SAMPLE rows at most
    trees = {}
    for dim, n in sizes.items():
        own = sample.filter(pa.compute.equal(sample["dim"], dim))
        if dim and n > SHARD_ROWS and own.num_rows:
            trees[dim] = Cells.of(_matrix(own["v"], dim), min(CELLS, -(-n // SHARD_ROWS), max(1, own.num_rows // 4)))
    sent = rows.sparkSession.sparkContext.broadcast(trees)  # CELLS nodes of three numbers for each of 64 lengths

    def place(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            cell = np.zeros(batch.num_rows, np.int64)
            for dim in np.unique(dims):
                if int(dim) in sent.value:
                    at = np.flatnonzero(dims == dim)
                    cell[at] = sent.value[int(dim)].place(_matrix(batch.column(1).take(pa.array(at)), int(dim)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["vec_id", "v", "dim", "cell"])

    placed = staged(rows.select("vec_id", "v", "dim").mapInArrow(place, "vec_id long, v array<double>, dim int, cell long"), "topk-cells")
    # one row for SHARD_ROWS vectors at most, of three numbers
    crowd = placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).alias("parts")).where("parts > 1")
    placed = placed.join(F.broadcast(crowd), ["dim", "cell"], "left")
    part = F.pmod(F.xxhash64("vec_id", "v"), F.coalesce("parts", F.lit(1).cast("long")))
    return placed.select("vec_id", "v", "dim", (F.col("cell") * F.lit(1 << 32) + part).alias("shard"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best. vectors: vec_id, embedding; is_query: a condition on vec_id."""
    rows = dealt_rows(finite_vectors(vectors)).withColumn("asks", F.coalesce(is_query, F.lit(False)))

    def pack(group: pa.Table) -> pa.Table:
        """A shard: its rows, its box, its own queries and what they find in it."""
        dim, ids = group["dim"][0].as_py(), group["vec_id"].to_numpy()
        x = _matrix(group["v"], dim)
        data, wide = _blob(x)
        asks = np.flatnonzero(group["asks"].to_numpy(zero_copy_only=False))
        tree = Tree(ids, _unblob(data, wide, len(ids), dim))
        q = Numbers(_unblob(data, wide, len(ids), dim)[asks])
        floors, found = answer(tree, ids[asks], q, [LEAST] * len(asks), k) if len(asks) else ([], [])
        box = [x.min(0).astype("<f8").tobytes(), x.max(0).astype("<f8").tobytes()]
        q_data, q_wide = _blob(x[asks])
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "shard": [group["shard"][0].as_py()], "wide": pa.array([wide], pa.int32()),
            "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "x": pa.array([data], pa.binary()), "low": pa.array(box[:1], pa.binary()), "high": pa.array(box[1:], pa.binary()),
            "q_wide": pa.array([q_wide], pa.int32()), "q_ids": pa.array([ids[asks].astype("<i8").tobytes()], pa.binary()), "q_x": pa.array([q_data], pa.binary()),
            "floors": pa.array([np.array(floors, "<i8").tobytes()], pa.binary()), "found": pa.array([found], pa.list_(FOUND)),
        })

    schema = f"dim int, shard long, wide int, ids binary, x binary, low binary, high binary, q_wide int, q_ids binary, q_x binary, floors binary, found array<{FOUND_SQL}>"
    packed = staged(run_groups(rows, ["dim", "shard"], pack, schema), "topk-shards")

    # boxes travel in rows of BOXES, and every block of queries meets each of those rows of its length
    slot = F.pmod(F.xxhash64("shard"), F.lit(64))
    place = F.floor((F.row_number().over(Window.partitionBy("dim", slot).orderBy("shard")) - 1) / BOXES) * 64 + slot
    boxes = packed.select("dim", "shard", "low", "high").withColumn("chunk", place).groupBy("dim", "chunk").agg(F.collect_list(F.struct("shard", "low", "high")).alias("boxes"))
    boxes = staged(boxes, "topk-boxes")
    blocks = packed.where(F.length("q_ids") > 0).select("dim", "shard", "q_wide", "q_ids", "q_x", "floors")
    size = packed.agg(F.sum(F.length("low") + F.length("high") + 16), F.count(F.lit(1))).first()
    if (size[0] or 0) <= SEND_BYTES:
        met = blocks.join(F.broadcast(boxes), "dim")
    else:
        parts = -(-size[1] // ASKS)
        met = blocks.join(boxes.select("dim", "chunk").groupBy("dim").agg(F.collect_list("chunk").alias("chunks")), "dim").withColumn("chunk", F.explode("chunks")).drop("chunks")
        met = met.withColumn("part", F.pmod(F.xxhash64("shard"), F.lit(parts)))
        met = met.join(boxes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))), ["dim", "chunk", "part"])
    asked = met.select("dim", "shard", "q_wide", "q_ids", "q_x", "floors", "boxes").mapInArrow(_requests, REQUEST)
    asked = staged(asked, "topk-requests")
    # a shard goes ahead of the requests for it
    copies = asked.groupBy("dim", "shard").agg(F.ceil(F.count(F.lit(1)) / ASKS).alias("copies"))
    empty = F.lit(None).cast("binary")
    shards = packed.select("dim", "shard", "wide", "ids", "x").join(copies, ["dim", "shard"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    shards = shards.select("dim", "shard", "copy", F.lit(0).alias("turn"), "wide", "ids", "x", empty.alias("floors"))
    asks = asked.join(copies, ["dim", "shard"]).withColumn("copy", F.pmod(F.xxhash64("home", "part"), F.col("copies")))
    both = shards.unionByName(asks.select("dim", "shard", "copy", F.lit(1).alias("turn"), F.col("q_wide").alias("wide"), F.col("q_ids").alias("ids"), F.col("q_x").alias("x"), "floors"))

    def search(batches):
        tree = None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                ids = np.frombuffer(r["ids"], "<i8")
                x = _unblob(r["x"], r["wide"], len(ids), r["dim"])
                if r["turn"] == 0:
                    tree = Tree(ids, x)
                    continue
                _, found = answer(tree, ids, Numbers(x), np.frombuffer(r["floors"], "<i8").tolist(), k)
                if found:
                    yield pa.RecordBatch.from_struct_array(pa.array(found, FOUND))
        release()

    second = both.repartition("dim", "shard", "copy").sortWithinPartitions("dim", "shard", "copy", "turn").mapInArrow(search, FOUND_SQL[7:-1].replace(":", " "))
    every = packed.select(F.explode("found").alias("f")).select("f.*").unionByName(second).distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("tail"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


FOUND = pa.struct([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("tail", pa.string())])
FOUND_SQL = "struct<query_id:long,vec_id:long,score:long,tail:string>"
REQUEST = "dim int, shard long, home long, part int, q_wide int, q_ids binary, q_x binary, floors binary"


def answer(tree: Tree, ids: np.ndarray, q: Numbers, floors: list[int], k: int) -> tuple[list[int], list[dict]]:
    """The kth score of each query in this tree (or its floor), and what was found."""
    mode = _mode(q, tree.rows)
    values = q.z if mode == 0 else q.z.astype(np.int64) if mode == 1 else q.exact()
    bound = bounds(q, tree.low, tree.high)
    out, low = [], []
    for i, own in enumerate(ids.tolist()):
        floor = -np.inf if floors[i] <= LEAST else floors[i]
        best = tree.search(values[i], own, mode, bound[i], k, floor)
        kth = best[0][0] if len(best) == k else LEAST
        low.append(max(LEAST, min(kth, LONG)))
        for s, v in best:
            far = abs(s) > LONG
            out.append({"query_id": own, "vec_id": -v, "score": max(-LONG, min(s, LONG)), "tail": str(s % _WIDE).zfill(700) if far else None})
    return low, out


def _requests(batches):
    """For a block of queries and a row of boxes: the queries that each of the shards may better."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
            ids, floors = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["floors"], "<i8")
            q = Numbers(_unblob(r["q_x"], r["q_wide"], len(ids), r["dim"]))
            low, high = (Numbers(np.frombuffer(b"".join(b[e] for b in r["boxes"]), "<f8").reshape(len(r["boxes"]), r["dim"])) for e in ("low", "high"))
            wanted = bounds(q, low, high) >= np.where(floors <= LEAST, -np.inf, floors.astype(float) * (1 - np.sign(floors) * 2.0**-52))[:, None]
            for j, b in enumerate(r["boxes"]):
                if b["shard"] == r["shard"]:
                    continue
                at = np.flatnonzero(wanted[:, j])
                for lo in range(0, len(at), ASKED):
                    own = at[lo : lo + ASKED]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["dim"]], pa.int32()), pa.array([b["shard"]]), pa.array([r["shard"]]), pa.array([lo], pa.int32()), pa.array([r["q_wide"]], pa.int32())]
                        + [pa.array([x.tobytes()], pa.binary()) for x in (ids[own], q.x[own], floors[own])],
                        names=["dim", "shard", "home", "part", "q_wide", "q_ids", "q_x", "floors"],
                    )
    release()
