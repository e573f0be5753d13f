"""Operator 2: near-duplicate vectors by a pivot-permutation index.

A vector is described by its ``prefix`` nearest reference vectors (pivots), in
order. Inverted lists hold, for each pivot, the vectors that have it among their
first ``probes`` ones. Two vectors are candidates if they share two of those
pivots, and in all ``shared`` of the ``prefix`` ones; only candidates are
verified by their cosine.

Pivots are a seeded sample of the vectors. Their number grows with the square
root of the table, so the pairs of pivots grow with the table, and so do the
sublists of vectors that share a pair: a sublist keeps about the same length at
every size. A list's sublists are looked through inside one task; a vector is sent
to at most ``probes`` - 1 lists. Two vectors that share several pairs of pivots
are compared in the sublist of the least pair only. A list of more than ``block``
vectors is cut into blocks that are compared in pairs, so the crowd of a hot
cluster spreads over many tasks and nothing is left out.

Equal vectors are one node from the start. Of the pairs of a list only the count
of each node's links and the edges of a spanning forest leave the task, never the
pairs themselves; classes are the forest's connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import picked, tune, written
from inkwell.llm.components import components, forest_labels

MIN_COSINE = 0.95
PREFIX = 16
SHARED = 5
BLOCK = 100_000
#: Candidate pairs whose pivots are compared at once.
PAIRS = 1 << 16
#: Sublists from this length on are compared by matrix products.
DENSE = 192
TILE = 1_024
SEED = "pivots-1"
#: Pivots are handed to every task; this bounds them (16 MB at 64 dimensions). Beyond it, sublists grow with the table.
MAX_PIVOTS = 1 << 16


def pivot_count(n: int) -> int:
    return int(min(MAX_PIVOTS, max(16, np.ceil(2 * np.sqrt(n)))))


def probe_count(pivots: int) -> int:
    """More pivots lie closer together, so more of them are probed: 6 up to 1,024 pivots, one more for each four times as many."""
    return 6 + max(0, int(np.ceil(np.log2(max(1, pivots) / 1024) / 2)))


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def unit_vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(row, v) of the usable vectors of (row, v) at length 1, and their dimension, which is the most frequent one."""
    rows = vectors.where("v IS NOT NULL").withColumn("v", F.col("v").cast("array<double>"))
    rows = rows.where(F.size("v") > 0).where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return rows, 0
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.where(F.size("v") == dims["d"]).withColumn("norm", norm).where("norm > 0 AND norm < double('infinity')")
    return rows.select("row", F.transform("v", lambda x: (x / F.col("norm")).cast("float")).alias("v")), dims["d"]


def _pivots(nodes: DataFrame, n: int, dim: int, seed: str) -> np.ndarray:
    """A seeded sample of the nodes, drawn by their hashes: first all below a bound, of these the least."""
    want = pivot_count(n)
    key = F.xxhash64(F.lit(seed), "node")
    near = nodes.where(F.pmod(key, F.lit(1 << 20)) <= int((1 << 20) * min(1.0, 3 * want / n))).orderBy(F.pmod(key, F.lit(1 << 20)), "node").limit(want)
    return np.stack([np.frombuffer(r["v"], np.float32) for r in near.select("v").collect()]).reshape(-1, dim)


def _enumerated(size: np.ndarray, other: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(sublist, place, place) of the pairs of many short sublists, some ``PAIRS`` at a time.

    Without ``other`` the pairs are those within each sublist, else those of its
    ``size`` left and ``other`` right members.
    """
    number = size * (size - 1) // 2 if other is None else size * other
    bound = np.searchsorted(np.cumsum(number), np.arange(PAIRS, int(number.sum()) + PAIRS, PAIRS), side="left")
    start = 0
    for stop in np.unique(np.minimum(bound + 1, len(size))):
        which = np.repeat(np.arange(start, stop), number[start:stop])
        at = np.arange(len(which)) - np.repeat(np.cumsum(number[start:stop]) - number[start:stop], number[start:stop])
        if other is None:  # the at-th cell of the lower triangle
            j = ((1 + np.sqrt(1 + 8 * at.astype(np.float64))) // 2).astype(np.int64)
            j = np.where(j * (j - 1) // 2 > at, j - 1, j)
            i = at - j * (j - 1) // 2
        else:
            i, j = at // other[which], at % other[which]
        if len(which):
            yield which, i, j
        start = stop


class Lists:
    """The comparison of one list's (or two of its blocks') vectors."""

    def __init__(self, x: np.ndarray, near: np.ndarray, second: np.ndarray | None, pivot: int, probes: int, shared: int, least: float):
        self.x, self.near, self.pivot, self.shared, self.least = x, near, pivot, shared, least
        self.head = np.sort(near[:, :probes].astype(np.int32), axis=1)
        row, col = np.nonzero(self.head > pivot)
        q = self.head[row, col]
        side = np.zeros(len(row), bool) if second is None else second[row]
        order = np.lexsort((row, side, q))
        self.row, self.q, self.side = row[order], q[order], side[order]
        self.same = second is None

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers of pairs with the least cosine, each pair once over all lists and sublists."""
        if not len(self.q):
            return
        begin = np.flatnonzero(np.concatenate([[True], self.q[1:] != self.q[:-1]]))
        end = np.append(begin[1:], len(self.q))
        middle = end - np.add.reduceat(self.side.astype(np.int64), begin)  # the right members begin here
        left, right = (end - begin, None) if self.same else (middle - begin, end - middle)
        wide = left > DENSE if self.same else left * right > DENSE * DENSE
        short = np.flatnonzero(~wide)
        for which, i, j in _enumerated(left[short], None if self.same else right[short]):
            which = short[which]
            a, b = self.row[begin[which] + i], self.row[(begin if self.same else middle)[which] + j]
            yield from self._verified(a, b, self.q[begin[which]])
        for k in np.flatnonzero(wide):
            rows = self.row[begin[k] : end[k]]
            cut = None if self.same else int(middle[k] - begin[k])
            yield from self._dense(rows if cut is None else rows[:cut], rows if cut is None else rows[cut:], int(self.q[begin[k]]))

    def _verified(self, a: np.ndarray, b: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        earlier = np.zeros(len(a), bool)
        for k in range(self.head.shape[1]):  # another shared pivot before q: they meet in an earlier sublist
            p = self.head[a, k]
            earlier |= (p < q) & (p != self.pivot) & (self.head[b] == p[:, None]).any(axis=1)
        a, b = a[~earlier], b[~earlier]
        near, count = self.near[b], np.zeros((len(b), self.near.shape[1]), bool)
        for k in range(self.near.shape[1]):
            count |= near == self.near[a, k][:, None]
        hit = count.sum(axis=1) >= self.shared
        a, b = a[hit], b[hit]
        hit = np.einsum("ij,ij->i", self.x[a], self.x[b]) >= self.least
        if hit.any():
            yield a[hit], b[hit]

    def _dense(self, left: np.ndarray, right: np.ndarray, q: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same by matrix products, a tile of the left rows at a time."""
        held, ids = np.unique(self.near[np.concatenate([left, right])], return_inverse=True)
        ids = ids.reshape(-1, self.near.shape[1])
        heads = self.head[np.concatenate([left, right])]
        before = np.unique(heads[(heads < q) & (heads != self.pivot)])

        def marks(rows: slice) -> tuple[np.ndarray, np.ndarray]:
            has = np.zeros((len(ids[rows]), len(held)), np.float32)
            np.put_along_axis(has, ids[rows], 1, axis=1)
            h = heads[rows]
            early = np.zeros((len(h), max(1, len(before))), np.float32)
            if len(before):
                r, c = np.nonzero((h < q) & (h != self.pivot))
                early[r, np.searchsorted(before, h[r, c])] = 1
            return has, early

        shift = 0 if self.same else len(left)
        for s in range(0, len(left), TILE):
            n = min(TILE, len(left) - s)
            has, early = marks(slice(s, s + n))
            for t in range(s if self.same else 0, len(right), TILE):
                m = min(TILE, len(right) - t)
                has2, early2 = marks(slice(shift + t, shift + t + m))
                ok = (early @ early2.T) == 0
                if self.same and s == t:
                    ok &= np.tri(n, m, -1, dtype=bool).T
                if not ok.any():
                    continue
                ok &= (has @ has2.T) >= self.shared
                i, j = np.nonzero(ok)
                if len(i) > n * m // 32:
                    good = (self.x[left[s : s + n]] @ self.x[right[t : t + m]].T)[i, j] >= self.least
                else:
                    good = np.einsum("ij,ij->i", self.x[left[s + i]], self.x[right[t + j]]) >= self.least
                if good.any():
                    yield left[s + i[good]], right[t + j[good]]


def _linked(nodes: DataFrame, n: int, dim: int, min_cosine: float, prefix: int, probes: int | None, shared: int, block: int, seed: str) -> DataFrame:
    """(node, links, other): for nodes (node, v, weight) in each list in which they have links, the weight of these, and a node of the same class."""
    pivots = _pivots(nodes, n, dim, seed)
    k = min(prefix, len(pivots))
    m = min(probes or probe_count(len(pivots)), k)
    least = min(shared, k)
    held = nodes.sparkSession.sparkContext.broadcast(pivots)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order = []
            x = _matrix(b.column("v"), np.float32, dim)
            for s in range(0, len(x), 256):  # with many pivots, a product of a whole batch is large
                far = -(x[s : s + 256] @ held.value.T)
                first = np.argpartition(far, k - 1, axis=1)[:, :k] if k < far.shape[1] else np.broadcast_to(np.arange(k), (len(far), k))
                by = np.take_along_axis(far, first, axis=1)
                order.append(np.take_along_axis(first, np.lexsort((first, by), axis=1), axis=1).astype(np.uint16))
            near = np.concatenate(order) if order else np.zeros((0, k), np.uint16)
            head = np.sort(near[:, :m], axis=1)[:, :-1].astype(np.int32)  # the last one's sublists are in the lists before it
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, head.size + 1, m - 1), pa.int32()), pa.array(head.ravel()))
            packed = pa.array([r.tobytes() for r in near], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("v"), b.column("weight"), packed, lists], names=["node", "v", "weight", "near", "lists"])

    described = written(nodes.mapInArrow(describe, "node long, v binary, weight long, near binary, lists array<int>"), "permutations")
    lengths = described.select(F.explode("lists").alias("pivot")).groupBy("pivot").count()
    lengths = lengths.select("pivot", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    split = described.withColumn("pivot", F.explode("lists")).drop("lists").join(F.broadcast(lengths), "pivot")
    split = split.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meeting = split.select("pivot", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).alias("second"), "node", "v", "weight", "near")

    def compare(group: pa.Table) -> pa.Table:
        pivot, same = group["pivot"][0].as_py(), group["i"][0].as_py() == group["j"][0].as_py()
        node, weight = group["node"].to_numpy(), group["weight"].to_numpy()
        second = None if same else group["second"].to_numpy()
        lists = Lists(_matrix(group["v"], np.float32, dim), _matrix(group["near"], np.uint16, k), second, pivot, m, least, min_cosine)
        links, label = np.zeros(len(node), np.int64), np.arange(len(node))
        for a, b in lists.pairs():
            links += np.bincount(a, weight[b], len(node)).astype(np.int64) + np.bincount(b, weight[a], len(node)).astype(np.int64)
            label = forest_labels(label, a, b)
        at = np.flatnonzero(links)
        return pa.table({"node": node[at], "links": links[at], "other": node[label[at]]})

    return meeting.groupBy("pivot", "i", "j").applyInArrow(compare, "node long, links long, other long")


def near_vectors(
    vectors: DataFrame,
    min_cosine: float = MIN_COSINE,
    prefix: int = PREFIX,
    probes: int | None = None,
    shared: int = SHARED,
    block: int = BLOCK,
    seed: str = SEED,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(vec_id, class_id, n_links), a row for each row of ``vectors``.

    ``n_links`` is the number of other rows whose cosine with this one is at
    least ``min_cosine``; ``class_id`` is the least id of the rows that are
    connected with it by links. Retrieval is approximate (recall is measured in
    the tests); all links counted are verified.

    Vectors that are null, empty, all zero or not finite, hold nulls, or have
    another dimension than most have no links and are a class of their own. Null
    ids are kept and are never a class's id unless it has no other. Rows that
    repeat an id are rows of their own, and equal vectors are linked. Ids may be
    of any type that can be ordered, and keep it. Ties between pivots go to the
    lower pivot number. An empty table gives no rows. Other columns are ignored,
    whatever their names.
    """
    spark = vectors.sparkSession
    tune(spark)
    numbered = written(picked(vectors, vec_id=id_col, v=vector_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    unit, dim = unit_vectors(numbered.select("row", "v"))
    alone = numbered.select("vec_id", F.col("vec_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    if not dim:
        return alone

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim) + np.float32(0)  # no negative zeros
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([r.tobytes() for r in x], pa.binary())], names=["row", "v"])

    packed = written(unit.mapInArrow(pack, "row long, v binary").withColumn("node", F.xxhash64("v")), "unit-vectors")
    nodes = written(packed.groupBy("node").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("weight")), "vector-nodes")
    n = nodes.count()
    ids = numbered.select("row", "vec_id").join(packed.select("row", "node"), "row", "left").join(nodes.select("node", "weight"), "node", "left")
    if n < 2:
        grouped = ids.select("vec_id", "row", "weight", F.coalesce("node", "row").alias("root"), F.col("node").isNull().alias("apart"), F.lit(0).cast("long").alias("links"))
    else:
        linked = written(_linked(nodes, n, dim, min_cosine, prefix, probes, shared, block, seed), "vector-links")
        degree = linked.groupBy("node").agg(F.sum("links").alias("links"))
        found = components(linked.select(F.col("node").alias("a"), F.col("other").alias("b")))
        known = ids.join(degree, "node", "left").join(found, "node", "left")
        grouped = known.select("vec_id", "row", "weight", F.coalesce("root", "node", "row").alias("root"), F.col("node").isNull().alias("apart"), F.coalesce("links", F.lit(0)).alias("links"))
    grouped = written(grouped, "vector-classes")
    first = grouped.groupBy("apart", "root").agg(F.min("vec_id").alias("class_id"))
    return grouped.join(first, ["apart", "root"]).select("vec_id", "class_id", (F.col("links") + F.coalesce(F.col("weight") - 1, F.lit(0))).alias("n_links"))
