"""Operator 3: near-duplicate documents by MinHash signatures and a multi-index Hamming join.

A document is the set of its word bigrams. Its signature has ``n_hashes``
symbols of b = 16 bits: the low bits of the minimum of each of that many
independent hashes. The distance of two signatures is the number of symbols in
which they differ, whose mean is n_hashes * (1 - Jaccard).

The join returns *every* pair of documents with a distance of at most
``max_distance`` = D. A signature is split into m chunks with m * (e + 1) > D,
so by the pigeonhole principle two such signatures have a chunk that differs in
at most e symbols. The allowed chunk errors are enumerated by leaving out every
choice of e symbols of a chunk: chunks with at most e errors agree in one of the
remainders. Equal remainders meet in a shuffle by key, and all members of a key
are compared by their full signatures.

A key of more than ``key_rows`` signatures is hot. All its members are compared
with one of them, the leader, wherever they are. Of what is left, only pairs with
a member that isn't near the leader are open. If there are few such members, they
are compared with blocks of all members. If there are many, the multi-index join
is applied once more to the chunks besides the key's own, which splits unlike
members; keys that are still hot are compared in pairs of blocks.

Only what joins groups is kept of a key's pairs: the edges of a spanning forest,
at most one fewer than the key's members. Documents of equal signatures are one
node, so thousands of exact copies cost no more than one. The connected
components of the edges are those of all pairs; they are found by alternating
large-star and small-star steps, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import picked, tune, written
from inkwell.llm.components import components, forest_labels
from inkwell.llm.words import mixed, pieces, split_words

N_HASHES = 64
MAX_DISTANCE = 30
CHUNK_ERRORS = 1
SHINGLE_WORDS = 2
#: Removed rows that are handed to every task; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Signatures of one key that are compared in one task.
KEY_ROWS = 8_000
#: Low bits of a key that hold the number of its mask.
_MASK_BITS = 12
_BLOCK = 1 << 15


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_011)
    return rng.integers(0, 2**32, n, np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, np.uint32)


def signatures(texts: list[str], n_hashes: int = N_HASHES, width: int = SHINGLE_WORDS) -> np.ndarray:
    """One row of ``n_hashes`` 16-bit symbols for each text.

    A text of fewer than ``width`` words is the set of its one shorter shingle;
    a text without words gets the signature of the empty shingle.
    """
    a, b = _multipliers(n_hashes)
    out = np.zeros((len(texts), n_hashes), np.uint16)
    for lo, hi in pieces(texts, 400_000):
        w = split_words(texts[lo:hi])
        counts = np.diff(w.first)
        n = np.maximum(counts - width + 1, 1)
        starts = np.cumsum(n) - n
        shingles = np.full(int(n.sum()), 0x51ED270B, np.uint64)
        owner = np.repeat(np.arange(hi - lo), n)
        at = w.first[:-1][owner] + np.arange(len(shingles)) - starts[owner]
        limit = w.first[1:][owner]
        for k in range(width):
            there = at + k < limit
            word = w.hashes[np.minimum(at + k, max(0, len(w.hashes) - 1))] if len(w.hashes) else np.zeros(len(at), np.uint64)
            shingles = np.where(there, mixed(shingles * np.uint64(0x9E3779B97F4A7C15) + word), shingles)
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full((n_hashes, hi - lo), 0xFFFFFFFF, np.uint32)
        for s in range(0, len(x), _BLOCK):  # a block stays in the cache for all hashes
            part, own = x[s : s + _BLOCK], owner[s : s + _BLOCK]
            cut = np.flatnonzero(np.diff(own, prepend=-1))
            for k in range(n_hashes):
                y = part * a[k]
                y += b[k]
                low[k, own[cut]] = np.minimum(low[k, own[cut]], np.minimum.reduceat(y, cut))
        out[lo:hi] = (mixed(low.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16).T
    return out


def chunk_masks(n_hashes: int, max_distance: int, errors: int) -> list[np.ndarray]:
    """The places that each key keeps: for every chunk, all of its places but ``errors`` ones."""
    m = max_distance // (errors + 1) + 1
    if m > n_hashes or n_hashes // m <= errors:
        raise ValueError("the chunks are too short for this distance and these errors")
    return [np.setdiff1d(c, gone) for c in np.array_split(np.arange(n_hashes), m) for gone in combinations(c, errors)]


def other_masks(n_hashes: int, max_distance: int, errors: int) -> list[list[np.ndarray]]:
    """For each mask of :func:`chunk_masks`, the masks of the other chunks that find all close pairs once more; none where chunks are too short."""
    m = max_distance // (errors + 1) + 1
    chunks = np.array_split(np.arange(n_hashes), m)
    more = max_distance // (m - 1) if m > 1 else max_distance
    if m < 2 or min(map(len, chunks)) <= more:
        return [[] for c in chunks for _ in combinations(c, errors)]
    by_chunk = [[np.setdiff1d(d, gone) for d in chunks if d is not c for gone in combinations(d, more)] for c in chunks]
    return [by_chunk[i] for i, c in enumerate(chunks) for _ in combinations(c, errors)]


def chunk_keys(sig: np.ndarray, masks: list[np.ndarray], own: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit key for each signature and mask, with the mask's number in the low bits; with ``own``, within these keys."""
    out = np.empty((len(sig), len(masks)), np.uint64)
    wide = sig.astype(np.uint64)
    for j, mask in enumerate(masks):
        h = np.full(len(sig), j + 1, np.uint64) if own is None else mixed(own + np.uint64(j + 1))
        for c in mask:
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + wide[:, c])
        out[:, j] = h << np.uint64(_MASK_BITS) | np.uint64(j)
    return out


def _signature_of(n_hashes: int):
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = pc.fill_null(batch.cast(pa.string()), "").to_pylist()
            sig = signatures(texts, n_hashes)
            raw = pa.py_buffer(np.ascontiguousarray(sig).tobytes())
            fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * n_hashes), len(texts), [None, raw])
            yield fixed.cast(pa.binary())

    return F.arrow_udf(sign, "binary").asNondeterministic()


def _sigs(column: pa.Array, n_hashes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, n_hashes)


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches that are sorted by ``key``."""
    held: list[pa.Table] = []
    now = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        keys = table.column(key).to_numpy()
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut or keys[-1] != now:
            if cut or held:
                yield pa.concat_tables([*held, table.slice(0, cut)])
            held, now = [], keys[-1]
        held.append(table.slice(cut))
    if held:
        yield pa.concat_tables(held)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return start, np.diff(np.append(start, len(keys)))


def _meeting(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(key, node, hot) of the keys with two members or more, from batches sorted by key; a key of over ``most`` members is hot.

    Of a key that goes on in the next batch no more than ``most`` rows and a batch are held.
    """

    def out(key: np.ndarray, node: np.ndarray, hot: np.ndarray | bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(np.broadcast_to(hot, len(key)))], names=["key", "node", "hot"])

    now, held, count = None, [], 0  # the key that may go on, its nodes that aren't given yet, and all so far
    for batch in batches:
        keys, nodes = batch.column("key").to_numpy(), batch.column("node").to_numpy()
        if not len(keys):
            continue
        start, size = _runs(keys)
        if keys[0] == now:
            held.append(nodes[: size[0]])
            count += int(size[0])
            start, size = start[1:], size[1:]
        if now is not None and (len(start) or count > most):
            node = np.concatenate(held) if held else nodes[:0]
            if count > 1 and len(node):
                yield out(np.full(len(node), now), node, count > most)
            held = []
        if len(start):
            lo, last = start[0], start[-1]
            keep, hot = np.repeat(size[:-1] > 1, size[:-1]), np.repeat(size[:-1] > most, size[:-1])
            if keep.any():
                yield out(keys[lo:last][keep], nodes[lo:last][keep], hot[keep])
            now, held, count = keys[-1], [nodes[last:]], int(size[-1])
    if held and count > 1:
        node = np.concatenate(held)
        yield out(np.full(len(node), now), node, count > most)


def forest(sig: np.ndarray, max_distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of all pairs within ``max_distance``.

    Each node is compared with the nodes that aren't reached yet, so a crowd of
    near copies costs about one comparison a node.
    """
    open_, rest = np.arange(len(sig)), sig
    edges: list[tuple[int, int]] = []
    while len(open_):
        todo, open_, rest = [int(open_[0])], open_[1:], rest[1:]
        while todo and len(open_):
            x = todo.pop()
            near = np.count_nonzero(rest != sig[x], axis=1) <= max_distance
            if near.any():
                edges += [(x, int(y)) for y in open_[near]]
                todo += open_[near].tolist()
                open_, rest = open_[~near], rest[~near]
    return edges


_EDGES = "a long, b long"


def _edge_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])


def _by_key(members: DataFrame, nodes: DataFrame, n_hashes: int, max_distance: int) -> DataFrame:
    """Edges of the forests of keys whose members (key, node) fit in a task."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, "key"):
            node, sig = table.column("node").to_numpy(), _sigs(table.column("sig"), n_hashes)
            pairs = []
            for s, n in zip(*_runs(table.column("key").to_numpy())):
                if n > 2 or np.count_nonzero(sig[s] != sig[s + 1]) <= max_distance:
                    pairs += [(s + x, s + y) for x, y in (forest(sig[s : s + n], max_distance) if n > 2 else [(0, 1)])]
            at = np.array(pairs, np.int64).reshape(-1, 2)
            yield _edge_batch(node[at[:, 0]], node[at[:, 1]])

    full = members.join(nodes.select("node", "sig"), "node").select("key", "node", "sig")
    return full.repartition("key").sortWithinPartitions("key").mapInArrow(joined, _EDGES)


def _attached(small: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``small``, which has a row for each hot key; joined without a shuffle as far as ``small`` is."""
    return rows.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, "key")


def _hot(members: DataFrame, nodes: DataFrame, n_hashes: int, max_distance: int, errors: int, key_rows: int, again: bool) -> list[DataFrame]:
    """Tables of edges that connect what the pairs within ``max_distance`` of the hot keys' ``members`` (key, node) connect."""
    full = written(members.join(nodes.select("node", "sig"), "node").select("key", "node", "sig"), "hot-keys")
    leaders = written(full.groupBy("key").agg(F.min("node").alias("lead"), F.min_by("sig", "node").alias("lead_sig"), F.count(F.lit(1)).alias("n")), "leaders")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = np.count_nonzero(_sigs(b.column("sig"), n_hashes) != _sigs(b.column("lead_sig"), n_hashes), axis=1) <= max_distance
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "node", "sig", "lead", "n")), pa.array(near)], names=["key", "node", "sig", "lead", "n", "near"])

    measured = written(_attached(leaders, full).mapInArrow(measure, "key long, node long, sig binary, lead long, n long, near boolean"), "hot-members")
    edges = [measured.where("near AND node <> lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b"))]
    far = measured.where("NOT near")
    open_ = written(far.groupBy("key").agg(F.count(F.lit(1)).alias("far")), "open-keys")
    if open_.isEmpty():
        return edges
    masks = other_masks(n_hashes, max_distance, errors)
    again = again and all(masks)
    rows = _attached(open_, measured.select("key", "node", "sig", "n", "near"))
    many = F.col("far") > (key_rows if again else 1 << 62)

    # blocks of all members against blocks of those that aren't near the leader
    blocks = lambda c: F.ceil(F.col(c) / key_rows).cast("int")
    few = rows.where(~many).withColumns({"all": blocks("n"), "some": blocks("far")})
    mine = few.select("key", "node", "sig", "near", F.lit(False).alias("far"), F.pmod(F.xxhash64("node"), "all").cast("int").alias("j"), F.explode(F.sequence(F.lit(0), F.col("some") - 1)).alias("k"))
    theirs = few.where("NOT near").select("key", "node", "sig", "near", F.lit(True).alias("far"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("j"), F.pmod(F.xxhash64("node", F.lit(1)), "some").cast("int").alias("k"))

    def compare(group: pa.Table) -> pa.Table:
        node, sig = group["node"].to_numpy(), _sigs(group["sig"], n_hashes)
        far, near = (group[c].to_numpy() for c in ("far", "near"))
        mine = np.flatnonzero(~far)
        ids, at = np.unique(node, return_inverse=True)
        label = np.arange(len(ids))
        label[at[near]] = at[near].min() if near.any() else 0  # joined by the leader already
        known = label.copy()
        held = sig[mine]
        for x in np.flatnonzero(far):
            y = mine[np.count_nonzero(held != sig[x], axis=1) <= max_distance]
            y = y[label[at[y]] != label[at[x]]]
            if len(y):
                label = forest_labels(label, np.full(len(y), at[x]), at[y])
        moved = np.flatnonzero((label != known) & ((known == np.arange(len(ids))) | ~np.isin(np.arange(len(ids)), at[near])))
        return pa.table({"a": np.minimum(ids[moved], ids[label[moved]]), "b": np.maximum(ids[moved], ids[label[moved]])})

    edges.append(mine.unionByName(theirs).groupBy("key", "j", "k").applyInArrow(compare, _EDGES))
    split = rows.where(many)
    if again and not split.isEmpty():

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in (batch.slice(i, 2_000) for i in range(0, batch.num_rows, 2_000)):
                    key, node, sig = part.column("key").to_numpy(), part.column("node").to_numpy(), _sigs(part.column("sig"), n_hashes)
                    mask = key & ((1 << _MASK_BITS) - 1)
                    for j in np.unique(mask):
                        which = mask == j
                        keys = chunk_keys(sig[which], masks[j], key[which].view(np.uint64))
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(node[which], keys.shape[1]))], names=["key", "node"])

        edges += _keyed_edges(split.select("key", "node", "sig").mapInArrow(keyed, "key long, node long"), nodes, n_hashes, max_distance, errors, key_rows, False)
    return edges


def _keyed_edges(keys: DataFrame, nodes: DataFrame, n_hashes: int, max_distance: int, errors: int, key_rows: int, again: bool) -> list[DataFrame]:
    """Tables of edges that connect what the pairs within ``max_distance`` that share a key of ``keys`` (key, node) connect."""
    members = written(keys.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: _meeting(b, key_rows), "key long, node long, hot boolean"), "key-members")
    edges = [_by_key(members.where("NOT hot"), nodes, n_hashes, max_distance)]
    hot = members.where("hot").select("key", "node")
    return edges if hot.isEmpty() else edges + _hot(hot, nodes, n_hashes, max_distance, errors, key_rows, again)


def signature_edges(nodes: DataFrame, n_hashes: int, max_distance: int, errors: int, key_rows: int = KEY_ROWS) -> DataFrame:
    """(a, b), a < b: edges that connect exactly what the pairs within ``max_distance`` connect.

    ``nodes`` has one row (node, sig) for each distinct signature.
    """
    masks = chunk_masks(n_hashes, max_distance, errors)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 4_000) for i in range(0, batch.num_rows, 4_000)):
                keys = chunk_keys(_sigs(part.column("sig"), n_hashes), masks)
                node = np.repeat(part.column("node").to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(node)], names=["key", "node"])

    keys = nodes.select("node", "sig").mapInArrow(keyed, "key long, node long")
    parts = _keyed_edges(keys, nodes, n_hashes, max_distance, errors, key_rows, True)
    return reduce(DataFrame.union, parts).distinct()


def near_groups(
    docs: DataFrame,
    max_distance: int = MAX_DISTANCE,
    n_hashes: int = N_HASHES,
    errors: int = CHUNK_ERRORS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, group_id, kept): the documents that have near copies.

    A group is a connected component of the pairs within ``max_distance``;
    ``group_id`` is the least doc_id of the group and marks the one document
    that stays (``kept``). A group is reported if it has two rows or more. Ids may
    be of any type that can be ordered, and keep it.

    Very long texts count with all their words. Null texts are never copies of anything and aren't reported. Texts without
    words are copies of each other. Rows that repeat an id count as rows of
    their own, of which one stays. A null id sorts after all others, so it stays
    only in a group of null ids, whose group_id is null. An empty table gives no
    rows. Other columns are ignored, whatever their names.
    """
    signed = _signed(docs, n_hashes, id_col, text_col)
    grouped = written(_with_root(signed, max_distance, n_hashes, errors), "near-groups")
    best = grouped.groupBy("root").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("group_size"), F.min(_order())["row"].alias("first"))
    return (
        grouped.join(best.where("group_size > 1"), "root")
        .select("doc_id", "group_id", (F.col("row") == F.col("first")).alias("kept"))
    )


def _order() -> Column:
    """The order in which rows of a group are preferred."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))


def _signed(docs: DataFrame, n_hashes: int, id_col: str, text_col: str) -> DataFrame:
    tune(docs.sparkSession)
    rows = picked(docs, doc_id=id_col, text=text_col).where(F.col("text").isNotNull())
    signed = rows.select("doc_id", F.xxhash64("text").alias("content"), _signature_of(n_hashes)(F.col("text")).alias("sig"))
    return written(signed.withColumn("node", F.xxhash64("sig")).withColumn("row", F.monotonically_increasing_id()), "signatures")


def _with_root(signed: DataFrame, max_distance: int, n_hashes: int, errors: int) -> DataFrame:
    nodes = written(signed.groupBy("node").agg(F.first("sig").alias("sig")), "nodes")
    found = components(signature_edges(nodes, n_hashes, max_distance, errors))
    return (
        signed.select("doc_id", "content", "row", "node")
        .join(found, "node", "left")
        .select("doc_id", "content", "row", F.coalesce("root", "node").alias("root"))
    )


def drop_near_copies(docs: DataFrame, max_distance: int = MAX_DISTANCE, n_hashes: int = N_HASHES, errors: int = CHUNK_ERRORS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with one row of each group of :func:`near_groups`; other rows stay as they are, those with null texts too.

    Rows to go are told by (doc_id, hash of the text), so a row that is wholly
    the same as the one that stays can only be removed by counting: of rows with
    equal id and text, one stays. Up to ``broadcast_rows`` such rows are handed to
    all tasks, more are joined by a shuffle. Null ids are kept apart from others. An
    empty table stays empty; columns of any other name are kept.
    """
    signed = _signed(docs, n_hashes, "doc_id", "text")
    grouped = _with_root(signed, max_distance, n_hashes, errors)
    best = grouped.groupBy("root").agg(F.min(_order())["row"].alias("first"))
    extra = grouped.join(best, "root").where("row <> first").groupBy("doc_id", "content").agg(F.count(F.lit(1)).alias("gone"))
    alike = grouped.groupBy("doc_id", "content").agg(F.count(F.lit(1)).alias("alike"))
    same = extra["doc_id"].eqNullSafe(alike["doc_id"]) & (extra["content"] == alike["content"])
    gone = written(extra.join(alike, same).select(extra["doc_id"].alias("__id2"), extra["content"].alias("__content2"), (F.col("alike") > F.col("gone")).alias("__one")), "near-copies")
    small = gone.count() <= broadcast_rows
    names = docs.columns
    raw = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    ident, text = F.col(f"__c{names.index('doc_id')}"), F.col(f"__c{names.index('text')}")
    raw = raw.withColumns({"__id": ident, "__content": F.when(text.isNotNull(), F.xxhash64(text))})

    def matched(right: DataFrame, how: str) -> DataFrame:
        right = F.broadcast(right) if small else right
        return raw.join(right, raw["__id"].eqNullSafe(right["__id2"]) & (raw["__content"] == right["__content2"]), how)

    kept = matched(gone, "left_anti")
    repeated = gone.where("__one")
    if not repeated.isEmpty():
        kept = kept.unionByName(matched(repeated, "left_semi").dropDuplicates(["__id", "__content"]))
    return kept.select(*[F.col(f"__c{i}").alias(n) for i, n in enumerate(names)])
