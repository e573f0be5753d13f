"""Character n-gram counts and pointwise mutual information."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.runtime import ship, written

#: Code points in 21 bits: as many of them fit into a signed 64-bit number.
PACKED_N = 3
_BITS = 21
#: Characters whose n-grams are listed at once, lines taken from a batch at once, and counts that a task holds before it sums them.
_PIECE = 1 << 18
_ROWS = 1_000
_HELD = 500_000

#: Distinct n-grams as one or more columns of packed code points, and their counts.
Counts = tuple[list[np.ndarray], np.ndarray]


def _summed(keys: list[np.ndarray], counts: np.ndarray | None = None) -> Counts:
    """Distinct rows of ``keys`` with the sums of their counts (1 each by default)."""
    if len(keys) == 1 and counts is None:
        key, n = np.unique(keys[0], return_counts=True)
        return [key], n
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    start = np.flatnonzero(new)
    n = np.diff(np.append(start, len(order))) if counts is None else np.add.reduceat(counts[order], start) if len(start) else counts
    return [k[start] for k in keys], n


def _packed_counts(texts: list[str], n: int) -> Counts:
    """Packed n-grams of the joined texts and their counts; no n-gram spans a line feed."""
    points = np.frombuffer("\n".join(texts).encode(f"utf-32-{sys.byteorder[0]}e", "surrogatepass"), np.uint32).astype(np.int64)
    size = max(0, len(points) - n + 1)
    keys, ok = [], np.ones(size, bool)
    for s in range(0, n, PACKED_N):
        key = np.zeros(size, np.int64)
        for k in range(s, min(n, s + PACKED_N)):
            part = points[k : k + size]
            key = key << _BITS | part
            ok &= part != 10
        keys.append(key)
    return _summed([k[ok] for k in keys])


def _unpacked(keys: list[np.ndarray], n: int) -> list[str]:
    points = []
    for s, key in zip(range(0, n, PACKED_N), keys):
        width = min(PACKED_N, n - s)
        points += [(key >> (_BITS * (width - 1 - k))) & ((1 << _BITS) - 1) for k in range(width)]
    joined = np.stack(points, axis=1).astype(np.uint32).tobytes().decode(f"utf-32-{sys.byteorder[0]}e", "surrogatepass")
    return [joined[i : i + n] for i in range(0, len(joined), n)]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    """The texts of the first column in lists of about ``_PIECE`` characters; a batch becomes strings ``_ROWS`` rows at a time."""
    for batch in batches:
        texts, size = [], 0
        for start in range(0, batch.num_rows, _ROWS):
            for t in batch.column(0).slice(start, _ROWS).to_pylist():
                if t:
                    texts.append(t)
                    size += len(t)
                if size > _PIECE:
                    yield texts
                    texts, size = [], 0
        if texts:
            yield texts


def ngram_counts(lines: DataFrame, n: int, column: str = "line") -> DataFrame:
    """(ngram, frequency) over all lines; n-grams don't cross line feeds, null and short lines have none.

    Code points are packed into numbers, three to one, and counted by array
    operations before the shuffle.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    ship(lines.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Counts] = []
        most = _HELD

        def merged() -> Counts:
            return _summed([np.concatenate(k) for k in zip(*(k for k, _ in held))], np.concatenate([c for _, c in held]))

        def emit(keys: list[np.ndarray], c: np.ndarray) -> Iterator[pa.RecordBatch]:
            for s in range(0, len(c), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(_unpacked([k[s : s + 100_000] for k in keys], n), pa.string()), pa.array(c[s : s + 100_000])], names=["ngram", "frequency"])

        for piece in _pieces(batches):
            held.append(_packed_counts(piece, n))
            if sum(len(c) for _, c in held) > most:
                one = merged()
                held, most = [one], max(_HELD, 2 * len(one[1]))
                if len(one[1]) > 1_000_000:
                    yield from emit(*one)
                    held, most = [], _HELD
        if held:
            yield from emit(*merged())

    return lines.select(column).mapInArrow(count, "ngram string, frequency long").groupBy("ngram").agg(F.sum("frequency").alias("frequency"))


def total_count(counts: DataFrame) -> DataFrame:
    """One row (total): the sum of all counts, before any filter."""
    return counts.agg(F.coalesce(F.sum("frequency"), F.lit(0)).alias("total"))


def component_counts(counts: DataFrame, min_freq: int = 1) -> DataFrame:
    """(ch, count): for n-grams of at least ``min_freq``, each occurrence of a character adds the n-gram's count."""
    kept = counts.where(F.col("frequency") >= min_freq)
    chars = F.transform(F.sequence(F.lit(1), F.length("ngram")), lambda i: F.substring("ngram", i, F.lit(1)))
    return kept.select(F.explode(chars).alias("ch"), "frequency").groupBy("ch").agg(F.sum("frequency").alias("count"))


def pmi_scores(counts: DataFrame, n: int, min_freq: int = 3) -> DataFrame:
    """(ngram, pmi, frequency) of n-grams with at least ``min_freq``; for n = 1 the score is the count.

    The total covers all n-grams, the character counts only the kept ones. The
    table of characters is as small as the alphabet, so it is broadcast; with
    more than 200,000 characters Spark chooses the join.
    """
    kept = counts.where(F.col("frequency") >= min_freq)
    if n == 1:
        return kept.select("ngram", F.col("frequency").cast("double").alias("pmi"), "frequency")
    components = written(component_counts(counts, min_freq), "characters")
    small = components.count() <= 200_000
    scored = kept.crossJoin(F.broadcast(total_count(counts)))
    product = None
    for k in range(1, n + 1):
        side = components.select(F.col("ch").alias(f"ch{k}"), F.col("count").alias(f"c{k}"))
        scored = scored.withColumn(f"ch{k}", F.substring("ngram", k, 1)).join(F.broadcast(side) if small else side, f"ch{k}")
        share = F.col(f"c{k}") / F.col("total")
        product = share if product is None else product * share
    pmi = F.log2((F.col("frequency") / F.col("total")) / product)
    return scored.select("ngram", pmi.alias("pmi"), "frequency").where(F.col("pmi").isNotNull() & ~F.isnan("pmi") & (F.abs("pmi") < float("inf")))


def top_ngrams(scores: DataFrame, top_k: int) -> DataFrame:
    """The ``top_k`` rows by score; ties by frequency, then by n-gram."""
    return scores.orderBy(F.desc(F.round("pmi", 6)), F.desc("frequency"), "ngram").limit(top_k)


def pmi(lines: DataFrame, n: int = 2, top_k: int = 2500, min_freq: int = 3) -> DataFrame:
    """(ngram, pmi, frequency): the best n-grams of the lines."""
    if n not in (1, 2, 3):
        raise ValueError("n must be 1, 2 or 3")
    if top_k < 1 or min_freq < 1:
        raise ValueError("top_k and min_freq must be at least 1")
    return top_ngrams(pmi_scores(written(ngram_counts(lines, n), "ngram-counts"), n, min_freq), top_k)


def with_prefix(items: DataFrame, prefix: str, column: str = "ngram") -> DataFrame:
    return items.where(F.startswith(F.col(column), F.lit(prefix)))


def with_suffix(items: DataFrame, suffix: str, column: str = "ngram") -> DataFrame:
    return items.where(F.endswith(F.col(column), F.lit(suffix)))


def last_written(items: DataFrame, key: str = "ngram", order: str = "pos") -> DataFrame:
    """Each key's last row by ``order``, as adding it again overwrites it."""
    rest = [c for c in items.columns if c != key]
    return items.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


#: Bytes that a node of a byte trie is estimated at: its own and its share of the child table.
NODE_BYTES = 96


def prefix_tree_nodes(items: DataFrame, column: str = "ngram") -> DataFrame:
    """One row (nodes, bytes): the nodes of a byte trie of the items, with its root, and its estimated memory."""
    data = F.col(column).cast("binary")
    heads = F.transform(F.sequence(F.lit(1), F.octet_length(column)), lambda i: F.hex(F.substring(data, F.lit(1), i)))
    nodes = items.where(F.octet_length(column) > 0).select(F.explode(heads).alias("p")).agg((F.count_distinct("p") + 1).alias("nodes"))
    return nodes.withColumn("bytes", F.col("nodes") * NODE_BYTES)
