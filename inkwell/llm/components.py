"""Connected components: of a large table of edges, and of the edges within a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import written


def forest_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` after joining the nodes ``a`` and ``b``; a label is the least node of a component."""
    label = label.copy()
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


#: So many edges (16 MB) are looked through in one task, with no further steps.
TASK_EDGES = 1_000_000


def _solved(edges: DataFrame) -> DataFrame:
    """(node, root) of edges that fit in one task."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            a, b = (np.concatenate(x) for x in zip(*parts))
            node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            label = forest_labels(np.arange(len(node)), at[: len(a)], at[len(a) :])
            for s in range(0, len(node), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(node[s : s + 100_000]), pa.array(node[label[s : s + 100_000]])], names=["node", "root"])

    return edges.coalesce(1).mapInArrow(solve, "node long, root long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least node of its connected component.

    Large-star and small-star steps alternate until nothing changes or no more
    than ``TASK_EDGES`` edges are left; every step's edges are written to the
    shared folder.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, n = None, now.count()
    while n > TASK_EDGES:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .distinct()
        )
        now = written(small, "edges")
        n, key = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, key) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
        before = (n, key)
    return _solved(now)
