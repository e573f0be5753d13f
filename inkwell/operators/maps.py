"""User functions over lines: one at a time, in batches, in parallel, and folded."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from inkwell.runtime import ship


def map_lines(lines: DataFrame, fn: Callable[[str], str]) -> DataFrame:
    """(pos, line) with ``fn`` applied; lines that become empty are dropped."""
    ship(lines.sparkSession)

    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else fn(x))

    mapped = lines.select("pos", F.pandas_udf(apply, "string")("line").alias("line"))
    return mapped.where("line IS NOT NULL AND line <> ''")


def map_batches(lines: DataFrame, fn: Callable[[list[str]], list[str]], batch_size: int = 1000) -> DataFrame:
    """(line): ``fn`` on batches of lines; it may change their number."""
    ship(lines.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []

        def done(lines: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(fn(lines), pa.string())], names=["line"])

        for batch in batches:
            held += batch.column(0).to_pylist()
            while len(held) >= batch_size:
                yield done(held[:batch_size])
                held = held[batch_size:]
        if held:
            yield done(held)

    return lines.select("line").mapInArrow(apply, "line string")


def for_each(lines: DataFrame, fn: Callable[[str], None], progress: Callable[[int], None] | None = None, every: int = 100) -> int:
    """Call ``fn`` for each line, in parallel; ``progress`` gets the lines done after each ``every`` of a task. Returns the number of lines."""
    sc = lines.sparkSession.sparkContext
    ship(lines.sparkSession)
    done = sc.accumulator(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for line in batch.column(0).to_pylist():
                fn(line)
                n += 1
                if progress and n % every == 0:
                    progress(n)
        done.add(n)
        yield from ()

    lines.select("line").mapInArrow(run, "line string").write.format("noop").mode("overwrite").save()
    return done.value


#: Partial results that are folded in the driver.
_PARTS = 64


def reduce_column(df: DataFrame, column: str, fn: Callable, initial):
    """Fold a column: Arrow batches within tasks, then the tasks' results by ever fewer tasks; ``fn`` must be associative and ``initial`` neutral."""
    ship(df.sparkSession)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = initial
        for batch in batches:
            total = reduce(fn, batch.column(0).to_pylist(), total)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["part"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = initial
        for batch in batches:
            total = reduce(fn, map(pickle.loads, batch.column(0).to_pylist()), total)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["part"])

    parts = df.select(column).mapInArrow(fold, "part binary").repartition(_PARTS).mapInArrow(combine, "part binary")
    return reduce(fn, (pickle.loads(bytes(r["part"])) for r in parts.collect()), initial)


def observed(lines: DataFrame, name: str, column: str = "line") -> tuple[DataFrame, Observation]:
    """``lines`` with counters of lines and bytes that fill while an action runs over them; no further pass."""
    seen = Observation(name)
    size = F.sum(F.octet_length(column).cast("long") + 1)
    return lines.observe(seen, F.count(F.lit(1)).alias("lines"), F.coalesce(size, F.lit(0)).alias("bytes")), seen
