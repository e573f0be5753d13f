"""Operator 7: drop the lines that many documents share.

Lines are normalised (lower case, runs of blanks as one space, trimmed) and
hashed; a document's hashes are made distinct before they are exploded, so the
count of documents a hash is a plain count that combines before its shuffle.
Lines whose hash is in more than ``max_docs`` documents go; the others are put
together again in their order. Short lines repeat by chance and long ones don't,
so lines of at least ``long_words`` words can have a lower threshold of their own.

The frequent hashes are handed to every task where their checked number is at
most ``broadcast_hashes``; beyond that they are joined by hash and brought back
to their document by a second join. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import picked, tune, written

MAX_DOCS = 10
#: The threshold of long lines, where it is asked for.
LONG_WORDS, LONG_DOCS = 50, 1
BROADCAST_HASHES = 1_000_000
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"


def _lines(text: Column) -> Column:
    flat = F.regexp_replace(F.lower(text), "[ \\t\\r\\f]+", " ")
    return F.transform(F.split(flat, "\n", -1), lambda x: F.trim(x))


def _hash(line: Column) -> Column:
    return F.when(line != "", F.xxhash64(line))


def line_hashes(text: Column) -> Column:
    """The hash of each normalised line; null for a line without visible characters."""
    return F.transform(_lines(text), _hash)


def _is_long(line: Column, words: int) -> Column:
    """Whether a normalised line has so many words; of scripts without blanks, each character counts as one."""
    spaced = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    wide = F.octet_length(line) - F.length(line)  # two bytes or more for each such character, which adds two words at most
    count = F.regexp_count(line, F.lit(f"[{_UNSPACED}]|[^ {_UNSPACED}]+"))
    return F.when(F.octet_length(line) < 2 * words - 1, F.lit(False)).when(spaced >= words, F.lit(True)).when(spaced + wide < words, F.lit(False)).otherwise(count >= words)


def dedup_lines(
    docs: DataFrame,
    max_docs: int = MAX_DOCS,
    id_col: str = "doc_id",
    text_col: str = "text",
    broadcast_hashes: int = BROADCAST_HASHES,
    long_words: int | None = None,
    long_docs: int = LONG_DOCS,
) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) for every row of ``docs``.

    Every row counts as a document of its own, also where ids or whole rows
    repeat; a line that repeats within a row counts once. Blank lines are never
    counted or dropped. Very long texts are looked through whole. A null text stays null, with 0 lines; a text that loses
    all its lines becomes the empty text. Null ids are kept. An empty table
    gives no rows. Other columns are ignored, whatever their names.

    With ``long_words``, lines of at least so many words go already where more
    than ``long_docs`` documents have them. All their copies go, the first as well.
    """
    tune(docs.sparkSession)
    rows = picked(docs, doc_id=id_col, text=text_col)
    texts = rows.where(F.col("text").isNotNull())
    if long_words is None:
        hashes, most = texts.select(F.explode(F.array_distinct(line_hashes(F.col("text")))).alias("h")), F.lit(max_docs)
    else:
        pairs = F.transform(_lines(F.col("text")), lambda x: F.struct(_hash(x).alias("h"), _is_long(x, long_words).alias("long")))
        hashes = texts.select(F.explode(F.array_distinct(pairs)).alias("p")).select("p.*")
        most = F.when(F.col("long"), long_docs).otherwise(max_docs)
    keys = [c for c in ("h", "long") if c in hashes.columns]
    counted = hashes.where(F.col("h").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("h")
    frequent = written(counted, "line-hashes")
    if frequent.count() <= broadcast_hashes:
        found = rows.withColumn("drop", _marker(docs, frequent)(line_hashes(F.col("text"))))
    else:
        found = _joined(rows, frequent)
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.col("drop"), i))
    return found.select(
        "doc_id",
        F.when(F.size("drop") > 0, F.array_join(kept, "\n")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.greatest(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def _marker(docs: DataFrame, frequent: DataFrame):
    """A function from a document's hashes to the places of those that are frequent."""
    known = docs.sparkSession.sparkContext.broadcast(np.sort(frequent.toPandas()["h"].to_numpy(dtype=np.int64)))

    def mark(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hot = known.value
        for batch in batches:
            flat = batch.flatten()
            values = flat.fill_null(0).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(hot, values), max(0, len(hot) - 1))
            hit = (hot[at] == values) if len(hot) else np.zeros(len(values), bool)
            if flat.null_count:
                hit &= ~flat.is_null().to_numpy(zero_copy_only=False)
            sizes = np.array([0 if n is None else n for n in pa.compute.list_value_length(batch).to_pylist()], dtype=np.int64)
            ends = np.cumsum(sizes)
            spots = np.flatnonzero(hit)
            owner = np.searchsorted(ends, spots, side="right")
            places = spots - (ends - sizes)[owner] if len(spots) else spots
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes))[: len(sizes)])])
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(places, pa.int32()))

    import pyarrow.compute  # noqa: F401  (list_value_length)

    return F.arrow_udf(mark, "array<int>").asNondeterministic()


def _joined(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """The same by joins: rows get a number, and their frequent lines' places come back to it."""
    numbered = written(rows.withColumn("row", F.monotonically_increasing_id()), "line-rows")
    places = (
        numbered.select("row", F.posexplode(line_hashes(F.col("text"))).alias("place", "h"))
        .where(F.col("h").isNotNull())
        .join(frequent, "h")
        .groupBy("row")
        .agg(F.collect_list("place").alias("drop"))
    )
    return numbered.join(places, "row", "left").withColumn("drop", F.coalesce("drop", F.array().cast("array<int>"))).drop("row")
