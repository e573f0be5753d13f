"""Filter, normalize and deduplicate lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import is_excluded, normalized_line
from inkwell.runtime import by_key, written


def normalized(lines: DataFrame, form: str = "NFKC", min_length: int = 0, max_length: int = 0) -> DataFrame:
    """(pos, line): lines that pass the filters before and after normalization, repeats included."""
    bounds = (min_length, max_length)
    done = lines.where(~is_excluded(F.col("line"), *bounds)).select("pos", normalized_line(F.col("line"), form).alias("line"))
    return done.where(F.col("line").isNotNull() & (F.col("line") != "")).where(~is_excluded(F.col("line"), *bounds))


def distinct_lines(lines: DataFrame) -> DataFrame:
    """(pos, line): each line once, at its first position; sort by ``pos`` for the order of first occurrence."""
    return lines.groupBy("line").agg(F.min("pos").alias("pos")).select("pos", "line")


def distinct_within(lines: DataFrame, batch: Column) -> DataFrame:
    """(pos, line): each line once in each ``batch``."""
    return lines.groupBy(batch.alias("batch"), "line").agg(F.min("pos").alias("pos")).select("pos", "line")


def numbered(lines: DataFrame) -> DataFrame:
    """``lines`` with ``number``, from 0 in the order of ``pos``; sums run over ranges of ``pos``, so no task sees all lines."""
    rows = written(lines.repartitionByRange("pos").withColumn("part", F.spark_partition_id()), "numbered-lines")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("pos")) - 1
    return by_key(rows, base, "part").withColumn("number", F.col("base") + inside).drop("part", "base")


def normalize_batches(lines: DataFrame, size: int = 1000, form: str = "NFKC") -> DataFrame:
    """(pos, line): normalized lines, each once in every batch of ``size`` lines; lines aren't bounded in length."""
    kept = numbered(lines).select(F.struct("pos", F.floor(F.col("number") / size).alias("batch")).alias("pos"), "line")
    done = distinct_within(normalized(kept, form), F.col("pos.batch"))
    return done.select("pos.pos", "line")


def normalize(lines: DataFrame, form: str = "NFKC", min_length: int = 0, max_length: int = 0) -> DataFrame:
    """(pos, line): the distinct normalized lines."""
    return distinct_lines(normalized(lines, form, min_length, max_length))


def normalize_stats(lines: DataFrame, form: str = "NFKC", min_length: int = 0, max_length: int = 0) -> DataFrame:
    """One row: rows, uniques, excluded lines, duplicates among the kept, and rows - uniques, which counts both."""
    return stats_of(lines, weighted_lines(lines, form, min_length, max_length))


def weighted_lines(lines: DataFrame, form: str = "NFKC", min_length: int = 0, max_length: int = 0) -> DataFrame:
    """(pos, line, count): the distinct normalized lines with how often each occurs; what both the result and its counters need."""
    return normalized(lines, form, min_length, max_length).groupBy("line").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("count")).select("pos", "line", "count")


def stats_of(lines: DataFrame, weights: DataFrame) -> DataFrame:
    """The counters of ``lines`` from their :func:`weighted_lines`."""
    counted = weights.agg(F.count(F.lit(1)).alias("uniques"), F.coalesce(F.sum("count"), F.lit(0)).alias("kept"))
    total = lines.agg(F.count(F.lit(1)).alias("rows"))
    both = total.crossJoin(counted)
    return both.select("rows", "uniques", (F.col("rows") - F.col("kept")).alias("excluded"), (F.col("kept") - F.col("uniques")).alias("duplicates"), (F.col("rows") - F.col("uniques")).alias("removed"))
