"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import math

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.runtime import shared_dir, ship, written  # noqa: F401

#: Rows that one ordered bucket of :func:`with_prefix` holds on average.
BUCKET_ROWS = 50_000
#: Documents in one Arrow batch, and its bytes, so that a batch of very long texts still fits in memory.
ARROW_ROWS, ARROW_BYTES = 1_000, 16 * 1024 * 1024


def tune(spark: SparkSession) -> None:
    """Send the package to the workers, and bound Arrow batches in rows and bytes where the session has no setting of its own."""
    ship(spark)
    for name, value in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(value))


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The filesystem of a path or URI, and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under new names, whatever else ``df`` holds.

    The lookup is by exact spelling and position, so extra columns that differ
    only in case, contain dots or repeat a name can't clash.
    """
    names = df.columns
    renamed = df.toDF(*[f"__c{i}" for i in range(len(names))])
    return renamed.select(*[F.col(f"__c{names.index(old)}").alias(new) for new, old in columns.items()])


def bucket_bits(n: int, per: int = BUCKET_ROWS) -> int:
    """Bits of an order key that split ``n`` rows into buckets of about ``per`` rows."""
    return min(24, max(0, math.ceil(math.log2(max(1, n) / per))))


def order_key(seed: str, *parts: Column) -> Column:
    """A seeded shuffle's key: md5 in hexadecimal, which every SQL engine computes alike."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))


def key_bucket(key: Column, bits: int) -> Column:
    """The first ``bits`` bits of a hexadecimal key; buckets keep the order of the keys."""
    return F.shiftright(F.conv(F.substring(key, 1, 7), 16, 10).cast("long"), 28 - bits)


def with_prefix(df: DataFrame, groups: list[str], bucket: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Add ``out``: the running sum of ``value`` in each group, in the order (bucket, order), exactly.

    A window over a whole group would sort the group in one task. Here only a
    bucket is sorted in a task; the sums of the buckets before it come from a
    small table of one row a bucket. ``groups`` may not hold nulls.
    """
    keys = [*groups, bucket]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        df.join(offsets, keys)
        .withColumn(out, F.sum(value).over(inside) + F.col("__before"))
        .drop("__before")
    )
