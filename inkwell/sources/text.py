"""Line, table and byte sources. Lines end at a line feed only; a carriage return is part of its line."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from inkwell.runtime import ship

#: Bytes of a file that are read at once, and that a task cuts into chunks.
_READ = 1 << 22
_RANGE = 1 << 24


def is_stdin(path: str) -> bool:
    return path == "-"


is_stdout = is_stdin


def _must_exist(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(path)


def read_lines(spark: SparkSession, path: str, strip_cr: bool = False) -> DataFrame:
    """(pos, line) of a file, a folder or, for ``-``, standard input; ``pos`` is in file order.

    ``strip_cr`` takes one carriage return off each line's end.
    """
    if is_stdin(path):
        return buffer_lines(spark, sys.stdin.buffer.read(), strip_cr)
    _must_exist(spark, path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    out = spark.read.option("lineSep", "\n").text(path).select(place.alias("pos"), F.col("value").alias("line"))
    return out.withColumn("line", F.regexp_replace("line", "\r$", "")) if strip_cr else out


def buffer_lines(spark: SparkSession, data: bytes, strip_cr: bool = False) -> DataFrame:
    """(pos, line) of bytes in memory; invalid UTF-8 becomes U+FFFD, and an empty tail is no line."""
    lines = data.decode("utf-8", "replace").split("\n")
    if lines[-1] == "":
        lines.pop()
    rows = [(i, x.removesuffix("\r") if strip_cr else x) for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, "pos long, line string")


def lines_of(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(pos, line) of a table's texts: ``pos`` is (key, place of the line in its text)."""
    split = df.select(F.col(key).alias("key"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("at", "line"))
    return split.select(F.struct("key", "at").alias("pos"), "line")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file's whole content, with CR LF as LF. A file is one row, so it has to fit into a task's memory."""
    _must_exist(spark, path)
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.replace("value", F.lit("\r\n"), F.lit("\n")).alias("text"))


def whole_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, chars, md5) of each file's whole content (UTF-8), with CR LF as LF; files of any size are read as a stream.

    Empty files have no row, as in :func:`read_whole`. An MD5 is a fold over the bytes in their order, so a file is one task's work.
    """
    _must_exist(spark, path)
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                md5, chars, held = hashlib.md5(usedforsecurity=False), 0, b""
                fs, at = _opener(name)
                with fs.open_input_stream(at, compression=None) as f:
                    more = True
                    while more:
                        data = f.read(_READ)
                        more, data = bool(data), held + data
                        held = b"\r" if more and data.endswith(b"\r") else b""  # its line feed may follow
                        data = data[: len(data) - len(held)].replace(b"\r\n", b"\n")
                        md5.update(data)
                        chars += int(np.count_nonzero(np.frombuffer(data, np.int8) >= -64))  # no continuation bytes
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([chars], pa.int64()), pa.array([md5.hexdigest()])], names=["path", "chars", "md5"])

    return files.mapInArrow(digest, "path string, chars long, md5 string")


def read_pmi(spark: SparkSession, path: str, min_score: float = 1.0) -> DataFrame:
    """(pos, ngram, pmi, frequency) of a tab-separated table.

    The first line is a header if it holds ``ngram``. Lines without a readable
    score and count are skipped, further columns ignored. Raises for a negative
    ``min_score`` and for a file without lines.
    """
    if min_score < 0:
        raise ValueError("min_score must not be negative")
    lines = read_lines(spark, path)
    first = lines.orderBy("pos").first()
    if first is None:
        raise ValueError(f"{path} is empty")
    at = first["pos"]
    place = F.struct(*[F.lit(v).alias(k) for k, v in at.asDict().items()]) if isinstance(at, Row) else F.lit(at)
    body = lines.where(F.col("pos") != place) if "ngram" in first["line"] else lines
    if body.isEmpty():
        raise ValueError(f"{path} has no data lines")
    return parse_pmi(body, min_score)


def parse_pmi(lines: DataFrame, min_score: float = 1.0) -> DataFrame:
    """(pos, ngram, pmi, frequency) of lines without header."""
    rest = F.regexp_extract("line", r"^[^\t]*\t([\s\S]*)$", 1)
    number = r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
    score = F.regexp_extract(rest, number, 1)
    count = F.regexp_extract(rest, number + r"\s+\+?(\d+)", 2)
    rows = lines.select("pos", F.substring_index("line", "\t", 1).alias("ngram"), F.expr("try_cast('0' AS double)").alias("zero"), score.alias("s"), count.alias("c"), F.contains("line", F.lit("\t")).alias("tab"))
    rows = rows.where("tab").select("pos", "ngram", F.col("s").try_cast("double").alias("pmi"), F.col("c").try_cast("long").alias("frequency"))
    return rows.where("pmi IS NOT NULL AND frequency IS NOT NULL").where(F.col("pmi") >= min_score)


def read_dictionary(spark: SparkSession, path: str | None) -> DataFrame:
    """(text): the distinct lines; a missing file is an empty dictionary."""
    try:
        if not path:
            raise FileNotFoundError
        return read_lines(spark, path).select(F.col("line").alias("text")).distinct()
    except FileNotFoundError:
        return spark.createDataFrame([], "text string")


def _opener(name: str):
    """The filesystem of a file as Spark names it, and the file's path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(name if "://" in name else "file://" + name.removeprefix("file:"))


def read_chunks(spark: SparkSession, path: str, chunk_bytes: int) -> DataFrame:
    """(path, chunk_no, chunk): the raw bytes of files in pieces; ranges of about ``_RANGE`` bytes are tasks of their own."""
    _must_exist(spark, path)
    ship(spark)
    per = max(1, _RANGE // chunk_bytes)
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    last = ((F.col("length") - 1) / F.lit(per * chunk_bytes)).cast("long")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("r"))
    tasks = min(10_000, max(1, -(-path_size(spark, path) // (per * chunk_bytes))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length, r in zip(*(c.to_pylist() for c in batch.columns)):
                fs, at = _opener(name)
                with fs.open_input_file(at) as f:
                    f.seek(r * per * chunk_bytes)
                    for n in range(r * per, min((r + 1) * per, -(-length // chunk_bytes))):
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([f.read(min(chunk_bytes, length - n * chunk_bytes))])], names=["path", "chunk_no", "chunk"])

    return ranges.repartition(tasks).mapInArrow(cut, "path string, chunk_no long, chunk binary")


def process_lines(path: str, fn: Callable[[str], None]) -> int:
    """Call ``fn`` in the driver for each line of a file, folder, URI or standard input, without its CR; returns the number of lines.

    Lines come a partition at a time; ``operators.maps.for_each`` calls in parallel.
    """
    if is_stdin(path):
        n = 0
        for raw in sys.stdin.buffer:
            fn(raw.decode("utf-8", "replace").removesuffix("\n"))
            n += 1
        return n
    n = 0
    for r in read_lines(SparkSession.active(), path, strip_cr=True).select("line").toLocalIterator():
        fn(r["line"])
        n += 1
    return n


def path_size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder on any filesystem."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
