"""Sinks: line folders, single ordered files, tables with ``%g`` numbers, and statistics as JSON."""

from __future__ import annotations

import json
import os
import re
import shutil
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from inkwell.runtime import shared_dir, shared_path, ship


def write_lines(df: DataFrame, path: str, column: str = "line", order: str | None = None) -> int:
    """One ordered file (or standard output for ``-``, nothing for ``null``); returns the lines.

    All tasks write parts, which then become one file; only lines for standard output are sent to the driver.
    """
    if order:
        df = df.orderBy(order)
    if path == "null":
        df.write.format("noop").mode("overwrite").save()
        return -1
    if path == "-":
        return write_text((r[0] + "\n" for r in df.select(column).toLocalIterator()), path)
    spark = df.sparkSession
    parts, seen = shared_path(spark, "parts"), Observation()
    _target(spark, path)
    counted = df.select(column).observe(seen, F.count(F.lit(1)).alias("lines"))
    counted.write.option("compression", "none").option("lineSep", "\n").text(parts)
    _join_parts(spark, parts, path)
    return seen.get["lines"]


def _target(spark: SparkSession, path: str) -> tuple:
    """The filesystem and the path of a file to write, which may not be a folder; paths that are no URI are the driver's."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path if is_uri(path) else f"file://{os.path.abspath(path)}")
    fs = p.getFileSystem(conf)
    if fs.exists(p) and fs.getFileStatus(p).isDirectory():
        raise IsADirectoryError(path)
    return fs, p


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The local path under which all executors reach ``path``: those in the shared folder, where that is a mounted one."""
    root, at = (re.sub(r"^file:/+", "/", x) for x in (shared_dir(spark), path))
    return at if at.startswith(root.rstrip("/") + "/") and not is_uri(at) else None


def _join_parts(spark: SparkSession, folder: str, path: str) -> None:
    """The part files of ``folder`` one after another in a file; the folder goes.

    In a mounted shared folder all tasks copy their parts to their places.
    Elsewhere a file can only be written from its start, or is the driver's own:
    there the driver's JVM copies block by block, and holds one block.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source = jvm.org.apache.hadoop.fs.Path(folder)
    held = source.getFileSystem(conf)
    found = [(int(m[1]), x.getPath(), x.getLen()) for x in held.listStatus(source) if (m := re.match(r"part-(\d+)", x.getPath().getName()))]
    found.sort(key=lambda x: (x[0], x[1].getName()))
    fs, target = _target(spark, path)
    fs.delete(target, False)  # with its checksum, if it has one
    at = _mounted(spark, path)
    if at and (inside := _mounted(spark, folder)):
        rows, end = [], 0
        for _, p, size in found:
            if size:
                rows.append((f"{inside}/{p.getName()}", end))
            end += size
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "wb") as f:
            f.truncate(end)
        _copy_to_places(spark, rows, at)
    else:
        out = fs.create(target, True) if is_uri(path) else fs.getRawFileSystem().create(target, True)
        try:
            for _, p, _ in found:
                part = held.open(p)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                finally:
                    part.close()
        finally:
            out.close()
    held.delete(source, True)


def _copy_to_places(spark: SparkSession, rows: list[tuple[str, int]], target: str) -> None:
    """Copy local files to given places of a file; a task that runs again writes the same bytes again."""
    ship(spark)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at in zip(*(c.to_pylist() for c in batch.columns)):
                with open(name, "rb") as part, open(target, "r+b") as out:
                    out.seek(at)
                    shutil.copyfileobj(part, out, 1 << 20)
            yield batch.slice(0, 0)

    kind = "name string, at long"
    spark.createDataFrame(rows, kind).mapInArrow(copy, kind).write.format("noop").mode("overwrite").save()


def write_folder(df: DataFrame, path: str, column: str = "line") -> None:
    """A folder of text files, written by all tasks; the form for large results."""
    df.select(column).write.mode("overwrite").text(path)


class _RemoteFile:
    """A text file on any filesystem that Spark knows, written in blocks."""

    def __init__(self, path: str):
        sc = SparkSession.active().sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
        if fs.exists(p) and fs.getFileStatus(p).isDirectory():
            raise IsADirectoryError(path)
        self.stream, self.held, self.size = fs.create(p, True), [], 0  # with its parent folders

    def write(self, text: str) -> None:
        self.held.append(text)
        self.size += len(text)
        if self.size >= 1 << 20:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.stream.write(bytearray("".join(self.held).encode("utf-8", "surrogatepass")))
        self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        self.stream.close()


def is_uri(path: str) -> bool:
    """Whether a path names a filesystem, so that Spark's own access is needed."""
    return re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", path) is not None


def _opened(path: str):
    if is_uri(path):
        return _RemoteFile(path)
    if os.path.isdir(path):
        raise IsADirectoryError(path)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    return open(path, "w", encoding="utf-8", newline="")


def write_text(parts: Iterable[str], path: str) -> int:
    """Write ``parts`` one after another to a local path, a URI of any filesystem, or standard output for ``-``; returns their number."""
    n = 0
    out = sys.stdout if path == "-" else _opened(path)
    try:
        for part in parts:
            out.write(part)
            n += 1
    finally:
        if path != "-":
            out.close()
    return n


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")


def pmi_tsv(df: DataFrame, header: bool = True) -> Iterable[str]:
    """Lines of ``ngram, pmi, frequency``; numbers have six significant digits."""
    if header:
        yield "ngram\tpmi\tfrequency\n"
    for r in df.select("ngram", "pmi", "frequency").toLocalIterator():
        yield f"{r['ngram']}\t{r['pmi']:g}\t{r['frequency']}\n"


def words_tsv(df: DataFrame) -> Iterable[str]:
    """Lines of ``word, score, frequency, context``; line ends and tabs in contexts are escaped."""
    yield "word\tscore\tfrequency\tcontext\n"
    for r in df.select("word", "score", "frequency", "context").toLocalIterator():
        yield f"{escaped(r['word'])}\t{r['score']:.2f}\t{r['frequency']}\t{escaped(r['context'])}\n"


def lines_to_buffer(df: DataFrame, column: str = "line", order: str = "pos") -> bytes:
    return "".join(r[0] + "\n" for r in df.orderBy(order).select(column).toLocalIterator()).encode()


def stats_json(command: str, **values: object) -> str:
    return json.dumps({"command": command, **values}, ensure_ascii=False)


def to_parallel_arrays(df: DataFrame, order: str) -> DataFrame:
    """One row of arrays: words, scores, frequencies, contexts in the order of ``order``."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "word", "score", "frequency", "context")))
    packed = df.agg(rows.alias("r"))
    names = {"word": "words", "score": "scores", "frequency": "frequencies", "context": "contexts"}
    return packed.select(*[F.col("r").getField(c).alias(n) for c, n in names.items()])
