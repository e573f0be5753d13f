"""Operator 8: WARC files as a table of record chunks.

Files are read as a stream: a record's payload is never held as a whole, but cut
into rows of at most ``chunk_bytes`` bytes, each with the record's identifier,
its chunk number, and the SHA-256 digest of the payload so far. The digest of
the last chunk is that of the whole payload. Arrow batches are bounded in bytes.
Whatever a file holds, its bytes come out as rows: what isn't a record, or breaks
off, is marked and never ends the job.

The writer puts each partition into a file of one gzip member a record. A task's
file has a name of its own attempt, and only files of finished tasks get into
the manifest, so lost executors and repeated tasks leave no doubles.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import open_fs, picked, shared_dir, tune, written

CHUNK_BYTES = 32 * 1024
READ_BYTES = 64 * 1024
BATCH_BYTES = 4 * 1024 * 1024
#: Header lines, and blocks of HTTP headers, are held up to this size; what is longer isn't taken for a header.
MAX_HEADER = 1024 * 1024
#: Bytes of small files that one task reads.
TASK_BYTES = 256 * 1024 * 1024
#: The warc_type of bytes where a record should begin.
MALFORMED = "malformed"
CHUNKS = "record_id string, warc_type string, target_uri string, chunk_no int, chunk_offset long, n_bytes int, chunk binary, digest string, is_last boolean, complete boolean"
_ARROW = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("target_uri", pa.string()), ("chunk_no", pa.int32()), ("chunk_offset", pa.int64()), ("n_bytes", pa.int32()), ("chunk", pa.binary()), ("digest", pa.string()), ("is_last", pa.bool_()), ("complete", pa.bool_())])


class Source:
    """Bytes of a plain file or of any number of gzip members, never more than a block ahead.

    Damaged gzip data end what can be read, until :meth:`resume` goes on with the
    next member.
    """

    def __init__(self, file):
        self.file, self.buffer, self.inflate, self.broken = file, b"", None, False
        self.raw = file.read(READ_BYTES)
        self.packed = self.raw[:2] == b"\x1f\x8b"

    def _more(self) -> bool:
        """Get some more bytes; false at the end."""
        if not self.packed:
            data, self.raw = self.raw or self.file.read(READ_BYTES), b""
            self.buffer += data
            return bool(data)
        while not self.broken:
            if self.inflate is None or self.inflate.eof:
                rest = self.inflate.unused_data if self.inflate is not None else b""
                self.raw = rest + self.raw
                if not self.raw:
                    self.raw = self.file.read(READ_BYTES)
                if not self.raw.strip(b"\0"):
                    return False
                self.inflate = zlib.decompressobj(31)
            raw = self.inflate.unconsumed_tail or self.raw
            if not self.inflate.unconsumed_tail:
                self.raw = b""
                raw = raw or self.file.read(READ_BYTES)
                if not raw:
                    return False
            try:
                data = self.inflate.decompress(raw, READ_BYTES)
            except zlib.error:
                self.broken, self.raw = True, raw[1:] + self.raw
                break
            if data:
                self.buffer += data
                return True
        return False

    def resume(self) -> None:
        """After damaged data, go to the next gzip member."""
        self.broken, self.inflate, self.buffer = False, None, b""
        while (at := self.raw.find(b"\x1f\x8b\x08")) < 0:
            more = self.file.read(READ_BYTES)
            if not more:
                self.raw = b""
                return
            self.raw = self.raw[-2:] + more
        self.raw = self.raw[at:]

    def line(self, most: int = MAX_HEADER) -> bytes:
        """The next line with its end, or its first ``most`` bytes; empty at the end of the file."""
        seen = 0
        while (at := self.buffer.find(b"\n", seen, most)) < 0:
            seen = len(self.buffer)
            if seen >= most or not self._more():
                at = min(len(self.buffer), most) - 1
                break
        out, self.buffer = self.buffer[: at + 1], self.buffer[at + 1 :]
        return out

    def read(self, n: int) -> bytes:
        """Up to ``n`` bytes; fewer only at the end of the file."""
        while len(self.buffer) < n and self._more():
            pass
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out

    def unread(self, data: bytes) -> None:
        self.buffer = data + self.buffer


def _to_next(source: Source) -> Iterator[bytes]:
    """Everything before the next line that begins a record, in pieces."""
    start = True
    while line := source.line(READ_BYTES):
        if start and line.startswith(b"WARC/"):
            source.unread(line)
            return
        start = line.endswith(b"\n")
        yield line


def _parts(source: Source, left: int, chunk_bytes: int) -> Iterator[bytes]:
    while left and (data := source.read(min(chunk_bytes, left))):
        left -= len(data)
        yield data


def _head_of(source: Source) -> tuple[dict[str, str] | None, bytes]:
    """The fields of a record's head, null if it doesn't end as one, and its bytes."""
    head: dict[str, str] = {}
    raw = b""
    while len(raw) < MAX_HEADER:
        line = source.line(MAX_HEADER - len(raw))
        raw += line
        if not line.endswith(b"\n"):
            break
        if not line.strip():
            return head, raw
        name, _, value = line.decode("utf-8", "replace").partition(":")
        head.setdefault(name.strip().lower(), value.strip())
    return None, raw


def _http_head(source: Source, left: int) -> tuple[bytes, bool]:
    """The HTTP head's bytes of a block of ``left`` bytes, and whether a blank line ends it."""
    head = b""
    while len(head) < min(left, MAX_HEADER):
        line = source.line(min(left, MAX_HEADER) - len(head))
        head += line
        if not line.strip() and line.endswith(b"\n"):
            return head, True
        if not line:
            break
    return head, False


def _rechunked(parts: Iterator[bytes], size: int) -> Iterator[bytes]:
    """The same bytes in chunks of ``size``; one of 0 bytes if there are none."""
    held, any_ = b"", False
    for part in parts:
        held += part
        while len(held) > size:
            yield held[:size]
            held, any_ = held[size:], True
    if held or not any_:
        yield held


def _rows(identity: tuple, parts: Iterator[bytes], expected: int, chunk_bytes: int) -> Iterator[tuple]:
    """A record's rows; it is complete if its payload has the ``expected`` bytes."""
    digest, offset = hashlib.sha256(), 0
    chunks = _rechunked(parts, chunk_bytes)
    now, number = next(chunks), 0
    while now is not None:
        after = next(chunks, None)
        digest.update(now)
        last = after is None
        yield (*identity, number, offset, len(now), now, digest.hexdigest(), last, last and offset + len(now) == expected)
        offset += len(now)
        now, number = after, number + 1


def chunks_of(file, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Rows of ``CHUNKS`` for all records of an open WARC file."""
    source = Source(file)
    while True:
        line = source.line(READ_BYTES)
        if not line:
            if not source.broken:
                return
            source.resume()
            continue
        if not line.strip():
            continue
        source.unread(line)
        if not line.startswith(b"WARC/"):
            yield from _rows((None, MALFORMED, None), _to_next(source), -1, chunk_bytes)
            continue
        head, raw = _head_of(source)  # its version line is no field
        if head is None:
            yield from _rows((None, MALFORMED, None), itertools.chain([raw], _to_next(source)), -1, chunk_bytes)
            continue
        identity = (head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"))
        length = head.get("content-length", "0")
        if not (length.isascii() and length.isdigit() and len(length) < 19):
            yield from _rows(identity, _to_next(source), -1, chunk_bytes)
            continue
        left, first, whole = int(length), b"", True
        if left and head.get("warc-type") == "response" and head.get("content-type", "").startswith("application/http"):
            first, whole = _http_head(source, left)
            left -= len(first)
        payload = _parts(source, left, chunk_bytes)
        yield from _rows(identity, payload if whole else itertools.chain([first], payload), left if whole else -1, chunk_bytes)


def read_warc(spark: SparkSession, paths: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table (``CHUNKS``) of the files whose paths are in ``paths`` (path).

    An empty payload is one chunk of 0 bytes, and payloads of any length are
    streamed. Marked ``complete`` = false, with all bytes that there are: records
    within which a file or an undamaged stretch of gzip data ends; those without a
    numeric length (up to the next record); ``application/http`` responses whose
    head has no end (head included). Bytes where a record should begin, up to the
    next one, have ``warc_type`` = "malformed" and are not complete. Missing header
    fields are null, a missing length is 0; of a repeated field the first counts.
    Records that repeat an identifier give their rows each. An empty file or table gives no
    rows. Null paths are left out; a path that doesn't exist raises. With a column
    ``n_bytes`` small files share a task. Other columns are ignored, whatever their
    names.
    """
    tune(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                if path is None:
                    continue
                fs, at = open_fs(path)
                rows, size = [], 0
                with fs.open_input_stream(at, compression=None) as file:
                    for row in chunks_of(file, chunk_bytes):
                        rows.append(row)
                        size += row[5] + 200
                        if size >= BATCH_BYTES:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    names = {"path": "path"} | ({"n_bytes": "n_bytes"} if "n_bytes" in paths.columns else {})
    files = picked(paths, **names).where("path IS NOT NULL")
    n, total = files.agg(F.count(F.lit(1)), F.sum("n_bytes") if "n_bytes" in names else F.lit(None).cast("long")).first()
    # files in order of size, so that each task reads about as much
    share = max(1, min(TASK_BYTES, (total or 0) // (4 * spark.sparkContext.defaultParallelism)))
    size = F.coalesce("n_bytes", F.lit(share)) if "n_bytes" in names else F.lit(share)
    before = F.sum("size").over(Window.orderBy(F.desc("size"), "path").rowsBetween(Window.unboundedPreceding, -1))
    placed = files.select("path", size.alias("size")).withColumn("task", F.floor(F.coalesce(before, F.lit(0)) / share).cast("int"))
    tasks = max(1, min(n, ((total if total is not None else n * share) + share - 1) // share))
    return placed.repartitionById(int(tasks), F.col("task") % int(tasks)).select("path").mapInArrow(read, CHUNKS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def record_bytes(record_id: str, uri: str | None, payload: bytes) -> bytes:
    """The head of a ``response`` record and its payload's HTTP headers."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    target = f"WARC-Target-URI: {uri}\r\n" if uri is not None else ""
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {record_id}\r\n{target}WARC-Date: 2020-01-01T00:00:00Z\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http) + len(payload)}\r\n\r\n"
    return head.encode() + http


def record_id_of(page_id: int | None, url: str | None) -> str:
    """An identifier of the row's own, ``<urn:uuid:...>``."""
    key = f"{'null' if page_id is None else page_id}|{'null' if url is None else url}"
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(key.encode('utf-8', 'surrogatepass')).hexdigest())}>"


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, html) as WARC files; returns their manifest (path, records, n_bytes).

    A null page is written as an empty one, a null url without a target. Line
    ends in a url are percent-encoded. An empty table gives no files.
    """
    tune(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0, 0
        fs, at = open_fs(path)
        for batch in batches:
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    out = fs.open_output_stream(at, compression=None)
                payload = (html or "").encode("utf-8", "surrogatepass")
                uri = url.replace("\r", "%0D").replace("\n", "%0A") if url is not None else None
                z = zlib.compressobj(3, zlib.DEFLATED, 31)
                for part in (record_bytes(record_id_of(page, url), uri, payload), payload, b"\r\n\r\n"):
                    size += out.write(z.compress(part)) or 0
                out.write(z.flush())
                n += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "n_bytes"])

    rows = picked(pages, page_id="page_id", url="url", html="html")
    return written(rows.mapInArrow(write, "path string, records long, n_bytes long"), "warc-manifest")


def chunk_pages(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of all ``pages`` by way of WARC files in the shared folder."""
    spark = pages.sparkSession
    manifest = write_warc(pages, f"{shared_dir(spark)}/inkwell/warc-{uuid.uuid4().hex}")
    return read_warc(spark, manifest, chunk_bytes)


def portable(chunks: DataFrame) -> DataFrame:
    """The chunk table with bytes as base64, which compares alike in all engines."""
    return chunks.withColumn("chunk", F.translate(F.base64("chunk"), "\r\n", ""))
