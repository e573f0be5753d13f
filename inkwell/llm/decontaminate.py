"""Operator 4: find and cut benchmark passages with an FM-index per training shard.

Each task turns stretches of its documents ("shards" of about ``shard_chars``
characters) into a word-level FM-index (:mod:`fmindex`): suffix array, wavelet
matrix over the Burrows-Wheeler transform, and sampled suffix positions. The
benchmark's phrases are searched backward through wavelet ranks; the occurrences
are located by walking to the next sampled position. Overlapping and touching
occurrences of a document merge into removal spans.

The documents aren't shuffled, and an index lives only as long as its shard. The
phrases are made on the executors and written to the shared folder in blocks of
about ``block_phrases``; a shard's one index is searched block by block. A worker
keeps up to ``CACHED_BLOCKS`` blocks between shards and reads further ones again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import open_fs, picked, tune, written
from inkwell.llm.fmindex import FMIndex
from inkwell.llm.words import Words, pieces, split_words

PHRASE_WORDS = 13
#: Ordinary text holds items of fewer words, so these are found only where they are a whole line or more.
SHORT_WORDS = 6
SHARD_CHARS = 4_000_000
BLOCK_PHRASES = 200_000
CACHED_BLOCKS = 4

PHRASES = "words binary, short boolean"


class Phrases:
    """A block of phrases: its distinct word hashes, and by (length, short) rows of numbers of these."""

    def __init__(self, rows: list[tuple[bytes, bool]]):
        flat = np.frombuffer(b"".join(w for w, _ in rows), np.uint64)
        self.vocabulary, ids = np.unique(flat, return_inverse=True)
        size = np.array([len(w) // 8 for w, _ in rows], np.int64)
        short = np.array([s for _, s in rows], bool)
        end = np.cumsum(size)
        self.groups: list[tuple[int, bool, np.ndarray]] = []
        for n in np.unique(size).tolist():
            for s in (False, True):
                which = np.flatnonzero((size == n) & (short == s))
                if len(which):
                    self.groups.append((n, s, ids[(end[which] - n)[:, None] + np.arange(n)].astype(np.int32)))

    def within(self, index: FMIndex) -> Iterator[tuple[int, bool, np.ndarray]]:
        """(length, short, rows of word hashes) of the phrases all of whose words are in the index."""
        if not len(index.vocabulary):
            return
        at = np.minimum(np.searchsorted(index.vocabulary, self.vocabulary), len(index.vocabulary) - 1)
        known = index.vocabulary[at] == self.vocabulary
        for n, short, ids in self.groups:
            live = np.flatnonzero(known[ids[:, -1]])
            live = live[known[ids[live]].all(axis=1)]
            if len(live):
                yield n, short, self.vocabulary[ids[live]]


def phrases_of(items: list[str | None], width: int = PHRASE_WORDS, least: int = SHORT_WORDS) -> list[tuple[bytes, bool]]:
    """The phrases of benchmark items, as bytes of word hashes, and whether the item is short.

    Every window of ``width`` words is a phrase; a shorter item is one phrase.
    Items of fewer than ``least`` words are short. Items without words have none.
    """
    rows: set[tuple[bytes, bool]] = set()
    least = min(least, width)
    for item in items:
        w = split_words([item or ""]).hashes
        n = min(width, len(w))
        rows |= {(w[i : i + n].tobytes(), len(w) < least) for i in range(len(w) - n + 1) if n}
    return sorted(rows)


def phrase_files(benchmark: DataFrame, width: int, block: int) -> list[str]:
    """The files that hold the distinct phrases of ``benchmark`` (text), about ``block`` in each."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = phrases_of(b.column(0).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), pa.array([s for _, s in rows], pa.bool_())], names=["words", "short"])

    phrases = written(benchmark.select("text").mapInArrow(make, PHRASES).distinct(), "phrases")
    n = phrases.count()
    if not n:
        return []
    return sorted(written(phrases.repartition(-(-n // block), "words"), "phrase-blocks").inputFiles())


_held: dict[str, Phrases] = {}


def _blocks(files: list[str]) -> Iterator[Phrases]:
    for path in files:
        block = _held.get(path)
        if block is None:
            fs, at = open_fs(path)
            table = pq.read_table(at, filesystem=fs)
            block = Phrases(list(zip(table["words"].to_pylist(), table["short"].to_pylist())))
            if len(_held) >= CACHED_BLOCKS and next(iter(_held)) not in files:
                _held.clear()
            if len(_held) < CACHED_BLOCKS:
                _held[path] = block
        yield block


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans, given in any order."""
    o = np.argsort(begin, kind="stable")
    begin, end = begin[o], np.maximum.accumulate(end[o])
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    return begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def _joined(texts: list[str]) -> Words:
    """The words of all texts, split piece by piece."""
    parts = [split_words(texts[lo:hi]) for lo, hi in pieces(texts)] or [split_words([])]
    bases = np.cumsum([0, *[int(p.text_begin[-1]) for p in parts]])
    over = lambda name: np.concatenate([getattr(p, name) + b for p, b in zip(parts, bases)])
    begin = over("begin")
    starts = np.concatenate([p.text_begin[:-1] + b for p, b in zip(parts, bases)])
    first = np.append(np.searchsorted(begin, starts), len(begin))
    return Words(np.concatenate([p.hashes for p in parts]), begin, over("end"), first, starts, over("feeds"))


def spans_in(texts: list[str], blocks: Iterator[Phrases], sample: int = 32, cut_before: bool = False, cut_after: bool = False) -> list[list[tuple[int, int]]]:
    """The removal spans of each text, as character positions (from, to).

    ``cut_before`` and ``cut_after`` tell that the only text is a piece whose
    ends needn't be ends of lines.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    w = _joined(texts)
    if not len(w.hashes):
        return out
    index = FMIndex(w.hashes, w.first, sample)
    line = None
    found_begin, found_end = [], []
    for block in blocks:
        for n, short, rows in block.within(index):
            _, at = index.find(rows)
            if short and len(at):
                if line is None:
                    line = np.searchsorted(w.feeds, w.begin)  # of each word, with one before and one after
                    line = np.concatenate([[line[0] - (not cut_before)], line, [line[-1] + (not cut_after)]])
                at = at[(line[at] < line[at + 1]) & (line[at + n] < line[at + n + 1])]
            found_begin.append(w.begin[at])
            found_end.append(w.end[at + n - 1])
    if not sum(map(len, found_begin)):
        return out
    a, b = np.concatenate(found_begin), np.concatenate(found_end)
    owner = np.searchsorted(w.text_begin, a, side="right") - 1
    order = np.argsort(owner, kind="stable")
    a, b, owner = a[order], b[order], owner[order]
    for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(owner)) + 1):
        k = owner[part[0]]
        x, y = merged(a[part] - w.text_begin[k], b[part] - w.text_begin[k])
        out[k] = list(zip(x.tolist(), y.tolist()))
    return out


def spans_in_long(text: str, blocks, chars: int, most: int = PHRASE_WORDS) -> list[tuple[int, int]]:
    """The removal spans of one text that is too long for an index, from overlapping pieces of about ``chars`` characters.

    A piece ends before a word that its end may cut, and the next one begins with
    the word before the last ``most`` ones, so every occurrence of up to ``most``
    words lies in a piece, with the words beside it. ``blocks()`` gives the phrases.
    """
    start, found = 0, []
    while True:
        part = text[start : start + chars]
        last = start + chars >= len(text)
        w = split_words([part])
        whole = len(w.begin)
        if not last and whole and w.end[-1] == len(part):
            whole -= 1
            part = part[: w.begin[-1]]
        if not last and whole <= most + 1:
            chars *= 2  # words longer than pieces
            continue
        found += [(a + start, b + start) for a, b in spans_in([part], blocks(), cut_before=start > 0, cut_after=not last)[0]]
        if last:
            break
        start += int(w.begin[whole - most - 1])
    if not found:
        return []
    x, y = merged(*(np.array(v) for v in zip(*found)))
    return list(zip(x.tolist(), y.tolist()))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    at, kept = 0, []
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return "".join([*kept, text[at:]])


def _finder(files: list[str], shard_chars: int, most: int):
    """A function from texts to (spans, clean text); clean is null where nothing is found."""
    kind = pa.struct([("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("clean", pa.string())])

    def answer(texts: list[str | None]) -> pa.Array:
        if not files:
            return pa.array([{"spans": [], "clean": None}] * len(texts), kind)
        if len(texts) == 1 and len(texts[0] or "") > shard_chars:
            found = [spans_in_long(texts[0], lambda: _blocks(files), shard_chars, most)]
        else:
            found = spans_in([t or "" for t in texts], _blocks(files))
        return pa.array([{"spans": [{"start": a, "end": b} for a, b in s], "clean": cut(t, s) if s else None} for t, s in zip(texts, found)], kind)

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held: list[str | None] = []
        size = 0
        for batch in batches:
            for t in batch.cast(pa.string()).to_pylist():
                n = len(t or "") + 1
                if held and size + n > shard_chars:
                    yield answer(held)
                    held, size = [], 0
                held.append(t)
                size += n
        if held:
            yield answer(held)

    return F.arrow_udf(find, "struct<spans:array<struct<start:int,end:int>>,clean:string>").asNondeterministic()


def _with_spans(df: DataFrame, text: str, benchmark: DataFrame, width: int, shard_chars: int, size: int) -> DataFrame:
    """``df`` with ``__spans`` and ``__clean``, which is null where nothing is found."""
    files = phrase_files(picked(benchmark, text="text"), width, size)
    found = df.withColumn("__found", _finder(files, shard_chars, width)(F.col(text)))
    return found.withColumns({"__spans": F.col("__found.spans"), "__clean": F.col("__found.clean")}).drop("__found")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    phrase_words: int = PHRASE_WORDS,
    shard_chars: int = SHARD_CHARS,
    block_phrases: int = BLOCK_PHRASES,
) -> DataFrame:
    """(doc_id, spans, n_spans, removed_chars): the documents that hold benchmark phrases.

    ``spans`` are character positions (start, end) to remove, merged and in
    order. Words are compared without case and punctuation. An item of at least
    ``phrase_words`` words is found wherever so many of its words follow each
    other, a shorter one wherever it stands whole; one of fewer than
    ``SHORT_WORDS`` words only where it begins and ends with a line.

    Null and empty texts and items match nothing, nor do those without words.
    Very long texts are searched in overlapping pieces. Rows that repeat an id
    give a row each; repeated items count once. Null ids are kept. An empty table on
    either side gives no rows. Other columns are ignored, whatever their names.
    """
    tune(docs.sparkSession)
    rows = picked(docs, doc_id="doc_id", text="text")
    found = _with_spans(rows, "text", benchmark, phrase_words, shard_chars, block_phrases)
    found = found.where(F.size("__spans") > 0).select("doc_id", F.col("__spans").alias("spans"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"]).cast("long"))
    return found.select("doc_id", "spans", F.size("spans").cast("long").alias("n_spans"), removed.alias("removed_chars"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, phrase_words: int = PHRASE_WORDS, shard_chars: int = SHARD_CHARS, block_phrases: int = BLOCK_PHRASES) -> DataFrame:
    """``docs`` without benchmark passages.

    The removal spans of :func:`contaminated` are cut out of the texts, and
    ``n_chars`` follows. A document of which no letter or digit is left goes.
    Documents without matches come out unchanged, null and empty texts, repeated
    rows and columns of any other name included; an empty table stays empty.
    """
    tune(docs.sparkSession)
    names = docs.columns
    text = f"__c{names.index('text')}"
    now = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    now = _with_spans(now, text, benchmark, phrase_words, shard_chars, block_phrases)
    now = now.where(F.col("__clean").isNull() | F.col("__clean").rlike(r"[\p{L}\p{N}]")).withColumn(text, F.coalesce("__clean", text))
    cut_now = F.col("__clean").isNotNull()
    out = [F.when(cut_now, F.length(text)).otherwise(F.col(f"__c{i}")).cast(docs.schema[i].dataType).alias(n) if n == "n_chars" else F.col(f"__c{i}").alias(n) for i, n in enumerate(names)]
    return now.select(*out)
