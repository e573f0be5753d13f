"""Words from n-grams: candidates, verification in the text, pruning and ranking."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import is_valid_candidate
from inkwell.runtime import by_key, ship, written

#: Characters before and after the start of a word's first occurrence.
CONTEXT = 20
#: Words that a task looks for at once; more are looked for in further passes.
PASS_WORDS = 1_000_000
#: Characters of joined texts that are searched at a time.
_PIECE = 1 << 19
#: Rows of a batch that become strings at a time.
_ROWS = 500
_BITS = 22


def candidates(scores: DataFrame, min_pmi: float = 1.0, max_bytes: int = 20, max_candidates: int = 100_000) -> DataFrame:
    """(ord, text, score, frequency): n-grams above the floors, in the order of ``pos`` if there is one, else by n-gram.

    If there are more than ``max_candidates``, the best by score stay, best first.
    """
    order = "pos" if "pos" in scores.columns else "ngram"
    kept = scores.where((F.col("pmi") >= min_pmi) & (F.octet_length("ngram") <= max_bytes))
    rows = kept.select(F.col(order).alias("ord"), F.col("ngram").alias("text"), F.col("pmi").alias("score"), "frequency")
    rows = written(rows, "candidates")
    if rows.count() <= max_candidates:
        return rows
    best = rows.orderBy(F.desc("score"), "ord").limit(max_candidates)
    return best.withColumn("n", F.row_number().over(Window.orderBy(F.desc("score"), "ord"))).select(F.col("n").alias("ord"), "text", "score", "frequency")


def with_offsets(texts: DataFrame, seq: str = "seq", text: str = "text") -> DataFrame:
    """(seq, start, size): where each text begins in all texts joined by line feeds in the order of ``seq``, and its characters.

    The texts themselves aren't moved. Sums run over ranges of ``seq``, so no task sees the whole table.
    """
    sizes = texts.where(F.col(text).isNotNull()).select(F.col(seq).cast("long").alias("seq"), F.length(text).cast("long").alias("size"))
    rows = written(sizes.repartitionByRange("seq").withColumn("part", F.spark_partition_id()), "sizes")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("part").agg(F.sum(F.col("size") + 1).alias("s")).select("part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return by_key(rows, sums, "part").select("seq", (F.col("base") + F.coalesce(F.sum(F.col("size") + 1).over(inside), F.lit(0))).alias("start"), "size")


def _windows(points: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every window of ``n`` code points."""
    size = len(points) - n + 1
    h = np.full(max(size, 0), n, np.uint64)
    for k in range(n):
        h = (h ^ points[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(f"utf-32-{sys.byteorder[0]}e", "surrogatepass"), np.uint32).astype(np.uint64)


def _has_border(word: str) -> bool:
    return any(word[:k] == word[-k:] for k in range(1, len(word)))


class Finder:
    """Find many words in texts at once: windows of each length are hashed and looked up, first in a table of bits."""

    def __init__(self, words: list[str]):
        self.words = sorted({w for w in words if w})
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        lengths = np.array([len(w) for w in self.words], np.int64)
        for n in np.unique(lengths):
            which = np.flatnonzero(lengths == n)
            h = np.array([_windows(_points(self.words[i]), int(n))[0] for i in which], np.uint64)
            o = np.argsort(h)
            bits = np.zeros(1 << _BITS, bool)
            bits[h >> np.uint64(64 - _BITS)] = True
            self.by_length[int(n)] = (h[o], which[o], bits)
        self.overlapping = np.array([_has_border(w) for w in self.words], bool)

    def find(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word numbers, positions) of the occurrences that don't overlap others of the same word, for each length."""
        points = _points(text)
        for n, (hashes, which, bits) in self.by_length.items():
            h = _windows(points, n)
            place = np.flatnonzero(bits[h >> np.uint64(64 - _BITS)])
            h = h[place]
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[at] == h
            place, word = place[hit], which[at[hit]]
            if not len(place):
                continue
            o = np.argsort(word, kind="stable")
            word, place = word[o], place[o]
            # one begins within the one before: only then there is something to leave out
            close = np.flatnonzero((word[1:] == word[:-1]) & (place[1:] - place[:-1] < n))
            if len(close):
                keep = np.ones(len(word), bool)
                for w in np.unique(word[close]):
                    lo, hi = np.searchsorted(word, [w, w + 1])
                    end = -1
                    for i, p in enumerate(place[lo:hi].tolist(), lo):
                        keep[i] = p >= end
                        end = p + n if p >= end else end
                word, place = word[keep], place[keep]
            yield word, place


def _passes(words: DataFrame, size: int) -> Iterator[DataFrame]:
    """``words`` (text, ...) in parts of about ``size`` rows."""
    n = words.count()
    parts = max(1, -(-n // size))
    for i in range(parts):
        yield words.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == i) if parts > 1 else words


def occurrences_in(texts: DataFrame, words: DataFrame, pass_words: int = PASS_WORDS) -> DataFrame:
    """(text, occurrences, seq, at): for the words that occur, their non-overlapping occurrences, and the text and place of the first.

    Words hold no line feed, so counting in each of the ``texts`` (seq, text) gives
    the counts of the joined text. ``seq`` tells the texts' order and is unique.
    """
    spark = texts.sparkSession
    ship(spark)
    distinct = written(words.select("text").where("text IS NOT NULL AND text <> ''").distinct(), "words")
    rows = texts.where("text IS NOT NULL").select(F.col("seq").cast("long").alias("seq"), "text")

    def counted(part: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(Finder([r[0] for r in part.collect()]))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f = shared.value
            count = np.zeros(len(f.words), np.int64)
            seq, at = np.full(len(f.words), _LAST), np.full(len(f.words), _LAST)
            for part in (b.slice(s, _ROWS) for b in batches for s in range(0, b.num_rows, _ROWS)):
                all_texts, all_seq = part.column("text").to_pylist(), part.column("seq").to_numpy()
                sizes = np.array([len(t) + 1 for t in all_texts], np.int64)
                cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // _PIECE, prepend=0))
                for lo, hi in zip([0, *cuts], [*cuts, len(sizes)]):
                    if lo == hi:
                        continue
                    begin = np.cumsum(sizes[lo:hi]) - sizes[lo:hi]
                    for word, place in f.find("\n".join(all_texts[lo:hi])):
                        count += np.bincount(word, minlength=len(count))
                        owner = np.searchsorted(begin, place, side="right") - 1
                        s, p = all_seq[lo:hi][owner], place - begin[owner]
                        o = np.lexsort((p, s, word))
                        o = o[np.concatenate([[True], word[o][1:] != word[o][:-1]])]
                        w, s, p = word[o], s[o], p[o]
                        better = (s < seq[w]) | ((s == seq[w]) & (p < at[w]))
                        seq[w[better]], at[w[better]] = s[better], p[better]
            got = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array([f.words[i] for i in got], pa.string()), *(pa.array(x[got]) for x in (count, seq, at))], names=["text", "n", "seq", "at"])

        return rows.mapInArrow(find, "text string, n long, seq long, at long")

    found = reduce(DataFrame.union, [counted(p) for p in _passes(distinct, pass_words)])
    return found.groupBy("text").agg(F.sum("n").alias("occurrences"), F.min(F.struct("seq", "at")).alias("first")).select("text", "occurrences", "first.*")


_LAST = np.iinfo(np.int64).max


def contexts_of(texts: DataFrame, found: DataFrame, reach: int = CONTEXT, pass_words: int = PASS_WORDS) -> DataFrame:
    """(text, context): the characters from ``reach`` before to ``reach`` after each first place of :func:`occurrences_in`, across texts."""
    spark = texts.sparkSession
    ship(spark)
    offsets = written(with_offsets(texts), "offsets")
    total = offsets.agg(F.max(F.col("start") + F.col("size"))).first()[0] or 0  # no line feed follows the last text
    spots = written(by_key(offsets.select("seq", "start"), found.select("text", "seq", "at"), "seq").select("text", (F.col("start") + F.col("at")).alias("first")), "spots")

    def located(part: DataFrame) -> DataFrame:
        spans = sorted((max(0, r["first"] - reach), min(total, r["first"] + reach), r["text"]) for r in part.collect())
        shared = spark.sparkContext.broadcast((np.array([s[0] for s in spans], np.int64), np.array([s[1] for s in spans], np.int64), [s[2] for s in spans]))

        def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, b, names = shared.value  # both in order
            for batch in batches:
                seq, start, size = (batch.column(c).to_numpy() for c in ("seq", "start", "size"))
                end = start + size + 1
                lo, hi = np.searchsorted(b, start, side="right"), np.searchsorted(a, end, side="left")
                n = np.maximum(0, hi - lo)
                row = np.repeat(np.arange(len(n)), n)
                span = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + lo[row]
                begin, stop = np.maximum(a[span], start[row]) - start[row], np.minimum(b[span], end[row]) - start[row]
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in span], pa.string()), pa.array(seq[row]), pa.array(start[row]), pa.array(begin), pa.array(stop - begin)], names=["word", "seq", "start", "begin", "n"])

        return offsets.mapInArrow(locate, "word string, seq long, start long, begin long, n long")

    pieces = written(reduce(DataFrame.union, [located(p) for p in _passes(spots, pass_words)]), "pieces")
    rows = texts.where("text IS NOT NULL").select(F.col("seq").cast("long").alias("seq"), "text")
    piece = F.substring(F.concat("text", F.lit("\n")), (F.col("begin") + 1).cast("int"), F.col("n").cast("int"))
    parts = by_key(rows, pieces, "seq").select("word", "start", piece.alias("piece"))
    joined = parts.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("p"))
    return joined.select(F.col("word").alias("text"), F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("context"))


def context_score(occurrences):
    return F.least(F.lit(1.0), occurrences / F.lit(10.0))


def statistical_score(text, frequency, occurrences):
    """Frequency evidence with bonuses for length in characters and for repeated occurrence, at most 1."""
    by_length = 1 + F.least(F.lit(0.3), (F.length(text) - 1) * F.lit(0.1))
    by_count = F.when(occurrences > 1, 1 + F.least(F.lit(0.2), (occurrences - 1) * F.lit(0.05))).otherwise(F.lit(1.0))
    return F.when(frequency == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.least(F.lit(1.0), frequency / F.lit(20.0)) * by_length * by_count))


def verify(
    cands: DataFrame,
    texts: DataFrame,
    dictionary: DataFrame | None = None,
    in_text: bool = True,
    context: bool = True,
    statistics: bool = True,
) -> DataFrame:
    """(ord, text, score, frequency, verified, context, context_score, statistical_score).

    With ``in_text`` only candidates that occur in the texts (seq, text) stay.
    Words of the dictionary are dropped.
    """
    found = written(occurrences_in(texts, cands), "occurrences")
    rows = cands.join(found, "text", "inner" if in_text else "left")
    rows = rows.withColumn("occurrences", F.coalesce("occurrences", F.lit(0)))
    if context:
        rows = rows.join(contexts_of(texts, found), "text", "left").withColumn("context", F.coalesce("context", F.lit("")))
    else:
        rows = rows.withColumn("context", F.lit(""))
    score = context_score(F.col("occurrences")) if context else F.lit(0.0)
    stat = statistical_score(F.col("text"), F.col("frequency"), F.col("occurrences")) if statistics else F.lit(0.0)
    if dictionary is not None:
        rows = rows.join(dictionary.select("text").distinct(), "text", "left_anti")
    return rows.select("ord", "text", "score", "frequency", F.lit(True).alias("verified"), "context", score.alias("context_score"), stat.alias("statistical_score"))


def _substrings(text: str):
    """All shorter substrings that aren't empty."""
    n = F.length(text)
    return F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(F.col(text), i, size))))


def drop_substrings(rows: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Drop a candidate that a longer one holds whose score, times ``ratio``, is above its own.

    Candidates are at most some dozen bytes long, so all their substrings are
    listed and joined by equality. Of repeated texts the best score counts.
    """
    longer = rows.where(F.length("text") > 1).select(F.explode(F.array_distinct(_substrings("text"))).alias("text"), "score")
    bound = longer.groupBy("text").agg((F.max("score") * ratio).alias("bound"))
    own = rows.groupBy("text").agg(F.max("score").alias("own"))
    gone = own.join(bound, "text").where("own < bound").select("text")
    return rows.join(gone, "text", "left_anti")


def drop_overlaps(rows: DataFrame) -> DataFrame:
    """Resolve overlaps (equal texts, or one within the other) greedily by score, best first.

    A candidate stays if it overlaps none that stands with a higher score, nor a
    later one of the same score among those that are still in the running.
    The edges come from an equality join of substrings; the greedy pass runs
    over the bounded list of candidates in one task.
    """
    numbered = written(rows.withColumn("id", F.row_number().over(Window.orderBy(F.desc("score"), "ord", "text"))), "numbered")
    inner = numbered.where(F.length("text") > 1).select(F.col("id").alias("a"), F.explode(F.array_distinct(_substrings("text"))).alias("text"))
    within = inner.join(numbered.select("text", F.col("id").alias("b")), "text").select("a", "b")
    same = numbered.select("text", F.col("id").alias("a")).join(numbered.select("text", F.col("id").alias("b")), "text").where("a < b").select("a", "b")
    edges = within.union(same).groupBy(F.col("a").alias("id")).agg(F.collect_list("b").alias("near"))
    graph = numbered.select("id", "score").join(edges, "id", "left").withColumn("one", F.lit(1))

    def resolve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        near: dict[int, set[int]] = {int(i): set() for i in g["id"]}
        for i, others in zip(g["id"], g["near"]):
            for j in others if others is not None else ():
                near[int(i)].add(int(j))
                near[int(j)].add(int(i))
        kept: set[int] = set()
        for _, level in g.groupby("score", sort=False):
            live = [int(i) for i in level["id"] if not near[int(i)] & kept]
            alive = set(live)
            kept |= {i for i in live if not any(j > i for j in near[i] & alive)}
        return pd.DataFrame({"id": sorted(kept)})

    survivors = graph.groupBy("one").applyInPandas(resolve, "id long")
    return numbered.join(survivors, "id").withColumn("ord", F.col("id")).drop("id")


def prune(rows: DataFrame, min_length: int = 2, max_length: int = 20, min_score: float = 0.5, substrings: bool = True, overlaps: bool = True, language: bool = True) -> DataFrame:
    """Bounds in bytes, the score floor, substrings, overlaps and validity, in this order."""
    rows = rows.where(F.octet_length("text").between(min_length, max_length)).where(F.col("score") >= min_score)
    if substrings:
        rows = drop_substrings(rows)
    if overlaps:
        rows = drop_overlaps(rows)
    return rows.where(is_valid_candidate(F.col("text"))) if language else rows


def rank(rows: DataFrame, top_k: int = 1000, model: str = "combined", weights: tuple[float, float, float, float] = (0.4, 0.2, 0.2, 0.2)) -> DataFrame:
    """(rank, word, score, frequency, context): the best words; any model but ``combined`` ranks by PMI."""
    size = F.octet_length("text")
    length = F.exp(-F.pow(size - 4, F.lit(2)) / 8)
    parts = (F.least(F.lit(1.0), F.col("score") / 10), length, F.col("context_score"), F.col("statistical_score"))
    total = F.col("score")
    if model == "combined":
        total = sum((F.lit(float(w)) * p for w, p in zip(weights[1:], parts[1:])), F.lit(float(weights[0])) * parts[0])
    order = [F.desc(F.round("total", 9)), F.desc("score"), F.col("ord"), F.col("text")]
    best = rows.withColumn("total", total).orderBy(*order).limit(top_k)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return ranked.select("rank", F.col("text").alias("word"), F.col("total").alias("score"), "frequency", "context")


#: Bytes of a row besides its texts: numbers, lengths and pointers.
ROW_BYTES = 64


def memory_estimate(stages: list[DataFrame]) -> DataFrame:
    """One row (bytes): the texts (or words) and contexts of all stages' rows, and ``ROW_BYTES`` for each row."""
    sizes = []
    for s in stages:
        texts = [c for c in ("text", "word", "context") if c in s.columns]
        sizes.append(s.select(sum((F.octet_length(c) for c in texts), F.lit(ROW_BYTES)).alias("n")))
    return reduce(DataFrame.union, sizes).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("bytes"))
