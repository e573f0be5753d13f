"""Operator 6: a quality classifier of histogram gradient-boosted trees over document statistics.

Statistics are computed from whole texts with array operations; the trees
(:mod:`gbdt`) are trained on a bounded, seeded sample of labelled documents and
sent to the tasks as flat arrays, which score all documents of a batch together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import order_key, picked, tune
from inkwell.llm.gbdt import Forest, train
from inkwell.llm.words import code_points, fold_table, pieces, split_words

#: The most labelled documents that the trees are fitted on.
TRAIN_ROWS = 8_000
SEED = "quality-1"
#: Characters whose statistics are computed at a time, so that their arrays stay in the cache; a longer text is one piece.
PIECE_CHARS = 200_000
#: Documents with less than this probability of good quality are rejected.
THRESHOLD = 0.5

FEATURES = (
    "log_chars", "log_words", "mean_word", "long_words", "letter_share", "upper_share", "digit_share", "space_share",
    "mark_share", "symbol_share", "stop_share", "comma_share", "upper_words", "mark_ended", "type_share", "log_type",
    "repeat_word", "repeat_pair", "type_pair", "top_word", "log_lines", "mean_line", "repeat_line", "marks_per_word",
    "pipe_share", "non_ascii", "short_words", "max_word",
)


#: Sets of characters that are counted, by name.
_SETS = {"digit": "0123456789", "space": " \t\r\n", "symbol": "#$%&*+<=>@^_`|~{}[]\\/", "stop": ".!?", "comma": ",;:", "pipe": "|"}
_COUNTED = ("inside", "upper", "digit", "space", "mark", "symbol", "stop", "comma", "pipe", "wide")


@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of each code point, and for each class which of ``_COUNTED`` it counts for."""
    fold = fold_table()
    cp = np.arange(len(fold), dtype=np.uint32)
    inside = fold != 0
    is_ = {name: np.isin(cp, [ord(c) for c in chars]) for name, chars in _SETS.items()}
    is_ |= {"inside": inside, "upper": inside & (fold != cp), "mark": ~inside & ~is_["space"], "wide": cp > 127}
    code = sum(is_[name].astype(np.uint16) << k for k, name in enumerate(_COUNTED))
    kinds, of = np.unique(code, return_inverse=True)
    return of.astype(np.uint8), (kinds[:, None] >> np.arange(len(_COUNTED)) & 1).astype(np.float64)


def _by_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``starts``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]


def _distinct(owner: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each owner, how many distinct values it has and how often the most frequent occurs."""
    if not len(values):
        return np.zeros(n), np.zeros(n)
    low = (values >> np.uint64(20)) | (owner.astype(np.uint64) << np.uint64(44))
    low.sort()
    new = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    runs = np.diff(np.append(new, len(low)))
    who = (low[new] >> np.uint64(44)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, who, runs)
    return np.bincount(who, minlength=n).astype(float), top


def statistics(texts: list[str]) -> np.ndarray:
    """One row of ``FEATURES`` for each text; a text without characters or words has zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    for lo, hi in pieces(texts, PIECE_CHARS):
        out[lo:hi] = _statistics(texts[lo:hi])
    return out


def _statistics(texts: list[str]) -> np.ndarray:
    n = len(texts)
    points, starts = code_points(texts)
    w = split_words(texts)
    chars = (np.diff(starts) - 1).astype(float)
    words = np.diff(w.first).astype(float)
    of, counts_for = _classes()
    kinds = len(counts_for)
    cell = np.repeat(np.arange(n, dtype=np.int64) * kinds, np.diff(starts))
    cell += of[points]
    count = dict(zip(_COUNTED, (np.bincount(cell, minlength=n * kinds).reshape(n, kinds) @ counts_for).T))
    length = (w.end - w.begin).astype(float)
    per_word = lambda v: _by_text(v, w.first)
    owner = np.repeat(np.arange(n), np.diff(w.first))
    begins = points[w.begin]
    first_upper = fold_table()[begins] != begins
    after = points[np.minimum(w.end, len(points) - 1)] if len(w.end) else np.zeros(0, points.dtype)
    types, top = _distinct(owner, w.hashes, n)
    same_next = np.zeros(len(w.hashes))
    pair_owner, pair = owner[:0], w.hashes[:0]
    if len(w.hashes) > 1:
        together = owner[1:] == owner[:-1]
        same_next[1:] = together & (w.hashes[1:] == w.hashes[:-1])
        pair_owner = owner[1:][together]
        pair = (w.hashes[1:] * np.uint64(31) + w.hashes[:-1] * np.uint64(0x9E3779B97F4A7C15))[together]
    pairs, _ = _distinct(pair_owner, pair, n)
    n_pairs = np.maximum(words - 1, 1)
    lines = np.array([t.count("\n") + 1 for t in texts], float)
    line_types = np.array([len(set(t.split("\n"))) for t in texts], float)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    c, k = np.maximum(chars, 1), np.maximum(words, 1)
    return np.stack(
        [
            np.log1p(chars), np.log1p(words), per_word(length) / k, per_word(length > 12) / k, count["inside"] / c,
            count["upper"] / c, count["digit"] / c, count["space"] / c, count["mark"] / c,
            count["symbol"] / c, count["stop"] / c, count["comma"] / c,
            per_word(first_upper) / k, per_word(np.isin(after, [ord(x) for x in "#$%&*!|"])) / k, types / k,
            np.where(words > 1, np.log1p(types) / np.log1p(np.maximum(words, 1)), 0), per_word(same_next) / k,
            np.where(words > 1, 1 - pairs / n_pairs, 0), pairs / k, top / k, np.log1p(lines), chars / np.maximum(lines, 1),
            1 - line_types / np.maximum(lines, 1), count["mark"] / k, count["pipe"] / c, count["wide"] / c,
            per_word(length <= 2) / k, np.minimum(longest, 60),
        ],
        axis=1,
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, seed: str) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``rows`` labelled documents, the same ones whatever the partitions.

    Ids are sampled before their texts are read, and the texts become
    statistics where they are, so the driver gets a row of numbers for each. Of
    several labels of an id the lowest counts, of several texts the first in
    order; null labels and ids aren't used.
    """
    good = picked(labels, doc_id="doc_id", quality="quality").where("doc_id IS NOT NULL AND quality IS NOT NULL")
    good = good.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    have = picked(docs, doc_id="doc_id", text="text")
    # no more than ``rows`` ids are drawn from those that the documents hold
    ids = good.join(have.select("doc_id"), "doc_id", "left_semi").orderBy(order_key(seed, F.col("doc_id"))).limit(rows)
    drawn = have.join(F.broadcast(ids), "doc_id").select("doc_id", "quality", F.col("text"), _measure()(F.col("text")).alias("x"))
    one = drawn.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min_by("x", F.coalesce("text", F.lit(""))).alias("x"))
    sample = one.toPandas().sort_values("doc_id")
    x = np.stack(sample["x"].to_numpy()) if len(sample) else np.zeros((0, len(FEATURES)))
    return x, sample["quality"].to_numpy(dtype=float)


def _measure():
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = statistics(pc.fill_null(batch.cast(pa.string()), "").to_pylist())
            ends = np.arange(0, x.size + 1, x.shape[1])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.ravel(), pa.float64()))

    return F.arrow_udf(measure, "array<double>").asNondeterministic()


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, seed: str = SEED) -> Forest:
    """Trees for the probability that a document's quality is 1, from at most ``rows`` labelled documents.

    Without any labelled document every probability is 1, so nothing is rejected.
    """
    x, y = labelled_sample(docs, labels, rows, seed)
    if not len(y):
        none = np.zeros(1, np.int64)
        return Forest(none, np.array([np.inf]), none, none, np.zeros(1), none, 0, 50.0)
    return train(x, (y > 0).astype(float))


def _scorer(docs: DataFrame, forest: Forest):
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = pc.fill_null(batch.cast(pa.string()), "").to_pylist()
            yield pa.array(shared.value.probability(statistics(texts)) if texts else [], pa.float64())

    return F.arrow_udf(score, "double").asNondeterministic()


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS, seed: str = SEED) -> DataFrame:
    """(doc_id, score, keep) for every row of ``docs``.

    ``score`` is the probability of good quality, ``keep`` whether it reaches
    ``threshold``. A null text is scored as an empty one, texts without words by
    their zero statistics, and very long texts by statistics of the whole text. Rows that repeat an id or a text get equal
    scores for equal texts. Without labels all is kept. An empty table gives no
    rows. Other columns are ignored, whatever their names.
    """
    tune(docs.sparkSession)
    forest = fit(docs, labels, rows, seed)
    scored = picked(docs, doc_id="doc_id", text="text").select("doc_id", _scorer(docs, forest)(F.col("text")).alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, unchanged.

    Null, empty and very long texts, repeated rows and missing labels are scored as
    by :func:`score_quality`. Null ids are kept. An empty table stays empty;
    columns of any other name are kept.
    """
    tune(docs.sparkSession)
    forest = fit(docs, labels, rows, seed)
    names = docs.columns
    raw = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    scored = raw.withColumn("__score", _scorer(docs, forest)(F.col(f"__c{names.index('text')}")))
    return scored.where(F.col("__score") >= threshold).select(*[F.col(f"__c{i}").alias(n) for i, n in enumerate(names)])
