"""Operator 9: language identification.

Sparse multinomial logistic regression on TF-IDF weights of hashed character
n-grams (one to three characters of the lower-cased words and the gaps between
them). Training is follow-the-regularised-leader (FTRL-proximal) with L1 and L2
penalties, so most weights are exactly zero, followed by temperature scaling on
held-out rows. Document frequencies are counted over the whole corpus; only the
rows that the weights are fitted on are a bounded sample.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import key_bucket, order_key, picked, tune
from inkwell.llm.words import fold_table

#: Dimensions of the hashed n-grams.
DIMS = 1 << 14
ORDERS = (1, 2, 3)
#: The most labelled documents of one language that the weights are fitted on.
TRAIN_ROWS = 1_500
EPOCHS = 3
SEED = "language-1"
_PIECE = 1 << 20
#: First bits of a seeded key by which ids are counted.
_KEY_BITS = 16


def ngram_counts(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs in the whole ``text``."""
    out = np.zeros(DIMS)
    for s in range(0, max(1, len(text)), _PIECE):
        overlap = max(ORDERS) - 1 if s else 0  # n-grams across pieces count once
        raw = np.frombuffer(text[s - overlap : s + _PIECE].encode(f"utf-32-{sys.byteorder[0]}e", "surrogatepass"), np.uint32)
        c = fold_table()[raw]
        letter = (c > 57) | ((c != 0) & (c < 48))  # digits and all else are gaps
        c = np.where(letter, c, np.uint32(32))
        for n in ORDERS:
            if len(c) < n:
                continue
            h = np.full(len(c) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            gap = np.ones(len(h), bool)
            for k in range(n):
                part = c[k : len(c) - n + 1 + k]
                h = (h ^ part) * np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(15)
                gap &= part == 32
            h = h[~gap] if n == 1 or gap.any() else h
            if overlap and n - 1 < overlap:
                lead = overlap - (n - 1)
                h = h[lead:] if not gap[:lead].any() else h[int((~gap[:lead]).sum()) :]
            out += np.bincount(h & np.uint32(DIMS - 1), minlength=DIMS)
    return out


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sparse TF-IDF row of a text: dimensions and log(1 + count) * idf, of length 1; no dimensions without letters."""
    counts = ngram_counts(text)
    at = np.flatnonzero(counts)
    return weighted(at, np.log1p(counts[at]), idf)


def weighted(at: np.ndarray, logs: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = logs * idf[at]
    return at, v / np.sqrt(v @ v) if len(at) else v


@dataclass
class Model:
    """Weights by dimension and language, most of them zero; languages in order of their names."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return np.stack([v @ self.weights[at] + self.bias for at, v in rows])

    def predict(self, texts: list[str]) -> list[tuple[str | None, float]]:
        """The language of each text and its calibrated probability."""
        if not texts or not self.languages:
            return [(None, 0.0)] * len(texts)
        rows = [features(t, self.idf) for t in texts]
        p = softmax(self.logits(rows) / self.temperature)
        best = p.argmax(axis=1)
        return [(self.languages[b], float(q[b])) if len(at) else (None, 0.0) for (at, _), q, b in zip(rows, p, best)]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = EPOCHS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with per-coordinate rates: weights (features x classes) and unpenalised biases."""
    m = DIMS + 1
    z, n, w = np.zeros((m, classes)), np.zeros((m, classes)), np.zeros((m, classes))
    strength = np.full((m, 1), l1)
    strength[-1] = 0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            at, v = np.append(at, m - 1), np.append(v, 1.0)[:, None]
            za, na = z[at], n[at]
            wa = np.where(np.abs(za) <= strength[at], 0, -(za - np.sign(za) * strength[at]) / ((beta + np.sqrt(na)) / alpha + l2))
            p = softmax((v * wa).sum(axis=0)[None])[0]
            p[y[i]] -= 1
            g = v * p
            sigma = (np.sqrt(na + g * g) - np.sqrt(na)) / alpha
            z[at] += g - sigma * wa
            n[at] += g * g
    w = np.where(np.abs(z) <= strength, 0, -(z - np.sign(z) * strength) / ((beta + np.sqrt(n)) / alpha + l2))
    return w[:-1], w[-1]


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean())

    a, b, r = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all texts each n-gram occurs, and the number of texts; tasks send one vector each, summed on the executors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, np.int64), 0
        for b in batches:
            for t in pc.fill_null(b.column(0).cast(pa.string()), "").to_pylist():
                df += ngram_counts(t) > 0
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], names=["dim", "n"])

    total = rows.select("text").mapInArrow(count, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(DIMS), 0
    for r in total:
        if r["dim"] < 0:
            n = r["n"]
        else:
            df[r["dim"]] = r["n"]
    return df, n


def _counted():
    """A function from texts to their n-grams: dimensions as 16-bit and log(1 + count) as 32-bit numbers, in bytes."""
    kind = pa.struct([("dims", pa.binary()), ("logs", pa.binary())])

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for t in pc.fill_null(batch.cast(pa.string()), "").to_pylist():
                c = ngram_counts(t)
                at = np.flatnonzero(c)
                out.append({"dims": at.astype(np.uint16).tobytes(), "logs": np.log1p(c[at]).astype(np.float32).tobytes()})
            yield pa.array(out, kind)

    return F.arrow_udf(count, "struct<dims:binary,logs:binary>").asNondeterministic()


def drawn_ids(ids: DataFrame, per_language: int, seed: str) -> DataFrame:
    """(doc_id, lang, key): the ``per_language`` distinct ids of each language that come first in a seeded order.

    The ids are counted by the first bits of their keys; only those in the first
    parts, which hold enough, are sorted.
    """
    labelled = ids.where("lang IS NOT NULL AND doc_id IS NOT NULL")
    keyed = labelled.withColumn("key", order_key(seed, F.col("doc_id")))
    part = key_bucket(F.col("key"), _KEY_BITS)
    found = keyed.select("lang", "doc_id", part.alias("part")).distinct().groupBy("lang", "part").agg(F.count(F.lit(1)).alias("ids"))
    so_far = F.sum("ids").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    wanted = found.withColumn("before", F.coalesce(so_far, F.lit(0))).where(F.col("before") < per_language).groupBy("lang").agg(F.max("part").alias("bound"))
    near = keyed.withColumn("part", part).join(F.broadcast(wanted), "lang").where("part <= bound").select("doc_id", "lang", "key").distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    return near.withColumn("nth", nth).where(F.col("nth") <= per_language).drop("nth")


def fit(docs: DataFrame, label_col: str = "lang", per_language: int = TRAIN_ROWS, seed: str = SEED) -> Model:
    """A model from at most ``per_language`` seeded rows of each language; a fifth of them set the temperature."""
    rows = picked(docs, doc_id="doc_id", text="text", lang=label_col)
    df, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 1
    drawn = rows.join(F.broadcast(drawn_ids(picked(docs, doc_id="doc_id", lang=label_col), per_language, seed)), ["doc_id", "lang"])
    drawn = drawn.select("lang", "key", "text", _counted()(F.col("text")).alias("c"))
    # texts become numbers where they are, so long ones don't reach the driver; of several texts of an id the first in order counts
    sample = drawn.groupBy("lang", "key").agg(F.min_by("c", F.coalesce("text", F.lit(""))).alias("c")).select("lang", "key", "c.*").toPandas()
    sample = sample.sort_values(["key", "lang"])
    languages = sorted(sample["lang"].unique())
    if not languages:
        return Model([], idf, np.zeros((DIMS, 0)), np.zeros(0), 1.0)
    y = sample["lang"].map({v: i for i, v in enumerate(languages)}).to_numpy()
    idf32 = idf.astype(np.float32)
    x = [weighted(np.frombuffer(at, np.uint16), np.frombuffer(c, np.float32), idf32) for at, c in zip(sample["dims"], sample["logs"])]
    del sample
    held = np.arange(len(y)) % 5 == 4
    pick = lambda mask: [x[i] for i in np.flatnonzero(mask)]
    w, b = train_ftrl(pick(~held), y[~held], len(languages))
    model = Model(languages, idf, w, b, 1.0)
    if held.any():
        model.temperature = best_temperature(model.logits(pick(held)), y[held])
    return model


def identify(docs: DataFrame, label_col: str = "lang", per_language: int = TRAIN_ROWS, seed: str = SEED) -> DataFrame:
    """(doc_id, language, confidence) for every row of ``docs``.

    ``confidence`` is the calibrated probability of ``language``. Ties go to
    the first language by name. A null or empty text, or one without letters,
    has no evidence: language is null and confidence 0. The same goes for all
    rows if no row has a label. Very long texts are counted whole, piece by piece.
    Rows that repeat an id or a text are predicted each on their own. An empty table gives no rows. Other columns are ignored,
    whatever their names.
    """
    tune(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, label_col, per_language, seed))
    kind = pa.struct([("language", pa.string()), ("confidence", pa.float64())])

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = pc.fill_null(batch.cast(pa.string()), "").to_pylist()
            yield pa.array([{"language": a, "confidence": b} for a, b in model.value.predict(texts)], kind)

    predicted = picked(docs, doc_id="doc_id", text="text").select("doc_id", F.arrow_udf(predict, "struct<language:string,confidence:double>").asNondeterministic()("text").alias("p"))
    return predicted.select("doc_id", "p.language", "p.confidence")
