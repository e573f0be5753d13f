"""The three operations on files, tables and buffers."""

from __future__ import annotations

import time
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import ngrams, normalize as norm, sampling, words
from inkwell.plans.options import NormalizeOptions, PmiOptions, WordOptions
from inkwell.plans.progress import Progress, Ratio, Reporter
from inkwell.runtime import written
from inkwell.sources import sinks
from inkwell.sources.text import buffer_lines, is_stdin, path_size, read_dictionary, read_lines, read_pmi


@dataclass
class Result:
    """Rows and counters of an operation; ``frame`` is its result as a table."""

    frame: DataFrame
    stats: dict[str, Any]


def _size(spark: SparkSession, path: str) -> int:
    return 0 if is_stdin(path) else path_size(spark, path)


def _timed(began: float, size: int) -> dict[str, Any]:
    spent = time.time() - began
    return {"elapsed_ms": int(spent * 1000), "mb_per_sec": size / 1e6 / max(spent, 1e-9)}


def normalize_file(spark: SparkSession, source: str, target: str, options: NormalizeOptions = NormalizeOptions(), progress: Progress | None = None, sample: int = 0, seed: int = 0, ratio: Ratio | None = None) -> Result:
    """Normalize a file's lines into a file (``-``: standard streams, ``null``: no output) in the order of first occurrence."""
    began, report = time.time(), Reporter(spark, progress, ratio, options.progress_step)
    report("reading", 0.0)
    lines = read_lines(spark, source)
    size = _size(spark, source)
    if sample:
        lines = written(sampling.sample_lines(lines, sample, seed), "sample")
    with report.during("processing", 0.05, 0.85, size):
        weights = written(norm.weighted_lines(lines, options.form.upper(), options.min_length, options.max_length), "distinct-lines")
    stats = norm.stats_of(lines, weights).first().asDict()
    done = weights.select("pos", "line")
    with report.during("writing", 0.9, 0.99, size):
        sinks.write_lines(done, target, order="pos")
    report("complete", 1.0, 1.0, size)
    return Result(done, stats | _timed(began, size) | {"sampled": bool(sample), "sample_size": sample})


def pmi_file(spark: SparkSession, source: str, target: str, options: PmiOptions = PmiOptions(), progress: Progress | None = None, ratio: Ratio | None = None) -> Result:
    """Score a file's n-grams into a table of ``ngram, pmi, frequency``."""
    began, report = time.time(), Reporter(spark, progress, ratio, options.progress_step)
    report("reading", 0.0)
    size = _size(spark, source)
    with report.during("processing", 0.05, 0.75, size):
        counts = written(ngrams.ngram_counts(read_lines(spark, source), options.n), "ngram-counts")
    grams = counts.count()
    with report.during("calculating", 0.8, 0.9, size):
        best = written(ngrams.top_ngrams(ngrams.pmi_scores(counts, options.n, options.min_freq), options.top_k).coalesce(1), "ngram-scores")
    if target != "null":
        report("writing", 0.9, 0.0, size)
        sinks.write_text(sinks.pmi_tsv(best), target)
    report("complete", 1.0, 1.0, size)
    return Result(best, {"n": options.n, "grams": grams, "distinct_ngrams": best.count()} | _timed(began, size))


def extract_stages(scores: DataFrame, texts: DataFrame, options: WordOptions = WordOptions(), dictionary: DataFrame | None = None) -> list[DataFrame]:
    """The candidates, and of these the verified, the pruned and the ranked ones."""
    found = words.candidates(scores, options.min_pmi, options.max_candidate_length, options.max_candidates)
    verified = written(words.verify(found, texts, dictionary, options.verify_in_text, options.use_context, options.use_statistics), "verified")
    pruned = words.prune(verified, options.min_length, options.max_length, options.min_score, options.remove_substrings, options.remove_overlaps, options.language_rules)
    pruned = written(pruned, "pruned")
    return [found, verified, pruned, words.rank(pruned, options.top_k, options.ranking_model, options.weights)]


def extract_words(scores: DataFrame, texts: DataFrame, options: WordOptions = WordOptions(), dictionary: DataFrame | None = None) -> DataFrame:
    """(rank, word, score, frequency, context) from scored n-grams and texts (seq, text)."""
    return extract_stages(scores, texts, options, dictionary)[-1]


def extract_words_file(spark: SparkSession, pmi_path: str, text_path: str, target: str = "null", options: WordOptions = WordOptions(), progress: Progress | None = None, ratio: Ratio | None = None) -> Result:
    """Words from a scored table and the text it came from; writes ``word, score, frequency, context``."""
    if not pmi_path or not text_path:
        raise ValueError("both input paths are needed")
    began, report = time.time(), Reporter(spark, progress, ratio)
    report("reading", 0.0)
    scores = read_pmi(spark, pmi_path, options.min_pmi)
    size = _size(spark, text_path)
    texts = norm.numbered(read_lines(spark, text_path)).selectExpr("number AS seq", "line AS text")
    dictionary = read_dictionary(spark, options.dictionary) if options.dictionary else None
    with report.during("processing", 0.1, 0.85, size):
        *before, ranked = extract_stages(scores, texts, options, dictionary)
        best = written(ranked, "words")
    if target != "null":
        report("writing", 0.9, 0.0, size)
        sinks.write_text(sinks.words_tsv(best.orderBy("rank")), target)
    memory = words.memory_estimate([*before, best]).first()["bytes"]
    report("complete", 1.0, 1.0, size)
    return Result(best, {"words_count": best.count(), "processing_time_ms": int((time.time() - began) * 1000), "memory_usage_bytes": memory})


def normalize_buffer(spark: SparkSession, data: bytes, options: NormalizeOptions = NormalizeOptions()) -> tuple[bytes, dict[str, Any]]:
    """Normalize bytes of lines. ``batch_scoped_dedup`` removes repeats only within each 1,000 lines."""
    lines = buffer_lines(spark, data)
    form, bounds = options.form.upper(), (options.min_length, options.max_length)
    if options.batch_scoped_dedup:
        done = norm.distinct_within(norm.normalized(lines, form, *bounds), F.floor(F.col("pos") / 1000))
    else:
        done = norm.normalize(lines, form, *bounds)
    out = sinks.lines_to_buffer(done)
    rows, uniques = lines.count(), out.count(b"\n")
    return out, {"rows": rows, "uniques": uniques, "duplicates": rows - uniques}


def pmi_buffer(spark: SparkSession, data: bytes, options: PmiOptions = PmiOptions()) -> tuple[bytes, dict[str, Any]]:
    """Score the n-grams of bytes of lines; the table has no header."""
    counts = written(ngrams.ngram_counts(buffer_lines(spark, data), options.n), "ngram-counts")
    best = ngrams.top_ngrams(ngrams.pmi_scores(counts, options.n, options.min_freq), options.top_k)
    rows = list(sinks.pmi_tsv(best, header=False))
    return "".join(rows).encode(), {"grams": counts.count(), "distinct_ngrams": len(rows)}
