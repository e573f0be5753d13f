"""Command line: ``python -m inkwell.plans.cli [-q] normalize|pmi|word-extract ...``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from inkwell.plans import api
from inkwell.plans.options import NormalizeOptions, PmiOptions, WordOptions
from inkwell.sources.sinks import stats_json

VERSION = "0.1.0"


def _between(low: float, high: float, kind: type):
    def parse(text: str):
        value = kind(text)
        if not low <= value <= high:
            raise argparse.ArgumentTypeError(f"must be between {low} and {high}")
        return value

    return parse


class Parser(argparse.ArgumentParser):
    """Exit codes tell what is wrong: 105 a bad value, 106 something missing, 109 something superfluous."""

    def error(self, message: str):
        missing, extra = "required" in message, "unrecognized" in message
        self.exit(106 if missing else 109 if extra else 105, f"{self.prog}: {message}\n")


def parser() -> argparse.ArgumentParser:
    top = Parser(prog="inkwell", description="Prepare text corpora and find words in them.")
    top.add_argument("-v", "--version", action="version", version=VERSION)
    top.add_argument("-q", "--quiet", action="store_true")
    commands = top.add_subparsers(dest="command", required=True)

    n = commands.add_parser("normalize", help="filter, normalize and deduplicate lines")
    n.add_argument("input")
    n.add_argument("output")
    n.add_argument("--form", type=str.upper, choices=["NFKC", "NFC"], default="NFKC")
    n.add_argument("--bloom-fp", type=_between(1e-4, 0.1, float), default=0.01)
    n.add_argument("--threads", type=int, default=0)
    n.add_argument("--min-length", type=int, default=0)
    n.add_argument("--max-length", type=int, default=0)
    n.add_argument("--sample", type=int, default=0)
    n.add_argument("--seed", type=int, default=0)

    p = commands.add_parser("pmi", help="score character n-grams")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--n", type=int, choices=[1, 2, 3], default=2)
    p.add_argument("--top", type=_between(1, 100_000, int), default=2500)
    p.add_argument("--min-freq", type=_between(1, 1000, int), default=3)
    p.add_argument("--threads", type=int, default=0)
    p.add_argument("--verbose", action="store_true")

    w = commands.add_parser("word-extract", help="find words among scored n-grams")
    w.add_argument("pmi_input")
    w.add_argument("original_text")
    w.add_argument("output")
    w.add_argument("--min-pmi", type=float, default=1.0)
    w.add_argument("--min-length", type=int, default=2)
    w.add_argument("--max-length", type=int, default=20, help="of candidates, in bytes")
    w.add_argument("--max-candidates", type=int, default=100_000)
    w.add_argument("--min-score", type=float, default=0.5)
    w.add_argument("--top", type=int, default=1000)
    w.add_argument("--no-verify", action="store_true")
    w.add_argument("--no-context", action="store_true")
    w.add_argument("--no-statistics", action="store_true")
    w.add_argument("--keep-substrings", action="store_true")
    w.add_argument("--keep-overlaps", action="store_true")
    w.add_argument("--dictionary", default="")
    w.add_argument("--ranking", default="combined")

    for c in (n, p, w):
        c.add_argument("--progress", choices=["tty", "json", "none"], default="tty")
        c.add_argument("--stats-json", action="store_true")
    return top


def _progress(kind: str):
    """Shows each new percent, with the time left."""
    last = -1

    def show(info: dict) -> None:
        nonlocal last
        percent = int(100 * info["overall_ratio"])
        if percent == last and info["phase"] != "complete":
            return
        last = percent
        if kind == "json":
            print(json.dumps(info | {"progress": percent, "eta": info["eta_s"]}), file=sys.stderr)
            return
        minutes, seconds = divmod(int(info["eta_s"]), 60)
        left = f" ETA: {f'{minutes}m ' if minutes else ''}{seconds}s" if 0 < info["overall_ratio"] < 1 else ""
        print(f"\r{info['phase']}: {percent} %{left}", end="\n" if info["phase"] == "complete" else "", file=sys.stderr, flush=True)

    return None if kind == "none" else show


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("inkwell").getOrCreate()
    show = _progress("none" if a.quiet else a.progress)
    try:
        if a.command == "normalize":
            options = NormalizeOptions(a.form, a.bloom_fp, a.threads, a.min_length, a.max_length)
            names, done = {"input": a.input, "output": a.output}, api.normalize_file(spark, a.input, a.output, options, show, a.sample, a.seed)
        elif a.command == "pmi":
            options = PmiOptions(a.n, a.top, a.min_freq, a.threads, verbose=a.verbose)
            names, done = {"input": a.input, "output": a.output}, api.pmi_file(spark, a.input, a.output, options, show)
        else:
            options = WordOptions(a.min_pmi, a.max_length, a.max_candidates, not a.no_verify, not a.no_context, not a.no_statistics, a.dictionary, a.min_length, max(a.max_length, a.min_length), a.min_score, not a.keep_substrings, not a.keep_overlaps, top_k=a.top, ranking_model=a.ranking)
            names, done = {"pmi_input": a.pmi_input, "original_text": a.original_text, "output": a.output}, api.extract_words_file(spark, a.pmi_input, a.original_text, a.output, options, show)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if a.stats_json:
        print(stats_json(a.command, **names, **done.stats))
    elif not a.quiet and a.output != "-":
        print(", ".join(f"{k} {v}" for k, v in done.stats.items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
