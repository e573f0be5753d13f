import math
import random
import time
import tracemalloc
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from inkwell.functions.text import ngrams
from inkwell.operators import ngrams as ng
from inkwell.operators import words as w
from inkwell.plans import api
from inkwell.plans.options import WordOptions
from inkwell.plans.queries import QUERIES
from inkwell.streaming import streams

TEXT = ["人工知能と機械学習の研究が進んでいます。", "深層学習を用いた自然言語処理技術の開発が行われています。", "人工知能研究開発者が集まるカンファレンスが開催されました。"]


def lines_frame(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "pos long, line string")


def brute_pmi(lines, n, min_freq):
    counts = Counter(x[i : i + n] for line in lines for x in line.split("\n") for i in range(len(x) - n + 1))
    total = sum(counts.values())
    comp = Counter()
    for g, c in counts.items():
        if c >= min_freq:
            for ch in g:
                comp[ch] += c
    return {g: (math.log2((c / total) / math.prod(comp[ch] / total for ch in g)) if n > 1 else float(c), c) for g, c in counts.items() if c >= min_freq}


def test_pmi_against_brute_force(spark):
    rng = random.Random(3)
    lines = ["".join(rng.choice("abcé学😀 \t") for _ in range(rng.randrange(0, 30))) for _ in range(200)] + ["", "x", "aa\nbb"]
    for n in (1, 2, 3):
        got = {r["ngram"]: (r["pmi"], r["frequency"]) for r in ng.pmi(lines_frame(spark, lines), n, 100_000, 2).collect()}
        want = brute_pmi(lines, n, 2)
        assert got.keys() == want.keys()
        assert all(abs(got[g][0] - want[g][0]) < 1e-9 and got[g][1] == want[g][1] for g in want)
    want = Counter(x[i : i + 4] for line in lines for x in line.split("\n") for i in range(len(x) - 3))
    assert {r["ngram"]: r["frequency"] for r in ng.ngram_counts(lines_frame(spark, lines), 4).collect()} == dict(want)


def test_long_lines_are_walked_once(spark):
    """Windows of a line of 300,000 characters: a substring that counts from the start took minutes."""
    line = "aé学😀b" * 60_000
    began = time.monotonic()
    row = spark.createDataFrame([(line,)], "line string").select(F.size(ngrams(F.col("line"), 3)).alias("n"), F.hash(ngrams(F.col("line"), 3)).alias("h"), F.slice(ngrams(F.col("line"), 3), 299_994, 10).alias("last")).first()
    assert row["n"] == 299_998 and row["last"] == [line[i : i + 3] for i in range(299_993, 299_998)]
    assert time.monotonic() - began < 30


def test_windows_of_odd_lines(spark):
    odd = ["a\nb\r\u2028c", "e\u0301e\u0301", "😀😀😀", "👨\u200d👩", "$1\\E.*", "ab", "\0\0\0\0", None]
    rows = spark.createDataFrame(list(enumerate(odd)), "i long, line string").select("i", *[ngrams(F.col("line"), n).alias(f"n{n}") for n in (1, 2, 3, 5)]).orderBy("i").collect()
    for r, line in zip(rows, odd):
        for n in (1, 2, 3, 5):
            assert r[f"n{n}"] == [line[i : i + n] for i in range(len(line) - n + 1)] if line else r[f"n{n}"] == []


def test_tasks_hold_little_and_count_all(spark, monkeypatch):
    """Pieces and sums far smaller than the input, in every combination of batch, piece and sum."""
    rng = random.Random(8)
    lines = ["".join(rng.choice("abcdé学😀") for _ in range(rng.randrange(0, 40))) for _ in range(700)] + ["x" * 5_000, "", "aa\nbb"]
    want = Counter(x[i : i + 3] for line in lines for x in line.split("\n") for i in range(len(x) - 2))
    for piece, rows, held in ((1, 1, 1), (100, 7, 50), (1 << 18, 1_000, 500_000)):
        monkeypatch.setattr(ng, "_PIECE", piece)
        monkeypatch.setattr(ng, "_ROWS", rows)
        monkeypatch.setattr(ng, "_HELD", held)
        assert {r["ngram"]: r["frequency"] for r in ng.ngram_counts(lines_frame(spark, lines).coalesce(1), 3).collect()} == dict(want)


def test_pieces_do_not_list_a_whole_batch():
    """A batch of 20,000 rows: what is held as strings at a time is bounded by rows and characters, and nothing is left out."""
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i:0100d}" for i in range(20_000)])], names=["line"])
    tracemalloc.start()
    n = chars = 0
    for piece in ng._pieces(iter([batch])):
        n, chars = n + len(piece), max(chars, sum(map(len, piece)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 20_000 and chars <= ng._PIECE + 100 and peak < 1_500_000


def test_pmi_of_nothing(spark):
    assert ng.pmi(lines_frame(spark, []), 2).count() == 0
    assert ng.ngram_counts(lines_frame(spark, ["a", ""]), 2).count() == 0


def test_lookup(spark):
    rows = spark.createDataFrame([("hello", 1), ("help", 2), ("helicopter", 3), ("world", 4), ("word", 5), ("help", 9)], "ngram string, pos long")
    last = ng.last_written(rows)
    assert last.count() == 5 and last.where("ngram = 'help'").first()["pos"] == 9
    assert ng.with_prefix(last, "hel").count() == 3
    assert [r["ngram"] for r in ng.with_suffix(last, "ld").collect()] == ["world"]
    assert ng.with_prefix(last, "xyz").count() == 0
    assert ng.prefix_tree_nodes(spark.createDataFrame([("ab",), ("ac",)], "ngram string")).first()[:] == (4, 4 * ng.NODE_BYTES)


def cands(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord long, text string, score double, frequency long")


def texts(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "seq long, text string")


def test_verification(spark):
    rows = [("機械学習", 4.8, 8), ("人工知能", 5.2, 10), ("存在しない", 3.5, 3), ("学習", 3.0, 15)]
    words = spark.createDataFrame([("人工知能",), ("辞書単語",)], "text string")
    got = {r["text"]: r for r in w.verify(cands(spark, rows), texts(spark, TEXT), words).collect()}
    assert set(got) == {"機械学習", "学習"}
    joined = "\n".join(TEXT)
    q = joined.index("機械学習")
    assert got["機械学習"]["context"] == joined[max(0, q - 20) : q + 20]
    assert got["学習"]["context_score"] == 0.2
    assert abs(got["学習"]["statistical_score"] - 0.75 * 1.1 * 1.05) < 1e-12
    off = w.verify(cands(spark, rows), texts(spark, TEXT), None, in_text=False, context=False, statistics=False)
    assert off.count() == 4 and off.agg(F.max("statistical_score"), F.max("context")).first()[:] == (0.0, "")


def test_occurrences_and_contexts_against_brute_force(spark):
    rng = random.Random(5)
    lines = ["".join(rng.choice("aab学") for _ in range(rng.randrange(0, 12))) for _ in range(300)]
    joined = "\n".join(lines)
    words = sorted({joined[i : i + n] for n in (1, 2, 3, 5) for i in range(0, len(joined) - n) if "\n" not in joined[i : i + n]})
    frame = spark.createDataFrame([(x,) for x in words], "text string")
    given = texts(spark, lines).repartition(6)
    offsets = {r["seq"]: (r["start"], r["size"]) for r in w.with_offsets(given).collect()}
    assert offsets == {i: (sum(len(x) + 1 for x in lines[:i]), len(x)) for i, x in enumerate(lines)}
    for most in (1_000_000, 7):
        found = w.occurrences_in(given, frame, most).persist()
        got = {r["text"]: (r["occurrences"], offsets[r["seq"]][0] + r["at"]) for r in found.collect()}
        assert got == {x: (joined.count(x), joined.index(x)) for x in words}
        ctx = {r["text"]: r["context"] for r in w.contexts_of(given, found, pass_words=most).collect()}
        assert ctx == {x: joined[max(0, q - 20) : q + 20] for x in words for q in [joined.index(x)]}


def test_repeats_within_words_and_long_texts(spark):
    long = "ab" * 400_000 + "aaa" * 5 + "zq"
    rows = spark.createDataFrame([(2, long), (1, "aaaa\nzq"), (3, None), (9, "")], "seq long, text string")
    words = spark.createDataFrame([("aa",), ("aba",), ("zq",), ("aaa",), ("none",), (None,)], "text string")
    got = {r["text"]: r[1:] for r in w.occurrences_in(rows, words).collect()}
    joined = "aaaa\nzq\n" + long + "\n"
    assert {k: v[0] for k, v in got.items()} == {x: joined.count(x) for x in ("aa", "aba", "zq", "aaa")}
    assert got["zq"][1:] == (1, 5) and got["aba"][1:] == (2, 0)


def test_longer_ngrams_against_brute_force(spark):
    rng = random.Random(13)
    lines = ["".join(rng.choice("ab学😀") for _ in range(rng.randrange(0, 40))) for _ in range(150)] + ["", "ab\nab", None]
    for n in (4, 5, 6, 7):
        want = Counter(x[i : i + n] for line in lines if line for x in line.split("\n") for i in range(len(x) - n + 1))
        assert {r["ngram"]: r["frequency"] for r in ng.ngram_counts(lines_frame(spark, lines), n).collect()} == dict(want)


def brute_overlaps(rows):
    order = sorted(rows, key=lambda r: -r[1])
    live = [True] * len(order)
    for i, (a, s) in enumerate(order):
        if not live[i]:
            continue
        for j, (b, t) in enumerate(order):
            if i == j or not live[j] or not (a in b or b in a):
                continue
            if s <= t:
                live[i] = False
                break
            live[j] = False
    return sorted(r for r, ok in zip(order, live) if ok)


def brute_substrings(rows):
    gone: set[str] = set()
    for y, t in sorted(rows, key=lambda r: -len(r[0].encode())):
        if y not in gone:
            gone |= {x for x, s in rows if len(x.encode()) < len(y.encode()) and x in y and s < t * 0.8}
    return sorted(r for r in rows if r[0] not in gone)


def test_pruning_against_brute_force(spark):
    rng = random.Random(7)
    for _ in range(4):
        rows = list({"".join(rng.choice("ab学") for _ in range(rng.randrange(1, 5))): float(rng.randrange(1, 9)) for _ in range(40)}.items())
        frame = cands(spark, [(t, s, 1) for t, s in rows])
        assert sorted((r["text"], r["score"]) for r in w.drop_overlaps(frame).collect()) == brute_overlaps(rows)
        assert sorted((r["text"], r["score"]) for r in w.drop_substrings(frame).collect()) == brute_substrings(rows)


def test_overlap_fixtures(spark):
    rows = [("機械学習", 5.0, 1), ("学習", 3.5, 1), ("人工知能", 4.8, 1), ("深層機械学習", 5.5, 1)]
    assert {r["text"] for r in w.drop_overlaps(cands(spark, rows)).collect()} == {"深層機械学習", "人工知能"}
    rows = [("重複語", 3.0, 1), ("重複語", 4.5, 1), ("学", 2.0, 1), ("習", 1.8, 1)]
    kept = w.drop_overlaps(cands(spark, rows)).collect()
    assert len(kept) == 3 and [r["score"] for r in kept if r["text"] == "重複語"] == [4.5]


def test_candidates_and_bounds(spark):
    scores = spark.createDataFrame([(0, "人工知能", 5.2, 10), (1, "ab", 3.0, 2), (2, "abc", 0.5, 9), (3, "cd", 3.0, 1)], "pos long, ngram string, pmi double, frequency long")
    assert [r["text"] for r in w.candidates(scores, 1.0, 3).orderBy("ord").collect()] == ["ab", "cd"]
    assert [r["text"] for r in w.candidates(scores, 1.0, 20, 2).orderBy("ord").collect()] == ["人工知能", "ab"]
    rows = [("機械学習", 4.8, 1), ("学", 3.5, 1), ("低", 2.5, 1), ("機械", 3.2, 1), ("-", 9.0, 1), ("A", 9.0, 1)]
    got = {r["text"] for r in w.prune(cands(spark, rows), 1, 10, 3.0, False, False).collect()}
    assert got == {"学", "機械", "A"}


def test_ranking(spark):
    rows = [("人工知能", 5.2, 10, 0.8, 0.7), ("機械学習", 4.8, 8, 0.9, 0.6), ("深層学習", 4.5, 7, 0.7, 0.5), ("最適長さ", 4.0, 5, 0.5, 0.4)]
    frame = spark.createDataFrame([(i, *r, "") for i, r in enumerate(rows)], "ord long, text string, score double, frequency long, context_score double, statistical_score double, context string")
    assert [r["word"] for r in w.rank(frame, 3, "pmi").orderBy("rank").collect()] == ["人工知能", "機械学習", "深層学習"]
    top = w.rank(frame, 1).first()
    assert abs(top["score"] - (0.4 * 0.52 + 0.2 * math.exp(-8) + 0.2 * 0.8 + 0.2 * 0.7)) < 1e-9


def test_extract_end_to_end(spark):
    rows = [("人工知能", 5.2, 10), ("機械学習", 4.8, 8), ("深層学習", 4.5, 7), ("自然言語", 4.2, 6), ("処理技術", 4.0, 5), ("人工知", 3.8, 4), ("知能研", 3.5, 3), ("研究開", 3.2, 2)]
    scores = spark.createDataFrame(rows, "ngram string, pmi double, frequency long")
    got = [r["word"] for r in api.extract_words(scores, texts(spark, TEXT), WordOptions(min_pmi=3.0, top_k=5)).orderBy("rank").collect()]
    assert len(got) == 5 and {"人工知能", "機械学習"} <= set(got) and "人工知" not in got
    loose = api.extract_words(scores, texts(spark, TEXT), WordOptions(verify_in_text=False, remove_overlaps=False, remove_substrings=False, top_k=10))
    assert loose.count() == 8


def test_whole_extraction_against_brute_force(spark, tmp_path):
    """The word queries over a small table of their own; more than a thousand candidates, frequencies from 3."""
    rng = random.Random(11)
    letters = "abcdefgéß" + "".join(chr(0x4E00 + i) for i in range(200))
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 5))) for _ in range(700)]
    docs = ["\n".join(" ".join(rng.choice(vocabulary) for _ in range(12)) for _ in range(4)) for _ in range(100)]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    joined = "\n".join(docs)
    scores = [(g, round(s, 6), c) for n in (2, 3) for g, (s, c) in sorted(brute_pmi(docs, n, 3).items(), key=lambda x: (-x[1][0], -x[1][1], x[0]))[:2500]]
    want = {g: (s, c) for g, s, c in scores if s >= 1.0 and len(g.encode()) <= 20}
    assert len(want) > 1000 and min(c for _, c in want.values()) == 3 and min(s for s, _ in want.values()) < 2

    def got(name, *columns):
        return [tuple(r[c] for c in columns) for r in QUERIES[name](spark, str(tmp_path)).collect()]

    count = {g: joined.count(g) for g in want}
    context = {g: joined[max(0, q - 20) : q + 20] for g in want for q in [joined.index(g)]}
    stat = {g: min(1, min(1, c / 20) * (1 + min(0.3, (len(g) - 1) * 0.1)) * (1 + min(0.2, (count[g] - 1) * 0.05))) for g, (_, c) in want.items()}
    assert dict(got("occurrence_counts", "text", "occurrences")) == count
    assert dict(got("context_window", "text", "context")) == context
    assert dict(got("context_score", "text", "context_score")) == {g: min(1, count[g] / 10) for g in want}
    found = dict(got("statistical_score", "text", "statistical_score"))
    assert found.keys() == stat.keys() and all(abs(found[g] - stat[g]) < 1e-8 for g in stat)
    stop = {g for g, c in Counter(x[i : i + 2] for d in docs for x in d.split("\n") for i in range(len(x) - 1)).items() if c % 2 == 0}
    assert sorted(got("dictionary_anti", "text", "score", "frequency")) == sorted((g, *v) for g, v in want.items() if g not in stop)
    rows = sorted((g, s) for g, (s, _) in want.items())
    assert sorted(got("substring_prune", "text", "score")) == brute_substrings(rows)
    assert sorted(got("overlap_prune", "text", "score")) == brute_overlaps(rows)

    def total(g):
        return 0.4 * min(1, want[g][0] / 10) + 0.2 * math.exp(-((len(g.encode()) - 4) ** 2) / 8) + 0.2 * min(1, count[g] / 10) + 0.2 * stat[g]

    def ranked(name, names, score):
        best = sorted(names, key=lambda g: (-round(score(g), 9), -want[g][0], g))[:1000]
        found = sorted(got(name, "rank", "word", "score", "frequency", "context"))
        assert [(r, g, c, x) for r, g, _, c, x in found] == [(i + 1, g, want[g][1], context[g]) for i, g in enumerate(best)]
        assert all(abs(s - score(g)) < 1e-5 for _, g, s, _, _ in found)

    ranked("rank_combined", want, total)
    ranked("rank_pmi", want, lambda g: want[g][0])
    sized = [(g, s) for g, s in rows if 2 <= len(g.encode()) <= 20]
    ranked("word_extract_end_to_end", [g for g, _ in brute_overlaps(brute_substrings(sized))], total)


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Hello\nhello\nabab\n\n")
    (tmp_path / "in" / "b.txt").write_text("hello\nabab\nzz\n")
    lines = streams.stream_lines(spark, str(tmp_path / "in"))
    got = streams.run_to_table(streams.distinct_stream(streams.normalized_stream(lines)))
    assert sorted(r["line"] for r in got.collect()) == ["abab", "hello", "zz"]
    seen = []
    q = streams.start_pmi(lines, 2, 1, 10, lambda df, epoch: seen.append(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert {r["ngram"]: r["frequency"] for r in seen[-1]}["ab"] == 4
    timed = lines.withColumn("ts", F.to_timestamp(F.lit("2024-01-01 00:00:10")))
    assert streams.run_to_table(streams.windowed_counts(timed, "ts", "1 minute", "1 minute"), "complete").first()["lines"] == 7


def test_stream_counts_in_the_tasks(spark, tmp_path):
    """Two batches of a stream: sums go into the state, not a row for each n-gram that occurs."""
    (tmp_path / "in").mkdir()
    parts = [["Hello", "aaaa", "é学😀x"] * 50, ["aaaa", "", "z", "hello"] * 50]
    for i, rows in enumerate(parts):
        (tmp_path / "in" / f"{i}.txt").write_text("\n".join(rows) + "\n")
    lines = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", 1).text(str(tmp_path / "in")).withColumnRenamed("value", "line")
    counts = streams.ngram_stream(lines, 2)
    assert "Generate" not in counts._jdf.queryExecution().analyzed().toString()
    want = Counter(x[i : i + 2] for rows in parts for x in rows for i in range(len(x) - 1))
    assert {r["ngram"]: r["frequency"] for r in streams.run_to_table(counts, "complete").collect()} == dict(want)
