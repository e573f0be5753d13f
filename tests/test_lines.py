import hashlib
import json
import os
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from inkwell import runtime
from inkwell.functions import text as fn
from inkwell.operators import maps, normalize as norm, sampling
from inkwell.plans import api, cli
from inkwell.plans.options import NormalizeOptions, PmiOptions, WordOptions
from inkwell.plans.progress import Reporter
from inkwell.sources import sinks
from inkwell.sources import text as src


def frame(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "pos long, line string")


def ask(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, line string").select("i", column(F.col("line")).alias("v")).orderBy("i").collect()
    return [r["v"] for r in rows]


def normalized(spark, lines, form="NFKC", **kw):
    return [r["line"] for r in norm.normalize(frame(spark, lines), form, **kw).orderBy("pos").collect()]


BASIC = ["Grüne Wiese", "grüne wiese", "GRÜNE WIESE", "Ｇｒüｎｅ　Ｗｉｅｓｅ", "#eine Bemerkung", "q", ""]


def test_basic_lines(spark):
    assert normalized(spark, BASIC) == ["grüne wiese", "#eine bemerkung"]
    assert "Grüne Wiese" in normalized(spark, BASIC, "NFC")
    s = norm.normalize_stats(frame(spark, BASIC)).first()
    assert (s["rows"], s["uniques"], s["excluded"], s["duplicates"], s["removed"]) == (7, 2, 2, 3, 5)


@pytest.mark.parametrize("form", ["NFC", "NFKC"])
def test_combining_marks_meet(spark, form):
    assert len(normalized(spark, ["café", "café", "resumé", "resumé"], form)) == 2


def test_compatibility_pairs(spark):
    for a, b in (("ﬁle", "file"), ("① number", "1 number"), ("ＡＢＣ", "abc")):
        assert len(normalized(spark, [a, b])) == 1
        assert len(normalized(spark, [a, b], "NFC")) == 2


def test_line_rules(spark):
    cases = {
        "a\t\tb": None, "\ta": None, "a\t": None, "Apple\tRed Fruit": "apple\tred fruit", "Room 12B": "Room 12B", "①Abc": "1Abc",
        "A B\tC1": "a b\tC1", "x‍y\r": "xy", "  \t ": None, "a": None, "": None, "　　": "  ", "ÉCOLE": "école", None: None,
    }
    assert ask(spark, list(cases), fn.normalized_line) == list(cases.values())


def test_emoji_only(spark):
    cases = {"😀123": True, "😀abc": False, "123": True, "!?": False, "☀ 😀": True, "©®™": True, "": False, "👍🏽‍": True, "é😀": False}
    assert ask(spark, list(cases), fn.is_emoji_only) == list(cases.values())


def test_exclusion_counts_bytes(spark):
    assert ask(spark, ["hi", "hello", "学"], lambda c: fn.is_excluded(c, 3, 10)) == [True, False, False]
    assert ask(spark, ["x" * 24, "#c", "é"], lambda c: fn.is_excluded(c, 0, 10)) == [True, False, False]
    lines = ["", "a", "ab", "normal length line", "x" * 100_000, "   \t  ", "!@#$%^&*()"]
    assert all(5 <= len(x.encode()) <= 50 for x in normalized(spark, lines, min_length=5, max_length=50))


def test_invalid_bytes_become_replacement_characters(spark):
    lines = src.buffer_lines(spark, bytes([0xFF, 0xFE, 0xFD, 0xFC, 0x80, 0x81, 0x82, 0x83]))
    assert norm.normalize(lines, "NFC").first()["line"] == "�" * 8


def test_ngrams(spark):
    for text, n, want in (("abc", 1, ["a", "b", "c"]), ("abc", 2, ["ab", "bc"]), ("abcd", 3, ["abc", "bcd"]), ("", 2, []), ("ab", 3, []), ("a😀学", 2, ["a😀", "😀学"]), (None, 1, [])):
        assert ask(spark, [text], lambda c: fn.ngrams(c, n)) == [want]
    assert ask(spark, ["abc"], lambda c: fn.ngrams(c, 0)) == [[]]


def test_hash_is_xxh64_of_seed_0(spark):
    assert ask(spark, ["abc", None, ""], fn.line_hash) == [str(xxhash.xxh64_intdigest(b"abc")), None, str(xxhash.xxh64_intdigest(b""))]


def test_occurrences_do_not_overlap(spark):
    df = spark.createDataFrame([("aaaa", "aa"), ("abcabc", "bc"), ("x", ""), ("", "a")], "t string, p string")
    assert [r[0] for r in df.select(fn.occurrences(F.col("t"), F.col("p"))).collect()] == [2, 2, 0, 0]


def test_sources_keep_carriage_returns_and_order(spark, tmp_path):
    p = tmp_path / "in.txt"
    p.write_bytes(b"one\r\ntwo\rstill two\n\nlast")
    assert [r["line"] for r in src.read_lines(spark, str(p)).orderBy("pos").collect()] == ["one\r", "two\rstill two", "", "last"]
    assert src.read_lines(spark, str(p), strip_cr=True).orderBy("pos").first()["line"] == "one"
    assert src.read_whole(spark, str(p)).first()["text"] == "one\ntwo\rstill two\n\nlast"
    chunks = src.read_chunks(spark, str(p), 7).orderBy("chunk_no").collect()
    assert b"".join(bytes(c["chunk"]) for c in chunks) == p.read_bytes() and len(chunks) == -(-len(p.read_bytes()) // 7)
    seen = []
    assert src.process_lines(str(p), seen.append) == 4 and seen == ["one", "two\rstill two", "", "last"]
    with pytest.raises(FileNotFoundError):
        src.read_lines(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("read", [1, 3, 1 << 22])
def test_whole_files_are_digested_as_streams(spark, tmp_path, monkeypatch, read):
    """Line ends, characters of several bytes and a last carriage return, wherever the reads are cut."""
    monkeypatch.setattr(src, "_READ", read)
    for name, data in (("a", "é\r\n\r\r\n学😀\rx\n\r".encode()), ("b", b""), ("c", b"\r\n" * 50)):
        (tmp_path / name).write_bytes(data)
    got = {r["path"][-1]: (r["chars"], r["md5"]) for r in src.whole_digests(spark, str(tmp_path)).collect()}
    whole = {p.name: p.read_bytes().replace(b"\r\n", b"\n") for p in tmp_path.iterdir() if p.stat().st_size}
    assert got == {k: (len(v.decode()), hashlib.md5(v).hexdigest()) for k, v in whole.items()}
    assert got == {r["path"][-1]: (len(r["text"]), hashlib.md5(r["text"].encode()).hexdigest()) for r in src.read_whole(spark, str(tmp_path)).collect()}


def test_pmi_table_source(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_text('ngram\tscore\tfreq\n人工知能\t5.2\t10\nmalformed\nno_freq\t4.5\nbad\tabc\t7\n"q\t3.0\t2\textra\nlow\t0.5\t9\nneg\t-1\t4\n')
    rows = [(r["ngram"], r["pmi"], r["frequency"]) for r in src.read_pmi(spark, str(p), 1.0).orderBy("pos").collect()]
    assert rows == [("人工知能", 5.2, 10), ('"q', 3.0, 2)]
    p.write_text("ab\t3\t4\ncd\t2e0\t5\n")
    assert src.read_pmi(spark, str(p)).count() == 2
    with pytest.raises(ValueError):
        src.read_pmi(spark, str(p), -1)
    for content in ("", "ngram\tpmi\tfrequency\n"):
        p.write_text(content)
        with pytest.raises(ValueError):
            src.read_pmi(spark, str(p))


def test_dictionary_may_be_missing(spark, tmp_path):
    assert src.read_dictionary(spark, str(tmp_path / "none")).count() == 0


def test_sampling(spark):
    lines = frame(spark, [f"line {i}" for i in range(100)])
    for k, want in ((10, 10), (20, 20), (200, 100), (0, 0)):
        assert sampling.sample_lines(lines, k, 5).count() == want
    assert sampling.sample_lines(lines, 10, 5).collect() == sampling.sample_lines(lines.repartition(7), 10, 5).collect()
    assert sampling.sample_lines(lines, 200, 5).collect() == lines.collect()


def test_maps_and_folds(spark):
    lines = frame(spark, [f"Line {i}" for i in range(1000)] + [""])
    assert maps.map_lines(lines, lambda x: x and "p:" + x).count() == 1000
    got = maps.map_batches(lines, lambda b: [x for x in b if x.endswith("0")], 50)
    assert got.count() == 100
    assert maps.reduce_column(spark.range(1, 11), "id", lambda a, b: a + b, 0) == 55
    assert maps.reduce_column(spark.range(0), "id", lambda a, b: a + b, 0) == 0
    steps = spark.sparkContext.accumulator(0)
    assert maps.for_each(lines, lambda x: None, lambda n: steps.add(n), 100) == 1001 and steps.value >= 100


def test_large_samples_are_exact(spark):
    lines = spark.range(300_000).selectExpr("id AS pos", "cast(id AS string) AS line")
    for k in (1, 777, 150_000, 299_999):
        got = sampling.sample_lines(lines, k, 9)
        assert got.count() == k and got.select("pos").distinct().count() == k
    assert sampling.sample_lines(lines, 10).count() == 10


def test_batches_of_a_thousand_lines(spark):
    lines = frame(spark, ["same", "other"] * 1_250).repartition(5)
    got = norm.normalize_batches(lines).collect()
    assert sorted((r["pos"], r["line"]) for r in got) == [(p, x) for b in (0, 1000, 2000) for p, x in ((b, "same"), (b + 1, "other"))]
    assert [r["number"] for r in norm.numbered(lines).orderBy("pos").collect()] == list(range(2_500))


def test_progress_steps_and_smoothed_time(spark):
    now, seen, ratios = [0.0], [], []
    report = Reporter(spark, seen.append, ratios.append, 0.1, lambda: now[0])
    for t, x in ((1, 0.1), (2, 0.15), (3, 0.2), (9, 0.3), (10, 0.25)):
        now[0] = t
        report("processing", x)
    report("complete", 1.0)
    assert ratios == [0.1, 0.2, 0.3, 1.0] and [s["phase"] for s in seen][-1] == "complete" and seen[-1]["phase_ratio"] == 1.0
    first, second = 9.0, 0.2 * 12 + 0.8 * 9.0
    assert [round(s["eta_s"], 6) for s in seen] == [first, round(second, 6), round(0.2 * 21 + 0.8 * second, 6), 0.0]


def test_progress_of_jobs_and_the_command_line(spark, tmp_path, capsys):
    raw = tmp_path / "raw.txt"
    raw.write_text("".join(f"line of text {i % 50}\n" for i in range(2_000)))
    seen, ratios = [], []
    done = api.normalize_file(spark, str(raw), str(tmp_path / "out.txt"), NormalizeOptions(progress_step=0.2), seen.append, ratio=ratios.append)
    assert done.stats["rows"] == 2_000 and done.stats["uniques"] == 50 and ratios == sorted(ratios) and ratios[-1] == 1.0
    assert {s["phase"] for s in seen} >= {"reading", "processing", "complete"} and seen[-1]["bytes"] == raw.stat().st_size
    cli.main(["normalize", str(raw), str(tmp_path / "o2.txt"), "--progress", "json"], spark)
    shown = [json.loads(x) for x in capsys.readouterr().err.splitlines() if x.startswith("{")]
    assert [s["progress"] for s in shown] == sorted({s["progress"] for s in shown}) and "eta" in shown[0]


def test_files_by_uri(spark, tmp_path):
    path = f"file://{tmp_path}/new/folder/out.txt"
    assert sinks.write_text((f"zeile {i}\n" for i in range(100_000)), path) == 100_000
    assert (tmp_path / "new/folder/out.txt").read_text().splitlines()[-1] == "zeile 99999"
    seen = []
    assert src.process_lines(path, seen.append) == 100_000 and seen[:2] == ["zeile 0", "zeile 1"]
    assert src.path_size(spark, path) == (tmp_path / "new/folder/out.txt").stat().st_size
    with pytest.raises(IsADirectoryError):
        sinks.write_text(["x"], f"file://{tmp_path}/new")
    assert not sinks.is_uri("C:/x") and not sinks.is_uri("/a:b/c") and sinks.is_uri("hdfs://n/x") and sinks.is_uri("s3a://b/x")


def test_batch_scoped_dedup_and_buffers(spark):
    out, stats = api.normalize_buffer(spark, b"line1\nline2\nline1\nline3\n", NormalizeOptions("NFC"))
    assert out == b"line1\nline2\nline3\n" and stats == {"rows": 4, "uniques": 3, "duplicates": 1}
    data = b"same\n" * 1500
    assert api.normalize_buffer(spark, data, NormalizeOptions(batch_scoped_dedup=True))[1]["uniques"] == 2
    assert api.normalize_buffer(spark, b"")[1] == {"rows": 0, "uniques": 0, "duplicates": 0}


def test_options_are_checked():
    for make in (
        lambda: NormalizeOptions("NFD"), lambda: NormalizeOptions(min_length=5, max_length=2), lambda: NormalizeOptions(bloom_false_positive_rate=0), lambda: NormalizeOptions(progress_step=0),
        lambda: PmiOptions(4), lambda: PmiOptions(top_k=0), lambda: PmiOptions(min_freq=0), lambda: WordOptions(min_pmi=-1), lambda: WordOptions(top_k=0),
        lambda: WordOptions(min_length=0), lambda: WordOptions(min_length=9, max_length=3), lambda: WordOptions(max_candidates=0),
    ):
        with pytest.raises(ValueError):
            make()


def test_cli_round_trip(spark, tmp_path, capsys):
    random.seed(1)
    raw, clean, table, out = (str(tmp_path / x) for x in ("raw.txt", "d/clean.txt", "pmi.tsv", "words.tsv"))
    body = ["the model learns the words", "the words teach the model", "a model of the words"]
    with open(raw, "w") as f:
        f.writelines(f"{random.choice(body)} {random.choice('abc')}\n" for _ in range(80))
    assert cli.main(["normalize", raw, clean, "--progress", "none", "--stats-json"], spark) == 0
    assert '"rows": 80' in capsys.readouterr().out
    lines = open(clean).read().splitlines()
    assert lines == list(dict.fromkeys(x.lower().rstrip("\n") for x in open(raw)))
    assert cli.main(["-q", "pmi", clean, table, "--n", "2", "--min-freq", "2", "--top", "50"], spark) == 0
    rows = open(table).read().splitlines()
    assert rows[0] == "ngram\tpmi\tfrequency" and 1 < len(rows) <= 51 and all(len(r.split("\t")) == 3 for r in rows)
    assert cli.main(["-q", "word-extract", table, clean, out], spark) == 0
    assert open(out).readline() == "word\tscore\tfrequency\tcontext\n"
    assert cli.main(["-q", "normalize", str(tmp_path / "none"), clean], spark) == 1


@pytest.mark.parametrize(("args", "code"), [(["pmi", "a", "b", "--n", "4"], 105), (["pmi", "a", "b", "--top", "0"], 105), (["pmi", "a"], 106), ([], 106), (["normalize", "a", "b", "-q"], 109), (["--version"], 0)])
def test_cli_exit_codes(args, code):
    with pytest.raises(SystemExit) as e:
        cli.main(args)
    assert e.value.code == code


def test_observed_counters(spark):
    lines, seen = maps.observed(frame(spark, ["ab", "é", ""]), "t_observed")
    lines.count()
    assert seen.get == {"lines": 3, "bytes": 7}


def test_sinks(spark, tmp_path):
    with pytest.raises(IsADirectoryError):
        sinks.write_text(["x"], str(tmp_path))
    df = spark.createDataFrame([("ab", 7.3128756, 2), ("cd", 1e-5, 3)], "ngram string, pmi double, frequency long")
    assert list(sinks.pmi_tsv(df.coalesce(1)))[1:] == ["ab\t7.31288\t2\n", "cd\t1e-05\t3\n"]
    assert sinks.escaped("a\tb\nc\\") == "a\\tb\\nc\\\\"
    ranked = spark.createDataFrame([(2, "b", 1.0, 3, "y"), (1, "a", 2.0, 4, "x")], "rank long, word string, score double, frequency long, context string")
    assert sinks.to_parallel_arrays(ranked, "rank").first()["words"] == ["a", "b"]


def _sent(spark, do):
    """What ``do`` returns, and whether it fetched rows one by one."""
    from pyspark.sql.classic.dataframe import DataFrame as Rows

    kept, used = Rows.toLocalIterator, []
    Rows.toLocalIterator = lambda self, *a, **k: used.append(1) or kept(self, *a, **k)
    try:
        return do(), bool(used)
    finally:
        Rows.toLocalIterator = kept


@pytest.mark.parametrize("place", ["shared", "plain", "uri"])
def test_ordered_files_are_written_by_the_tasks(spark, tmp_path, place):
    """In the shared folder, on a path of the driver and on a URI; an older file and its checksum go; the parts are removed."""
    root = {"shared": runtime.shared_path(spark, "t"), "plain": f"{tmp_path}/new dir", "uri": f"file://{tmp_path}/u"}[place]
    path = f"{root}/lines.txt"
    sinks.write_text(["old\n" * 1000], path if sinks.is_uri(path) else f"file://{path}")
    n = 5_000
    lines = spark.range(n).selectExpr("id AS pos", "concat('zéile ', id) AS line").repartition(7)
    assert _sent(spark, lambda: sinks.write_lines(lines, path, order="pos")) == (n, False)
    local = path.removeprefix("file://")
    assert open(local, encoding="utf-8").read() == "".join(f"zéile {i}\n" for i in range(n))
    assert [r["line"] for r in src.read_lines(spark, path).orderBy("pos").limit(2).collect()] == ["zéile 0", "zéile 1"]
    assert not [p for p in os.listdir(f"{runtime.shared_dir(spark)}/inkwell".removeprefix("file://")) if p.startswith("parts-")]
    assert sinks.write_lines(lines.where("false"), path, order="pos") == 0 and os.path.getsize(local) == 0
    with pytest.raises(IsADirectoryError):
        sinks.write_lines(lines, root, order="pos")


def test_more_parts_than_digits(spark, tmp_path):
    """Parts are put together by their number, not by their name."""
    folder = runtime.shared_path(spark, "parts")
    os.makedirs(folder)
    for i in (9, 100_000, 99_999):
        with open(f"{folder}/part-{i:05d}-x-c000.txt", "w") as f:
            f.write(f"{i}\n")
    sinks._join_parts(spark, folder, str(tmp_path / "out.txt"))
    assert (tmp_path / "out.txt").read_text() == "9\n99999\n100000\n" and not os.path.exists(folder)


def test_chunks_are_cut_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(src, "_RANGE", 64)
    (tmp_path / "a").write_bytes(bytes(range(256)) * 4 + b"end")
    (tmp_path / "b").write_bytes(b"")
    (tmp_path / "c").write_bytes(b"x" * 64)
    chunks = src.read_chunks(spark, str(tmp_path), 10)
    assert chunks.select(F.spark_partition_id()).distinct().count() > 1
    rows = chunks.orderBy("path", "chunk_no").collect()
    for name in "abc":
        own = [r for r in rows if r["path"].endswith(f"/{name}")]
        assert b"".join(bytes(r["chunk"]) for r in own) == (tmp_path / name).read_bytes()
        assert [r["chunk_no"] for r in own] == list(range(len(own))) and all(len(r["chunk"]) == 10 for r in own[:-1])
