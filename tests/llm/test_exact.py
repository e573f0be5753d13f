"""Operators whose results are held against brute force or SQL on small tables."""

import gzip
import hashlib
import io
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from inkwell.llm import common, components as comp, decontaminate as dc, fmindex, license_scan, line_dedup, minhash as mh, mixing, pivots, sharding, warc, words
from inkwell.llm.license_rules import RULES
from inkwell.llm.oracles import ORACLES
from inkwell.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    """rows: (doc_id, text[, lang[, source]])"""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src1", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOCS)


def clashing(df):
    """``df`` with extra columns of names that operators use themselves or that clash but for their case."""
    for name in ("text2", "key", "__key", "row", "bucket", "TEXTS", "spans", "score", "node", "root", "h", "drop", "position", "domain", "a.b"):
        df = df.withColumn(name, F.lit("x"))
    return df


def odd_rows(spark):
    long = "lorem ipsum dolor sit amet " * 20_000
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (4, long), (None, "a null id here"), (None, None), (5, "ß İ \U0001f600"), (6, "same text"), (6, "same text"), (6, "other text"), (7, "x\n\n\nx", None, None)]
    return docs_of(spark, rows)


def sql(query, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    return con.sql(query).fetchall()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# words and the FM-index


def test_words_are_folded_runs_of_letters_and_digits():
    texts = ["Hello, WORLD_42", "", "ÉCOLE école", "x" * 5000, "İ a", "  "]
    w = words.split_words(texts)
    assert np.diff(w.first).tolist() == [3, 0, 2, 1, 2, 0]
    assert w.hashes[3] == w.hashes[4] and w.hashes[0] != w.hashes[1]
    joined = "\n".join(texts) + "\n"
    assert [joined[a:b] for a, b in zip(w.begin[:3], w.end[:3])] == ["Hello", "WORLD", "42"]
    assert len(words.split_words([]).hashes) == 0


def test_fm_index_against_brute_force():
    rng = np.random.default_rng(0)
    for trial in range(40):
        docs = [rng.integers(1, 5, rng.integers(0, 40)).astype(np.uint64) for _ in range(rng.integers(1, 8))]
        docs = docs + docs if trial % 3 == 0 else docs
        text, first = np.concatenate(docs), np.cumsum([0] + [len(d) for d in docs])
        index = fmindex.FMIndex(text, first, int(rng.integers(1, 9)))
        for n in (1, 2, 3, 6):
            phrases = np.unique(rng.integers(1, 6, (20, n)).astype(np.uint64), axis=0)
            row, at = index.find(phrases)
            want = {(k, int(f) + i) for d, f in zip(docs, first) for i in range(len(d) - n + 1) for k, p in enumerate(phrases) if (d[i : i + n] == p).all()}
            assert set(zip(row.tolist(), at.tolist())) == want and len(row) == len(want)


def test_suffix_array_of_repeats():
    for t in ([0] * 50, [0, 1] * 40, list(range(9, -1, -1)), [3]):
        t = np.array(t, np.int64)
        assert fmindex.suffix_array(t, int(t.max()) + 1).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def brute_spans(text, items, n, least=dc.SHORT_WORDS):
    found = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W_]+", text)]
    tokens = [x[2] for x in found]
    spans = []
    for item in items:
        w = [x.lower() for x in re.findall(r"[^\W_]+", item or "")]
        k = min(n, len(w))
        for p in {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} - {()}:
            for i in range(len(tokens) - k + 1):
                if tuple(tokens[i : i + k]) == p:
                    before = text[found[i - 1][1] if i else 0 : found[i][0]]
                    after = text[found[i + k - 1][1] : found[i + k][0] if i + k < len(found) else None]
                    whole = (not i or "\n" in before) and (i + k == len(found) or "\n" in after)
                    spans += [(found[i][0], found[i + k - 1][1])] * (whole or len(w) >= least)
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("block", [200_000, 3])
def test_decontamination_against_brute_force(spark, block):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(30)]
    items = [" ".join(rng.choice(vocab) for _ in range(k)) for k in (20, 9, 7, 4, 13, 40)] + [None, "", "W1?", "w2 w3"]
    texts = []
    for i in range(120):
        body = [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        if i % 3 == 0:
            w = items[i % 6].split()
            body[len(body) // 2 : len(body) // 2] = [x.upper() + "," for x in (w if i % 2 else w[: max(1, len(w) - 3)])]
        texts.append((" " if i % 4 else "\n").join(body))
    texts += [texts[0], texts[3], "", None, items[0], items[5] + ". " + items[5], "w1", " -w1-\n", "w1 w1", "w4\nw2\nw3\nw4", "w2 w3 w3"]
    frame = clashing(docs_of(spark, list(enumerate(texts))))
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items + items[:3])], "item_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in dc.contaminated(frame, bench, 8, 2_000, block).collect()}
    want = {i: s for i, t in enumerate(texts) if t and (s := brute_spans(t, items, 8))}
    assert got == want and sum(len(texts[i].split()) < 6 for i in want) >= 3
    clean = {r["doc_id"]: r["text"] for r in dc.decontaminate(frame, bench, 8, 2_000, block).collect()}
    for i, t in enumerate(texts):
        cut = dc.cut(t, want.get(i, [])) if t is not None else None
        assert (i in clean) == (i not in want or any(x.isalnum() for x in cut))
        assert i not in clean or clean[i] == cut


def test_long_texts_are_searched_in_pieces():
    rng = random.Random(9)
    text = "".join(rng.choice("abc") * rng.randrange(1, 4) + rng.choice("   \n") for _ in range(3000)) + "z" * 900 + " tail a b"
    items = [text[500:560].strip(), text[2000:2100].strip(), "z" * 900 + " tail a b", "nothing of this kind here", "ab", "bb", "a cc", "c", "aa\nb"]
    blocks = [dc.Phrases(dc.phrases_of(items[:4], 7)), dc.Phrases(dc.phrases_of(items[4:], 7))]
    want = dc.spans_in([text], blocks)[0]
    assert want == brute_spans(text, items, 7) and len(want) > 30
    assert all(dc.spans_in_long(text, lambda: blocks, size, 7) == want for size in (60, 100, 999, 10**6))


def test_scripts_without_blanks_have_a_word_for_each_character(spark):
    w = words.split_words(["人工知能 and ABC学x", "ไทย", "plain"])
    assert np.diff(w.first).tolist() == [8, 3, 1]
    item = "人工知能と機械学習の研究が進んでいます"
    bench = spark.createDataFrame([(1, item), (2, "深層学習を用いた")], "item_id long, text string")
    got = dc.contaminated(docs_of(spark, [(1, "前に" + item + "後に"), (2, "人工知能と機械学習の"), (3, "x深層学習を用いた。")]), bench).collect()
    assert [(r["doc_id"], r["spans"][0][:]) for r in sorted(got)] == [(1, (2, 2 + len(item))), (3, (1, 9))]


def test_a_larger_benchmark_is_searched_in_one_index_a_shard(spark, monkeypatch):
    """Phrases are cut into as many files as blocks, and each shard builds one index."""
    bench = spark.createDataFrame([(i, " ".join(f"b{i}x{k}" for k in range(30))) for i in range(300)], "item_id long, text string")
    files = dc.phrase_files(bench, 13, 1_000)
    assert len(files) == 6
    built = []
    index = dc.FMIndex
    monkeypatch.setattr(dc, "FMIndex", lambda *a: built.append(1) or index(*a))
    texts = [" ".join(f"b{i}x{k}" for k in range(9, 25)) + " clean words" for i in range(0, 300, 7)]
    found = dc.spans_in(texts, dc._blocks(files))
    assert len(built) == 1 and all(s == [(0, len(t) - len(" clean words"))] for t, s in zip(texts, found))


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "some words that are not found in any of these texts at all ever")], "item_id long, text string")
    assert dc.contaminated(odd_rows(spark), bench).count() == 0
    assert rows_of(dc.decontaminate(odd_rows(spark), bench)) == rows_of(odd_rows(spark))
    for d, b in ((docs_of(spark, []), bench), (odd_rows(spark), bench.limit(0))):
        assert dc.contaminated(d, b).count() == 0


# MinHash


def components_of(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def near_texts(seed=4):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randrange(5, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.choice((0, 0, 1, 4))):
            copy = [rng.choice(vocab) if rng.random() < rng.choice((0, 0.03, 0.1, 0.25)) else x for x in base]
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


def test_minhash_returns_all_pairs_under_the_distance(spark):
    texts = near_texts()
    sig = mh.signatures(texts)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if np.count_nonzero(sig[i] != sig[j]) <= mh.MAX_DISTANCE]
    root = components_of(len(texts), pairs)
    groups = defaultdict(list)
    for i, r in enumerate(root):
        groups[r].append(i)
    want = sorted((i, min(g), i == min(g)) for g in groups.values() if len(g) > 1 for i in g)
    frame = clashing(docs_of(spark, list(enumerate(texts))))
    assert sorted(map(tuple, mh.near_groups(frame).collect())) == want
    kept = {r["doc_id"] for r in mh.drop_near_copies(frame).collect()}
    assert kept == {min(g) for g in groups.values()}


def test_chunk_keys_meet_for_every_close_pair():
    rng = np.random.default_rng(1)
    masks = mh.chunk_masks(64, 25, 1)
    a = rng.integers(0, 65536, (300, 64)).astype(np.uint16)
    b = a.copy()
    for i in range(300):
        at = rng.choice(64, rng.integers(0, 26), replace=False)
        b[i, at] ^= np.uint16(1)
    assert (mh.chunk_keys(a, masks) == mh.chunk_keys(b, masks)).any(axis=1).all()


def test_forest_connects_what_pairs_connect():
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 3, (80, 12)).astype(np.uint16)
    pairs = [(i, j) for i in range(80) for j in range(i) if np.count_nonzero(sig[i] != sig[j]) <= 4]
    assert components_of(80, mh.forest(sig, 4)) == components_of(80, pairs)


@pytest.mark.parametrize("key_rows", [8, 40, 8_000])
def test_hot_keys_connect_what_pairs_connect(spark, key_rows):
    """Keys that hundreds of unlike signatures share, crowds of near copies, and chains between them."""
    rng = np.random.default_rng(key_rows)
    sig = rng.integers(0, 65536, (900, 64)).astype(np.uint16)
    sig[:400, 0:4] = 7  # a chunk in common, unlike else
    for i in range(0, 200, 4):
        sig[i + 1] = sig[i]
        sig[i + 1, rng.choice(64, rng.integers(20, 34), replace=False)] ^= np.uint16(1)
    sig[400:700] = sig[400]  # a crowd
    for i in range(401, 700):
        sig[i, rng.choice(64, rng.integers(1, 28), replace=False)] ^= np.uint16(rng.integers(1, 99))
    for i in range(700, 760):  # a chain out of it
        sig[i] = sig[i - 1] if i > 700 else sig[650]
        sig[i, rng.choice(64, 20, replace=False)] ^= np.uint16(3)
    pairs = [(i, j) for i in range(900) for j in np.flatnonzero(np.count_nonzero(sig[:i] != sig[i], axis=1) <= 30)]
    nodes = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sig)], "node long, sig binary")
    found = [tuple(r) for r in mh.signature_edges(nodes, 64, 30, 1, key_rows).collect()]
    assert components_of(900, found) == components_of(900, pairs)
    assert all(a < b for a, b in found)


def test_a_key_of_twenty_thousand_unlike_signatures(spark):
    rng = np.random.default_rng(5)
    sig = rng.integers(0, 65536, (20_000, 64)).astype(np.uint16)
    sig[:, 8:12] = 1
    for i in range(0, 200, 2):
        sig[i + 1] = sig[i]
        sig[i + 1, rng.choice(np.r_[:8, 12:64], 30, replace=False)] ^= np.uint16(9)
    nodes = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sig)], "node long, sig binary").repartition(8)
    found = {tuple(r) for r in mh.signature_edges(nodes, 64, 30, 1).collect()}
    assert found == {(i, i + 1) for i in range(0, 200, 2)}


def test_runs_over_batches():
    rng = np.random.default_rng(8)
    for _ in range(50):
        keys = np.sort(rng.integers(0, 12, rng.integers(0, 60)))
        cuts = np.sort(rng.integers(0, len(keys) + 1, 5))
        parts = [pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(v, pa.int64())], names=["key", "node"]) for k, v in zip(np.split(keys, cuts), np.split(np.arange(len(keys)), cuts))]
        count = Counter(keys.tolist())
        got = [r for b in mh._meeting(iter(parts), 4) for r in zip(*(c.to_pylist() for c in b.columns))]
        assert sorted(got, key=lambda r: r[1]) == [(k, i, count[k] > 4) for i, k in enumerate(keys.tolist()) if count[k] > 1]
        groups = [t.column("key").to_pylist() for t in mh._grouped(iter(parts), "key")]
        assert sum(groups, []) == keys.tolist() and all(not set(a) & set(b) for a, b in zip(groups, groups[1:]))


def test_ids_of_any_type_and_both_joins(spark):
    texts = near_texts(3)
    rows = [(f"d{i:04d}", t) for i, t in enumerate(texts + texts[:5])] + [(None, texts[0]), (None, "of its own"), ("d0000", texts[0])]
    frame = clashing(spark.createDataFrame(rows, "doc_id string, text string"))
    groups = mh.near_groups(frame).collect()
    assert {r["group_id"] for r in groups} <= {r["doc_id"] for r in groups} and [r["kept"] for r in groups].count(True) == len({r["group_id"] for r in groups})
    small, large = (rows_of(mh.drop_near_copies(frame, broadcast_rows=n)) for n in (500_000, 0))
    assert small == large and len(small) == len(rows) - len(groups) + len({r["group_id"] for r in groups})


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = dict(map(tuple, mh.components(spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_minhash_edges(spark):
    got = Counter(map(tuple, mh.near_groups(odd_rows(spark)).collect()))
    assert got == Counter({(4, 4, True): 1, (4, 4, False): 1, (2, 2, True): 1, (3, 2, False): 1, (6, 6, True): 1, (6, 6, False): 1})
    kept = Counter((r["doc_id"], r["text"]) for r in mh.drop_near_copies(odd_rows(spark)).collect())
    assert kept[(6, "same text")] == 1 and kept[(6, "other text")] == 1 and kept[(1, None)] == 1 and kept[(None, None)] == 1 and kept[(None, "a null id here")] == 1
    assert kept[(2, "")] == 1 and kept[(3, " \n\t ")] == 0
    assert mh.near_groups(docs_of(spark, [])).count() == 0 and mh.drop_near_copies(docs_of(spark, [])).count() == 0


# sharding, mixing, lines


def test_sharding_against_sql(spark):
    rng = random.Random(1)
    rows = [(i, None, "en", rng.choice(["a", "a", "a", "b", "c", "", None])) for i in range(1000)]
    frame = docs_of(spark, rows)
    got = rows_of(sharding.assign_shards(clashing(frame), bucket_rows=20).select("doc_id", "source", "shard_id", "position"))
    pdf = frame.toPandas()
    assert got == sorted(sql(ORACLES["op1_sharding"], documents=pdf), key=repr)
    sizes = Counter(r[2] for r in got)
    assert len(sizes) == sharding.N_SHARDS and max(sizes.values()) - min(sizes.values()) <= 1
    share = Counter(r[1] for r in rows_of(frame.select("doc_id", "source")))
    for s in range(sharding.N_SHARDS):
        mine = Counter(r[1] for r in got if r[2] == s)
        assert all(abs(mine[k] - share[k] * sizes[s] / 1000) < 2 for k in share)


def test_sharding_keeps_every_row(spark):
    frame = odd_rows(spark).withColumn("shard_id", F.lit("old")).withColumn("Position", F.lit(1))
    assert sharding.shard_documents(frame, 3).columns == [*odd_rows(spark).columns, "shard_id", "position"]
    plain = sharding.shard_documents(odd_rows(spark), 3)
    assert sorted(r["position"] for r in plain.collect()) == list(range(12))
    assert rows_of(plain.select(*odd_rows(spark).columns)) == rows_of(odd_rows(spark))
    assert sharding.assign_shards(docs_of(spark, [])).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(odd_rows(spark), 0)


def test_mixing_against_sql(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, "", "one two", "a b c d e f g", "x " * 40]), rng.choice(["en", "en", "de", "zz", None]), rng.choice([f"src{k}" for k in range(18)] + [None])) for i in range(900)]
    frame = docs_of(spark, rows)
    got = rows_of(mixing.mix(clashing(frame).drop("domain")).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch"))
    assert got == sorted(sql(ORACLES["op5_source_mixing"], documents=frame.toPandas()), key=repr)
    assert {r[5] for r in got} == {0, 1}
    for leaves in (1_000, 0):
        chosen = Counter(r["doc_id"] for r in mixing.mix_documents(frame, broadcast_leaves=leaves).collect())
        assert chosen == Counter(r[0] for r in got)


def test_mixing_takes_as_many_of_equal_rows_as_were_chosen(spark):
    """A third of all rows are one; the cut falls within them."""
    rows = [(7, "a b c d", "en", "src1")] * 100 + [(i, "a b", "en", "src1") for i in range(200)] + [(None, "x y z", "en", "src1")] * 30
    for share in ((1, 10), (3, 10), (5, 10), (8, 10), (13, 10)):
        mixture = mixing.Mixture(budget=share, max_epochs=3)
        frame = docs_of(spark, rows).repartition(5)
        want = Counter(r["doc_id"] for r in mixing.mix(frame, mixture).collect())
        got = mixing.mix_documents(clashing(frame), mixture)
        assert got.columns == clashing(frame).columns
        assert Counter(r["doc_id"] for r in got.collect()) == want


def fill(budget, children):
    """Exact water-filling with fractions: children (weight, capacity)."""
    left, open_, out = budget, dict(enumerate(children)), {}
    while open_:
        total = sum(w for w, _ in open_.values())
        full = [i for i, (w, c) in open_.items() if left * w >= c * total]
        if not full:
            return [out.get(i, left * children[i][0] / total) for i in range(len(children))]
        for i in full:
            out[i] = open_.pop(i)[1]
        left -= sum(out[i] for i in full)
    return [out[i] for i in range(len(children))]


def test_shortages_stay_among_siblings(spark):
    mixture = mixing.Mixture(domains={"A": ("s1", "s2"), "B": ("s3",)}, domain_weights={"A": 1, "B": 1}, language_weights={}, source_weights={}, budget=(1, 2), max_epochs=1)
    tokens = spark.createDataFrame([("A", "en", "s1", 100), ("A", "en", "s2", 1000), ("B", "en", "s3", 900)], "domain string, lang string, source string, n_tokens long")
    got = {r["source"]: r["budget"] for r in mixing.leaf_budgets(tokens, mixture).collect()}
    assert got == {"s1": 100, "s2": 400, "s3": 500}
    assert [round(x) for x in fill(500, [(1, 100), (1, 1000)])] == [100, 400]


def test_mixing_edges(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0
    every = mixing.Mixture(budget=(2, 1), max_epochs=2)
    twice = mixing.mix_documents(odd_rows(spark).where("source IS NOT NULL"), every)
    assert Counter((r["doc_id"], r["text"]) for r in twice.collect())[(6, "same text")] == 4


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_line_dedup_against_sql(spark, limit):
    rng = random.Random(6)
    pool = [f"Common  Line {i}" for i in range(6)] + ["", "  ", "rare"]
    rows = [(i, "\n".join([rng.choice(pool), f"own {i}", rng.choice(pool).upper(), rng.choice(pool)])) for i in range(60)] + [(60, ""), (61, None), (62, "common line 1")]
    frame = docs_of(spark, rows)
    got = rows_of(line_dedup.dedup_lines(clashing(frame).drop("drop"), broadcast_hashes=limit))
    assert got == sorted(sql(ORACLES["op7_line_dedup"], documents=frame.toPandas()[["doc_id", "text"]]), key=repr)
    assert any(r[3] for r in got)
    assert line_dedup.dedup_lines(docs_of(spark, []), broadcast_hashes=limit).count() == 0
    assert line_dedup.dedup_lines(odd_rows(spark), broadcast_hashes=limit).count() == 12


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_long_lines_have_their_own_threshold(spark, limit, tmp_path):
    passage, han = " ".join(f"w{i}" for i in range(50)), "学習人工知能" * 9
    shared = {0: [passage, " ".join(f"v{i}" for i in range(49))], 1: [han, "short"]}
    rows = [(i, "\n".join([f"own {i}", *shared[i // 2 % 2], f"end {i}"])) for i in range(4)] + [(4, passage.upper().replace(" ", "  ")), (5, "x " * 60 + "\n" + "x " * 60), (6, "alone " * 60)]
    rows += [(10 + i, "common line") for i in range(11)] + [(30 + i, "not common") for i in range(10)]
    frame = docs_of(spark, rows)
    frame.write.parquet(str(tmp_path / "documents.parquet"))

    def key(line):
        return " ".join(line.lower().split())

    def is_long(line):
        return len(line.split()) >= 50 or len(line) >= 50 and not line.isascii()

    spread = Counter(k for _, text in rows for k in {key(x) for x in text.split("\n")})
    want = []
    for i, text in rows:
        kept = [x for x in text.split("\n") if spread[key(x)] <= (1 if is_long(x) else 10)]
        n = text.count("\n") + 1
        want.append((i, "\n".join(kept), n, n - len(kept)))
    got = rows_of(line_dedup.dedup_lines(frame, broadcast_hashes=limit, long_words=line_dedup.LONG_WORDS))
    assert got == sorted(want, key=repr) and sum(r[3] for r in got) == 11 + 3 + 2
    assert rows_of(QUERIES["op7_line_dedup_by_length"](spark, str(tmp_path))) == got


def test_prefix_sums_are_exact(spark):
    df = spark.createDataFrame([("g" if i % 3 else "h", i // 10, i, i % 7) for i in range(200)], "g string, b long, i long, v long")
    got = {r["i"]: r["s"] for r in common.with_prefix(df, ["g"], "b", [F.col("i")], F.col("v"), "s").collect()}
    sums: Counter = Counter()
    for i in range(200):
        g = "g" if i % 3 else "h"
        sums[g] += i % 7
        assert got[i] == sums[g]


def test_edited_copies_of_short_texts_are_found(spark):
    """Pairs whose word bigrams have a Jaccard similarity of 76 / 122 = 0.62."""
    rng = random.Random(8)
    rows = []
    for i in range(100):
        words = [f"w{rng.randrange(10**9)}" for _ in range(123)]
        rows += [(2 * i, " ".join(words[:100])), (2 * i + 1, " ".join(words[:77] + words[100:]))]
    groups = defaultdict(set)
    for r in mh.near_groups(docs_of(spark, rows)).collect():
        groups[r["group_id"]].add(r["doc_id"])
    found = [g for g in groups.values() if len(g) > 1]
    assert len(found) >= 85 and all(len(g) == 2 and min(g) // 2 == max(g) // 2 for g in found)


# vectors


def classes_of(unit, least=pivots.MIN_COSINE):
    """(class, links) of each row by comparing all pairs."""
    near = unit @ unit.T >= least
    np.fill_diagonal(near, False)
    root = components_of(len(unit), list(zip(*np.nonzero(np.triu(near)))))
    return [(root[i], int(near[i].sum())) for i in range(len(unit))]


@pytest.mark.parametrize("kind", [int, str])
def test_pivots_against_brute_force(spark, kind):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(700, 32))
    near = np.concatenate([base[i] + rng.normal(size=(k, 32)) * 0.05 for i, k in ((0, 60), (1, 5), (2, 1), (3, 1))])
    x = np.concatenate([base, near, near[:3] * 8, base[5:8]])
    want = classes_of(x / np.linalg.norm(x, axis=1, keepdims=True))
    name = (lambda i: i) if kind is int else (lambda i: f"v{i:05d}")
    rows = [(name(i), v.tolist()) for i, v in enumerate(x)]
    odd = [(name(9001), None), (name(9002), []), (name(9003), [0.0] * 32), (name(9004), [float("nan")] * 32), (name(9005), [1.0]), (None, base[9].tolist()), (name(9006), [None] * 32), (None, None)]
    frame = clashing(spark.createDataFrame(rows + odd, f"vec_id {'long' if kind is int else 'string'}, embedding array<double>"))
    for block in (100_000, 20):
        found = pivots.near_vectors(frame, block=block).collect()
        assert len(found) == len(rows) + len(odd)
        got = {r["vec_id"]: (r["class_id"], r["n_links"]) for r in found if r["vec_id"] is not None}
        twin = {9: 1}  # the row without an id is near row 9
        assert [got[name(i)] for i in range(len(x))] == [(name(c), n + twin.get(i, 0)) for i, (c, n) in enumerate(want)]
        assert all(got[name(i)] == (name(i), 0) for i in range(9001, 9007))
        assert sorted((str(r["class_id"]), r["n_links"]) for r in found if r["vec_id"] is None) == sorted([(str(name(9)), 1), ("None", 0)])
    again = pivots.near_vectors(frame.union(frame.where(F.col("vec_id") == name(700)))).where(F.col("vec_id") == name(700)).collect()
    assert [(r["class_id"], r["n_links"]) for r in again] == [(name(want[700][0]), want[700][1] + 1)] * 2
    assert pivots.near_vectors(frame.limit(0)).count() == 0
    assert [r[:] for r in pivots.near_vectors(frame.where(F.col("vec_id").isin([name(5), name(9001)]))).orderBy("vec_id").collect()] == [(name(5), name(5), 0), (name(9001), name(9001), 0)]


@pytest.mark.parametrize("dense", [1, 192])
def test_lists_count_each_candidate_pair_once(monkeypatch, dense):
    """Short and long sublists, whole lists and pairs of blocks: all give the pairs that share two of the first pivots and enough of all."""
    monkeypatch.setattr(pivots, "DENSE", dense)
    monkeypatch.setattr(pivots, "PAIRS", 500)
    monkeypatch.setattr(pivots, "TILE", 37)
    rng = np.random.default_rng(dense)
    x = np.repeat(rng.normal(size=(30, 16)), 8, axis=0) + rng.normal(size=(240, 16)) * 0.2
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    near = np.argsort(-(x @ x[rng.permutation(240)[:40]].T), axis=1)[:, :16].astype(np.uint16)
    probes, shared, least = 6, 7, 0.7
    want = {(i, j) for i in range(240) for j in range(i) if len({*near[i, :probes]} & {*near[j, :probes]}) > 1 and len({*near[i]} & {*near[j]}) >= shared and x[i] @ x[j] >= least}
    for blocks in (1, 3):
        found = []
        for p in range(40):
            has = np.flatnonzero((near[:, :probes] == p).any(axis=1))
            for u in range(blocks):
                for v in range(u, blocks):
                    rows = has[(has % blocks == u) | (has % blocks == v)]
                    second = None if u == v else rows % blocks == v
                    for a, b in pivots.Lists(x[rows], near[rows], second, p, probes, shared, least).pairs():
                        found += [(max(i, j), min(i, j)) for i, j in zip(rows[a].tolist(), rows[b].tolist())]
        assert len(found) == len(set(found)) and set(found) == want and len(want) > 300


@pytest.mark.parametrize("count", [283, 1_000, 4_096, 16_000])
def test_pivots_recall_at_any_number_of_pivots(spark, tmp_path, monkeypatch, count):
    """Pairs of cosine 0.95 to 0.98 among 16,000 vectors; the number of pivots is that of larger tables."""
    rng = np.random.default_rng(count)
    base = rng.normal(size=(15_000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=(1_000, 64))
    side -= (side * base[:1_000]).sum(axis=1, keepdims=True) * base[:1_000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(0.9501, 0.98, (1_000, 1))
    near = c * base[:1_000] + np.sqrt(1 - c * c) * side
    table = pa.table({"vec_id": np.arange(16_000), "embedding": np.concatenate([base, near]).tolist()})
    pq.write_table(table, str(tmp_path / "v.parquet"))
    monkeypatch.setattr(pivots, "pivot_count", lambda n: count)
    got = {r["vec_id"]: (r["class_id"], r["n_links"]) for r in pivots.near_vectors(spark.read.parquet(str(tmp_path / "v.parquet"))).collect()}
    found = np.array([got[15_000 + i] == (i, 1) for i in range(1_000)])
    low = c[:, 0] < 0.96
    assert found.mean() >= 0.95 and found[low].mean() >= 0.9


def test_copied_vectors_against_sql(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(60, 64)).astype(np.float32)
    rows = pa.table({"vec_id": np.arange(60), "embedding": pa.array([r.tolist() for r in x], pa.list_(pa.float32()))})
    pq.write_table(rows, str(tmp_path / "embeddings.parquet"))
    for name in ("op2_embedding_near_dedup", "op2_embedding_near_dedup_copied"):
        got = QUERIES[name](spark, str(tmp_path)).select("vec_id", "class_id", "n_links")
        assert rows_of(got) == sorted((tuple(r) for r in sql(ORACLES[name], embeddings=rows)), key=repr)


def test_components_by_steps_and_in_one_task(spark, monkeypatch):
    rng = np.random.default_rng(6)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2)) if a != b]
    root = components_of(400, pairs)
    frame = spark.createDataFrame(pairs, "a long, b long")
    for most in (1_000_000, 0):
        monkeypatch.setattr(comp, "TASK_EDGES", most)
        assert {r["node"]: r["root"] for r in comp.components(frame).collect()} == {v: root[v] for p in pairs for v in p}


# WARC


def parse(data, chunk=warc.CHUNK_BYTES):
    return list(warc.chunks_of(io.BytesIO(data), chunk))


def test_warc_round_trip(spark):
    rng = random.Random(3)
    pages = [(i, f"http://x/{i}", "".join(rng.choice("añ学<>\n") for _ in range(rng.choice((0, 10, 500, 5000))))) for i in range(40)]
    pages += [(100, None, "no url"), (101, "http://x/a\nb", None), (None, "u", "é" * 100_000), (3, "http://x/3", "again"), (3, "http://x/3", "again")]
    frame = clashing(spark.createDataFrame(pages, "page_id long, url string, html string"))
    chunks = warc.chunk_pages(frame, 1000).collect()
    by = defaultdict(list)
    for r in chunks:
        by[r["record_id"]].append(r)
    for page, url, html in pages:
        data = (html or "").encode()
        mine = sorted(by[warc.record_id_of(page, url)], key=lambda r: r["chunk_no"])
        copies = sum(1 for p in pages if p[:2] == (page, url))
        if copies > 1:
            continue
        assert b"".join(bytes(r["chunk"]) for r in mine) == data
        assert mine[-1]["digest"] == hashlib.sha256(data).hexdigest() and [r["is_last"] for r in mine] == [False] * (len(mine) - 1) + [True]
        assert all(r["n_bytes"] <= 1000 and r["digest"] == hashlib.sha256(data[: r["chunk_offset"] + r["n_bytes"]]).hexdigest() for r in mine)
    assert len(by[warc.record_id_of(3, "http://x/3")]) == 3
    assert warc.chunk_pages(frame.limit(0)).count() == 0


def test_warc_plain_truncated_and_broken_files():
    payload = b"z" * 2500
    record = warc.record_bytes("<a>", "u", payload) + payload + b"\r\n\r\n"
    rows = parse(record + record, 1000)
    assert [(r[3], r[5], r[8], r[9]) for r in rows] == [(0, 1000, False, False), (1, 1000, False, False), (2, 500, True, True)] * 2
    assert [(r[5], r[8], r[9]) for r in parse(record[:-700], 1000)] == [(1000, False, False), (804, True, False)]
    assert parse(b"") == [] and parse(b"\r\n\r\n") == []
    rows = parse(b"<html>\nx\n" + record)
    assert [r[1] for r in rows] == ["malformed", "response"] and rows[0][6] == b"<html>\nx\n" and not rows[0][9] and rows[1][9]


def test_malformed_records_give_rows_and_end_no_job(spark, tmp_path):
    good = warc.record_bytes("<good>", "u", b"payload") + b"payload\r\n\r\n"
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <bad>\r\nContent-Type: application/http\r\nContent-Length: %s\r\n\r\n"
    block = b"HTTP/1.1 200 OK no end!"
    cases = {
        "no_line_end": (head % b"23" + block, block),
        "no_separator": (head % b"23" + block[:-2] + b"\r\n", block[:-2] + b"\r\n"),
        "no_number": (head % b"many" + block, block),
        "stray": (b"stray bytes\r\n" * 3, b"stray bytes\r\n" * 3),
        "long_head": (b"WARC/1.1\r\nX: " + b"y" * (warc.MAX_HEADER + 10) + b"\r\n\r\n", None),
        "short_length": (head % b"4" + b"a\n\n" + block, b"a\n\nH"),
        "head_of_nothing": (b"WARC/1.1\r\nWARC-Type: response", None),
        "past_the_end": (head % b"99999" + b"a: b\r\n\r\nrest", None),
    }
    paths = []
    for name, (data, _) in cases.items():
        ends = name in ("head_of_nothing", "past_the_end")
        for kind in ("plain", "packed"):
            p = tmp_path / f"{name}.{kind}"
            body = data if name == "no_separator" else data + b"\r\n"
            parts = [good, body, *[good] * (not ends)]
            p.write_bytes(b"".join(gzip.compress(x) if kind == "packed" else x for x in parts))
            paths.append(str(p))
    damaged = tmp_path / "damaged.packed"
    z = gzip.compress(warc.record_bytes("<hurt>", "u", random.Random(1).randbytes(300_000)) + random.Random(1).randbytes(300_000))
    damaged.write_bytes(gzip.compress(good) + z[:150_000] + b"\xff" * 2_000 + z[152_000:] + gzip.compress(good))
    paths += [str(damaged), None]
    frame = clashing(spark.createDataFrame([(p,) for p in paths], "path string"))
    rows = warc.read_warc(spark, frame, 1000).collect()
    fine = [r for r in rows if r["record_id"] == "<good>"]
    assert all(bytes(r["chunk"]) == b"payload" and r["complete"] for r in fine) and len(fine) >= 2 * (2 * len(cases) - 2) + 1
    assert not any(r["complete"] for r in rows if r["record_id"] == "<hurt>" or r["warc_type"] == "malformed")
    for name, (data, want) in cases.items():
        for kind in ("plain", "packed"):
            mine = list(warc.chunks_of(open(tmp_path / f"{name}.{kind}", "rb"), 10_000_000))
            bad = [r for r in mine if r[0] != "<good>"]
            assert [r[0] for r in mine].count("<good>") == (1 if name in ("head_of_nothing", "past_the_end") else 2), name
            assert bad and (name == "no_separator" or name == "short_length" or not any(r[9] for r in bad)), name
            if want is not None and name not in ("no_separator", "short_length"):
                assert bad[0][6].rstrip(b"\r\n") == want.rstrip(b"\r\n"), name
    assert sum(len(r[6]) for r in parse(cases["long_head"][0] + good)) > warc.MAX_HEADER


def test_warc_files_share_tasks_by_size(spark, tmp_path):
    good = warc.record_bytes("<good>", "u", b"x" * 50) + b"x" * 50 + b"\r\n\r\n"
    rows = []
    for i in range(30):
        p = tmp_path / f"{i}.warc"
        p.write_bytes(good * (100 if i == 7 else 1))
        rows.append((str(p), len(good) * (100 if i == 7 else 1)))
    got = warc.read_warc(spark, spark.createDataFrame(rows, "path string, n_bytes long"))
    assert got.count() == 129
    assert warc.read_warc(spark, spark.createDataFrame(rows, "path string, n_bytes long").select("path")).count() == 129


# licenses


def brute_scan(text):
    """Every pattern over the whole text; a detection stands unless one that comes before it in the order holds it, or overlaps it with a higher priority."""
    found = [(m.start(), m.end(), r.priority, r.number) for r in RULES for m in re.finditer(r.pattern, text, re.I | re.A) if m.end() > m.start()]
    order = sorted(found, key=lambda d: (-d[2], d[0] - d[1], d[0], d[3]))
    stands = [True] * len(order)
    for i, (a, b, p, _) in enumerate(order):
        for j in range(i):
            x, y, q, _ = order[j]
            inside, across = x <= a and b <= y, max(a, x) < min(b, y) and q > p
            if stands[j] and (inside or across):
                stands[i] = False
                break
    return [(a, b, n) for (a, b, _, n), ok in zip(order, stands) if ok]


def sample_of(parsed, rng):
    """A text that a parsed pattern matches, but for what lies around it."""
    out = []
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out.append(chr(arg))
        elif name == "NOT_LITERAL":
            out.append("x" if arg != ord("x") else "y")
        elif name == "ANY":
            out.append("x")
        elif name == "IN":
            kind, value = arg[0]
            if str(kind) == "NEGATE":
                out.append("x")
            elif str(kind) == "RANGE":
                out.append(chr(value[0]))
            elif str(kind) == "CATEGORY":
                out.append({"CATEGORY_DIGIT": "2", "CATEGORY_SPACE": " ", "CATEGORY_WORD": "a"}.get(str(value), "x"))
            else:
                out.append(chr(value))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            lo, hi, inner = arg
            out.append("".join(sample_of(inner, rng) for _ in range(max(lo, min(hi, rng.choice((lo, lo + 1)))))))
        elif name == "SUBPATTERN":
            out.append(sample_of(arg[3], rng))
        elif name == "BRANCH":
            out.append(sample_of(rng.choice(arg[1]), rng))
    return "".join(out)


def test_each_rule_finds_a_text_of_its_own():
    """A text is made from each pattern; the rule, or one that stands before it, covers it, and keywords don't gate it out."""
    import re._parser as parser

    rng = random.Random(12)
    alone = set()
    for rule in RULES:
        made = [sample_of(parser.parse(rule.pattern, re.I | re.A), rng) for _ in range(40)]
        made = [(t, m) for t in made if (m := re.search(rule.pattern, t, re.I | re.A)) and m.group()][:4]
        assert made, rule
        for text, whole in made:
            assert rule in license_scan.candidates(text), (rule, text)
            got = [(a, b, r.number) for a, b, r in license_scan.scan(f"{text}\n")]
            assert sorted(got) == sorted(brute_scan(f"{text}\n")), rule
            assert any(a < whole.end() and whole.start() < b for a, b, _ in got)
            if any(n == rule.number for _, _, n in got):
                alone.add(rule.number)
    hidden = [r for r in RULES if r.number not in alone]
    assert len(hidden) < len(RULES) // 10, [(r.license, r.pattern) for r in hidden]


def test_license_gates_change_nothing(spark):
    notices = [
        "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: (MIT OR Apache-2.0)", "Copyright (c) 2019 Someone. All rights reserved.", "GPLv2+ and LGPL-2.1",
        "https://creativecommons.org/licenses/by-sa/4.0/", "dual licensed under the BSD 3-Clause\n  license", "Mit der Lizenz nicht", "mit mit mit", "", "released   under\nthe mit licence",
    ]
    rng = random.Random(5)
    texts = notices + [" ".join(rng.choice(notices) for _ in range(6)) for _ in range(60)] + ["word " * 100_000 + notices[0], None]
    frame = clashing(docs_of(spark, list(enumerate(texts))))
    got = defaultdict(list)
    for r in license_scan.scan_licenses(frame).collect():
        got[r["doc_id"]].append((r["start"], r["end"], r["rule"]))
        assert texts[r["doc_id"]][r["start"] : r["end"]] == r["matched"]
    for i, t in enumerate(texts):
        assert sorted(got[i]) == sorted(brute_scan(t or ""))
    first = {i: RULES[got[i][0][2]].license for i in range(4)}
    assert first == {0: "MIT", 1: "Apache-2.0", 2: "GPL-3.0-only", 3: "CC-BY-NC-4.0"}
    assert license_scan.scan_licenses(docs_of(spark, [])).count() == 0 and license_scan.scan_licenses(odd_rows(spark)).count() == 0


def test_hundreds_of_rules_and_their_keywords():
    assert len(RULES) > 250 and len({r.license for r in RULES}) > 90
    assert all(k == k.lower() and " " not in k for r in RULES for k in r.keywords)
    assert all(any(k in r.keywords or any(k in w for w in r.keywords) for k in license_scan._roots()) for r in RULES)


def test_gaps_of_license_rules_cross_line_ends():
    holder = "the University of Somewhere, the Institute of Something Else in Elsewhere,\n    its departments, its laboratories and its members"
    texts = {
        "NCSA": "deal with the Software without restriction, including without limitation the\nrights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is furnished\nto do so, subject to the following conditions:",
        "BSD-3-Clause": f"Neither the names of {holder}\nnor the names of its contributors may be used to endorse or promote products",
        "CC0-1.0": f"To the extent possible under law, {holder}\nhas waived all copyright and related or neighboring rights",
        "NASA-1.3": "NASA Open Source Agreement, in\nits third version, a license",
    }
    for name, text in texts.items():
        hits = [text[a:b] for a, b, r in license_scan.scan(text) if r.license == name]
        assert any(len(h) > 0.9 * len(text) for h in hits), name
        assert [(a, b, r.number) for a, b, r in license_scan.scan(text)] == brute_scan(text)
