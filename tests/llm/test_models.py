"""Trained models: accuracy on rows that training didn't see, and a pipeline run."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from inkwell.llm import decontaminate, gbdt, langid, minhash, mixing, quality, sharding, words
from inkwell.llm.queries import QUERIES
from tests.llm.test_exact import clashing, components_of, docs_of, odd_rows, rows_of

SF = "/root/testdata/sf0.01"


def test_trees_learn_an_interaction_and_flatten_alike():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = gbdt.train(x[:2000], y[:2000], trees=60, depth=3)
    assert ((forest.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95

    def walk(row):
        total = forest.base
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.right[node] if row[forest.feature[node]] > forest.threshold[node] else forest.left[node]
            total += forest.value[node]
        return total

    assert np.allclose(forest.margin(x[:50]), [walk(r) for r in x[:50]])
    assert gbdt.train(x[:5], np.ones(5)).probability(x[:5]).min() > 0.5


def test_statistics_match_direct_counts():
    texts = ["Hello hello WORLD!\nx 12\nx 12", "", "a|b|c", "é" * 300, "  \n "]
    got = dict(zip(quality.FEATURES, quality.statistics(texts).T))
    n = [max(1, len(t)) for t in texts]
    assert np.allclose(got["digit_share"], [sum(c.isdigit() for c in t) / k for t, k in zip(texts, n)])
    assert np.allclose(got["pipe_share"], [t.count("|") / k for t, k in zip(texts, n)])
    assert np.allclose(got["repeat_line"], [1 - len(set(t.split("\n"))) / len(t.split("\n")) for t in texts])
    assert np.allclose(got["type_share"][0], 4 / 7) and np.allclose(got["repeat_word"][0], 1 / 7)
    assert np.isfinite(quality.statistics(texts)).all() and quality.statistics([]).shape == (0, len(quality.FEATURES))
    assert np.allclose(quality.statistics([texts[0]])[0], quality.statistics(texts)[0])


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    train = labels.where("doc_id % 2 = 0")
    scored = quality.score_quality(clashing(docs), train)
    assert scored.count() == docs.count()
    held = scored.join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert (held["keep"] == (held["quality"] == 1)).mean() > 0.93
    assert held[held["quality"] == 1]["keep"].mean() > 0.97
    again = quality.score_quality(docs.repartition(5), train)
    assert rows_of(scored.select("doc_id", "score")) == rows_of(again.select("doc_id", "score"))


def test_quality_edges(spark):
    labels = spark.createDataFrame([(6, 1), (6, 0), (4, 1), (None, 1), (5, None)], "doc_id long, quality int")
    assert quality.score_quality(odd_rows(spark), labels).count() == 12
    assert rows_of(quality.keep_good(odd_rows(spark), labels.limit(0))) == rows_of(odd_rows(spark))
    assert quality.score_quality(docs_of(spark, []), labels).count() == 0


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1").toPandas()
    got = model.predict(held["text"].tolist())
    right = np.array([a == b for (a, _), b in zip(got, held["lang"])])
    assert right.mean() > 0.95
    sparse = (model.weights != 0).mean()
    assert 0 < sparse < 0.6
    confidence = np.array([c for _, c in got])
    assert abs(confidence.mean() - right.mean()) < 0.05


def test_ngram_counts_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    text = "".join(random.Random(1).choice("ab  ñ1") for _ in range(5000))
    whole = langid.ngram_counts(text)
    for piece in (7, 64, 1000):
        monkeypatch.setattr(langid, "_PIECE", piece)
        assert (langid.ngram_counts(text) == whole).all()
    assert whole.sum() > 0 and langid.ngram_counts("").sum() == 0 and langid.ngram_counts(" 12 ").sum() == 0


def test_document_frequencies_cover_all_rows(spark):
    rows = docs_of(spark, [(1, "ab"), (2, "ab ab"), (3, None), (4, "zz")])
    df, n = langid.document_frequencies(rows.select("text"))
    want = sum((langid.ngram_counts(t) > 0).astype(int) for t in ("ab", "ab ab", "", "zz"))
    assert n == 4 and (df == want).all()


def test_drawn_ids_are_the_first_of_each_language(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(("en", "de", "de", "de", None))) for i in range(3_000)] * 2 + [(None, "en")]
    want = {}
    for lang in ("en", "de"):
        ids = {i for i, x in rows if x == lang and i is not None}
        want[lang] = set(sorted(ids, key=lambda i: hashlib.md5(f"s:{i}".encode()).hexdigest())[:40])
    got = langid.drawn_ids(spark.createDataFrame(rows, "doc_id long, lang string"), 40, "s").collect()
    assert {x: {r["doc_id"] for r in got if r["lang"] == x} for x in want} == want and len(got) == 80


def test_features_against_plain_counts():
    """N-grams hashed one at a time, and their weights, in plain Python."""
    texts = ["Hallo, hällo 12 Welt!\nA b", "aaa", "学 x", "¿Qué?"]
    table = words.fold_table()
    low = lambda ch: ch if (c := int(table[ord(ch)])) == 0 else chr(c)

    def counts(text):
        chars = [low(c) if c.isalpha() or (ord(c) > 57 and table[ord(c)]) else " " for c in text]
        out = Counter()
        for n in langid.ORDERS:
            for i in range(len(chars) - n + 1):
                part = chars[i : i + n]
                if not any(c != " " for c in part):
                    continue
                h = n * 0x9E3779B1 % 2**32
                for c in part:
                    h = (h ^ ord(c)) * 0x85EBCA6B % 2**32
                    h ^= h >> 15
                out[h % langid.DIMS] += 1
        return out

    n = len(texts)
    df = sum((np.isin(np.arange(langid.DIMS), list(counts(t))) for t in texts), np.zeros(langid.DIMS))
    idf = np.log((1 + n) / (1 + df)) + 1
    for t in texts:
        want = counts(t)
        assert {i: int(c) for i, c in enumerate(langid.ngram_counts(t)) if c} == dict(want)
        at, v = langid.features(t, idf)
        raw = {i: math.log(1 + c) * (math.log((1 + n) / (1 + df[i])) + 1) for i, c in want.items()}
        length = math.sqrt(sum(x * x for x in raw.values()))
        assert np.allclose(v, [raw[i] / length for i in at.tolist()])


def test_ftrl_against_a_plain_loop(monkeypatch):
    monkeypatch.setattr(langid, "DIMS", 6)
    rng = np.random.default_rng(2)
    rows = [(np.flatnonzero(m), rng.normal(size=int(m.sum()))) for m in rng.random((25, 6)) < 0.5]
    y = rng.integers(0, 3, 25)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.1
    got_w, got_b = langid.train_ftrl(rows, y, 3, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2, seed=7)
    z = [[0.0] * 3 for _ in range(7)]
    n = [[0.0] * 3 for _ in range(7)]

    def weight(i, k):
        bound = l1 if i < 6 else 0.0
        if abs(z[i][k]) <= bound:
            return 0.0
        return -(z[i][k] - math.copysign(bound, z[i][k])) / ((beta + math.sqrt(n[i][k])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(2):
        for r in order.permutation(25):
            x = [*zip(rows[r][0].tolist(), rows[r][1].tolist()), (6, 1.0)]
            w = {(i, k): weight(i, k) for i, _ in x for k in range(3)}
            e = [math.exp(sum(v * w[i, k] for i, v in x)) for k in range(3)]
            for i, v in x:
                for k in range(3):
                    g = v * (e[k] / sum(e) - (k == y[r]))
                    z[i][k] += g - (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / alpha * w[i, k]
                    n[i][k] += g * g
    assert np.allclose(got_w, [[weight(i, k) for k in range(3)] for i in range(6)]) and np.allclose(got_b, [weight(6, k) for k in range(3)])
    assert (got_w == 0).any()


def test_temperature_is_the_best_of_a_grid():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(400, 3)) * 4
    y = np.array([rng.choice(3, p=p) for p in langid.softmax(logits / 2.5)])

    def loss(t):
        return -np.log(langid.softmax(logits / t)[np.arange(400), y]).mean()

    t = langid.best_temperature(logits, y)
    assert loss(t) <= min(loss(g) for g in np.geomspace(0.05, 20, 300)) + 1e-6 and 2 < t < 3.2


def test_ties_of_languages_go_to_the_first_by_name(spark):
    docs = docs_of(spark, [(i, "same words", lang) for i, lang in enumerate(["xx", "aa"] * 10)])
    model = langid.Model(["aa", "xx"], np.ones(langid.DIMS), np.zeros((langid.DIMS, 2)), np.zeros(2), 1.0)
    assert model.predict(["same words"])[0] == ("aa", 0.5)
    assert {r["language"] for r in langid.identify(docs).collect()} <= {"aa", "xx"}


def test_a_split_is_the_best_of_all():
    """Every feature and cut by plain sums of gradients, and the leaves' values."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(120, 5)), 1)
    y = (x[:, 2] + rng.normal(size=120) > 0.3).astype(float)
    forest = gbdt.train(x, y, trees=1, depth=1, bins=16, rate=0.2, l2=1.0, least=10)
    p = y.mean()
    g, h = p - y, np.full(120, p * (1 - p))
    best = (0.0, 0, 0.0)
    for f in range(5):
        for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)[1:-1])):
            left = x[:, f] <= c
            if min(left.sum(), (~left).sum()) < 10:
                continue
            gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
            if gain > best[0] + 1e-12:
                best = (gain, f, c)
    root = forest.roots[0]
    assert (forest.feature[root], forest.threshold[root]) == best[1:]
    for side, rows in ((forest.left, x[:, best[1]] <= best[2]), (forest.right, x[:, best[1]] > best[2])):
        assert np.isclose(forest.value[side[root]], -0.2 * g[rows].sum() / (h[rows].sum() + 1))
    assert np.isclose(forest.base, math.log(p / (1 - p)))


def test_boosting_follows_plain_newton_steps():
    """Several trees of depth 2, grown again from their own splits."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3))
    y = ((x[:, 0] > 0) != (x[:, 1] > 0)).astype(float)
    forest = gbdt.train(x, y, trees=4, depth=2, bins=16, rate=0.3)
    margin = np.full(300, math.log(y.mean() / (1 - y.mean())))
    for root in forest.roots:
        p = 1 / (1 + np.exp(-margin))
        leaf = np.array([root] * 300)
        for _ in range(2):
            leaf = np.where(x[np.arange(300), forest.feature[leaf]] <= forest.threshold[leaf], forest.left[leaf], forest.right[leaf])
        for k in np.unique(leaf):
            rows = leaf == k
            assert np.isclose(forest.value[k], -0.3 * (p - y)[rows].sum() / ((p * (1 - p))[rows].sum() + 1))
        margin = margin + forest.value[leaf]
    assert np.allclose(forest.margin(x), margin)


def test_quality_query_against_scoring_one_by_one(spark):
    """The registered query's rows from the same trees, walked in plain Python over each document's own statistics."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    forest = quality.fit(docs, labels)
    rows = docs.select("doc_id", "text").collect()
    want = {}
    for r in rows:
        row = quality.statistics([r["text"] or ""])[0]
        total = forest.base
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.right[node] if row[forest.feature[node]] > forest.threshold[node] else forest.left[node]
            total += forest.value[node]
        want[r["doc_id"]] = 1 / (1 + math.exp(-total))
    got = {r["doc_id"]: (r["score"], r["keep"]) for r in QUERIES["op6_quality_classifier"](spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == want.keys() and all(abs(got[i][0] - want[i]) < 1e-9 and got[i][1] == (got[i][0] >= quality.THRESHOLD) for i in want)


def test_language_query_against_predicting_one_by_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in QUERIES["op9_language_id"](spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        at, v = langid.features(r["text"] or "", model.idf)
        z = [(sum(float(v[i]) * model.weights[d, k] for i, d in enumerate(at)) + model.bias[k]) / model.temperature for k in range(len(model.languages))]
        e = [math.exp(q - max(z)) for q in z]
        best = max(range(len(z)), key=lambda k: (e[k], -k))
        assert got[r["doc_id"]]["language"] == (model.languages[best] if len(at) else None)
        assert not len(at) or abs(got[r["doc_id"]]["confidence"] - e[best] / sum(e)) < 1e-6


def test_all_statistics_against_plain_python():
    texts = ["Hello hello WORLD!\nx 12\nx 12", "", "a|b|c; d, e: f?", "é" * 300, "  \n ", "One two one two ONE #tag *x* averyveryverylongword\n\nend.", "ß8 Ñandú\tx\r\n(y) [z] 100%"]
    table = words.fold_table()
    for text, got in zip(texts, quality.statistics(texts)):
        inside = [bool(table[ord(c)]) for c in text]
        runs = [(m.start(), m.end()) for m in re.finditer("1+", "".join("01"[b] for b in inside))]
        tokens = ["".join(chr(table[ord(c)]) for c in text[a:b]) for a, b in runs]
        c, k, lines = max(1, len(text)), max(1, len(tokens)), text.split("\n")
        upper = [b and chr(table[ord(ch)]) != ch for ch, b in zip(text, inside)]
        spaces = sum(ch in " \t\r\n" for ch in text + "\n")  # with the line end that follows each text
        marks = sum(not b and ch not in " \t\r\n" for ch, b in zip(text, inside))
        share = lambda chars: sum(ch in chars for ch in text) / c
        pairs = set(zip(tokens, tokens[1:]))
        after = [(text + "\n")[b] for _, b in runs]
        want = [
            math.log1p(len(text)), math.log1p(len(tokens)), sum(map(len, tokens)) / k, sum(len(t) > 12 for t in tokens) / k, sum(inside) / c, sum(upper) / c, share("0123456789"), spaces / c,
            marks / c, share("#$%&*+<=>@^_`|~{}[]\\/"), share(".!?"), share(",;:"), sum(upper[a] for a, _ in runs) / k, sum(x in "#$%&*!|" for x in after) / k, len(set(tokens)) / k,
            math.log1p(len(set(tokens))) / math.log1p(len(tokens)) if len(tokens) > 1 else 0, sum(a == b for a, b in zip(tokens, tokens[1:])) / k,
            1 - len(pairs) / max(1, len(tokens) - 1) if len(tokens) > 1 else 0, len(pairs) / k, max(Counter(tokens).values(), default=0) / k, math.log1p(len(lines)), len(text) / len(lines),
            1 - len(set(lines)) / len(lines), marks / k, share("|"), sum(ord(ch) > 127 for ch in text) / c, sum(len(t) <= 2 for t in tokens) / k, min(60, max(map(len, tokens), default=0)),
        ]
        assert np.allclose(got, want), [(n, a, b) for n, a, b in zip(quality.FEATURES, got, want) if not np.isclose(a, b)]


def test_language_edges(spark):
    got = {(r["doc_id"], r["language"], r["confidence"]) for r in langid.identify(clashing(odd_rows(spark))).collect()}
    assert (1, None, 0.0) in got and (2, None, 0.0) in got and any(g[0] == 4 and g[1] == "en" for g in got)
    assert langid.identify(docs_of(spark, [])).count() == 0
    unlabelled = docs_of(spark, [(1, "abc", None)])
    assert langid.identify(unlabelled).first()["language"] is None


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert after.columns == docs.columns
            assert 0 < after.count() <= before.count()
        before = after
    assert sorted(r["position"] for r in before.collect()) == list(range(before.count()))
    assert rows_of(corpus_pipeline.run(spark, SF)) == rows_of(before)


def plain_pipeline(docs, items, forest):
    """The rows of the pipeline from lists of documents (doc_id, text, lang, source, n_chars), stage by stage in plain Python."""

    def good(text):
        row, total = quality.statistics([text or ""])[0], forest.base
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.right[node] if row[forest.feature[node]] > forest.threshold[node] else forest.left[node]
            total += forest.value[node]
        return 1 / (1 + math.exp(-total)) >= quality.THRESHOLD

    docs = [d for d in docs if good(d[1])]

    signed = minhash.signatures([d[1] for d in docs])
    pairs = [(i, int(j)) for i in range(len(docs)) for j in np.flatnonzero(np.count_nonzero(signed[:i] != signed[i], axis=1) <= minhash.MAX_DISTANCE)]
    first = {}
    for i, root in enumerate(components_of(len(docs), pairs)):
        first[root] = min(first.get(root, i), i, key=lambda k: docs[k][0])
    docs = [docs[i] for i in sorted(first.values())]

    phrases = set()
    for item in items:
        w = [x.lower() for x in re.findall(r"[^\W_]+", item)]
        n = min(decontaminate.PHRASE_WORDS, len(w))
        phrases |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    assert min(map(len, phrases)) >= decontaminate.SHORT_WORDS
    clean = []
    for doc_id, text, lang, source, n_chars in docs:
        found = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W_]+", text)]
        tokens = [f[2] for f in found]
        gone = bytearray(len(text))
        for n in {len(p) for p in phrases}:
            for i in range(len(tokens) - n + 1):
                if tuple(tokens[i : i + n]) in phrases:
                    a, b = found[i][0], found[i + n - 1][1]
                    gone[a:b] = b"1" * (b - a)
        if any(gone):
            text = "".join(c for c, g in zip(text, gone) if not g)
            n_chars = len(text)
            if not any(c.isalnum() for c in text):
                continue
        clean.append((doc_id, text, lang, source, n_chars))

    mixture, leaves = mixing.MIXTURE, {}
    domain_of = {s: d for d, sources in mixture.domains.items() for s in sources}
    for d in clean:
        leaves.setdefault((domain_of.get(d[3], mixture.other_domain), d[2], d[3]), []).append((len(re.findall(r"[^ \t\n\r\f]+", d[1])), d))
    tokens = {k: sum(n for n, _ in v) for k, v in leaves.items()}

    def split(budget, weights, children):
        rest, full, out = sum(weights[c] for c in children), 0, {}
        order = sorted(children, key=lambda c: (children[c] / weights[c], c))
        for i, c in enumerate(order):
            if (budget - full) * weights[c] < children[c] * rest:
                return out | {x: (budget - full) * weights[x] // rest for x in order[i:]}
            out[c], full, rest = children[c], full + children[c], rest - weights[c]
        return out

    def caps(level, *above):
        out = Counter()
        for k, n in tokens.items():
            if k[: len(above)] == above:
                out[k[level]] += n * mixture.max_epochs
        return out

    class Weights(dict):
        def __init__(self, known, other):
            super().__init__(known)
            self.other = other

        def __missing__(self, _):
            return self.other

    chosen = []
    num, den = mixture.budget
    for domain, a in split(sum(tokens.values()) * num // den, Weights(mixture.domain_weights, mixture.other_domain_weight), caps(0)).items():
        for lang, b in split(a, Weights(mixture.language_weights, mixture.other_weight), caps(1, domain)).items():
            for source, c in split(b, Weights(mixture.source_weights, mixture.other_weight), caps(2, domain, lang)).items():
                rows, (full, left) = leaves[domain, lang, source], divmod(c, tokens[domain, lang, source])
                chosen += [d for _, d in rows] * full
                for n, d in sorted(rows, key=lambda r: (hashlib.md5(f"{mixing.SEED}:{full}:{r[1][0]}".encode()).hexdigest(), r[1][0])):
                    if n > left:
                        break
                    left -= n
                    chosen.append(d)

    strata = {}
    for d in chosen:
        strata.setdefault("=" + d[3], []).append((hashlib.md5(f"{sharding.SEED}:{d[0]}".encode()).hexdigest(), d[0], d))
    ranked = [((r + 0.5) / len(v), k, key, i, d) for k, v in strata.items() for r, (key, i, d) in enumerate(sorted(v))]
    return [(*d, place * sharding.N_SHARDS // len(ranked), place) for place, (*_, d) in enumerate(sorted(ranked))]


def test_pipeline_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    want = plain_pipeline(rows, items, quality.fit(docs, labels))
    got = corpus_pipeline.run(spark, sf).select("doc_id", "text", "lang", "source", "n_chars", "shard_id", "position")
    assert rows_of(got) == sorted(want, key=repr) and len(want) > 50


def test_stages_keep_columns_of_clashing_names(spark):
    docs = clashing(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        mine = [c for c in out.columns if c not in ("shard_id", "position")] if name == "sharding" else out.columns
        assert mine == [c for c in docs.columns if name != "sharding" or c != "position"], name
        assert out.count() > 0


def test_pipeline_of_odd_rows(spark, tmp_path):
    docs = odd_rows(spark)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, str(tmp_path)).persist()
            frame.count()
    assert Counter(QUERIES).keys() >= {f"op{n}_{x}" for n, x in ((1, "sharding"), (8, "warc"))}
