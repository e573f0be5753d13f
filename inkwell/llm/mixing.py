"""Operator 5: mix sources to target weights by hierarchical budgeting.

The token budget is split along a tree domain > language > source. Each node
divides its budget among its children by their weights; a child gets at most
its capacity (its tokens times ``max_epochs``), and what it can't take is shared
by its siblings by their weights. A shortage leaves a node only when all of its
children are full, since a node's capacity is the sum of its children's.

A leaf's budget is spent on seeded epochs: whole passes over its documents, then
the prefix of one more pass, in that epoch's own seeded order, whose running
token sum stays within what is left. The running sums are exact and distributed
(:func:`common.with_prefix`). All arithmetic is on integers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import bucket_bits, key_bucket, picked, with_prefix, written

SEED = "mix-1"


@dataclass(frozen=True)
class Mixture:
    """Weights are positive integers; what a level doesn't name gets ``other``."""

    domains: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "web": ("src0", "src1", "src2", "src3", "src4", "src5"),
            "books": ("src6", "src7", "src8", "src9", "src10"),
            "reference": ("src11", "src12", "src13", "src14", "src15"),
        }
    )
    domain_weights: dict[str, int] = field(default_factory=lambda: {"web": 50, "books": 20, "reference": 20})
    language_weights: dict[str, int] = field(default_factory=lambda: {"en": 60, "de": 15, "fr": 15, "es": 10})
    source_weights: dict[str, int] = field(default_factory=lambda: {"src0": 3})
    other_domain: str = "other"
    other_domain_weight: int = 10
    other_weight: int = 1
    #: The budget as a share of all tokens.
    budget: tuple[int, int] = (8, 10)
    max_epochs: int = 2


MIXTURE = Mixture()
#: Leaves whose plan is handed to every task.
BROADCAST_LEAVES = 200_000


def _case(column: str, values: dict[str, str | int], other: str | int) -> str:
    """A SQL expression that both Spark and the oracle understand."""
    quote = lambda v: "'" + str(v).replace("'", "''") + "'"
    show = lambda v: quote(v) if isinstance(v, str) else str(v)
    whens = " ".join(f"WHEN {column} = {quote(k)} THEN {show(v)}" for k, v in values.items())
    return f"CASE {whens} ELSE {show(other)} END" if whens else show(other)


def domain_sql(m: Mixture) -> str:
    return _case("source", {s: d for d, sources in m.domains.items() for s in sources}, m.other_domain)


def weight_sql(m: Mixture) -> dict[str, str]:
    return {
        "domain": _case("domain", m.domain_weights, m.other_domain_weight),
        "lang": _case("lang", m.language_weights, m.other_weight),
        "source": _case("source", m.source_weights, m.other_weight),
    }


def token_count(text: Column) -> Column:
    """Tokens are runs of characters other than ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r\\f]+")), F.lit(0)).cast("long")


def _filled(children: DataFrame, parent: list[str], name: str, weight: str) -> DataFrame:
    """Split each parent's ``budget`` among its children of capacity ``cap``: adds ``share``.

    Children fill up in the order of capacity by weight. Those before the first
    one that doesn't fill get their capacity; the others share the rest by weight.
    """
    rows = children.withColumn("w", F.expr(weight).cast("long"))
    order = [F.col("cap") / F.col("w"), F.col(name)]
    up = Window.partitionBy(*parent).orderBy(*order)
    rows = rows.withColumns(
        {
            "full": F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "rest": F.sum("w").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    rows = rows.withColumn("open", F.expr("(budget - full) * w < cap * rest"))
    group = Window.partitionBy(*parent)
    rows = rows.withColumns(
        {
            "full": F.min(F.when(F.col("open"), F.col("full"))).over(group),
            "rest": F.max(F.when(F.col("open"), F.col("rest"))).over(group),
        }
    )
    share = F.when(F.col("open"), F.expr("(budget - full) * w div rest")).otherwise(F.col("cap"))
    return rows.withColumn("share", share).drop("w", "full", "rest", "open", "budget")


def leaf_budgets(tokens: DataFrame, mixture: Mixture = MIXTURE) -> DataFrame:
    """(domain, lang, source, tokens, budget) for every leaf of ``tokens`` (domain, lang, source, n_tokens)."""
    leaves = tokens.groupBy("domain", "lang", "source").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    leaves = leaves.withColumn("cap", F.col("tokens") * mixture.max_epochs)
    num, den = mixture.budget
    weights = weight_sql(mixture)
    total = leaves.agg(F.expr(f"sum(tokens) * {num} div {den}").alias("budget"))
    domains = leaves.groupBy("domain").agg(F.sum("cap").alias("cap")).crossJoin(F.broadcast(total)).withColumn("all", F.lit(1))
    domains = _filled(domains, ["all"], "domain", weights["domain"]).select("domain", F.col("share").alias("budget"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(domains, "domain")
    langs = _filled(langs, ["domain"], "lang", weights["lang"]).select("domain", "lang", F.col("share").alias("budget"))
    out = _filled(leaves.join(langs, ["domain", "lang"]), ["domain", "lang"], "source", weights["source"])
    return out.select("domain", "lang", "source", "tokens", F.col("share").alias("budget"))


def _leafed(docs: DataFrame, mixture: Mixture) -> DataFrame:
    rows = picked(docs, doc_id="doc_id", text="text", lang="lang", source="source")
    rows = rows.select("doc_id", F.xxhash64("text").alias("content"), token_count(F.col("text")).alias("n_tokens"), F.coalesce("lang", F.lit("(none)")).alias("lang"), F.coalesce("source", F.lit("(none)")).alias("source"))
    return rows.withColumn("domain", F.expr(domain_sql(mixture)))


LEAF = ["domain", "lang", "source"]
#: The order of a leaf's documents in the epoch that is cut.
ORDER = ["key", "doc_id", "n_tokens", "content"]


def _planned(docs: DataFrame, mixture: Mixture, seed: str) -> tuple[DataFrame, DataFrame]:
    """Documents without texts, and the leaves' whole epochs ``full`` with the tokens ``left`` for the cut one."""
    rows = written(_leafed(docs, mixture), "mix-tokens")
    budgets = leaf_budgets(rows, mixture)
    return rows, written(budgets.select(*LEAF, F.expr("budget div tokens").alias("full"), F.expr("budget % tokens").alias("left")), "mix-budgets")


def _cut_key(seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def _by_leaf(rows: DataFrame, leaves: DataFrame, most: int) -> DataFrame:
    """``rows`` with the columns of ``leaves``, without a shuffle where these are at most ``most``."""
    return rows.join(F.broadcast(leaves) if leaves.count() <= most else leaves, LEAF)


def _cut(rows: DataFrame, spent: DataFrame, seed: str, most: int) -> DataFrame:
    """The documents of each leaf's cut epoch in its seeded order, with the tokens up to each as ``sum``."""
    part = _by_leaf(rows, spent.where("left > 0"), most).withColumn("key", _cut_key(seed))
    part = part.withColumn("bucket", key_bucket(F.col("key"), bucket_bits(rows.count())))
    return with_prefix(part, LEAF, "bucket", [F.col(c) for c in ORDER], F.col("n_tokens"), "sum")


def mix(docs: DataFrame, mixture: Mixture = MIXTURE, seed: str = SEED) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, epoch): one row for each use of a document.

    Null languages and sources are leaves named ``(none)``. Texts that are null,
    empty or blank have no tokens; they come with whole epochs, and in the last
    epoch where the order puts them within the prefix. Very long texts count
    with all their tokens. A leaf without any token is left out. Rows that repeat
    an id are documents of their own. Null ids are kept. An empty table gives no
    rows. Other columns are ignored, whatever their names.
    """
    rows, spent = _planned(docs, mixture, seed)
    columns = ["doc_id", *LEAF, "n_tokens", "epoch"]
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("epoch")
    whole = _by_leaf(rows, spent.where("full > 0"), BROADCAST_LEAVES).select("doc_id", *LEAF, "n_tokens", epochs)
    part = _cut(rows, spent, seed, BROADCAST_LEAVES).where("sum <= left").withColumn("epoch", F.col("full"))
    return whole.select(*columns).unionByName(part.select(*columns))


def mix_documents(docs: DataFrame, mixture: Mixture = MIXTURE, seed: str = SEED, broadcast_leaves: int = BROADCAST_LEAVES) -> DataFrame:
    """``docs`` as mixed by :func:`mix`: each row as often as it was chosen, possibly never.

    What a leaf takes of its cut epoch is a prefix of a seeded order, so the last
    document taken tells for each row whether it is in, and no text is moved. Of
    rows that are equal in id, text and leaf, and at the very end of the prefix, as
    many come out as were chosen. Null, empty and very long texts, null ids, repeated
    rows and empty tables are as in :func:`mix`; columns of any other name are kept.
    Up to ``broadcast_leaves`` leaves are handed to all tasks, more are joined.
    """
    rows, spent = _planned(docs, mixture, seed)
    part = _cut(rows, spent, seed, broadcast_leaves).select(*LEAF, F.struct(*ORDER).alias("at"), (F.col("sum") <= F.col("left")).alias("taken"))
    part = written(part, "mix-order")
    last = written(part.where("taken").groupBy(*LEAF).agg(F.max("at").alias("last")), "mix-last")
    equal = _by_leaf(part, last, broadcast_leaves).where("at = last").groupBy(*LEAF).agg(F.count(F.lit(1)).alias("alike"), F.count_if("taken").alias("some"))
    plan = written(spent.join(last, LEAF, "left").join(equal, LEAF, "left"), "mix-plan")
    names = docs.columns
    at = {n: F.col(f"__c{names.index(n)}") for n in ("doc_id", "text", "lang", "source")}
    raw = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    nothing = F.lit("(none)")
    raw = raw.withColumns({"doc_id": at["doc_id"], "lang": F.coalesce(at["lang"], nothing), "source": F.coalesce(at["source"], nothing)})
    placed = _by_leaf(raw.withColumn("domain", F.expr(domain_sql(mixture))), plan, broadcast_leaves).withColumn("key", _cut_key(seed))
    # texts are only looked at where the key is that of the last document
    end, place = F.col("last.key"), F.struct("key", "doc_id", token_count(at["text"]).alias("n_tokens"), F.xxhash64(at["text"]).alias("content"))
    taken = F.when(end.isNull() | (F.col("key") > end), F.lit(False)).when(F.col("key") < end, F.lit(True)).otherwise(place <= F.col("last"))
    split = F.when(end.isNull() | (F.col("key") != end), F.lit(False)).otherwise((place == F.col("last")) & (F.col("some") < F.col("alike")))
    kept = [F.col(f"__c{i}").alias(n) for i, n in enumerate(names)]
    use = F.explode(F.sequence(F.lit(1), F.col("times")))
    out = placed.where(~split).withColumn("times", F.col("full").cast("int") + taken.cast("int")).where("times > 0").withColumn("use", use)
    if plan.where("some < alike").isEmpty():
        return out.select(*kept)
    ends = placed.where(split).select(*LEAF, "some", "full", *[f"__c{i}" for i in range(len(names))])
    ends = written(ends.withColumn("nth", F.monotonically_increasing_id()), "mix-ends")
    ends = ends.withColumn("bucket", F.shiftright("nth", 33))  # the task that wrote it
    ends = with_prefix(ends, LEAF, "bucket", [F.col("nth")], F.lit(1).cast("long"), "place")
    ends = ends.withColumn("times", F.col("full").cast("int") + (F.col("place") <= F.col("some")).cast("int")).where("times > 0").withColumn("use", use)
    return out.select(*kept).union(ends.select(*kept))
