"""Operator 1: proportional stratified interleaving into shards.

Rows are shuffled by a seeded hash and ranked within their source. A row of
rank r among n rows has the fractional rank (r - 1/2) / n. Sorted by fractional
rank, every stretch of the order holds the sources in the proportions of the
whole, so cutting the order into equal pieces gives shards that all match the
mixture. No shard differs from another by more than one row in size.

Both rankings are running counts over buckets of the order key
(:func:`common.with_prefix`), so no task sorts a whole source or the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import bucket_bits, key_bucket, order_key, picked, with_prefix

N_SHARDS = 64
SEED = "shards-1"


def assign_shards(
    docs: DataFrame,
    n_shards: int = N_SHARDS,
    seed: str = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    bucket_rows: int = 50_000,
) -> DataFrame:
    """(doc_id, source, shard_id, position) for every row of ``docs``.

    ``position`` counts from 0 over all shards in order, and each shard holds
    the rows of consecutive positions.

    Null or empty sources are strata of their own. Null ids are ordinary ids.
    Rows of one id and source get adjacent ranks and are interchangeable.
    An empty table gives no rows. Other columns are ignored, whatever their
    names; texts aren't read.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    rows = picked(docs, doc_id=id_col, source=source_col)
    total = rows.count()
    bits = bucket_bits(total, bucket_rows)
    key = order_key(seed, F.col("doc_id"))
    rows = rows.select(
        "doc_id",
        "source",
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("!")).alias("__stratum"),
        key.alias("__key"),
        key_bucket(key, bits).alias("__bucket"),
    )
    sizes = rows.groupBy("__stratum").agg(F.count(F.lit(1)).alias("__n"))
    ranked = with_prefix(rows, ["__stratum"], "__bucket", [F.col("__key"), F.col("doc_id")], F.lit(1).cast("long"), "__rank")
    spread = (
        ranked.join(sizes, "__stratum")
        .withColumn("__frac", (F.col("__rank") - F.lit(0.5)) / F.col("__n"))
        .withColumn("__all", F.lit(0))
        .withColumn("__bucket", F.floor(F.col("__frac") * F.lit(float(2**bits))))
    )
    order = [F.col(c) for c in ("__frac", "__stratum", "__key", "doc_id")]
    placed = with_prefix(spread, ["__all"], "__bucket", order, F.lit(1).cast("long"), "__place")
    position = F.col("__place") - 1
    return placed.select(
        "doc_id",
        "source",
        F.expr(f"(__place - 1) * {n_shards} div {max(1, total)}").cast("long").alias("shard_id"),
        position.cast("long").alias("position"),
    )


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, seed: str = SEED) -> DataFrame:
    """``docs`` with ``shard_id`` and ``position``; columns of those names, in any case of letters, are replaced.

    The assignment is computed without the texts, which then move once, in the
    join by ``doc_id``. Rows that repeat an id are matched to the id's
    positions in the order of their texts' hashes. Null ids and sources, and null,
    empty and very long texts are ordinary. An empty table stays empty; columns
    of any other name are kept.
    """
    names = docs.columns
    keep = [i for i, c in enumerate(names) if c.lower() not in ("shard_id", "position")]
    at = names.index("doc_id")
    raw = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    nth = Window.partitionBy("__id", "__source")
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("__id"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("!")).alias("__source")]
    placed = assign_shards(docs, n_shards, seed).select(*key, "shard_id", "position")
    placed = placed.withColumn("__nth", F.row_number().over(nth.orderBy("position")))
    source = F.col(f"__c{names.index('source')}")
    raw = raw.withColumns({"__id": F.coalesce(F.col(f"__c{at}").cast("string"), F.lit("null")), "__source": F.coalesce(F.concat(F.lit("="), source), F.lit("!"))})
    raw = raw.withColumn("__nth", F.row_number().over(nth.orderBy(F.xxhash64(f"__c{names.index('text')}"))))
    joined = raw.join(placed, ["__id", "__source", "__nth"])
    return joined.select(*[F.col(f"__c{i}").alias(names[i]) for i in keep], "shard_id", "position")
