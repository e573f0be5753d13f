"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.decontaminate import contaminated
from inkwell.llm.langid import identify
from inkwell.llm.license_scan import scan_licenses
from inkwell.llm.line_dedup import LONG_WORDS, dedup_lines
from inkwell.llm.minhash import near_groups
from inkwell.llm.mixing import mix
from inkwell.llm.pivots import near_vectors
from inkwell.llm.quality import score_quality
from inkwell.llm.sharding import assign_shards
from inkwell.llm.warc import chunk_pages, portable

#: What is added to a vector's id for its copy.
COPY_IDS = 1_000_000_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op2_embedding_near_dedup_copied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the vectors and a copy of each: every fifth copy is equal, the others have their numbers scaled by 0.7, 1 and 1.3 in turn."""
    own = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    scaled = F.transform("embedding", lambda x, i: x.cast("double") * (1 + (F.pmod(F.col("vec_id") + i, F.lit(3)) - 1) * F.lit(0.3)))
    copy = own.select((F.col("vec_id") + COPY_IDS).alias("vec_id"), F.when(F.col("vec_id") % 5 == 0, F.col("embedding").cast("array<double>")).otherwise(scaled).alias("embedding"))
    return near_vectors(own.withColumn("embedding", F.col("embedding").cast("array<double>")).union(copy))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents"))


def op7_line_dedup_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long lines that more than one document has go as well."""
    return dedup_lines(_table(spark, sf_dir, "documents"), long_words=LONG_WORDS)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(chunk_pages(_table(spark, sf_dir, "pages")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_embedding_near_dedup, op2_embedding_near_dedup_copied, op3_minhash_near_dedup, op4_decontamination, op5_source_mixing, op6_quality_classifier, op7_line_dedup, op7_line_dedup_by_length, op8_warc, op9_language_id, op10_license_scan)}
