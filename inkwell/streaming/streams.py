"""Streams of text files: mapped lines, distinct lines, n-gram counts. The stateful forms go beyond the batch engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkwell.functions.text import is_excluded, normalized_line
from inkwell.operators.ngrams import ngram_counts, pmi_scores, top_ngrams
from inkwell.runtime import shared_path


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(line) of the text files that appear in a folder."""
    return spark.readStream.option("lineSep", "\n").text(folder).withColumnRenamed("value", "line")


def normalized_stream(lines: DataFrame, form: str = "NFKC", min_length: int = 0, max_length: int = 0) -> DataFrame:
    """(line): filtered and normalized lines; stateless."""
    done = lines.where(~is_excluded(F.col("line"), min_length, max_length)).select(normalized_line(F.col("line"), form).alias("line"))
    return done.where("line IS NOT NULL AND line <> ''").where(~is_excluded(F.col("line"), min_length, max_length))


def distinct_stream(lines: DataFrame, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each line once. Without ``time`` the state grows with the distinct lines; with it, repeats within ``delay`` go."""
    if time is None:
        return lines.dropDuplicates(["line"])
    return lines.withWatermark(time, delay).dropDuplicatesWithinWatermark(["line"])


def ngram_stream(lines: DataFrame, n: int) -> DataFrame:
    """(ngram, frequency) so far; for output modes complete and update. Tasks count before the state's shuffle, as in the batch engine."""
    return ngram_counts(lines, n)


def windowed_counts(lines: DataFrame, time: str, window: str, delay: str) -> DataFrame:
    """(start, lines): lines for each window of event time; late lines beyond ``delay`` are dropped."""
    grouped = lines.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("lines")).select(F.col("w.start").alias("start"), "lines")


def start_pmi(lines: DataFrame, n: int, min_freq: int, top_k: int, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Recompute the best n-grams after each batch of ``lines`` and hand them to ``sink``."""

    def score(counts: DataFrame, epoch: int) -> None:
        sink(top_ngrams(pmi_scores(counts, n, min_freq), top_k), epoch)

    writer = ngram_stream(lines, n).writeStream.outputMode("complete").foreachBatch(score)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there into a table in the shared folder, and return the table.

    In the modes ``complete`` and ``update`` each batch is a table of its own;
    of ``complete`` the last one is returned, of ``update`` all.
    """
    spark = df.sparkSession
    path = shared_path(spark, "stream")
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    last: list[int] = []

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table/epoch={epoch}")
        last.append(epoch)

    if mode == "append":
        query = writer.format("parquet").option("path", f"{path}/table").start()
    else:
        query = writer.foreachBatch(write).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(df.schema).parquet(f"{path}/table")
    if not last:
        return spark.createDataFrame([], df.schema)
    epochs = [last[-1]] if mode == "complete" else sorted(set(last))
    return spark.read.schema(df.schema).parquet(*[f"{path}/table/epoch={e}" for e in epochs])
