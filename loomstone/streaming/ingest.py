"""Streams of documents and events: profiles as files arrive, re-delivered sources dropped, windowed event counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import text as T
from loomstone.functions.dialect import SPARK as D
from loomstone.operators import profile as PR


def documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long", files_per_trigger: int = 50) -> DataFrame:
    """A folder of Parquet documents as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def profiles(stream: DataFrame) -> DataFrame:
    """Stateless profiling: words, signal counts, language and whether the source is blocked, per document as it comes."""
    sampled = stream.withColumn("sample", F.substring("text", 1, 4000))
    hits = sampled.withColumn("pt_hits", F.expr(T.portuguese_hits(D, "sample"))).withColumn("en_hits", F.expr(T.english_hits(D, "sample")))
    return hits.select(
        "doc_id", F.expr(T.word_count(D, "text")).alias("words"), "pt_hits", "en_hits",
        F.expr(PR.language(D, "sample", "pt_hits", "en_hits")).alias("detected_language"), F.expr(PR.blocked(D, "text")).alias("blocked"),
    )


def unique_sources(stream: DataFrame, time: str = "ts", within: str = "1 hour") -> DataFrame:
    """Drops a text that was delivered before, by its digest, as long as the watermark keeps it in state."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withColumn("digest", F.sha2("text", 256)).withWatermark(time, within).dropDuplicatesWithinWatermark(["digest"])


def event_counts(stream: DataFrame, time: str = "ts", length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event type in tumbling windows; late events count until the watermark passes."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def merge_into(table: str):
    """A foreachBatch sink that appends each batch once: a batch id that is in the table already is not written again."""

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if spark.catalog.tableExists(table) and not spark.table(table).where(F.col("batch_id") == batch_id).isEmpty():
            return
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").saveAsTable(table)

    return put
