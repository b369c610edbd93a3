"""Corpus pipeline over `documents`: STAGES in order, each by one training-data operator, each on all that the one before kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet and reads it again.
A document is a row: stages that drop rows decide by a row key (the file and place of a row of a Parquet table; anything else is
written with one first), so rows without a doc_id or with a shared one are judged by their own text. Only the shard is by
doc_id, which drops nothing.

In every stage an empty table gives an empty result, very long texts are read whole, columns that are not used are kept whatever
their names, and a null source or lang is a value like others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import decontamination, jaccard_join, mixing, sharding, toxicity
from loomstone.llm._runtime import free_name, keyed, shared_dir, write_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Most row keys (8 bytes each) that are broadcast; beyond it documents and keys are joined by shuffle.
BROADCAST_IDS = 500_000


def _rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a row key, and the key's name, which no column of docs has."""
    key = free_name(docs, "row_key")
    return keyed(docs, key), key


def _by_row(rows: DataFrame, key: str) -> DataFrame:
    """Keyed rows as the operators read them: under their row key instead of their doc_id."""
    return rows.select(F.col(key).alias("doc_id"), "text")


def _marked(keys: DataFrame) -> DataFrame:
    """A single column of distinct row keys, written, and broadcast where they are few."""
    few, _ = write_table(keys)
    return F.broadcast(few) if few.count() <= BROADCAST_IDS else few


def _without(rows: DataFrame, key: str, rejected: DataFrame, columns: list[str]) -> DataFrame:
    """Keyed rows but those whose row key is in `rejected` (under the name doc_id), without the key."""
    return rows.join(_marked(rejected.select(F.col("doc_id").alias(key))), key, "left_anti").select(*(f"`{c}`" for c in columns))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below 0.5. Null and empty texts have the score of a text without evidence, which
    is that of clean ones; equal texts are kept or dropped alike; a score of exactly 0.5 rejects."""
    rows, key = _rows(docs)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(rows, key, toxicity.score(_by_row(rows, key), model).where("predicted = 1"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8: that of the smallest doc_id, one
    without a doc_id only if none has it, and of several rows with that doc_id the first by row key. Rows without text or words
    link with nothing and all stay."""
    rows, key = _rows(docs)
    found, _ = write_table(jaccard_join.classes(_by_row(rows, key), k=5, num=8, den=10).select(F.col("doc_id").alias("row"), "component_id"))
    named = found.join(rows.select(F.col(key).alias("row"), "doc_id"), "row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first"))
    rejected = found.join(first.select(F.col("first.row").alias("row")), "row", "left_anti")
    return _without(rows, key, rejected.select(F.col("row").alias("doc_id")), docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a 10-word window of a benchmark item (or all words of a shorter one). Null and empty texts have none and
    stay; equal texts are kept or dropped alike; items without text have no windows."""
    rows, key = _rows(docs)
    found = decontamination.matches(_by_row(rows, key), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10)
    return _without(rows, key, found.where("n_hit > 0"), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources have equal shares of the bytes. The first row of a doc_id draws its count by
    the doc_id, others and those without one by their row key as well: one draw never decides on several documents. A null or
    empty text counts one byte; all rows without a source are one source."""
    rows, key = _rows(docs)
    ids = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low < high")
    again = rows.select("doc_id", F.col(key).alias("row")).join(ids.select("doc_id", "low"), "doc_id").where("row > low")
    # The documents' own columns stay under one name, so that none can clash with those added here.
    whole = rows.select(F.col(key).alias("row"), "doc_id", "text", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"))
    drawn = whole.join(_marked(again.select("row")).withColumn("again", F.lit(True)), "row", "left")
    own = F.when(F.col("doc_id").isNotNull() & F.col("again").isNull(), F.col("doc_id").cast("string")).otherwise(F.concat_ws("|", "doc_id", F.lit("row"), "row"))
    return mixing.mix(drawn.select(own.alias("doc_id"), "text", "source", "whole")).select("whole.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard of 16, by doc_id: rows that share one, or have none, share a shard. A column `shard` is replaced."""
    return sharding.assign(docs, [1.0] * 16)


STAGES = [
    ("toxicity", reject_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]
#: Trained models and similarity joins are not expressible in SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all STAGES to documents, each result written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
