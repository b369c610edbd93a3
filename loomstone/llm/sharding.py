"""Operator 2, sharding: rendezvous hashing of stable record keys over weighted shards. DataFrame functions only.

Each (key, shard) pair has a hash-seeded uniform u; the shard with the largest weight / -ln(u) takes the record. A new
shard therefore only takes records into itself, and each shard's share follows its weight.

Defined results: a null doc_id is a key of its own; a null text has size 1 and checksum 0; repeated rows get slots of their
own, and are numbered in buckets by their place in the table, so that no task has all rows of one key; an empty table gives an
empty result; very long texts are only measured and summed; extra columns are kept by assign(), whose `shard` replaces a column
of that name, and left out of manifest().
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm._runtime import keyed


def uniform(*parts: Column) -> Column:
    """A uniform double in (0, 1) from the md5 of the parts; null parts count as text of their own. 52 bits, never 0 or 1."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\x00null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def scores(key: Column, weights: Sequence[float], salt: str = "shard") -> Column:
    """An array of (score, shard) of a key, for shards 0, 1, ... of the given weights above 0."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be above 0, one at least")
    return F.array(*[F.struct((F.lit(float(w)) / -F.log(uniform(F.lit(salt), key, F.lit(i)))).alias("s"), F.lit(i).alias("i")) for i, w in enumerate(weights)])


def rendezvous(key: Column, weights: Sequence[float], salt: str = "shard") -> Column:
    """The number of the shard that takes a key."""
    return F.array_max(scores(key, weights, salt))["i"]


def with_slots(df: DataFrame, shard: str, order: Sequence[str], bucket_key: Column, rows_per_bucket: int = 100_000) -> DataFrame:
    """df with `slot`: gapless from 0 within each shard. Rows are numbered within hash buckets of bounded expected size,
    and each bucket starts where the ones before end; so no task holds a whole shard."""
    n_buckets = max(1, -(-df.count() // rows_per_bucket))
    parted = df.withColumn("_bucket", F.pmod(bucket_key, F.lit(n_buckets)))
    totals = parted.groupBy(shard, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(shard, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy(shard, "_bucket").orderBy(*order)
    numbered = parted.withColumn("_at", F.row_number().over(own))
    return numbered.join(base, [shard, "_bucket"]).withColumn("slot", F.col("_base") + F.col("_at") - 1).drop("_bucket", "_base", "_at")


def assign(documents: DataFrame, weights: Sequence[float], salt: str = "shard") -> DataFrame:
    """documents with `shard` (int), by doc_id and weights alone."""
    return documents.withColumn("shard", rendezvous(F.col("doc_id"), weights, salt))


def manifest(documents: DataFrame, shards: int = 16, salt: str = "shard") -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot, grown_shard (with one shard more)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = keyed(documents).select(
        F.col("doc_id"),
        F.col("row_key"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        scores(F.col("doc_id"), [1.0] * (shards + 1), salt).alias("scores"),
    )
    # One set of scores answers for both numbers of shards: the new shard only adds its own.
    best = lambda a: F.array_max(a)["i"].cast("int")
    rows = rows.withColumn("shard", best(F.slice("scores", 1, shards))).withColumn("grown_shard", best(F.col("scores"))).drop("scores")
    out = with_slots(rows, "shard", ["doc_id", "text_crc32", "size", "row_key"], F.xxhash64("row_key"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
