"""Operator 9, mixing sources to target weights: Poisson replication.

Each source has a mean repetition rate: its target share of the mixture's bytes over its own bytes. Each document's number
of copies is the Poisson distribution of that mean inverted at a hash-seeded uniform of its doc_id, so that it depends on
nothing but the id, the rate and the seed; the copies are exploded and shuffled globally by a second hash. DataFrame functions only.

Defined results: a null source is a source of its own; a null or empty text counts one byte (each text counts its UTF-8
bytes plus 1, so that no source weighs nothing); rows that repeat a doc_id repeat alike; a null doc_id is an id of its own (all its
rows have one count) but its rows are dealt over all tasks like others; very long texts are only measured; an empty table gives an empty result; extra columns are kept whatever their names, and
`copy_no` and `rate` replace columns of those names.
Sources without a target weight (with weights given) have rate 0.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.sharding import uniform

#: Most sources whose rates are broadcast; beyond it the rates are joined by shuffle.
BROADCAST_SOURCES = 20_000


def rates(documents: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """One row per source: _source (null-safe key), rate, low (a count below which no probability is left) and cdf, the cumulative
    Poisson probabilities of low, low + 1, ... copies.

    weights: target share by source, equal shares if None. epochs: bytes of the mixture over bytes of documents.
    The probabilities run far enough into the tail that what is left out is below a double's precision.
    """
    spark = documents.sparkSession
    sizes = documents.groupBy(_key().alias("_source")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("_bytes"))
    if weights is None:
        sizes = sizes.withColumn("_w", F.lit(1.0))
    else:
        given = spark.createDataFrame([("=" + k, float(v)) for k, v in weights.items()], "_source string, _w double")
        sizes = sizes.join(given, "_source", "left").withColumn("_w", F.coalesce("_w", F.lit(0.0)))
    total = sizes.agg(F.sum("_bytes").alias("_all"), F.sum("_w").alias("_ws"))
    rated = sizes.crossJoin(F.broadcast(total)).select(  # a single row
        "_source", F.coalesce(F.try_divide(F.col("_w") * epochs * F.col("_all"), F.col("_ws") * F.col("_bytes")), F.lit(0.0)).alias("rate")
    )
    return rated.withColumn("low", F.greatest(F.lit(0), F.floor(F.col("rate") - 12 * F.sqrt("rate") - 30))).withColumn("cdf", _cdf(F.col("rate"), F.col("low")))


#: Logarithms of the first factorials; from there on Stirling's series is exact to a double's precision.
_FACTORIALS = [math.lgamma(k + 1) for k in range(16)]


def _cdf(rate, low):
    """The cumulative probabilities of `low`, low + 1, ... copies, to 12 deviations and 30 above the mean: as many numbers as the
    square root of the rate times 24, each the one before and a term of its own."""
    term = lambda k: F.exp(_log_term(rate, k.cast("double")))
    start = F.struct(F.lit(0.0).alias("c"), F.array().cast("array<double>").alias("a"))
    step = lambda acc, k: F.struct((acc["c"] + term(k)).alias("c"), F.array_append(acc["a"], acc["c"] + term(k)).alias("a"))
    cdf = F.aggregate(F.sequence(low, F.ceil(rate + 12 * F.sqrt(rate) + 30)), start, step, lambda acc: acc["a"])
    return F.when(rate > 0, cdf).otherwise(F.array(F.lit(1.0)))


def _log_term(rate, k):
    """Logarithm of the Poisson probability of k."""
    some = F.greatest(k, F.lit(1.0))
    small = F.element_at(F.array(*map(F.lit, _FACTORIALS)), F.least(k, F.lit(15.0)).cast("int") + 1)
    # k! by Stirling, with the large parts of the exponent taken together before they can cancel.
    far = k - rate - k * F.log(some / rate) - 0.5 * F.log(2 * math.pi * some) - 1 / (12 * some) + 1 / (360 * some**3) - 1 / (1260 * some**5)
    return F.when(k < 16, k * F.log(rate) - rate - small).otherwise(far)


def _key():
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))


def mix(documents: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = 1.0, seed: str = "mix") -> DataFrame:
    """documents, each row as often as its Poisson count says, with copy_no (from 1) and rate, in a global hash order."""
    rated = rates(documents, weights, epochs)
    # The documents' own columns stay under one name, so that none can clash with those added here.
    kept = [c for c in documents.columns if c not in ("copy_no", "rate")]
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("doc"), _key().alias("_source"), uniform(F.lit(seed), F.col("doc_id")).alias("u"), F.monotonically_increasing_id().alias("row"))
    if rated.select("_source").count() <= BROADCAST_SOURCES:
        rated = F.broadcast(rated)
    counted = rows.join(rated, "_source").withColumn("n", F.col("low") + F.size(F.filter("cdf", lambda c: c <= F.col("u")))).where("n > 0")
    copies = counted.select("doc", "row", "rate", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy_no"))
    # By the row as well: rows without a doc_id, or with one that many share, are dealt over all tasks.
    placed = copies.withColumn("place", F.xxhash64(F.lit(seed), "doc.doc_id", "copy_no", "row"))
    return placed.repartition("place").sortWithinPartitions("place").select("doc.*", "rate", "copy_no")
