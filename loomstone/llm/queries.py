"""The driver's queries over the training-data operators: one opN_<name> each, over whole tables, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomstone.llm import decontamination, embedding_dedup, jaccard_join, language_id, mixing, oracles, secret_scan, sharding, substring_dedup, token_counts, toxicity, vector_codes, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of chunks that occur in two documents or more, with the document and place of the first copy."""
    return substring_dedup.spans(_table(spark, sf_dir, "documents")).drop("row_key")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to 16 shards by rendezvous hashing, and to 17."""
    return sharding.manifest(_table(spark, sf_dir, "documents"), 16)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and kept vectors at a cosine of 0.9 over all embeddings."""
    return embedding_dedup.links(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in a 10-word window of a benchmark item."""
    found = decontamination.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), size=10)
    return decontamination.report(found).drop("n_near_items")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = _table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of encoded lengths with prefix and suffix sums at each length."""
    return token_counts.limits(token_counts.histogram(_table(spark, sf_dir, "documents")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents mixed to equal byte shares of all sources, as many bytes as before."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return jaccard_join.classes(_table(spark, sf_dir, "documents"), k=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings coded over integer codebooks of 4 parts and 256 entries after 4 rounds."""
    return vector_codes.encode(_table(spark, sf_dir, "embeddings")).drop("label")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings projected on the first 16 whitened components."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document."""
    return secret_scan.digest(secret_scan.spans(_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_sharding, op3_embedding_dedup, op4_decontamination, op5_language_id, op6_toxicity, op7_token_counts, op8_jaccard_join, op9_mixing, op10_warc, op11_vector_codes, op12_whitening, op13_secret_scan)}


def oracle_sql() -> dict[str, str]:
    """The others train a model, cut by a hash or need a tokenizer: they are tested against brute force, round trips or held-out rows."""
    return dict(oracles.SQL)
