"""Operator 7, token counts: an exact histogram of encoded lengths, whose suffix sums answer every context limit.

Each text is encoded whole by a public tokenizer; a task returns only how many of its documents have which length, and the
lengths are summed by key. Prefix and suffix sums run over the histogram in two levels (within buckets of lengths, then over
bucket totals), so no task holds more than one bucket or the bucket totals.

Defined results: a null or empty text has 0 tokens; repeated rows count each; an empty table gives an empty histogram;
other columns are never read. Special-token strings in a text are ordinary text. Very long texts are encoded whole; runs of
white space of RUN characters and more, which the tokenizer's pattern can't walk, are cut out as that pattern cuts them.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm import _text as X
from loomstone.llm._runtime import ship, write_table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that this vocabulary was made with (a fixed value of the public tokenizer).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of the pattern, and how long a run of it is handed to the pattern at most.
SPACE, RUN = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000", 1000
_BUCKET = 256
_ENCODINGS: dict[int, object] = {}


def encoding(raw: bytes, pattern: str = PATTERN):
    """The tokenizer of a vocabulary file's content (base64 token and rank a line); kept per process."""
    import tiktoken

    key = hash((raw, pattern))
    if key not in _ENCODINGS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        _ENCODINGS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def count(enc, text: str) -> int:
    """The number of tokens of a text: what encoding it whole gives.

    The pattern takes a run of white space as one piece without its last character, which goes on with what follows, or with
    it where the text ends. Such a piece, if long, is merged as one, and the text before and after it by themselves."""
    total = at = 0
    for m in re.finditer(f"[{SPACE}]{{{RUN},}}", text):
        total += len(enc.encode_ordinary(text[at : m.start()]))
        at = m.end() if m.end() == len(text) else m.end() - 1
        total += len(enc._encode_single_piece(text[m.start() : at]))
    return total + len(enc.encode_ordinary(text[at:]))


def histogram(documents: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length, as a written table, so that texts are encoded once however
    often it is read. The vocabulary file (1 MB) is read on the driver and broadcast."""
    spark = documents.sparkSession
    ship(spark)
    with open(vocabulary, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(raw.value, pattern)
        counts: dict[int, int] = {}
        for b in batches:
            data, offs = X.buffers(b.column("text"))
            for i in range(b.num_rows):
                n = count(enc, data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
                counts[n] = counts.get(n, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["n_tokens", "n_docs"])

    part = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "n_tokens long, n_docs long")
    out, _ = write_table(part.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")))
    raw.destroy()
    return out


def limits(hist: DataFrame) -> DataFrame:
    """One row per length L that occurs: n_docs; docs_at_most and tokens_at_most (of documents of L tokens or fewer);
    docs_longer and tokens_longer; truncated_total (tokens left if each document is cut at L); quantile (share of
    documents of L tokens or fewer). Between two rows every sum of documents and tokens stays as in the lower one, and
    truncated_total grows by docs_longer a token: at_limits() answers any limit so."""
    h = hist.withColumn("_b", F.floor(F.col("n_tokens") / _BUCKET)).withColumn("_t", F.col("n_tokens") * F.col("n_docs"))
    sums = h.groupBy("_b").agg(F.sum("n_docs").alias("_bd"), F.sum("_t").alias("_bt"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = sums.select(
        "_b", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c + "0") for c in ("_bd", "_bt")), *(F.sum(c).over(everything).alias(c + "n") for c in ("_bd", "_bt"))
    )
    own = Window.partitionBy("_b").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    x = h.withColumn("_d", F.sum("n_docs").over(own)).withColumn("_s", F.sum("_t").over(own)).join(base, "_b")
    at_d, at_t = F.col("_bd0") + F.col("_d"), F.col("_bt0") + F.col("_s")
    return x.select(
        "n_tokens", "n_docs", at_d.alias("docs_at_most"), at_t.alias("tokens_at_most"),
        (F.col("_bdn") - at_d).alias("docs_longer"), (F.col("_btn") - at_t).alias("tokens_longer"),
        (at_t + F.col("n_tokens") * (F.col("_bdn") - at_d)).alias("truncated_total"), (at_d / F.col("_bdn")).alias("quantile"),
    )


def at_limits(table: DataFrame, context: Sequence[int]) -> DataFrame:
    """One row per context limit: docs_at_most, tokens_at_most, docs_longer, truncated_total. table: from limits()."""
    spark = table.sparkSession
    asked = spark.createDataFrame([(int(c),) for c in context], "context_limit long")
    all_docs = table.agg(F.sum("n_docs").alias("_all"))
    below = table.join(F.broadcast(asked), F.col("n_tokens") <= F.col("context_limit"))
    last = below.groupBy("context_limit").agg(F.max(F.struct("n_tokens", "docs_at_most", "tokens_at_most", "docs_longer")).alias("x"))
    return asked.join(last, "context_limit", "left").crossJoin(F.broadcast(all_docs)).select(
        "context_limit",
        F.coalesce("x.docs_at_most", F.lit(0)).alias("docs_at_most"),
        F.coalesce("x.tokens_at_most", F.lit(0)).alias("tokens_at_most"),
        F.coalesce("x.docs_longer", "_all", F.lit(0)).alias("docs_longer"),
        (F.coalesce("x.tokens_at_most", F.lit(0)) + F.col("context_limit") * F.coalesce("x.docs_longer", "_all", F.lit(0))).alias("truncated_total"),
    )


def quantiles(table: DataFrame, shares: Sequence[float]) -> DataFrame:
    """One row per share in (0, 1]: the smallest length that at least this share of documents does not exceed."""
    spark = table.sparkSession
    asked = spark.createDataFrame([(float(s),) for s in shares], "share double")
    return table.join(F.broadcast(asked), F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


