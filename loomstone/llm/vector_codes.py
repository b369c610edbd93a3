"""Operator 11, vector code compression: product codes of vectors over integer codebooks, exact in every step.

Components become floor(scale * x); vectors are cut into equal consecutive parts and each part gets the index of its nearest
codebook entry. A round broadcasts the integer codebooks; Arrow batches compute all squared distances by norm expansion,
|x|^2 - 2 x.c + |c|^2, from int64 matrix products, and take the first smallest; each task adds up its parts by entry, and
the sums of all tasks are merged by a grouped shuffle. The new entries are floor(sum / count). Every number is an integer, so
neither the order of rows nor that of tasks matters and a repeated task changes nothing.

The whole-number table is written once to the shared folder and read by each round. Only the codebooks (entries x dimension
numbers) come to the driver.

Defined results: vectors that are null or hold null or non-finite components are dropped; so are components of 2^150 and more in
magnitude after scaling (arrays of doubles only). Where squares could leave 64 bits the same steps run on Python integers; an
error that does not fit a long is null, and so is its label's sum. Rows that share a vec_id count each, in the order of vec_id and then
of their vector, a null vec_id after all others; equal distances go to the lower index; equal entries beyond the first stay
unused. Vectors of another length have codebooks of their own; of a length that `parts` does not divide the first parts are
one longer; an empty vector has code 0 in every part. With fewer rows than entries the codebook is as short as the table. An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm._runtime import drop_table, hot_keys, ship, spread_join, write_table
from loomstone.llm._text import tidy
from loomstone.llm._vectors import finite, matrix, merged, sum_batch, sum_rows, whole_table

#: Rows whose distances to all entries are held at once.
SLICE = 2048
#: Most labels (a key and a sum each) that are broadcast; beyond it they are joined by shuffle, hot ones over several tasks.
BROADCAST_LABELS = 100_000
_LARGEST = (1 << 63) - 1


def edges(dim: int, parts: int) -> list[int]:
    """Where the parts of a vector begin, and its end."""
    return [p * (dim // parts) + min(p, dim % parts) for p in range(parts + 1)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, the first of equally near ones; squared distance to it) of each row."""
    d = (book * book).sum(1) - 2 * (x @ book.T)
    code = d.argmin(1)
    return code, d[np.arange(len(x)), code] + (x * x).sum(1)


def _whole(x: np.ndarray, wide: bool) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) if wide else x.astype(np.int64)


def _codes(batch: pa.RecordBatch, dim: int, books: list[np.ndarray], wide: bool) -> Iterator[tuple[int, np.ndarray, list]]:
    """For each slice of a batch: its first row, its vectors as integers, and per part (codes, squared distances)."""
    cuts, x = edges(dim, len(books)), matrix(batch.column("x"), dim)
    for lo in range(0, len(x), SLICE):
        whole = _whole(x[lo : lo + SLICE], wide)
        yield lo, whole, [nearest(whole[:, a:z], book) for a, z, book in zip(cuts, cuts[1:], books, strict=False)]


def _adder(dim: int, books, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = books.value
        cuts, kind = edges(dim, len(own)), object if wide else np.int64
        n = [np.zeros(len(b), np.int64) for b in own]
        sums = [np.zeros(b.shape, kind) for b in own]
        for batch in batches:
            for _, x, found in _codes(batch, dim, own, wide):
                for p, (code, _) in enumerate(found):
                    order = np.argsort(code, kind="stable")
                    entries, first = np.unique(code[order], return_index=True)
                    n[p] += np.bincount(code, minlength=len(own[p]))
                    if cuts[p] < cuts[p + 1]:
                        sums[p][entries] += np.add.reduceat(x[order, cuts[p] : cuts[p + 1]], first, axis=0)
        for p in range(len(own)):
            used = np.flatnonzero(n[p])
            yield sum_batch(list(sum_rows(p, used, n[p][used], sums[p][used], wide)), wide)

    return tidy(run)


def _coder(dim: int, books, wide: bool, digest: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = books.value
        for batch in batches:
            code, error = [], []
            for _, x, found in _codes(batch, dim, own, wide):
                digits = np.stack([c for c, _ in found], 1).astype(np.uint8).tobytes().hex()
                code += [digits[i : i + 2 * len(own)] for i in range(0, len(digits), 2 * len(own))]
                total = sum(e for _, e in found)
                error += [int(v) if v <= _LARGEST else None for v in total.tolist()]
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64()), pa.array([digest] * len(code), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error", "codebooks_sha256"])

    return tidy(run)


def start(rows: DataFrame, entries: int) -> list[list[float]]:
    """The vectors of the `entries` smallest vec_ids: found on the ids alone first, so that few vectors are ever sorted."""
    low = [r[0] for r in rows.where("vec_id IS NOT NULL").select("vec_id").orderBy("vec_id").limit(entries).collect()]
    near = rows.where(F.col("vec_id") <= low[-1]) if len(low) == entries else rows
    return [r["x"] for r in near.select("vec_id", "x").orderBy(F.col("vec_id").isNull(), "vec_id", "x").limit(entries).collect()]


def fit(rows: DataFrame, dim: int, wide: bool, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """The codebooks (entries x width each) of a table of whole vectors of one length, after `rounds` rounds."""
    sc = rows.sparkSession.sparkContext
    cuts = edges(dim, parts)
    found = start(rows, entries)
    first = _whole(np.array(found, float).reshape(len(found), dim), wide)
    books = [first[:, a:z].copy() for a, z in zip(cuts, cuts[1:], strict=False)]
    for _ in range(rounds):
        shared = sc.broadcast(books)
        books = [b.copy() for b in books]
        for (p, e), (n, sums) in merged(rows.select("x"), _adder(dim, shared, wide), wide, max(np.diff(cuts), default=0)).items():
            books[p][e] = [s // n for s in sums[: cuts[p + 1] - cuts[p]]]
        shared.unpersist()
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(v) for b in books for row in b.tolist() for v in row).encode()).hexdigest()


def encode(embeddings: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of each kept row of embeddings (vec_id, embedding, label).

    code: two hex digits a part; error: squared distances to the entries, summed over the parts; label_error: errors summed
    over equal labels, nulls together."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    spark = embeddings.sparkSession
    ship(spark)
    kept, e = finite(embeddings)
    # floor() gives longs; at 2^52 and beyond a double is whole anyway.
    scaled = F.transform(e, lambda c: F.when(F.abs(c * scale) < float(1 << 52), F.floor(c * scale).cast("double")).otherwise(c * scale))
    rows = kept.select(F.col("vec_id"), F.col("label"), scaled.alias("x")).where(~F.exists("x", lambda c: F.abs(c) >= 2.0**150))
    table, path, dims = whole_table(rows)
    paths, coded = [path], None
    for dim in dims:
        own = table.where(F.col("dim") == dim)
        about = own.agg(F.count("*").alias("n"), F.max(F.coalesce(F.array_max(F.transform("x", F.abs)), F.lit(0.0))).alias("top")).first()
        # Squares of differences, summed over a part and over the vector, and sums of components must stay below 2^62.
        wide = max(dim * (2 * int(about["top"])) ** 2, about["n"] * int(about["top"])) >= 1 << 62
        books = fit(own, dim, wide, parts, entries, rounds)
        shared = spark.sparkContext.broadcast(books)
        schema = f"vec_id {own.schema['vec_id'].dataType.simpleString()}, label {own.schema['label'].dataType.simpleString()}, code string, error long, codebooks_sha256 string"
        part, at = write_table(own.select("vec_id", "label", "x").mapInArrow(_coder(dim, shared, wide, digest(books)), schema))
        shared.unpersist()
        paths.append(at)
        coded = part if coded is None else coded.unionAll(part)
    if coded is None:
        coded = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit("").alias("codebooks_sha256")).where("false")
    drop_table(spark, path)
    return _with_label_errors(coded)


def _with_label_errors(coded: DataFrame) -> DataFrame:
    key = F.when(F.col("label").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    coded = coded.withColumn("key", key)
    # try_sum is null where a sum leaves 64 bits, but passes over null errors: those are counted.
    sums = coded.groupBy("key").agg(F.count("*").alias("n"), F.count("error").alias("known"), F.try_sum("error").alias("s"))
    sums, _ = write_table(sums.select("key", "n", F.when(F.col("n") == F.col("known"), F.col("s")).alias("label_error")))
    counts = sums.agg(F.count("*"), F.sum("n")).first()
    if counts[0] <= BROADCAST_LABELS:
        out = coded.join(F.broadcast(sums.drop("n")), "key")
    else:
        out = spread_join(coded, sums.drop("n"), "key", hot_keys(sums, "key", "n", counts[1]), "code")
    return out.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
