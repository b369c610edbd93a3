"""Vectors as whole numbers: the table that the vector operators read again and again, and exact sums over its rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm._runtime import shared_dir

#: Sums of so many positions travel in one row.
WIDTH = 16
_SUMS = [f"s{i}" for i in range(WIDTH)]


def finite(embeddings: DataFrame) -> tuple[DataFrame, Column]:
    """The rows whose vector is neither null nor holds null or non-finite components, and the vector as doubles."""
    e = F.col("embedding").cast("array<double>")
    odd = F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return embeddings.where(e.isNotNull() & ~odd), e


def whole_table(rows: DataFrame) -> tuple[DataFrame, str, list[int]]:
    """Write rows (with a column x, a vector) to the shared folder, vectors of each length apart: (table with its column dim,
    path, lengths). Later passes read only what they need of it, and a lost executor costs a read and no recount."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    dealt = rows.withColumn("dim", F.size("x"))
    schema = dealt.schema
    dealt.write.partitionBy("dim").parquet(path)
    table = spark.read.schema(schema).parquet(path)
    return table, path, sorted(r["dim"] for r in table.select("dim").distinct().collect())


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """A list column without nulls whose lists are all of length dim, as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def sum_rows(part: int, entry: np.ndarray, n: np.ndarray, sums: np.ndarray, wide: bool) -> Iterator[dict]:
    """What a task adds to the sums of the entries of a part, in rows of WIDTH positions each.

    wide: the sums are Python integers; each is sent as its high and low part, next to each other."""
    if wide:
        sums = np.stack([sums >> 64, sums & ((1 << 64) - 1)], axis=-1).reshape(len(sums), -1)
    for block in range(max(1, -(-sums.shape[1] // WIDTH))):
        piece = sums[:, block * WIDTH : (block + 1) * WIDTH]
        for e, k, row in zip(entry.tolist(), n.tolist(), piece.tolist(), strict=True):
            values = [Decimal(v) for v in row] if wide else row
            yield {"part": part, "entry": e, "block": block, "n": k} | dict(zip(_SUMS, values, strict=False))


def sum_batch(rows: list[dict], wide: bool) -> pa.RecordBatch:
    kind = pa.decimal128(38, 0) if wide else pa.int64()
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("block", pa.int32()), ("n", pa.int64()), *((s, kind) for s in _SUMS)])
    return pa.RecordBatch.from_pylist(rows, schema)


def merged(df: DataFrame, run: Callable, wide: bool, width: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """The exact sums over all tasks of what run emits with sum_batch(): {(part, entry): (n, sums of width positions)}.

    Tasks have added up their own rows, so a row a task, entry and block is shuffled; what reaches the driver is as large as the
    entries are and not as the table is."""
    kind = "decimal(38,0)" if wide else "long"
    schema = "part int, entry int, block int, n long, " + ", ".join(f"{s} {kind}" for s in _SUMS)
    added = df.mapInArrow(run, schema).groupBy("part", "entry", "block").agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in _SUMS))
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in sorted(added.collect(), key=lambda r: (r["part"], r["entry"], r["block"])):
        _, sums = out.setdefault((r["part"], r["entry"]), (r["n"], []))
        sums += [int(r[s] or 0) for s in _SUMS]
    if wide:
        out = {k: (n, [(hi << 64) + lo for hi, lo in zip(s[::2], s[1::2], strict=True)]) for k, (n, s) in out.items()}
    return {k: (n, s[:width]) for k, (n, s) in out.items()}
