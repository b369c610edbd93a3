"""Operator 12, embedding whitening: principal components of a compensated covariance, and vectors projected on them.

Components c become whole numbers x = floor(scale * c) + shift. Statistics are over the fit list, each distinct x once. Its count n and
the sums S are exact integers, so n*x - S is an exact integer too and (n*x - S)/n the centred vector, taken to 64 bits as a
double and what the double leaves over. Tasks accumulate centred outer products in double-double: a block of rows is split by
an error-free transformation into slices of 21 bits, whose matrix products are exact in doubles, and those are added to the high and
low parts by two-sums. High and low parts of all tasks are merged by two-sums again, row by row of the matrix and in two
levels, so that no task gets more than a share. What comes to the driver is the covariance (dimension squared). Its
eigenvectors come from LAPACK's divide and conquer on the tridiagonal form (numpy's eigh), refined once in extended
precision against the double-double matrix. A last pass over the fit list measures the covariance of the whitened vectors.

Defined results: vectors that are null, or hold null or non-finite components or one of 2^62 and more after scaling, are dropped;
repeated rows are returned each, with any vec_id and also without one, and count once in the fit list. Vectors of each length
are whitened apart. A component whose eigenvalue is not above rounding (dimension * 2^-52 of the largest) has no scale:
whitened is null and it stays out of identity_error. Without variance explained is null and identity_error 0. A deviation that
does not fit a long is null. Equal eigenvalues have any orthonormal basis, the same for all rows. An empty vector has no component
and so no row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm._runtime import drop_table, ship, write_table
from loomstone.llm._text import tidy
from loomstone.llm._vectors import finite, matrix, merged, sum_batch, sum_rows, whole_table

#: Rows of a block and bits of a slice: products of two slices summed over a block fit the 53 bits of a double.
BLOCK, BITS, SLICES = 1024, 21, 5
#: Groups that a row of the matrix is merged in first.
SHARES = 32
_LARGEST = (1 << 63) - 1
_PARTS = "share int, task int, i int, hi array<double>, lo array<double>"
_PARTS_ARROW = pa.schema([("share", pa.int32()), ("task", pa.int32()), ("i", pa.int32()), ("hi", pa.list_(pa.float64())), ("lo", pa.list_(pa.float64()))])


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(s, e): the rounded sum and what it lost; s + e = a + b exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(total: tuple[np.ndarray, np.ndarray], hi: np.ndarray, lo: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """total + (hi + lo) in double-double."""
    s, e = two_sum(total[0], hi)
    return two_sum(s, e + (total[1] + lo))


def exact_products(hi: np.ndarray, lo: np.ndarray) -> Iterator[np.ndarray]:
    """Matrices, each exact, whose sum is (hi + lo)^T (hi + lo) to 2^-100 of the columns' largest entries. BLOCK rows at most."""
    unit = 2.0 ** np.frexp(np.abs(hi).max(0, initial=0.0))[1]  # of each column its own
    slices, rest = [], hi
    for k in range(SLICES):
        unit *= 2.0**-BITS
        slices.append(np.rint(rest / unit) * unit)
        rest = rest - slices[-1]
        if k == SLICES // 2:
            rest = rest + lo
    for a in range(SLICES):
        for b in range(a, SLICES - a):
            p = slices[a].T @ slices[b]
            yield p
            if a != b:
                yield p.T


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n*x - S as exact integers, (n*x - S)/n as high and low part) of whole vectors x."""
    top = max(int(np.abs(x).max(initial=0)), *(abs(s) // n + 1 for s in sums), 1)
    if n * top < 1 << 62:
        m = x * n - np.array(sums, np.int64)
        y = m.astype(np.longdouble) / n
    else:
        m = x.astype(object) * n - np.array(sums, object)
        y = np.array([[np.longdouble(v // n) + np.longdouble(v % n) / n for v in row] for row in m], np.longdouble).reshape(x.shape)
    hi = y.astype(float)
    return m, hi, (y - hi).astype(float)


def deviations(m: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, null where it does not fit a long."""
    if m.dtype != object and m.shape[1] * max(-int(m.min(initial=0)), int(m.max(initial=0))) ** 2 <= _LARGEST:
        return (m * m).sum(1).tolist()
    return [v if v <= _LARGEST else None for v in (sum(int(c) ** 2 for c in row) for row in m)]


def _gram(dim: int, n: int, sums: list[int], project: np.ndarray | None = None):
    """Emits a task's sum of outer products of centred (and projected) vectors, a row of the matrix each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = dim if project is None else project.shape[1]
        total = np.zeros((size, size)), np.zeros((size, size))
        for batch in batches:
            x = matrix(batch.column("x"), dim)
            for at in range(0, len(x), BLOCK):
                _, hi, lo = centred(x[at : at + BLOCK], n, sums)
                if project is not None:
                    hi, lo = hi @ project, lo @ project
                for p in exact_products(hi, lo):
                    total = add(total, p)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pylist([{"share": task % SHARES, "task": task, "i": i, "hi": total[0][i].tolist(), "lo": total[1][i].tolist()} for i in range(size)], _PARTS_ARROW)

    return tidy(run)


def _merge(table: pa.Table) -> pa.Table:
    table = table.sort_by("task")
    size = len(table["hi"][0])
    total = np.zeros(size), np.zeros(size)
    for hi, lo in zip(table["hi"], table["lo"], strict=True):
        total = add(total, np.array(hi.values), np.array(lo.values))
    first = table.slice(0, 1)
    return pa.table({"share": first["share"], "task": first["task"], "i": first["i"], "hi": [total[0].tolist()], "lo": [total[1].tolist()]}, _PARTS_ARROW)


def outer_sums(rows: DataFrame, dim: int, n: int, sums: list[int], project: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """High and low part of the sum of outer products over rows (x), merged over all tasks."""
    own = rows.select("x").mapInArrow(_gram(dim, n, sums, project), _PARTS)
    merged_ = own.groupBy("i", "share").applyInArrow(_merge, _PARTS).groupBy("i").applyInArrow(_merge, _PARTS)
    found = sorted(merged_.collect(), key=lambda r: r["i"])
    return np.array([r["hi"] for r in found]), np.array([r["lo"] for r in found])


def eigen(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors as columns) of the symmetric matrix hi + lo.

    Householder reduction to tridiagonal form and divide and conquer (LAPACK's syevd), then steps of refinement in extended
    precision, each of which squares what rounding the matrix and the solver's own steps left."""
    def even(m):  # what rounding puts between m and its transpose would be divided by the gaps
        return (m + m.T) / 2

    a = even(hi.astype(np.longdouble) + lo)
    size = np.abs(a).sum(1).max(initial=0)
    x = np.linalg.eigh(a.astype(float))[1][:, ::-1].astype(np.longdouble)
    for _ in range(3):
        r = np.eye(len(a)) - even(x.T @ x)
        s = even(x.T @ a @ x)
        e = np.diag(s) / (1 - np.diag(r))
        gap = e[None, :] - e[:, None]
        # Directions whose eigenvalues are not told apart stay as they are among themselves.
        apart = np.abs(gap) > 8 * len(a) * np.finfo(np.longdouble).eps * size + np.abs(s - np.diag(np.diag(s)))
        x = x + x @ np.where(apart, (s + e[None, :] * r) / np.where(apart, gap, 1), r / 2)
    x = x / np.sqrt((x * x).sum(0))
    order = np.argsort(-e, kind="stable")
    return e[order].astype(float), x[:, order].astype(float)


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, sums = 0, None
    for batch in batches:
        lists = batch.column("x")
        x = matrix(lists, len(lists[0]) if len(lists) else 0)
        own = ((x >> 32).sum(0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(0)  # neither half can leave 64 bits
        n, sums = n + len(x), own if sums is None else sums + own
    if n:
        yield sum_batch(list(sum_rows(0, np.zeros(1, int), np.array([n]), sums.reshape(1, -1), True)), True)


def _output(dim: int, n: int, sums: list[int], scale: np.ndarray, explained: list, error: float):
    """scale: eigenvectors over the square roots of their eigenvalues, NaN columns where there is no scale."""
    k = scale.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids = matrix(batch.column("x"), dim), batch.column("vec_id")
            for at in range(0, len(x), BLOCK):
                m, hi, lo = centred(x[at : at + BLOCK], n, sums)
                w = (hi @ scale + lo @ scale).ravel()
                rows = len(m)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(np.arange(at, at + rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * k, n, np.int64)), pa.array([v for v in deviations(m) for _ in range(k)], pa.int64()), pa.array(w, mask=np.isnan(w)),
                        pa.array(explained * rows, pa.float64()), pa.array(np.full(rows * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return tidy(run)


def whiten(embeddings: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each kept row of embeddings (vec_id,
    embedding) and component up to `components`."""
    spark = embeddings.sparkSession
    ship(spark)
    kept, e = finite(embeddings)
    kept = kept.where(~F.exists(e, lambda c: F.abs(c * scale) >= float(1 << 62)))
    rows = kept.select("vec_id", F.transform(e, lambda c: F.floor(c * scale) + F.lit(shift).cast("long")).alias("x"))
    table, path, dims = whole_table(rows)
    kind = table.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = None
    for dim in (d for d in dims if d):
        own = table.where(F.col("dim") == dim)
        fit, fit_at = write_table(own.select("x").distinct())
        n, sums = merged(fit, tidy(_total), True, dim)[0, 0]
        hi, lo = outer_sums(fit, dim, n, sums)
        value, vector = eigen(hi / n, lo / n)
        k, trace = min(components, dim), float(np.trace(hi) / n)
        value, vector = value[:k], vector[:, :k]
        usable = value > dim * 2.0**-52 * max(value[0], 0.0)
        weights = np.where(usable, vector / np.sqrt(np.where(usable, value, 1.0)), np.nan)
        error = 0.0
        if usable.any():
            got = outer_sums(fit, dim, n, sums, weights[:, usable])
            error = float(np.abs((got[0] - n * np.eye(usable.sum()) + got[1]) / n).max())
        explained = [float(v / trace) if trace > 0 else None for v in value]
        part = own.select("vec_id", "x").mapInArrow(_output(dim, n, sums, weights, explained, error), schema)
        drop_table(spark, fit_at)
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], schema) if out is None else out
