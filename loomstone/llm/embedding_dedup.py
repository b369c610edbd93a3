"""Operator 3, embedding near-dedup: product quantisation with coarse inverted lists, residual codes and exact rerank.

A bounded sample (`sample` vectors, chosen by a hash of vec_id) trains the coarse centroids and, on the residuals, one small
codebook per subspace. Every vector is stored in the list of its nearest centroid as codes of its residual. As a query it
probes all lists that a vector within the search radius can lie in: those whose boundary with its own list is no farther
than `margin` of the radius (1 is exact, less loses links across boundaries). In a list, distances to the codes come from
tables of the query's subspace distances; what may lie within the radius, given each code's own error, is compared exactly
(cosine in double precision).

Equal vectors are one row with a count, so copies cost nothing. Lists are packed into tiles of at most `cell` vectors (a
larger list is cut into several), and a vector is shipped once to each pair of its own tile with one that it probes. A link
is found once, in the pair of its ends' tiles, and counts for both ends; a pair emits counts and a spanning forest of its
links, never the links. Where vectors do not cluster nearly every tile is probed and the work grows with the square of n.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; vectors of
different lengths never link (each length is searched by itself); rows that repeat a vec_id are vectors of their own, each
with its own links and component; a cosine of exactly the threshold links; of equal vectors each links with all others; a null vec_id is returned with no links and component null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm import _text as X
from loomstone.llm._runtime import components, drop_table, ship, write_table

SUBSPACES, CODES = 8, 64


def _assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (c * c).sum(1) / 2
    for lo in range(0, len(x), 4096):
        out[lo : lo + 4096] = (x[lo : lo + 4096] @ c.T - half).argmax(1)
    return out


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _assign(x, c)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[r.integers(0, len(x), len(c))])
    return c


class Index:
    """Coarse centroids and residual codebooks, trained on unit vectors."""

    def __init__(self, x: np.ndarray, lists: int):
        self.coarse = _kmeans(x, lists)
        res = x - self.coarse[_assign(x, self.coarse)]
        d = x.shape[1]
        m = min(SUBSPACES, d)
        self.cut = np.linspace(0, d, m + 1).astype(int)
        self.books = [_kmeans(res[:, a:b], CODES, 6) for a, b in zip(self.cut[:-1], self.cut[1:], strict=True)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, distance to what the codes stand for) of each vector."""
        own = _assign(x, self.coarse)
        res = x - self.coarse[own]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        err = np.zeros(len(x))
        for s, book in enumerate(self.books):
            part = res[:, self.cut[s] : self.cut[s + 1]]
            codes[:, s] = _assign(part, book)
            err += ((part - book[codes[:, s]]) ** 2).sum(1)
        return own, codes, np.sqrt(err)

    def probe(self, x: np.ndarray, radius: float, margin: float) -> np.ndarray:
        """Mask (row, list) of the lists to probe: distance to the boundary with the own list at most margin * radius."""
        norms = (self.coarse * self.coarse).sum(1)
        d2 = norms - 2 * x @ self.coarse.T
        own = d2.argmin(1)
        gap = d2 - d2[np.arange(len(x)), own][:, None]
        apart = np.sqrt(np.maximum(norms[own][:, None] + norms - 2 * self.coarse[own] @ self.coarse.T, 0))
        return gap <= 2 * apart * margin * radius + 1e-6  # more than rounding can take away

    def near(self, q: np.ndarray, lst: int, codes: np.ndarray, err: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, stored) pairs of a list that may lie within radius, by table lookups."""
        shifted = q - self.coarse[lst]
        dist = np.zeros((len(q), len(codes)), np.float32)
        for s, book in enumerate(self.books):
            part = shifted[:, self.cut[s] : self.cut[s + 1]]
            table = ((part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1)).astype(np.float32)
            dist += table[:, codes[:, s]]
        return np.nonzero(dist <= (radius + err + 1e-3).astype(np.float32) ** 2)


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(r, np.float64) for r in raw])
    return x


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges (id, smallest id) of the components of a local edge list: by repeated minimum over neighbours, pointers halved."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inv[: len(a)], inv[len(a) :]
    low = np.arange(len(ids))
    while True:
        was = low.copy()
        m = np.minimum(low[u], low[v])
        np.minimum.at(low, u, m)
        np.minimum.at(low, v, m)
        low = low[low]
        if (low == was).all():
            return [(int(ids[i]), int(ids[low[i]])) for i in np.flatnonzero(low != np.arange(len(ids)))]


ROW = "vec_id long, dim int, key binary, unit binary"


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in batches:
        ids, dims, keys, units = [], [], [], []
        for vid, e in zip(b.column("vec_id").to_pylist(), b.column("embedding"), strict=True):
            x = None
            if e.is_valid and len(e) and e.values.null_count == 0:
                v = e.values.to_numpy(zero_copy_only=False)
                y = v.astype(np.float64)
                most = np.abs(y).max()
                if np.isfinite(most) and most > 0:  # by the largest component first: squares neither overflow nor vanish
                    y = y / most if most > 1e-300 else y * 1e300 / (most * 1e300)
                    x = y / np.sqrt((y * y).sum())
            ids.append(vid)
            dims.append(0 if x is None else len(x))
            keys.append(None if x is None else xxhash.xxh3_128_digest(np.ascontiguousarray(v)))
            units.append(None if x is None else x.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], ["vec_id", "dim", "key", "unit"])


def _tiles(sizes: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray]:
    """(first tile, number of tiles) of each list: small lists share a tile, larger ones are cut into several."""
    pieces = np.maximum(1, -(-sizes // cell))
    first, tile, filled = np.zeros(len(sizes), np.int64), 0, 0
    for k, n in enumerate(sizes):
        if filled and filled + n > cell:
            tile, filled = tile + 1, 0
        first[k], filled = tile, filled + n
        if pieces[k] > 1:
            tile, filled = tile + pieces[k], 0
    return first, pieces


def _search(reps: DataFrame, cosine: float, sample: int, margin: float, cell: int, per_list: int, scratch: list[str]) -> DataFrame:
    """(id, n, low) parts: found neighbours (weighted by copies) of id in a pair of tiles, and the forest's edge to low if any."""
    spark = reps.sparkSession
    radius = float(np.sqrt(2 - 2 * cosine))
    n = reps.count()
    picked = reps.select("id", "unit").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    if n < 2:
        return spark.createDataFrame([], "id long, n long, low long")
    index = Index(_unit([r["unit"] for r in picked]), max(1, min(n // per_list, 1024, len(picked) // 8)))
    shared = spark.sparkContext.broadcast(index)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                own, codes, err = ix.encode(_unit(part.column("unit").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.astype(np.int32)), part.column("id"), part.column("copies"), part.column("unit"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err)],
                    ["list", "id", "copies", "unit", "codes", "err"],
                )

    row = "list int, id long, copies long, unit binary, codes binary, err double"
    rows, rows_at = write_table(reps.select("id", "copies", "unit").mapInArrow(X.tidy(encode), row))
    scratch.append(rows_at)
    sizes = np.zeros(len(index.coarse), np.int64)
    for r in rows.groupBy("list").count().collect():  # a row a list
        sizes[r["list"]] = r["count"]
    # At least 16 tiles where n allows it, so that the pairs spread over the tasks.
    placed = spark.sparkContext.broadcast(_tiles(sizes, min(cell, max(1024, n // 16))))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, (first, pieces) = shared.value, placed.value
        n_tiles = int((first + pieces).max())
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                own = part.column("list").to_numpy().astype(np.int64)
                tile = first[own] + (X.mix(part.column("id").to_numpy().astype(np.uint64)) % pieces[own].astype(np.uint64)).astype(np.int64)
                ok = ix.probe(_unit(part.column("unit").to_pylist()), radius, margin)
                ok[np.arange(len(own)), own] = True
                to = np.zeros((len(own), n_tiles), bool)
                for k in range(len(first)):
                    to[:, first[k] : first[k] + pieces[k]] |= ok[:, k : k + 1]
                at, other = np.nonzero(to)
                mine = tile[at]
                more = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(mine, other).astype(np.int32)), pa.array(np.maximum(mine, other).astype(np.int32)), pa.array(mine.astype(np.int32)), *more.columns],
                    ["s", "t", "tile", *more.schema.names],
                )

    def pair_links(key: tuple, t: pa.Table) -> pa.Table:
        ix, (s, o) = shared.value, (key[0].as_py(), key[1].as_py())
        tile, lst, ids, copies, err = (t.column(c).to_numpy() for c in ("tile", "list", "id", "copies", "err"))
        left, right = np.flatnonzero(tile == s), np.flatnonzero(tile == o)
        n_links, edges = np.zeros(len(ids), np.int64), []
        if len(left) and len(right):
            x = _unit(t.column("unit").to_pylist())
            codes = np.stack([np.frombuffer(c, np.uint8) for c in t.column("codes").to_pylist()])
            right = right[np.argsort(lst[right], kind="stable")]
            lists, at = np.unique(lst[right], return_index=True)
            for q in (left[lo : lo + 1024] for lo in range(0, len(left), 1024)):
                ok = ix.probe(x[q], radius, margin)
                ok[np.arange(len(q)), lst[q]] = True
                for k, of_list in zip(lists.tolist(), np.split(right, at[1:]), strict=True):
                    asks = q[ok[:, k]]
                    for db in (of_list[lo : lo + 1024] for lo in range(0, len(of_list), 1024)):
                        if not len(asks):
                            break
                        a, b = ix.near(x[asks], k, codes[db], err[db], radius)
                        a, b = asks[a], db[b]
                        # Within one tile each link shows from both ends.
                        sel = ids[a] < ids[b] if s == o else ids[a] != ids[b]
                        a, b = a[sel], b[sel]
                        keep = np.zeros(len(a), bool)
                        for lo in range(0, len(a), 1 << 16):
                            i = slice(lo, lo + (1 << 16))
                            keep[i] = np.einsum("ij,ij->i", x[a[i]], x[b[i]]) >= cosine
                        a, b = a[keep], b[keep]
                        if len(a):
                            np.add.at(n_links, a, copies[b])
                            np.add.at(n_links, b, copies[a])
                            edges += _forest(ids[a], ids[b])
        low = dict(_forest(*np.array(edges, np.int64).T)) if edges else {}
        hit = np.flatnonzero(n_links)
        out = {"id": ids[hit], "n": n_links[hit], "low": [low.get(int(v)) for v in ids[hit]]}
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    shipped = rows.mapInArrow(X.tidy(spread), f"s int, t int, tile int, {row}")
    return shipped.groupBy("s", "t").applyInArrow(pair_links, "id long, n long, low long")


def links(embeddings: DataFrame, cosine: float = 0.9, sample: int = 16_384, margin: float = 1.0, cell: int = 8192, per_list: int = 400) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors at the given cosine or more), component_id, kept."""
    spark = embeddings.sparkSession
    ship(spark)
    src = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows, rows_at = write_table(src.mapInArrow(X.tidy(_prepare), ROW))
    scratch = [rows_at]
    valid = rows.where("key IS NOT NULL AND vec_id IS NOT NULL")
    # A distinct vector has a number of its own (id): unlike vectors may share their smallest vec_id (low_id).
    groups, groups_at = write_table(valid.groupBy("dim", "key").agg(F.min("vec_id").alias("low_id"), F.count("*").alias("copies")).withColumn("id", F.monotonically_increasing_id()))
    scratch.append(groups_at)
    own = groups.select("dim", "key", F.col("low_id").alias("vec_id"), "id", "copies")
    reps = valid.join(own, ["dim", "key", "vec_id"]).groupBy("dim", "id").agg(F.max("copies").alias("copies"), F.max("unit").alias("unit"))
    found = None
    for r in groups.select("dim").distinct().collect():
        part = _search(reps.where(F.col("dim") == r["dim"]), cosine, sample, margin, cell, per_list, scratch)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = spark.createDataFrame([], "id long, n long, low long")
    found, found_at = write_table(found)
    scratch.append(found_at)
    count = found.groupBy("id").agg(F.sum("n").alias("found"))
    comp = components(found.where("low IS NOT NULL").select(F.col("id").alias("a"), F.col("low").alias("b")))
    named = comp.join(groups.select("id", "low_id"), "id").select("id", "component", "low_id")
    lowest = named.groupBy("component").agg(F.min("low_id").alias("lowest"))
    placed = groups.join(count, "id", "left").join(named.join(lowest, "component").select("id", "lowest"), "id", "left")
    out = rows.join(placed, ["dim", "key"], "left")
    component = F.when(F.col("id").isNull() | F.col("vec_id").isNull(), F.col("vec_id")).otherwise(F.coalesce("lowest", "low_id"))
    done, _ = write_table(out.select(
        "vec_id",
        F.when(F.col("vec_id").isNull(), F.lit(0)).otherwise(F.coalesce("found", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    ))
    for at in scratch:
        drop_table(spark, at)
    return done
