"""Operator 1, substring dedup: content-defined chunks cut by a gear rolling hash, deduplicated by digest.

A position is a cut where the top bits of the gear hash of the last 32 bytes are zero and no other such position lies in
the `min_chunk` bytes before it; a longer gap is cut every `max_chunk` bytes. Both rules look at nearby bytes only, so cuts
move along with text that is inserted before them; a cut within a character moves to its end. A chunk is repeated when its digest occurs in two rows or more
(or anywhere twice, with across_documents=False); runs of adjacent repeated chunks of `min_run` bytes or more count.

A document is a row, whatever its doc_id: rows are told apart by `row_key`, a column of _runtime.keyed() tables, or else a number
that spans() gives and stores with the chunks.

Defined results: a null or empty text has no chunks; equal rows repeat each other; an empty table gives an empty result;
extra columns are ignored by spans() and kept by remove(), also one called row_key. A null doc_id takes part under null and sorts first. Very long texts
are chunked whole, one at a time where they exceed a slice of 1 MB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm import _text as X
from loomstone.llm._runtime import drop_table, is_keyed, ship, write_table

_GEAR = (X.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
CHUNK_SCHEMA = "row_key long, doc_id long, start int, length int, d1 long, d2 long"


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of G[data[i-k]] << k over the last 32 bytes, modulo 2**32, by doubling."""
    h = _GEAR[data]
    for m in (1, 2, 4, 8, 16):
        nxt = h.copy()
        nxt[m:] += h[:-m] << np.uint32(m) if len(h) > m else np.zeros(0, np.uint32)
        h = nxt
    return h


def cuts(data: np.ndarray, offsets: np.ndarray, bits: int, min_chunk: int, max_chunk: int) -> np.ndarray:
    """Sorted end positions of the chunks of all documents in the buffer; each document's end is one."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    ends = np.unique(offsets[1:][np.diff(offsets) > 0])
    at = np.flatnonzero((gear(data) >> np.uint32(32 - bits)) == 0) + 1
    if len(at):
        # A hash whose window reaches into the document before says nothing about this one.
        doc_start = offsets[np.searchsorted(offsets, at - 1, "right") - 1]
        at = at[at - doc_start >= 32]
    if len(at):
        keep = np.ones(len(at), bool)
        keep[1:] = np.diff(at) >= min_chunk
        at = at[keep]
    ends = np.union1d(at, ends)
    gaps = np.diff(np.concatenate([[0], ends]))
    if (more := (gaps - 1) // max_chunk).any():
        base = np.repeat(ends - gaps, more)
        step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        ends = np.sort(np.concatenate([ends, base + step * max_chunk]))
    # A cut inside a character moves to its end: again a local rule, and no text is ever cut within a character.
    for _ in range(3):
        inside = (ends < n) & ((data[np.minimum(ends, n - 1)] & 0xC0) == 0x80)
        if not inside.any():
            break
        ends = ends + inside
    return np.unique(ends)


def _chunk_batches(bits: int, min_chunk: int, max_chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            data, offs = X.buffers(b.column("text"))
            keys, ids = b.column("row_key"), b.column("doc_id")
            for lo, hi in X.slices(offs, 1 << 20):
                d, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                e = cuts(d, o, bits, min_chunk, max_chunk)
                if not len(e):
                    continue
                s = np.concatenate([[0], e[:-1]])
                row = np.searchsorted(o, s, "right") - 1
                raw = d.tobytes()
                digest = b"".join([xxhash.xxh3_128_digest(raw[i:j]) for i, j in zip(s.tolist(), e.tolist(), strict=True)])
                parts = np.frombuffer(digest, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(row + lo)), ids.take(pa.array(row + lo)), pa.array((s - o[row]).astype(np.int32)), pa.array((e - s).astype(np.int32)), pa.array(np.ascontiguousarray(parts[:, 0])), pa.array(np.ascontiguousarray(parts[:, 1]))],
                    ["row_key", "doc_id", "start", "length", "d1", "d2"],
                )

    return run


def chunks(documents: DataFrame, bits: int = 5, min_chunk: int = 16, max_chunk: int = 128) -> DataFrame:
    """One row per chunk: row_key, doc_id, start and length in UTF-8 bytes, and the 128-bit digest as two longs."""
    ship(documents.sparkSession)
    key = F.col("row_key") if is_keyed(documents) else F.monotonically_increasing_id()
    src = documents.select(key.cast("long").alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(X.tidy(_chunk_batches(bits, min_chunk, max_chunk)), CHUNK_SCHEMA)


def spans(documents: DataFrame, min_run: int = 96, across_documents: bool = True, **chunking) -> DataFrame:
    """One row per run of repeated chunks: row_key, doc_id, start, end (UTF-8 bytes), n_chunks, dup_bytes (bytes whose first
    occurrence is elsewhere, which dedup removes), first_doc_id (where the run's earliest copy lies), n_copies.

    The grouped side of the join has one row per digest, so a digest that holds a large part of all chunks leaves a join
    that Spark can split; the grouping itself combines before it shuffles. Chunks are stored, as both sides of the join
    must see the same row keys.
    """
    c, chunks_at = write_table(chunks(documents, **chunking))
    seen = c.groupBy("d1", "d2").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "row_key", "start")).alias("first"), F.min("row_key").alias("low"), F.max("row_key").alias("high")
    )
    repeated = seen.where((F.col("n") > 1) & (F.col("low") < F.col("high")) if across_documents else F.col("n") > 1)
    hit = c.join(repeated.select("d1", "d2", "n", "first"), ["d1", "d2"])
    hit = hit.select(
        "row_key", "doc_id", "start", (F.col("start") + F.col("length")).alias("end"), "n",
        F.col("first.doc_id").alias("first_doc"),
        F.when(~((F.col("first.row_key") == F.col("row_key")) & (F.col("first.start") == F.col("start"))), F.col("length")).otherwise(0).alias("dup"),
    )
    w = Window.partitionBy("row_key").orderBy("start", "end")
    fresh = F.coalesce((F.lag("end").over(w) != F.col("start")).cast("int"), F.lit(1))
    runs = hit.withColumn("run", F.sum(fresh).over(w)).groupBy("row_key", "run").agg(
        F.first("doc_id").alias("doc_id"),
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_chunks"),
        F.sum("dup").alias("dup_bytes"), F.when(F.count("first_doc") == F.count("*"), F.min("first_doc")).alias("first_doc_id"), F.max("n").alias("n_copies"),
    )
    out, _ = write_table(runs.where(F.col("end") - F.col("start") >= min_run).drop("run"))
    drop_table(documents.sparkSession, chunks_at)
    return out


def remove(documents: DataFrame, found: DataFrame) -> DataFrame:
    """documents with the text of every run cut out but for its first copy: a run is cut where all of it is repeated from elsewhere.

    Null texts and documents without such runs stay as they are. Where documents are a keyed() table, found being its
    spans, rows are cut by row_key; otherwise by doc_id, and rows whose doc_id is null or not theirs alone stay whole.
    """
    key = "row_key" if is_keyed(documents) else "doc_id"
    if key == "doc_id":
        found = found.join(documents.groupBy("doc_id").count().where("count = 1").select("doc_id"), "doc_id", "left_semi")
    cut = (
        found.where("dup_bytes = `end` - `start`")
        .groupBy(key)
        .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_cuts"))
    )

    @F.pandas_udf("string")
    def without(text, spans_):
        import pandas as pd

        out = []
        for t, s in zip(text, spans_, strict=True):
            if t is None or s is None or not len(s):
                out.append(t)
                continue
            raw, at, kept = t.encode(), 0, []
            for x in s:
                kept.append(raw[at : x["start"]])
                at = x["end"]
            out.append((b"".join(kept) + raw[at:]).decode())
        return pd.Series(out, dtype=object)

    return documents.join(cut, key, "left").withColumn("text", without("text", "_cuts")).select(*documents.columns)
