"""Operator 5, language identification: string kernel with Nystroem landmarks and one-versus-rest kernel ridge regression.

The kernel of two texts is the number of character n-grams (n = 1, 2, 3 together: a blended spectrum) present in both,
divided by the geometric mean of how many each has. N-grams are hashed to `dims` places, so a text is one row of bits.
Training draws a bounded sample per language, picks landmarks from it, and solves a ridge regression in the landmarks'
space; texts are scored in batches by two matrix products (presence by landmarks, kernel by weights).

Sample bounds: `per_language` rows a language (whole texts, chosen by a hash of doc_id), `landmarks` in all. Only
(text, lang) of rows outside the held-out part are learned from; a prediction sees nothing but the text.

Defined results: a null text or one without a letter is `und` with score 0, as is every text when nothing can be learned;
of languages that score alike the first by name is predicted; repeated rows are predicted alike; very long texts are read whole,
one at a time; an empty table gives an empty result; a row with a null doc_id is not held out and not learned from; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm import _text as X
from loomstone.llm._runtime import ship

ORDERS = 3
#: A slice is bounded by the bytes of its texts and, as each becomes a row of `dims` places, by their number.
SLICE, ROWS = 1 << 19, 256
_SALT = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def held_out(doc_id: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(parts)) == part, F.lit(False))


def presence(texts: list[str], dims: int) -> np.ndarray:
    """One row of 0/1 per text: which hashed n-grams of its lower-cased characters occur, ends of text included."""
    raw = [t.lower().encode("utf-32-le", "replace") for t in texts]
    gap = b" \0\0\0" * ORDERS
    cp = np.frombuffer(gap.join(raw) + gap, "<u4")
    lens = np.array([len(r) // 4 for r in raw], np.int64)
    out = np.zeros((len(texts), dims), np.uint8)
    flat = out.ravel()
    first = np.cumsum(lens + ORDERS) - (lens + ORDERS)
    at = np.arange(lens.sum()) + np.repeat(first - (np.cumsum(lens) - lens), lens)
    row = np.repeat(np.arange(len(texts)) * dims, lens)
    shift = np.uint32(32 - int(dims).bit_length() + 1)
    h = np.zeros(len(cp) - ORDERS, np.uint32)
    for n in range(ORDERS):
        h = (h + cp[n : len(cp) - ORDERS + n]) * np.uint32(_SALT[n])
        h ^= h >> np.uint32(15)
        flat[row + ((h[at] * np.uint32(0x27D4EB2F)) >> shift)] = 1
    return out


def _pack(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 64):
            part = b.slice(lo, 64)
            bits = np.packbits(presence([t or "" for t in part.column("text").to_pylist()], dims), axis=1)
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("h"), pa.array([x.tobytes() for x in bits], pa.binary())], ["lang", "h", "bits"])


def sample(documents: DataFrame, per_language: int, most: int = 40_000) -> DataFrame:
    """(lang, h, text): of each language about per_language distinct texts outside the held-out part, by hash order; all where
    there are fewer. At most `most` texts in all: with many languages each has fewer, 2 at least, and only the most / 2 most frequent
    languages are learned.

    Texts are told apart by their hash h, whatever rows or doc_ids they stand in, so a text that occurs often is one witness and no
    language hangs on one id. A language's texts are thinned by a hash threshold before they are ranked, so no task sees all of them."""
    rows = documents.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select(F.col("lang").alias("lang"), F.xxhash64("text").alias("h"), "text")
    texts = rows.select("lang", "h").distinct()
    totals = texts.groupBy("lang").agg(F.count("*").alias("_n")).orderBy(F.col("_n").desc(), "lang").limit(most // 2)
    each = max(2, min(per_language, most // max(1, totals.count())))
    unit = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) / float(1 << 30)
    thin = texts.join(F.broadcast(totals), "lang").where(unit * F.col("_n") <= 1.5 * each + 20)
    picked = thin.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("_r") <= each).select("lang", "h")
    return rows.join(F.broadcast(picked), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))


class Model:
    def __init__(self, bits: np.ndarray, langs: list[str], landmarks: int, ridge: float, dims: int):
        self.dims, self.langs = dims, sorted(set(langs))
        if not self.langs:
            return
        y = np.array([[1.0 if g == k else -1.0 for k in self.langs] for g in langs])
        by = [np.flatnonzero(y[:, k] > 0) for k in range(len(self.langs))]
        each = max(2, landmarks // len(self.langs))
        z = np.concatenate([np.array(i[:each]) for i in by])
        p = bits.astype(np.float32)
        self.z = np.ascontiguousarray((p[z] / np.sqrt(np.maximum(p[z].sum(1, keepdims=True), 1))).T)
        k_zz = (p[z] / np.sqrt(np.maximum(p[z].sum(1, keepdims=True), 1))).astype(np.float64) @ self.z.astype(np.float64)
        val, vec = np.linalg.eigh(k_zz)
        root = vec / np.sqrt(np.maximum(val, 1e-6 * val.max())) @ vec.T
        phi = self.kernel(bits).astype(np.float64) @ root
        phi1 = np.column_stack([phi, np.ones(len(phi))])
        # Each language weighs alike, however many rows it has.
        w = np.zeros(len(langs))
        for i in by:
            w[i] = 1.0 / len(i)
        w *= len(langs) / w.sum()
        reg = ridge * np.eye(phi1.shape[1])
        reg[-1, -1] = 1e-9
        coef = np.linalg.solve(phi1.T @ (phi1 * w[:, None]) + reg, phi1.T @ (y * w[:, None]))
        self.w, self.b = (root @ coef[:-1]).astype(np.float32), coef[-1].astype(np.float32)

    def kernel(self, bits: np.ndarray) -> np.ndarray:
        p = bits.astype(np.float32)
        return (p @ self.z) / np.sqrt(np.maximum(p.sum(1, keepdims=True), 1))

    def predict(self, bits: np.ndarray) -> tuple[list[str], np.ndarray]:
        f = self.kernel(bits) @ self.w + self.b
        best = f.argmax(1)
        return [self.langs[i] for i in best], np.clip((f[np.arange(len(f)), best] + 1) / 2, 0, 1).astype(np.float64)


def train(documents: DataFrame, per_language: int = 400, landmarks: int = 160, ridge: float = 0.1, dims: int = 8192) -> Model:
    ship(documents.sparkSession)
    packed = sample(documents, per_language).mapInArrow(lambda it: _pack(it, dims), "lang string, h long, bits binary")
    rows = sorted(packed.collect(), key=lambda r: (r["lang"], r["h"], r["bits"]))  # 40,000 rows of dims / 8 bytes at most
    bits = np.array([np.unpackbits(np.frombuffer(r["bits"], np.uint8)) for r in rows], np.uint8).reshape(len(rows), dims)
    return Model(bits, [r["lang"] for r in rows], landmarks, ridge, dims)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            _, offs = X.buffers(b.column("text"))
            for lo, hi in X.slices(offs, SLICE, ROWS):
                part = b.slice(lo, hi - lo)
                ok = part.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
                names, scores = np.full(len(ok), "und", object), np.zeros(len(ok))
                if ok.any() and m.langs:
                    texts = part.column("text").filter(pa.array(ok)).to_pylist()
                    got, p = m.predict(presence(texts, m.dims))
                    names[ok], scores[ok] = got, p
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    src = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
    )
    return src.mapInArrow(X.tidy(run), "doc_id long, held_out boolean, lang_pred string, score double")
