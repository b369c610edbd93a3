"""Operator 4, benchmark decontamination: a distributed positional inverted index, matched from the rarest terms.

build_index() turns the training texts into blocks of about 1 MB and stores, per block, the positions of each term, sorted
(only the terms that the test items contain are kept: no other can match). The index is a table in the shared folder, split by
documents, so a block is matched where it lies and nothing but the index's term totals is shuffled. match() starts every
window of test words from its rarest term over the whole corpus, shifts that term's positions by the window's offsets, and
intersects them with the next rarer terms' lists in turn; what is left are exact phrases. With a slop above 0 each term may
lie so many words off its place relative to the rarest, which gives the proximity matches.

The test items are collected in parts of bounded size (`part_bytes`); each part has an index of its own terms, and the
passes are merged per document. So the broadcast stays bounded however large the benchmark is. Words are compared by a 64-bit
hash of their bytes. Index and broadcasts are deleted once the matches are written.

Defined results: a null or empty text has no words and no hits; an item without words has no windows; items that repeat an
item_id count once, and so do all items whose item_id is null (a null last in the lists, not in the digest); repeated documents are matched each on its own; an empty benchmark or table gives zeros or no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm import _text as X
from loomstone.llm._runtime import drop_table, ship, write_table

BLOCK = 1 << 20
INDEX_SCHEMA = "doc_ids array<long>, doc_first binary, terms binary, term_first binary, positions binary"
MATCH_SCHEMA = "block_id long, row int, doc_id long, n_words long, spans binary, items array<string>, near array<string>"


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    d, o = X.buffers(texts)
    s, e, first = X.words(d, o, X.word_bytes("alnum"))
    return X.range_hashes(d, s, e), first


def _sorted(ids: set[str | None]) -> list[str | None]:
    return sorted(ids, key=lambda i: (i is None, i or ""))


class Windows:
    """The windows of a part of the benchmark: `size` consecutive item words each, or all words of a shorter item."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        h, first = _hashes(pa.array([t for _, t in items], pa.string()))
        self.vocabulary = np.unique(h)
        term = np.searchsorted(self.vocabulary, h)
        words = np.diff(first)
        many = np.where(words > 0, np.maximum(words - size + 1, 1), 0)
        self.ids = [x for x, _ in items]
        self.item = np.repeat(np.arange(len(items), dtype=np.int32), many)
        nth = np.arange(len(self.item)) - np.repeat(np.cumsum(many) - many, many)
        start = first[:-1][self.item] + nth
        self.length = np.minimum(words, size)[self.item].astype(np.int32)
        width = int(self.length.max()) if len(start) else 0
        self.terms = np.full((len(start), width), -1, np.int32)
        for j in range(width):
            on = self.length > j
            self.terms[on, j] = term[start[on] + j]
        self.offsets = np.tile(np.arange(width, dtype=np.int32), (len(start), 1))

    def rarest_first(self, counts: np.ndarray) -> Windows:
        """Each window's terms in order of their totals over the corpus; places beyond a window's length last."""
        n = np.where(self.terms >= 0, counts[self.terms], np.iinfo(np.int64).max)
        order = np.argsort(n, axis=1, kind="stable")
        self.terms = np.take_along_axis(self.terms, order, 1)
        self.offsets = np.take_along_axis(self.offsets, order, 1)
        # A window with a term that the corpus lacks has no match.
        ok = (np.where(self.terms >= 0, counts[self.terms], 1) > 0).all(1) if len(self.terms) else np.zeros(0, bool)
        self.terms, self.offsets, self.item, self.length = self.terms[ok], self.offsets[ok], self.item[ok], self.length[ok]
        return self


def build_index(documents: DataFrame, vocabulary) -> DataFrame:
    """One row per block of documents: their ids, the index of each one's first word, and the positions of each term.

    vocabulary: broadcast sorted hashes of the terms to keep; terms are numbered by their place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary.value
        maybe = np.zeros(1 << 22, bool)
        maybe[(vocab >> np.uint64(42)).astype(np.int64)] = True
        table = X.word_bytes("alnum")
        for b in batches:
            data, offs = X.buffers(b.column("text"))
            ids = b.column("doc_id")
            for lo, hi in X.slices(offs, BLOCK):
                d, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                s, e, first = X.words(d, o, table)
                h = X.range_hashes(d, s, e)
                at = np.flatnonzero(maybe[(h >> np.uint64(42)).astype(np.int64)]) if len(vocab) else np.zeros(0, np.int64)
                h = h[at]
                term = np.searchsorted(vocab, h)
                term[term == len(vocab)] = 0
                ok = vocab[term] == h if len(vocab) else np.zeros(0, bool)
                term, at = term[ok], at[ok]
                order = np.argsort(term.astype(np.uint16) if len(vocab) < 65536 else term, kind="stable")
                term, at = term[order], at[order].astype("<u4")
                own, t_first = np.unique(term, return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[lo : lo + hi - lo].slice(0).to_pylist()], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (first.astype("<u4").tobytes(), own.astype("<u4").tobytes(), np.append(t_first, len(term)).astype("<u4").tobytes(), at.tobytes()))],
                    ["doc_ids", "doc_first", "terms", "term_first", "positions"],
                )

    src = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(X.tidy(run), INDEX_SCHEMA).withColumn("block_id", F.monotonically_increasing_id())


def term_totals(index: DataFrame, n_terms: int) -> np.ndarray:
    """Occurrences of each term over the whole corpus, from the stored lists' lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for b in batches:
            for t, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[np.frombuffer(t, "<u4")] += np.diff(np.frombuffer(f, "<u4").astype(np.int64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    out = np.zeros(n_terms, np.int64)
    for r in index.select("terms", "term_first").mapInArrow(X.tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]  # a row for each term of this part of the benchmark at most
    return out


def _block_matches(w: Windows, keys, terms, t_first, doc_first, slop: int, most: int = 1 << 18):
    """(window, start, exact) of the matches in a block. keys: term << 32 | position, sorted."""
    if not len(w.item) or not len(keys):
        return
    where = np.searchsorted(terms, w.terms[:, 0])
    where[where == len(terms)] = 0
    present = terms[where] == w.terms[:, 0]
    many = np.where(present, t_first[where + 1] - t_first[where], 0)
    ends = np.cumsum(many)
    lo = 0
    while lo < len(many):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        n = many[lo:hi]
        win = np.repeat(np.arange(lo, hi), n)
        if len(win):
            base = np.repeat(t_first[where[lo:hi]] - (np.cumsum(n) - n), n)
            anchor = (keys[base + np.arange(len(win))] & 0xFFFFFFFF).astype(np.int64)
            doc = np.searchsorted(doc_first, anchor, "right") - 1
            start = anchor - w.offsets[win, 0]
            low, high = doc_first[doc], doc_first[doc + 1]
            ok = (start + w.length[win] + slop > low) & (start - slop < high)
            win, start, low, high = win[ok], start[ok], low[ok], high[ok]
            for j in range(1, w.terms.shape[1]):
                t = w.terms[win, j].astype(np.int64)
                here = start + w.offsets[win, j]
                a, z = np.maximum(here - slop, low), np.minimum(here + slop, high - 1)
                i = np.searchsorted(keys, (t << 32) | np.maximum(a, 0))
                found = keys[np.minimum(i, len(keys) - 1)]
                ok = (t < 0) | ((i < len(keys)) & (found >= ((t << 32) | np.maximum(a, 0))) & (found <= ((t << 32) | np.maximum(z, 0))) & (a <= z))
                win, start, low, high = win[ok], start[ok], low[ok], high[ok]
                if not len(win):
                    break
            exact = (start >= low) & (start + w.length[win] <= high)
            for j in range(1, w.terms.shape[1]):
                t = w.terms[win, j].astype(np.int64)
                key = (t << 32) | np.maximum(start + w.offsets[win, j], 0)
                i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                exact &= (t < 0) | (keys[i] == key)
            yield win, start, exact
        lo = hi


def match(index: DataFrame, windows, slop: int) -> DataFrame:
    """Per document of the index: merged spans of exact matches in words, the items that match exactly, and those that match in proximity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Windows = windows.value
        for b in batches:
            for r in b.to_pylist():
                first = np.frombuffer(r["doc_first"], "<u4").astype(np.int64)
                terms = np.frombuffer(r["terms"], "<u4").astype(np.int64)
                t_first = np.frombuffer(r["term_first"], "<u4").astype(np.int64)
                at = np.frombuffer(r["positions"], "<u4").astype(np.int64)
                keys = (np.repeat(terms, np.diff(t_first)) << 32) | at
                n_docs = len(first) - 1
                edge = np.zeros(int(first[-1]) + 1, np.int64)
                exact_items, near_items = [set() for _ in range(n_docs)], [set() for _ in range(n_docs)]
                for win, start, exact in _block_matches(w, keys, terms, t_first, first, slop):
                    doc = np.searchsorted(first, start + w.offsets[win, 0], "right") - 1
                    np.add.at(edge, start[exact], 1)
                    np.add.at(edge, (start + w.length[win])[exact], -1)
                    for into, sel in ((near_items, slice(None)), (exact_items, exact)):
                        for dd, it in set(zip(doc[sel].tolist(), w.item[win[sel]].tolist(), strict=True)):
                            into[dd].add(w.ids[it])
                hit = np.cumsum(edge[:-1]) > 0
                out = [[], [], [], []]
                for i in range(n_docs):
                    x = np.flatnonzero(np.diff(np.concatenate([[0], hit[first[i] : first[i + 1]].astype(np.int8), [0]]))) if exact_items[i] else np.zeros(0)
                    for col, v in zip(out, (int(first[i + 1] - first[i]), x.astype("<u4").tobytes(), _sorted(exact_items[i]), _sorted(near_items[i])), strict=True):
                        col.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["block_id"]] * n_docs, pa.int64()), pa.array(range(n_docs), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.list_(pa.string())), pa.array(out[3], pa.list_(pa.string()))],
                    ["block_id", "row", "doc_id", "n_words", "spans", "items", "near"],
                )

    return index.mapInArrow(X.tidy(run), MATCH_SCHEMA)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hits, spans = [], []
        for raw in b.column("spans").to_pylist():
            x = np.sort(np.concatenate([np.frombuffer(s, "<u4").reshape(-1, 2).astype(np.int64) for s in raw] or [np.zeros((0, 2), np.int64)]).view([("a", "i8"), ("z", "i8")]).ravel())
            out: list[list[int]] = []
            for a, z in x.tolist():
                if out and a <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], z)
                else:
                    out.append([a, z])
            spans.append([{"start": a, "end": z} for a, z in out])
            hits.append(sum(z - a for a, z in out))
        names = [_sorted(set().union(*x)) for x in b.column("items").to_pylist()]
        near = [_sorted(set().union(*x)) for x in b.column("near").to_pylist()]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("n_words"), pa.array(hits, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(near, pa.list_(pa.string())), pa.array(spans, kind)],
            ["doc_id", "n_words", "n_hit", "items", "near_items", "spans"],
        )


def matches(documents: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 2, part_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside exact matches), items and near_items (item_ids as strings,
    sorted; near ones include the exact), spans (start and end in words)."""
    spark = documents.sparkSession
    ship(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    passes, done, sent = [], [], []
    for p in range(parts):
        part = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)
        w = Windows([(r[0], r[1]) for r in part.collect()], size)
        vocabulary = spark.sparkContext.broadcast(w.vocabulary)
        index, at = write_table(build_index(documents, vocabulary))
        vocabulary.destroy()
        w.rarest_first(term_totals(index, len(w.vocabulary)))
        passes.append((index, spark.sparkContext.broadcast(w)))
        done.append(at)
        sent.append(passes[-1][1])
    found = [match(i, w, slop) for i, w in passes]
    if parts == 1:
        merged = found[0].select("doc_id", "n_words", F.array("spans").alias("spans"), F.array("items").alias("items"), F.array("near").alias("near"))
    else:
        # Blocks are cut alike in every pass, so (block_id, row) names the same document in each.
        both = found[0]
        for f in found[1:]:
            both = both.unionAll(f)
        merged = both.groupBy("block_id", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"), F.collect_list("near").alias("near")).drop("block_id", "row")
    # Written before the index goes: a row per document that is small beside its text.
    out, _ = write_table(merged.mapInArrow(X.tidy(_merge), "doc_id long, n_words long, n_hit long, items array<string>, near_items array<string>, spans array<struct<start:long,end:long>>"))
    for at in done:
        drop_table(spark, at)
    for b in sent:
        b.destroy()
    return out


def report(found: DataFrame) -> DataFrame:
    """The digest of matches(): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
