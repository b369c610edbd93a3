"""Operator 8, n-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Documents with equal shingle sets form one class, found by a 128-bit digest of the set. Tokens (shingles) are ordered by a
corpus-wide frequency sketch, rarest first, ties by hash; any order common to all sets makes prefix filtering exact. Classes
that share a prefix token are compared through that token's smallest class first, and what those links join already needs
no further comparison: only pairs that are still in different components are enumerated. So a group of thousands of near
copies gives a star of pairs, not all pairs, and the components are those of the full relation. Each pair passes the length,
positional and suffix filters (the last by histograms over hash ranges) and is verified once against the whole sets of
64-bit shingle hashes. Scratch tables and broadcasts are deleted before the result is returned.

Defined results: a document without words or text (or null) has the empty set and links with nothing; ties and repeated
rows share a class; an empty table gives an empty result; extra columns are ignored. Rows with a null doc_id are returned
with their set size and component null, and link with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import _text as X
from loomstone.llm._runtime import HOT_ROWS, HOT_SHARE, components, drop_table, hot_keys, ship, spread_join, write_table

SLICE = 1 << 19
_PIECES = 256
#: Hash ranges whose token counts the suffix filter compares, and classes of a token that one task compares with as many.
RANGES, CELL = 256, 1024
#: Most ids (24 bytes each) of documents whose set is another's that are broadcast; beyond it they are joined by shuffle.
BROADCAST_IDS = 200_000
#: Most candidate documents that are looked for by a bitmap.
MAP_IDS = 1 << 24
#: Pairs that one step of _cells() looks at.
STEP = 1 << 17


def _sets(b: pa.RecordBatch, k: int, kind: str, pick=None) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of the rows of a batch; pick: a mask of rows."""
    table = X.word_bytes(kind)
    data, offs = X.buffers(b.column("text"))
    for lo, hi in X.slices(offs, SLICE):
        if pick is not None and not pick[lo:hi].any():
            continue
        d, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        s, e, first = X.words(d, o, table)
        sh, at = X.shingles(X.range_hashes(d, s, e), first, k)
        for i in range(hi - lo):
            if pick is None or pick[lo + i]:
                yield lo + i, np.unique(sh[at[i] : at[i + 1]])


def frequency_sketch(docs: DataFrame, k: int, kind: str, bits: int) -> np.ndarray:
    """Occurrences of shingles over the whole corpus by the top `bits` bits of their hash, on a scale of sixths of a power of two.

    Its size is fixed by `bits` alone: tasks emit it in pieces (65535 of a counter at most from a task), which are summed on the
    executors without a bound. It decides only the order of tokens, never a result: a shingle far more frequent than the
    average counter keeps its late place however large the corpus is."""
    size = 1 << bits
    piece = max(1, size // _PIECES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = X.word_bytes(kind), np.zeros(size, np.uint32)
        for b in batches:
            data, offs = X.buffers(b.column("text"))
            for lo, hi in X.slices(offs, SLICE):
                d, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                s, e, first = X.words(d, o, table)
                sh, _ = X.shingles(X.range_hashes(d, s, e), first, k)
                idx, n = np.unique((sh >> np.uint64(64 - bits)).astype(np.int32), return_counts=True)
                total[idx] += n.astype(np.uint32)
        if total.any():
            small = np.minimum(total, 65535).astype("<u2")
            for p in range(0, size, piece):
                if (x := small[p : p + piece]).any():
                    yield pa.RecordBatch.from_arrays([pa.array([p // piece], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(raw, "<u2").astype(np.uint64)
                sums[p] = sums[p] + x if p in sums else x
        for p, x in sums.items():
            scale = np.minimum(np.log2(x.astype(np.float64) + 1) * 6, 255).astype(np.uint8)  # 255 is above 2**42
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([scale.tobytes()], pa.binary())], ["piece", "counts"])

    out = np.zeros(size, np.uint8)
    parts = docs.select("text").mapInArrow(X.tidy(count), "piece int, counts binary").repartition("piece").mapInArrow(X.tidy(add), "piece int, counts binary")
    for r in parts.collect():  # a table of fixed size: 2**bits bytes
        out[r["piece"] * piece : (r["piece"] + 1) * piece] = np.frombuffer(r["counts"], np.uint8)
    return out


def _prefix_rows(sketch, k: int, kind: str, num: int, den: int, bits: int):
    """Rows (doc_id, n, d1, d2, sig, prefix) of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        order = sketch.value
        bounds = np.arange(1, RANGES, dtype=np.uint64) << np.uint64(56)
        for b in batches:
            ids = b.column("doc_id")
            rows, ns, d1, d2, sigs, prefixes = [], [], [], [], [], []

            def flush():
                return pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows, pa.int64())), pa.array(ns, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sigs, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                    ["doc_id", "n", "d1", "d2", "sig", "prefix"],
                )

            for i, u in _sets(b, k, kind):
                n = len(u)
                rows.append(i)
                ns.append(n)
                if n:
                    h = np.frombuffer(xxhash.xxh3_128_digest(u), np.int64)
                    d1.append(int(h[0]))
                    d2.append(int(h[1]))
                    cut = np.searchsorted(u, bounds)
                    sigs.append(np.minimum(np.diff(np.concatenate([[0], cut, [n]])), 255).astype(np.uint8).tobytes())
                    need = -(-n * num // den)  # an equal or larger set shares so many at least
                    seen = order[(u >> np.uint64(64 - bits)).astype(np.int64)]
                    prefixes.append(X.signed(u[np.argsort(seen, kind="stable")[: n - need + 1]]))
                else:
                    d1.append(0)
                    d2.append(0)
                    sigs.append(b"")
                    prefixes.append(np.zeros(0, np.int64))
                if len(rows) >= 2000:
                    yield flush()
                    rows, ns, d1, d2, sigs, prefixes = [], [], [], [], [], []
            if rows:
                yield flush()

    return run


def _bitmap(ids: DataFrame, col: str, bits: int) -> bytes:
    """A bitmap of 2**bits bits over hashed ids, made on the executors: which documents may be needed."""
    h = F.pmod(F.xxhash64(col), F.lit(1 << bits))
    parts = ids.groupBy(F.bitmap_bucket_number(h + 1).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h + 1)).alias("m"))
    out = bytearray((1 << bits) // 8)
    for r in parts.collect():  # at most 2**bits bits
        at = (r["b"] - 1) * 4096
        out[at : at + 4096] = r["m"]
    return bytes(out)


def _set_rows(docs: DataFrame, k: int, kind: str, ids: DataFrame, n: int) -> tuple[DataFrame, Broadcast | None]:
    """(doc_id, tokens) of the documents that may be among the n ids (column a), and the broadcast that this reads.

    Up to MAP_IDS ids a bitmap of 16 bits an id (1 to 32 MB) says which texts to work on; beyond it the documents are
    joined with the ids."""
    spark = docs.sparkSession
    bits = max(23, (16 * n - 1).bit_length())
    sent = None if n > MAP_IDS else spark.sparkContext.broadcast(_bitmap(ids, "a", bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = None if sent is None else np.frombuffer(sent.value, np.uint8)
        for b in batches:
            if raw is not None:
                p = b.column("pos").to_numpy(zero_copy_only=False).astype(np.int64)
                b = b.filter(pa.array((raw[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1))
            if not b.num_rows:
                continue
            for part in batched(_sets(b, k, kind), 200):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array([i for i, _ in part], pa.int64())), pa.array([u.tobytes() for _, u in part], pa.binary())], ["doc_id", "tokens"])

    some = docs.where("doc_id IS NOT NULL")
    if sent is None:
        some = some.join(ids.select(F.col("a").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return some.withColumn("pos", F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))).mapInArrow(X.tidy(run), "doc_id long, tokens binary"), sent


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            (da, oa), (db, ob) = X.buffers(b.column("ta")), X.buffers(b.column("tb"))
            for i in range(b.num_rows):
                x = np.frombuffer(da[oa[i] : oa[i + 1]].tobytes(), np.uint64)
                y = np.frombuffer(db[ob[i] : ob[i + 1]].tobytes(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep[i] = den * both >= num * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep))

    return run


def _close(x: np.ndarray, y: np.ndarray, total: np.ndarray, num: int, den: int) -> np.ndarray:
    """Suffix filter: the token counts of RANGES hash ranges differ by no more than two similar sets of `total` tokens can.

    A range that holds 255 tokens or more counts as 255: that only lowers the difference, so no similar pair is lost."""
    # |x ^ y| = total - 2 both, and both * (den + num) >= num * total
    most = total - 2 * (-(-num * total // (den + num)))
    return np.abs(x.astype(np.int16) - y.astype(np.int16)).sum(1) <= most


def _far(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(np.ascontiguousarray(X.buffers(b.column(c))[0]).tobytes(), np.uint8).reshape(-1, RANGES) for c in ("sa", "sb"))
            total = b.column("na").to_numpy(zero_copy_only=False) + b.column("nb").to_numpy(zero_copy_only=False)
            yield b.select(["a", "b"]).filter(pa.array(_close(x, y, total, num, den)))

    return run


def _cells(posts: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs (a, b) of classes that share a token, lie in different components and pass the filters.

    posts: (token, id, n, pos, component, sig, df, main). A token's classes are cut into blocks of about CELL and compared block
    by block on the executors; only what passes all filters is emitted, so no list of all pairs is ever made. Of a token with
    more classes than CELL those of its largest component, `main`, are compared with the others only, so one that a large group of
    copies shares costs as much as the classes outside that group."""
    split = F.col("df") > CELL
    x = posts.withColumn("in_main", split & (F.col("component") == F.col("main")))
    blocks = lambda rows: F.ceil(rows / CELL).cast("int")
    x = x.withColumn("nm", F.when(split, blocks(F.col("n_main"))).otherwise(0)).withColumn("ns", F.when(split, blocks(F.col("df") - F.col("n_main"))).otherwise(1))
    x = x.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("in_main"), F.col("nm")).otherwise(F.col("ns"))).cast("int"))
    # Cells (mixed = false, i <= j) hold two blocks of the others, cells (mixed = true, i, j) one of the others and one of main.
    x = x.withColumn("to", F.explode(F.sequence(F.lit(0), F.when(F.col("in_main"), F.col("ns")).otherwise(F.col("ns") + F.col("nm")) - 1)))
    x = x.withColumn("mixed", F.col("in_main") | (F.col("to") >= F.col("ns")))
    i = F.when(F.col("in_main"), F.col("to")).when(F.col("mixed"), F.col("own")).otherwise(F.least("own", "to"))
    j = F.when(F.col("in_main"), F.col("own")).when(F.col("mixed"), F.col("to") - F.col("ns")).otherwise(F.greatest("own", "to"))
    x = x.withColumn("i", i).withColumn("j", j).withColumn("second", F.col("in_main") | (~F.col("mixed") & (F.col("own") > F.col("i"))))
    cell = ["token", "mixed", "i", "j"]
    x = x.select(*cell, "second", "id", "n", "pos", "component", "sig").repartition(*cell).sortWithinPartitions(*cell, "second")

    def compare(t: pa.RecordBatch, starts: np.ndarray) -> Iterator[np.ndarray]:
        """Pairs of whole cells, given where each starts: rows of a cell's first block with those of its second, or with the
        rows after them where it has one block only."""
        col = {c: t.column(c).to_numpy(zero_copy_only=False) for c in ("second", "id", "n", "pos", "component")}
        sig = X.buffers(t.column("sig"))[0].reshape(-1, RANGES)
        size = np.diff(np.append(starts, t.num_rows))
        rows, end, firsts = np.arange(t.num_rows), np.repeat(starts + size, size), np.add.reduceat(~col["second"], starts, dtype=np.int64)
        alone = (t.column("mixed").to_numpy(zero_copy_only=False) == False) & (t.column("i").to_numpy() == t.column("j").to_numpy())  # noqa: E712
        begin = np.where(alone, rows + 1, np.repeat(starts + firsts, size))
        many = np.where(col["second"], 0, end - begin)
        upto = np.concatenate([[0], np.cumsum(many)])
        lo = 0
        while lo < t.num_rows:
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + STEP, "right")) - 1)
            c = many[lo:hi]
            a = np.repeat(rows[lo:hi], c)
            b = np.repeat(begin[lo:hi] - (upto[lo:hi] - upto[lo]), c) + np.arange(len(a))
            na, nb = col["n"][a], col["n"][b]
            total = na + nb
            ok = (col["component"][a] != col["component"][b]) & (np.minimum(na, nb) * den >= np.maximum(na, nb) * num)
            ok &= np.minimum(na - col["pos"][a], nb - col["pos"][b]) >= -(-num * total // (den + num))
            a, b, total = a[ok], b[ok], total[ok]
            for at in range(0, len(a), 1 << 14):
                p, q = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
                near = _close(sig[p], sig[q], total[at : at + (1 << 14)], num, den)
                p, q = col["id"][p[near]], col["id"][q[near]]
                if len(p):
                    yield np.stack([np.minimum(p, q), np.maximum(p, q)])
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def pairs(t: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for p in compare(t, starts):
                yield pa.RecordBatch.from_arrays([pa.array(p[0], pa.int64()), pa.array(p[1], pa.int64())], ["a", "b"])

        for b in batches:
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            new[0] = True
            for c in cell:
                v = b.column(c).to_numpy(zero_copy_only=False)
                new[1:] |= v[1:] != v[:-1]
            starts = np.flatnonzero(new)
            # The last cell may go on in the next batch.
            if starts[-1]:
                yield from pairs(b.slice(0, starts[-1]), starts[:-1])
            held = b.slice(starts[-1])
        if held is not None and held.num_rows:
            yield from pairs(held, np.zeros(1, np.int64))

    return x.mapInArrow(X.tidy(run), "a long, b long").distinct()


def _links(pairs: DataFrame, tokens: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough; the pairs of a document with many are dealt over several tasks."""
    n = pairs.count()
    hot = {c: hot_keys(pairs.groupBy(c).agg(F.count("*").alias("n")), c, "n", n) for c in ("a", "b")}
    left = spread_join(pairs, tokens.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tb")), "b", hot["b"], "a")
    both = spread_join(left, tokens.select(F.col("doc_id").alias("a"), F.col("tokens").alias("ta")), "a", hot["a"], "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(X.tidy(_verify(num, den)), "a long, b long")


def _headed(rows: DataFrame, heads: DataFrame, hot: int) -> DataFrame:
    """rows with what heads has of their set (d1, d2), null without a head. Sets of more than `hot` documents, few by that
    bound, are joined by broadcast, so that no task has the copies of one set; only the other rows are shuffled."""
    key = ["d1", "d2"]
    more = [c for c in heads.columns if c not in (*key, "copies")]
    large = heads.where(F.col("copies") > hot).drop("copies").withColumn("is_hot", F.lit(True))
    met = rows.join(F.broadcast(large), key, "left")
    cold = met.where("is_hot IS NULL").select(*rows.columns).join(heads.where(F.col("copies") <= hot).drop("copies"), key, "left")
    return met.where("is_hot").select(*rows.columns, *more).unionByName(cold.select(*rows.columns, *more))


def classes(documents: DataFrame, k: int = 5, num: int = 8, den: int = 10, kind: str = "nonspace", sketch_bits: int = 20, stars: int = 1) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id.

    Two documents link when den * |intersection| >= num * |union| of their k-word shingle sets.
    """
    spark: SparkSession = documents.sparkSession
    ship(spark)
    src = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = spark.sparkContext.broadcast(frequency_sketch(src, k, kind, sketch_bits))
    rows, rows_at = write_table(src.mapInArrow(X.tidy(_prefix_rows(sketch, k, kind, num, den, sketch_bits)), "doc_id long, n long, d1 long, d2 long, sig binary, prefix array<long>"))
    full = rows.where("n > 0 AND doc_id IS NOT NULL")
    # Sets of one document need no head: it is its own.
    heads, heads_at = write_table(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"))
    hot = max(HOT_ROWS, rows.count() // HOT_SHARE)
    headed = _headed(full.select("doc_id", "d1", "d2"), heads, hot)
    # One row per class, that of its smallest doc_id: the others are few as a rule, and go by their ids alone.
    others = headed.where("doc_id != rep").select("doc_id", "d1", "d2").distinct()
    others, others_at = write_table(others)
    if others.count() <= BROADCAST_IDS:
        others = F.broadcast(others)
    reps = full.join(others, ["doc_id", "d1", "d2"], "left_anti").select(F.col("doc_id").alias("id"), "n", "sig", "prefix")
    posts = reps.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    half = lambda salt: F.sum(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 32)))
    # Narrow rows find the tokens of several classes; only those classes' rows go on, and stay where their token is.
    several, several_at = write_table(posts.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"))
    hot_tokens = hot_keys(several, "token", "df", several.agg(F.sum("df")).first()[0] or 0)
    posts, met_at = write_table(spread_join(posts, several, "token", hot_tokens, "id"))
    shared = posts.groupBy("token").agg(F.max("df").alias("df"), F.min(F.struct("id", "pos")).alias("lead"), half(1).alias("h1"), half(2).alias("h2"))
    # Tokens with the same classes say the same: of them the first in the common order stays, whose places bound the overlap.
    shared = shared.groupBy("df", F.col("lead.id").alias("lead"), "h1", "h2").agg(F.min_by("token", "lead.pos").alias("token"))
    shared, shared_at = write_table(shared.select("token", "df"))
    posts, posts_at = write_table(spread_join(posts, shared.select("token"), "token", hot_tokens, "id"))
    drop_table(spark, several_at)
    drop_table(spark, met_at)
    sigs = reps.select("id", "sig")

    def fits(p: DataFrame, hot: DataFrame | None) -> DataFrame:
        """Length and positional filters on (a, na, pa, b, nb, pb), then one row per pair, then the suffix filter."""
        small, large = F.least("na", "nb"), F.greatest("na", "nb")
        need = F.ceil(F.lit(num) * (F.col("na") + F.col("nb")) / F.lit(num + den))
        bound = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
        # At a later common token than the first the bound counts only what follows, so it may speak only for the pair's first.
        p = p.where(small * den >= large * num)
        p = p.groupBy("a", "b").agg(F.max(bound).alias("bound"), F.first("na").alias("na"), F.first("nb").alias("nb")).where(F.col("bound") >= need)
        p = p.join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
        p = spread_join(p, sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a", hot, "b")
        return p.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(X.tidy(_far(num, den)), "a long, b long")

    comp, tried, scratch = None, None, [posts_at, shared_at, others_at, heads_at, rows_at]
    for rnd in range(stars + 1):
        tagged = posts.withColumn("component", F.col("id")) if comp is None else posts.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
        if rnd < stars:
            # Compare with the token's leader: the smallest class, in later rounds that of the component with the largest number.
            pick = F.min(F.struct("id", "n", "pos", "component")) if rnd == 0 else F.max(F.struct("component", "id", "n", "pos"))
            lead, lead_at = write_table(tagged.groupBy("token").agg(pick.alias("l"), F.count("*").alias("df")))
            scratch.append(lead_at)
            led = lead.groupBy(F.col("l.id").alias("a")).agg(F.sum("df").alias("n"))
            hot_leads = hot_keys(led, "a", "n", lead.agg(F.sum("df")).first()[0] or 0)
            p = spread_join(tagged.drop("df"), lead.select("token", "l"), "token", hot_tokens, "id").where("component != l.component")
            p = p.select(F.col("l.id").alias("a"), F.col("l.n").alias("na"), F.col("l.pos").alias("pa"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
            p = fits(p, hot_leads)
        else:
            # Only tokens whose classes are in several components still, with the component that has most of them.
            shares = tagged.groupBy("token", "component").agg(F.count("*").alias("n"))
            open_ = shares.groupBy("token").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("df"), F.count("*").alias("parts")).where("parts > 1")
            open_ = open_.select("token", "df", F.col("top.n").alias("n_main"), F.col("top.component").alias("main"))
            p = _cells(spread_join(tagged.drop("df"), open_, "token", hot_tokens, "id").join(sigs, "id"), num, den)
        p = p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        # What an earlier round verified is not verified again.
        pairs, pairs_at = write_table(p if tried is None else p.join(tried, ["a", "b"], "left_anti"))
        scratch.append(pairs_at)
        tried = pairs if tried is None else tried.unionAll(pairs)
        ids = pairs.select("a").unionAll(pairs.select(F.col("b").alias("a")))
        n_ids = ids.agg(F.approx_count_distinct("a")).first()[0]
        if not n_ids:
            continue
        # Only the documents of these pairs are read for their whole sets.
        sets, sent = _set_rows(src, k, kind, ids, n_ids)
        tokens, tokens_at = write_table(sets)
        found, found_at = write_table(_links(pairs, tokens, num, den))
        scratch.append(found_at)
        drop_table(spark, tokens_at)
        if sent is not None:
            sent.destroy()
        if not found.isEmpty():
            known = found if comp is None else found.unionAll(comp.where("id != component").select(F.col("id").alias("a"), F.col("component").alias("b")))
            comp, comp_at = write_table(components(known))
            scratch.append(comp_at)
    if comp is None:
        comp = spark.createDataFrame([], "id long, component long")
    # A class of many copies takes its component from its head; only documents without copies are looked up one by one.
    heads = heads.join(comp, F.col("rep") == F.col("id"), "left").withColumn("component", F.coalesce("component", "rep")).drop("id")
    headed = _headed(rows.select("doc_id", "n", "d1", "d2").where("n > 0 AND doc_id IS NOT NULL"), heads, hot)
    named = headed.where("rep IS NOT NULL").select("doc_id", "n", F.col("rep").alias("class_id"), F.col("component").alias("component_id"))
    alone = headed.where("rep IS NULL").select("doc_id", "n").join(comp, F.col("doc_id") == F.col("id"), "left")
    named = named.unionByName(alone.select("doc_id", "n", F.col("doc_id").alias("class_id"), F.coalesce("component", "doc_id").alias("component_id")))
    rest = rows.where("NOT (n > 0 AND doc_id IS NOT NULL)").select("doc_id", "n", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    out, _ = write_table(named.unionByName(rest).select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id"))
    for at in scratch:
        drop_table(spark, at)
    sketch.destroy()
    return out
