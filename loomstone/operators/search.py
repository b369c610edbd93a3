"""FL15: items that hold a literal, found by a trigram posting table before any text is read.

index() numbers the items, keeps their searched texts beside the table, and writes a row for each distinct trigram of a block of items (a
batch of a task) with the places of those that hold it, as distances, of which those of common trigrams compress to little. Each task writes
its rows to folders by the trigram, so nothing is shuffled and a search reads the folders of its own trigrams only. An item is a candidate if it is in the lists of all of
a literal's trigrams, which are intersected block by block; candidates' texts are then compared. Which fields of an item are searched
depends on its section. Literals under three characters have no trigram: for them all texts are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.shipping import ship

#: ---- fixed values: the searched fields of each section, as columns of items ----
SEARCHED = {"procedures": "a", "principles": "a", "atomic_units": "a", "playbooks": "a"}
BOTH = "concat_ws(' ', a, b)"
#: ---- end of fixed values ----
#: Folders that the posting table is dealt to.
BUCKETS = 256
KEYS = ["pkg", "section", "ord"]
#: Bits of an item's number that tell its place in a block.
PLACE = 14


def searched(items: DataFrame) -> DataFrame:
    """(pkg, section, ord, x): the text of each item (pkg, section, ord, a, b) that a search looks at, in lower case."""
    text = "CASE section " + " ".join(f"WHEN '{s}' THEN coalesce({x}, '')" for s, x in SEARCHED.items()) + f" ELSE {BOTH} END"
    return items.select(*KEYS, F.lower(F.expr(text)).alias("x"))


def _bucket(gram) -> F.Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _packed(at: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Ascending places of lists one after the other as a text of bytes each: distances of two bytes, of a list all lower ones first, as
    most upper ones are 0."""
    starts = np.cumsum(lengths) - lengths
    far = np.diff(at, prepend=0)
    far[starts] = at[starts]
    out, place = np.empty(2 * len(at), np.uint8), np.arange(len(at)) + np.repeat(starts, lengths)
    out[place] = far & 255
    out[place + np.repeat(lengths, lengths)] = far >> 8
    ends = np.concatenate([[0], 2 * np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(out)])


def _places(packed: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(2, -1).T).view("<u2").ravel(), dtype=np.int64)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch of (id, x): block, part, gram, at. A block may reach over batches, so part tells its pieces apart."""
    for batch in batches:
        ids, texts = batch.column("id").to_numpy(), batch.column("x").to_pylist()
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
        whole = row[2:] == row[:-2]
        grams, of = (codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])[whole], ids[row[:-2][whole]]
        for block in np.unique(of >> PLACE):
            own = of >> PLACE == block
            found, nth = np.unique(grams[own], return_inverse=True)
            each = np.unique(nth << PLACE | of[own] & ((1 << PLACE) - 1))  # by trigram and place, each once
            lengths = np.bincount(each >> PLACE, minlength=len(found))
            said = np.stack([found >> 42, found >> 21 & 0x1FFFFF, found & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            n = len(found)
            cols = [pa.array(np.full(n, block)), pa.array(np.full(n, ids[0])), pa.array([said[i : i + 3] for i in range(0, 3 * n, 3)], pa.string()), _packed(each & ((1 << PLACE) - 1), lengths)]
            yield pa.RecordBatch.from_arrays(cols, ["block", "part", "gram", "at"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lists that a literal's trigrams have in a block (literal, block, ats): literal and id of the items that are in all."""
    for batch in batches:
        rows, ids = [], []
        for i, (block, ats) in enumerate(zip(batch.column("block").to_pylist(), batch.column("ats").to_pylist(), strict=True)):
            both = None
            for at in sorted(ats, key=len):
                both = _places(at) if both is None else np.intersect1d(both, _places(at), assume_unique=True)
                if not len(both):
                    break
            rows.append(np.full(len(both), i))
            ids.append((block << PLACE) + both)
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column("literal").take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(ids))], ["literal", "id"])


def index(items: DataFrame, path: str) -> None:
    """Write the posting table of items to folder path, and their numbered texts beside it."""
    ship(items.sparkSession)
    searched(items).withColumn("id", F.monotonically_increasing_id()).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}_items")
    texts = items.sparkSession.read.parquet(f"{path}_items").select("id", "x")
    rows = texts.mapInArrow(_postings, "block long, part long, gram string, at binary").withColumn("bucket", _bucket("gram"))
    # Within a file rows are sorted by trigram, so that row groups are skipped by their statistics as well.
    rows.sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").mode("overwrite").option("compression", "zstd").parquet(path)


def _held(spark: SparkSession, path: str, literals: list[str]) -> DataFrame:
    """(literal, pkg, section, ord, x) of items that hold all trigrams of a literal of three characters or more."""
    ship(spark)
    grams = [(s, s.lower()[i : i + 3]) for s in literals for i in range(len(s.lower()) - 2)]
    asked = spark.createDataFrame(sorted(set(grams)), "literal string, gram string")  # as many as the literals are long
    sizes = asked.groupBy("literal").agg(F.count("*").alias("n"))
    # Their folders are worked out first: read as literals, they prune the table before it is listed.
    folders = [r[0] for r in asked.select(_bucket("gram").alias("b")).distinct().collect()]
    wanted = [g for _, g in sorted(set(grams))]
    postings = spark.read.parquet(path).where(F.col("bucket").isin(folders) & F.col("gram").isin(wanted))
    # All trigrams of an item are in one part of its block, each once.
    lists = postings.join(F.broadcast(asked), "gram").groupBy("literal", "block", "part").agg(F.collect_list("at").alias("ats")).join(F.broadcast(sizes), "literal").where("size(ats) = n")
    found = lists.select("literal", "block", "ats").mapInArrow(_met, "literal string, id long")
    return found.join(spark.read.parquet(f"{path}_items"), "id").select("literal", *KEYS, "x")


def candidates(spark: SparkSession, path: str, literals: list[str]) -> DataFrame:
    """(literal, pkg, section, ord) of items that hold all trigrams of a literal of three characters or more."""
    return _held(spark, path, literals).select("literal", *KEYS)


def search(items: DataFrame, path: str, literals: list[str]) -> DataFrame:
    """(literal, pkg, section, ord) of each item that holds a literal, in either case, in a searched field."""
    spark = items.sparkSession
    literals = sorted(set(literals))
    rows, found = searched(items), None
    if long := [s for s in literals if len(s.lower()) > 2]:
        found = _held(spark, path, long).where(F.contains("x", F.lower("literal"))).select("literal", *KEYS)
    for s in (s for s in literals if len(s.lower()) <= 2):
        part = rows.where(F.contains("x", F.lit(s.lower()))).select(F.lit(s).alias("literal"), *KEYS)
        found = part if found is None else found.unionByName(part)
    return rows.select(F.lit("").alias("literal"), *KEYS).where("false") if found is None else found
