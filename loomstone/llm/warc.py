"""Operator 10, WARC: archives written record by record, and read back by boundary-chain verification.

Writing: one record per page, its payload the html in UTF-8. Of pages with equal payloads of `least` bytes or more the one
with the smallest page_id is a response, the others are revisits without a payload block. Archives are written by Spark
(any file system it can write to); each task rotates its archive after a number of records, set for each class of payload sizes.

Reading: tasks look for the record magic in their archives and emit every candidate with the offset of the record that
would follow it. A candidate inside a payload looks like a record but is no link of the chain from the file's start: pointer
jumping (doubling of the successor pointers, log2 of the longest chain rounds) marks what is reachable from offset 0, and
only that is kept. A chain must end exactly at the file's end.

Defined results: a null html is an empty payload; a null page_id or url is written as an absent header and read as null
(a null page_id sorts last among equal payloads); rows that repeat page_id and payload are one response and revisits of it;
an empty table gives archives without records and an empty result; a revisit without its response is read with payload_bytes
null; white space and control characters of a url are written as %20; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm._runtime import drop_table, shared_dir, ship, write_table

MAGIC = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a record beside its payload, about; and how far pages of one size class lie apart.
HEADER, SPREAD = 700, 8
#: Most revisits (40 bytes each) that are broadcast to the writers; beyond it they are joined by shuffle.
BROADCAST_REVISITS = 200_000


def _base32(hex_col):
    """Bare upper-case base32 of a 40-digit hex SHA-1: 160 bits are 32 digits of 5 bits, taken 20 bits at a time."""
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    wide = [F.conv(F.substring(hex_col, 1 + 10 * i, 10), 16, 10).cast("long") for i in range(4)]
    one = [F.substring(F.lit(digits), (F.shiftright(w, 35 - 5 * j).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for w in wide for j in range(8)]
    return F.concat(*one)


def _rows(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
        F.octet_length(html).cast("long").alias("bytes"), F.sha1(html.cast("binary")).alias("sha"), F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("key"),
    )


def _is_copy():
    return F.coalesce(F.col("again") & ~F.col("tied"), F.lit(False))


def write(pages: DataFrame, path: str, least: int = 0, archive_bytes: int = 32 << 20) -> None:
    """Write the archives of pages into folder path: part-*.txt files of concatenated WARC records of about archive_bytes each."""
    rows = _rows(pages)
    narrow = rows.select("sha", "bytes", "key", F.col("page_id").isNull().alias("no_id"), "page_id")
    stats = narrow.agg(F.count("*").alias("n"), F.sum("bytes").alias("b"), F.max("bytes").alias("most")).first()
    mean = HEADER + (stats["b"] or 0) / max(1, stats["n"])
    same = narrow.where(F.col("bytes") >= least).groupBy("sha", "bytes", "key", "no_id", "page_id").agg(F.count("*").alias("n"))
    groups = same.groupBy("sha", "bytes").agg(F.sum("n").alias("all"), F.min(F.struct("no_id", "page_id", "key")).alias("first")).where("all > 1")
    again = same.join(groups.select("sha", "bytes", "first"), ["sha", "bytes"]).where("key != first.key OR n > 1")
    again = again.select("sha", "key", F.col("first.page_id").alias("first_id"), (F.col("key") == F.col("first.key")).alias("tied"), F.lit(True).alias("again"))
    again, again_at = write_table(again)
    side = F.broadcast(again) if again.count() <= BROADCAST_REVISITS else again
    x = rows.join(side, ["sha", "key"], "left").withColumn("tied", F.coalesce("tied", F.lit(False)))
    done = [again_at]
    if again.where("tied").isEmpty():
        x = x.withColumn("is_copy", _is_copy())
    else:
        # Rows alike in page_id and payload: one of them is the response. Which one is settled in a table of their own.
        tied, tied_at = write_table(x.where("tied").withColumn("uid", F.monotonically_increasing_id()))
        done.append(tied_at)
        one = tied.groupBy("sha", "key").agg(F.min("uid").alias("one"))
        tied = tied.join(one, ["sha", "key"]).withColumn("is_copy", F.col("uid") != F.col("one")).drop("uid", "one")
        x = x.where("NOT tied").withColumn("is_copy", _is_copy()).unionByName(tied)
    rev = F.coalesce(F.col("is_copy"), F.lit(False))
    line = lambda name, value: F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))
    clean = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    header = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(rev, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), F.col("sha"), F.lit(">"))),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), _base32(F.col("sha")))),
        F.when(rev, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("first_id").cast("string"), F.lit("")), F.lit(">"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(rev, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
    )
    record = F.concat(header, F.when(rev, F.lit("")).otherwise(F.col("html")))
    # Each record ends with two line ends; the text writer puts what ends a row there. An archive holds so many records that
    # none exceeds SPREAD times archive_bytes or one record: pages far above the mean go to archives of their own size class.
    low, high = -1, SPREAD * mean
    while True:
        per_file = max(1, int(archive_bytes * SPREAD / high))
        within = x.where((F.col("bytes") > low) & (F.col("bytes") <= int(high)))
        within.select(record.alias("value")).write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).text(path)
        if int(high) >= (stats["most"] or 0):
            break
        low, high = int(high), high * SPREAD
    for at in done:
        drop_table(pages.sparkSession, at)


_HEAD = re.compile(rb"(?:[^\r\n:]+:[^\r\n]*\r\n)*\r\n")
_FIELD = re.compile(rb"([^\r\n:]+):[ \t]*([^\r\n]*)\r\n")
_ID = re.compile(rb"<urn:page:(-?\d*)(?::[0-9a-f]+)?>")
CANDIDATE = "file string, at long, next long, size long, page_id long, record_type string, refers_to long, stated string, payload_bytes long, payload_digest string"


def _number(raw: bytes | None) -> int | None:
    m = _ID.fullmatch(raw or b"")
    return int(m[1]) if m and m[1] else None


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in CANDIDATE.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    for b in batches:
        for i in range(b.num_rows):
            file, raw = b.column("path")[i].as_py(), b.column("content")[i].as_buffer()
            view = memoryview(raw)
            text = bytes(view)
            out, at = [], text.find(MAGIC)
            while at >= 0:
                head = _HEAD.match(text, at + len(MAGIC))
                if head:
                    f = {k.lower(): v for k, v in _FIELD.findall(text, at + len(MAGIC), head.end() - 2)}
                    length = f.get(b"content-length", b"")
                    if length.isdigit() and head.end() + int(length) + 4 <= len(text):
                        end = head.end() + int(length)
                        payload = view[head.end() : end]
                        if text[end : end + 4] == b"\r\n\r\n":
                            sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                            stated = f.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("ascii", "replace")
                            out.append((file, at, end + 4, len(text), _number(f.get(b"warc-record-id")), f.get(b"warc-type", b"").decode("ascii", "replace"), _number(f.get(b"warc-refers-to")), stated, len(payload), sha))
                at = text.find(MAGIC, at + 1)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place in the archives of folder path that reads like a record, with its successor's offset and its own content."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_scan, CANDIDATE)


def reachable(links: DataFrame) -> tuple[DataFrame, str]:
    """The table, and its path, of (file, at) of the links (file, at, next, size) that lie on the chain from offset 0, by pointer jumping.

    Each round doubles the reach of the pointers: from the marked links those that a pointer leads to are marked, and each
    pointer becomes its pointer's pointer. After round r all links up to 2**r steps from the start are marked.
    """
    jump, path = write_table(links.select("file", "at", "next").distinct())
    spark = links.sparkSession
    marked, mpath = write_table(jump.where("at = 0").select("file", "at"))
    total = -1
    while True:
        more = marked.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        hop = jump.select("file", F.col("at").alias("next"), F.col("next").alias("over"))
        nxt, npath = write_table(marked.unionAll(more).distinct())
        far, fpath = write_table(jump.join(hop, ["file", "next"]).select("file", "at", F.col("over").alias("next")))
        now = nxt.count()
        drop_table(spark, path)
        drop_table(spark, mpath)
        jump, path, marked, mpath = far, fpath, nxt, npath
        if now == total:
            drop_table(spark, path)
            return marked, mpath
        total = now


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives in folder path, verified: page_id, payload_bytes and payload_digest of the full payload,
    record_type, refers_to. Fails if a chain does not end at its file's end or a payload does not have its stated digest."""
    found, found_at = write_table(candidates(spark, path))
    chain, chain_at = reachable(found)
    kept = found.join(chain, ["file", "at"])
    ends = found.select("file", "size").distinct().join(chain.withColumn("size", F.col("at")), ["file", "size"], "left_anti")
    if not ends.isEmpty():
        raise ValueError(f"archives with a broken chain: {[r['file'] for r in ends.limit(3).collect()]}")
    responses = kept.where("record_type = 'response'").groupBy(F.col("stated").alias("payload_digest")).agg(F.max("payload_bytes").alias("full_bytes"))
    revisits = kept.where("record_type = 'revisit'").select("page_id", F.col("stated").alias("payload_digest"), "record_type", "refers_to")
    # A revisit whose response lies elsewhere keeps its digest and has no known size.
    revisits = revisits.join(responses, "payload_digest", "left").select("page_id", F.col("full_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    own = kept.where("record_type != 'revisit'")
    checked = F.when(F.col("stated") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest at "), "file", F.lit(":"), F.col("at").cast("string"))).cast("string"))
    out, _ = write_table(own.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to").unionByName(revisits))
    for at in (found_at, chain_at):
        drop_table(spark, at)
    return out


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder and return what reading them back gives, one row per page."""
    spark = pages.sparkSession
    import uuid

    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, least)
    return read(spark, path)
