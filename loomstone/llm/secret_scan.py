r"""Operator 13, secret scans: regular expressions over whole texts by way of a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived (Cox, "Regular Expression Matching with a Trigram
Index"): an OR of sets of trigrams all of which a text must hold to match. Trigrams are of the UTF-8 bytes, A-Z in lower case.

1. index(): blocks of rows (an Arrow batch each) are inverted to postings, written as a table (trigram, block, rows). A query
   run keeps the trigrams that its rules ask for; without a choice all are kept, for rules to come.
2. candidates(): postings are joined with the few (rule, set, trigram) rows, grouped by block and set, and the lists of sets that
   are complete are intersected from the shortest one. Groups hold a set's lists of one block: their size is that of a batch.
3. spans(): rows are read once more with their candidate rules, and each rule runs on its candidates only. A rule without
   mandatory trigrams runs on every text.

A match is verified by the rule's own expression, leftmost and non-overlapping; one whose group is shorter than the rule asks for
is dropped, but has taken its text. Places are code points, ends exclusive.

Defined results: a null or empty text has no span; rows are told apart by file and place, so repeated rows, null and shared doc_ids
are scanned each; matches of one rule never overlap, those of different rules may; very long texts are one string each; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import product
from re import _parser  # the standard library's own parse of an expression; tests hold its node names

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm._runtime import drop_table, keyed, ship, write_table
from loomstone.llm._text import _LOWER, buffers, tidy

#: (kind, expression, its group whose length counts, least length, whether letters match in either case). The first three are
#: those of the contract; `{16,}` and `{32,}` say what dropping shorter matches of `+` says, since such a match is a longest run.
BASE = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16, False),
    ("hex", r"[0-9a-f]{32,}", 0, 32, False),
)
#: Published formats of keys and tokens.
MORE = (
    ("private_key", r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----", 0, 0, False),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, False),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0, False),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 0, False),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0, False),
    ("url_login", r"[a-z][a-z0-9+.-]{1,30}://[^\x00-\x20/:@]{1,100}:[^\x00-\x20/:@]{1,100}@", 0, 0, False),
)
RULES = BASE + MORE
#: Places whose trigrams are held at once.
TILE = 1 << 20
#: Most strings that a part of an expression is spelt out to, and most sets of a query; beyond them a query asks for less.
EXACT, SETS = 64, 32
#: Most candidate rows (a key and a number each) that are broadcast; beyond it texts and candidates are joined by shuffle.
BROADCAST_ROWS = 500_000
_ANY: frozenset = frozenset({frozenset()})

Query = frozenset  # of frozensets of trigrams (bytes): one of them must be there whole; _ANY asks for nothing


# ---- from an expression to a query ----
def _least(q: Iterable[frozenset]) -> Query:
    """Without sets that hold another one: the smaller one lets their texts through anyway."""
    q = sorted(set(q), key=len)
    return frozenset(s for i, s in enumerate(q) if not any(t <= s for t in q[:i]))


def _and(a: Query, b: Query) -> Query:
    both = _least(x | y for x, y in product(a, b))
    return both if len(both) <= SETS else min(a, b, key=lambda q: (q == _ANY, len(q)))


def _or(a: Query, b: Query) -> Query:
    either = _least(a | b)
    return either if len(either) <= SETS else _ANY


def _grams(s: bytes) -> frozenset:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _spelt(strings: set[bytes]) -> Query:
    return _least(_grams(s) for s in strings)


def _chars(items, ignore: bool) -> set[bytes] | None:
    """The members of a character class in lower case, None if they are too many to spell out."""
    out: set[int] = set()
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            out.add(arg)
        elif name == "RANGE" and arg[1] - arg[0] < 4 * EXACT:
            out |= set(range(arg[0], arg[1] + 1))
        else:
            return None
    low = {chr(c).encode().translate(bytes(_LOWER)) for c in out}
    return low if len(low) <= EXACT else None


def _walk(tree, ignore: bool) -> tuple[set[bytes] | None, Query]:
    """(all strings that match, if they are few; the query) of a sequence of parsed nodes.

    Strings that are spelt out side by side are put together, so that trigrams reach over nodes; where a node cannot be spelt out,
    those so far give their trigrams and the next ones start anew."""
    query, run, whole = _ANY, {b""}, True
    for op, arg in tree:
        name, exact, own = str(op), None, _ANY
        if name == "LITERAL":
            exact = {chr(arg).encode().translate(bytes(_LOWER))}
        elif name == "IN":
            exact = _chars(arg, ignore)
        elif name == "AT":
            exact = {b""}
        elif name == "SUBPATTERN":
            exact, own = _walk(arg[3], ignore)
        elif name == "BRANCH":
            found = [_walk(x, ignore) for x in arg[1]]
            if all(e is not None for e, _ in found):
                exact = set().union(*(e for e, _ in found))
            own = found[0][1]
            for _, q in found[1:]:
                own = _or(own, q)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, body = arg
            e, q = _walk(body, ignore)
            if e is not None and high != _parser.MAXREPEAT and high * max(map(len, e), default=0) <= 8:
                exact = {b"".join(p) for n in range(low, high + 1) for p in product(e, repeat=n)} if len(e) ** high <= EXACT else None
            own = q if low else _ANY
        if exact is not None and len(exact) > EXACT:
            exact, own = None, _and(own, _spelt(exact))
        if exact is not None and len(run) * len(exact) <= EXACT:
            run = {a + b for a, b in product(run, exact)}
            continue
        query, whole = _and(_and(query, _spelt(run)), own), False
        run = exact if exact is not None else {b""}
    query = _and(query, _spelt(run))
    return (run if whole else None), query


def trigram_query(pattern: str, ignore: bool = False) -> Query:
    """Sets of trigrams of which a text must hold one whole to match; _ANY where none is mandatory."""
    return _walk(_parser.parse(pattern, re.ASCII | (re.IGNORECASE if ignore else 0)), ignore)[1]


def queries(rules) -> list[tuple[int, int, bytes, int]]:
    """(rule, set, trigram, size of the set) of all rules that have mandatory trigrams."""
    out = []
    for r, (_, pattern, _, _, ignore) in enumerate(rules):
        if (q := trigram_query(pattern, ignore)) != _ANY:
            out += [(r, c, t, len(s)) for c, s in enumerate(sorted(q, key=sorted)) for t in sorted(s)]
    return out


# ---- index ----
def _code(t: bytes) -> int:
    return t[0] << 16 | t[1] << 8 | t[2]


def _invert(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(trigrams, rows), sorted and each pair once, of a batch of texts; TILE places at a time, however long a text is."""
    found = [np.zeros(0, np.int64)]
    for lo in range(0, len(data) - 2, TILE):
        low = _LOWER[data[lo : lo + TILE + 2]].astype(np.uint32)
        code = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
        at = np.flatnonzero(wanted[code]) if wanted is not None else np.arange(len(code))
        row = np.searchsorted(offsets, at + lo, "right") - 1
        inside = at + lo + 3 <= offsets[row + 1]  # not over the end of a text
        found.append(np.unique((code[at[inside]].astype(np.int64) << 32) | row[inside]))
    pair = np.unique(np.concatenate(found))
    return pair >> 32, pair & 0xFFFFFFFF


def _indexer(codes: list[int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None
        if codes is not None:
            wanted = np.zeros(1 << 24, bool)
            wanted[codes] = True
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            keys = batch.column("row_key").to_numpy()
            t, r = _invert(*buffers(batch.column("text")), wanted)
            codes_here, first = np.unique(t, return_index=True)
            if len(codes_here):
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(r)).astype(np.int32)), pa.array(keys[r]))
                yield pa.RecordBatch.from_arrays([pa.array(codes_here.astype(np.int32)), pa.array(np.full(len(codes_here), block)), lists], ["trigram", "block", "rows"])
            block += 1

    return tidy(run)


def index(rows: DataFrame, trigrams: Iterable[bytes] | None = None) -> DataFrame:
    """Postings (trigram, block, rows) of keyed rows (row_key, text): the row_keys of a block's texts that hold the trigram (its three
    bytes as one number). All trigrams, or those asked for."""
    codes = None if trigrams is None else sorted({_code(t) for t in trigrams})
    return rows.select("row_key", F.col("text").cast("string").alias("text")).mapInArrow(_indexer(codes), "trigram int, block long, rows array<long>")


def candidates(postings: DataFrame, rules=RULES) -> DataFrame:
    """(row_key, mask): the rows that the trigram queries let through, bit r set for rule r."""
    spark = postings.sparkSession
    asked = [(r, c, _code(t), n) for r, c, t, n in queries(rules)]
    wanted = F.broadcast(spark.createDataFrame(asked, "rule int, part int, trigram int, terms int"))
    lists = F.array_sort(F.collect_list(F.struct(F.size("rows").alias("n"), "trigram", "rows")))
    sets = postings.join(wanted, "trigram").groupBy("block", "rule", "part", "terms").agg(lists.alias("lists")).where(F.size("lists") == F.col("terms"))
    both = F.aggregate(F.slice("lists", 2, 1 << 30), F.col("lists")[0]["rows"], lambda acc, x: F.array_intersect(acc, x["rows"]))
    hit = sets.select("rule", F.explode(both).alias("row_key"))
    return hit.groupBy("row_key").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("mask"))


# ---- verification ----
def find(text: str, rule: tuple) -> Iterator[tuple[int, int]]:
    """The places of a rule's matches in a text."""
    _, pattern, group, least, ignore = rule
    for m in re.finditer(pattern, text, re.ASCII | (re.IGNORECASE if ignore else 0)):
        if m.end(group) - m.start(group) >= least:
            yield m.start(), m.end()


def _scanner(rules, always: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, at, rows = batch.column("mask").fill_null(0).to_numpy() | always, [0], []
            for mask, text in zip(masks.tolist(), batch.column("text"), strict=True):
                if mask and (t := text.as_py()):
                    rows += sorted((a, r, z) for r, rule in enumerate(rules) if mask >> r & 1 for a, z in find(t, rule))
                at.append(len(rows))
            start, rule, end = (pa.array([x[i] for x in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int64())))
            kind = pa.array([r[0] for r in rules], pa.string()).take(rule)
            spans = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([start, rule, kind, end], ["start", "rule", "kind", "end"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), spans], ["doc_id", "row_key", "spans"])

    return tidy(run)


def scan(rows: DataFrame, rules=RULES, postings: DataFrame | None = None) -> DataFrame:
    """(doc_id, row_key, spans) of every keyed row (doc_id, text, row_key): spans are structs (start, rule, kind, end) by start and
    then by the rules' order. postings: an index() of these rows made before; else one of the rules' trigrams is made."""
    if len(rules) > 63:
        raise ValueError("at most 63 rules at a time")
    ship(rows.sparkSession)
    always = sum(1 << r for r, rule in enumerate(rules) if trigram_query(rule[1], rule[4]) == _ANY)
    made = None
    if postings is None:
        postings, made = write_table(index(rows, {t for _, _, t, _ in queries(rules)}))
    found, _ = write_table(candidates(postings, rules))
    if made:
        drop_table(rows.sparkSession, made)
    few = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    scanned = rows.join(few, "row_key", "left").select("doc_id", "row_key", "text", "mask")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return scanned.mapInArrow(_scanner(rules, always), f"doc_id {kind}, row_key long, spans array<struct<start: long, rule: int, kind: string, end: long>>")


def spans(docs: DataFrame, rules=RULES) -> DataFrame:
    """scan() of all rows of docs (doc_id, text)."""
    ship(docs.sparkSession)
    return scan(keyed(docs).select("doc_id", F.col("text").cast("string").alias("text"), "row_key"), rules)


def digest(found: DataFrame, base: int = len(BASE)) -> DataFrame:
    """A row for each of spans(): how many spans the first `base` rules have, n_<kind> each, the SHA-256 of their list, and the list
    of all spans, kind:start:end comma-joined."""

    def listed(a):
        return F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind):
        return F.filter("spans", lambda s: s["kind"] == kind)

    own = F.filter("spans", lambda s: s["rule"] < base)
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind, *_ in RULES[:base]]
    return found.select("doc_id", *counts, F.sha2(listed(own), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
