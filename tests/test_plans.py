"""The compiler as a whole, readers and writers, and streams."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from loomstone.plans import compile as C
from loomstone.sources import readers
from loomstone.streaming import ingest

DOCS = [
    (1, "# Returns\n\nThe return window means the time in which a buyer may bring goods back.\nThe clerk must sign the form before the parcel leaves the shop.\n\n## Steps\n1. Check the receipt.\n2. Sign the form.\n"),
    (2, "a" * 64),
    (3, "Q: What is it?\nA: It is a lamp that is sold in the shop.\nQ: Is it good?\nA: The lamp is not a replacement for daylight in a workshop."),
    (4, '{"_id":"x","text":"The first record must hold a whole sentence for the test."}\n{"_id":"y","text":"The second record is a sentence as well, it is long."}'),
]


@pytest.fixture(scope="module")
def out(spark):
    return C.compile_documents(spark.createDataFrame(DOCS, "doc_id long, text string"))


def test_compile(out):
    prof = {r["doc_id"]: r for r in out["profiles"].collect()}
    assert prof["2"]["blocked"] and not prof["1"]["blocked"]
    spans = out["spans"].collect()
    assert {(r["doc_id"], r["source_type"]) for r in spans} == {("1", "markdown_section"), ("3", "faq_pair"), ("4", "jsonl_record")}
    items = out["items"].collect()
    assert len({(r["doc_id"], r["section"], r["id"]) for r in items}) == len(items)
    everything = {(r["doc_id"], r["section"]) for r in items} | {(r["doc_id"], r["section"]) for r in out["rejects"].collect()}
    assert {("1", "concepts"), ("1", "procedures"), ("1", "atomic_units")} <= everything
    assert any(r["section"] == "anti_patterns" for r in items if r["doc_id"] == "3") or out["rejects"].count() > 0
    ids = {(r["doc_id"], r["id"]) for r in items}
    traces = out["traces"].collect()
    assert {(r["doc_id"], r["extracted_item_id"]) for r in traces} <= ids and len(traces) == len(items)
    assert {r["doc_id"] for r in out["quality"].collect()} == {r["doc_id"] for r in out["stats"].collect()} == {r["doc_id"] for r in items}


def test_compile_keeps_confidence_and_reports(spark):
    docs = [
        ("a", "# Fees\n\nThe fee must be 12% of the price and it is due on 2024-05-06.\n\n## Refunds\n\nIf the buyer returns the goods, then the shop must pay the price back in full."),
        ("b", "Q: What is it?\nA: It is a lamp that is sold in the shop.\nQ: Is it good?\nA: The lamp is not a replacement for daylight in a workshop."),
    ]
    got = C.compile_documents(spark.createDataFrame(docs, "doc_id string, text string"))
    sure = {(r["section"], r["confidence"]) for r in got["items"].collect()}
    assert {c for s, c in sure if s in ("retrieval_chunks", "atomic_units", "concepts")} == {1.0}
    assert ("decision_rules", 0.95) in sure and all(c == 1.0 for s, c in sure if s == "anti_patterns")
    cover = {r["doc_id"]: (r["spans_total"], r["spans_covered"]) for r in got["coverage"].collect()}
    assert cover["a"][0] == 2 and cover["b"][0] == 2 and all(0 < c <= t for t, c in cover.values())
    numbers = {(r["doc_id"], r["kind"], r["value_text"], r["outcome"]) for r in got["numbers"].collect()}
    assert numbers == {("a", "percent", "12%", "exact"), ("a", "date", "2024-05-06", "exact")}
    assert {r["reason"] for r in got["gate"].collect()} <= {"language_mismatch", "truncated", "incomplete_proposition"}


def test_sanitize_partitions_items_and_is_idempotent(spark):
    found = C.hold(C.items(C.spans(spark.createDataFrame([(str(i), t) for i, t in DOCS], "doc_id string, text string"))))
    kept, bad = C.sanitized(found)
    assert kept.count() + bad.select("doc_id", "section", "ord").distinct().count() == found.count()
    again, none = C.sanitized(kept)
    assert none.count() == 0 and again.count() == kept.count()


def test_map_chunks_goes_on_after_errors(spark):
    def extractor(text):
        if "bad" in text:
            raise ValueError("no")
        return [{"section": "concepts", "title": text[:3], "body": text}]

    rows = C.map_chunks(spark.createDataFrame([(1, "s_001", "good text"), (2, "s_001", "bad text")], "doc_id long, span_id string, text string"), extractor).collect()
    assert [(r["doc_id"], r["section"]) for r in sorted(rows)] == [("1", "concepts"), ("2", "error")]


def test_readers(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("one\ntwo")
    assert [tuple(r) for r in readers.texts(spark, str(tmp_path / "t")).collect()] == [("a.txt", "one\ntwo")]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "1.json").write_text(json.dumps({"case_id": "one", "query": "q?", "local_probes": [{"probe": "p"}]}, indent=1))
    (tmp_path / "c" / "2.json").write_text("{broken")
    assert [r["case_id"] for r in readers.cases(spark, str(tmp_path / "c")).collect()] == ["one"]
    log = tmp_path / "log.jsonl"
    log.write_text('{"case_id":"one","model_spec":"m","condition":"raw","query_type":"primary","query_index":0,"rep":0}\nnot json\n')
    done = readers.results(spark, str(log))
    assert [r["task_key"] for r in done.collect()] == ["one|m|raw|primary|0|0"]
    tasks = spark.createDataFrame([("one|m|raw|primary|0|0",), ("two|m|raw|primary|0|0",)], "task_key string")
    assert readers.remaining(tasks, done).count() == 1
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:body><w:p ><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p ><w:r><w:t xml:space="preserve">a &amp; b</w:t></w:r></w:p></w:body>')
    assert readers.office(spark, str(tmp_path / "d.docx")).first()["text"] == "## Head\n\na & b"


def test_yaml_and_schema():
    assert readers.yaml({"a": [1, {"b": "x: y"}], "c": None, "d": {}}) == 'a:\n  - 1\n  - b: "x: y"\nc: null\nd: {}\n'
    slim = readers.slim_schema({"type": "object", "description": "d", "required": ["a", "z"], "properties": {"a": {"type": ["null", "string"], "enum": ["x"]}}})
    assert slim == {"type": "object", "properties": {"a": {"type": "string"}}, "required": ["a"]}


def test_streams(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    q = ingest.profiles(ingest.documents(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("prof").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("prof").count() == docs.count()
    want = {r["doc_id"]: r["source_word_count"] for r in C.apply(docs, C.PR.profile).collect()}
    assert {r["doc_id"]: r["words"] for r in spark.table("prof").collect()} == want


def test_event_windows_count_every_event(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    q = ingest.event_counts(stream).writeStream.format("memory").queryName("ev").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("ev").agg(F.sum("n")).first()[0] == events.count()


def test_bullet_forms_of_patterns_principles_and_if_then(spark):
    from loomstone.functions.dialect import SPARK
    from loomstone.sources import markup

    want = {
        "principles": [("Measure first", ("Measure first", "", ""))],
        "patterns": [("**Drift** — load rises", ("Drift", "load rises", "")), ("plain", ("plain", "", ""))],
        "if_then_rules": [("IF a THEN b THEN c _(d)_", ("a", "b THEN c", "d")), ("if x then y", ("x", "y", ""))],
    }
    for section, cases in want.items():
        spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, bullet string").createOrReplaceTempView("bullets_of_forms")
        got = spark.sql(markup.parsed_bullet(SPARK, "bullets_of_forms", "k", section)).orderBy("k").collect()
        assert [(r["part1"], r["part2"], r["part3"]) for r in got] == [w for _, w in cases]
