"""Traces, language recovery and cost by value, on rows written out by hand."""

from loomstone.functions.dialect import SPARK as D
from loomstone.operators import harness as BM
from loomstone.operators import promote as PM
from loomstone.operators import provenance as TR


def view(spark, name, rows, schema):
    spark.createDataFrame(rows, schema).createOrReplaceTempView(name)
    return name


def test_synthesized_traces(spark):
    items = view(spark, "tr_items", [
        (1, "a_1", "explicit", ["s_1", "s_2"], [" ", "said"]), (1, "a_2", None, ["s_1"], []), (1, "a_3", "inferred", [], ["only text"]),
        (1, "a_4", "explicit", [], ["  "]), (1, None, "explicit", ["s_1"], ["x"]), (2, "b_1", "explicit", ["s_1"], ["x"]),
    ], "pkg int, id string, basis string, refs array<string>, excerpts array<string>")
    traced = view(spark, "tr_traced", [(2,)], "pkg int")
    got = sorted(map(tuple, spark.sql(TR.synthesized(D, items, traced, "pkg")).collect()))
    assert got == [(1, "a_1", "s_1", "said", "explicit"), (1, "a_2", "s_1", "", "uncertain"), (1, "a_3", "document", "only text", "inferred")]


def test_enriched_traces(spark):
    rows = view(spark, "tr_rows", [(1, "a", 1, "s_1", "", None), (1, "b", 1, "s_1", "inferred", 0.25), (1, "c", 1, "s_9", "", None)], "pkg int, extracted_item_id string, ref_no int, source_location string, basis string, confidence double")
    entries = view(spark, "tr_entries", [(1, "s_1", "r", "f.md", "p", 3, 4, 30, 40)], "pkg int, source_id string, source_record_id string, source_file string, path string, line_start int, line_end int, char_start int, char_end int")
    got = {r["extracted_item_id"]: r for r in spark.sql(TR.enriched(D, rows, entries, "pkg")).collect()}
    assert (got["a"]["source_basis"], got["a"]["confidence"], got["a"]["source_line_end"], got["a"]["source_char_start"]) == ("explicit", 1.0, 4, 30)
    assert (got["b"]["source_basis"], got["b"]["confidence"]) == ("inferred", 0.25)
    assert (got["c"]["source_basis"], got["c"]["confidence"], got["c"]["source_file"]) == ("", None, None)


def test_language_recovery(spark):
    """Three mismatches and more than a fifth of the rejects: both must hold, and the detected language must be another one."""
    bad, cut = "language_mismatch", "truncated"
    verdicts = [(1, bad)] * 3 + [(1, None)] * 9 + [(2, bad)] * 2 + [(3, bad)] * 3 + [(3, cut)] * 12 + [(4, bad)] * 4 + [(5, bad)] * 4
    v = view(spark, "sn_verdicts", verdicts, "pkg int, reason string")
    langs = view(spark, "sn_langs", [(1, "pt", "en"), (2, "pt", "en"), (3, "pt", "en"), (4, "en", "en"), (5, "pt", "unknown")], "pkg int, language string, detected string")
    got = {r["pkg"]: (r["applied"], r["language_after"], r["restored"]) for r in spark.sql(PM.recovery(D, v, langs, "pkg")).collect()}
    assert got == {1: (True, "en", 3), 2: (False, "pt", 0), 3: (False, "pt", 0), 4: (False, "en", 0), 5: (False, "pt", 0)}


def test_cost(spark):
    tasks = view(spark, "ag_tasks", [("p:big-2024-01-01", "primary", "c" * 300, "q" * 100, "q" * 100, "g" * 100)] * 1000 + [("p:new", "local_probe", "", "", "", "")] * 10, "model_spec string, query_type string, context string, asked string, query string, gold string")
    got = {r["model_spec"]: tuple(r)[1:] for r in spark.sql(BM.cost(D, tasks, {"p:big": (2.0, 10.0)}, "p:big")).collect()}
    # 1,000 calls of (300 + 100 + 100) / 4 tokens; the judge has (100 + 100 + 2,000) / 4 and no probes; p:new costs 5 and 15.
    assert got == {"p:big-2024-01-01": (1000, 125_000, 200_000, 2.25), "p:big": (1000, 550_000, 100_000, 2.1), "p:new": (10, 250, 2000, 0.03)}
