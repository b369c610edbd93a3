"""The inspection report and excerpts in their sources, values worked out by hand."""

import json
import random
import re

from loomstone.operators import inspection as I
from loomstone.sources import fenced as FE


def test_excerpts_are_found_by_the_strictest_method():
    text = "The  Quick\nbrown fox. the quick brown fox İ end\t\there"
    got = I.locate(text, ["Quick", "THE quick", "the quick  brown\n fox", "the QUICK brown fox.", "missing", "", "end here", "   ", "İ END"])
    assert got[0] == ("exact", 5, 10) and got[1] == ("case_insensitive", 22, 31) and got[4] == got[5] == got[7] == ("none", None, None)
    assert [(m, re.sub(r"\s+", " ", text[a:z]).lower()) for m, a, z in (got[2], got[3], got[6])] == [("whitespace", "the quick brown fox"), ("whitespace", "the quick brown fox."), ("whitespace", "end here")] and got[2][1] == 0
    assert got[8] == ("case_insensitive", 42, 47)


def test_many_excerpts_against_plain_search():
    r = random.Random(5)
    text = "".join(r.choice("aAbB \n") for _ in range(3000))
    asked = ["".join(r.choice("aAbB \n") for _ in range(r.randint(1, 9))) for _ in range(400)] + ["zzz"]
    for e, (method, a, z) in zip(asked, I.locate(text, asked)):
        flat, want = re.sub(r"\s+", " ", text).lower(), re.sub(r"\s+", " ", e).strip().lower()
        assert method == ("exact" if e in text else "case_insensitive" if e.lower() in text.lower() else "whitespace" if want and want in flat else "none")
        if method == "exact":
            assert a == text.index(e) and text[a:z] == e
        elif method == "case_insensitive":
            assert a == text.lower().index(e.lower())
        elif method == "whitespace":
            assert re.sub(r"\s+", " ", text[a:z]).lower() == want


def test_report(spark):
    sections = [
        (1, "metadata", {"source_title": "T", "package_id": "p", "human_readability": 0.5}), (1, "knowledge_limits", {"missing_context": ["m"]}),
        (1, "entities", [{"id": "e1", "name": "A", "confidence": 0.5, "source_refs": ["s"]}, {"id": "e2", "label": "L"}, {"name": "no id"}]),
        (1, "atomic_units", [{"id": "a1", "statement": "x" * 90, "type": "fact", "confidence": 0.9, "source_excerpts": ["found HERE", "lost"]}, {"id": "a2", "type": "", "source_excerpts": [" ", "found"]}, {"type": "fact", "confidence": 1.0}]),
        (1, "if_then_rules", [{"id": f"r{i}", "if": f"i{i}", "then": "t"} for i in range(7)]), (1, "exceptions", [{"id": "x", "general_rule": "g", "exception_case": "c", "modified_action": "m", "source_refs": []}]),
        (1, "anti_patterns", [{"id": "ap", "name": "n", "description": "d", "source_excerpts": ["gone " * 60] * 12}]), (2, "core_intent", {"key_value": "k"}),
    ]
    full = FE.filled(spark.createDataFrame([(i, s, json.dumps(v)) for i, s, v in sections], "doc_id long, section string, value string"))
    got = {r["doc_id"]: r for r in I.report(full, spark.createDataFrame([(1, "It was found\n here é.", "packed text"), (3, "x", "y")], "doc_id long, source string, packed string")).collect()}
    one = got[1]
    assert set(got) == {1, 2} and one["cover"]["title"] == "T" and one["cover"]["author"] == "Unknown" and one["cover"]["human_readability"] == 0.5
    assert one["inventory"]["total"] == 15 + 4 and {s["section"]: s["n"] for s in one["inventory"]["sections"]}["if_then_rules"] == 7 and "patterns" in one["inventory"]["empty"]
    assert [tuple(t) for t in one["inventory"]["types"]] == [("fact", 2), ("unknown", 1)]
    assert one["quality"]["buckets"] == [0, 1, 0, 2] and abs(one["quality"]["mean"] - 0.8) < 1e-12
    t = one["traceability"]
    assert (t["total"], t["traced"], t["excerpts"], t["n_orphans"]) == (15, 4, 16, 9) and [(w["section"], w["traced"], w["total"]) for w in t["worst"]][:2] == [("if_then_rules", 0, 7), ("exceptions", 0, 1)]
    assert (t["orphans"][0]["id"], t["orphans"][0]["title"]) == ("e2", "L") and [w["section"] for w in t["worst"]][2:] == ["entities", "atomic_units", "anti_patterns"]
    c = one["source_coverage"]
    assert (c["available"], c["total"], c["located"], len(c["failures"])) == (True, 15, 2, 10) and abs(c["pct"] - 2 / 15) < 1e-12 and len(c["failures"][0]["excerpt"]) == 220 and c["failures"][0]["section"] == "anti_patterns"
    assert one["compression"]["source_bytes"] == 22 and one["compression"]["package_bytes"] == 11 and one["compression"]["source_tokens"] == 5
    assert one["rules"]["if_then_rules"] == 7 and [s["first"] for s in one["rules"]["if_then_rules_samples"]] == [f"i{i}" for i in range(5)] and one["rules"]["exceptions_samples"][0]["second"] == "m" and one["rules"]["heuristics"] == 0
    assert one["limits"]["missing_context"] == ["m"] and [tuple(a) for a in one["anti_patterns"]] == [("ap", "n", "d")]
    two = got[2]
    assert two["inventory"]["total"] == 0 and two["quality"]["mean"] is None and two["traceability"]["pct"] == 0 and not two["source_coverage"]["available"] and two["compression"] is None and two["anti_patterns"] == []
