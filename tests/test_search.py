"""Items found by literals through the posting table."""

import random

import numpy as np

from loomstone.operators import search as S


def test_search_agrees_with_a_scan(spark, tmp_path):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abÉß ") for _ in range(r.randint(0, 12)))
    sections = ["concepts", "procedures", "qa_pairs", "atomic_units"]
    rows = [(p, s, o, word() if r.random() < 0.9 else None, word()) for p in range(8) for s in sections for o in range(20)]
    items = spark.createDataFrame(rows, "pkg long, section string, ord long, a string, b string")
    S.index(items, str(tmp_path / "postings"))
    literals = ["ab", "a", "aba", "ABB", "éa b", "bab", "zzz", "ba ba", "ßa", ""]
    want = set()
    for p, s, o, a, b in rows:
        text = ((a or "") if s in S.SEARCHED else " ".join(x for x in (a, b) if x is not None)).lower()
        want |= {(x, p, s, o) for x in literals if x.lower() in text}
    got = [tuple(x) for x in S.search(items, str(tmp_path / "postings"), [*literals, "aba"]).collect()]
    assert set(got) == want and len(got) == len(want)
    assert S.search(items, str(tmp_path / "postings"), []).count() == 0


def test_a_search_reads_its_own_folders(spark, tmp_path):
    rows = [(i, "concepts", 1, f"word {i:05d} of many {i * 7919 % 10007}", "") for i in range(3000)]
    items = spark.createDataFrame(rows, "pkg long, section string, ord long, a string, b string")
    path = str(tmp_path / "postings")
    S.index(items, path)
    plan = S.candidates(spark, path, ["02999 of"])
    assert {r["pkg"] for r in plan.collect()} == {2999}
    scanned = [f for f in plan.inputFiles()]
    assert 0 < len(scanned) and spark.read.parquet(path).count() > 3000
    explained = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in explained and "bucket" in explained.split("PartitionFilters")[1][:200] and "PushedFilters: [In(gram" in explained


def test_postings_are_lists_of_a_block(spark, tmp_path):
    """A row for each item and trigram would be shuffled and written: here 200 items alike share theirs."""
    items = spark.createDataFrame([(i, "concepts", 1, "the same words", "") for i in range(200)], "pkg long, section string, ord long, a string, b string").coalesce(1)
    path = str(tmp_path / "postings")
    S.index(items, path)
    assert spark.read.parquet(path).count() == len({"the same words "[i : i + 3] for i in range(13)})
    assert S.search(items, path, ["SAME w"]).count() == 200 and S.search(items, path, ["samew"]).count() == 0


def test_common_trigrams_take_little_room(spark, tmp_path):
    """Lists are not shuffled, and those that all items are in are not written number by number."""
    items = spark.createDataFrame([(i, "concepts", 1, "the same words", "") for i in range(9000)], "pkg long, section string, ord long, a string, b string").coalesce(1)
    path = str(tmp_path / "postings")
    S.index(items, path)
    files = [f for f in (tmp_path / "postings").rglob("*.parquet")]
    assert sum(f.stat().st_size for f in files) < 9000 * 12 * 2 / 5
    assert S.search(items, path, ["SAME w"]).count() == 9000
    lists = [[0], [0, 1, 2], [5, 300, 16383], list(range(0, 16384, 3)), [7]]
    packed = S._packed(np.array(sum(lists, [])), np.array([len(x) for x in lists]))
    assert [S._places(p).tolist() for p in packed.to_pylist()] == lists
