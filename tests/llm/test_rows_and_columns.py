"""No row or column is lost: shared and absent ids, one text in many rows, columns named like the operators' own."""

import random

import pytest
from pyspark.sql import functions as F

from loomstone.llm import embedding_dedup, language_id, mixing, substring_dedup, toxicity
from loomstone.llm._runtime import free_name, is_keyed, keyed

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n))


def test_unlike_vectors_that_share_an_id_keep_their_links(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.05]), (3, [0.1, 1.0]), (3, [0.1, 1.0]), (9, [-1.0, -1.0])]
    got = embedding_dedup.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False), (9, 0, 9, True)]


@pytest.mark.parametrize("one_text", [True, False])
def test_no_language_vanishes_that_stands_under_one_id(spark, one_text):
    many, few = prose(30, 1), [prose(12, 100 + k) for k in range(50)]
    for doc_id in (1, 3, 4, 5):
        rows = [(doc_id, many if one_text else f"{many} {k}", "en") for k in range(3000)] + [(1000 + k, t, "de") for k, t in enumerate(few)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").where(~language_id.held_out())
        got = language_id.sample(docs, 40).collect()
        langs = [r["lang"] for r in got]
        assert len(set(langs)) == docs.select("lang").distinct().count() and max(map(langs.count, langs)) <= 40 and len({(r["lang"], r["h"]) for r in got}) == len(got)


def test_a_sample_of_many_languages_is_bounded(spark):
    docs = spark.createDataFrame([(4 * k + i, prose(5, 4 * k + i), f"l{k:03d}") for k in range(60) for i in range(4)], "doc_id long, text string, lang string")
    got = language_id.sample(docs, 40, most=50).collect()
    assert len({r["lang"] for r in got}) <= 25 and len(got) <= 50


def test_one_text_of_a_shared_id_trains(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, share: seen.update(texts=texts, labels=labels.tolist()))
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(k, f"other {k}") for k in range(2, 40)], "doc_id long, text string")
    toxicity.fit(docs, spark.createDataFrame([(k, k % 2) for k in range(1, 40)], "doc_id long, toxic int"), most_toxic=10, most_clean=10)
    assert len(seen["texts"]) <= 20 and sum(t.startswith("text") for t in seen["texts"]) <= 1


def test_rows_without_an_id_are_dealt_over_all_tasks(spark):
    docs = spark.createDataFrame([(None, f"t{k}", "en", "a", 1) for k in range(4000)], DOC)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = mixing.mix(docs, epochs=40.0)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 1.3 * min(sizes)


def test_a_column_called_row_key_is_none(spark):
    shared = prose(80, 3)
    rows = [(k, f"{prose(20, 10 + k)} {shared} {prose(20, 30 + k)}") for k in range(2)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((r["doc_id"], r["start"], r["end"]) for r in substring_dedup.spans(plain).collect())
    assert len(want) == 2
    for value in (F.lit(7), F.lit("seven")):
        got = substring_dedup.spans(plain.withColumn("row_key", value)).collect()
        assert sorted((r["doc_id"], r["start"], r["end"]) for r in got) == want
    assert is_keyed(keyed(plain)) and not is_keyed(plain.withColumn("row_key", F.lit(7))) and free_name(plain.withColumn("Row_Key", F.lit(7)), "row_key") == "row_key_"


def test_pipeline_keeps_columns_of_any_name(spark, sf):
    import corpus_pipeline as C

    names = ("row_key", "_id", "_key", "row", "whole", "again", "low", "component_id", "rate", "copy_no")
    docs = spark.createDataFrame([(k if k % 3 else None, prose(60, k), "en", "a", 5) for k in range(12)], DOC)
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(f"own {i}"))
    for name, stage in C.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        assert {tuple(r) for r in out.select(*names).distinct().collect()} == {tuple(f"own {i}" for i in range(len(names)))}, name
