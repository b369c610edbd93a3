"""What must not grow with the input beside it: joins whose derived sides the planner takes for small, and rows written without need."""

from loomstone.plans import catalogue


def plan(spark, sf, name):
    return catalogue.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_group_lists_broadcast_nothing(spark, sf):
    """A package's lines come from a small table and are many: no join may send them to the driver."""
    assert "Broadcast" not in plan(spark, sf, "rp21_group_lists")


def test_a_case_is_parsed_once(spark, sf):
    """A filter below the violations would parse a case's text at every mention."""
    df = catalogue.queries()["bm12_schema"](spark, sf)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_trigrams_are_counted_by_patterns(spark):
    """No function runs for each trigram of a text, which the planner could only interpret."""
    from loomstone.operators import language

    text = "Ab ab, ABA\U00020000\U00020000 é1é"
    got = spark.createDataFrame([(text,), ("",), ("a",)], "t string").selectExpr(f"{language._grams('t')} AS g").selectExpr("g", f"{language._counted('g')} AS c").collect()
    whole = " ab ab aba\U00020000\U00020000 é é "
    want = sorted(whole[i : i + 3] for i in range(len(whole) - 2))
    assert sorted(got[0]["g"]) == want and {(r["gram"], -r["minus"]) for r in got[0]["c"]} == {(w, want.count(w)) for w in want}
    assert [r["minus"] for r in got[0]["c"]] == sorted(r["minus"] for r in got[0]["c"]) and got[2]["g"] == [" a "]
    assert "->" not in language._grams("t") and "sequence" not in language._counted("g")


def test_block_lines_are_looked_at_once():
    """Reading a block strips each of its lines once, however often it is looked at."""
    from loomstone.sources import blocks

    class Line(str):
        strips = 0

        def strip(self, *a):
            Line.strips += 1
            return str.strip(self, *a)

    text = "a:\n  - b: 1\n    c: 'x'\n  - b: 2\n    c:\n      - 3\n"
    split, blocks.re.split = blocks.re.split, lambda p, t: [Line(x) for x in split(p, t)]
    try:
        got = blocks.load(text)
    finally:
        blocks.re.split = split
    assert got == {"a": [{"b": 1, "c": "x"}, {"b": 2, "c": [3]}]} and Line.strips <= 2 * len(text.split("\n"))


def test_packages_are_parsed_in_one_pass(spark):
    """Blocks with an error must not cost another reading of all texts; they are kept one by one."""
    from loomstone.sources import fenced

    bad = "# P\n\n---\n```yaml\na: [\n```\n```yaml\na: [\n```\n"
    df = fenced.read(spark.createDataFrame([("x", bad, "a.md"), ("x", bad, "a.md"), ("y", "", "b.md")], "doc_id string, text string, filename string"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = sorted((r["doc_id"], r["section"], r["error"] is None) for r in df.where("section IS NULL").collect())
    assert got == [("x", None, False)] * 4 + [("x", None, True)] * 2 + [("y", None, True)]


def test_lines_are_not_trimmed_by_patterns(spark, sf):
    """A line is trimmed by a built-in, once, and no alternative of a word list is tried where another has failed on the same letter."""
    plan_ = plan(spark, sf, "ch2_headings")
    assert plan_.count("trim(line") == 1 and "^\\s+|" not in plan_
    from loomstone.functions.dialect import SPARK

    got = spark.sql(f"SELECT {SPARK.trim(SPARK.lit(chr(11) + chr(12) + ' f x f ' + chr(9)))} AS t, {SPARK.squeeze(SPARK.lit('a  b' + chr(10) + 'c d' + chr(10)))} AS s").first()
    assert got == ("f x f", "a b c d ")


def test_parts_of_a_text_are_worked_out_once(spark, sf):
    """Chunks take the paths of their sections along instead of working out the sections a second time."""
    assert "Join" not in plan(spark, sf, "ch3_chunks")


def test_whole_words_keep_their_boundaries(spark):
    """Boundaries as single looks to one side find what those spelt out do."""
    import itertools

    from loomstone.functions.dialect import SPARK, _EDGE

    texts = ["".join(x) for x in itertools.product(["não", "está", "É", "é", "de", "des", "x", "1", "_", " ", "-"], repeat=3)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in (r"(?i)\b(?:não|está|é|de|des|do)\b", r"(?i)\b(?:de|des)\b", r"(?i)\b(de|x\s?)\b|\b\d", r"(?i)\b(?:est|está)\b"):
        plain = SPARK.lit(p.replace(r"\b", _EDGE).replace("(?i)", "(?iu)"))
        assert df.where(f"{SPARK.all('t', p)} <> regexp_extract_all(t, {plain}, 0)").count() == 0 < df.where(SPARK.has("t", p)).count()
    assert r"(?=\w)|" not in SPARK.pat(r"(?i)\b(?:de|des)\b") and "de|des" not in SPARK.pat(r"(?i)\b(?:de|des)\b")


def test_verdicts_are_compiled(spark, sf):
    """Completeness and truncation of a text are no function of an array, which the planner interprets; a text is trimmed once."""
    from loomstone.functions import text
    from loomstone.functions.dialect import SPARK

    assert all("->" not in f(SPARK, "x") for f in (text.complete, text.truncated)) and "->" not in text.wrong_language(SPARK, "x", "'en'")
    df = catalogue.queries()["sn1_sanitize"](spark, sf)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("trim(fs") + df._jdf.queryExecution().optimizedPlan().toString().count("trim(item") <= 1


def test_a_fold_moves_its_rows_once(spark, sf):
    """Rows are dealt by package and section; merging and numbering them must not write them to disk again."""
    from loomstone.operators import reduce
    from loomstone.plans import rendered
    from loomstone.functions.dialect import SPARK

    items = catalogue.run(spark, sf, f"SELECT * FROM {rendered.partials(SPARK)} p")
    assert reduce.fold(items)._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL") == 1
    assert "ENSURE_REQUIREMENTS" not in reduce.fold(items)._jdf.queryExecution().executedPlan().toString() and "Window" not in plan(spark, sf, "dd17_reduce")


def test_what_is_held_is_worked_out_once(spark):
    from pyspark.sql import functions as F

    from loomstone.plans.compile import hold

    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    assert hold(spark.range(10).select(counted("id").alias("n"))).count() == 10 and seen.value == 10


def test_overlap_finds_the_words_of_a_text_once(spark, sf):
    """Both words lists of a response and its gold are found once a row, however often their likeness is mentioned."""
    from loomstone.functions.dialect import SPARK
    from loomstone.operators import harness

    assert harness.overlap(SPARK, "a", "b").count("regexp_extract_all(") == 2
    df = catalogue.queries()["bm4_scored"](spark, sf)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 2
    pairs = [("Pay $5.50 the the fee now", "the fee of 5.50 is due, fee"), ("", "of the"), ("a b", ""), (None, "fee"), ("fee", None)]
    rows = spark.createDataFrame(pairs, "a string, b string").selectExpr(f"{harness.overlap(SPARK, 'a', 'b')} AS o")
    assert [None if r["o"] is None else round(r["o"], 6) for r in rows.collect()] == [0.666667, 0.0, 0.0, None, None]


def test_a_response_is_normalised_once(spark, sf):
    """Refusal, escalation and polarity look at one normalised text instead of making it at every mention."""
    plan_ = catalogue.queries()["bm7_classify"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan_.count("lower(CASE model_spec") + plan_.count("lower(response") <= 2


def test_text_that_is_no_object_is_not_parsed(spark):
    """Lines of prose never reach the parser, whose errors are slow; what may be an object still does."""
    from loomstone.functions.dialect import SPARK

    texts = ['{"a": "b"}', ' \t\r\n{"a": "c"}', '{"a": 1}', "{a", "", "[1]", '"{"', "prose {x}", ' {"a": "d"}', '﻿{"a": "e"}', "null", None]
    plain = "coalesce(schema_of_variant(try_parse_json(t)) LIKE 'OBJECT%', false)"
    value = "CASE WHEN schema_of_variant(try_variant_get(try_parse_json(t), '$.a', 'variant')) = 'STRING' THEN get_json_object(t, '$.a') END"
    df = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr(f"{SPARK.json_object('t')} AS o", f"{plain} AS po", f"{SPARK.json_text('t', 'a')} AS v", f"{value} AS pv")
    assert all((r["o"], r["v"]) == (r["po"], r["pv"]) for r in df.collect()) and df.where("o").count() >= 3
    assert all("RLIKE" in x[: x.index("try_parse_json")] for x in (SPARK.json_object("t"), SPARK.json_text("t", "a")))


def test_candidates_are_judged_once(spark, sf):
    """What was kept is compared with candidates that are written down, not judged a second time from the tables."""
    assert "customer" not in plan(spark, sf, "pm5_promoted") and "c_custkey" not in plan(spark, sf, "pm5_promoted")


def test_a_case_of_the_index_is_parsed_once(spark, sf):
    """Filters below must not parse a file again, and the texts of files are not shuffled where their names are asked for."""
    df = catalogue.queries()["hp19_case_index"](spark, sf)
    plan_ = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan_.count("parseJson") == 1 and "value" not in plan_[: plan_.index("parseJson")].split("Project")[0]


def test_a_folder_gets_one_entry_for_each_file(spark, tmp_path):
    """Files of a task are put together apart from the folder that all tasks share, and nothing of that is left."""
    import os

    import pyarrow as pa

    from loomstone.sources import folders

    moved, fs = [], folders.pafs.LocalFileSystem

    class Seen(fs):
        def move(self, a, b):
            moved.append((os.path.dirname(a), os.path.dirname(b)))
            super().move(a, b)

    batch = pa.RecordBatch.from_pydict({"folder": ["a", "a", None], "file": ["x", "y", "z"], "text": ["1", None, "é"]})
    given, folders.file_system = folders.file_system, lambda p: (Seen(), p)
    try:
        assert folders.FolderWriter({"path": str(tmp_path)}).write(iter([batch])).files == 3
    finally:
        folders.file_system = given
    assert len(moved) == 3 and all(a != b for a, b in moved)
    assert sorted(os.listdir(tmp_path)) == ["a", "z"] and sorted(os.listdir(tmp_path / "a")) == ["x", "y"] and (tmp_path / "z").read_text() == "é"


def test_lines_of_a_layout_are_shipped_once(spark, sf):
    """Lines are measured where their document lies: the table by order, then its words by document, and no join."""
    p = plan(spark, sf, "io7_layout_markdown")
    assert p.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in p and "HashJoin" not in p


def test_layout_in_windows_is_that_of_joins(spark, tmp_path):
    """Also for words without a document, without a size, running heads, lines twice and equal lines of a table."""
    import random

    import oracle

    from loomstone.functions.dialect import DUCK, SPARK
    from loomstone.plans import rendered
    from loomstone.sources import layout

    r = random.Random(5)
    pages = [(d, p) for d in (1, 2, 3, None) for p in (1, 2, 3)]
    rows = [(d, p, i, r.choice(["Head 7", "Head 8", " ", "Body text", "of it.", "Title", "\t"]), r.choice([10.0, 14.0, 0.0, None]), r.choice([9.0, None]), 20.0, r.choice([10.0, 40.0, None]), r.choice([700.0, 690.0, 689.0, 600.0, None])) for d, p in pages for i in range(r.randint(1, 14))]
    df = spark.createDataFrame(rows, "doc_id bigint, page int, place int, str string, height double, scale double, width double, x double, y double")
    df.write.parquet(f"{tmp_path}/words")
    df.createOrReplaceTempView("layout_words")
    con = oracle.duck("/root/testdata/sf0.001")
    con.execute(f"CREATE VIEW layout_words AS SELECT * FROM read_parquet('{tmp_path}/words/*.parquet')")
    assert oracle.differences(spark.sql(layout.markdown(SPARK, "layout_words", "doc_id")), con, layout.markdown(DUCK, "layout_words", "doc_id")) == ""
    lines = spark.sql("SELECT * FROM VALUES (1, 1, 5, 2, 9.5D, 50, 0D, 0D, 'R'), (1, 1, 5, 2, 9.5D, 50, 0D, 0D, 'R'), (1, 2, 6, 3, 1D, 4, 0D, 0D, 'N'), (2, 1, 6, 4, 1D, 2, 0D, 0D, 'N') t(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag)")
    lines.write.parquet(f"{tmp_path}/lines")
    lines.createOrReplaceTempView("lineitem")
    con.execute(f"CREATE OR REPLACE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lines/*.parquet')")
    spark.read.parquet("/root/testdata/sf0.001/orders.parquet").createOrReplaceTempView("orders")
    assert oracle.differences(spark.sql(f"SELECT * FROM {rendered.placed_words(SPARK)} w"), con, f"SELECT * FROM {rendered.placed_words(DUCK)} w") == ""


def test_many_words_are_tried_where_one_may_begin(spark):
    """Words of a list are tried only at a letter that one begins with, in either case; a letter beyond ASCII begins none."""
    from loomstone.functions import patterns, text
    from loomstone.functions.dialect import SPARK, _EDGE

    texts = ["Kelvin Key key xkey key1", "ſee SEE see. asee", "one two, THREE\tfour", "Não não, está É", "", "zz " * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in (text.any_word(["key", "see", "one", "three"]), text.any_word(patterns.PT_STOPWORDS), r"\b(?:key|see|one|three)\b"):
        plain = SPARK.lit(p.replace(r"\b", _EDGE).replace("(?i)", "(?iu)"))
        assert SPARK.pat(p).count("(?-i:[") == 1 and df.where(f"{SPARK.all('t', p)} <> regexp_extract_all(t, {plain}, 0)").count() == 0 < df.where(SPARK.has("t", p)).count()
    words = text.profile_language(SPARK, "t")
    assert "array_contains" not in words and words.count(" IN (") == len(patterns.PROFILE_WORDS)


def test_what_a_statement_is_cut_at_is_found_once(spark, sf):
    """Promotion cuts at a decision, a condition and an exception; each is found once a statement, however often the cuts mention it."""
    df = catalogue.queries()["pm2_promote"](spark, sf)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 12


def test_numeric_patterns_are_tried_where_they_can_match(spark):
    """What a pattern needs is looked for first: what it finds, in either case and odd letters as well, is found as without that."""
    from loomstone.functions import patterns as P
    from loomstone.functions.dialect import SPARK as D
    from loomstone.operators import extract as E

    texts = [
        "US$ 5,000.10 R$3 €7 12 USD 1.5EUR 7% 2024-05-06 1/2/2024 1-2-24 Jan. 5, 2024 ſEPT 3 2021 5 DE MarçO de 2020 3 de mayo", "10:30 pm 5h 7h30min 3 DIAS 4anos 12 wee\u212as 5 Öre", "Decreto nº 12.3 LEİ 55 lei - Resolução Federal 9 Medıda Provisória 77",
        "art. 5º §7 ARTÍCULO 12 Section 4.2 ſection 7 CAPÍTULO 3 Sec. 9 cap. 1", "RFC 2119 ISO-9001:2015 W3C 5 10.1234/ab.c ISBN 978-3-16-148410-0 İSBN: 3-16-148410-X 1.234,5 1,234,567", "", "no digits here", "lei .", "7 d\u00eda 7\u2009%",
    ]
    texts = [t.replace("\\\u212a", "\u212a").replace("\\\u00eda", "\u00eda").replace("\\\u2009", "\u2009") for t in texts]
    spark.createDataFrame(list(enumerate(texts)), "k int, text string").createOrReplaceTempView("odd_texts")
    got = {(r["k"], r["kind"], r["value_text"], r["first_rank"]) for r in spark.sql(E.numeric_facts(D, "odd_texts", "k", context=False)).collect()}
    want, seen = set(), set()
    for n, (kind, p) in enumerate(P.NUMERIC):
        for r in spark.sql(f"SELECT k, explode({D.all('text', p, 0)}) AS v FROM odd_texts").collect():
            if (r["k"], kind, r["v"]) not in seen:
                want.add((r["k"], kind, r["v"], n))
            seen.add((r["k"], kind, r["v"]))
    assert got == want and {w[3] for w in want} == set(range(len(P.NUMERIC)))
    counts = spark.sql(E.kind_counts(D, "odd_texts")).first().asDict()
    for kind in dict.fromkeys(k for k, _ in P.NUMERIC):
        every = spark.sql("SELECT sum(" + " + ".join(D.count("text", p) for k, p in P.NUMERIC if k == kind) + ") AS n FROM odd_texts").first()["n"]
        assert counts[f"{kind}_literals"] == every


def test_numeric_patterns_are_gated(spark, sf):
    """A text without what a pattern needs is not searched by it."""
    spark.conf.set("spark.sql.maxToStringFields", "200")
    shown = catalogue.queries()["ex11_numeric_facts"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.maxToStringFields")
    assert all(f", {code})" in shown for code in ("USD", "RFC", "isbn")) and "ontains(low_" in shown
