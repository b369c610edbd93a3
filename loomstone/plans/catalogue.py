"""The engine's own queries by operator, each rendered for Spark (what runs) and for DuckDB (what it is checked against)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import patterns as P
from loomstone.functions import text as T
from loomstone.functions.dialect import DUCK, SPARK, Dialect
from loomstone.operators import dedup as DD
from loomstone.operators import extract as EX
from loomstone.operators import harness as BM
from loomstone.operators import inspection as IN
from loomstone.operators import language as LN
from loomstone.operators import profile as PR
from loomstone.operators import promote as PM
from loomstone.operators import provenance as TR
from loomstone.operators import reduce as RE
from loomstone.operators import report as AG
from loomstone.operators import sanitize as SA
from loomstone.operators import schema as SC
from loomstone.operators import search as SE
from loomstone.operators import segment as SG
from loomstone.plans import oracles as OR
from loomstone.plans import rendered as R
from loomstone.plans.compile import hold, relation, scratch
from loomstone.sources import fenced as FE
from loomstone.sources import folders as FO
from loomstone.sources import layout as LA
from loomstone.sources import markup as IO
from loomstone.sources import readable as RD
from loomstone.streaming import judging as JU

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
BUILDERS: dict[str, Callable[[Dialect], str]] = {}
#: Queries whose Spark side is DataFrame code, and the SQL that they are checked against.
PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
PLAN_SQL: dict[str, Callable[[], str]] = {}


def query(name: str, oracle: Callable[[], str] | None = None):
    """A builder for both engines; oracle: SQL that DuckDB runs instead, where Spark's is laid out for its own planner."""

    def put(f):
        BUILDERS[name] = f
        if oracle:
            PLAN_SQL[name] = oracle
        return f

    return put


#: Tables of so many bytes are dealt out to all cores first: a small file is one task whatever its cores, and the work is in the texts.
SMALL_BYTES = (100_000, 256 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if SMALL_BYTES[0] < int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < SMALL_BYTES[1]:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Plan SQL over the tables of a folder; views are bound when the plan is analysed, so folders do not mix."""
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)


def plan(name: str, sql: Callable[[], str] | None = None):
    def put(f):
        PLANS[name] = f
        if sql:
            PLAN_SQL[name] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda spark, sf_dir, f=f: run(spark, sf_dir, f(SPARK))) for k, f in BUILDERS.items()} | PLANS


def oracle_sql() -> dict[str, str]:
    return {k: f(DUCK) for k, f in BUILDERS.items() if k not in PLAN_SQL} | {k: f() for k, f in PLAN_SQL.items()}


def sentences(d: Dialect, rel: str, key: str) -> str:
    """(key, n, s): the trimmed sentences of a relation of texts."""
    out = d.explode(f"(SELECT {key}, {T.sentences(d, 'text')} AS ss FROM {rel}) s0", key, "ss", "item", "n")
    return f"(SELECT {key}, n, {T.trim(d, 'item')} AS s FROM {out} s1 WHERE {T.trim(d, 'item')} <> '')"


def statements(d: Dialect) -> str:
    return f"(SELECT * FROM {PM.gather(d, R.items(d) + ' i', 'pkg')} g)"


# ---- preflight ----
query("pr1_profile")(lambda d: PR.profile(d, "documents"))
query("pr4_language_hits")(lambda d: PR.language_hits(d, "documents"))
query("pr4_language_confusion")(lambda d: f"SELECT lang, detected_language, count(*) AS n, cast(sum(pt_hits) AS bigint) AS pt_hits, cast(sum(en_hits) AS bigint) AS en_hits FROM ({PR.language_hits(d, 'documents', more='lang, ')}) h GROUP BY lang, detected_language")
query("pr6_format")(lambda d: PR.source_format(d, R.formats(d) + " f", "doc_id"))
query("pr8_domain")(lambda d: PR.domain(d, R.formats(d) + " f", "doc_id"))
query("pr9_domain_language")(lambda d: PR.domain_language(d, "documents", "doc_id"))
query("pr10_guessed_language")(lambda d: PR.guessed_language(d, R.items(d) + " i", "pkg"))
query("pr11_profile_language")(lambda d: f"SELECT lang, own, count(*) AS n FROM (SELECT lang, {T.profile_language(d, 'text')} AS own FROM documents) p GROUP BY lang, own")


@plan("pr11_ngram_language", OR.ngram_languages)
def _ngrams(spark, sf_dir):
    """The language of every document by trigram ranks, profiles of the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return LN.detect(docs, "doc_id", "text", LN.profiles(docs.where("doc_id % 4 <> 2"))).withColumnRenamed("lang", "found")


@query("pr2_blocked")
def _blocked(d):
    samples = ["", "   ", "notes.txt", "a" * 40, "A1" * 20 + ".txt", "g" * 40, "dir/some file.txt", "dir/file.jsonl", "two\nlines.txt", "b" * 64, "word"]
    rel = d.rows(["n", "t"], [[str(i), d.lit(s)] for i, s in enumerate(samples)])
    return f"SELECT n, {PR.blocked(d, 't')} AS blocked FROM {rel} UNION ALL SELECT 1000 + page_id AS n, {PR.blocked(d, 'url')} AS blocked FROM pages"


# ---- segmentation ----
query("sg2_jsonl_spans")(lambda d: SG.jsonl(d, R.jsonl(d) + " j", "doc_id"))
query("sg3_json_array_spans")(lambda d: SG.json_array(d, R.json_array(d) + " j", "doc_id"))
query("sg4_markdown_spans")(lambda d: SG.sections(d, R.sections_md(d) + " m", "doc_id"))
query("sg5_legal_spans")(lambda d: SG.legal(d, R.legal(d) + " m", "doc_id"))
query("sg6_faq_spans")(lambda d: SG.faq(d, R.faq(d) + " m", "doc_id"))
query("sg7_plain_span")(lambda d: SG.plain(d, "documents", "doc_id"))
query("ch1_chunks")(lambda d: SG.pack(d, "documents", "doc_id", "text", 1500, r"\n"))
query("ch1_sections_packed")(lambda d: SG.pack(d, R.sections_md(d) + " m", "doc_id", "text", 200))
query("ch3_sections", lambda: OR.headed_sections(DUCK, R.book_md(DUCK) + " m", "doc_id"))(lambda d: SG.headed_sections(d, R.book_md(d) + " m", "doc_id"))
query("ch3_chunks", lambda: OR.chunks(DUCK, f"(SELECT doc_id, text FROM {R.book_md(DUCK)} m0 UNION ALL SELECT -1 - doc_id, text FROM documents) m", "doc_id", 60))(lambda d: SG.chunks(d, f"(SELECT doc_id, text FROM {R.book_md(d)} m0 UNION ALL SELECT -1 - doc_id, text FROM documents) m", "doc_id", 60))
query("ch4_rough_sections")(lambda d: SG.rough_sections(d, R.book_md(d) + " m", "doc_id"))
query("ch2_headings", lambda: OR.headings(DUCK, f"(SELECT doc_id, text FROM {R.sections_md(DUCK)} m)", "doc_id"))(lambda d: SG.headings(d, f"(SELECT doc_id, text FROM {R.sections_md(d)} m)", "doc_id"))
query("ch2_document_headings", lambda: f"SELECT doc_id, count(*) AS n, min(line_no) AS first_line, max(depth) AS deepest FROM ({OR.headings(DUCK, 'documents', 'doc_id')}) h GROUP BY doc_id")(lambda d: f"SELECT doc_id, count(*) AS n, min(line_no) AS first_line, max(depth) AS deepest FROM ({SG.headings(d, 'documents', 'doc_id')}) h GROUP BY doc_id")
query("io24_manifest")(lambda d: SG.manifest(d, f"(SELECT doc_id, 's_001' AS span_id, 'document' AS source_type, 'document' AS path, {d.sha256(T.trim(d, 'text'))} AS text_sha256, {T.trim(d, 'text')} AS text FROM documents) s"))

# ---- sources and markup ----
query("io6_running_text")(lambda d: IO.running_text(d, R.page_text(d) + " p", "host", "page_id"))
query("io8_transcript")(lambda d: IO.transcript(d, R.transcript(d) + " t", "conv_id"))
query("io8_named")(lambda d: IO.spoken_text(d, f"(SELECT conv_id, text, CASE conv_id % 3 WHEN 0 THEN 'talk.VTT' WHEN 1 THEN 'talk.srt' ELSE 'talk.txt' END AS filename FROM {R.transcript(d)} t)", "conv_id", "filename"))
query("io5_page_lines")(lambda d: f"SELECT * FROM {LA.page_lines(d, R.placed_words(d) + ' w', 'doc_id')} p")
query("io7_layout_markdown")(lambda d: LA.markdown(d, R.placed_words(d) + " w", "doc_id"))
query("io9_package_format")(lambda d: f"SELECT doc_id, {IO.package_format(d, 'text', "CASE WHEN length(text) % 3 = 0 THEN 'a.md' ELSE 'upload' END")} AS fmt, {IO.readable(d, 'text')} AS readable FROM {R.formats(d)} f")
query("io13_report_sections")(lambda d: IO.report_sections(d, R.report_md(d) + " m", "doc_id"))
query("io16_bullets")(lambda d: IO.bullets(d, R.report_md(d) + " m", "doc_id"))
query("io17_subsections")(lambda d: IO.subsections(d, R.report_md(d) + " m", "doc_id"))


query("io13_package_items")(lambda d: RD.package_items(d, R.package_md(d) + " m", "doc_id"))


@query("io15_section_keys")
def _section_keys(d):
    """The keys of titles as packages spell them: each known one, some unknown, and one with a count for each part."""
    odd = [*(k.title() + " (12)" for k in RD.SECTION_TITLES), "Unknown", "", "Entities and more", " PLAYBOOKS ( 3 ) "]
    known = list(RD.SECTION_TITLES)
    counted = f"CASE p_partkey % {len(known)} " + " ".join(f"WHEN {i} THEN {d.lit(t)}" for i, t in enumerate(known)) + f" END || ' (' || {d.text('p_size')} || ')'"
    titles = f"(SELECT title FROM {d.rows(['title'], [[d.lit(t)] for t in odd])} o UNION ALL SELECT {counted} AS title FROM part)"
    return f"SELECT title, {RD.section_key(d, 'title')} AS section_key FROM {titles} t"


query("io19_grouped_blocks")(lambda d: RD.grouped_blocks(d, R.package_md(d) + " m", "doc_id"))
query("rp1_core_intent")(lambda d: RD.core_intent(d, R.package_md(d) + " m", "doc_id"))
query("rp2_domain_map")(lambda d: RD.domain_map(d, R.package_md(d) + " m", "doc_id"))
query("rp5_bullet_sections")(lambda d: RD.bullet_rows(d, R.package_md(d) + " m", "doc_id"))
query("rp3_headed_sections")(lambda d: RD.headed_rows(d, R.package_md(d) + " m", "doc_id"))
query("rp21_group_lists")(lambda d: RD.group_lists(d, R.package_md(d) + " m", "doc_id"))
query("rp23_traceability")(lambda d: RD.traceability(d, R.package_md(d) + " m", "doc_id"))


@query("io14_trace_tags")
def _tags(d):
    cols = ", ".join(f"{v} AS {k}" for k, v in IO.trace_tag(d, "bullet").items())
    return f"SELECT doc_id, grp, {cols} FROM ({IO.bullets(d, R.report_md(d) + ' m', 'doc_id')}) b"


@query("rp_sections")
def _parsed(d):
    b = f"(SELECT doc_id, grp, {IO.trace_tag(d, 'bullet')['bare']} AS bullet FROM ({IO.bullets(d, R.report_md(d) + ' m', 'doc_id')}) b)"
    starts = {"heuristics": "**When**%", "decision_rules": "IF %", "anti_patterns": "**Guess%", "causal_chains": "delay%"}
    return " UNION ALL ".join(f"SELECT * FROM ({IO.parsed_bullet(d, f"(SELECT * FROM {b} q WHERE bullet LIKE '{like}') w", 'doc_id, grp', s)}) x{i}" for i, (s, like) in enumerate(starts.items()))


def _packages(spark, sf_dir):
    """The texts of packages of customers, which are fenced Markdown, JSON or YAML by turns."""
    form = F.expr("CASE doc_id % 3 WHEN 0 THEN 'markdown' WHEN 1 THEN 'json' ELSE 'yaml' END")
    return FE.write_forms(run(spark, sf_dir, f"SELECT * FROM {R.packages_json(SPARK)} p"), form).select("doc_id", "text", F.expr("CASE form WHEN 'markdown' THEN 'package.md' END").alias("filename"))


@plan("io10_package_sections", OR.package_sections)
def _sections(spark, sf_dir):
    """Every package written as text and read back."""
    return FE.read(hold(_packages(spark, sf_dir))).where("error IS NULL").select("doc_id", "section", "value")


@plan("io11_package_filled", OR.package_filled)
def _filled(spark, sf_dir):
    """Every package written as text, read back and filled with defaults and traces."""
    return FE.filled(FE.read(hold(_packages(spark, sf_dir))))


@plan("io11_package_files", OR.package_sections)
def _package_files(spark, sf_dir):
    """Every package written as a file of its own and the folder read back."""
    kind = "CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.json' ELSE '.yaml' END"
    texts = _packages(spark, sf_dir).select(F.lit("").alias("folder"), F.expr(f"doc_id || {kind}").alias("file"), "text")
    read = FO.through(texts, lambda root: FO.packages(spark, root).where("error IS NULL").select("doc_id", "section", "value"))
    return read.select(F.expr("cast(regexp_extract(doc_id, '^[0-9]+', 0) AS bigint)").alias("doc_id"), "section", "value")


def _through_files(spark, sf_dir, read):
    """What read(root) gives of the case folders of all parts, written as files."""
    return FO.through(run(spark, sf_dir, f"SELECT * FROM {R.case_files(SPARK)} f"), read)


@plan("hp18_case_files", OR.case_files)
def _case_files(spark, sf_dir):
    """Every case file of two languages, with what is wrong with it."""
    return _through_files(spark, sf_dir, lambda root: FO.cases(spark, root).select("lang", "file", "stem", "case_id", "error", F.sha2("value", 256).alias("value_sha256")))


@plan("hp19_case_index", OR.case_index)
def _case_index(spark, sf_dir):
    """The case of each id and language."""
    return FO.index(_through_files(spark, sf_dir, lambda root: FO.cases(spark, root).select("lang", "file", "case_id", "error"))).select("lang", "case_id", "file")


@plan("hp25_parity", OR.case_parity)
def _case_parity(spark, sf_dir):
    """Ids and names that the languages' folders and the packages do not share."""
    return FO.uneven(_through_files(spark, sf_dir, lambda root: FO.sides(spark, root)))


@plan("sn3_strings", OR.nested_strings)
def _strings(spark, sf_dir):
    """Every text anywhere in the packages' values, with its path."""
    rows = run(spark, sf_dir, f"SELECT struct(doc_id, section) AS key, value FROM {R.packages_json(SPARK)} p")
    return FE.strings(rows, "key", "value").select("key.doc_id", "key.section", "path", "text")


@query("io20_json")
def _json(d):
    obj = "'{\"id\":' || " + d.json_quote("section || '_' || " + d.text("ord")) + " || ',\"body\":' || " + d.json_quote("body") + " || '}'"
    return f"SELECT pkg, section, '[' || {d.join(d.gather(obj, 'ord'), ',')} || ']' AS items_json, count(*) AS n FROM {R.items(d)} i GROUP BY pkg, section"


@query("io23_report_md")
def _report(d):
    line = "'- ' || body || ' _[' || coalesce(id, '?') || ' | ' || basis || ' | c=' || " + d.fmt("%.2f", "coalesce(confidence, " + d.real("0") + ")") + " || ' | ' || ref || ']_'"
    return f"SELECT pkg, section, '## ' || section || ' (' || {d.text('count(*)')} || ')' || chr(10) || {d.join(d.gather(line, 'ord'), chr(10))} AS report FROM {R.items(d)} i GROUP BY pkg, section"


# ---- extraction ----
query("ex2_definitions")(lambda d: EX.definitions(d, R.sections_md(d) + " m", "doc_id"))
query("ex3_rules")(lambda d: EX.rules(d, R.sections_md(d) + " m", "doc_id"))
query("ex4_procedures")(lambda d: EX.procedures(d, R.sections_md(d) + " m", "doc_id", "'Order ' || " + d.text("doc_id")))
query("ex5_statements")(lambda d: EX.statements(d, f"(SELECT conv_id, turn, text FROM conversations)", "conv_id", "turn", "conv_id") if d.name == "duckdb" else EX.statements(d, "conversations", "conv_id", "turn", "conv_id"))
query("ex6_excerpts")(lambda d: EX.excerpts(d, "conversations", "turn", "conv_id"))
query("ex11_numeric_facts")(lambda d: EX.numeric_facts(d, R.sections_md(d) + " m", "doc_id"))
query("ex11_document_literals")(lambda d: EX.numeric_facts(d, "documents", "doc_id", context=False))
query("ex11_kind_counts")(lambda d: EX.kind_counts(d, "documents"))
query("ex12_modal_units")(lambda d: EX.modal_units(d, f"(SELECT doc_id, replace(replace(text, 'must', 'deve'), 'is not', 'não pode') AS text FROM {R.sections_md(d)} m) n", "doc_id"))
query("ex13_conditionals")(lambda d: EX.conditionals(d, f"(SELECT doc_id, n, s AS text FROM {sentences(d, 'documents', 'doc_id')} x) y", "doc_id, n"))
query("ex13_item_conditionals")(lambda d: EX.conditionals(d, f"(SELECT pkg, source_id, statement AS text FROM {statements(d)} x) y", "pkg, source_id"))
query("ex14_span_questions")(lambda d: f"SELECT pkg, span_id, {PM.span_question(d, 'text', 'CASE WHEN span_id = ' + d.lit('s_002') + ' THEN title ELSE ' + d.lit('') + ' END')} AS question FROM {R.spans(d)} s")
query("ex15_negations")(lambda d: f"SELECT pkg, source_id, {EX.question(d, 'statement')} AS question, {EX.subject(d, 'statement')} AS subject FROM {statements(d)} s WHERE {d.has('lower(statement)', P.NEGATION)}")
query("ex17_splits")(lambda d: f"SELECT pkg, source_id, {EX.split_on(d, 'statement', P.EXCEPTION, 1)} AS general_rule, {EX.split_on(d, 'statement', P.EXCEPTION, 2)} AS exception_case FROM {statements(d)} s")


@query("ex10_flat_to_sections")
def _flat(d):
    cut = r"(?i)^IF\s+(.+?),?\s+THEN\s+(.+?)\.?\z"
    return f"""SELECT pkg, ord, CASE WHEN {d.has('body', cut)} THEN 'if_then_rules' WHEN section IN ('{"', '".join(P.SECTIONS)}') THEN section ELSE 'atomic_units' END AS target_section,
    CASE WHEN {d.has('body', cut)} THEN {d.first('body', cut, 1)} ELSE coalesce(nullif(title, ''), substr(body, 1, 80)) END AS part1, CASE WHEN {d.has('body', cut)} THEN {d.first('body', cut, 2)} ELSE body END AS part2
    FROM (SELECT pkg, ord, CASE WHEN ord % 5 = 2 THEN 'unknown' ELSE section END AS section, title, body FROM {R.items(d)} i) f"""


# ---- predicates ----
@query("fl_sentence_flags")
def _flags(d):
    f = {"complete": T.complete(d, "s"), "truncated": T.truncated(d, "s"), "pt": T.portuguese_signals(d, "s"), "en": T.english_signals(d, "s"), "wrong_en": T.wrong_language(d, "s", "'en'"), "wrong_pt": T.wrong_language(d, "s", "'pt'"), "conditional": d.has("s", P.CONDITIONAL_WORDS), "procedural": d.has("s", P.PROCEDURAL_WORDS)}
    return f"SELECT lang, count(*) AS n, {', '.join(f'{d.count_if(v)} AS n_{k}' for k, v in f.items())} FROM (SELECT lang, s FROM {sentences(d, 'documents', 'lang')} x) y GROUP BY lang"


query("fl5_item_flags")(lambda d: f"SELECT pkg, source_id, {T.complete(d, 'statement')} AS complete, {T.truncated(d, 'statement')} AS truncated FROM {statements(d)} s")
query("fl9_reject_reasons")(lambda d: f"SELECT reason, role, count(*) AS n FROM (SELECT role, {T.reject_reason(d, 's', 'role', d.lit('en'))} AS reason FROM (SELECT CASE WHEN n % 2 = 0 THEN 'substantive' ELSE 'title' END AS role, s FROM {sentences(d, 'documents', 'doc_id')} x) y) z GROUP BY reason, role")
query("fl10_valid_chunks")(lambda d: f"SELECT pkg, ord, {PM.valid_chunk(d, 'body', 'context')} AND n_refs > 0 AND n_excerpts > 0 AS valid FROM {R.items(d)} i WHERE section = 'retrieval_chunks'")
query("fl13_refusals")(lambda d: f"SELECT conv_id, turn, {BM.refusal(d, 'text')} AS refused, {BM.escalation(d, 'text')} AS escalates FROM conversations UNION ALL SELECT o_orderkey, 0, {BM.refusal(d, "CASE o_orderkey % 3 WHEN 0 THEN 'I cannot say.' WHEN 1 THEN 'Please consult the legal team.' ELSE 'The CEO said yes.' END")}, {BM.escalation(d, "CASE o_orderkey % 3 WHEN 0 THEN 'I cannot say.' WHEN 1 THEN 'Please consult the legal team.' ELSE 'The CEO said yes.' END")} FROM orders")
query("fl15_search")(lambda d: f"SELECT pkg, section, ord FROM {R.items(d)} i WHERE contains(lower(title || ' ' || body), 'review order 1')")

LITERALS = ["review order 1", "Courier", "vs.", "or", "signed contract that nobody has"]


@plan("fl15_indexed_search", lambda: OR.literal_search(LITERALS))
def _searched(spark, sf_dir):
    """Several literals searched in the items of all packages by a posting table."""
    items = run(spark, sf_dir, f"SELECT * FROM {R.partials(SPARK)} p")
    path = scratch(spark)
    SE.index(items, path)
    return SE.search(items, path, LITERALS)


# ---- similarity, dedup, merge ----
query("dd3_jaccard_join")(lambda d: DD.shared_tokens(d, "(SELECT doc_id, text FROM documents)", "(SELECT item_id, text FROM benchmark)", "doc_id", "item_id", 0.2))
query("dd4_turn_similarity")(lambda d: f"SELECT conv_id, turn, {d.half_even(T.jaccard(d, 'a', 'b'), 6)} AS similarity FROM (SELECT conv_id, turn, {T.plain_tokens(d, 'text')} AS a, {T.plain_tokens(d, 'coalesce(before, ' + d.lit('') + ')')} AS b FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) c) e")
query("dd6_uniq")(lambda d: DD.distinct_first(d, R.items(d) + " i", "pkg, section", "ord", "title"))
query("dd7_exact_dedup")(lambda d: DD.corpus_exact(d, "documents", "doc_id"))
query("dd8_fuzzy_leaders")(lambda d: DD.leaders(d, f"(SELECT * FROM {R.items(d)} i0 WHERE section = 'atomic_units') i", "pkg", "ord", "body", 0.8))
query("dd16_sanitizer_dedup")(lambda d: DD.leaders(d, f"(SELECT pkg, ord, title || ' ' || body AS t FROM {R.items(d)} i0 WHERE section = 'retrieval_chunks') i", "pkg", "ord", "t", 0.85, plain=True))
query("dd9_entity_merge")(lambda d: DD.merge_entities(d, f"(SELECT pkg, ord, title AS name, body AS description, context AS alias, confidence FROM {R.items(d)} i0 WHERE section = 'entities') i", "pkg", "ord"))
query("dd9_fuzzy_entities")(lambda d: DD.fuzzy_merge(d, R.loose_entities(d) + " i", "pkg", "ord", "name", "description", "alias", 0.7))
query("dd10_fuzzy_concepts")(lambda d: DD.fuzzy_merge(d, R.loose_entities(d) + " i", "pkg", "ord", "name", "description", "''", 0.75))
query("dd15_kept_apart")(lambda d: f"SELECT * FROM {DD.kept_apart(d, f"(SELECT pkg, ord, body FROM {R.items(d)} i0 WHERE section = 'retrieval_chunks') i", 'pkg', 'ord', 'body', 'body')} k")
query("dd11_relations")(lambda d: DD.relations(d, f"(SELECT pkg, ord, title AS name, basis AS relation FROM {R.items(d)} i0 WHERE section = 'entities') i", "pkg", "ord"))
query("dd12_trace_merge")(lambda d: DD.merge_traces(d, f"(SELECT pkg, ord, ref, basis, confidence FROM {R.items(d)} i0 WHERE section = 'concepts') i", "pkg", "ord"))
query("dd17_package")(lambda d: RE.package_fields(d, R.package_texts(d)))


@plan("dd17_reduce", OR.reduced)
def _reduced(spark, sf_dir):
    """All partial packages of all customers reduced to one package each."""
    return RE.reduce(run(spark, sf_dir, f"SELECT * FROM {R.partials(SPARK)} p")).withColumnRenamed("ord", "place").selectExpr(*OR.columns(SPARK))


query("dd14_longest")(lambda d: DD.longest(d, R.items(d) + " i", "pkg, section", "ord", "body"))

# ---- promotion, coverage, sanitation ----
query("pm1_sources")(lambda d: f"SELECT * FROM {PM.gather(d, R.items(d) + ' i', 'pkg')} g")
query("pm2_promote")(lambda d: PM.promote(d, statements(d), "pkg"))
query("pm5_gate_audit")(lambda d: PM.gate(d, statements(d), "pkg"))


def _gated(d):
    return f"(SELECT s0.*, row_number() OVER (PARTITION BY pkg ORDER BY source_section, coalesce(source_id, ''), statement) AS ord FROM {statements(d)} s0)"


@plan("pm5_promoted", lambda: PM.promoted(DUCK, _gated(DUCK), "pkg"))
def _promoted(spark, sf_dir):
    """What the statements become and what rejects them. Candidates are judged once, though looked at twice."""
    judged = hold(run(spark, sf_dir, PM.candidates(SPARK, _gated(SPARK), "pkg")))
    return spark.sql(f"WITH {PM.kept_promotions(SPARK, relation(judged), 'pkg')}")



query("cv1_inserted_balanced")(lambda d: PM.inserted(d, R.spans(d) + " sp0", f"(SELECT * FROM {R.items(d)} ix WHERE ord % 5 = 0 OR section <> 'retrieval_chunks')", "pkg", "balanced", False))
query("cv1_inserted_complete")(lambda d: PM.inserted(d, R.spans(d) + " sp0", f"(SELECT * FROM {R.items(d)} ix WHERE ord % 5 = 0 OR section <> 'retrieval_chunks')", "pkg", "complete", True))
query("cv1_coverage")(lambda d: PM.covered(d, R.spans(d) + " s", R.items(d) + " i", "pkg"))
query("cv3_path_titles")(lambda d: f"SELECT pkg, span_id, {PM.path_title(d, 'path')} AS title, {PM.coverage_mode('CASE WHEN pkg % 2 = 0 THEN ' + d.lit('faq') + ' ELSE ' + d.lit('markdown') + ' END')} AS mode FROM {R.spans(d)} s")
query("sn4_titles")(lambda d: f"SELECT pkg, ord, {PM.repaired_title(d, 'title', 'body')} AS title FROM {R.items(d)} i WHERE section = 'retrieval_chunks'")


def _sanitized(d):
    cols = {"name": "title", "label": "title", "title": "title", "statement": "body", "definition": "body", "description": "body", "decision": "body", "condition": "title", "compressed_knowledge": "body", "standalone_context": "context", "type": "context"}
    used = ("entities", "concepts", "decision_rules", "retrieval_chunks", "atomic_units")
    fields = [(s, f, cols[f], r) for s, f, r in P.FIELD_ROLES if s in used and f in cols]
    fine = f"(section = 'retrieval_chunks' AND {PM.valid_chunk(d, 'body', 'context')} AND n_refs > 0 AND n_excerpts > 0)"
    return PM.sanitize(d, PM.field_rows(d, f"(SELECT *, {fine} AS fine FROM {R.items(d)} i0) i", "pkg", fields, "fine"), "pkg")


@query("sn1_duplicates")
def _near_copies(d):
    """SN1's second phase over what the first one keeps: the items of each section that are near copies of one kept before."""
    text = "CASE section WHEN 'atomic_units' THEN body ELSE title || ' ' || body END"
    kept = f"(SELECT i.pkg, i.section, i.ord, {text.replace('section', 'i.section')} AS x FROM {R.items(d)} i JOIN (SELECT pkg AS p, section AS s, ord AS o FROM ({_sanitized(d)}) z0 WHERE reason IS NULL) z ON i.pkg = z.p AND i.section = z.s AND i.ord = z.o WHERE i.section IN ('decision_rules', 'retrieval_chunks', 'atomic_units'))"
    return f"SELECT pkg, section, ord, CASE WHEN near THEN 'near_duplicate' END AS reason FROM {DD.kept_apart(d, kept + ' j', 'pkg, section', 'ord', 'x', 'x')} k"


@plan("sn1_package", OR.package_verdicts)
def _verdicts(spark, sf_dir):
    """The verdict on every item of every package, all sections and fields."""
    return SA.judged(run(spark, sf_dir, f"SELECT * FROM {R.partial_sections(SPARK)} p")).drop("item")


query("sn1_sanitize")(_sanitized)
query("sn1_reject_counts")(lambda d: f"SELECT section, field, reason, count(*) AS n FROM ({_sanitized(d)}) s GROUP BY section, field, reason")



@query("sn5_language_recovery")
def _recovered(d):
    """Packages that call themselves Portuguese or English, the language their verdicts give them, and what a second pass in it rejects."""
    own = "CASE WHEN pkg % 3 = 0 THEN 'pt' ELSE 'en' END"
    cols = {"statement": "body", "definition": "body", "description": "body"}
    fields = [(s, f, cols[f], r) for s, f, r in P.FIELD_ROLES if s in ("atomic_units", "concepts", "entities") and f in cols]
    rows = PM.field_rows(d, R.items(d) + " i", "pkg", fields)
    detected = f"(SELECT pkg, {own} AS language, language AS detected FROM ({PR.guessed_language(d, R.items(d) + ' i', 'pkg')}) g)"
    found = f"({PM.recovery(d, f"({PM.sanitize(d, rows, 'pkg', own)})", detected, 'pkg')})"
    again = f"(SELECT f.*, r.language_after FROM {rows} f JOIN (SELECT pkg AS rk, language_after FROM {found} r0 WHERE applied) r ON f.pkg = r.rk)"
    left = f"(SELECT pkg AS k, {d.count_if('reason IS NOT NULL')} AS rejected_after FROM ({PM.sanitize(d, again, 'pkg', 'language_after')}) s GROUP BY pkg)"
    return f"SELECT pkg, language, detected, language_after, applied, rejected, mismatches, restored, coalesce(rejected_after, rejected) AS rejected_after FROM {found} f LEFT JOIN {left} l ON f.pkg = l.k"


# ---- identity, provenance, numeric integrity ----
query("id1_ids")(lambda d: TR.stable_ids(d, R.items(d) + " i", "pkg"))
query("id2_missing_ids")(lambda d: TR.missing_ids(d, R.items(d) + " i", "pkg"))
query("tr1_trace")(lambda d: TR.trace(d, f"(SELECT * FROM {R.items(d)} i0 WHERE id IS NOT NULL AND section <> 'retrieval_chunks') i", R.spans(d), "pkg"))
query("tr2_trace_rows")(lambda d: TR.trace_rows(d, R.items(d) + " i", "pkg"))
query("tr3_enrich")(lambda d: TR.enrich(d, f"({TR.trace_rows(d, R.items(d) + ' i', 'pkg')})", f"(SELECT pkg, span_id AS source_id, 'document' AS source_type, path, {d.sha256('text')} AS text_sha256 FROM {R.spans(d)} s WHERE span_id <> 's_003')", "pkg"))



@query("tr3_all_fields")
def _enriched(d):
    rows = f"(SELECT pkg, id AS extracted_item_id, n AS ref_no, ref AS source_location, CASE WHEN ord % 2 = 0 THEN '' ELSE basis END AS basis, confidence FROM {d.explode(f'(SELECT pkg, id, ord, basis, confidence, refs FROM {R.items(d)} i0 WHERE id IS NOT NULL) i', 'pkg, id, ord, basis, confidence', 'refs', 'ref', 'n')} x)"
    place = "cast(right(span_id, 1) AS int)"
    manifest = f"(SELECT pkg, span_id AS source_id, 'r_' || {d.text('pkg')} AS source_record_id, 'customers.md' AS source_file, path, {place} * 10 AS line_start, {place} * 10 + 2 AS line_end, {place} * 100 AS char_start, {place} * 100 + length(text) AS char_end FROM {R.spans(d)} s WHERE span_id <> 's_003')"
    return TR.enriched(d, rows, manifest, "pkg")


query("tr4_synthesized")(lambda d: TR.synthesized(d, f"(SELECT pkg, id, CASE WHEN ord % 4 = 0 THEN NULL ELSE basis END AS basis, refs, {d.array(d.lit(' '), 'excerpt')} AS excerpts FROM {R.items(d)} i0)", "(SELECT DISTINCT pkg FROM " + R.items(d) + " t0 WHERE pkg % 4 = 0)", "pkg"))


def _numeric_items(d):
    cut = f"CASE WHEN s.pkg % 3 = 0 THEN '$' || {d.money('c_acctbal * 1000')} WHEN s.pkg % 3 = 1 THEN '$' || {d.first(d.money('c_acctbal * 1000'), r'^[^,.]+', 0)} ELSE '$77,777.77' END"
    return f"(SELECT s.pkg, 'au_' || s.span_id AS id, 'The balance is ' || {cut} || ' today, as of 2024-05-06.' AS body, s.text AS source FROM {R.spans(d)} s JOIN customer c ON s.pkg = c.c_custkey WHERE s.span_id = 's_001')"


query("ng1_numeric_repair")(lambda d: TR.numeric_check(d, _numeric_items(d) + " n", "pkg"))
query("ng3_score")(lambda d: TR.numeric_score(d, f"({TR.numeric_check(d, _numeric_items(d) + ' n', 'pkg')})", "pkg"))

# ---- statistics and reports ----
query("ag1_stats")(lambda d: AG.stats(d, R.items(d) + " i", "pkg"))
query("ag3_quality")(lambda d: AG.quality(d, R.items(d) + " i", "pkg", "4"))
query("ag4_allocation")(lambda d: AG.allocation(d, R.items(d) + " i", f"(SELECT pkg, text || ' not if step' AS text FROM {R.spans(d)} s0 WHERE span_id = 's_003') s1", "pkg"))
query("ag5_acceptance")(lambda d: f"SELECT target_section, count(*) AS attempted, {d.count_if('reason IS NULL')} AS promoted, {d.half_even(f"1 - {d.real(d.count_if("reason = 'language_mismatch'"))} / count(*)", 4)} AS language_fidelity, {d.half_even(f"{d.real(d.count_if('reason IS NULL'))} / count(*)", 4)} AS acceptance_rate FROM ({PM.gate(d, statements(d), 'pkg')}) g GROUP BY target_section")
@plan("ag7_report", OR.inspected)
def _inspected(spark, sf_dir):
    """The inspection report of every package."""
    full = hold(FE.filled(run(spark, sf_dir, f"SELECT * FROM {R.packages_json(SPARK)} p")))
    found = IN.report(full, run(spark, sf_dir, f"SELECT * FROM {R.package_sources(SPARK)} s"))
    return found.select("doc_id", *(F.coalesce(F.expr(v), F.lit("")).alias(k) if "array_join" in v else F.expr(v).alias(k) for k, v in OR.REPORT.items()))


query("ag8_inventory")(lambda d: AG.inventory(d, R.items(d) + " i"))
query("ag9_confidence")(lambda d: AG.confidence_buckets(d, R.items(d) + " i", "pkg"))
query("ag10_worst_traced")(lambda d: AG.worst_traced(d, R.items(d) + " i", "pkg"))
query("ag11_orphans")(lambda d: AG.orphans(d, R.items(d) + " i", "pkg"))
query("ag12_locate")(lambda d: f"SELECT pkg, section, ord, {AG.locate(d, 'excerpt', 'text')} AS located FROM (SELECT i.pkg, i.section, i.ord, CASE WHEN i.ord % 2 = 0 THEN upper(s.title) ELSE 'has  orders on   file' END AS excerpt, s.title || ' ' || s.text AS text FROM {R.items(d)} i JOIN {R.spans(d)} s ON i.pkg = s.pkg AND i.ref = s.span_id) q")
query("ag13_compression")(lambda d: AG.compression(d, "documents", "doc_id", "text", T.norm(d, "text")))
query("ag14_rule_samples")(lambda d: AG.rule_samples(d, R.items(d) + " i", "pkg"))
query("ag15_case_index")(lambda d: f"SELECT c.case_id, c.domain, t.case_id IS NOT NULL AS has_translation FROM {R.cases(d)} c LEFT JOIN (SELECT case_id FROM {R.cases(d)} c1 WHERE n_probes > 1) t ON c.case_id = t.case_id")
query("ag16_grouping_sets")(lambda d: f"SELECT domain, relation_type, complexity_level, source_status, count(*) AS n FROM {R.cases(d)} c GROUP BY GROUPING SETS ((domain), (relation_type), (complexity_level), (source_status))")


def _labelled(d):
    return f"(SELECT r.*, k.label, k.confidence AS label_confidence FROM {R.results(d)} r JOIN ({BM.classify(d, R.results(d) + ' r1', 'task_key')}) k ON r.task_key = k.task_key)"


query("ag17_summary")(lambda d: BM.summary(d, _labelled(d), "model_spec, condition, relation_type, complexity_level, source_status"))
query("ag18_rollup")(lambda d: f"SELECT model_spec, condition, count(*) AS n, {d.count_if(f'label = {d.lit('correct')}')} AS correct FROM {_labelled(d)} x GROUP BY ROLLUP (model_spec, condition)")
query("ag19_cost")(lambda d: f"SELECT model_spec, count(*) AS calls, cast(sum(floor((length(raw_text) + length(query) + 100) / 4)) AS bigint) AS tokens_in, cast(sum(200) AS bigint) AS tokens_out FROM (SELECT t.model_spec, c.raw_text, c.query FROM ({BM.tasks(d, R.cases(d), ['a:one', 'b:two'], P.QUERY_TYPES, 2)}) t JOIN {R.cases(d)} c ON t.case_id = c.case_id) q GROUP BY model_spec")



@query("ag19_priced")
def _priced(d):
    tasks = BM.tasks(d, R.cases(d), ["mock:yes", "openai:large-2024-08-06", "other:one"], P.QUERY_TYPES, 2)
    rows = f"(SELECT t.model_spec, t.query_type, c.raw_text AS context, c.query AS asked, c.query, c.gold FROM ({tasks}) t JOIN {R.cases(d)} c ON t.case_id = c.case_id)"
    return BM.cost(d, rows, {"mock:yes": (0.0, 0.0), "openai:large": (2.5, 10.0)}, "openai:judge", system_chars=400)


# ---- evaluation harness ----
query("bm1_tasks")(lambda d: BM.tasks(d, R.cases(d), ["mock:yes", "mock:no"], P.QUERY_TYPES, 2))


@query("bm4_scored", lambda: OR.scored(DUCK))
def _scored(d):
    rows = d.once(R.results(d), likeness=BM.overlap(d, "response", "gold"))
    return f"SELECT task_key, {d.half_even('likeness', 6)} AS overlap, CASE WHEN likeness >= 0.4 THEN 'probe_pass' ELSE 'probe_fail' END AS probe FROM {rows} r"


query("bm5_polarity")(lambda d: f"SELECT task_key, {BM.polarity(d, 'response')} AS pol, {BM.polarity(d, 'gold')} AS gold_pol FROM {R.results(d)} r")
query("bm6_turn_overlap")(lambda d: f"SELECT conv_id, turn, {d.half_even(BM.overlap(d, 'text', 'before'), 6)} AS overlap FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) c WHERE before IS NOT NULL")
query("bm7_classify")(lambda d: f"SELECT task_key, pol_gold, pol_resp, {d.half_even('overlap', 6)} AS overlap, label, confidence FROM ({BM.classify(d, R.results(d) + ' r1', 'task_key')}) k")
MODELS = ["anthropic:one", "openai:two", "google:three", "mock:yes", "openai:gpt-5", "openai:gpt-5-mini"]


def _models(d):
    return f"(SELECT CASE p_size % {len(MODELS)} " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MODELS)) + " END AS model_spec, count(*) AS n FROM part GROUP BY 1)"


query("bm10_families")(lambda d: f"SELECT model_spec, n, {BM.family(d, *BM.spec(d, 'model_spec'))} AS family, {BM.temperature(d, BM.spec(d, 'model_spec')[1], d.real('0.2'))} AS temperature FROM {_models(d)} m")
query("fl12_judge_family")(lambda d: BM.judge_conflicts(d, _models(d) + " m0", ["openai:judge", "google:judge", "other:judge", "mock:judge"]))


@query("bm3_queries")
def _asked(d):
    tasks = BM.tasks(d, R.cases(d), ["mock:yes"], P.QUERY_TYPES, 1)
    asked = BM.query_text(d, "t.query_type", "c.query", "CASE WHEN c.n_probes = 1 THEN '' ELSE 'Is ' || c.raw_text || ' exempt?' END", f"'Probe ' || {d.text('t.query_index')} || ' of ' || c.case_id")
    gold = BM.scoring_gold("t.query_type", "c.gold", "'No exemption.'")
    return f"SELECT t.task_key, {asked} AS asked, {gold} AS gold, {BM.prompt_name('t.query_type', "CASE WHEN c.complexity_level = 1 THEN 'standard' ELSE 'minimal' END")} AS prompt FROM ({tasks}) t JOIN {R.cases(d)} c ON t.case_id = c.case_id"


query("bm9_agreement")(lambda d: f"SELECT model_spec, count(*) AS n, {d.count_if('label = judged')} AS agreed FROM (SELECT model_spec, label, CASE WHEN length(case_id) % 2 = 0 THEN label ELSE 'other' END AS judged FROM {_labelled(d)} x) y GROUP BY model_spec")
query("bm12_violations")(lambda d: BM.violations(d, R.cases(d), "case_id"))
@plan("bm12_schema", OR.case_violations)
def _schema(spark, sf_dir):
    """Every violation of the case schema in every case file."""
    return SC.violations(run(spark, sf_dir, f"SELECT * FROM {R.cases_json(SPARK)} c"), "p_partkey", "value", SC.CASE_SCHEMA)


query("bm13_parity")(lambda d: f"SELECT coalesce(a.case_id, b.case_id) AS case_id, CASE WHEN b.case_id IS NULL THEN 'missing_translation' ELSE 'extra_translation' END AS problem FROM (SELECT case_id FROM {R.cases(d)} c WHERE n_probes <> 1) a FULL OUTER JOIN (SELECT case_id FROM {R.cases(d)} c WHERE n_probes <> 2) b ON a.case_id = b.case_id WHERE a.case_id IS NULL OR b.case_id IS NULL")
query("bm16_resume")(lambda d: f"SELECT t.task_key FROM ({BM.tasks(d, R.cases(d), ['mock:yes'], ['primary'], 2)}) t LEFT ANTI JOIN (SELECT task_key FROM {R.results(d)} r) p ON t.task_key = p.task_key" if d.name == "spark" else f"SELECT t.task_key FROM ({BM.tasks(d, R.cases(d), ['mock:yes'], ['primary'], 2)}) t ANTI JOIN (SELECT task_key FROM {R.results(d)} r) p ON t.task_key = p.task_key")
query("bm17_export")(lambda d: f"SELECT case_id, {d.sha256('raw_text')} AS raw_sha256, {d.sha256('gold')} AS gold_sha256, length(raw_text) AS raw_chars FROM {R.cases(d)} c")
@query("hp23_judge_prompt")
def _judge_prompt(d):
    few = lambda n: f"CASE n WHEN 0 THEN {d.empty()} WHEN 1 THEN {d.array('gold')} ELSE {d.array('gold', 'query', 'response', 'task_key')} END".replace("CASE n", f"CASE length(task_key) % {n}")
    return f"SELECT task_key, {JU.prompt(d, 'query', 'gold', 'substr(gold, 1, 20)', {'composition_hallucination': few(2), 'wrong_escalation': few(3), 'refusal': few(4)}, 'response')} AS prompt FROM {R.results(d)} r"


query("hp16_http_errors")(lambda d: f"SELECT o_orderkey, {BM.http_error(d, 'status', 'body')} AS error_class FROM (SELECT o_orderkey, cast(CASE o_orderkey % 7 WHEN 0 THEN 200 WHEN 1 THEN 401 WHEN 2 THEN 429 WHEN 3 THEN 402 WHEN 4 THEN 400 WHEN 5 THEN 400 ELSE 503 END AS int) AS status, CASE o_orderkey % 4 WHEN 0 THEN 'Schema with lots of properties' WHEN 1 THEN 'Invalid JSON schema' WHEN 2 THEN 'schema too complex' ELSE 'bad request' END AS body FROM orders) o")


@query("bm8_judge_json")
def _judge(d):
    ok = "'{\"label\":\"Correct\",\"confidence\":\"high\",\"rationale\":\"' || p_brand || '\"}'"
    raw = f"CASE p_partkey % 5 WHEN 0 THEN {ok} WHEN 1 THEN '```json' || chr(10) || {ok} || chr(10) || '```' WHEN 2 THEN 'I think ' || {ok} || ' fits.' WHEN 3 THEN '{{\"label\":\"strange\",\"confidence\":\"certain\"}}' ELSE 'no idea' END"
    return BM.judged(d, f"(SELECT p_partkey, {raw} AS raw FROM part) j", "p_partkey")
