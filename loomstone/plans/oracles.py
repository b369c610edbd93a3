"""DuckDB SQL for queries whose Spark side is not SQL text, written for the rules and not from the operators' code."""

from __future__ import annotations

from loomstone.functions import patterns as P
from loomstone.functions import text as T
from loomstone.functions.dialect import DUCK as D
from loomstone.functions.dialect import Dialect
from loomstone.operators import dedup as DD
from loomstone.operators import harness as BM
from loomstone.operators import reduce as RE
from loomstone.operators import segment as SG
from loomstone.plans import rendered as R
from loomstone.sources import fenced as FE


def _uniq(values: str, keys: str) -> str:
    return f"list_filter({values}, lambda x, i: {keys}[i] <> '' AND list_position({keys}, {keys}[i]) = i)"


def _fold(src: str, to: str) -> list[str]:
    """CTEs that fold the items of src to those of `to`: leaders by list_reduce over each section, then ordered lists."""
    alias = "list_transform(list_filter(links, lambda l: section = 'entities' AND l.kind = 'alias'), lambda l: l.value)"
    led = " UNION ALL ".join(
        DD.clusters(D, f"(SELECT pkg, section, ord, t, al FROM {to}_k k{i} WHERE section IN ({', '.join(repr(s) for s in found)}))", "pkg, section", "ord", "t", "al", 2 if t is None else t)
        for i, (t, found) in enumerate({t: [s for s, (_, u) in RE.KEYS.items() if u == t] for t in {u for _, u in RE.KEYS.values()}}.items())
    )
    rank = f"coalesce(list_position({D.words(P.BASIS_ORDER)}, coalesce(basis, 'uncertain')), 9)"
    named = "CASE WHEN section = 'entities' AND ord <> leader THEN list_append(links, {'kind': 'alias', 'value': a, 'relation': NULL}) ELSE links END"
    lk = f"CASE WHEN l.kind = 'related' THEN l.kind || '|' || {T.norm(D, 'l.value')} || '|' || {T.norm(D, "coalesce(l.relation, '')")} WHEN {T.norm(D, "coalesce(l.value, '')")} = '' THEN '' ELSE l.kind || '|' || {T.norm(D, 'l.value')} || '|' END"
    whole = "section IN ('entities', 'concepts')"
    plain = ", ".join(repr(s) for s, (_, t) in RE.KEYS.items() if t is None)
    return [
        f"{to}_k AS MATERIALIZED (SELECT * FROM (SELECT *, {RE.key(D)} AS t, {alias} AS al FROM {src}) k WHERE {T.norm(D, 't')} <> '' OR {whole})",
        f"{to}_l AS MATERIALIZED ({led})",
        f"""{to}_g AS MATERIALIZED (SELECT pkg, section, leader, count(*) AS n_rows, max(coalesce(confidence, 0)) AS top, list(basis ORDER BY {rank}, ord)[1] AS best, list(b ORDER BY length(b) DESC NULLS LAST, ord)[1] AS longest,
            flatten(list(refs ORDER BY ord)) AS all_refs, flatten(list(excerpts ORDER BY ord)) AS all_ex, flatten(list({named} ORDER BY ord)) AS all_links FROM {to}_k JOIN {to}_l USING (pkg, section, ord) GROUP BY pkg, section, leader)""",
        f"""{to} AS MATERIALIZED (SELECT pkg, section, leader AS ord, a, CASE WHEN n_rows > 1 AND {whole} THEN longest ELSE b END AS b, c, steps,
            CASE WHEN n_rows > 1 AND {whole} THEN {_uniq('all_links', f'list_transform(all_links, lambda l: {lk})')} ELSE links END AS links,
            CASE WHEN merged THEN top ELSE confidence END AS confidence, CASE WHEN merged THEN best ELSE basis END AS basis,
            CASE WHEN merged THEN {_uniq('all_refs', f'list_transform(all_refs, lambda v: {T.norm(D, "v")})')} ELSE refs END AS refs,
            CASE WHEN merged AND NOT {whole} THEN {_uniq('all_ex', f'list_transform(all_ex, lambda v: {T.norm(D, "v")})')} ELSE excerpts END AS excerpts, n_rows
            FROM (SELECT g.*, k.*EXCLUDE (pkg, section), n_rows > 1 AND g.section NOT IN ({plain}) AS merged FROM {to}_g g JOIN {to}_k k ON g.pkg = k.pkg AND g.section = k.section AND g.leader = k.ord) m)""",
    ]


def reduced() -> str:
    grown = ", ".join(repr(s) for s in RE.GROWN)
    cols = "pkg, section, a, b, c, steps, links, confidence, basis, refs, excerpts"
    ctes = [
        f"items AS MATERIALIZED (SELECT * FROM {R.partials(D)} i)", *_fold("items", "one"), f"added AS MATERIALIZED ({RE.promoted(D, 'one')})",
        f"""both_ AS MATERIALIZED (SELECT {cols}, row_number() OVER (PARTITION BY pkg, section ORDER BY o1, o2, o3, o4) AS ord FROM (
            SELECT {cols}, -1 AS o1, ord AS o2, 0 AS o3, 0 AS o4 FROM one WHERE section IN ({grown}) UNION ALL SELECT pkg, section, a, b, c, steps, [] AS links, confidence, basis, refs, excerpts, o1, o2, o3, o4 FROM added) u)""",
        *_fold("both_", "two"),
    ]
    return f"WITH {', '.join(ctes)} SELECT {', '.join(columns(D))} FROM (SELECT *, row_number() OVER (PARTITION BY pkg, section ORDER BY ord) AS place FROM (SELECT * FROM one WHERE section NOT IN ({grown}) UNION ALL SELECT * FROM two) q) z"


def columns(d) -> list[str]:
    """Reduced items as a query shows them: lists as lines."""
    link = d.each("links", lambda v: f"{v}.kind || ': ' || coalesce({v}.value, '') || coalesce(' (' || {v}.relation || ')', '')", "v")
    return ["pkg", "section", "place", "a", "b", "c", f"{d.join('steps', chr(10))} AS steps", f"{d.join(link, chr(10))} AS links", f"{d.half_even('confidence', 6)} AS confidence", "basis", f"{d.join('refs', ',')} AS refs", f"{d.join('excerpts', chr(10))} AS excerpts", "n_rows"]


def package_sections() -> str:
    """What is read back is what was written."""
    return f"SELECT doc_id, section, value FROM {R.packages_json(D)} p"


def package_filled() -> str:
    """Defaults laid under what is given, member by member, and traces of items where there are none."""
    sections = D.rows(["section"], [[D.lit(s)] for s in FE.SECTIONS])
    defaults = D.rows(["section", "k", "x"], [[D.lit(s), D.lit(k), D.lit(FE._json(v))] for s, o in FE.OBJECTS.items() for k, v in o.items()])
    objects = ", ".join(D.lit(s) for s in FE.OBJECTS)
    order = "list_position([" + ", ".join(D.lit(s) for s in FE.LISTS) + "], section)"
    return f"""WITH given AS MATERIALIZED (SELECT * FROM {R.packages_json(D)} p), every_ AS (SELECT doc_id, section FROM (SELECT DISTINCT doc_id FROM given) a, {sections} b),
    own AS (SELECT e.doc_id, e.section, value AS v FROM every_ e LEFT JOIN given USING (doc_id, section)),
    obj AS (SELECT doc_id, section, CASE WHEN v LIKE '[%' AND section = 'knowledge_limits' THEN '{{"missing_context":' || v || '}}' WHEN v LIKE '[%' AND section = 'domain_map' THEN '{{"subdomains":' || v || '}}' ELSE coalesce(v, '{{}}') END AS v FROM own WHERE section IN ({objects})),
    member AS (SELECT doc_id, section, k, cast(json_extract(v, '$."' || k || '"') AS varchar) AS x FROM (SELECT doc_id, section, v, unnest(json_keys(v)) AS k FROM obj) m),
    laid AS (SELECT * FROM member UNION ALL SELECT o.doc_id, o.section, f.k, f.x FROM obj o JOIN {defaults} f USING (section) WHERE NOT list_contains(json_keys(o.v), f.k)),
    full_obj AS (SELECT doc_id, section, '{{' || string_agg(to_json(k) || ':' || x, ',' ORDER BY k) || '}}' AS value FROM laid GROUP BY doc_id, section),
    lists AS (SELECT doc_id, section, CASE WHEN v LIKE '[%' THEN v ELSE '[]' END AS value FROM own WHERE section NOT IN ({objects})),
    item AS (SELECT doc_id, {order} AS o, unnest(range(json_array_length(value)::BIGINT)) AS n, unnest(cast(json_extract(value, '$[*]') AS json[])) AS i FROM lists WHERE section <> 'source_traceability'),
    said AS (SELECT doc_id, o, n, i->>'id' AS id, coalesce(i->>'source_basis', 'uncertain') AS basis, coalesce(i->'source_refs'->>0, 'document') AS loc, json_array_length(i, '$.source_refs') AS refs, list_filter(cast(i->'source_excerpts' AS varchar[]), lambda e: trim(e) <> '') AS ex FROM item),
    made AS (SELECT doc_id, '[' || string_agg('{{"extracted_item_id":' || to_json(id) || ',"source_location":' || to_json(loc) || ',"source_excerpt":' || to_json(coalesce(ex[1], '')) || ',"extraction_type":' || to_json(basis) || '}}', ',' ORDER BY o, n) || ']' AS t FROM said WHERE id <> '' AND (len(ex) > 0 OR refs > 0) GROUP BY doc_id)
    SELECT doc_id, section, CASE WHEN section = 'source_traceability' AND value = '[]' THEN coalesce(t, value) ELSE value END AS value FROM (SELECT * FROM full_obj UNION ALL SELECT * FROM lists) z LEFT JOIN made USING (doc_id)"""


def nested_strings() -> str:
    """The engine's own walk over JSON trees."""
    return f"SELECT doc_id, section, fullkey AS path, atom->>'$' AS text FROM (SELECT p.doc_id, p.section, t.fullkey, t.atom, t.type FROM {R.packages_json(D)} p, json_tree(p.value) t) j WHERE type = 'VARCHAR'"


def case_violations() -> str:
    """What is wrong with a case, path by path, in the engine's own JSON functions."""
    where = lambda path, keyword, test: f"SELECT p_partkey, '{path}' AS path, '{keyword}' AS keyword FROM good WHERE {test}"
    text = lambda path: where(path, "type", f"json_exists(value, '{path}') AND json_type(value, '{path}') <> 'VARCHAR'")
    gone = lambda at, name: where(f"{at}.{name}", "required", f"json_type(value, '{at}') = 'OBJECT' AND NOT json_exists(value, '{at}.{name}')")
    tests = [
        "SELECT p_partkey, '$' AS path, 'json' AS keyword FROM cases WHERE NOT json_valid(value)",
        where("$.case_id", "pattern", "NOT regexp_matches(value->>'$.case_id', '^[a-z0-9_]+$')"), where("$.metadata.domain", "enum", "value->>'$.metadata.domain' NOT IN ('corporate_policy', 'regulatory', 'clinical', 'education', 'technical_ops', 'eligibility', 'legal')"),
        where("$.metadata.complexity_level", "type", "(value->>'$.metadata.complexity_level')::DOUBLE % 1 <> 0"), where("$.metadata.complexity_level", "maximum", "(value->>'$.metadata.complexity_level')::DOUBLE > 3"),
        text("$.metadata.notes"), gone("$.metadata", "license"), where("$.representations", "type", "json_type(value, '$.representations') <> 'OBJECT'"), where("$.local_probes", "minItems", "json_array_length(value, '$.local_probes') < 2"),
        where("$.controls.parametric_contamination_risk", "enum", "value->>'$.controls.parametric_contamination_risk' NOT IN ('low', 'medium', 'high')"),
        *(gone(f"$.local_probes[{i}]", n) for i in (0, 1) for n in ("fragment_id", "probe", "expected_answer")), *(text(f"$.local_probes[{i}].expected_answer") for i in (0, 1)), *(text(f"$.gold_answer.required_relations[{i}]") for i in range(3)),
    ]
    return f"WITH cases AS (SELECT * FROM {R.cases_json(D)} c), good AS (SELECT * FROM cases WHERE json_valid(value)) " + " UNION ALL ".join(tests)


def _cases() -> str:
    """Case files with their ids, as a WITH clause."""
    return f"""WITH files AS MATERIALIZED (SELECT * FROM {R.case_files(D)} f),
    found AS (SELECT CASE folder WHEN 'cases' THEN 'en' ELSE 'pt-br' END AS lang, file, split_part(file, '.', 1) AS stem, CASE WHEN json_valid(text) THEN json_extract_string(text, '$.case_id') END AS case_id,
        CASE WHEN NOT json_valid(text) THEN 'json' END AS error, sha256(text) AS value_sha256 FROM files WHERE folder <> 'ckf/cases')"""


def case_files() -> str:
    """HP18, by the names and texts that were written."""
    return f"{_cases()} SELECT * FROM found"


def case_index() -> str:
    """HP19: ids from the greatest name that states them."""
    return f"{_cases()} SELECT lang, case_id, max(file) AS file FROM found WHERE case_id IS NOT NULL GROUP BY lang, case_id"


def case_parity() -> str:
    """HP25, BM13: differences of sets, both ways."""
    own = "SELECT coalesce(case_id, stem) AS key FROM found WHERE lang = '{}'"
    names = "SELECT replace(file, '{1}', '') AS key FROM files WHERE folder = '{0}'"
    en, pt, case, pack = own.format("en"), own.format("pt-br"), names.format("cases", ".json"), names.format("ckf/cases", ".ckf.json")
    return _cases() + " " + " UNION ALL ".join(f"SELECT key, '{p}' AS problem FROM (({a}) EXCEPT ({b})) x" for a, b, p in ((en, pt, "missing_translation"), (pt, en, "extra_translation"), (case, pack, "missing_package"), (pack, case, "extra_package")))


def ngram_languages() -> str:
    """Ranks counted over unnested trigrams, profiles of the rows that are not held out."""
    s = "' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}]+', ' ', 'g')) || ' '"
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, lang, length(coalesce(text, '')) >= 30 AS enough, {s} AS s, doc_id % 4 = 2 AS held FROM documents),
    g AS MATERIALIZED (SELECT doc_id, lang, held, gram, count(*) AS n FROM (SELECT doc_id, lang, held, substr(s, unnest(generate_series(1, length(s) - 2)), 3) AS gram FROM d WHERE length(s) > 2) x GROUP BY ALL),
    p AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, gram) AS place FROM g WHERE NOT held AND lang IS NOT NULL GROUP BY lang, gram QUALIFY place <= 300),
    r AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) AS rank FROM g QUALIFY rank <= 300),
    f AS (SELECT r.doc_id, l.lang, count(*) * 300 AS most, sum(coalesce(least(abs(rank - place), 300), 300)) AS far FROM r CROSS JOIN (SELECT DISTINCT lang FROM p) l LEFT JOIN p ON p.lang = l.lang AND p.gram = r.gram GROUP BY r.doc_id, l.lang),
    b AS (SELECT doc_id, any_value(most) AS most, list(lang ORDER BY far, lang)[1] AS lang, list(far ORDER BY far, lang) AS fars FROM f GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN d.enough AND most > 0 AND fars[1] < most AND fars[2] - fars[1] >= 0.004 * most THEN b.lang ELSE 'und' END AS found, round(coalesce(1 - fars[1] / most, 0), 6) AS score FROM d LEFT JOIN b USING (doc_id)"""


#: Columns of the inspection report as its query shows them, over report()'s structs.
REPORT = {
    "title": "cover.title", "domain": "cover.domain", "human_readability": "cover.human_readability", "total": "inventory.total", "empty_sections": "array_join(inventory.empty, ',')",
    "types": "array_join(transform(inventory.types, t -> t.type || '=' || t.n), ',')", "buckets": "array_join(quality.buckets, ',')", "mean": "bround(quality.mean, 9)", "traced": "traceability.traced", "pct": "bround(traceability.pct, 9)",
    "worst": "array_join(transform(traceability.worst, w -> w.section || '=' || w.traced || '/' || w.total), ',')", "orphans": "array_join(transform(traceability.orphans, o -> o.section || ':' || o.id || ':' || coalesce(o.title, '')), ',')", "n_orphans": "traceability.n_orphans",
    "excerpts": "source_coverage.total", "located": "source_coverage.located", "failures": "array_join(transform(source_coverage.failures, f -> f.section || ':' || f.id || ':' || f.excerpt), ',')", "source_bytes": "compression.source_bytes", "package_tokens": "compression.package_tokens",
    "decision_rules": "rules.decision_rules", "samples": "array_join(transform(rules.decision_rules_samples, r -> r.id || ':' || r.first), chr(10))", "missing_context": "array_join(limits.missing_context, ',')",
}


def inspected() -> str:
    """The report worked out from the package's JSON item by item."""
    traced = ", ".join(repr(s) for s in FE.LISTS if s != "source_traceability")
    order = "list_position([" + ", ".join(D.lit(s) for s in FE.LISTS) + "], section)"
    b = ", ".join(f"count(*) FILTER (WHERE conf >= {x} AND conf < {y} AND section <> 'source_traceability')" for x, y in ((0, 0.5), (0.5, 0.7), (0.7, 0.85), (0.85, 1.0001)))
    return f"""WITH sections AS MATERIALIZED ({package_filled()}), item AS MATERIALIZED (SELECT doc_id, section, {order} AS o, unnest(range(json_array_length(value)::BIGINT)) AS n, unnest(cast(json_extract(value, '$[*]') AS json[])) AS i FROM sections WHERE value LIKE '[%'),
    f AS MATERIALIZED (SELECT *, i->>'id' AS id, cast(i->>'confidence' AS double) AS conf, coalesce(json_array_length(i, '$.source_excerpts'), 0) > 0 OR coalesce(json_array_length(i, '$.source_refs'), 0) > 0 AS has, section IN ({traced}) AS t FROM item),
    src AS MATERIALIZED (SELECT * FROM {R.package_sources(D)} s),
    q AS (SELECT f.doc_id, o, n, k, section, coalesce(id, '—') AS id, e FROM (SELECT *, unnest(range(json_array_length(i, '$.source_excerpts')::BIGINT)) AS k, unnest(cast(i->'source_excerpts' AS varchar[])) AS e FROM f WHERE t) f WHERE trim(e) <> ''),
    fo AS (SELECT q.*, contains(lower(regexp_replace(source, '\\s+', ' ', 'g')), lower(regexp_replace(e, '\\s+', ' ', 'g'))) OR contains(lower(source), lower(e)) AS ok FROM q JOIN src USING (doc_id)),
    lost AS (SELECT doc_id, array_to_string(list(section || ':' || id || ':' || e ORDER BY o, n, k)[1:10], ',') AS failures FROM fo WHERE NOT ok GROUP BY doc_id),
    cov AS (SELECT doc_id, count(*) AS excerpts, count(*) FILTER (WHERE ok) AS located FROM fo GROUP BY doc_id),
    sec AS (SELECT doc_id, section, {order} AS o, json_array_length(value)::BIGINT AS n FROM sections WHERE value LIKE '[%'),
    hs AS (SELECT doc_id, section, count(*) FILTER (WHERE has) AS k FROM f GROUP BY doc_id, section),
    inv AS (SELECT doc_id, sum(n)::BIGINT AS total, coalesce(string_agg(section, ',' ORDER BY o) FILTER (WHERE n = 0), '') AS empty_sections FROM sec GROUP BY doc_id),
    wst AS (SELECT doc_id, array_to_string(list(section || '=' || k || '/' || n ORDER BY k::DOUBLE / n, o)[1:5], ',') AS worst FROM sec JOIN hs USING (doc_id, section) WHERE section <> 'source_traceability' GROUP BY doc_id),
    ty AS (SELECT doc_id, string_agg(x || '=' || c, ',' ORDER BY x) AS types FROM (SELECT doc_id, coalesce(nullif(i->>'type', ''), 'unknown') AS x, count(*) AS c FROM f WHERE section = 'atomic_units' GROUP BY ALL) y GROUP BY doc_id),
    ag AS (SELECT doc_id, array_to_string([{b}], ',') AS buckets, round_even(avg(conf) FILTER (WHERE t), 9) AS mean, count(*) FILTER (WHERE has AND t) AS traced, round_even(count(*) FILTER (WHERE has AND t) / count(*) FILTER (WHERE t), 9) AS pct, count(*) FILTER (WHERE t AND NOT has AND id IS NOT NULL) AS n_orphans,
        array_to_string(coalesce(list(section || ':' || id || ':' || coalesce(nullif(i->>'name', ''), nullif(i->>'label', ''), nullif(substr(i->>'statement', 1, 80), ''), '') ORDER BY o, n) FILTER (WHERE t AND NOT has AND id IS NOT NULL), [])[1:25], ',') AS orphans, count(*) FILTER (WHERE section = 'decision_rules') AS decision_rules,
        array_to_string(coalesce(list(id || ':' || (i->>'condition') ORDER BY n) FILTER (WHERE section = 'decision_rules'), [])[1:5], chr(10)) AS samples FROM f GROUP BY doc_id),
    me AS (SELECT doc_id, max(value) FILTER (WHERE section = 'metadata') AS m, max(value) FILTER (WHERE section = 'knowledge_limits') AS kl FROM sections GROUP BY doc_id)
    SELECT inv.doc_id, m->>'source_title' AS title, m->>'domain' AS domain, cast(m->>'human_readability' AS double) AS human_readability, total, empty_sections, coalesce(types, '') AS types, coalesce(buckets, '0,0,0,0') AS buckets, mean, coalesce(traced, 0) AS traced, coalesce(pct, 0) AS pct, coalesce(worst, '') AS worst, coalesce(orphans, '') AS orphans,
        coalesce(n_orphans, 0) AS n_orphans, coalesce(excerpts, 0) AS excerpts, coalesce(located, 0) AS located, coalesce(failures, '') AS failures, CASE WHEN length(source) > 0 AND length(packed) > 0 THEN strlen(source) END AS source_bytes, CASE WHEN length(source) > 0 AND length(packed) > 0 THEN floor(length(packed) / 4 + 0.5)::BIGINT END AS package_tokens,
        coalesce(decision_rules, 0) AS decision_rules, coalesce(samples, '') AS samples, coalesce(array_to_string(cast(kl->'missing_context' AS varchar[]), ','), '') AS missing_context
    FROM inv LEFT JOIN ty USING (doc_id) LEFT JOIN ag USING (doc_id) LEFT JOIN wst USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id) LEFT JOIN me USING (doc_id) LEFT JOIN src USING (doc_id)"""


def package_verdicts() -> str:
    """Fields by role from the JSON, the first failing text of an item, and near copies among what is kept."""
    from loomstone.operators import promote as PM
    from loomstone.operators import sanitize as SA

    roles = D.rows(["section", "no", "field", "role"], [[D.lit(s), str(i), D.lit(f), D.lit(r)] for i, (s, f, r) in enumerate(P.FIELD_ROLES)])
    keys = "CASE section " + " ".join(f"WHEN '{s}' THEN concat_ws(' ', {', '.join(f"i->>'{f}'" for f in fs)})" for s, fs in SA.COPY_FIELDS.items()) + " END"
    b, c = "coalesce(i->>'compressed_knowledge', '')", "coalesce(i->>'standalone_context', '')"
    title = PM.repaired_title(D, "coalesce(i->>'title', '')", b)
    key = f"CASE WHEN fine THEN {title} || ' ' || {b} ELSE {keys} END"
    return f"""WITH rows0 AS MATERIALIZED (SELECT * FROM {R.partial_sections(D)} p), lang AS (SELECT doc_id AS id, value->>'language' AS lang FROM rows0 WHERE section = 'metadata'),
    item AS MATERIALIZED (SELECT doc_id, section, n, i, lang, section = 'retrieval_chunks' AND json_array_length(i, '$.source_refs') > 0 AND json_array_length(i, '$.source_excerpts') > 0 AND {PM.valid_chunk(D, b, c)} AS fine
        FROM (SELECT doc_id, section, unnest(range(json_array_length(value)::BIGINT)) AS n, unnest(cast(json_extract(value, '$[*]') AS json[])) AS i FROM rows0 WHERE section IN ({', '.join(repr(s) for s in SA.SECTIONS)})) x LEFT JOIN lang ON id = doc_id),
    field AS (SELECT doc_id, item.section, n, lang, no, field, role, json_extract(i, '$.' || field) AS x FROM item JOIN {roles} r USING (section) WHERE NOT fine),
    txt AS (SELECT f.doc_id, f.section, f.n, f.lang, f.no, f.field, f.role, t.id AS pos, t.atom->>'$' AS t FROM field f, json_tree(f.x) t WHERE t.type = 'VARCHAR'),
    bad AS MATERIALIZED (SELECT * FROM (SELECT *, {T.reject_reason(D, 't', 'role', 'lang')} AS reason FROM txt) y WHERE reason IS NOT NULL),
    one AS (SELECT doc_id, section, n, arg_min({{'reason': reason, 'field': field, 'preview': substr({T.squeeze(D, 't')}, 1, 120)}}, no * 1000 + pos) AS v FROM bad GROUP BY doc_id, section, n),
    judged AS MATERIALIZED (SELECT item.*, v.reason AS reason, v.field AS field, v.preview AS preview, {T.squeeze(D, key)} AS k FROM item LEFT JOIN one USING (doc_id, section, n)),
    near AS (SELECT * FROM {DD.kept_apart(D, f"(SELECT doc_id, section, n, k AS x FROM judged WHERE reason IS NULL AND section IN ({', '.join(repr(s) for s in SA.COPY_FIELDS)})) w", 'doc_id, section', 'n', 'x', 'x')} k0)
    SELECT j.doc_id, j.section, j.n::INT AS n, CASE WHEN fine THEN {title} END AS title, CASE WHEN near THEN 'duplicate' WHEN reason IS NULL THEN 'kept' ELSE 'removed' END AS status, CASE WHEN near THEN 'near_duplicate' ELSE reason END AS reason, CASE WHEN near THEN NULL ELSE field END AS field, CASE WHEN near THEN substr(k, 1, 120) ELSE preview END AS preview
    FROM judged j LEFT JOIN near ON j.doc_id = near.doc_id AND j.section = near.section AND j.n = near.ord"""


def literal_search(literals: list[str]) -> str:
    """Every text compared with every literal."""
    from loomstone.operators.search import SEARCHED

    text = f"lower(CASE WHEN section IN ({', '.join(repr(s) for s in SEARCHED)}) THEN coalesce(a, '') ELSE concat_ws(' ', a, b) END)"
    return f"SELECT literal, pkg, section, ord FROM (SELECT pkg, section, ord, {text} AS x FROM {R.partials(D)} p) i JOIN {D.rows(['literal'], [[D.lit(s)] for s in literals])} l ON contains(x, lower(literal))"


# ---- headings and the parts between them, each line's expressions spelt out ----
def heading(d: Dialect, x: str) -> tuple[str, str]:
    """CH2: (depth, title) of a line as a heading: depth null if it is none, 7 for a rule."""
    t = T.trim(d, x)
    bare = T.trim(d, d.sub(t, r"[^\p{L}\p{N}\s]"))
    letters = f"length({d.sub(bare, r'[^\p{L}]')})"
    open_end = f"NOT {d.has(t, r'[.!?]\z')}"
    dots = f"length({t}) - length(replace({t}, '.', ''))"
    md = r"^(#{1,6})\s+(.+?)\s*\z"
    depth = (
        f"CASE WHEN {t} = '' THEN NULL WHEN {d.has(t, md)} THEN length({d.first(t, md, 1)})"
        f" WHEN {d.has(t, r'(?i)^(cap[íi]tulo|chapter|cap\.)\s+\d+([\s:.\-—–].*)?\z')} THEN 2"
        f" WHEN {d.has(t, r'(?i)^(parte|part)\s+[ivxlcdm0-9]+([\s:.\-—–].*)?\z')} THEN 1"
        f" WHEN {d.has(t, r'^\d+(\.\d+){0,3}\.?\s+\S.{2,80}\z')} AND {open_end} THEN least(6, 3 + {dots})"
        f" WHEN {d.has(t, r'^[_\-=]{3,}\z')} THEN 7"
        f" WHEN {letters} BETWEEN 6 AND 80 AND {d.size(d.split(bare, r'\s+'))} >= 2 AND {bare} = upper({bare}) AND {open_end} THEN 2 END"
    )
    title = f"CASE WHEN {d.has(t, md)} THEN {T.trim(d, d.first(t, md, 2))} ELSE {t} END"
    return depth, title


def headings(d: Dialect, rel: str, key: str, x: str = "text") -> str:
    """CH2 over all lines: those that are headings or rules."""
    depth, title = heading(d, "line")
    return f"SELECT * FROM (SELECT {key}, line_no, cast({depth} AS int) AS depth, {title} AS title FROM {SG.lines(d, rel, key, x)} a) b WHERE depth IS NOT NULL"


def headed_sections(d: Dialect, rel: str, key: str, x: str = "text") -> str:
    """CH3: (key, sec, path, heading, text) of each part between headings, the heading's line kept; a rule ends a part and leaves
    the path as it is. The path has, for each depth above the heading's own, the latest heading of it that no shallower one has
    ended, or a filler."""
    flat = T.trim(d, d.sub(d.sub(d.sub(x, "\r\n", "\n"), "\u00a0", " "), r"\n{4,}", "\n\n\n"))
    depth, title = heading(d, "line")
    marked = f"(SELECT {key}, line_no, line, cast({depth} AS int) AS depth, {title} AS title FROM {SG.lines(d, f'(SELECT {key}, {flat} AS text FROM {rel}) n0', key)} n1)"
    own = "CASE WHEN depth < 7 THEN least(depth, 6) END"
    run = f"(SELECT *, count(depth) OVER (PARTITION BY {key} ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS sec, {SG._ancestors(d, 'own', 'title', key, 'line_no')} FROM (SELECT *, {own} AS own FROM {marked} n2) n3)"
    # The latest heading is the same on all lines of a section: its own, or after a rule the one before it.
    joined = d.join(d.gather("CASE WHEN depth = 7 THEN '' ELSE line END", "line_no"), SG.MARK)
    secs = f"""(SELECT {key}, sec, max(path) AS path, max(heading) AS heading, {T.trim(d, f"replace({joined}, chr(30), chr(10))")} AS text
        FROM (SELECT {key}, sec, line_no, line, depth, {SG._crumbs()} AS path, last.title AS heading FROM {run} n4) n5 GROUP BY {key}, sec)"""
    return f"SELECT {key}, sec, path, heading, text FROM {secs} s WHERE text <> ''"


def chunks(d: Dialect, rel: str, key: str, most: int, x: str = "text") -> str:
    """CH1 over CH3: each part between headings, packed by paragraphs where it is longer than `most`; parts of one section are numbered in their path."""
    secs = f"({headed_sections(d, rel, key, x)})"
    packed = SG.pack(d, f"{secs} h9", f"{key}, sec", "text", most)
    return f"""SELECT {key}, {SG.span_id(d, f'row_number() OVER (PARTITION BY {key} ORDER BY sec, n)')} AS span_id, CASE WHEN many > 1 THEN path || ' · part ' || {d.text('n')} ELSE path END AS path, heading, chars, text_sha256
    FROM (SELECT p.{key}, p.sec, p.n, p.chars, p.text_sha256, s.path, s.heading, count(*) OVER (PARTITION BY p.{key}, p.sec) AS many FROM ({packed}) p JOIN {secs} s ON p.{key} = s.{key} AND p.sec = s.sec) q"""


def scored(d: Dialect) -> str:
    """How much of the gold each response has, worked out at each mention."""
    return f"SELECT task_key, {d.half_even(BM.overlap(d, 'response', 'gold'), 6)} AS overlap, CASE WHEN {BM.overlap(d, 'response', 'gold')} >= 0.4 THEN 'probe_pass' ELSE 'probe_fail' END AS probe FROM {R.results(d)} r"
