"""Readable Markdown packages: numbered sections to typed rows, whole packages at a time.

Lines are tagged with their section by running counts, so a package is never folded; a section that occurs twice counts in its
last form. All rows have the document's key, their section and their place n in it, and the fields of a trace tag.
"""

from __future__ import annotations

from loomstone.functions import text as T
from loomstone.functions.dialect import Dialect
from loomstone.operators.segment import lines

# ---- fixed values: section titles, and the forms of one bullet by section ----
SECTION_TITLES = {
    "core intent": "core_intent",
    "domain map": "domain_map",
    "entities": "entities",
    "entity graph": "entities",
    "concepts": "concepts",
    "concept graph": "concepts",
    "principles": "principles",
    "heuristics": "heuristics",
    "decision rules": "decision_rules",
    "procedures": "procedures",
    "patterns": "patterns",
    "anti-patterns": "anti_patterns",
    "antipatterns": "anti_patterns",
    "causal chains": "causal_chains",
    "contextual triggers": "contextual_triggers",
    "if-then rules": "if_then_rules",
    "if then rules": "if_then_rules",
    "exceptions": "exceptions",
    "exceptions and edge cases": "exceptions",
    "mental models": "mental_models",
    "operational playbooks": "playbooks",
    "playbooks": "playbooks",
    "q&a pairs": "qa_pairs",
    "qa pairs": "qa_pairs",
    "question-answer pairs for agents": "qa_pairs",
    "retrieval chunks": "retrieval_chunks",
    "atomic units": "atomic_units",
    "embedding-ready atomic units": "atomic_units",
    "agent instructions": "agent_instructions",
    "knowledge limits": "knowledge_limits",
    "source traceability": "source_traceability",
}
BASES = ["explicit", "inferred", "synthesized", "author_opinion", "uncertain"]
#: Section: what may end a bullet (the third field), the form of the rest (first and second field).
TAILS = {
    "decision_rules": r"_\(([^)]+)\)_\s*\z",
    "if_then_rules": r"_\(([^)]+)\)_\s*\z",
    "anti_patterns": r"(?i)_\(fails because\s+([^)]+)\)_\s*\z",
    "causal_chains": r"\(([^)]+)\)\s*\z",
}
FORMS = {
    "heuristics": r"(?i)^\*\*When\*\*\s+(.+?)\s+->\s+\*\*do\*\*\s+(.+?)(?:\s*\|\s*_avoid:_\s*(.+))?\z",
    "decision_rules": r"(?i)^IF\s+(.+?)\s+THEN\s+(.+)\z",
    "patterns": r"^\*\*(.+?)\*\*\s*[—-]\s*(.*)\z",
    "anti_patterns": r"^\*\*(.+?)\*\*\s*-\s*(.+)\z",
    "causal_chains": r"^(.+?)\s*->\s*(.+)\z",
    "contextual_triggers": r"(?i)_When_\s+`([^`]+)`\s*->\s*(.*)\z",
    "if_then_rules": r"(?i)^IF\s+(.+?)\s+THEN\s+(.+)\z",
    "exceptions": r"(?i)_Rule:_\s+(.+?)\s*\|\s*_Exception:_\s+(.+)\z",
    "mental_models": r"^\*\*(.+?)\*\*\s*-\s*(.+)\z",
    "qa_pairs": r"(?s)^\*\*Q:\*\*\s*(.+?)\s*\n\s*\*\*A:\*\*\s*(.+)\z",
    "atomic_units": r"_\[([^\]]+)\]_\s*(.+)\z",
}
QA_ONE_LINE = r"(?s)^\*\*Q:\*\*\s*(.+?)\s*\*\*A:\*\*\s*(.+)\z"
BULLET_SECTIONS = ["principles", "heuristics", "decision_rules", "patterns", "anti_patterns", "causal_chains", "contextual_triggers", "if_then_rules", "exceptions", "mental_models", "qa_pairs", "atomic_units"]
HEADED_SECTIONS = ["entities", "concepts", "procedures", "playbooks", "retrieval_chunks"]
GROUPS = {
    "agent_instructions": ["behavior_rules", "reasoning_rules", "response_rules", "forbidden_behaviors", "preferred_questions", "tool_usage_guidance"],
    "knowledge_limits": ["missing_context", "weakly_supported_claims", "assumptions_detected", "possible_biases", "outdated_sections", "needs_human_review"],
}
HEADING = r"^##\s+\d+\.\s+(.+?)\s*\z"
ITEM_ID = r"(?i)^[a-z]+_\d+\z"
REFS = r"(?i)^[a-z]+_\d+(?:\s*,\s*[a-z]+_\d+)*\z"


def section_key(d: Dialect, title: str) -> str:
    """IO15: a section title's key, null if it is none."""
    t = f"lower({T.trim(d, d.sub(title, r'\(\s*\d+\s*\)\s*\z'))})"
    return d.let(t, lambda v: "CASE " + v + " " + " ".join(f"WHEN {d.lit(k)} THEN '{s}'" for k, s in SECTION_TITLES.items()) + " END", "title_v")


def body_lines(d: Dialect, rel: str, key: str, x: str = "text") -> str:
    """IO13: (key, section, line_no, line) of all lines in known sections, headings left out; of equal sections the last."""
    heads = f"(SELECT *, {d.has('line', HEADING)} AS head, CASE WHEN {d.has('line', HEADING)} THEN {section_key(d, d.first('line', HEADING, 1))} END AS sk FROM {lines(d, rel, key, x)} l1)"
    run = f"(SELECT *, count(CASE WHEN head THEN 1 END) OVER (PARTITION BY {key} ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS sec FROM {heads} l2)"
    named = f"(SELECT {key}, line_no, line, head, sec, max(sk) OVER (PARTITION BY {key}, sec) AS section FROM {run} l3)"
    last = f"(SELECT *, max(sec) OVER (PARTITION BY {key}, section) AS last_sec FROM {named} l4 WHERE section IS NOT NULL)"
    return f"(SELECT {key}, section, line_no, line FROM {last} l5 WHERE sec = last_sec AND NOT head)"


def among(sections: list[str]) -> str:
    return "section IN (" + ", ".join(f"'{s}'" for s in sections) + ")"


def bullets(d: Dialect, body: str, key: str) -> str:
    """IO16: (key, section, n, raw): bullets with their indented lines, line ends kept; a blank line ends one, other lines are skipped."""
    kind = f"CASE WHEN {d.has('line', r'^\s*-\s+')} THEN 'S' WHEN {d.has('line', r'^\s{2,}\S')} THEN 'C' WHEN {T.trim(d, 'line')} = '' THEN 'B' ELSE 'O' END"
    run = f"(SELECT *, count(CASE WHEN kind IN ('S', 'B') THEN 1 END) OVER (PARTITION BY {key}, section ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS grp FROM (SELECT *, {kind} AS kind FROM {body} b0) b1)"
    one = f"CASE WHEN kind = 'S' THEN {d.sub('line', r'^\s*-\s+')} ELSE {T.trim(d, 'line')} END"
    return f"""(SELECT {key}, section, row_number() OVER (PARTITION BY {key}, section ORDER BY grp) AS n, raw FROM (
        SELECT {key}, section, grp, {d.join(d.gather(one, 'line_no'), chr(10))} AS raw FROM {run} b2 WHERE kind IN ('S', 'C') GROUP BY {key}, section, grp HAVING max(CASE WHEN kind = 'S' THEN 1 ELSE 0 END) = 1) b3)"""


def subsections(d: Dialect, body: str, key: str) -> str:
    """IO17: (key, section, n, raw, body): what stands under each ### heading of a section; raw is the heading."""
    head = r"^###\s+(.+?)\s*\z"
    run = f"(SELECT *, count(CASE WHEN {d.has('line', head)} THEN 1 END) OVER (PARTITION BY {key}, section ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS n FROM {body} s0)"
    rest = f"CASE WHEN {d.has('line', head)} THEN '' ELSE line END"
    return f"(SELECT {key}, section, n, max(CASE WHEN {d.has('line', head)} THEN {d.first('line', head, 1)} END) AS raw, {T.trim(d, d.join(d.gather(rest, 'line_no'), chr(10)))} AS body FROM {run} s1 WHERE n > 0 GROUP BY {key}, section, n)"


def traced(d: Dialect, rel: str, key: str, more: str = "") -> str:
    """IO14, RP5, RP24: rel's raw without its last trace tag as `bare`, and the tag's item_id, basis, confidence and refs.

    A tag holds a bar or is an id. Of its parts, cut at bars, the first id is the item's, the last number after c= the
    confidence, the first basis the basis, and whatever else lists ids the refs."""
    tag = r"_\[([^\]]+)\]_\s*\z"
    cut = f"(SELECT *, {T.trim(d, d.first('ended', tag, 1))} AS inner_tag FROM (SELECT *, {d.sub('raw', r'\s+\z')} AS ended FROM {rel} t0) t1)"
    is_tag = f"(contains(inner_tag, '|') OR {d.has('inner_tag', ITEM_ID)})"
    parts = d.keep(d.each(d.split("inner_tag", r"\|"), lambda v: T.trim(d, v), "p"), lambda v: f"{v} <> ''", "p")
    staged = f"(SELECT *, {is_tag} AS tagged, CASE WHEN {is_tag} THEN {parts} ELSE {d.empty()} END AS parts FROM {cut} t2)"
    first = d.at(d.keep("parts", lambda v: d.has(v, ITEM_ID), "p"), 1)
    number = r"(?i)^c\s*=\s*(\d+(?:\.\d+)?|\.\d+)\z"
    named = "(" + " OR ".join(f"lower({{v}}) = '{b}'" for b in BASES) + ")"
    basis = d.at(d.keep("parts", lambda v: named.replace("{v}", v), "p"), 1)
    conf = d.keep("parts", lambda v: d.has(v, number), "p")
    ids = f"(SELECT *, {first} AS item_id, lower({basis}) AS basis, {conf} AS confs FROM {staged} t3)"
    at = d.position("parts", "item_id")
    refs = d.each(d.flat(d.each(d.keep_at("parts", lambda v, i: f"{d.has(v, REFS)} AND {i} <> coalesce({at}, 0)", "p", "i"), lambda v: d.split(v, ","), "p")), lambda v: T.trim(d, v), "p")
    confidence = f"CASE WHEN {d.size('confs')} > 0 THEN cast({d.first(d.at('confs', d.size('confs')), number, 1)} AS double) END"
    bare = f"CASE WHEN tagged THEN {d.sub(d.sub('ended', tag), r'\s+\z')} ELSE ended END"
    return f"(SELECT {key}, section, n, {more} item_id, basis, {confidence} AS confidence, {d.join(refs, ',')} AS refs, {T.trim(d, bare)} AS bare FROM {ids} t4)"


def bullet_rows(d: Dialect, rel: str, key: str, x: str = "text") -> str:
    """RP6-RP8, RP10-RP16, RP18, RP20: every bullet of every bullet section with its fields f1 to f3 by the section's form.

    What does not fit a form keeps its whole text as the first field; an atomic unit without a type is a fact."""
    body = f"(SELECT * FROM {body_lines(d, rel, key, x)} r0 WHERE {among(BULLET_SECTIONS)})"
    rows = traced(d, bullets(d, body, key), key)
    by = lambda f, default, names: "CASE section " + " ".join(f"WHEN '{s}' THEN {f(s)}" for s in names) + f" ELSE {default} END"
    tail = by(lambda s: d.first("bare", TAILS[s], 1), "''", TAILS)
    core = by(lambda s: T.trim(d, d.sub("bare", TAILS[s])), "bare", TAILS)
    cored = f"(SELECT *, {T.trim(d, tail)} AS tail, {core} AS core FROM {rows} r1)"
    fits = f"(SELECT *, {by(lambda s: d.has('core', FORMS[s]), 'false', FORMS)} AS fits, section = 'qa_pairs' AND {d.has('core', QA_ONE_LINE)} AS one_line FROM {cored} r2)"

    def field(i):
        group = lambda s: d.first("core", FORMS[s], i)
        return T.trim(d, by(group, "''", FORMS))

    else1 = "CASE section WHEN 'anti_patterns' THEN bare WHEN 'atomic_units' THEN 'fact' ELSE core END"
    third = T.trim(d, d.first("core", FORMS["heuristics"], 3))
    return f"""SELECT {key}, section, n, item_id, basis, confidence, refs,
        CASE WHEN fits THEN {field(1)} WHEN one_line THEN {T.trim(d, d.first('core', QA_ONE_LINE, 1))} ELSE {else1} END AS f1,
        CASE WHEN fits THEN {field(2)} WHEN one_line THEN {T.trim(d, d.first('core', QA_ONE_LINE, 2))} WHEN section = 'atomic_units' THEN bare ELSE '' END AS f2,
        CASE WHEN section = 'heuristics' AND fits THEN {third} ELSE tail END AS f3 FROM {fits} r3"""


def headed_rows(d: Dialect, rel: str, key: str, x: str = "text") -> str:
    """RP3, RP4, RP9, RP17, RP19: entities (name, type, description; aliases, relations), concepts and chunks (label, text),
    procedures and playbooks (name, objective; steps). Lists are joined by line ends."""
    body = f"(SELECT * FROM {body_lines(d, rel, key, x)} h0 WHERE {among(HEADED_SECTIONS)})"
    rows = traced(d, subsections(d, body, key), key, "body,")
    full = d.keep(d.each(d.split("body", r"\r?\n"), lambda v: T.trim(d, v), "l"), lambda v: f"{v} <> ''", "l")
    staged = f"(SELECT *, {full} AS ls FROM {rows} h1)"
    typed = r"^(.+?)\s*_\((.+?)\)_\s*\z"
    alias, rel_line, step, aim = r"(?i)_Aliases:_\s*(.+)\z", r"(?i)_Relations:_\s*(.+)\z", r"^\d+\.\s+(.+)\z", r"(?i)_Objective:_\s*(.+)\z"
    piece = r"^\s*(.+?)\s*->\s*\*\*(.+?)\*\*\s*\z"
    csv = lambda p, but=None: d.flat(d.each(d.keep("ls", lambda v: d.has(v, p) + (f" AND NOT {d.has(v, but)}" if but else ""), "l"), lambda v: d.split(d.first(v, p, 1), ","), "l"))
    aliases = d.keep(d.each(csv(alias), lambda v: T.trim(d, v), "a"), lambda v: f"{v} <> ''", "a")
    relations = d.each(d.keep(csv(rel_line, alias), lambda v: d.has(v, piece), "q"), lambda v: f"{T.trim(d, d.first(v, piece, 1))} || ' -> ' || {T.trim(d, d.first(v, piece, 2))}", "q")
    said = d.join(d.keep("ls", lambda v: f"NOT {d.has(v, alias)} AND NOT {d.has(v, rel_line)}", "l"), " ")
    steps = d.each(d.keep("ls", lambda v: f"{d.has(v, step)} AND NOT {d.has(v, aim)}", "l"), lambda v: T.trim(d, d.first(v, step, 1)), "l")
    aims = d.keep("ls", lambda v: d.has(v, aim), "l")
    objective = f"CASE WHEN {d.size(aims)} > 0 THEN {T.trim(d, d.first(d.at(aims, d.size(aims)), aim, 1))} ELSE '' END"
    entity, steps_of = "section = 'entities'", "section IN ('procedures', 'playbooks')"
    return f"""SELECT {key}, section, n, item_id, basis, confidence, refs,
        CASE WHEN {entity} AND {d.has('bare', typed)} THEN {T.trim(d, d.first('bare', typed, 1))} ELSE bare END AS f1,
        CASE WHEN {entity} THEN CASE WHEN {d.has('bare', typed)} THEN {T.trim(d, d.first('bare', typed, 2))} ELSE '' END WHEN {steps_of} THEN {objective} ELSE body END AS f2,
        CASE WHEN {entity} THEN {said} ELSE '' END AS f3,
        CASE WHEN {entity} THEN {d.join(aliases, chr(10))} WHEN {steps_of} THEN {d.join(steps, chr(10))} ELSE '' END AS list1,
        CASE WHEN {entity} THEN {d.join(relations, chr(10))} ELSE '' END AS list2 FROM {staged} h2"""


def whole_section(d: Dialect, rel: str, key: str, section: str, x: str = "text") -> str:
    body = f"(SELECT * FROM {body_lines(d, rel, key, x)} w0 WHERE section = '{section}')"
    return f"(SELECT {key}, {T.trim(d, d.join(d.gather('line', 'line_no'), chr(10)))} AS body FROM {body} w1 GROUP BY {key})"


def core_intent(d: Dialect, rel: str, key: str, x: str = "text") -> str:
    """RP1: four labelled texts, null where absent, and the bullets after the label of intended agent use."""
    labels = {"primary_purpose": "Primary purpose", "intended_user": "Intended user", "transformation_goal": "Transformation goal", "key_value": "Key value"}
    one = lambda name: f"CASE WHEN {d.has('body', p := rf'(?i)\*\*{name}:\*\*\s*(.+)')} THEN {T.trim(d, d.first('body', p, 1))} END"
    rest = d.split(d.first("body", r"(?is)\*\*Intended agent use:\*\*[^\n]*(\n.*)\z", 1), r"\r?\n")
    uses = d.each(d.keep(rest, lambda v: d.has(v, r"^\s*-\s+(.+)"), "u"), lambda v: T.trim(d, d.first(v, r"^\s*-\s+(.+)", 1)), "u")
    return f"SELECT {key}, {', '.join(f'{one(v)} AS {k}' for k, v in labels.items())}, {d.join(uses, chr(10))} AS intended_agent_use FROM {whole_section(d, rel, key, 'core_intent', x)} c0"


def domain_map(d: Dialect, rel: str, key: str, x: str = "text") -> str:
    """RP2: main domain and three lists; HP9: a list alone has no main domain."""
    csv = lambda name: d.join(d.keep(d.each(d.split(d.first("body", rf"(?i)\*\*{name}:\*\*\s*(.+)", 1), ","), lambda v: T.trim(d, v), "m"), lambda v: f"{v} <> ''", "m"), chr(10))
    main = r"(?i)\*\*Main domain:\*\*\s*(.+)"
    return f"SELECT {key}, CASE WHEN {d.has('body', main)} THEN {T.trim(d, d.first('body', main, 1))} END AS main_domain, {csv('Subdomains')} AS subdomains, {csv('Adjacent')} AS adjacent_domains, {csv('Excluded')} AS excluded_domains FROM {whole_section(d, rel, key, 'domain_map', x)} m0"


def grouped_blocks(d: Dialect, rel: str, key: str, x: str = "text") -> str:
    """IO19: the bullets under each **label** line of the grouped sections; a label that comes again counts in its last form."""
    body = f"(SELECT * FROM {body_lines(d, rel, key, x)} g0 WHERE {among(list(GROUPS))})"
    head, item = r"^\*\*(.+?)\*\*\s*\z", r"^\s*-\s+(.+)\z"
    run = f"(SELECT *, count(CASE WHEN {d.has('line', head)} THEN 1 END) OVER (PARTITION BY {key}, section ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS grp FROM {body} g1)"
    name = f"max(CASE WHEN {d.has('line', head)} THEN {d.sub(f'lower({T.trim(d, d.first("line", head, 1))})', r'\s+', '_')} END)"
    got = d.keep(d.gather(f"CASE WHEN {d.has('line', head)} THEN '' WHEN {d.has('line', item)} THEN {T.trim(d, d.first('line', item, 1))} ELSE '' END", "line_no"), lambda v: f"{v} <> ''", "g")
    rows = f"(SELECT {key}, section, grp, {name} AS group_key, {d.join(got, chr(10))} AS items FROM {run} g2 WHERE grp > 0 GROUP BY {key}, section, grp)"
    return f"SELECT {key}, section, group_key, items FROM (SELECT *, max(grp) OVER (PARTITION BY {key}, section, group_key) AS last_grp FROM {rows} g3) g4 WHERE grp = last_grp"


def _labelled_blocks(d: Dialect, rel: str, key: str, x: str) -> str:
    """(key, section, grp, group_key, items) of the grouped sections; what stands before the first label is grp 0."""
    body = f"(SELECT * FROM {body_lines(d, rel, key, x)} g0 WHERE {among(list(GROUPS))})"
    head, item = r"^\*\*(.+?)\*\*\s*\z", r"^\s*-\s+(.+)\z"
    run = f"(SELECT *, count(CASE WHEN {d.has('line', head)} THEN 1 END) OVER (PARTITION BY {key}, section ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS grp FROM {body} g1)"
    name = f"max(CASE WHEN {d.has('line', head)} THEN {d.sub(f'lower({T.trim(d, d.first("line", head, 1))})', r'\s+', '_')} END)"
    got = d.keep(d.gather(f"CASE WHEN {d.has('line', head)} THEN '' WHEN {d.has('line', item)} THEN {T.trim(d, d.first('line', item, 1))} ELSE '' END", "line_no"), lambda v: f"{v} <> ''", "g")
    return f"(SELECT {key}, section, grp, {name} AS group_key, {d.join(got, chr(10))} AS items FROM {run} g2 GROUP BY {key}, section, grp)"


def group_lists(d: Dialect, rel: str, key: str, x: str = "text") -> str:
    """RP21, RP22: the six lists of agent instructions and of knowledge limits, empty where absent; tool_usage is an alias.

    Spark gathers a section's labelled blocks in one row and picks the lists there: lines look small to its planner, which would
    broadcast all of them in a join."""
    if d.name == "spark":
        return _gathered_lists(d, rel, key, x)
    found = f"(SELECT {key}, section, group_key AS own, CASE WHEN group_key = 'tool_usage' THEN 'tool_usage_guidance' ELSE group_key END AS list_name, items FROM ({grouped_blocks(d, rel, key, x)}) k0)"
    first = f"(SELECT *, row_number() OVER (PARTITION BY {key}, section, list_name ORDER BY CASE WHEN own = 'tool_usage' THEN 0 ELSE 1 END) AS nth FROM {found} k1)"
    names = d.rows(["section", "list_name"], [[f"'{s}'", f"'{g}'"] for s, gs in GROUPS.items() for g in gs])
    have = f"(SELECT DISTINCT {key}, section FROM {body_lines(d, rel, key, x)} k2 WHERE {among(list(GROUPS))})"
    return f"SELECT h.{key}, h.section, v.list_name, coalesce(f.items, '') AS items FROM {have} h JOIN {names} v ON h.section = v.section LEFT JOIN (SELECT * FROM {first} k3 WHERE nth = 1) f ON f.{key} = h.{key} AND f.section = v.section AND f.list_name = v.list_name"


def _gathered_lists(d: Dialect, rel: str, key: str, x: str) -> str:
    names = "CASE section " + " ".join(f"WHEN '{s}' THEN {d.words(gs)}" for s, gs in GROUPS.items()) + " END"
    blocks = f"(SELECT {key}, section, collect_list(named_struct('alias', group_key = 'tool_usage', 'grp', grp, 'name', CASE WHEN group_key = 'tool_usage' THEN 'tool_usage_guidance' ELSE group_key END, 'items', items)) AS blocks FROM {_labelled_blocks(d, rel, key, x)} k0 GROUP BY {key}, section)"
    own = d.top(d.keep("blocks", lambda v: f"{v}.grp > 0 AND {v}.name = list_name", "k"))[0]
    return f"SELECT {key}, section, list_name, coalesce({own}.items, '') AS items FROM (SELECT {key}, section, blocks, explode({names}) AS list_name FROM {blocks} k1) k2"


def traceability(d: Dialect, rel: str, key: str, x: str = "text") -> str:
    """RP23: item, location and quoted excerpt of each block; blocks without an excerpt are dropped."""
    body = f"(SELECT * FROM {body_lines(d, rel, key, x)} q0 WHERE section = 'source_traceability')"
    head = r"(?i)^([a-z]+_\d+)\s*[—-]\s*(.+)\z"
    quoted = d.keep(d.split("body", r"\r?\n"), lambda v: d.has(v, r"^\s*>"), "q")
    text = T.trim(d, d.join(d.each(quoted, lambda v: d.sub(v, r"^\s*>\s?"), "q"), chr(10)))
    rows = f"(SELECT {key}, n, CASE WHEN {d.has('raw', head)} THEN {d.first('raw', head, 1)} ELSE {T.trim(d, 'raw')} END AS extracted_item_id, CASE WHEN {d.has('raw', head)} THEN {T.trim(d, d.first('raw', head, 2))} ELSE 'document' END AS source_location, {text} AS source_excerpt FROM {subsections(d, body, key)} q1)"
    return f"SELECT {key}, n, extracted_item_id, source_location, source_excerpt, 'uncertain' AS extraction_type FROM {rows} q2 WHERE extracted_item_id <> '' AND source_excerpt <> ''"


def package_items(d: Dialect, rel: str, key: str, x: str = "text") -> str:
    """IO13, TR4: every item of a package with the excerpt that its traceability gives for its id (the last one), '' without."""
    cols = f"{key}, section, n, item_id, basis, confidence, refs, f1, f2, f3"
    return f"""SELECT i.*, coalesce(t.source_excerpt, '') AS excerpt FROM (SELECT {cols} FROM ({bullet_rows(d, rel, key, x)}) i0 UNION ALL SELECT {cols} FROM ({headed_rows(d, rel, key, x)}) i1) i
    LEFT JOIN (SELECT {key} AS tkey, extracted_item_id, source_excerpt FROM (SELECT *, row_number() OVER (PARTITION BY {key}, extracted_item_id ORDER BY n DESC) AS nth FROM ({traceability(d, rel, key, x)}) t0) t1 WHERE nth = 1) t ON i.{key} = t.tkey AND i.item_id = t.extracted_item_id"""
