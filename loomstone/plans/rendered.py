"""Relations of deterministic texts and items, rendered from the relational tables alike in both engines.

The corpus tables hold prose without headings, amounts or modal claims; these give the rule-based operators something to find.
Every table is used whole.
"""

from __future__ import annotations

from loomstone.functions.dialect import Dialect

NL = "chr(10)"


def sections_md(d: Dialect) -> str:
    """One Markdown document per order."""
    k, c = d.text("o_orderkey"), d.text("o_custkey")
    amount, day = d.money("o_totalprice"), d.day("o_orderdate")
    parts = [
        f"'# Order ' || {k}", "''", f"'The order total is US$ ' || {amount} || ' and it was placed on ' || {day} || '.'",
        f"'If the status is ' || o_orderstatus || ', then the clerk must review order ' || {k} || ' within 30 days.'", "''",
        "'### Deep terms'", f"'Order ' || {k} || ' is not a replacement for a signed contract.'", "''", "'## Steps'", f"'1. Check order ' || {k} || '.'", f"'2. Ship the parcel to customer ' || {c} || '.'", "'3) File the receipt.'", "''",
        "'## Notes'", f"'Priority class means the level ' || o_orderpriority || '.'", "'A discount of 12.5% needs RFC 2119 and Section 4.2 of the manual at 14:30.'",
    ]
    return f"(SELECT o_orderkey AS doc_id, {f' || {NL} || '.join(parts)} AS text FROM orders)"


def faq(d: Dialect) -> str:
    return f"(SELECT p_partkey AS doc_id, 'Q: What is part ' || {d.text('p_partkey')} || '?' || {NL} || 'A: It is a ' || p_name || ' of brand ' || p_brand || '.' || {NL} || 'Q: How much is it?' || {NL} || 'A: It costs $' || {d.money('p_retailprice')} || '.' AS text FROM part)"


def legal(d: Dialect) -> str:
    arts = f" || {NL} || ".join(f"'Art. {i} The supplier ' || s_name || ' shall keep record {i}.'" for i in range(1, 7))
    return f"(SELECT s_suppkey AS doc_id, 'Preamble of the norm.' || {NL} || {arts} AS text FROM supplier)"


def jsonl(d: Dialect) -> str:
    """One JSONL document per user, a record per event; every seventh line is not JSON."""
    line = f"CASE WHEN event_id % 7 = 6 THEN 'not a record' ELSE '{{\"_id\":\"e' || {d.text('event_id')} || '\",\"text\":' || {d.json_quote("'User did ' || event_type || ' worth ' || " + d.money('value'))} || '}}' END"
    return f"(SELECT user_id AS doc_id, {d.join(d.gather(line, 'event_id'), chr(10))} AS text FROM events GROUP BY user_id)"


def json_array(d: Dialect) -> str:
    """One JSON array per brand, an object per part."""
    obj = f"'{{\"id\":\"p' || {d.text('p_partkey')} || '\",\"text\":' || {d.json_quote('p_name')} || '}}'"
    return f"(SELECT p_brand AS doc_id, '[' || {d.join(d.gather(obj, 'p_partkey'), ',')} || ']' AS text FROM part GROUP BY p_brand)"


def transcript(d: Dialect) -> str:
    """One WebVTT transcript per conversation."""
    cue = f"{d.text('turn + 1')} || {NL} || '00:00:0' || {d.text('turn % 10')} || '.000 --> 00:00:09.000' || {NL} || '<v ' || role || '>' || replace(text, {NL}, ' ') || '</v>' || {NL}"
    return f"(SELECT conv_id, 'WEBVTT' || {NL} || {NL} || {d.join(d.gather(cue, 'turn'), chr(10))} AS text FROM conversations GROUP BY conv_id)"


def formats(d: Dialect) -> str:
    """All of the above with plain documents, under one text key."""
    t = lambda rel, tag, key="doc_id": f"SELECT '{tag}' || {d.text(key)} AS doc_id, text FROM {rel} {tag}0"
    return "(" + " UNION ALL ".join([t(sections_md(d), "md"), t(faq(d), "faq"), t(legal(d), "law"), t(jsonl(d), "jl"), t(json_array(d), "ja"), t("documents", "doc")]) + ")"


def items(d: Dialect) -> str:
    """Items of one package per customer: pkg, section, ord, id, title, body, context, confidence, basis, excerpt, refs, n_refs, n_excerpts."""
    k, c = d.text("o_orderkey"), d.text("o_custkey")
    ref = d.fmt("s_%03d", "1 + o_orderkey % 3")
    bodies = [
        f"'If the status is ' || o_orderstatus || ', then the clerk must review order ' || {k} || '.'",
        f"'Order ' || {k} || ' is not a replacement for the contract of customer ' || {c} || '.'",
        f"'Use the standard carrier instead of a courier for order ' || {k} || ' unless the client objects.'",
        f"'The workflow for order ' || {k} || ' starts with review, and then the parcel is shipped to customer ' || {c} || '.'",
        f"'The agent should confirm order ' || {k} || ' when the amount is $' || {d.money('o_totalprice')} || '.'",
        f"'Order ' || {k} || ' was placed and'",
    ]
    body = "CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN {b}" for i, b in enumerate(bodies)) + " END"
    base = lambda section, title, text, context="''", where="true": f"""SELECT o_custkey AS pkg, '{section}' AS section, o_orderkey AS ord, CASE WHEN o_orderkey % 5 <> 0 THEN '{section[0]}_' || {k} END AS id, {title} AS title, {text} AS body, {context} AS context,
        CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE {d.real('0.5')} + (o_orderkey % 10) / {d.real('20')} END AS confidence, CASE o_orderkey % 3 WHEN 0 THEN 'explicit' WHEN 1 THEN 'inferred' ELSE 'uncertain' END AS basis,
        CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'order ' || {k} END AS excerpt, {ref} AS ref, CASE WHEN o_orderkey % 7 = 0 THEN {d.empty()} ELSE {d.array(ref, "'s_002'")} END AS refs,
        CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 2 END AS n_refs, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS n_excerpts FROM orders WHERE {where}"""  # noqa: E731
    return "(" + " UNION ALL ".join([
        base("atomic_units", "''", body),
        base("retrieval_chunks", f"CASE WHEN o_orderkey % 4 = 1 THEN 'Order vs.' ELSE 'Order ' || {k} END", body, f"CASE WHEN o_orderkey % 2 = 0 THEN 'Orders of customer ' || {c} || ' in one place.' ELSE '' END"),
        base("concepts", "'Status ' || o_orderstatus", "'Status ' || o_orderstatus || ' is a state that an order of this shop can be in.'"),
        base("entities", f"CASE WHEN o_orderkey % 2 = 0 THEN 'Customer ' ELSE 'customer  ' END || {c}", f"'A customer who placed order ' || {k} || '.'", "o_orderpriority"),
        base("decision_rules", "'Amount above limit of ' || o_orderpriority", body, where="o_orderkey % 2 = 1"),
    ]) + ")"


def spans(d: Dialect) -> str:
    """Three spans per package for its items to refer to."""
    one = lambda n, text: f"SELECT c_custkey AS pkg, 's_00{n}' AS span_id, 'document > part {n}' AS path, 'Part {n} of ' || c_name AS title, {text} AS text FROM customer"
    return "(" + " UNION ALL ".join([
        one(1, f"c_name || ' holds a balance of $' || {d.money('c_acctbal * 1000')} || ' in the segment ' || c_mktsegment || ', and this is the first part of what is on file.'"),
        one(2, "'Short note on ' || c_name"),
        one(3, "c_name || ' has orders on file that are reviewed each month by the clerk of the segment ' || c_mktsegment || '.'"),
    ]) + ")"


def cases(d: Dialect) -> str:
    """One evaluation case per part."""
    k = d.text("p_partkey")
    return f"""(SELECT 'part_' || {k} AS case_id, CASE p_size % 4 WHEN 0 THEN 'finance' WHEN 1 THEN 'legal' WHEN 2 THEN 'education' ELSE 'retail' END AS domain, CASE p_size % 3 WHEN 0 THEN 'exception' WHEN 1 THEN 'override' ELSE 'scope' END AS relation_type,
        cast(1 + p_size % 4 AS int) AS complexity_level, CASE WHEN p_size % 2 = 0 THEN 'synthetic' ELSE 'adapted' END AS source_status, 'May part ' || {k} || ' be returned?' AS query,
        CASE WHEN p_size % 2 = 0 THEN 'Yes, part ' || {k} || ' of ' || p_brand || ' may be returned with the receipt.' ELSE 'No, part ' || {k} || ' is excluded from returns by rule ' || p_type || '.' END AS gold, cast(p_size % 4 AS int) AS n_probes,
        p_name || ' ' || p_type AS raw_text FROM part)"""


def results(d: Dialect) -> str:
    """One mock response per case, model and condition."""
    from loomstone.operators import harness as H

    models = ["mock:yes", "mock:no", "mock:refuse", "mock:echo", "mock:default"]
    t = H.tasks(d, cases(d), models, ["primary"], 1)
    return f"(SELECT t.task_key, t.case_id, t.model_spec, t.condition, c.relation_type, c.complexity_level, c.source_status, c.domain, c.query, c.gold, {H.mock_response(d, 't.model_spec', 'c.gold', 'c.query')} AS response FROM ({t}) t JOIN {cases(d)} c ON t.case_id = c.case_id)"


def report_md(d: Dialect) -> str:
    """One readable package report per part, with sections, bullets, subsections and trace tags."""
    k = d.text("p_partkey")
    parts = [
        f"'# Package ' || {k}", "'## 1. Entities (2)'", f"'### ' || p_name || ' _(part)_'", f"'A part of size ' || {d.text('p_size')} || '.'", "'_Aliases:_ item, piece'", "''",
        "'## 4. Heuristics (2)'", f"'- **When** part ' || {k} || ' is late -> **do** call the supplier | _avoid:_ waiting _[h_001 | explicit | c=0.90 | s_001]_'", "'- **When** stock is low -> **do** reorder'", f"'  within ' || {d.text('p_size')} || ' days'", "''",
        "'## 5. Decision rules'", f"'- IF price exceeds ' || {d.money('p_retailprice')} || ' THEN ask a manager _(policy)_'", "''",
        "'## 8. Anti-patterns'", f"'- **Guessing** - inventing data about ' || p_brand || ' _(fails because nobody checks)_'", "''", "'## 9. Causal chains'", "'- delay -> refund (by contract)'",
    ]
    return f"(SELECT p_partkey AS doc_id, {f' || {NL} || '.join(parts)} AS text FROM part)"


def page_text(d: Dialect) -> str:
    """Pages as lines of text: block tags end lines, headings become marks, other tags go; with the host."""
    h = "coalesce(html, '')"
    x = d.sub(h, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    x = d.sub(x, r"(?i)<h1[^>]*>", "\n# ")
    x = d.sub(x, r"(?i)<h2[^>]*>", "\n## ")
    x = d.sub(x, r"(?i)</?(p|div|br|li|ul|tr|h1|h2|article|nav|head|title)[^>]*>", "\n")
    x = d.sub(x, r"<[^>]+>", "")
    return f"(SELECT page_id, {d.first('url', r'^[a-z]+://([^/:?#]+)', 1)} AS host, {x} AS text FROM pages)"


def package_md(d: Dialect) -> str:
    """One readable package per part, all 22 sections: items that fit their form, items that do not, items without a tag, and every seventh one with a section twice."""
    k = d.text("p_partkey")
    even = lambda a, b: f"CASE WHEN p_partkey % 2 = 0 THEN {a} ELSE {b} END"
    tag = lambda i, conf="0.80", refs="s_001, s_002": f"' _[{i} | Explicit | c={conf} | {refs}]_'"
    parts = [
        f"'# Package of ' || p_name", "'> Compiled locally'", "''",
        "'## 1. Core intent'", f"'**Primary purpose:** Explain part ' || {k}", "'**Intended user:** clerks'", "'**Key value:** fewer returns'", "'**Intended agent use:**'", "'- answer questions'", "'- check orders '", "''",
        "'## 2. Domain map'", "'**Main domain:** retail'", "'**Subdomains:** ' || p_brand || ', ' || p_type", "'**Adjacent:** logistics, , law'", "''",
        "'## 3. Entities (3)'", f"'### ' || p_name || ' _(part)_' || {tag('e_001')}", "'A part that is sold.'", "'It has a brand.'", "'_Aliases:_ item, piece,'", "'_Relations:_ made by -> **' || p_brand || '**, broken, sold in -> **' || p_type || '**'", f"'### Plain entity _[e_002]_'", "'### Third _[not a tag]_'", "'Alone.'", "''",
        "'## 4. Concept graph'", f"'### Size ' || {d.text('p_size')} || {tag('c_001', '1')}", "'How large'", "''", "'a part is.'", "''",
        "'## 5. Principles (2)'", f"'- Weigh each part.' || {tag('p_001')}", "'- Second principle,'", f"'  in two lines of ' || {k}", "'no bullet at all'", "''", "'  lost line'",
        "'## 6. Heuristics'", f"'- **When** part ' || {k} || ' is late -> **do** call | _avoid:_ waiting' || {tag('h_001', '.5')}", "'- **When** stock is low -> **do** reorder'", "'- just a remark'",
        "'## 7. Decision rules'", f"'- IF price exceeds ' || {d.money('p_retailprice')} || ' THEN ask THEN wait _(policy)_' || {tag('dr_001')}", "'- a rule without form _(why not)_'",
        "'## 8. Procedures'", f"'### Return' || {tag('pr_001')}", "'_Objective:_ get it back'", "'1. Check it.'", "'2. Send it.'", "'3) not a step'", "'### Empty'",
        "'## 9. Patterns'", "'- **Peaks** — each spring _[pt_001]_'", "'- **Lows** -'", "'- no form'",
        "'## 10. Antipatterns'", "'- **Guessing** - inventing ' || p_brand || ' data _(fails because nobody checks)_ _[ap_001 | inferred]_'", "'- guess _(fails because of this)_'",
        "'## 11. Causal chains'", "'- delay -> refund -> loss (by contract)'", "'- only a cause (mechanism)'",
        "'## 12. Contextual triggers'", "'- _When_ `late ' || p_type || '` -> look it up _[ct_001 | c=0.3]_'", "'- always'",
        "'## 13. IF-THEN rules'", "'- if small then post it _(cheap)_'", "'- otherwise'",
        "'## 14. Exceptions and edge cases'", "'- _Rule:_ no returns | _Exception:_ broken ' || p_type", "'- none'",
        "'## 15. Mental models'", "'- **Shelf** - parts age - slowly'", "'- **Open'",
        "'## 16. Operational playbooks'", "'### Recall _[pb_001 | synthesized | s_003]_'", "'_Objective:_ first'", "'_Objective:_ second aim'", "'1. Stop sales.'",
        "'## 17. Q&A pairs'", f"'- **Q:** What is part ' || {k} || '?'", "'  **A:** It is a ' || p_type || '. _[qa_001 | explicit]_'", "'- **Q:** One line? **A:** Yes.'", "'- a question alone?'",
        "'## 18. Retrieval chunks (1)'", f"'### Chunk ' || {k} || {tag('rc_001')}", "'Text of the chunk.'", "'More text.'",
        "'## 19. Atomic units (2)'", "'- _[numeric_fact]_ It costs ' || " + d.money("p_retailprice") + " || '. _[au_001 | c=x | s_009]_'", "'- untyped unit'",
        "'## 20. Agent instructions'", "'**Behavior rules**'", "'- be kind'", "'- be brief'", "'**Tool usage**'", "'- use the scale'", "'**Behavior rules**'", f"'- last form ' || {k}", "'**Other**'", "'- ignored'",
        "'## 21. Knowledge limits'", "'- before any label'", "'**Missing context**'", "'- the weight'", "'**Needs human review**'",
        "'## 22. Source traceability'", "'### e_001 — page 3'", "'> The part is sold.'", "'>  Twice.'", "'### p_001 - page 4'", "'no quote'", "'### h_001'", "'> call them'", "'### rc_001 — end'", "'> chunk of ' || p_name",
        "'## 23. Unknown section'", "'- nothing'", even("'## 24. Principles'", "'### tail'"), even("'- The last form of principles. _[p_009 | uncertain | c=0.25]_'", "'text'"),
    ]
    return f"(SELECT p_partkey AS doc_id, {f' || {NL} || '.join(parts)} AS text FROM part)"


def placed_words(d: Dialect) -> str:
    """Positioned text of one document per order, a word per line item, over two pages, with a running head on each."""
    order = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax"
    place, given = f"row_number() OVER ({order}, w)", "lineitem"
    if d.name == "spark":
        # The same places, counted before each line becomes three words: of n equal lines the first words come first, then the second ones.
        place = "3 * (first - 1) + (w - 1) * equal + nth - first + 1"
        given = f"(SELECT *, rank() OVER ({order}) AS first, row_number() OVER ({order}) AS nth, count(*) OVER ({order} RANGE BETWEEN CURRENT ROW AND CURRENT ROW) AS equal FROM lineitem)"
    cells = f"""SELECT l_orderkey AS doc_id, cast(1 + l_linenumber % 2 AS int) AS page, cast({place} AS int) AS place, CASE w WHEN 1 THEN CASE WHEN l_partkey % 3 = 0 THEN 'Sent by rail.' ELSE 'Sent By Road' END WHEN 2 THEN lower(l_returnflag) || ' of ' || {d.text('l_partkey')} ELSE '' END AS str,
        CASE WHEN l_quantity > 40 THEN 14.0 WHEN l_quantity < 5 THEN NULL ELSE 10.0 END AS height, CASE WHEN l_quantity < 3 THEN NULL ELSE 9.5 END AS scale, CASE WHEN w = 1 THEN 40.0 ELSE 30.0 END AS width, cast(50 + w * (40 + l_suppkey % 2) AS double) AS x, cast(700 - l_linenumber * 15 - (l_partkey % 3) * (w % 2) * 1.25 - CASE WHEN l_suppkey % 4 = 0 THEN 20 ELSE 0 END AS double) AS y FROM {given} c0 CROSS JOIN {d.rows(['w'], [['1'], ['2'], ['3']])} v0"""
    heads = f"SELECT o_orderkey AS doc_id, cast(p AS int) AS page, 0 AS place, 'Order file ' || {d.text('p')} AS str, 10.0 AS height, NULL AS scale, 60.0 AS width, 50.0 AS x, 780.0 AS y FROM orders c1 CROSS JOIN {d.rows(['p'], [['1'], ['2']])} v1"
    return f"(SELECT * FROM ({cells}) c2 UNION ALL SELECT * FROM ({heads}) c3)"


def book_md(d: Dialect) -> str:
    """One text with headings of all kinds per order."""
    k = d.text("o_orderkey")
    parts = ["'Before any heading.'", "''", f"'Chapter ' || {d.text('1 + o_orderkey % 9')} || ': Orders'", f"'Order ' || {k} || ' opens it.'", "''", f"'A second paragraph on customer ' || {d.text('o_custkey')} || '.'", "'-----'", "'After the rule.'", f"'1.2.3 Details of order ' || {k}", "'Deep text.'", "''", "''", "''", "''", "'Deeper text.'", "'GENERAL TERMS'", "'Terms of ' || o_orderpriority || '.'", "'# Top heading'", "'#### Far below'", "'End of ' || o_orderstatus || '.'"]
    return f"(SELECT o_orderkey AS doc_id, {f' || {NL} || '.join(parts)} AS text FROM orders)"


def loose_entities(d: Dialect) -> str:
    """Entities of one package per customer whose names differ by a word, by case or by an alias only."""
    k = d.text("o_orderkey")
    names = ["'North river shipping carrier company'", "'north  River Shipping Carrier'", "'NRSC'", "'South lake depot'", f"'Clerk of customer ' || {d.text('o_custkey')}", "'North river shipping carrier company limited'", "'The depot'"]
    alias = ["'NR carrier'", "''", "'North River shipping carrier company'", "'the  depot'", "''", "'Big carrier'", "''"]
    case = lambda v: "CASE o_orderkey % 7 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(v)) + " END"
    return f"""(SELECT o_custkey AS pkg, o_orderkey AS ord, {case(names)} AS name, 'Seen in order ' || {k} || CASE WHEN o_orderkey % 3 = 0 THEN ' and described at length' ELSE '' END AS description, {case(alias)} AS alias,
        CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE {d.real('0.5')} + (o_orderkey % 10) / {d.real('20')} END AS confidence, CASE o_orderkey % 4 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'inferred' WHEN 2 THEN 'explicit' ELSE 'odd' END AS basis, {d.fmt('s_%03d', '1 + o_orderkey % 3')} AS ref, 'order  ' || {d.text('o_orderkey % 5')} AS excerpt FROM orders)"""


def partials(d: Dialect) -> str:
    """Partial packages of customers, all 17 sections: each order is a partial with items of some of them, many of them alike."""
    k, c = d.text("o_orderkey"), d.text("o_custkey")
    none = "cast(NULL AS varchar)" if d.name == "duckdb" else "cast(NULL AS string)"
    said = ["'Review each order of the north region before shipping'", "'Review each order of the north region before it ships'", "'review  each ORDER of the north region, before shipping'", f"'Archive the signed contract of customer ' || {c}", f"'Archive the signed contract of customer ' || {c} || ' and carrier'", "'If the status is open, then the clerk must review it'", "''"]
    more = ["'It lowers the number of returns'", "'It lowers the number of late returns'", none, f"'Seen in order ' || {k}"]
    units = [
        "'First check the parcel, then ship it and finally file the receipt.'", f"'Order ' || {k} || ' is not a replacement for the contract.'", "'Use the standard carrier instead of a courier unless the client objects.'",
        "'The team should confirm an order when the amount is high.'", "'The workflow has steps: 1. Check the order. 2. Ship the parcel. 3. Ask.'", f"'Plain fact on customer ' || {c} || '.'", "'Courier mail is not a contract.'",
    ]
    pick = lambda v, by, shift=0: f"CASE ({by} + {shift}) % {len(v)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(v)) + " END"
    link = lambda kind, value, relation=none: d.struct(kind=f"'{kind}'", value=value, relation=relation)
    names = pick(["'North river shipping carrier company'", "'north  River Shipping Carrier'", "'NRSC'", "'South lake depot'", f"'Clerk of customer ' || {c}", "'North river shipping carrier company limited'", "'The depot'"], "o_orderkey")
    alias = pick(["'NR carrier'", "''", "'North River shipping carrier company'", "'the  depot'", "''", "'Big carrier'", "'NRSC'"], "o_orderkey")
    no_links = d.keep(d.array(link("alias", "''")), lambda v: "false", "z")
    lists = {"entities": d.array(link("alias", alias), link("attribute", pick(["'large'", "'Large'", "'old'"], "o_orderkey")), link("related", "'Depot'", pick(["'owns'", "'OWNS'", "'rents'"], "o_orderkey"))), "concepts": d.array(*(link(kind, pick(["'Status'", "'status '", "'Price'", "''"], "o_orderkey", i)) for i, kind in enumerate(["depends_on", "supports", "contradicts", "enables", "risks"])))}
    out = []
    for i, section in enumerate(["entities", "concepts", "principles", "heuristics", "decision_rules", "procedures", "patterns", "anti_patterns", "causal_chains", "contextual_triggers", "if_then_rules", "exceptions", "mental_models", "playbooks", "qa_pairs", "retrieval_chunks", "atomic_units"]):
        a = names if section == "entities" else pick(units, "o_orderkey", i) if section == "atomic_units" else pick(said, "o_orderkey", i)
        b = pick([units[3], f"{units[1]} || ' ' || {units[2]}", units[0]], "o_orderkey") if section == "retrieval_chunks" else pick(more, "o_orderkey", i)
        steps = d.array("'Check it.'", pick(["'Ship it.'", "'Send it.'"], "o_orderkey")) if section in ("procedures", "playbooks") else d.empty()
        out.append(f"""SELECT o_custkey AS pkg, '{section}' AS section, {d.big('o_orderkey')} AS ord, {a} AS a, {b} AS b, {pick(more, 'o_orderkey', i + 1)} AS c, {steps} AS steps, {lists.get(section, no_links)} AS links,
            CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE {d.real('0.5')} + (o_orderkey % 10) / {d.real('20')} END AS confidence, {pick(["'uncertain'", "'inferred'", "'explicit'", "'odd'", none], 'o_orderkey')} AS basis,
            {d.array(d.fmt('s_%03d', '1 + o_orderkey % 3'), "'s_002'")} AS refs, {d.array("'order  ' || " + d.text('o_orderkey % 5'))} AS excerpts FROM orders WHERE (o_orderkey / 8 + {i}) % 3 < 1""")
    return "(" + " UNION ALL ".join(out) + ")"


def package_texts(d: Dialect) -> str:
    """What the partial packages of conversations say once: pkg, part, pos, field, value; a turn is a partial."""
    text = f"substr(replace(text, {NL}, ' '), 1, 40 + (turn % 3) * 20)"
    fields = ["core_intent.primary_purpose", "core_intent.intended_user", "core_intent.intended_agent_use", "domain_map.main_domain", "domain_map.adjacent_domains", "domain_map", "metadata.suggested_domain", "metadata.suggested_subdomains", "metadata.language", "metadata.source_title", "agent_instructions.behavior_rules", "agent_instructions.forbidden_behaviors", "knowledge_limits.missing_context", "knowledge_limits"]
    one = lambda i, f: f"SELECT conv_id AS pkg, turn AS part, {i} AS pos, '{f}' AS field, CASE WHEN turn % 3 = {i % 3} THEN lower({text}) WHEN turn % 3 = 1 THEN role ELSE {text} END AS value FROM conversations WHERE turn % {2 + i % 3} = 0 AND conv_id % {5 + i % 4} <> 0"
    return "(" + " UNION ALL ".join(one(i, f) for i, f in enumerate(fields)) + ")"


def packages_json(d: Dialect) -> str:
    """Packages of customers as (doc_id, section, value): the sections that each has, values as JSON text, of many shapes."""
    k, c, q = d.text("o_orderkey"), d.text("c_custkey"), d.json_quote
    obj = lambda **f: "'{' || " + " || ',' || ".join(f"'\"{n}\":' || {v}" for n, v in f.items()) + " || '}'"
    arr = lambda *v: "'[' || " + " || ',' || ".join(v) + " || ']'"
    text = "'Review order ' || " + k + " || CASE o_orderkey % 6 WHEN 0 THEN ': now' WHEN 1 THEN ' # 2' WHEN 2 THEN chr(10) || 'in two lines' WHEN 3 THEN ' - \"soon\"' WHEN 4 THEN ', {maybe}' ELSE ' ' END"
    trace = {"source_basis": "'\"explicit\"'", "confidence": "'0.' || " + d.text("1 + o_orderkey % 9"), "source_refs": f"CASE WHEN o_orderkey % 3 = 0 THEN '[]' ELSE {arr(q(d.fmt('s_%03d', '1 + o_orderkey % 3')), q(d.lit('s_002')))} END", "source_excerpts": f"CASE WHEN o_orderkey % 2 = 0 THEN '[]' ELSE {arr(q(d.lit(' ')), q("'order ' || " + k))} END"}
    items = {
        "entities": obj(id=q("'e_' || " + k), name=q("'Order ' || " + k), type=q("o_orderpriority"), aliases=arr(q(k), q("o_orderstatus")), related_entities=arr(obj(entity_id=q("'e_1'"), relation_type=q("'owns'"), confidence="'1'")), **trace),
        "decision_rules": obj(id=q("'dr_' || " + k), condition=q(text), decision=q("''"), reasoning="CASE WHEN o_orderkey % 2 = 0 THEN 'null' ELSE 'true' END", **trace),
        "procedures": obj(name=q("'yes'"), steps=arr(obj(step="'1'", action=q(text)), obj(step="'2'", action=q("'Ship it.'"), input_required="'{}'"))),
        "atomic_units": obj(id=q("'au_' || " + k), statement=q(text), type=q("'null'"), tags=arr(arr(q(k), "'-7'"), "'[]'", "'false'"), **trace),
    }
    parts = [f"SELECT o_custkey AS doc_id, '{s}' AS section, '[' || {d.join(d.gather(v, 'o_orderkey'), ',')} || ']' AS value FROM orders WHERE (o_custkey + {i}) % 4 <> 0 GROUP BY o_custkey" for i, (s, v) in enumerate(items.items())]
    objects = {
        "metadata": obj(package_id=q("'pkg_' || " + c), source_title=q("c_name"), domain=q("lower(c_mktsegment)"), subdomains=arr(q("'orders'"), q("c_mktsegment")), language=q("'en'"), human_readability="'0.' || " + d.text("1 + c_custkey % 9"), reviewed="CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END"),
        "core_intent": obj(primary_purpose=q("'Explain orders of ' || c_name"), intended_agent_use=arr(q("'answer'"), q("'check'"))),
        "domain_map": f"CASE WHEN c_custkey % 4 = 0 THEN {arr(q('lower(c_mktsegment)'), q(d.lit('retail')))} ELSE {obj(main_domain=q('c_mktsegment'), adjacent_domains="'[]'")} END",
        "knowledge_limits": f"CASE WHEN c_custkey % 5 = 0 THEN {arr(q(d.lit('no weights')))} ELSE {obj(missing_context=arr(q(d.lit('no weights')), q('c_name')))} END",
        "heuristics": f"CASE WHEN c_custkey % 2 = 0 THEN {q(d.lit('not a list'))} ELSE '[]' END",
        "source_traceability": f"CASE WHEN c_custkey % 6 = 0 THEN {arr(obj(extracted_item_id=q(d.lit('e_1')), source_location=q(d.lit('page 2')), source_excerpt=q('c_name'), extraction_type=q(d.lit('explicit'))))} ELSE '[]' END",
    }
    parts += [f"SELECT c_custkey AS doc_id, '{s}' AS section, {v} AS value FROM customer WHERE (c_custkey + {i}) % 7 <> 0" for i, (s, v) in enumerate(objects.items())]
    return "(" + " UNION ALL ".join(parts) + ")"


def cases_json(d: Dialect) -> str:
    """An evaluation case file per part as JSON text, most of them with faults of many kinds, some no JSON."""
    k, q = d.text("p_partkey"), d.json_quote
    probe = lambda i, more: f"'{{\"fragment_id\":\"{i}\",\"probe\":' || {q('p_name')} || {more} || '}}'"
    probes = " || ".join([probe(1, "',\"expected_answer\":\"yes\"'"), f"CASE WHEN p_partkey % 4 <> 0 THEN ',' || {probe(2, "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ',\"expected_answer\":' || CASE WHEN p_partkey % 10 = 1 THEN '7' ELSE '\"no\"' END END")} ELSE '' END"])
    parts = [
        "'{\"case_id\":'", q(f"CASE WHEN p_partkey % 7 = 0 THEN 'Part ' ELSE 'part_' END || {k}"), "',\"metadata\":{\"domain\":'", "CASE WHEN p_size % 5 = 0 THEN '\"shops\"' ELSE '\"legal\"' END",
        "',\"relation_type\":\"scope\",\"complexity_level\":'", "CASE WHEN p_partkey % 9 = 0 THEN '1.5' ELSE " + d.text("1 + p_size % 4") + " END", "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ',\"license\":\"open\"' END", "',\"source_status\":\"real\",\"notes\":'", "CASE WHEN p_partkey % 11 = 0 THEN 'null' ELSE '\"n\"' END",
        "'},\"representations\":'", "CASE WHEN p_partkey % 17 = 0 THEN '[]' ELSE '{\"raw\":' || " + q("p_name") + " || ',\"annotated\":\"a\",\"compiled\":\"c\"}' END", "',\"query\":'", q("'May ' || p_name || ' be returned?'"),
        "',\"gold_answer\":{\"full\":\"f\",\"minimal\":\"m\",\"required_relations\":[\"scope\"'", "CASE WHEN p_partkey % 13 = 0 THEN ',3,{}' ELSE '' END", "']},\"local_probes\":['", probes, "'],\"failure_examples\":{},\"controls\":{\"parametric_contamination_risk\":'",
        "CASE WHEN p_size % 6 = 0 THEN '\"none\"' ELSE '\"low\"' END", "CASE WHEN p_partkey % 23 = 0 THEN '}' ELSE '}}' END",
    ]
    return f"(SELECT p_partkey, {' || '.join(parts)} AS value FROM part)"


def case_files(d: Dialect) -> str:
    """Files (folder, file, text) of each part's case: one or two translations, some files without an id, some ids stated by two
    files or in one language only, and a package for most cases."""
    k, value = d.text("p_partkey"), f"{cases_json(d)} c"
    unnamed = "CASE WHEN p_partkey % 6 = 0 THEN replace(value, '\"case_id\"', '\"case\"') ELSE value END"
    return f"""(SELECT 'cases' AS folder, 'part_' || {k} || '.json' AS file, {unnamed} AS text FROM {value}
    UNION ALL SELECT 'cases_pt-br', CASE WHEN p_partkey % 8 = 1 THEN 'peça_' ELSE 'part_' END || {k} || '.v1.json', replace(value, '_', CASE WHEN p_partkey % 19 = 0 THEN '-' ELSE '_' END) FROM {value}
    UNION ALL SELECT 'cases_pt-br', 'part_' || {k} || '.v2.json', value FROM {value} WHERE p_partkey % 5 = 0
    UNION ALL SELECT 'ckf/cases', CASE WHEN p_partkey % 16 = 3 THEN 'Part_' ELSE 'part_' END || {k} || '.ckf.json', '{{}}' FROM part)"""


def package_sources(d: Dialect) -> str:
    """The source text of each customer's package, spelling what the package quotes in four ways, and a text for the package."""
    line = f"CASE o_orderkey % 4 WHEN 0 THEN 'An order ' || {d.text('o_orderkey')} || ' is on file.' WHEN 1 THEN 'ORDER ' || {d.text('o_orderkey')} || ' came.' WHEN 2 THEN 'no order' ELSE 'Order  ' || {d.text('o_orderkey')} || ' left.' END"
    return f"(SELECT o_custkey AS doc_id, {d.join(d.gather(line, 'o_orderkey'), chr(10))} AS source, {d.join(d.gather('o_orderpriority', 'o_orderkey'), chr(10))} AS packed FROM orders WHERE o_custkey % 10 <> 0 GROUP BY o_custkey)"


def partial_sections(d: Dialect) -> str:
    """The partial packages of customers as section rows (doc_id, section, value), items with their sections' own fields."""
    from loomstone.operators.reduce import FIELDS

    name = lambda i: "CASE section " + " ".join(f"WHEN '{s}' THEN '\"{f[i]}\":'" for s, f in FIELDS.items() if f[i]) + " END"
    field = lambda i, x: f"{name(i)} || {d.json_quote(x)}"
    many = lambda a: f"'[' || {d.join(d.each(a, lambda v: d.json_quote(v), 'q'), ',')} || ']'"
    steps = f"CASE WHEN section = 'procedures' THEN '\"steps\":[{{\"step\":1,\"action\":' || {d.json_quote("CASE WHEN ord % 5 = 0 THEN 'Check it and' ELSE 'Check it.' END")} || '}}]' WHEN section = 'playbooks' THEN '\"steps\":' || {many('steps')} END"
    body = f"concat_ws(',', '\"id\":' || {d.json_quote("substr(section, 1, 2) || '_' || " + d.text('ord'))}, {field(0, 'a')}, {field(1, 'b')}, {field(2, 'c')}, {steps}, '\"source_refs\":' || {many('refs')}, '\"source_excerpts\":' || CASE WHEN ord % 3 = 0 THEN '[]' ELSE {many('excerpts')} END)"
    items = f"SELECT pkg AS doc_id, section, '[' || {d.join(d.gather(f"'{{' || {body} || '}}'", 'ord'), ',')} || ']' AS value FROM {partials(d)} ps GROUP BY pkg, section"
    meta = f"SELECT c_custkey AS doc_id, 'metadata' AS section, '{{\"language\":\"' || CASE WHEN c_custkey % 4 = 0 THEN 'pt' ELSE 'en' END || '\"}}' AS value FROM customer WHERE c_custkey % 7 <> 0"
    return f"(SELECT * FROM ({items}) p0 UNION ALL SELECT * FROM ({meta}) p1)"
