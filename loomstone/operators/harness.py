"""Offline evaluation: task plans, mock responses, rule-based scoring, judge parsing, and summaries."""

from __future__ import annotations

from loomstone.functions import patterns as P
from loomstone.functions import text as T
from loomstone.functions.dialect import Dialect


def normal(d: Dialect, x: str) -> str:
    return T.squeeze(d, f"lower({x})")


def polarity(d: Dialect, x: str) -> str:
    """BM5: yes or no among the first 5 words, or null."""
    return _polarity(d, normal(d, x))


def _polarity(d: Dialect, n: str) -> str:
    head = d.sub(f"substr({n}, 1, 200)", P.PREAMBLE)
    toks = d.take(d.all(f"substr({head}, 1, 80)", P.POLARITY_TOKEN, 0), 5)
    known = d.keep(toks, lambda t: f"{d.has_item(d.words(P.YES_TOKENS + P.NO_TOKENS), t)}", "t")
    told = lambda first: f"CASE WHEN {d.has_item(d.words(P.YES_TOKENS), first)} THEN 'yes' WHEN {d.has_item(d.words(P.NO_TOKENS), first)} THEN 'no' END"
    return d.let(d.at(known, 1), told, "pol") if d.name == "spark" else told(d.at(known, 1))


def content_tokens(d: Dialect, x: str) -> str:
    return d.keep(d.all(f"lower({x})", P.OVERLAP_TOKEN, 0), lambda t: f"length({t}) > 2 AND NOT {d.has_item(d.words(P.OVERLAP_STOPWORDS), t)}", "t")


def first_distinct(d: Dialect, a: str, n: int) -> str:
    """The first n distinct items in order."""
    if d.name == "spark":
        return f"slice(array_distinct({a}), 1, {n})"
    return f"list_transform(list_filter(list_transform({a}, lambda v, i: {{'v': v, 'f': list_position({a}, v) = i}}), lambda s: s.f), lambda s: s.v)[1:{n}]"


def overlap(d: Dialect, response: str, target: str) -> str:
    """BM6: the share of the target's first 12 distinct content words that the response has."""
    if d.name == "spark":
        # Words are found once a text. The target's have no stopwords, so the response's need not be told apart from them.
        whole = lambda x: d.all(f"lower({x})", P.OVERLAP_TOKEN, 0)
        words = d.take(d.keep(d.less(whole(target), d.words(P.OVERLAP_STOPWORDS)), lambda t: f"length({t}) > 2", "t"), 12)
        return d.let(words, lambda t: f"CASE WHEN {d.size(t)} = 0 THEN {d.real('0')} ELSE {d.real(d.both(t, whole(response)))} / {d.size(t)} END", "ov")
    t = first_distinct(d, content_tokens(d, target), 12)
    r = content_tokens(d, response)
    return f"CASE WHEN {d.size(t)} = 0 THEN {d.real('0')} ELSE {d.real(d.both(t, r))} / {d.size(t)} END"


def refusal(d: Dialect, x: str) -> str:
    """FL13."""
    return _refusal(d, normal(d, x))


def _refusal(d: Dialect, n: str) -> str:
    pats = " OR ".join(d.has(n, p) for p in P.REFUSALS)
    short = " OR ".join(f"contains({n}, {d.lit(t)})" for t in P.REFUSAL_TOKENS)
    return f"({pats} OR (length({n}) < 40 AND ({short})))"


def escalation(d: Dialect, x: str) -> str:
    """FL14."""
    return _escalation(d, normal(d, x))


def _escalation(d: Dialect, n: str) -> str:
    return "(" + " OR ".join(f"contains({n}, {d.lit(t)})" for t in P.ESCALATIONS) + ")"


def classify(d: Dialect, rel: str, key: str, response: str = "response", gold: str = "gold") -> str:
    """BM7: label and confidence of each response."""
    said = normal(d, response)
    if d.name == "spark":
        rel, said = d.once(f"(SELECT * FROM {rel})", said_=said), "said_"
    return f"""
    SELECT {key}, pol_gold, pol_resp, overlap, CASE WHEN refused THEN 'refusal' WHEN pol_gold IS NOT NULL AND pol_gold = pol_resp AND overlap > 0.25 THEN 'correct'
            WHEN pol_gold <> pol_resp THEN CASE WHEN esc THEN 'wrong_escalation' ELSE 'composition_hallucination' END
            WHEN overlap > 0.45 AND NOT esc THEN 'correct' WHEN esc THEN 'wrong_escalation' ELSE 'other' END AS label,
        CASE WHEN refused THEN 'medium' WHEN pol_gold IS NOT NULL AND pol_gold = pol_resp AND overlap > 0.25 THEN CASE WHEN overlap > 0.45 THEN 'high' ELSE 'medium' END
            WHEN pol_gold <> pol_resp THEN 'medium' ELSE 'low' END AS confidence
    FROM (SELECT *, {_refusal(d, said)} AS refused, {polarity(d, gold)} AS pol_gold, {_polarity(d, said)} AS pol_resp, {overlap(d, response, gold)} AS overlap, {_escalation(d, said)} AS esc FROM {rel}) a"""


def judged(d: Dialect, rel: str, key: str, x: str = "raw") -> str:
    """BM8: label, confidence and rationale in a judge's output: fenced, embedded in prose, or unparseable.

    An embedded object keeps whatever confidence it states; a plain one falls back to low."""
    t = d.sub(d.sub(T.trim(d, x), r"^```(?:json)?\s*"), r"\s*```\s*\z")
    inner = d.first("cleaned", r"\{[^{}]*\}", 0)
    pick = lambda k: f"CASE WHEN whole THEN {d.json_text('cleaned', k)} ELSE {d.json_text('inner_obj', k)} END"
    labels = ", ".join(d.lit(v) for v in P.LABELS)
    return f"""
    SELECT {key}, CASE WHEN label IN ({labels}) THEN label ELSE 'other' END AS label, CASE WHEN NOT parsed THEN 'low' WHEN whole AND coalesce(conf, 'low') NOT IN ('high', 'medium', 'low') THEN 'low' ELSE coalesce(conf, 'low') END AS confidence, parsed
    FROM (SELECT {key}, whole, whole OR embedded AS parsed, lower({T.trim(d, pick('label'))}) AS label, lower({T.trim(d, pick('confidence'))}) AS conf
          FROM (SELECT *, {d.json_object('cleaned')} AS whole, {d.json_object('inner_obj')} AS embedded FROM (SELECT *, {inner} AS inner_obj FROM (SELECT {key}, {t} AS cleaned FROM {rel}) a) b) c) e"""


def family(d: Dialect, provider: str, model: str) -> str:
    """BM10: a model's family: by its provider's own, else the provider."""
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.FAMILIES.items())
    return f"CASE {provider} {names} ELSE {provider} END"


def spec(d: Dialect, x: str) -> tuple[str, str]:
    """(provider, model) of a specification, cut at its first colon."""
    return d.first(x, r"^([^:]+):", 1), d.first(x, r"^[^:]+:(.*)\z", 1)


def judge_conflicts(d: Dialect, models: str, judges: list[str]) -> str:
    """FL12: judges of the family of a model that they would judge."""
    own = lambda x: family(d, *spec(d, x))
    j = d.rows(["judge_spec"], [[d.lit(v)] for v in judges])
    return f"SELECT judge_spec, model_spec, {own('judge_spec')} AS family FROM (SELECT DISTINCT model_spec FROM {models}) m JOIN {j} j ON {own('judge_spec')} = {own('model_spec')}"


def query_text(d: Dialect, kind: str, query: str, control: str, probe: str) -> str:
    """BM3: what is asked, by the kind of query; null for an unknown kind or a missing control."""
    return f"CASE {kind} WHEN 'primary' THEN {query} WHEN 'negative_control' THEN nullif({control}, '') WHEN 'local_probe' THEN {probe} END"


def scoring_gold(kind: str, gold: str, control_gold: str) -> str:
    """BM15: the answer to score against: the control's for a control."""
    return f"CASE WHEN {kind} = 'negative_control' THEN {control_gold} ELSE {gold} END"


def prompt_name(kind: str, style: str) -> str:
    """HP21: which system prompt goes with a query."""
    return f"CASE WHEN {kind} = 'local_probe' THEN 'probe' WHEN {style} = 'standard' THEN 'standard' ELSE 'minimal' END"


def temperature(d: Dialect, model: str, asked: str) -> str:
    """HP17: the temperature to send, null for models that take none."""
    return f"CASE WHEN {d.has(model, P.NO_TEMPERATURE)} AND NOT {d.has(model, P.TAKES_TEMPERATURE)} THEN NULL ELSE {asked} END"


def tasks(d: Dialect, cases: str, models: list[str], query_types: list[str], repetitions: int) -> str:
    """BM1, BM2: case x model x condition x query type (x probe) x repetition, with the key of each. Only the case side grows."""
    m = d.rows(["model_spec"], [[d.lit(v)] for v in models])
    c = d.rows(["condition"], [[d.lit(v)] for v in P.CONDITIONS])
    q = d.rows(["query_type"], [[d.lit(v)] for v in query_types])
    probes = d.explode(f"(SELECT case_id, model_spec, condition, query_type, {d.seq("CASE WHEN query_type = 'local_probe' THEN n_probes ELSE 1 END")} AS ps FROM {cases} c0 CROSS JOIN {m} m CROSS JOIN {c} c CROSS JOIN {q} q) a", "case_id, model_spec, condition, query_type", "ps", "item", "p")
    reps = d.explode(f"(SELECT *, {d.seq(str(repetitions))} AS rs FROM {probes} b) e", "case_id, model_spec, condition, query_type, p - 1 AS query_index", "rs", "item", "r")
    return f"SELECT case_id, model_spec, condition, query_type, query_index, r - 1 AS rep, concat_ws('|', {d.text('case_id')}, model_spec, condition, query_type, {d.text('query_index')}, {d.text('r - 1')}) AS task_key FROM {reps} f"


def mock_response(d: Dialect, model: str, gold: str, query: str) -> str:
    """BM11: what a mock model answers."""
    return f"CASE {model} WHEN 'mock:yes' THEN 'Yes. ' || {gold} WHEN 'mock:no' THEN 'No, this is not allowed.' WHEN 'mock:refuse' THEN 'I cannot determine this without more information.' WHEN 'mock:echo' THEN {query} ELSE 'This is a deterministic mock response.' END"


def summary(d: Dialect, rel: str, keys: str) -> str:
    """AG17: per group the labels' counts, accuracy and composition error rate."""
    n = ", ".join(f"{d.count_if(f"label = '{v}'")} AS n_{v}" for v in P.LABELS)
    return f"SELECT *, {d.half_even(f"{d.real('n_correct')} / n", 3)} AS accuracy, {d.half_even(f"{d.real('n_composition_hallucination')} / n", 3)} AS composition_error_rate FROM (SELECT {keys}, count(*) AS n, {n} FROM {rel} r0 GROUP BY {keys}) a"


def violations(d: Dialect, rel: str, key: str) -> str:
    """BM12, BM14: constraints that a case breaks, one row each."""
    tests = {
        "case_id_pattern": f"NOT {d.has('case_id', r'^[a-z0-9_]+\z')}",
        "domain_enum": "domain NOT IN ('education', 'compliance', 'healthcare', 'finance', 'legal', 'operations', 'software')",
        "complexity_range": "complexity_level NOT BETWEEN 1 AND 3",
        "query_empty": f"{T.trim(d, 'query')} = ''",
        "gold_empty": f"coalesce({T.trim(d, 'gold')}, '') = ''",
        "too_few_probes": "n_probes < 2",
    }
    return " UNION ALL ".join(f"SELECT {key}, '{k}' AS violation FROM {rel} v{i} WHERE {c}" for i, (k, c) in enumerate(tests.items()))


def http_error(d: Dialect, status: str, body: str) -> str:
    """HP16: the error class of an HTTP status."""
    return f"CASE WHEN {status} IN (401, 403) THEN 'auth' WHEN {status} = 429 THEN 'rate_limit' WHEN {status} = 402 THEN 'payment' WHEN {status} = 400 AND {d.has(body, P.SCHEMA_ERROR)} THEN 'schema_too_complex' WHEN {status} >= 400 THEN 'provider_error' END"


def cost(d: Dialect, tasks: str, prices: dict[str, tuple[float, float]], judge: str = "", other: tuple[float, float] = (5.0, 15.0), system_chars: int = 0) -> str:
    """AG19: calls, tokens and price in dollars of tasks (model_spec, query_type, context, asked, query, gold), with those of a judge.

    A token is four characters. prices are per million tokens in and out, by model; one with a date at its end has the price of
    the name before it, one without a price that of `other`. Probes are not judged."""
    used = f"SELECT model_spec AS spec, floor(({system_chars} + length(context) + length(asked) + 100) / 4.0) AS t_in, 200 AS t_out FROM {tasks} t"
    if judge:
        used += f" UNION ALL SELECT {d.lit(judge)}, floor((length(query) + length(gold) + 2000) / 4.0), 100 FROM {tasks} j WHERE query_type <> 'local_probe'"
    table = d.rows(["known", "p_in", "p_out"], [[d.lit(k), d.real(a), d.real(b)] for k, (a, b) in prices.items()])
    names = ", ".join(d.lit(k) for k in prices)
    dated = d.first("spec", r"^(.*)-202", 1)
    price_key = f"CASE WHEN spec IN ({names}) OR {dated} = '' THEN spec ELSE {dated} END"
    dollars = f"({d.real('tokens_in')} * coalesce(p_in, {d.real(other[0])}) + {d.real('tokens_out')} * coalesce(p_out, {d.real(other[1])})) / 1000000"
    return f"""SELECT spec AS model_spec, calls, tokens_in, tokens_out, {d.half_even(dollars, 2)} AS estimated_cost_usd
    FROM (SELECT spec, {price_key} AS price_key, count(*) AS calls, cast(sum(t_in) AS bigint) AS tokens_in, cast(sum(t_out) AS bigint) AS tokens_out FROM ({used}) u GROUP BY spec) c LEFT JOIN {table} p ON c.price_key = p.known"""
