"""Statistics, quality scores and inspection reports over the item table."""

from __future__ import annotations

from loomstone.functions import patterns as P
from loomstone.functions import text as T
from loomstone.functions.dialect import Dialect


def counts(d: Dialect, rel: str, key: str) -> str:
    """Items of each section per package, one row a package: the base of AG1, AG3 and AG6."""
    n = ", ".join(f"{d.count_if(f"section = '{s}'")} AS n_{s}" for s in P.SECTIONS)
    return f"SELECT {key}, {n}, count(*) AS items_total, {d.count_if('n_refs > 0')} AS with_refs, {d.count_if('n_refs > 0 OR n_excerpts > 0')} AS with_trace, cast(sum(n_excerpts) AS bigint) AS excerpts_total, count(confidence) AS with_conf, coalesce(sum(confidence), 0) AS conf_sum FROM {rel} GROUP BY {key}"


def stats(d: Dialect, rel: str, key: str) -> str:
    """AG1, AG2."""
    return f"SELECT {key}, n_atomic_units, n_retrieval_chunks, n_entities, n_concepts, n_procedures, n_decision_rules, n_if_then_rules, n_heuristics, excerpts_total, with_trace, items_total, {d.real('with_trace')} / items_total AS traceability_pct FROM ({counts(d, rel, key)}) a"


def quality(d: Dialect, rel: str, key: str, chunks: str) -> str:
    """AG3, AG6: the quality scores of each package; chunks: SQL for its number of chunks. Intent and metadata count as absent."""
    foundation = " + ".join(f"CASE WHEN n_{s} > 0 THEN 1 ELSE 0 END" for s in P.FOUNDATIONAL)
    populated = " + ".join(f"CASE WHEN n_{s} > 0 THEN 1 ELSE 0 END" for s in P.SECTIONS)
    rich = " + ".join(f"n_{s}" for s in P.RICH)
    clamp = lambda x: f"greatest(0, least(1, {x}))"
    return f"""
    SELECT {key}, items_total, coverage, density, traceability, schema_completeness, floor((coverage * 0.4 + schema_completeness * 0.6) * 100 + 0.5) / 100 AS human_readability,
        floor((traceability * 0.5 + density * 0.3 + coverage * 0.2) * 100 + 0.5) / 100 AS ai_utility_score,
        floor(CASE WHEN rich + flat > 0 THEN least(1, {d.real('rich')} / (rich + flat) / 0.3) ELSE 0 END * 100 + 0.5) / 100 AS section_allocation_score
    FROM (SELECT {key}, items_total, {clamp(f'({foundation}) / {d.real(str(len(P.FOUNDATIONAL)))} * 0.8')} AS coverage, {clamp(f"{d.real('items_total')} / {chunks} / 6")} AS density,
            {clamp(f"{d.real('with_refs')} / items_total * 0.6 + {d.real('with_conf')} / items_total * 0.3 + CASE WHEN with_conf > 0 THEN conf_sum / with_conf ELSE 0 END * 0.1")} AS traceability,
            ({populated}) / {d.real(str(len(P.SECTIONS) + 4))} AS schema_completeness, {rich} AS rich, n_atomic_units + n_retrieval_chunks AS flat
          FROM (SELECT * FROM ({counts(d, rel, key)}) a) b) c"""


CONTRAST = r"(?i)\b(not|does\s+not\s+replace|instead\s+of|rather\s+than|composes?\s+with)\b"
PROCEDURE = r"(?i)\b(pipeline|steps?|workflow|process|sequence)\b"
CONDITION = r"(?i)\b(if|when|unless|except|does\s+not\s+apply)\b"


def allocation(d: Dialect, rel: str, sources: str, key: str) -> str:
    """AG4: the section allocation score of each package against its source text."""
    src = f"(SELECT {key} AS sk, {d.has('text', CONTRAST)} AS contrastive, {d.has('text', PROCEDURE)} AS procedural, {d.has('text', CONDITION)} AS conditional, {T.word_count(d, 'text')} AS words FROM {sources})"
    share = f"{d.real('n_atomic_units + n_retrieval_chunks')} / items_total"
    rules = [
        (f"{share} > 0.8", 0.20), ("contrastive AND n_anti_patterns = 0 AND n_decision_rules = 0", 0.20), ("procedural AND n_procedures = 0 AND n_playbooks = 0", 0.15),
        ("conditional AND n_exceptions = 0 AND n_if_then_rules = 0", 0.15), ("words > 1000 AND n_qa_pairs = 0", 0.10),
    ]
    loss = " + ".join(f"CASE WHEN {c} THEN {v} ELSE 0 END" for c, v in rules)
    many = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c, _ in rules)
    return f"SELECT {key}, {d.half_even(share, 3)} AS atomic_share, contrastive, procedural, conditional, words AS source_word_count, {many} AS n_penalties, {d.half_even(f'greatest(0, 1.0 - ({loss}))', 4)} AS score FROM ({counts(d, rel, key)}) a JOIN {src} s ON a.{key} = s.sk"


def inventory(d: Dialect, rel: str) -> str:
    """AG8: items per section, empty sections included."""
    dim = d.rows(["section", "section_no"], [[d.lit(s), str(i)] for i, s in enumerate(P.SECTIONS)])
    return f"SELECT s.section, s.section_no, coalesce(n, 0) AS n FROM {dim} s LEFT JOIN (SELECT section, count(*) AS n FROM {rel} GROUP BY section) i ON s.section = i.section"


def confidence_buckets(d: Dialect, rel: str, key: str) -> str:
    """AG9."""
    edges = [("low", "0", "0.5"), ("fair", "0.5", "0.7"), ("good", "0.7", "0.85"), ("high", "0.85", "1.0001")]
    cols = ", ".join(f"{d.count_if(f'confidence >= {a} AND confidence < {b}')} AS {n}" for n, a, b in edges)
    return f"SELECT {key}, {cols}, avg(confidence) AS mean_confidence FROM {rel} GROUP BY {key}"


def worst_traced(d: Dialect, rel: str, key: str, top: int = 5) -> str:
    """AG10: per package the `top` non-empty sections with least traced items, ties in section order."""
    no = "CASE section " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(P.SECTIONS)) + " END"
    return f"SELECT {key}, section, n, traced, pct FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY pct, no) AS nth FROM (SELECT {key}, section, {no} AS no, count(*) AS n, {d.count_if('n_refs > 0 OR n_excerpts > 0')} AS traced, {d.real(d.count_if('n_refs > 0 OR n_excerpts > 0'))} / count(*) AS pct FROM {rel} GROUP BY {key}, section) a) b WHERE nth <= {top}"


def orphans(d: Dialect, rel: str, key: str, top: int = 25) -> str:
    """AG11: items with neither refs nor excerpts: the first `top` of a package, with their total."""
    return f"SELECT {key}, section, id, orphans FROM (SELECT {key}, section, id, count(*) OVER (PARTITION BY {key}) AS orphans, row_number() OVER (PARTITION BY {key} ORDER BY section, ord) AS nth FROM {rel} WHERE n_refs = 0 AND n_excerpts = 0 AND id IS NOT NULL) a WHERE nth <= {top}"


def locate(d: Dialect, x: str, source: str) -> str:
    """AG12: how an excerpt is found in its source."""
    return f"CASE WHEN contains({source}, {x}) THEN 'exact' WHEN contains(lower({source}), lower({x})) THEN 'case_insensitive' WHEN contains({T.norm(d, source)}, {T.norm(d, x)}) THEN 'normalized' ELSE 'none' END"


def compression(d: Dialect, rel: str, key: str, source: str, packed: str) -> str:
    """AG13: bytes of the source and the packed text, ratio, reduction and token estimates."""
    return f"SELECT {key}, {d.bytes(source)} AS source_bytes, {d.bytes(packed)} AS packed_bytes, {d.real(d.bytes(packed))} / greatest(1, {d.bytes(source)}) AS ratio, cast(floor(length({source}) / 4.0 + 0.5) AS bigint) AS source_tokens, cast(floor(length({packed}) / 4.0 + 0.5) AS bigint) AS packed_tokens FROM {rel}"


def rule_samples(d: Dialect, rel: str, key: str, top: int = 5) -> str:
    """AG14: the first `top` samples of each rule section with the section's count."""
    return f"SELECT {key}, section, n, nth, body FROM (SELECT {key}, section, body, count(*) OVER (PARTITION BY {key}, section) AS n, row_number() OVER (PARTITION BY {key}, section ORDER BY ord) AS nth FROM {rel} WHERE section IN ('decision_rules', 'if_then_rules', 'principles', 'heuristics', 'exceptions', 'anti_patterns')) a WHERE nth <= {top}"
