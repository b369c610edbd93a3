"""Identity, traceability joins and numeric integrity of items against their sources."""

from __future__ import annotations

from loomstone.functions import patterns as P
from loomstone.functions import text as T
from loomstone.functions.dialect import Dialect
from loomstone.operators import extract as E


def stable_ids(d: Dialect, rel: str, key: str) -> str:
    """ID1: prefix and position within a package's section."""
    prefix = "CASE section " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.ID_PREFIX.items()) + " END"
    return f"SELECT {key}, section, ord, {d.fmt('%s_%03d', prefix, f'row_number() OVER (PARTITION BY {key}, section ORDER BY ord)')} AS id FROM {rel}"


def missing_ids(d: Dialect, rel: str, key: str) -> str:
    """ID2: only items without an id get one, from the section's initials."""
    prefix = "CASE section " + " ".join(f"WHEN '{k}' THEN '{''.join(p[0] for p in k.split('_'))}'" for k in P.SECTIONS) + " END"
    return f"SELECT {key}, section, ord, coalesce(id, {d.fmt('%s_%03d', prefix, f'row_number() OVER (PARTITION BY {key}, section ORDER BY ord)')}) AS id FROM {rel}"


def trace(d: Dialect, items: str, spans: str, key: str) -> str:
    """TR1: each item's first resolvable ref with its path, and its first excerpt or the span's first 600 characters."""
    refs = d.explode(f"(SELECT {key}, id, basis, excerpt, refs FROM {items}) a", f"{key}, id, basis, excerpt", "refs", "ref", "n")
    return f"""SELECT {key}, id AS extracted_item_id, path AS source_location, coalesce(nullif({T.trim(d, 'excerpt')}, ''), substr(text, 1, 600)) AS source_excerpt, basis AS extraction_type
    FROM (SELECT r.{key}, r.id, r.basis, r.excerpt, s.path, s.text, row_number() OVER (PARTITION BY r.{key}, r.id ORDER BY r.n) AS nth FROM {refs} r JOIN {spans} s ON r.{key} = s.{key} AND r.ref = s.span_id) b WHERE nth = 1"""


def trace_rows(d: Dialect, items: str, key: str) -> str:
    """TR2: one row per (item, ref); extraction type is the section."""
    refs = d.explode(f"(SELECT {key}, id, section, excerpt, refs FROM {items} WHERE id IS NOT NULL) a", f"{key}, id, section, excerpt", "refs", "ref", "n")
    return f"SELECT {key}, id AS extracted_item_id, ref AS source_location, coalesce(excerpt, '') AS source_excerpt, section AS extraction_type, n AS ref_no FROM {refs} b"


def enrich(d: Dialect, rows: str, manifest: str, key: str) -> str:
    """TR3: trace rows with their manifest entry, where there is one."""
    return f"SELECT t.{key}, t.extracted_item_id, t.ref_no, t.source_location, m.source_type, m.path, m.text_sha256, m.source_id IS NOT NULL AS located FROM {rows} t LEFT JOIN {manifest} m ON t.{key} = m.{key} AND t.source_location = m.source_id"


def enriched(d: Dialect, rows: str, manifest: str, key: str) -> str:
    """TR3 with all fields: rows (basis, confidence) that a manifest entry matches take its record, file, path and places, and
    'explicit' and 1 where they say nothing of their own; the others stay as they are."""
    places = ", ".join(f"m.{c} AS source_{c}" for c in ("path", "line_start", "line_end", "char_start", "char_end"))
    return f"""SELECT t.{key}, t.extracted_item_id, t.ref_no, t.source_location, m.source_record_id, m.source_file, {places},
    CASE WHEN m.source_id IS NULL THEN t.basis ELSE coalesce(nullif(t.basis, ''), 'explicit') END AS source_basis,
    CASE WHEN m.source_id IS NULL THEN t.confidence ELSE coalesce(t.confidence, {d.real('1')}) END AS confidence
    FROM {rows} t LEFT JOIN {manifest} m ON t.{key} = m.{key} AND t.source_location = m.source_id"""


def synthesized(d: Dialect, items: str, traced: str, key: str) -> str:
    """TR4: trace rows for packages that list none (traced: the keys of those that do). An item with an id gives its first ref,
    its first excerpt that is not blank and its basis; one with neither ref nor excerpt gives no row."""
    return f"""SELECT {key}, id AS extracted_item_id, CASE WHEN n_refs > 0 THEN ref ELSE 'document' END AS source_location, coalesce(excerpt, '') AS source_excerpt, coalesce(basis, 'uncertain') AS extraction_type
    FROM (SELECT i.{key}, i.id, i.basis, {d.size('i.refs')} AS n_refs, {d.at('i.refs', 1)} AS ref, {d.at(d.keep('i.excerpts', lambda x: f"{T.trim(d, x)} <> ''"), 1)} AS excerpt
          FROM {items} i LEFT JOIN {traced} t ON i.{key} = t.{key} WHERE t.{key} IS NULL AND i.id <> '') a WHERE n_refs > 0 OR excerpt IS NOT NULL"""


def numeric_check(d: Dialect, items: str, key: str, x: str = "body", source: str = "source") -> str:
    """NG1, NG2: every numeric literal of an item's text: exact in its source, the start of a longer literal there, or neither.

    items: rows (key, id, body, source) with the text of the item's spans joined to it."""
    facts = E.numeric_facts(d, items, f"{key}, id, {source}", x, context=False)
    tail = d.lit(r"[.,]\d+(?:[.,]\d+)?")
    longer = d.first_by(source, f"concat({d.quoted('value_text')}, {tail})")
    return f"""SELECT {key}, id, kind, value_text, CASE WHEN contains({source}, value_text) THEN 'exact' WHEN kind NOT IN ('date', 'citation_reference') AND longer <> '' THEN 'corrected' ELSE 'unverifiable' END AS outcome,
        CASE WHEN NOT contains({source}, value_text) AND kind NOT IN ('date', 'citation_reference') AND longer <> '' THEN longer END AS repaired
    FROM (SELECT *, {longer} AS longer FROM ({facts}) a) b"""


def numeric_score(d: Dialect, checks: str, key: str) -> str:
    """NG3: per package the integrity score."""
    return f"""SELECT {key}, total, exact_matches, corrected, unverifiable, greatest(0, least(1, {d.real('exact_matches + corrected')} / total - unverifiable * 0.1)) AS numeric_integrity_score
    FROM (SELECT {key}, count(*) AS total, {d.count_if("outcome = 'exact'")} AS exact_matches, {d.count_if("outcome = 'corrected'")} AS corrected, {d.count_if("outcome = 'unverifiable'")} AS unverifiable FROM {checks} c GROUP BY {key}) a"""
