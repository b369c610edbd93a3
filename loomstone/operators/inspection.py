"""AG7, AG12: the inspection report of packages, one nested row each, from one pass over their sections.

A package's sections are rows (doc_id, section, value as JSON text: what fenced.filled() gives). Each row is measured where it lies: its
items are read once into the few fields that the report looks at, and become one struct of counts, orphans, samples and
excerpts. One grouping by package puts the structs together and works the report out of them; the source text joins there, once a
package. Excerpts are looked for by automata over all excerpts of a package at a time, so the search is linear in the source.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.shipping import ship
from loomstone.sources import fenced as FE

#: Sections whose items carry a trace, in the report's order, and the buckets of confidence (from, below).
TRACED = [s for s in FE.LISTS if s != "source_traceability"]
BUCKETS = ((0.0, 0.5), (0.5, 0.7), (0.7, 0.85), (0.85, 1.0001))
WORST, ORPHANS, FAILURES, SAMPLES = 5, 25, 10, 5
RULES = ("if_then_rules", "decision_rules", "exceptions", "contextual_triggers", "heuristics")
_ITEM = "array<struct<id: string, name: string, label: string, statement: string, type: string, description: string, `if`: string, `then`: string, condition: string, decision: string, exception_case: string, modified_action: string, confidence: double, source_refs: array<string>, source_excerpts: array<string>>>"


# ---- excerpts in their source ----
def _squeezed(text: str) -> tuple[str, list[int], list[int]]:
    """text with each run of white space as one space, and where stretches between the runs begin: in it, and in text."""
    out, at, there, here = [], [0], [0], 0
    for m in re.finditer(r"\s+", text):
        out += [text[there[-1] : m.start()], " "]
        here += m.start() - there[-1] + 1
        at.append(here)
        there.append(m.end())
    out.append(text[there[-1] :])
    return "".join(out), at, there


def _find(text: str, wanted: set[str]) -> dict[str, int]:
    """The first place of each wanted text."""
    import ahocorasick

    found: dict[str, int] = {}
    if not wanted or not text:
        return found
    machine = ahocorasick.Automaton()
    for w in wanted:
        machine.add_word(w, w)
    machine.make_automaton()
    for end, w in machine.iter(text):
        if w not in found:
            found[w] = end - len(w) + 1
            if len(found) == len(wanted):
                break
    return found


def locate(text: str, excerpts: list[str]) -> list[tuple[str, int | None, int | None]]:
    """AG12: (method, start, end) of each excerpt in text: exact, case_insensitive, whitespace or none; offsets are those of text,
    the first place by the strictest method that finds it."""
    out: dict[str, tuple[str, int | None, int | None]] = {e: ("exact", a, a + len(e)) for e, a in _find(text, {e for e in excerpts if e}).items()}
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)  # letters that grow keep their place
    lower = lambda e: "".join(c.lower() if len(c.lower()) == 1 else c for c in e)
    left = {e: lower(e) for e in excerpts if e and e not in out}
    places = _find(low, set(left.values()))
    out |= {e: ("case_insensitive", places[k], places[k] + len(k)) for e, k in left.items() if k in places}
    left = {e: re.sub(r"\s+", " ", k).strip() for e, k in left.items() if e not in out}
    if any(left.values()):
        flat, at, there = _squeezed(low)
        places = _find(flat, {k for k in left.values() if k})

        def back(i: int) -> int:
            n = bisect_right(at, i) - 1
            return min(there[n] + i - at[n], len(text))

        out |= {e: ("whitespace", back(places[k]), back(places[k] + len(k) - 1) + 1) for e, k in left.items() if k in places}
    return [out.get(e, ("none", None, None)) for e in excerpts]


_FOUND = "total long, located long, failures array<struct<section: string, id: string, excerpt: string>>, places array<struct<section: string, id: string, excerpt: string, method: string, start: long, `end`: long>>"


def coverage(packages: DataFrame) -> DataFrame:
    """(doc_id, total, located, failures, places) of packages (doc_id, source, excerpts: structs of section, id, excerpt)."""
    ship(packages.sparkSession)
    kind = packages.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, asked in zip(b.column("doc_id").to_pylist(), b.column("source").to_pylist(), b.column("excerpts").to_pylist(), strict=True):
                asked = [a for a in asked or [] if (a["excerpt"] or "").strip()] if text else []
                found = locate(text or "", [a["excerpt"] for a in asked])
                places = [a | {"method": m, "start": s, "end": z} for a, (m, s, z) in zip(asked, found, strict=True)]
                lost = [{k: p[k][:220] if k == "excerpt" else p[k] for k in ("section", "id", "excerpt")} for p in places if p["method"] == "none"]
                rows.append({"doc_id": doc, "total": len(places), "located": len(places) - len(lost), "failures": lost[:FAILURES], "places": places})
            text_, long = pa.string(), pa.int64()
            one = [("section", text_), ("id", text_), ("excerpt", text_)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", b.schema.field("doc_id").type), ("total", long), ("located", long), ("failures", pa.list_(pa.struct(one))), ("places", pa.list_(pa.struct([*one, ("method", text_), ("start", long), ("end", long)])))]))

    return packages.select("doc_id", "source", "excerpts").mapInArrow(run, f"doc_id {kind}, {_FOUND}")


# ---- the report ----
def measured(sections: DataFrame) -> DataFrame:
    """(doc_id, section, no, m, value): each section row with what the report needs of it, worked out in the row."""
    no = "array_position(array(" + ", ".join(f"'{s}'" for s in FE.SECTIONS) + "), section)"
    rows = sections.select("doc_id", "section", F.expr(no).alias("no"), "value", F.when(F.col("section").isin(*FE.LISTS), F.from_json("value", _ITEM)).alias("items"))
    traced = "(coalesce(size(i.source_excerpts), 0) > 0 OR coalesce(size(i.source_refs), 0) > 0)"
    title = "coalesce(nullif(i.name, ''), nullif(i.label, ''), nullif(substring(i.statement, 1, 80), ''))"
    counts = ", ".join(f"size(filter(items, i -> i.confidence >= {a} AND i.confidence < {b}))" for a, b in BUCKETS)
    excerpts = "flatten(transform(items, i -> transform(filter(coalesce(i.source_excerpts, array()), e -> e RLIKE '[^\\\\s]'), e -> named_struct('section', section, 'id', coalesce(i.id, '—'), 'excerpt', e))))"
    m = f"""named_struct('n', size(items), 'traced', size(filter(items, i -> {traced})), 'excerpts_total', aggregate(items, 0, (s, i) -> s + coalesce(size(i.source_excerpts), 0)),
        'buckets', array({counts}), 'conf_n', size(filter(items, i -> i.confidence IS NOT NULL)), 'conf_sum', aggregate(items, 0D, (s, i) -> s + coalesce(i.confidence, 0D)),
        'orphans', transform(filter(items, i -> NOT {traced} AND i.id IS NOT NULL), i -> named_struct('section', section, 'id', i.id, 'title', {title})), 'excerpts', {excerpts})"""
    own = {
        "types": "CASE WHEN section = 'atomic_units' THEN transform(items, i -> coalesce(nullif(i.type, ''), 'unknown')) END",
        "samples": f"CASE WHEN section IN ('if_then_rules', 'decision_rules', 'exceptions') THEN transform(slice(items, 1, {SAMPLES}), i -> named_struct('id', i.id, 'first', coalesce(i.`if`, i.condition, i.exception_case), 'second', coalesce(i.`then`, i.decision, i.modified_action))) END",
        "named": "CASE WHEN section = 'anti_patterns' THEN transform(items, i -> named_struct('id', i.id, 'name', i.name, 'description', i.description)) END",
    }
    return rows.select("doc_id", "section", "no", "value", F.expr(f"CASE WHEN items IS NOT NULL THEN {m} END").alias("m"), *(F.expr(v).alias(k) for k, v in own.items()))


def report(sections: DataFrame, sources: DataFrame) -> DataFrame:
    """AG7: one row a package: doc_id, cover, inventory, quality, traceability, source_coverage, compression, rules, limits, anti_patterns.

    sources: (doc_id, source, packed), the source's text and the package's own, either may be null or missing."""
    rows = measured(sections)
    listed = F.array_sort(F.collect_list(F.when(F.col("m").isNotNull(), F.struct("no", "section", "m"))))
    text = lambda s: F.max(F.when(F.col("section") == s, F.col("value"))).alias(f"{s}_")
    only = lambda c, s: F.max_by(c, F.col("section") == s).alias(c)
    sample = lambda s: F.max_by(F.when(F.col("section") == s, F.col("samples")), F.when(F.col("section") == s, F.lit(1))).alias(f"s_{s}")
    one = rows.groupBy("doc_id").agg(listed.alias("l"), text("metadata"), text("knowledge_limits"), only("types", "atomic_units"), only("named", "anti_patterns"), *map(sample, ("if_then_rules", "decision_rules", "exceptions")))
    one = one.withColumn("t", F.expr("filter(l, x -> x.section <> 'source_traceability')")).withColumn("meta", F.from_json("metadata_", FE.schema("metadata"))).withColumn("limits", F.from_json("knowledge_limits_", FE.schema("knowledge_limits")))
    total = lambda f: f"aggregate(t, 0, (s, x) -> s + x.m.{f})"
    many = lambda s: f"coalesce(try_element_at(transform(filter(l, x -> x.section = '{s}'), x -> x.m.n), 1), 0)"
    pct = "(x.m.traced / x.m.n)"
    worst = f"transform(slice(array_sort(transform(filter(t, x -> x.m.n > 0), x -> named_struct('pct', {pct}, 'no', x.no, 'section', x.section, 'total', x.m.n, 'traced', x.m.traced))), 1, {WORST}), x -> named_struct('section', x.section, 'total', x.total, 'traced', x.traced, 'pct', x.pct))"
    cover = {"title": ("source_title", "'(untitled)'"), "author": ("source_author", "'—'"), "domain": ("domain", "'—'"), "language": ("language", "'—'"), "protocol_version": ("protocol_version", "'—'"), "package_id": ("package_id", "'—'"), "compression": ("compression_level", "'—'"), "human_readability": ("human_readability", "0D"), "ai_utility": ("ai_utility_score", "0D")}
    parts = {
        "cover": "named_struct(" + ", ".join(f"'{k}', coalesce(meta.{f}, {v})" for k, (f, v) in cover.items()) + ")",
        "inventory": "named_struct('sections', transform(l, x -> named_struct('section', x.section, 'n', x.m.n)), 'empty', transform(filter(l, x -> x.m.n = 0), x -> x.section), 'types', transform(array_sort(array_distinct(coalesce(types, array()))), k -> named_struct('type', k, 'n', size(filter(types, y -> y = k)))), 'total', aggregate(l, 0, (s, x) -> s + x.m.n))",
        "quality": f"named_struct('buckets', transform(sequence(0, {len(BUCKETS) - 1}), b -> aggregate(t, 0, (s, x) -> s + x.m.buckets[b])), 'mean', CASE WHEN {total('conf_n')} > 0 THEN aggregate(t, 0D, (s, x) -> s + x.m.conf_sum) / {total('conf_n')} END)",
        "traceability": f"named_struct('total', {total('n')}, 'traced', {total('traced')}, 'pct', CASE WHEN {total('n')} > 0 THEN {total('traced')} / {total('n')} ELSE 0D END, 'excerpts', {total('excerpts_total')}, 'worst', {worst}, 'orphans', slice(flatten(transform(t, x -> x.m.orphans)), 1, {ORPHANS}), 'n_orphans', size(flatten(transform(t, x -> x.m.orphans))))",
        "rules": "named_struct(" + ", ".join(f"'{s}', {many(s)}" for s in RULES) + ", " + ", ".join(f"'{s}_samples', s_{s}" for s in ("if_then_rules", "decision_rules", "exceptions")) + ")",
    }
    packed = one.join(sources.select("doc_id", "source", "packed"), "doc_id", "left").select("doc_id", "limits", F.col("named").alias("anti_patterns"), "source", "packed", F.expr("flatten(transform(t, x -> x.m.excerpts))").alias("excerpts"), *(F.expr(v).alias(k) for k, v in parts.items()))
    from loomstone.plans.compile import hold

    packed = hold(packed)  # what excerpts are searched in, and what their places are joined to
    found = coverage(packed)
    some = "coalesce(length(source), 0) > 0"
    out = packed.join(found, "doc_id")
    sizes = f"CASE WHEN {some} AND length(packed) > 0 THEN named_struct('source_bytes', octet_length(source), 'package_bytes', octet_length(packed), 'ratio', octet_length(packed) / octet_length(source), 'reduction_pct', (1 - octet_length(packed) / octet_length(source)) * 100, 'source_tokens', cast(floor(length(source) / 4D + 0.5D) AS bigint), 'package_tokens', cast(floor(length(packed) / 4D + 0.5D) AS bigint)) END"
    covered = f"named_struct('available', {some}, 'total', total, 'located', located, 'pct', CASE WHEN total > 0 THEN located / total ELSE 0D END, 'failures', failures)"
    return out.select("doc_id", "cover", "inventory", "quality", "traceability", F.expr(covered).alias("source_coverage"), F.expr(sizes).alias("compression"), "rules", "limits", F.coalesce("anti_patterns", F.array()).alias("anti_patterns"))
