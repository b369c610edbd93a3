"""DuckDB SQL for those training-data queries that SQL can express, written from their contracts and not from the operators."""

from __future__ import annotations

from loomstone.llm import secret_scan

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _reach(nodes: str, edges: str) -> str:
    """CTEs reach(id, r), comp(id, component): the smallest id reachable over edges (x, y) in both directions."""
    return f"""reach(id, r) AS (SELECT id, id FROM {nodes} UNION SELECT reach.id, e.y FROM reach JOIN {edges} e ON reach.r = e.x),
    comp AS (SELECT id, min(r) AS component FROM reach GROUP BY id)"""


EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
edge AS (SELECT a.id AS x, b.id AS y FROM ok a JOIN ok b ON a.id <> b.id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
{_reach('v', 'edge')}
SELECT v.id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component AS component_id, component = v.id AS kept
FROM v JOIN comp ON v.id = comp.id LEFT JOIN (SELECT x, count(*) AS n FROM edge GROUP BY x) k ON v.id = k.x"""

DECONTAMINATION = rf"""
WITH low AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(ws)) AS l, array_to_string(ws[j:j + least(10, len(ws)) - 1], ' ') AS w FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS j FROM items WHERE len(ws) > 0) a),
places AS (SELECT rid, ws, l, unnest(generate_series(1, len(ws) - l + 1)) AS j FROM low, (SELECT DISTINCT l FROM win) k WHERE len(ws) >= l),
occ AS (SELECT rid, item_id, j, win.l FROM (SELECT rid, l, j, array_to_string(ws[j:j + l - 1], ' ') AS w FROM places) p JOIN win ON p.w = win.w AND p.l = win.l),
hit AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(generate_series(j, j + l - 1)) AS p FROM occ) a GROUP BY rid),
its AS (SELECT rid, count(*) AS n, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT rid, item_id::VARCHAR AS i FROM occ) a GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM low LEFT JOIN hit ON low.rid = hit.rid LEFT JOIN its ON low.rid = its.rid"""

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT id, array_to_string(ws[j:j + 2], ' ') AS s FROM (SELECT id, ws, unnest(generate_series(1, greatest(1, len(ws) - 2))) AS j FROM w WHERE len(ws) > 0) a),
n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
pair AS (SELECT a.id AS x, b.id AS y, count(*) AS both_n FROM sh a JOIN sh b ON a.s = b.s AND a.id <> b.id GROUP BY a.id, b.id),
edge AS (SELECT x, y FROM pair JOIN n a ON x = a.id JOIN n b ON y = b.id WHERE 100 * both_n >= 90 * (a.n + b.n - both_n)),
{_reach('w', 'edge')}
SELECT w.id AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component AS component_id FROM w JOIN comp ON w.id = comp.id LEFT JOIN n ON w.id = n.id"""

MIXING = """
WITH s AS (SELECT source, sum(strlen(coalesce(text, '')) + 1)::DOUBLE AS b FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(b) FROM s) / ((SELECT count(*) FROM s)::DOUBLE * b) AS rate FROM s),
k AS (SELECT source, rate, unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 30)::INT)) AS k FROM r),
p AS (SELECT source, rate, k, exp(-rate + sum(CASE WHEN k > 0 THEN ln(rate) - ln(k) ELSE 0 END) OVER (PARTITION BY source ORDER BY k)) AS p FROM k),
c AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM p),
d AS (SELECT *, (('0x' || substr(md5('mix|' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
n AS (SELECT d.doc_id, any_value(c.rate) AS rate, count(*) AS n FROM d JOIN c ON d.source = c.source AND c.c <= d.u GROUP BY d.doc_id)
SELECT doc_id, text, lang, source, n_chars, rate, unnest(generate_series(1, n)) AS copy_no FROM documents JOIN n USING (doc_id)"""

_WORD = "('0x' || substr(h, {at}, 10))::BIGINT"
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((({_WORD.format(at=1 + 10 * i)} >> {35 - 5 * j}) & 31) + 1)::INT, 1)" for i in range(4) for j in range(8))
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS x, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first_id FROM p)
SELECT page_id, strlen(x)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f"""



def _codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Whole numbers as doubles: all products and sums of the tables stay far below 2^53, so they are exact."""
    near = "SELECT rid, p, min({{'d': list_inner_product(y, y) - 2 * list_inner_product(y, c) + list_inner_product(c, c), 'k': k}}) AS m FROM part JOIN b{0} USING (p) GROUP BY rid, p"
    ctes = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(e, lambda c: floor({scale} * c)) AS x FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) v"
        " WHERE e IS NOT NULL AND len(list_filter(e, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0)",
        f"part AS MATERIALIZED (SELECT rid, p, x[1 + p * (len(x) // {parts}):(p + 1) * (len(x) // {parts})] AS y FROM kept, (SELECT unnest(range({parts})) AS p) q)",
        f"b0 AS MATERIALIZED (SELECT p, rid - 1 AS k, y AS c FROM part WHERE rid <= {entries})",
    ]
    for i in range(rounds):
        ctes += [
            f"a{i} AS MATERIALIZED ({near.format(i)})",
            f"s{i} AS (SELECT p, k, list(v ORDER BY i) AS c FROM (SELECT p, m.k AS k, i, floor(sum(y[i]) / count(*)) AS v FROM (SELECT a{i}.p, m, y, unnest(generate_series(1, len(y))) AS i FROM a{i} JOIN part USING (rid, p)) u GROUP BY p, m.k, i) w GROUP BY p, k)",
            f"b{i + 1} AS MATERIALIZED (SELECT b{i}.p, b{i}.k, coalesce(s{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN s{i} ON b{i}.p = s{i}.p AND b{i}.k = s{i}.k)",
        ]
    ctes += [
        f"a AS MATERIALIZED ({near.format(rounds)})",
        "o AS (SELECT rid, string_agg(printf('%02x', m.k), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a GROUP BY rid)",
        f"h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY p, k)) AS h FROM b{rounds})",
    ]
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN o USING (rid), h"


def _secrets() -> str:
    """Each kind's matches are set between marks (a character that no expression takes) and the text is cut there: every second piece
    is a match, and the lengths of the pieces before are its place."""
    either = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    kinds = [("assign", rf"""({either})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2), ("access", "AKIA[A-Z0-9]+", 16, 0), ("hex", "[0-9a-f]+", 32, 0)]
    kinds += [(kind, pattern, 0, 0) for kind, pattern, *_ in secret_scan.MORE]
    quoted = [(k, p.replace("'", "''"), n, g) for k, p, n, g in kinds]
    cut = " UNION ALL ".join(f"SELECT rid, {i} AS r, string_split(regexp_replace(t, '({p})', chr(2) || '\\1' || chr(2), 'g'), chr(2)) AS pieces FROM docs" for i, (_, p, _, _) in enumerate(quoted))
    fine = " ".join(f"WHEN {i} THEN length({f"regexp_extract(piece, '{p}', {g})" if g else 'piece'}) >= {n}" for i, (_, p, n, g) in enumerate(quoted))
    named = " ".join(f"WHEN {i} THEN '{k}'" for i, (k, *_) in enumerate(quoted))
    one = f"CASE r {named} END || ':' || a || ':' || z"
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, replace(coalesce(text, ''), chr(2), chr(3)) AS t FROM documents),
pieces AS (SELECT rid, r, unnest(pieces) AS piece, unnest(range(len(pieces))) AS n FROM ({cut}) c WHERE len(pieces) > 1),
placed AS (SELECT rid, r, piece, n, sum(length(piece)) OVER (PARTITION BY rid, r ORDER BY n)::BIGINT AS z FROM pieces),
found AS (SELECT rid, r, z - length(piece) AS a, z FROM placed WHERE n % 2 = 1 AND CASE r {fine} END),
per AS (SELECT rid, count(*) FILTER (WHERE r = 0) AS n0, count(*) FILTER (WHERE r = 1) AS n1, count(*) FILTER (WHERE r = 2) AS n2, string_agg({one}, ',' ORDER BY a, r) FILTER (WHERE r < 3) AS base, string_agg({one}, ',' ORDER BY a, r) AS spans FROM found GROUP BY rid)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per USING (rid)"""


SQL = {
    "op3_embedding_dedup": EMBEDDINGS, "op4_decontamination": DECONTAMINATION, "op8_jaccard_join": JACCARD, "op9_mixing": MIXING, "op10_warc": WARC,
    "op11_vector_codes": _codes(), "op13_secret_scan": _secrets(),
}
