"""Positioned text to lines and Markdown: what a page reader gives, as rows of (document, page, place, text, size, position).

Reading pages out of a file needs a library that is not here; everything after it is this.
"""

from __future__ import annotations

from loomstone.functions import text as T
from loomstone.functions.dialect import Dialect


def words(d: Dialect, rel: str, key: str) -> str:
    """IO3: usable items: text that is not empty, with sizes and positions filled in (height: its own, else `scale`, else 10)."""
    return f"(SELECT {key}, page, place, str, cast(coalesce(height, scale, 10) AS double) AS height, cast(coalesce(width, 0) AS double) AS width, cast(coalesce(x, 0) AS double) AS x, cast(coalesce(y, 0) AS double) AS y FROM {rel} WHERE str <> '')"


def page_lines(d: Dialect, rel: str, key: str, tolerance: float = 2) -> str:
    """IO4, IO5: one row per line: from the top, items join the line whose first item lies within `tolerance` of them; its text
    by place from the left with a space at gaps above 1, white space squeezed, and the largest height.

    A line's first item stands for it, so this is a fold over a page's items, which a page bounds."""
    item = d.struct(y="y", x="x", place="place", str="str", height="height", width="width")
    order = "row_number() OVER (PARTITION BY {key}, page ORDER BY y DESC, x, place)".replace("{key}", key)
    pages = f"(SELECT {key}, page, {d.gather('item', 'o')} AS items FROM (SELECT {key}, page, {order} AS o, {item} AS item FROM {words(d, rel, key)} p0) p1 GROUP BY {key}, page)"
    start = d.struct(y=d.real("0"), n="0", outs=d.empty("int"))

    def step(acc, v):
        fresh = f"({acc}.n = 0 OR abs({acc}.y - {v}.y) > {tolerance})"
        n = f"({acc}.n + CASE WHEN {fresh} THEN 1 ELSE 0 END)"
        return d.struct(y=f"CASE WHEN {fresh} THEN {v}.y ELSE {acc}.y END", n=n, outs=d.append(f"{acc}.outs", n))

    seen = d.each("items", lambda v: d.struct(y=f"{v}.y", n="0", outs=d.empty("int")), "i")
    folded = f"(SELECT {key}, page, items, {d.fold(seen, start, step)} AS f FROM {pages} p2)"
    numbered = d.each_at("items", lambda v, i: d.struct(line_no=d.at("f.outs", i), item=v), "v", "i")
    rows = d.explode(f"{folded} p3", f"{key}, page", numbered, "one", "at")
    flat = f"(SELECT {key}, page, one.line_no AS line_no, one.item.y AS y, one.item.x AS x, one.item.place AS place, one.item.str AS str, one.item.height AS height, one.item.width AS width FROM {rows} p4)"
    by = f"OVER (PARTITION BY {key}, page, line_no ORDER BY x, y DESC, place)"
    gap = f"(SELECT *, x - (lag(x) {by} + lag(width) {by}) AS gap, row_number() {by} AS nth FROM {flat} p5)"
    return f"(SELECT {key}, page, line_no, {T.squeeze(d, d.join(d.gather("CASE WHEN gap > 1 THEN ' ' ELSE '' END || str", 'nth'), ''))} AS text, max(y) AS y, max(height) AS height FROM {gap} p6 GROUP BY {key}, page, line_no)"


def _head_key(d: Dialect) -> str:
    return T.trim(d, d.sub("lower(text)", r"\d+", "#"))


def _heading_shape(d: Dialect) -> str:
    return f"length(text) BETWEEN 1 AND 90 AND NOT {d.has('text', r'[.!?:;,]\z')} AND NOT {d.has('text', r'^\d+\z')} AND {d.has('text', r'\p{L}')}"


def _measured_in_windows(d: Dialect, rel: str, key: str, share: float) -> str:
    """markdown() without a join: pages of a document and of a running head are counted by their first lines, the upper middle of
    values is the one at its place among them. Lines without a document or page share no measure, as in a join."""
    has = f"{key} IS NOT NULL"
    upper = lambda part, value, nth, many: f"max(CASE WHEN {nth} = floor({many} / 2) + 1 THEN {value} END) OVER (PARTITION BY {part})"
    chrome = f"{has} AND length(k) BETWEEN 1 AND 100 AND on_pages >= greatest(2, ceil(pages * {d.real(str(share))}))"
    return f"""WITH ln AS (SELECT *, {_head_key(d)} AS k FROM {page_lines(d, rel, key)} l0),
    firsts AS (SELECT *, page IS NOT NULL AND row_number() OVER (PARTITION BY {key}, page ORDER BY line_no) = 1 AS of_page, page IS NOT NULL AND row_number() OVER (PARTITION BY {key}, k, page ORDER BY line_no) = 1 AS of_head FROM ln),
    seen AS (SELECT *, count_if(of_page) OVER (PARTITION BY {key}) AS pages, count_if(of_head) OVER (PARTITION BY {key}, k) AS on_pages FROM firsts),
    free AS (SELECT *, coalesce(height > 0, false) AS high FROM seen WHERE NOT coalesce({chrome}, false)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY {key}, high ORDER BY height) AS h_nth, count(*) OVER (PARTITION BY {key}, high) AS h_many FROM free),
    body AS (SELECT {key}, page, line_no, text, y, height, CASE WHEN {has} THEN {upper(key, 'height', 'high AND h_nth', 'h_many')} END AS body FROM ranked),
    kept AS (SELECT *, greatest(0, (lag(y) OVER w) - y) AS gap, (lag(y) OVER w) - y AS dy FROM body WHERE text <> '' WINDOW w AS (PARTITION BY {key}, page ORDER BY line_no)),
    gaps AS (SELECT *, row_number() OVER (PARTITION BY {key}, page, gap IS NOT NULL ORDER BY gap) AS g_nth, count(*) OVER (PARTITION BY {key}, page, gap IS NOT NULL) AS g_many FROM kept),
    mid AS (SELECT *, CASE WHEN {has} AND page IS NOT NULL THEN {upper(f'{key}, page', 'gap', 'gap IS NOT NULL AND g_nth', 'g_many')} END AS mid FROM gaps),
    judged AS (SELECT *, greatest(coalesce(mid, 0) * 1.6, coalesce(body, 10) * 1.4) AS apart, height > coalesce(body, 10) * 1.15 AND {_heading_shape(d)} AS heading FROM mid),
    outs AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY page, line_no) AS o, CASE WHEN dy IS NOT NULL AND (dy >= apart OR heading) THEN chr(10) ELSE '' END || CASE WHEN heading THEN '## ' ELSE '' END || text
               || CASE WHEN lead(page) OVER (PARTITION BY {key} ORDER BY page, line_no) <> page THEN chr(10) ELSE '' END AS piece FROM judged)
    SELECT {key}, {T.trim(d, d.sub(d.join(d.gather('piece', 'o'), chr(10)), r'\n{3,}', chr(10) + chr(10)))} AS markdown, count(*) AS n_lines FROM outs GROUP BY {key}"""


def markdown(d: Dialect, rel: str, key: str, share: float = 0.6) -> str:
    """IO6, IO7: a document's lines as Markdown: running heads dropped, large short lines as headings, paragraphs apart by their gaps.

    Spark deals the words out by document once and measures the lines in windows: joins would work them out, and ship them, for each side."""
    if d.name == "spark":
        return _measured_in_windows(d, f"(SELECT /*+ REPARTITION({key}) */ * FROM {rel})", key, share)
    k, shape = _head_key(d), _heading_shape(d)
    upper = lambda part, value, rel_: f"(SELECT {part}, {value} AS middle FROM (SELECT {part}, {value}, row_number() OVER (PARTITION BY {part} ORDER BY {value}) AS nth, count(*) OVER (PARTITION BY {part}) AS many FROM {rel_}) u WHERE nth = floor(many / 2) + 1)"
    return f"""WITH ln AS (SELECT *, {k} AS k FROM {page_lines(d, rel, key)} l0),
    tot AS (SELECT {key}, count(DISTINCT page) AS pages FROM ln GROUP BY {key}),
    seen AS (SELECT {key}, k, count(DISTINCT page) AS n FROM ln WHERE length(k) BETWEEN 1 AND 100 GROUP BY {key}, k),
    chrome AS (SELECT s.{key}, s.k FROM seen s JOIN tot t ON s.{key} = t.{key} WHERE s.n >= greatest(2, ceil(t.pages * {d.real(str(share))}))),
    free AS (SELECT ln.* FROM ln LEFT JOIN chrome c ON ln.{key} = c.{key} AND ln.k = c.k WHERE c.k IS NULL),
    body AS {upper(key, 'height', '(SELECT * FROM free WHERE height > 0) f0')},
    kept AS (SELECT *, greatest(0, (lag(y) OVER w) - y) AS gap, (lag(y) OVER w) - y AS dy FROM free WHERE text <> '' WINDOW w AS (PARTITION BY {key}, page ORDER BY line_no)),
    mid AS {upper(f'{key}, page', 'gap', '(SELECT * FROM kept WHERE gap IS NOT NULL) f1')},
    judged AS (SELECT n.*, greatest(coalesce(m.middle, 0) * 1.6, coalesce(b.middle, 10) * 1.4) AS apart, n.height > coalesce(b.middle, 10) * 1.15 AND {shape.replace('text', 'n.text')} AS heading
               FROM kept n LEFT JOIN body b ON n.{key} = b.{key} LEFT JOIN mid m ON n.{key} = m.{key} AND n.page = m.page),
    outs AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY page, line_no) AS o, CASE WHEN dy IS NOT NULL AND (dy >= apart OR heading) THEN chr(10) ELSE '' END || CASE WHEN heading THEN '## ' ELSE '' END || text
               || CASE WHEN lead(page) OVER (PARTITION BY {key} ORDER BY page, line_no) <> page THEN chr(10) ELSE '' END AS piece FROM judged)
    SELECT {key}, {T.trim(d, d.sub(d.join(d.gather('piece', 'o'), chr(10)), r'\n{3,}', chr(10) + chr(10)))} AS markdown, count(*) AS n_lines FROM outs GROUP BY {key}"""
