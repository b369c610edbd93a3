"""Row generators: documents to records, sections, headings and chunks."""

from __future__ import annotations

from loomstone.functions import patterns as P
from loomstone.functions import text as T
from loomstone.functions.dialect import Dialect

MARK = "\x1e"


def span_id(d: Dialect, n: str) -> str:
    """s_001, s_002, ...; longer past 999."""
    return d.fmt("s_%03d", n)


def lines(d: Dialect, rel: str, key: str, x: str = "text") -> str:
    """Each line with its 1-based number."""
    return d.explode(f"(SELECT {key}, {d.split(x, r'\r?\n')} AS ls FROM {rel}) l0", key, "ls", "line", "line_no")


def jsonl(d: Dialect, rel: str, key: str, x: str = "text") -> str:
    """SG2: one span per JSON object line with text; ids, offsets (one for each line end) and digest."""
    body = "coalesce(" + ", ".join(f"nullif({d.json_text('line', k)}, '')" for k in P.TEXT_KEYS) + ")"
    rid = "coalesce(" + ", ".join(f"nullif({d.json_text('line', k)}, '')" for k in ("_id", "id", "question", "title")) + ")"
    return f"""
    SELECT {key}, {span_id(d, 'n')} AS span_id, 'jsonl_record' AS source_type, rid AS source_record_id, coalesce(rid, {d.fmt('record[%d]', 'n - 1')}) AS path,
        title, body AS text, line_no AS line_start, char_start, char_start + length(line) AS char_end, {d.sha256('body')} AS text_sha256
    FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY line_no) AS n
          FROM (SELECT {key}, line_no, line, cast(ends - length(line) - 1 AS bigint) AS char_start, {body} AS body, {rid} AS rid, nullif({d.json_text('line', 'title')}, '') AS title
                FROM (SELECT *, sum(length(line) + 1) OVER (PARTITION BY {key} ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS ends FROM {lines(d, rel, key, x)} a) b
                WHERE {d.json_object('line')}) c
          WHERE body IS NOT NULL AND {T.trim(d, 'body')} <> '') e"""


def json_array(d: Dialect, rel: str, key: str, x: str = "text") -> str:
    """SG3: one span per object with text of a JSON array."""
    if d.name == "spark":
        elements = f"coalesce(cast(try_variant_get(try_parse_json({x}), '$', 'array<string>') AS array<string>), array())"
    else:
        elements = f"CASE WHEN json_valid({x}) THEN CASE WHEN json_type({x}) = 'ARRAY' THEN CAST(json_extract({x}, '$[*]') AS VARCHAR[]) ELSE [] END ELSE [] END"
    body = "coalesce(" + ", ".join(f"nullif({d.json_text('line', k)}, '')" for k in P.TEXT_KEYS[:4]) + ")"
    rid = "coalesce(" + ", ".join(f"nullif({d.json_text('line', k)}, '')" for k in ("_id", "id")) + ")"
    items = d.explode(f"(SELECT {key}, {elements} AS els FROM {rel}) a0", key, "els", "line", "line_no")
    return f"""
    SELECT {key}, {span_id(d, 'n')} AS span_id, 'json_array_record' AS source_type, rid AS source_record_id, coalesce(rid, {d.fmt('array[%d]', 'n - 1')}) AS path, body AS text, {d.sha256('body')} AS text_sha256
    FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY line_no) AS n
          FROM (SELECT {key}, line_no, {body} AS body, {rid} AS rid FROM {items} b WHERE {d.json_object('line')}) c WHERE body IS NOT NULL AND {T.trim(d, 'body')} <> '') e"""


def _ancestors(d: Dialect, depth: str, title: str, part: str, order: str) -> str:
    """Columns at1..at5, up2..up5 and last: the latest heading of each depth with its title, the place of the latest shallower one, and
    the latest heading of all. A running maximum of (place, title) carries titles along, so that no heading is looked up again."""
    w = f"OVER (PARTITION BY {part} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    cols = [f"max(CASE WHEN {depth} = {k} THEN {d.struct(place=order, title=title)} END) {w} AS at{k}" for k in range(1, 6)]
    cols += [f"max(CASE WHEN {depth} < {k} THEN {order} END) {w} AS up{k}" for k in range(2, 6)]
    return ", ".join([*cols, f"max(CASE WHEN {depth} IS NOT NULL THEN {d.struct(place=order, depth=depth, title=title)} END) {w} AS last"])


def _crumbs() -> str:
    """The path of the latest heading: above its own depth the latest heading of each depth that no shallower one has ended, or a filler."""
    above = [f"CASE WHEN last.depth > {k} THEN " + (f"CASE WHEN at{k}.place > coalesce(up{k}, 0) THEN at{k}.title ELSE '…' END" if k > 1 else "coalesce(at1.title, '…')") + " END" for k in range(1, 6)]
    return f"CASE WHEN last IS NULL THEN 'document' ELSE concat_ws(' > ', {', '.join(above)}, last.title) END"


def sections(d: Dialect, rel: str, key: str, x: str = "text") -> str:
    """SG4: heading-scoped sections with their breadcrumb; a preamble without text is dropped.

    One window over the lines and one grouping of what it gives, both by document: lines move once."""
    ln = lines(d, rel, key, x)
    head = r"^(#{1,6})\s+(.+?)\s*\z"
    marked = f"(SELECT *, CASE WHEN {d.has('line', head)} THEN length({d.first('line', head, 1)}) END AS depth, CASE WHEN {d.has('line', head)} THEN {T.trim(d, d.first('line', head, 2))} END AS title FROM {ln} m0)"
    run = f"(SELECT *, count(depth) OVER (PARTITION BY {key} ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS sec, {_ancestors(d, 'depth', 'title', key, 'line_no')} FROM {marked} m1)"
    joined = d.join(d.gather("CASE WHEN depth IS NULL THEN line ELSE '' END", "line_no"), MARK)
    secs = f"""(SELECT {key}, sec, coalesce(max(CASE WHEN depth IS NOT NULL THEN line_no END), 1) AS line_start, max(title) AS title, max(path) AS path, {T.trim(d, f"replace({joined}, chr(30), chr(10))")} AS body
        FROM (SELECT {key}, sec, line_no, line, depth, title, {_crumbs()} AS path FROM {run} m2) m3 GROUP BY {key}, sec)"""
    return f"""
    SELECT {key}, {span_id(d, f'row_number() OVER (PARTITION BY {key} ORDER BY sec)')} AS span_id, 'markdown_section' AS source_type, path, title AS heading, line_start,
        text, {d.sha256('text')} AS text_sha256
    FROM (SELECT *, CASE WHEN title IS NULL THEN body ELSE {T.trim(d, "title || chr(10) || chr(10) || body")} END AS text FROM {secs} s0 WHERE title IS NOT NULL OR body <> '') s"""


def cut_before(d: Dialect, rel: str, key: str, marker: str, x: str = "text") -> str:
    """Pieces of x, each but the first beginning at a line that the marker pattern starts; blank ones dropped, numbered from 1."""
    cut = d.split(d.sub(x, r"(?im)^(\s*" + marker + ")", MARK + "$1"), MARK)
    return f"(SELECT {key}, piece, row_number() OVER (PARTITION BY {key} ORDER BY p) AS n FROM (SELECT {key}, p, {T.trim(d, 'item')} AS piece FROM {d.explode(f'(SELECT {key}, {cut} AS ps FROM {rel}) c0', key, 'ps', 'item', 'p')} c1) c2 WHERE piece <> '')"


def legal(d: Dialect, rel: str, key: str, x: str = "text") -> str:
    """SG5: one span per article."""
    rid = f"CASE WHEN {d.has('piece', r'^Art\.\s*(\d+\w*)')} THEN 'Art. ' || {d.first('piece', r'^Art\.\s*(\d+\w*)', 1)} END"
    return f"""SELECT {key}, {span_id(d, 'n')} AS span_id, 'legal_article' AS source_type, rid AS source_record_id, coalesce(rid, {d.fmt('section[%d]', 'n - 1')}) AS path, piece AS text, {d.sha256('piece')} AS text_sha256
    FROM (SELECT *, {rid} AS rid FROM {cut_before(d, rel, key, r'Art\.\s*\d+', x)} a) b"""


def faq(d: Dialect, rel: str, key: str, x: str = "text") -> str:
    """SG6: one span per question, titled by it."""
    q = r"(?i)^(?:Q:|P:|Pergunta\s*[:\-—]|Question\s*[:\-—])\s*(.+?)(?:\n|\z)"
    title = f"CASE WHEN {d.has('piece', q)} THEN substr({T.trim(d, d.first('piece', q, 1))}, 1, 200) END"
    return f"""SELECT {key}, {span_id(d, 'n')} AS span_id, 'faq_pair' AS source_type, title, coalesce(title, {d.fmt('qa[%d]', 'n - 1')}) AS path, piece AS text, {d.sha256('piece')} AS text_sha256
    FROM (SELECT *, {title} AS title FROM {cut_before(d, rel, key, r'(?:Q:|P:|Pergunta\s*[:\-—]|Question\s*[:\-—])', x)} a) b"""


def plain(d: Dialect, rel: str, key: str, x: str = "text") -> str:
    """SG7: the whole trimmed document as one span; none for a blank one."""
    return f"""SELECT {key}, 's_001' AS span_id, 'document' AS source_type, 'document' AS path, length(t) AS char_end, {d.size(d.split('t', r'\r?\n'))} AS line_end, {d.sha256('t')} AS text_sha256
    FROM (SELECT {key}, {T.trim(d, x)} AS t FROM {rel}) a WHERE t <> ''"""


def manifest(d: Dialect, rel: str) -> str:
    """IO24: spans without their text, with a preview of 200 characters."""
    return f"SELECT doc_id, span_id AS source_id, source_type, path, text_sha256, substr({T.squeeze(d, 'text')}, 1, 200) AS text_preview FROM {rel}"


def heading(d: Dialect, rel: str, x: str = "line") -> str:
    """CH2: rel with (depth, title) of a line as a heading: depth null if it is none, 7 for a rule. A line is trimmed and stripped once."""
    md = r"^(#{1,6})\s+(.+?)\s*\z"
    letters = f"length({d.sub('bare_', r'[^\p{L}]')})"
    open_end = f"NOT {d.has('t_', r'[.!?]\z')}"
    dots = "length(t_) - length(replace(t_, '.', ''))"
    # What costs nothing to see comes first: marks, digits, a letter in lower case.
    depth = (
        f"CASE WHEN t_ = '' THEN NULL WHEN mark_ <> '' THEN length(mark_)"
        f" WHEN {d.has('t_', r'(?i)^(cap[íi]tulo|chapter|cap\.)\s+\d+([\s:.\-—–].*)?\z')} THEN 2"
        f" WHEN {d.has('t_', r'(?i)^(parte|part)\s+[ivxlcdm0-9]+([\s:.\-—–].*)?\z')} THEN 1"
        f" WHEN substr(t_, 1, 1) BETWEEN '0' AND '9' AND {d.has('t_', r'^\d+(\.\d+){0,3}\.?\s+\S.{2,80}\z')} AND {open_end} THEN least(6, 3 + {dots})"
        f" WHEN {d.has('t_', r'^[_\-=]{3,}\z')} THEN 7"
        f" WHEN bare_ = upper(bare_) AND {letters} BETWEEN 6 AND 80 AND {d.size(d.split('bare_', r'\s+'))} >= 2 AND {open_end} THEN 2 END"
    )
    seen = d.once(rel, t_=T.trim(d, x))
    seen = d.once(seen, mark_=f"CASE WHEN t_ LIKE '#%' THEN {d.first('t_', md, 1)} ELSE '' END", bare_=T.trim(d, d.sub("t_", r"[^\p{L}\p{N}\s]+")))
    return d.once(seen, depth=f"cast({depth} AS int)", title=f"CASE WHEN mark_ <> '' THEN {T.trim(d, d.first('t_', md, 2))} ELSE t_ END")


def headings(d: Dialect, rel: str, key: str, x: str = "text") -> str:
    """CH2 over all lines: those that are headings or rules."""
    return f"SELECT {key}, line_no, depth, title FROM {heading(d, lines(d, rel, key, x))} b WHERE depth IS NOT NULL"


def pack(d: Dialect, rel: str, key: str, x: str, most: int, gap: str = r"\n\n+", carry: str = "") -> str:
    """CH1: paragraphs of x packed greedily to at most `most` characters a chunk; a longer paragraph stays whole. carry: more columns of rel."""
    carry = f", {carry}" if carry else ""
    t = T.trim(d, d.sub(d.sub(d.sub(x, "\r\n", "\n"), " ", " "), r"\n{4,}", "\n\n\n"))
    glue = "chr(10) || chr(10)"
    item = lambda v: d.struct(buf=v, done=d.empty())
    start = d.struct(buf=d.text("''"), done=d.empty())

    def step(acc, v):
        full = f"length({acc}.buf || {glue} || {v}.buf) > {most} AND {acc}.buf <> ''"
        return d.struct(
            buf=f"CASE WHEN {full} THEN {v}.buf WHEN {acc}.buf = '' THEN {v}.buf ELSE {acc}.buf || {glue} || {v}.buf END",
            done=f"CASE WHEN {full} THEN {d.append(f'{acc}.done', f'{acc}.buf')} ELSE {acc}.done END",
        )

    folded = d.fold(d.each("ps", item, "p"), start, step)
    whole = f"(SELECT {key}{carry}, CASE WHEN length(t) <= {most} THEN {d.array('t')} ELSE {d.append('f.done', 'f.buf')} END AS cs FROM (SELECT {key}{carry}, t, {folded} AS f FROM (SELECT {key}{carry}, t, {d.split('t', gap)} AS ps FROM (SELECT {key}{carry}, {t} AS t FROM {rel}) p0) p1) p2)"
    out = d.explode(f"{whole} p3", f"{key}{carry}", "cs", "item", "n")
    return f"""SELECT {key}{carry}, n, {span_id(d, 'n')} AS span_id, length(text) AS chars, cast(sum(length(text)) OVER (PARTITION BY {key} ORDER BY n ROWS UNBOUNDED PRECEDING) - length(text) AS bigint) AS char_start, {d.sha256('text')} AS text_sha256
    FROM (SELECT {key}{carry}, n, {T.trim(d, 'item')} AS text FROM {out} a) b WHERE text <> ''"""


def headed_sections(d: Dialect, rel: str, key: str, x: str = "text") -> str:
    """CH3: (key, sec, path, heading, text) of each part between headings, the heading's line kept; a rule ends a part and leaves
    the path as it is. The path has, for each depth above the heading's own, the latest heading of it that no shallower one has
    ended, or a filler."""
    flat = T.trim(d, d.sub(d.sub(d.sub(x, "\r\n", "\n"), "\u00a0", " "), r"\n{4,}", "\n\n\n"))
    marked = f"(SELECT {key}, line_no, line, depth, title FROM {heading(d, lines(d, f'(SELECT {key}, {flat} AS text FROM {rel}) n0', key))} n1)"
    own = "CASE WHEN depth < 7 THEN least(depth, 6) END"
    run = f"(SELECT *, count(depth) OVER (PARTITION BY {key} ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS sec, {_ancestors(d, 'own', 'title', key, 'line_no')} FROM (SELECT *, {own} AS own FROM {marked} n2) n3)"
    # The latest heading is the same on all lines of a section: its own, or after a rule the one before it.
    joined = d.join(d.gather("CASE WHEN depth = 7 THEN '' ELSE line END", "line_no"), MARK)
    secs = f"""(SELECT {key}, sec, max(path) AS path, max(heading) AS heading, {T.trim(d, f"replace({joined}, chr(30), chr(10))")} AS text
        FROM (SELECT {key}, sec, line_no, line, depth, {_crumbs()} AS path, last.title AS heading FROM {run} n4) n5 GROUP BY {key}, sec)"""
    return f"SELECT {key}, sec, path, heading, text FROM {secs} s WHERE text <> ''"


def chunks(d: Dialect, rel: str, key: str, most: int, x: str = "text") -> str:
    """CH1 over CH3: each part between headings, packed by paragraphs where it is longer than `most`; parts of one section are numbered in their path."""
    packed = pack(d, f"({headed_sections(d, rel, key, x)}) h9", f"{key}, sec", "text", most, carry="path, heading")
    return f"""SELECT {key}, {span_id(d, f'row_number() OVER (PARTITION BY {key} ORDER BY sec, n)')} AS span_id, CASE WHEN many > 1 THEN path || ' · part ' || {d.text('n')} ELSE path END AS path, heading, chars, text_sha256
    FROM (SELECT *, count(*) OVER (PARTITION BY {key}, sec) AS many FROM ({packed}) p) q"""


def rough_sections(d: Dialect, rel: str, key: str, filename: str = "'Document'", x: str = "text") -> str:
    """CH4: (key, sec, title, body) of what stands between # headings and lines in capitals; parts without a body are dropped."""
    head = f"({d.has('line', r'^(?:#{1,6}\s+|[A-Z][A-Z\s]{4,}\z)')} AND length({T.trim(d, 'line')}) < 120)"
    run = f"(SELECT *, count(CASE WHEN {head} THEN 1 END) OVER (PARTITION BY {key} ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS sec FROM {lines(d, rel, key, x)} a)"
    title = f"coalesce(max(CASE WHEN {head} THEN {T.trim(d, d.sub('line', r'^#{1,6}\s+'))} END), {filename})"
    return f"SELECT * FROM (SELECT {key}, sec, {title} AS title, {T.trim(d, d.join(d.gather(f"CASE WHEN {head} THEN '' ELSE line END", 'line_no'), chr(10)))} AS body FROM {run} b GROUP BY {key}, sec) c WHERE body <> ''"
