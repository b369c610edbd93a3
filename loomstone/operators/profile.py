"""Preflight profiling of whole documents: language, format, domain, blocking checks. One projection each, no shuffle."""

from __future__ import annotations

from loomstone.functions import patterns as P
from loomstone.functions import text as T
from loomstone.functions.dialect import Dialect


def blocked(d: Dialect, x: str) -> str:
    """Whether x holds nothing but a hash or a file name, or nothing."""
    t = T.trim(d, x)
    return f"({t} = '' OR {d.has(t, P.HASH_ONLY)} OR {d.has(t, P.FILENAME_ONLY)})"


def language(d: Dialect, sample: str, pt: str, en: str) -> str:
    """pt-BR, en, es or unknown. sample: the first 4,000 characters; pt, en: hit counts over it."""
    return d.let(
        T.profile_language(d, sample),
        lambda own: (
            f"CASE WHEN {pt} >= 3 AND {pt} > {en} THEN 'pt-BR' WHEN {own} = 'pt' THEN 'pt-BR' WHEN {own} IN ('en', 'es') THEN {own}"
            f" WHEN {pt} > {en} AND {pt} >= 1 THEN 'pt-BR' WHEN {en} > 0 THEN 'en' ELSE 'unknown' END"
        ),
        "own",
    )


def profile(d: Dialect, rel: str, key: str = "doc_id", x: str = "text", filename: str = "cast(NULL AS varchar(20))") -> str:
    """PR1: the source profile of each row of rel."""
    if d.name == "spark":
        filename = filename.replace("varchar(20)", "string")
    stem = d.sub(filename, r"\.[^.]+\z")
    return f"""
    SELECT key AS {key}, chars AS source_char_count, words AS source_word_count, blocked,
        CASE WHEN blocked THEN 'unknown' ELSE found_language END AS detected_language,
        CASE WHEN blocked THEN 0 ELSE greatest(1, cast(ceil(chars / {d.real(str(P.CHUNK_CHARS))}) AS int)) END AS estimated_chunks,
        NOT blocked AND words >= 20 AS extraction_looks_valid,
        CASE WHEN blocked THEN 1 ELSE CASE WHEN words < 50 THEN 1 ELSE 0 END + CASE WHEN words < 200 AND hash_name THEN 1 ELSE 0 END
            + CASE WHEN words > 100 AND found_language = 'unknown' THEN 1 ELSE 0 END END AS n_warnings
    FROM (SELECT *, {language(d, 'sample', 'pt', 'en')} AS found_language FROM (SELECT *, {T.portuguese_hits(d, 'sample')} AS pt, {T.english_hits(d, 'sample')} AS en
          FROM (SELECT {key} AS key, coalesce(length({x}), 0) AS chars, {T.word_count(d, f"coalesce({x}, '')")} AS words,
                {blocked(d, f"coalesce({x}, '')")} AS blocked, coalesce(substr({x}, 1, 4000), '') AS sample,
                coalesce({d.has(stem, P.HASH_ONLY)}, false) AS hash_name FROM {rel}) p) q) r"""


def language_hits(d: Dialect, rel: str, key: str = "doc_id", x: str = "text", more: str = "") -> str:
    """PR4, PR5: signal counts of the first 4,000 characters, and the language they give."""
    return f"""SELECT {key}, {more} pt AS pt_hits, en AS en_hits, {language(d, 'sample', 'pt', 'en')} AS detected_language
    FROM (SELECT *, {T.portuguese_hits(d, 'sample')} AS pt, {T.english_hits(d, 'sample')} AS en
          FROM (SELECT *, substr({x}, 1, 4000) AS sample FROM {rel}) p) q"""


def source_format(d: Dialect, rel: str, key: str, x: str = "text") -> str:
    """PR6: format, record count and whether the records are structured, by the first rule that holds."""
    t = "t"
    lines = d.keep(d.split(t, r"\r?\n"), lambda v: f"{T.trim(d, v)} <> ''", "v")
    texty = lambda keys: lambda v: " OR ".join(f"{d.json_text(v, k)} IS NOT NULL" for k in keys)
    parsed = d.size(d.keep("sample", lambda v: d.json_object(v), "v"))
    bearing = d.size(d.keep("sample", texty(P.TEXT_KEYS), "v"))
    jsonl = f"n_lines BETWEEN 2 AND 100000 AND {parsed} >= {d.size('sample')} * 0.9 AND {bearing} >= {d.size('sample')} * 0.5"
    if d.name == "spark":
        elements = "coalesce(CASE WHEN t LIKE '[%' THEN cast(try_variant_get(try_parse_json(t), '$', 'array<string>') AS array<string>) END, array())"
    else:
        elements = "CASE WHEN json_valid(t) THEN CASE WHEN json_type(t) = 'ARRAY' THEN CAST(json_extract(t, '$[*]') AS VARCHAR[]) ELSE [] END ELSE [] END"
    array_bearing = d.size(d.keep("elements", texty(P.TEXT_KEYS[:4]), "v"))
    json_array = f"t LIKE '[%' AND t LIKE '%]' AND {d.size('elements')} > 0 AND {array_bearing} >= {d.size('elements')} * 0.5"
    return f"""
    SELECT {key}, CASE WHEN t = '' THEN 'unknown' WHEN jsonl THEN 'jsonl_records' WHEN json_array THEN 'json_array_records' WHEN faq THEN 'faq'
            WHEN articles >= 5 THEN 'legal_norm' WHEN headings > 0 THEN 'markdown' WHEN clock AND turns > 0 THEN 'transcript' ELSE 'plain_text' END AS detected_format,
        CASE WHEN t = '' THEN 0 WHEN jsonl THEN n_lines WHEN json_array THEN n_elements WHEN faq THEN greatest(1, blocks) WHEN articles >= 5 THEN articles
            WHEN headings > 0 THEN headings WHEN clock AND turns > 0 THEN turns ELSE 0 END AS record_count,
        t <> '' AND (jsonl OR json_array OR faq OR articles >= 5 OR (headings = 0 AND clock AND turns > 0)) AS has_structured_records
    FROM (SELECT {key}, t, n_lines, {jsonl} AS jsonl, {json_array} AS json_array, {d.size('elements')} AS n_elements,
            {d.has(t, P.FAQ_QUESTION)} AND {d.has(t, P.FAQ_ANSWER)} AS faq, {d.count(t, P.FAQ_BLOCK)} AS blocks, {d.count(t, P.ARTICLE_LINE)} AS articles,
            {d.count(t, P.HEADING_LINE)} AS headings, {d.has(t, P.TIME_LINE)} AS clock, {d.count(t, P.SPEAKER_LINE)} AS turns
          FROM (SELECT *, {d.size('lines')} AS n_lines, {d.take('lines', 50)} AS sample, {elements} AS elements
                FROM (SELECT {key}, t, {lines} AS lines FROM (SELECT {key}, {T.trim(d, x)} AS t FROM {rel}) a) b) c) e"""


def domain(d: Dialect, rel: str, key: str, x: str = "text") -> str:
    """PR8: the domain with most distinct keywords as substrings; the first wins ties; general knowledge without any."""
    score = {k: " + ".join(f"CASE WHEN contains(low, {d.lit(w)}) THEN 1 ELSE 0 END" for w in words) for k, words in P.DOMAINS.items()}
    cols = ", ".join(f"{v} AS s{i}" for i, v in enumerate(score.values()))
    best = "greatest(" + ", ".join(f"s{i}" for i in range(len(score))) + ")"
    cases = " ".join(f"WHEN s{i} = {best} THEN {d.lit(k)}" for i, k in enumerate(score))
    return f"SELECT {key}, CASE WHEN {best} = 0 THEN {d.lit(P.NO_DOMAIN)} {cases} END AS domain, {best} AS score FROM (SELECT {key}, {cols} FROM (SELECT {key}, lower({x}) AS low FROM {rel}) a) b"


def domain_language(d: Dialect, rel: str, key: str, x: str = "text") -> str:
    """PR9: pt if its function words outnumber English ones, else en."""
    low = f"lower({x})"
    return f"SELECT {key}, CASE WHEN {d.count(low, T.any_word(P.PT_DOMAIN_WORDS).removeprefix('(?i)'))} > {d.count(low, T.any_word(P.EN_DOMAIN_WORDS).removeprefix('(?i)'))} THEN 'pt' ELSE 'en' END AS domain_language FROM {rel}"


def guessed_language(d: Dialect, rel: str, key: str, x: str = "body") -> str:
    """PR10: a package's language by the function words of its statements and definitions: pt or es if above both others, else en."""
    n = ", ".join(f"sum({d.count(f'lower({x})', T.any_word(w).removeprefix('(?i)'))}) AS {k}" for k, w in P.GUESS_WORDS.items())
    return f"SELECT {key}, cast(pt AS bigint) AS pt_words, cast(es AS bigint) AS es_words, cast(en AS bigint) AS en_words, CASE WHEN pt > en AND pt > es THEN 'pt' WHEN es > en AND es > pt THEN 'es' ELSE 'en' END AS language FROM (SELECT {key}, {n} FROM {rel} WHERE section IN ('atomic_units', 'concepts', 'entities') GROUP BY {key}) g"
