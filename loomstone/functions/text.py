"""Text predicates and measures as SQL expressions over a text expression."""

from __future__ import annotations

from loomstone.functions import patterns as P
from loomstone.functions.dialect import Dialect


def any_word(words: list[str]) -> str:
    return r"(?i)\b(?:" + "|".join(words) + r")\b"


def trim(d: Dialect, x: str) -> str:
    """x without white space at either end."""
    return d.trim(x)


def squeeze(d: Dialect, x: str) -> str:
    """x with each run of white space as one space, none at the ends."""
    return f"trim({d.squeeze(x)})"


def norm(d: Dialect, x: str) -> str:
    """The key under which texts count as equal: lower case, white space squeezed."""
    return squeeze(d, f"lower({x})")


def word_list(d: Dialect, x: str) -> str:
    return d.keep(d.split(x, r"\s+"), lambda w: f"{w} <> ''")


def word_count(d: Dialect, x: str) -> str:
    return d.size(word_list(d, x))


def tokens(d: Dialect, x: str) -> str:
    """Distinct words of 3 letters or digits and more, without stopwords."""
    raw = d.split(d.sub(norm(d, x), r"[^\p{L}\p{N}\s]", " "), r"\s+")
    return d.distinct(d.keep(raw, lambda w: f"length({w}) >= 3 AND NOT {d.one_of(w, sorted(set(P.STOPWORDS)))}", "w"))


def plain_tokens(d: Dialect, x: str) -> str:
    """Distinct words of more than 2 letters or digits, stopwords included."""
    raw = d.split(d.sub(f"lower({x})", r"[^\p{L}\p{N}\s]", " "), r"\s+")
    return d.distinct(d.keep(raw, lambda w: f"length({w}) > 2", "w"))


def jaccard(d: Dialect, a: str, b: str) -> str:
    """Of two arrays without repeats; 0 if either is empty."""
    both = d.both(a, b)
    return f"CASE WHEN {d.size(a)} = 0 OR {d.size(b)} = 0 THEN 0.0D ELSE {d.real(both)} / ({d.size(a)} + {d.size(b)} - {both}) END".replace("0.0D", d.real("0"))


def portuguese_signals(d: Dialect, x: str) -> str:
    return f"({d.has(x, P.PT_ACCENT)} OR {d.has(x, any_word(P.PT_STOPWORDS))})"


def english_signals(d: Dialect, x: str) -> str:
    return d.has(x, any_word(P.EN_STOPWORDS))


def portuguese_hits(d: Dialect, x: str) -> str:
    n = d.count(x, any_word(P.PT_PROFILE_WORDS))
    return f"(CASE WHEN {d.has(x, P.PT_ACCENT_HITS)} THEN 2 ELSE 0 END + CASE WHEN {portuguese_signals(d, x)} THEN 1 ELSE 0 END + least(5, cast(floor({n} / 3.0) AS int)))"


def english_hits(d: Dialect, x: str) -> str:
    n = d.count(x, any_word(P.EN_PROFILE_WORDS))
    return f"(CASE WHEN {english_signals(d, x)} THEN 1 ELSE 0 END + least(5, cast(floor({n} / 5.0) AS int)))"


def profile_language(d: Dialect, x: str) -> str:
    """The language with most function words in x, null below 30 characters or without any; ties by code. Stands in for an n-gram detector."""
    langs = sorted(P.PROFILE_WORDS)
    every = any_word(sorted({w for words in P.PROFILE_WORDS.values() for w in words})).removeprefix("(?i)")
    # One pass finds the words of all languages; how many are whose is counted among them.
    own = lambda k: lambda hits: d.size(d.keep(hits, lambda h: d.one_of(h, P.PROFILE_WORDS[k]), "h"))
    scores = d.let(d.all(f"lower({x})", every), lambda hits: d.array(*(own(k)(hits) for k in langs)), "hits")

    def best(sc):
        most, place = d.top(sc)
        return f"CASE WHEN {most} > 0 THEN {d.at(d.words(langs), place)} END"

    return f"CASE WHEN length({x}) >= 30 THEN {d.let(scores, best, 'sc')} END"


def wrong_language(d: Dialect, x: str, lang: str) -> str:
    """Whether a short text shows the other language's signals only. lang: SQL text, English and Portuguese packages."""
    en, pt = f"(lower({lang}) = 'en' OR lower({lang}) LIKE 'en-%')", f"(lower({lang}) IN ('pt', 'por') OR lower({lang}) LIKE 'pt-%')"
    return d.trimmed(
        x,
        lambda t: (
            f"CASE WHEN {lang} IS NULL OR length({t}) < 12 THEN false"
            f" WHEN {en} THEN {d.has(t, P.PT_ACCENT)} OR ({portuguese_signals(d, t)} AND NOT {english_signals(d, t)})"
            f" WHEN {pt} THEN {english_signals(d, t)} AND NOT {portuguese_signals(d, t)} ELSE false END"
        ),
        "lang_t",
    )


def last_word(d: Dialect, t: str) -> str:
    return f"lower({d.sub(d.first(t, r'\S+\z'), r'[.!?…,;:]+\z')})"


def complete(d: Dialect, x: str) -> str:
    """Whether x reads as a whole proposition."""
    return d.trimmed(
        x,
        lambda t: (
            f"(length({t}) >= 20 AND {d.has(t, P.OPENING)} AND {d.has(t, P.TERMINAL)} AND {d.size(d.split(t, r'\s+'))} >= 4"
            f" AND NOT {d.one_of(last_word(d, t), P.DANGLING_WORDS)}"
            f" AND {d.real('length(' + d.sub(t, r'[^\p{L}]') + ')')} / length({t}) >= 0.6)"
        ),
        "whole_t",
    )


def truncated(d: Dialect, x: str) -> str:
    """Whether x looks cut off."""
    return d.trimmed(
        x,
        lambda t: (
            f"(length({t}) < 12 OR {d.has(t, P.TRAILING_ABBREVIATION)} OR {d.has(t, P.TRAILING_MARK)}"
            f" OR (NOT {d.has(t, P.TERMINAL)} AND {d.size(d.split(t, r'\s+'))} > 3)"
            f" OR {d.one_of(last_word(d, t), P.DANGLING_WORDS)})"
        ),
        "cut_t",
    )


def sentences(d: Dialect, x: str, mark: str = "\x1f") -> str:
    """x cut after . ! or ? that white space follows. Through a marker, as one engine has no look-behind."""
    return d.split(d.sub(x, r"([.!?])\s+", "$1" + mark), mark)


def reject_reason(d: Dialect, x: str, role: str, lang: str) -> str:
    """Why the sanitizer rejects a field's text in a role, or null."""

    def reason(t):
        consistent = f"({lang} IS NULL OR length({t}) < 50 OR coalesce({profile_language(d, t)}, lower({lang})) = lower({lang}))"
        return (
            f"CASE WHEN {t} = '' THEN NULL"
            f" WHEN {wrong_language(d, t, lang)} OR NOT {consistent} THEN 'language_mismatch'"
            f" WHEN {role} IN ('label', 'name', 'title', 'tag') THEN CASE WHEN {d.has(t, P.TRAILING_MARK_LABEL)} OR {d.has(t, P.TRAILING_ABBREVIATION)} THEN 'truncated' END"
            f" WHEN {role} = 'substantive' THEN CASE WHEN {truncated(d, t)} THEN 'truncated' WHEN length({t}) > 20 AND NOT {complete(d, t)} THEN 'incomplete_proposition' END END"
        )

    return d.trimmed(x, reason, "field_t")
