"""One expression, two engines: SQL fragments rendered for Spark (what runs) and for DuckDB (what it is checked against).

Builders across the library take a Dialect as first argument and return SQL text. Patterns are written once, with the ASCII
word boundary as `\\b` and with `(?i)` for case-insensitive matching; Spark gets the equivalent look-arounds and `(?iu)`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

#: Java's \b takes accented letters as word characters, other engines' does not: both sides spelt out.
_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
#: Around words that begin and end in ASCII word characters the boundary is one look to either side.
_WHOLE = re.compile(r"\\b\(\?:([^()\[\]\\?*+{}]*)\)\\b")
_BEGUN = re.compile(r"(?:[A-Za-z0-9_]|\\d)(?![?*{])|\\d\{[1-9]")


def _ascii(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c == "_")


def _factored(words: list[str]) -> str:
    """Alternatives that share their beginnings, so that a word is not tried against each; none where their order could matter."""
    odd = lambda a, b: len(b) > len(a) and b.startswith(a) and _ascii(a[-1]) != _ascii(b[len(a)])
    if not all(re.fullmatch(r"[^\W_]+(?: [^\W_]+)*", w) for w in words) or any(odd(a, b) for a in words for b in words):
        return ""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def text(at):
        kids = [(c, text(t)) for c, t in at.items() if c]
        single = "".join(c for c, t in kids if not t)
        out = [c + t for c, t in kids if t] + ([single if len(single) == 1 else f"[{single}]"] if single else [])
        if not out:
            return ""
        body = out[0] if len(out) == 1 and ("" not in at or single) else f"(?:{'|'.join(out)})"
        return body + "?" if "" in at else body

    return "|".join(text({c: t}) for c, t in tree.items())


def _whole(m: re.Match) -> str:
    """Whole words: those that begin and end alike under one boundary, which is a look to one side each. Many words are tried only
    where a letter stands that one of them begins with."""
    words, sides = m[1].split("|"), {}
    if not all(words) or not _factored(words):
        plain = all(re.fullmatch("[A-Za-z0-9_](?:.*[A-Za-z0-9_])?", w) for w in words)
        return rf"{_guard(words)}(?<!\w)(?:{m[1]})(?!\w)" if plain else m[0]
    for w in words:
        sides.setdefault((_ascii(w[0]), _ascii(w[-1])), []).append(w)
    parts = [f"(?<{'!' if a else '='}\\w)(?:{_factored(ws)})(?{'!' if z else '='}\\w)" for (a, z), ws in sides.items()]
    guard = _guard(words) if all(a for a, _ in sides) else ""
    return guard + (parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})")


def _guard(words: list[str]) -> str:
    """A look at the letter where a word may begin, of either case: a letter of ASCII, as a boundary before it asks."""
    firsts = {c for w in words for c in (w[0].lower(), w[0].upper())}
    return rf"(?<!\w)(?=(?-i:[{''.join(sorted(firsts))}]))" if len(words) > 3 and all(_ascii(c) for c in firsts) else ""


def _begun(p: str) -> str:
    """p with each boundary that a word character surely follows as one look behind."""
    out, at = "", 0
    for m in re.finditer(r"\\b(?=(\((?:\?:)?)?)", p):
        alts = [p[m.end() :]]
        if m[1]:
            depth, start, alts, n = 0, m.end() + len(m[1]), [], m.end()
            while n < len(p):
                c = p[n]
                if c == "\\":
                    n += 1
                elif c == "[":
                    n = p.index("]", n + 1)
                elif c == "(":
                    depth += 1
                elif c in ")|":
                    if depth == 1:
                        alts.append(p[start:n])
                        start = n + 1
                    depth -= c == ")"
                    if not depth:
                        break
                n += 1
            if p[n + 1 : n + 2] in ("?", "*", "{"):
                continue
        if all(_BEGUN.match(x) for x in alts):
            out += p[at : m.start()] + r"(?<!\w)"
            at = m.end()
    return out + p[at:]


class Dialect:
    name = ""

    def lit(self, s: str) -> str:
        raise NotImplementedError

    def pat(self, p: str) -> str:
        """A pattern as a SQL literal."""
        raise NotImplementedError

    def words(self, values: Sequence[str]) -> str:
        """An array literal of strings."""
        raise NotImplementedError

    def let(self, value: str, f: Callable[[str], str], v: str = "v") -> str:
        """f over a name for value, which is then evaluated once however often f mentions it."""
        return self.at(self.each(self.array(value), f, v), 1)


    def trimmed(self, x: str, f: Callable[[str], str], v: str) -> str:
        """f over x without white space at either end."""
        return self.let(self.trim(x), f, v)


class Spark(Dialect):
    name = "spark"
    #: The name of a column that is trimmed already.
    TRIMMED = "trimmed_"

    def trimmed(self, x, f, v):
        # Trimming anew costs less than a name, for which the planner interprets all of f.
        return f(self.trim(x))

    def lit(self, s):
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"

    def pat(self, p):
        p = _begun(_WHOLE.sub(_whole, p))
        return self.lit(p.replace(r"\b", _EDGE).replace("(?i)", "(?iu)").replace("(?im)", "(?ium)").replace("(?is)", "(?ius)"))

    def has(self, x, p):
        return f"({x} RLIKE {self.pat(p)})"

    def count(self, x, p):
        return f"regexp_count({x}, {self.pat(p)})"

    def all(self, x, p, group=0):
        return f"regexp_extract_all({x}, {self.pat(p)}, {group})"

    def first(self, x, p, group=0):
        return f"regexp_extract({x}, {self.pat(p)}, {group})"

    def sub(self, x, p, to=""):
        return f"regexp_replace({x}, {self.pat(p)}, {self.lit(to)})"

    def trim(self, x):
        """x without white space at either end: a built-in that looks at the ends only, where a pattern would be tried at each character."""
        return x if x == self.TRIMMED else f"trim(BOTH ' \\t\\n\\u000B\\u000C\\r' FROM {x})"

    def squeeze(self, x):
        """x with each run of white space as one space; runs that are one already are left alone."""
        return f"regexp_replace({x}, {self.lit(r'[^\S ]\s*| \s+')}, ' ')"

    def split(self, x, p):
        return f"split({x}, {self.pat(p)}, -1)"

    def keep(self, a, cond: Callable[[str], str], v="x"):
        return f"filter({a}, {v} -> {cond(v)})"

    def each(self, a, f: Callable[[str], str], v="x"):
        return f"transform({a}, {v} -> {f(v)})"

    def each_at(self, a, f: Callable[[str, str], str], v="x", i="i"):
        """f gets the item and its 1-based place."""
        return f"transform({a}, ({v}, {i}) -> {f(v, f'({i} + 1)')})"

    def keep_at(self, a, cond: Callable[[str, str], str], v="x", i="i"):
        """cond gets the item and its 1-based place."""
        return f"filter({a}, ({v}, {i}) -> {cond(v, f'({i} + 1)')})"

    def position(self, a, x):
        """The first 1-based place of x in a, 0 or null without."""
        return f"array_position({a}, {x})"

    def any(self, a, cond: Callable[[str], str], v="x"):
        return f"exists({a}, {v} -> {cond(v)})"

    def fold(self, a, init, step: Callable[[str, str], str], acc="acc", v="x"):
        return f"aggregate({a}, {init}, ({acc}, {v}) -> {step(acc, v)})"

    def words(self, values):
        return "array(" + ", ".join(self.lit(v) for v in values) + ")"

    def array(self, *items):
        return "array(" + ", ".join(items) + ")"

    def empty(self, kind="string"):
        return f"cast(array() AS array<{kind}>)"

    def struct(self, **f):
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in f.items()) + ")"

    def size(self, a):
        return f"size({a})"

    def at(self, a, i):
        return f"try_element_at({a}, cast({i} AS int))"

    def take(self, a, n):
        return f"slice({a}, 1, {n})"

    def top(self, a):
        """(largest item, its first 1-based place)"""
        return f"array_max({a})", f"array_position({a}, array_max({a}))"

    def distinct(self, a):
        return f"array_distinct({a})"

    def both(self, a, b):
        return f"size(array_intersect({a}, {b}))"

    def less(self, a, b):
        """The distinct items of a that b has not."""
        return f"array_except({a}, {b})"

    def has_item(self, a, x):
        return f"array_contains({a}, {x})"

    def one_of(self, x, values):
        """Whether x is one of fixed values, which are looked up and not gone through."""
        return f"({x} IN ({', '.join(self.lit(v) for v in values)}))"

    def append(self, a, x):
        return f"array_append({a}, {x})"

    def join(self, a, sep):
        return f"array_join({a}, {self.lit(sep)})"

    def flat(self, a):
        return f"flatten({a})"

    def concat(self, a, b):
        return f"concat({a}, {b})"

    def sort(self, a):
        return f"sort_array({a})"

    def sha256(self, x):
        return f"sha2({x}, 256)"

    def fmt(self, f, *a):
        return f"format_string({self.lit(f)}, {', '.join(a)})"

    def money(self, x):
        return f"format_number(cast({x} AS decimal(14, 2)), 2)"

    def day(self, ts):
        return f"date_format({ts}, 'yyyy-MM-dd')"

    def explode(self, rel, cols, arr, item="item", pos="pos"):
        """SELECT cols, 1-based pos and item from a relation with an array expression.

        Outer, and empty ones left out afterwards: else the array is worked out once more for a filter below, and once more to be exploded."""
        return f"(SELECT {cols}, {pos}_ + 1 AS {pos}, {item}_ AS {item} FROM {rel} LATERAL VIEW OUTER posexplode({arr}) AS {pos}_, {item}_ WHERE {pos}_ IS NOT NULL)"

    def once(self, rel, **cols):
        """rel with a column more for each expression, worked out once a row. A plain column would be put in again wherever later
        filters mention it."""
        for n, (name, x) in enumerate(cols.items()):
            rel = f"(SELECT * FROM {rel} {name}_{n} LATERAL VIEW OUTER explode(array({x})) AS {name})"
        return rel

    def json_text(self, x, key):
        """The string at a key of a JSON object text, null unless it is a string."""
        v = f"try_variant_get(try_parse_json({x}), '$.{key}', 'variant')"
        return f"CASE WHEN {self.opens(x)} AND schema_of_variant({v}) = 'STRING' THEN get_json_object({x}, '$.{key}') END"

    def opens(self, x):
        """Whether x may be a JSON object. Text that is none is not parsed: a parser's error is slow."""
        return f"{x} RLIKE {self.lit(r'^[ \t\r\n\x{FEFF}]*[{]')}"

    def json_object(self, x):
        return f"coalesce(CASE WHEN {self.opens(x)} THEN schema_of_variant(try_parse_json({x})) LIKE 'OBJECT%' END, false)"

    def json_quote(self, x):
        return f"substr(to_json(array({x})), 2, length(to_json(array({x}))) - 2)"

    def count_if(self, cond):
        return f"count_if({cond})"

    def half_even(self, x, n):
        return f"bround({x}, {n})"

    def gather(self, x, order):
        """An aggregate: the array of x in the order of a key that has no ties."""
        return f"transform(array_sort(collect_list(named_struct('o', {order}, 'v', {x})), (l, r) -> CASE WHEN l.o < r.o THEN -1 WHEN l.o > r.o THEN 1 ELSE 0 END), x -> x.v)"

    def bytes(self, x):
        return f"octet_length({x})"

    def rows(self, names, values):
        """A relation of literal rows."""
        return "(SELECT * FROM VALUES " + ", ".join("(" + ", ".join(v) + ")" for v in values) + f" AS t({', '.join(names)}))"

    def big(self, x):
        return f"cast({x} AS bigint)"

    def real(self, x):
        return f"cast({x} AS double)"

    def text(self, x):
        return f"cast({x} AS string)"

    def seq(self, n):
        """1, 2, ... n as an array; empty for 0."""
        return f"CASE WHEN {n} > 0 THEN sequence(1, cast({n} AS int)) ELSE cast(array() AS array<int>) END"

    def quoted(self, x):
        """A pattern that matches the text x literally, for use with matching_text."""
        return f"concat('\\\\Q', {x}, '\\\\E')"

    def first_by(self, x, pattern_sql):
        return f"regexp_extract({x}, {pattern_sql}, 0)"

    def lit_pat(self, p):
        return self.pat(p)


class Duck(Dialect):
    name = "duckdb"

    def lit(self, s):
        parts = ["'" + p.replace("'", "''") + "'" for p in s.split("\n")]
        return parts[0] if len(parts) == 1 else "(" + " || chr(10) || ".join(parts) + ")"

    def pat(self, p):
        return self.lit(p)

    def has(self, x, p):
        return f"regexp_matches({x}, {self.pat(p)})"

    def count(self, x, p):
        return f"len(regexp_extract_all({x}, {self.pat(p)}))"

    def all(self, x, p, group=0):
        return f"regexp_extract_all({x}, {self.pat(p)}, {group})"

    def first(self, x, p, group=0):
        return f"regexp_extract({x}, {self.pat(p)}, {group})"

    def sub(self, x, p, to=""):
        return f"regexp_replace({x}, {self.pat(p)}, {self.lit(re.sub(r'[$](\d)', r'\\\1', to))}, 'g')"

    def trim(self, x):
        return self.sub(x, r"^\s+|\s+\z")

    def squeeze(self, x):
        return self.sub(x, r"\s+", " ")

    def split(self, x, p):
        return f"string_split_regex({x}, {self.pat(p)})"

    def keep(self, a, cond, v="x"):
        return f"list_filter({a}, lambda {v}: {cond(v)})"

    def each(self, a, f, v="x"):
        return f"list_transform({a}, lambda {v}: {f(v)})"

    def each_at(self, a, f, v="x", i="i"):
        return f"list_transform({a}, lambda {v}, {i}: {f(v, i)})"

    def keep_at(self, a, cond, v="x", i="i"):
        return f"list_filter({a}, lambda {v}, {i}: {cond(v, i)})"

    def position(self, a, x):
        return f"list_position({a}, {x})"

    def any(self, a, cond, v="x"):
        return f"(len(list_filter({a}, lambda {v}: {cond(v)})) > 0)"

    def fold(self, a, init, step, acc="acc", v="x"):
        # list_reduce wants one type: the items are wrapped like the accumulator by the callers that need it.
        return f"list_reduce({a}, lambda {acc}, {v}: {step(acc, v)}, {init})"

    def words(self, values):
        return "[" + ", ".join(self.lit(v) for v in values) + "]"

    def array(self, *items):
        return "[" + ", ".join(items) + "]"

    def empty(self, kind="string"):
        return f"CAST([] AS {'VARCHAR' if kind == 'string' else kind}[])"

    def struct(self, **f):
        return "{" + ", ".join(f"'{k}': {v}" for k, v in f.items()) + "}"

    def size(self, a):
        return f"len({a})"

    def at(self, a, i):
        return f"list_extract({a}, {i})"

    def take(self, a, n):
        return f"({a})[1:{n}]"

    def top(self, a):
        return f"list_max({a})", f"list_position({a}, list_max({a}))"

    def distinct(self, a):
        return f"list_distinct({a})"

    def both(self, a, b):
        return f"len(list_intersect({a}, {b}))"

    def less(self, a, b):
        return f"list_filter(list_distinct({a}), lambda xq: NOT list_contains({b}, xq))"

    def has_item(self, a, x):
        return f"list_contains({a}, {x})"

    def one_of(self, x, values):
        return self.has_item(self.words(values), x)

    def append(self, a, x):
        return f"list_append({a}, {x})"

    def join(self, a, sep):
        return f"array_to_string({a}, {self.lit(sep)})"

    def flat(self, a):
        return f"flatten({a})"

    def concat(self, a, b):
        return f"list_concat({a}, {b})"

    def sort(self, a):
        return f"list_sort({a})"

    def sha256(self, x):
        return f"sha256({x})"

    def fmt(self, f, *a):
        return f"printf({self.lit(f)}, {', '.join(a)})"

    def money(self, x):
        return f"format('{{:,.2f}}', cast(cast({x} AS decimal(14, 2)) AS double))"

    def day(self, ts):
        return f"strftime({ts}, '%Y-%m-%d')"

    def explode(self, rel, cols, arr, item="item", pos="pos"):
        return f"(SELECT {cols}, unnest(generate_series(1, len({arr}))) AS {pos}, unnest({arr}) AS {item} FROM {rel})"

    def once(self, rel, **cols):
        for n, (name, x) in enumerate(cols.items()):
            rel = f"(SELECT *, {x} AS {name} FROM {rel} {name}_{n})"
        return rel

    def json_text(self, x, key):
        return f"CASE WHEN json_valid({x}) THEN CASE WHEN json_type({x}, '$.{key}') = 'VARCHAR' THEN json_extract_string({x}, '$.{key}') END END"

    def json_object(self, x):
        return f"coalesce(CASE WHEN json_valid({x}) THEN json_type({x}) = 'OBJECT' END, false)"

    def json_quote(self, x):
        return f"cast(to_json({x}) AS varchar)"

    def count_if(self, cond):
        return f"count(*) FILTER (WHERE {cond})"

    def half_even(self, x, n):
        return f"round_even({x}, {n})"

    def gather(self, x, order):
        return f"list({x} ORDER BY {order})"

    def bytes(self, x):
        return f"strlen({x})"

    def rows(self, names, values):
        return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(v) + ")" for v in values) + f") AS t({', '.join(names)}))"

    def big(self, x):
        return f"cast({x} AS bigint)"

    def real(self, x):
        return f"cast({x} AS double)"

    def text(self, x):
        return f"cast({x} AS varchar)"

    def seq(self, n):
        return f"generate_series(1, cast({n} AS int))"

    def quoted(self, x):
        return f"regexp_escape({x})"

    def first_by(self, x, pattern_sql):
        return f"regexp_extract({x}, {pattern_sql}, 0)"

    def lit_pat(self, p):
        return self.pat(p)


SPARK, DUCK = Spark(), Duck()
