"""Article filters: short strings turned into Column predicates once, on the driver.

A filter reads ``[!]target.[generator.]operator.value``. Each becomes two columns, whether
it matches and whether it fails. A row is kept if no filter fails and every filter holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import and_, eq, ge, gt, le, lt, ne, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The words of the filter notation.
OPERATORS = {"eq": eq, "ne": ne, "gt": gt, "gte": ge, "lt": lt, "lte": le}
GENERATORS = ("len", "sim", "regex", "contains", "count", "empty")
WILDCARD = "*"

# The fields an article shows to filters, in the order a wildcard tries them.
ARTICLE_FIELDS = ("title", "content", "link")


class FilterError(ValueError):
    """A filter string that cannot be read."""


@dataclass(frozen=True)
class Filter:
    target: str
    generator: str
    operator: str
    value: str
    negate: bool = False


_OP, _GEN = "|".join(OPERATORS), "|".join(GENERATORS)
# A generator alone looks at all fields; its value then holds no dot. Anything else names a target first.
_NOTATION = re.compile(
    rf"(?P<all>{_GEN})\.(?P<op0>{_OP})\.(?P<value0>[^.]*)"
    rf"|(?P<field>[^.]*)\.(?:(?P<gen>(?:{_GEN})?)\.)?(?P<op>{_OP})\.(?P<value>.*)",
    re.DOTALL,
)


def parse_filter(text: str) -> Filter:
    found = _NOTATION.fullmatch(text.removeprefix("!"))
    if found is None:
        raise FilterError(f"cannot read {text!r} as a filter")
    negate = text.startswith("!")
    if found["all"]:
        return Filter(WILDCARD, found["all"], found["op0"], found["value0"], negate)
    return Filter(found["field"] or WILDCARD, found["gen"] or "", found["op"], found["value"], negate)


def parse_filters(texts: Iterable[str]) -> list[Filter]:
    return [parse_filter(t) for t in texts]


# --- regular expressions ---------------------------------------------------

# Word edges by ASCII word characters, whatever the Java release takes them to be.
_WORD_EDGES = {
    "b": r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))",
    "B": r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))",
}
# Letters that also match a sign outside of ASCII when case is ignored say nothing of word edges.
_WORD_CHARACTER = re.compile(r"[A-JL-RT-Za-jl-rt-z0-9_]")
# Classes that hold a shorthand and its opposite hold every character.
_ANY_CHARACTER = re.compile(r"\[(?:\\s\\S|\\S\\s|\\d\\D|\\D\\d|\\w\\W|\\W\\w)\]")
_POSIX_CLASS = re.compile(r"\[:(\^?)([a-z]+):\]")
_REPEAT = re.compile(r"[*+?]|\{(\d+)(?:(,)(\d*))?\}")
_GROUP = re.compile(r"\(\?(?:P?<(\w+)>|([imsU]*)(-[imsU]+)?([:)]))", re.ASCII)
_ESCAPE = re.compile(r"\\(?:x\{([0-9A-Fa-f]+)\}|x([0-9A-Fa-f]{2})|(0[0-7]{0,2}|[1-7][0-7]{1,2})|([pP])(?:\{(\^?)(\w+)\}|(\w))|(.))", re.DOTALL)
_SPACE = r"\t\n\f\r "
# The largest count a repetition may ask for.
_MOST_REPEATS = 1000


class _BadPattern(ValueError):
    pass


def _posix(found: re.Match) -> str:
    name = {"ascii": "ASCII", "xdigit": "XDigit"}.get(found[2], found[2].capitalize())
    sign = "P" if found[1] else "p"
    if name == "Word":
        return r"\W" if found[1] else r"\w"
    return rf"\{sign}{{{name}}}"


def _literal(c: str) -> str:
    return c if c.isalnum() or not c.isascii() else f"\\x{ord(c):02x}"


def _escape(found: re.Match, in_class: bool) -> str:
    """One escape of the filter notation as Java writes it."""
    code, pair, octal, sign, caret, name, letter, c = found.groups()
    if code or pair or octal:
        value = int(octal, 8) if octal else int(code or pair, 16)
        if value > 0x10FFFF:
            raise _BadPattern
        return f"\\x{{{value:x}}}"
    if sign:
        name = name or letter
        sign = {"p": "P", "P": "p"}[sign] if caret else sign
        return rf"\{sign}{{{name if len(name) < 3 else 'Is' + name}}}"
    if c in "dDwW":
        return rf"\{c}"
    if c in "sS":
        return f"[{'^' if c == 'S' else ''}{_SPACE}]"
    if c in "aftnrv":
        return r"\x0b" if c == "v" else rf"\{c}"
    if not in_class and c in _WORD_EDGES:
        return _WORD_EDGES[c]
    if not in_class and c in "Az":
        return rf"(?:\{c})"
    if c.isascii() and not c.isalnum():
        return _literal(c)
    raise _BadPattern


def _char_class(pattern: str, i: int) -> tuple[str, int]:
    """The class that opens at i, and where it ends."""
    out, i = ["["], i + 1
    if pattern[i : i + 1] == "^":
        out, i = ["[^"], i + 1
    first = True
    while first or pattern[i : i + 1] != "]":
        if i >= len(pattern):
            raise _BadPattern
        if (posix := _POSIX_CLASS.match(pattern, i)) is not None:
            out.append(_posix(posix))
            i = posix.end()
        elif pattern[i] == "\\":
            found = _ESCAPE.match(pattern, i)
            if found is None:
                raise _BadPattern
            out.append(_escape(found, in_class=True))
            i = found.end()
        elif pattern[i] == "-" and not first and pattern[i - 1] != "-" and pattern[i + 1 : i + 2] not in ("", "]"):
            out.append("-")
            i += 1
        else:
            out.append(_literal(pattern[i]))
            i += 1
        first = False
    return "".join(out) + "]", i + 1


def _word_edge(pattern: str, i: int, before: str) -> str:
    """A word edge at i, after the atom ``before``. Next to a character of a word it is no more than a look at the other side."""
    ahead, repeat = pattern[i + 2 : i + 3], pattern[i + 3 : i + 4]
    if _WORD_CHARACTER.fullmatch(ahead) and repeat not in ("*", "?", "{"):
        return r"(?<!\w)"
    return r"(?!\w)" if _WORD_CHARACTER.fullmatch(before) else _WORD_EDGES["b"]


def _translated(pattern: str) -> str:
    # Per open group: whether ^ and $ stand for lines. Laziness and names do not change what matches.
    lines, names = [False], set()
    out, i, repeatable, repeated = [], 0, False, False
    while i < len(pattern):
        c, unit, atom = pattern[i], "", True
        if (repeat := _REPEAT.match(pattern, i)) is not None:
            low, comma, high = repeat.groups()
            counts = [int(n) for n in (low, high) if n]
            if not repeatable or repeated or (counts and (max(counts) > _MOST_REPEATS or counts != sorted(counts))):
                raise _BadPattern
            out.append(repeat[0])
            i = repeat.end()
            i += pattern[i : i + 1] == "?"
            repeated = True
            continue
        if pattern.startswith(r"\Q", i):
            end = pattern.find(r"\E", i + 2)
            end, after = (len(pattern), len(pattern)) if end < 0 else (end, end + 2)
            unit, i = "".join(map(_literal, pattern[i + 2 : end])), after
            if not unit:
                continue
        elif c == "\\":
            found = _ESCAPE.match(pattern, i)
            if found is None:
                raise _BadPattern
            edge = found[0] == r"\b"
            unit = _word_edge(pattern, i, out[-1] if out else "") if edge else _escape(found, in_class=False)
            i = found.end()
        elif (any_character := _ANY_CHARACTER.match(pattern, i)) is not None:
            unit, i = "(?s:.)", any_character.end()
        elif c == "[":
            unit, i = _char_class(pattern, i)
        elif pattern.startswith("(?", i):
            group = _GROUP.match(pattern, i)
            if group is None or (group[1] and group[1] in names) or group[0] == "(?)":
                raise _BadPattern
            name, on, off, close = group.groups()
            names.add(name)
            by_line = lines[-1]
            if not name:
                by_line = "m" in on or (by_line and "m" not in (off or ""))
                put = "".join({"i": "iu", "s": "s"}.get(f, "") for f in on)
                drop = "".join(f for f in (off or "") if f in "is")
                unit = f"(?{put}{'-' + drop if drop else ''}{close}" if put or drop else ("(?:" if close == ":" else "")
            else:
                unit = "("
            if close == ")":
                lines[-1] = by_line
            else:
                lines.append(by_line)
            i, atom = group.end(), False
        elif c == "(":
            lines.append(lines[-1])
            unit, i, atom = "(", i + 1, False
        elif c == ")":
            if len(lines) == 1:
                raise _BadPattern
            lines.pop()
            unit, i = ")", i + 1
        elif c == "|":
            unit, i, atom = "|", i + 1, False
        elif c == "^":
            unit, i = (r"(?:\A|(?<=\n))" if lines[-1] else r"(?:\A)"), i + 1
        elif c == "$":
            unit, i = (r"(?=\n|\z)" if lines[-1] else r"(?:\z)"), i + 1
        elif c == ".":
            unit, i = ".", i + 1
        else:
            unit, i = _literal(c), i + 1
        out.append(unit)
        repeatable, repeated = atom, False
    if len(lines) > 1:
        raise _BadPattern
    return "(?d)" + "".join(out)


def java_pattern(pattern: str) -> str | None:
    """The pattern for Spark's matcher, or None if it is not a valid one of the notation, which
    has no look-around, back-references or possessive repetition.

    Only a line feed ends a line, white space leaves out the vertical tab, a plain ``$`` is the
    very end of the text, and ignoring case goes for all letters.
    """
    try:
        translated = _translated(pattern)
    except _BadPattern:
        return None
    return translated if _compiles(translated) else None


@lru_cache(maxsize=4096)
def _compiles(pattern: str) -> bool:
    """Whether Spark's matcher takes the pattern; constants fold, so no job runs."""
    session = SparkSession.getActiveSession()
    try:
        session.sql("SELECT '' RLIKE :pattern", {"pattern": pattern}).collect()
    except Exception as problem:  # noqa: BLE001 - the error class differs between clients
        if "PATTERN" in str(problem).upper():
            return False
        raise
    return True


# --- compilation -----------------------------------------------------------

def _never() -> Column:
    return F.lit(False)


def _compare(f: Filter, field: Column) -> tuple[Column, bool]:
    """(match, fails) of one filter on one field."""
    compare = OPERATORS[f.operator]
    if f.generator == "":
        return compare(field, F.lit(f.value)), False
    if f.generator == "len":
        if not re.fullmatch(r"[+-]?[0-9]+", f.value) or abs(int(f.value)) >= 2**63:
            return _never(), True
        return compare(F.octet_length(field).cast("bigint"), F.lit(int(f.value)).cast("bigint")), False
    if f.generator in ("sim", "count"):
        return _never(), True
    # Boolean generators: the value is the pattern or needle, and the test is against true.
    if f.operator not in ("eq", "ne"):
        return _never(), True
    if f.generator == "regex":
        pattern = java_pattern(f.value)
        if pattern is None:
            return _never(), True
        holds = field.rlike(pattern)
    elif f.generator == "contains":
        holds = F.contains(field, F.lit(f.value))
    else:
        holds = field == ""
    return (holds if f.operator == "eq" else ~holds), False


def compile_filter(f: Filter, fields: Iterable[str] = ARTICLE_FIELDS) -> tuple[Column, bool]:
    """(passes, fails). An unknown target is never looked at: it cannot match and cannot
    fail. Missing text counts as empty."""
    fields = list(fields)
    targets = fields if f.target == WILDCARD else [t for t in fields if t == f.target]
    tests = [_compare(f, F.coalesce(F.col(t), F.lit(""))) for t in targets]
    match = reduce(or_, [m for m, _ in tests], _never())
    return (~match if f.negate else match), any(fails for _, fails in tests)


def keep_condition(filters: Iterable[Filter], fields: Iterable[str] = ARTICLE_FIELDS) -> Column:
    """True for rows all filters let through. A failing filter rejects, negated or not."""
    compiled = [compile_filter(f, fields) for f in filters]
    return reduce(and_, [_never() if fails else passes for passes, fails in compiled], F.lit(True))


def resolve_filters(
    per_source: dict[str, list[str]], default: list[str] = (), *, inherit: bool = True
) -> dict[str, list[Filter]]:
    """url -> filters. A non-empty list replaces the default; an empty one inherits it,
    unless ``inherit`` is off."""
    out = {}
    for url, own in per_source.items():
        texts = list(own) or (list(default) if inherit else [])
        if texts:
            out[url] = parse_filters(texts)
    return out


def filter_condition(
    by_url: dict[str, list[Filter]], url: Column, fields: Iterable[str] = ARTICLE_FIELDS
) -> Column:
    """One predicate over rows of many sources. Sources that share a filter list share a
    branch, so the plan grows with the number of different lists, not of sources."""
    groups: dict[tuple[Filter, ...], list[str]] = {}
    for source_url, filters in by_url.items():
        groups.setdefault(tuple(filters), []).append(source_url)
    fields = list(fields)
    condition = None
    for filters, urls in groups.items():
        keep = keep_condition(filters, fields)
        condition = F.when(url.isin(urls), keep) if condition is None else condition.when(url.isin(urls), keep)
    return F.lit(True) if condition is None else condition.otherwise(F.lit(True))


def apply_filters(
    articles: DataFrame,
    by_url: dict[str, list[Filter]],
    url_column: str = "source_url",
    fields: Iterable[str] = ARTICLE_FIELDS,
) -> DataFrame:
    """Articles their source's filters let through; sources without filters keep all."""
    return articles.filter(filter_condition(by_url, F.col(url_column), fields))


# How many different filters a table of sources may hold: each is a predicate of the plan.
MOST_FILTERS = 2_000
# Bits of one mask word; the sign stays out of it.
_WORD_BITS = 62


@dataclass(frozen=True)
class FilterTable:
    """Filters of any number of sources: the different ones, and per url which of them apply, as bits."""

    filters: tuple[Filter, ...]
    masks: DataFrame


def filter_table(sources: DataFrame, default: Iterable[str] = (), *, inherit: bool = True) -> FilterTable:
    """From (url, filters array<string>), one row a source. A non-empty list replaces the default; an empty one
    inherits it, unless ``inherit`` is off. Only the different filters come to the driver, to be read there;
    more than MOST_FILTERS are an error."""
    fallback = F.array(*map(F.lit, default)) if inherit and list(default) else F.array()
    own = F.coalesce("filters", F.array().cast("array<string>"))
    lists = sources.select("url", F.when(F.size(own) > 0, own).otherwise(fallback.cast("array<string>")).alias("texts"))
    rows = lists.select(F.explode("texts").alias("text")).distinct().limit(MOST_FILTERS + 1).collect()
    if len(rows) > MOST_FILTERS:
        raise ValueError(f"more than {MOST_FILTERS} different filters")
    texts = sorted(r["text"] for r in rows)
    wanted = lists.filter(F.size("texts") > 0)
    place = F.array_position(F.array(*map(F.lit, texts)).cast("array<string>"), F.col("text")) - 1
    bits = wanted.select("url", F.explode(F.array_distinct("texts")).alias("text")).select("url", place.cast("int").alias("at"))
    words = -(-len(texts) // _WORD_BITS)
    word = lambda w: F.expr(f"bit_or(CASE WHEN at DIV {_WORD_BITS} = {w} THEN shiftleft(1L, at % {_WORD_BITS}) ELSE 0L END)")
    masks = bits.groupBy("url").agg(F.array(*[word(w) for w in range(words)]).cast("array<bigint>").alias("mask"))
    return FilterTable(tuple(parse_filters(texts)), masks)


def apply_filter_table(
    articles: DataFrame, table: FilterTable, url_column: str = "source_url", fields: Iterable[str] = ARTICLE_FIELDS
) -> DataFrame:
    """Articles their source's filters let through; sources without filters keep all.

    One join with the masks; the plan has each different filter once, and a row is tested against those of
    its own source alone. Spark broadcasts the masks where they are small; else both sides are dealt by url and AQE
    splits a source that holds most of the articles.
    """
    fields = list(fields)
    masks = table.masks.select(F.col("url").alias("_url"), F.col("mask").alias("_mask"))
    joined = articles.join(masks, F.col(url_column) == F.col("_url"), "left")
    keep = F.col("_mask").isNull()
    tests = []
    for n, f in enumerate(table.filters):
        asked = F.get("_mask", n // _WORD_BITS).bitwiseAND(F.lit(1 << n % _WORD_BITS).cast("bigint")) != 0
        passes, fails = compile_filter(f, fields)
        tests.append(~asked if fails else ~asked | passes)
    return joined.filter(keep | reduce(and_, tests, F.lit(True))).select(*articles.columns)


def filter_errors(filters: Iterable[Filter], fields: Iterable[str] = ARTICLE_FIELDS) -> list[Filter]:
    """Filters that reject every row because they cannot be evaluated."""
    fields = list(fields)
    return [f for f in filters if compile_filter(f, fields)[1]]
