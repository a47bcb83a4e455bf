import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import filters as f

PARSED = {
    "body.len.lt.7": ("body", "len", "lt", "7", False),
    "!kind.empty.ne.yes": ("kind", "empty", "ne", "yes", True),
    "price.lte.3.50": ("price", "", "lte", "3.50", False),
    "regex.eq.^a": ("*", "regex", "eq", "^a", False),
    ".count.gt.2": ("*", "count", "gt", "2", False),
    "body.regex.eq.w.x..y": ("body", "regex", "eq", "w.x..y", False),
    # A generator's name is a target where the value holds a dot.
    "len.gte.1.5": ("len", "", "gte", "1.5", False),
}


@pytest.mark.parametrize("text", PARSED)
def test_parse(text):
    got = f.parse_filter(text)
    assert (got.target, got.generator, got.operator, got.value, got.negate) == PARSED[text]


@pytest.mark.parametrize("text", ["plain", "body.like.x", "body.size.eq.3", "", "!", "x.y", "!eq"])
def test_parse_errors(text):
    with pytest.raises(f.FilterError):
        f.parse_filter(text)


DOC = {"title": "Tide tables 2031", "body": "salt " * 8, "price": "12.5", "kind": "chart;notice"}


@pytest.mark.parametrize(
    "text, passes",
    [
        ("body.len.eq.40", True),
        ("body.len.lt.40", False),
        ("title.regex.eq.[0-9]{4}$", True),
        ("title.regex.ne.tables", False),
        ("kind.contains.eq.;n", True),
        ("!kind.contains.eq.chart", False),
        # Numbers are compared as texts.
        ("price.lt.9", True),
        ("price.gt.12.45", True),
        ("nowhere.len.gte.0", False),
        ("!nowhere.eq.x", True),
        ("*.len.lte.4", True),
        ("*.eq.Tide", False),
        # A boolean generator's own value is the needle; the test is against true.
        ("title.empty.eq.false", False),
        ("title.empty.ne.false", True),
        # Failing filters reject, negated or not.
        ("!title.len.eq.x", False),
        ("!title.regex.gt.Tide", False),
        ("!title.regex.eq.(", False),
        ("!title.regex.eq.(?=T)", False),
        ("!title.regex.eq.(T)\\1", False),
        ("!body.sim.eq.1", False),
        ("body.count.gte.1", False),
        ("!missing.sim.eq.1", True),
    ],
)
def test_evaluate(spark, text, passes):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in DOC.items()])
    assert df.filter(f.keep_condition([f.parse_filter(text)], DOC)).count() == int(passes)


def test_length_is_in_bytes_and_null_is_empty(texts):
    df = texts(["éé", None], "title")
    keep = lambda text: [r.n for r in df.filter(f.keep_condition([f.parse_filter(text)], ["title"])).collect()]
    assert keep("title.len.eq.4") == [0]
    assert keep("title.empty.eq.x") == [1]
    assert keep("!title.contains.eq.z") == [0, 1]


@pytest.mark.parametrize(
    "pattern, text, matches",
    [
        ("end$", "the end", True),
        ("end$", "the end\n", False),
        ("(?m)end$", "the end\nmore", True),
        ("a.b", "a\rb", True),
        ("a.b", "a\nb", False),
        (r"a\sb", "a\vb", False),
        (r"[\s]b", "\tb", True),
        ("(?i)STRASSE|Ä", "ä", True),
        (r"\bcaf\b", "café", True),
        ("(?P<year>[0-9]{4})", "in 2024", True),
        ("[[:alpha:]]+[[:^digit:]]", "ab", True),
        ("[a&&b]", "&", True),
        (r"\$5", "cost $5", True),
        ("[$]", "$", True),
        ("^[*+-] ", "+ item", True),
        (r"C\++$", "C++", True),
        (r"\Qa$b*\E+", "xa$b**", True),
        (r"\v", "a\vb", True),
        (r"\v", "a\nb", False),
        ("[]a-]x", "]x", True),
        ("(?m)^b$", "a\nb\nc", True),
        ("(?m:^b)$", "a\nb\nc", False),
        ("(?U)a+{", "aa{", True),
        (r"\x41\101[^\S\n]", "AA ", True),
        (r"\p{Greek}\pL", "αβ", True),
    ],
)
def test_patterns(spark, pattern, text, matches):
    made = f.java_pattern(pattern)
    assert made is not None
    assert spark.range(1).select(F.lit(text).rlike(made).alias("m")).first().m is matches


@pytest.mark.parametrize("pattern", [r"a\Z", r"\h", "(?x)a", "x{2000}", "x{3,2}", "a++", "a**", "*a", "(|+)", "(a", "a)", "[a", r"\k<n>", "(?<!a)b", "(?>a)", "(?P<n>a)(?P<n>b)"])
def test_patterns_that_are_none(spark, pattern):
    assert f.java_pattern(pattern) is None


def test_per_source(spark):
    rows = [
        ("a", "tiny"),
        ("a", "right in the zone"),
        ("a", "way over the upper bound"),
        ("b", "spam offer"),
        ("b", "fine"),
        ("c", "spam offer"),
        ("d", "anything"),
    ]
    df = spark.createDataFrame(rows, "source_url string, content string").withColumns({"title": F.lit(""), "link": F.lit("")})
    rules = f.resolve_filters(
        {"a": ["content.len.gte.10", "content.len.lte.20"], "b": ["!content.contains.eq.spam"], "c": []},
        default=["content.len.gte.5"],
    )
    kept = {(r.source_url, r.content) for r in f.apply_filters(df, rules).collect()}
    assert kept == {("a", "right in the zone"), ("b", "fine"), ("c", "spam offer"), ("d", "anything")}
    assert f.resolve_filters({"c": []}, ["len.gte.5"], inherit=False) == {}
    assert f.apply_filters(df, {}).count() == len(rows)


def test_sources_with_one_list_share_a_branch(spark):
    rules = {f"u{i}": f.parse_filters(["title.len.gte.1"]) for i in range(500)}
    condition = f.filter_condition(rules, F.col("source_url"))
    df = spark.createDataFrame([("u7", "", "", "")], "source_url string, title string, content string, link string")
    plan = df.filter(condition)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("octet_length") == 1
    assert df.filter(condition).count() == 0


SOURCES = "url string, filters array<string>"


def test_table_equals_lists(spark):
    """The same rules by table and by plan, with failing, shared, inherited, unknown and repeated filters over several mask words."""
    rules = {f"u{i}": [f"content.len.gte.{i % 70}", "!title.contains.eq.x"][: 1 + i % 2] for i in range(90)}
    rules |= {"bad": ["title.len.eq.x"], "never": ["!content.sim.gte.1"], "unknown": ["!tags.eq.a", "!tags.eq.a"], "empty": [], "none": None}
    urls = [*rules, "elsewhere", None]
    rows = [(u, t, "y" * n, "") for u in urls for n in (0, 3, 64, 200) for t in ("x", None)]
    df = spark.createDataFrame(rows, "source_url string, title string, content string, link string")
    sources = spark.createDataFrame([(u, r) for u, r in rules.items()], SOURCES)
    for default, inherit in (([], True), (["content.len.lt.100"], True), (["content.len.lt.100"], False)):
        resolved = f.resolve_filters({u: r or [] for u, r in rules.items()}, default, inherit=inherit)
        expected = f.apply_filters(df, resolved)
        got = f.apply_filter_table(df, f.filter_table(sources, default, inherit=inherit))
        assert got.columns == df.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_table_of_ten_thousand_sources(spark):
    """The plan holds the different filters, whatever the number of sources."""
    lists = [["content.len.gte.3"], ["title.regex.eq.^a"], ["content.len.gte.3", "!title.eq.b"]]
    articles = spark.createDataFrame([(f"u{i}", "abc"[i % 3], "y" * (i % 7), "") for i in range(20_000)], "source_url string, title string, content string, link string")
    plans = []
    for n in (30, 10_000):
        sources = spark.range(n).select(F.concat(F.lit("u"), "id").alias("url"), F.get(F.lit(lists), (F.col("id") % 3).cast("int")).alias("filters"))
        kept = f.apply_filter_table(articles, f.filter_table(sources))
        plans.append(kept._jdf.queryExecution().optimizedPlan().toString())
        assert kept.count() == sum(
            i >= n or (i % 7 >= 3 if i % 3 == 0 else i % 3 == 0 if i % 3 == 1 else i % 7 >= 3 and i % 3 != 1) for i in range(20_000)
        )
    assert abs(len(plans[0]) - len(plans[1])) < 100


def test_table_with_too_many_filters(spark, monkeypatch):
    monkeypatch.setattr(f, "MOST_FILTERS", 2)
    sources = spark.createDataFrame([("a", ["title.eq.1", "title.eq.2"]), ("b", ["title.eq.3"])], SOURCES)
    with pytest.raises(ValueError):
        f.filter_table(sources)


@pytest.mark.parametrize("pattern", [r"\bTHE\b", r"(?i)\bthe\b", r"a\b[\s\S]*\bz", r"\b.", r"x?\bS\b", r"(?i)\bst?\b", r"\bk*", r"(a|b)\b", r"_\b-", r"\B\w\b", r"[\d\D]\b1"])
def test_word_edges_next_to_letters(spark, pattern):
    """An edge beside a plain letter is simplified; what matches stays."""
    texts = ["THE", "THEN", "the end", "éTHE", "a z", "az", "a\nbz", "", "ſt", "s", "xS", "\u212a", "_-", "a1", "kk", "b,", "1"]
    made = f.java_pattern(pattern)
    python = re.compile(pattern.replace(r"[\s\S]", "(?s:.)").replace(r"[\d\D]", "(?s:.)"), re.ASCII)
    got = [r.m for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(F.col("t").rlike(made).alias("m")).collect()]
    assert got == [python.search(t) is not None for t in texts], made


def test_failing_filters_are_named():
    bad = f.parse_filters(["title.len.eq.x", "content.sim.gte.1", "title.eq.a", "missing.count.eq.1"])
    assert f.filter_errors(bad) == bad[:2]
