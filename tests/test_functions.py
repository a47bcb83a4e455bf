import datetime as dt
import hashlib
import hmac
import html
from html.entities import html5
import uuid

from pyspark.sql import functions as F

from tidemark.functions import ids, payload, scores, text, times
from tidemark.schemas import SCORES

NBSP = "\N{NO-BREAK SPACE}"


def utc(*parts):
    return dt.datetime(*parts)


def test_clean(evaluate):
    cases = {
        "<p>hi</p>": "hi",
        "<div><b>bold</b> text</div>": "bold text",
        "a    b\t\tc": "a b c",
        "Tom &amp; Jerry": "Tom & Jerry",
        "   hello   ": "hello",
        "": "",
        "<br/><hr/>": "",
        "one\ntwo": "one\ntwo",
        "&lt;b&gt;gone&lt;/b&gt;": "gone",
        "&amp;lt;b&gt;": "&lt;b>",
        f"{NBSP}edge{NBSP}": "edge",
        "a < b": "a < b",
        "<multi\nline>x": "x",
        "a\vb": "a\vb",
    }
    assert evaluate(list(cases), text.clean) == list(cases.values())


def test_unescape_rare_entities(evaluate):
    cases = ["&eacute;&#x41;&#66;", "&ampx", "&notit;", "&#128;&#0;", "&unknown;", "q?a=1&b=2", "&CounterClockwiseContourIntegral;", "plain"]
    assert evaluate(cases, text.unescape) == [html.unescape(c) for c in cases]
    assert evaluate(["&#1;x", "&#xFFFE;"], text.unescape) == ["\x01x", "￾"]


def test_every_entity_equals_html(spark, evaluate):
    """All names, with and without semicolon, inside words; all one-byte numbers, and those beyond the last code point."""
    names = sorted(html5)
    cases = ["&" + n for n in names] + ["&" + n.rstrip(";") + "x &" for n in names]
    cases += [f"&#{n};" for n in [*range(0x20, 0x7F), *range(0xA0, 0x180), 0, 0x80, 0x9F, 0xD800, 0x10FFFF - 2, 0x110000, 10**20]]
    cases += ["&#;", "&#x;", "&", "&&amp;&", "&#00065", "&#x00041z", "&ampamp;", "&notin", "é&eacute"]
    assert evaluate(cases, text.unescape) == [html.unescape(c) for c in cases]


def test_clean_keeps_null(evaluate):
    assert evaluate([None], text.clean) == [None]


def test_select_content(evaluate):
    pick = lambda target: text.select_content(target, F.lit("C"), F.lit("D"))
    assert evaluate([None, "content", "description", "link", "bogus"], pick) == ["D", "C", "D", "", ""]


def test_uuid5(evaluate):
    values = ["https://example.com/post/1", "", "résumé", "a", "b"]
    assert evaluate(values, ids.uuid5) == [str(uuid.uuid5(ids.NAMESPACE, v)) for v in values]


def test_article_id(evaluate):
    with_link = evaluate(["x"], lambda c: ids.article_id(c, F.lit("s")))
    assert with_link == [str(uuid.uuid5(ids.NAMESPACE, "x"))]
    no_link = [evaluate([None, ""], lambda c, s=s: ids.article_id(c, F.lit(s))) for s in "ab"]
    assert no_link[0][0] == no_link[0][1] != no_link[1][0]


def test_hmac_any_key_length(texts):
    body = "payload é"
    keys = ["", "k", "six6\\66", "k" * 63, "k" * 64, "k" * 65, "k" * 200, "é" * 40]
    keyed = ids.with_hmac_keys(texts(keys), F.col("t"), "inner", "outer")
    signed = keyed.select("n", ids.hmac_sha256(F.col("inner"), F.col("outer"), F.lit(body)).alias("h"))
    got = [r.h for r in signed.orderBy("n").collect()]
    assert got == [hmac.new(k.encode(), body.encode(), hashlib.sha256).hexdigest() for k in keys]


def test_content_hash_tells_order_and_null(spark):
    row = spark.range(1).select(
        ids.content_hash(F.lit("a").alias("x"), F.lit(None).cast("string").alias("y")).alias("p"),
        ids.content_hash(F.lit("a").alias("x"), F.lit("").alias("y")).alias("q"),
        ids.content_hash(F.lit("a").alias("x"), F.lit(None).cast("string").alias("y")).alias("r"),
    ).first()
    assert row.p == row.r != row.q and len(row.p) == 32


def test_unix_to_time(evaluate):
    cases = {
        "1700000000": 1_700_000_000_000_000,
        "1700000000000": 1_700_000_000_000_000,
        "1700000000000000": 1_700_000_000_000_000,
        "0": 0,
        "-1": -1_000_000,
        # The limits themselves still count as the coarser unit.
        str(10**12): 10**18,
        str(10**15): 10**18,
        str(10**12 + 1): 10**15 + 1000,
        str(-(10**17)): None,
    }
    got = evaluate(list(cases), lambda c: F.unix_micros(times.unix_to_time(c.cast("bigint"))))
    assert got == list(cases.values())


def test_rfc3339(evaluate):
    cases = {
        "2025-01-02T03:04:05Z": utc(2025, 1, 2, 3, 4, 5),
        "2025-01-02T03:04:05.25+02:00": utc(2025, 1, 2, 1, 4, 5, 250000),
        "2025-01-02T03:04:05,5Z": utc(2025, 1, 2, 3, 4, 5, 500000),
        "2025-01-02": None,
        "2025-01-02 03:04:05": None,
        "2025-13-02T03:04:05Z": None,
        "not-a-time": None,
        "2025-01-02T03:04:05": None,
    }
    got = evaluate(list(cases), lambda c: times.rfc3339(c).cast("timestamp_ntz"))
    assert got == list(cases.values())


def test_feed_date(evaluate):
    at = utc(2025, 1, 2, 3, 4, 5)
    cases = {
        "Thu, 02 Jan 2025 03:04:05 GMT": at,
        "2 Jan 2025 03:04:05 +0000": at,
        "Thu, 2 Jan 2025 05:04:05 +0200": at,
        "02 Jan 2025 03:04 GMT": utc(2025, 1, 2, 3, 4),
        "2025-01-02T03:04:05Z": at,
        "Thu, 02 Jan 25 03:04:05 GMT": at,
        "02 Jan 99 03:04 GMT": utc(1999, 1, 2, 3, 4),
        "Thursday, 02-Jan-25 03:04:05 GMT": at,
        "2 January 2025 03:04:05 GMT": at,
        "Thu Jan  2 03:04:05 2025": at,
        "2025-01-02T03:04:05": at,
        "2025-01-02 03:04:05": at,
        "2025-01-02": utc(2025, 1, 2),
        "2 Jan 2025": utc(2025, 1, 2),
        "January 2, 2025": utc(2025, 1, 2),
        "Jan 2 03:04:05 UTC 2025": at,
        "2 Jan 2025 03:04:05": at,
        "Wed, 02 Jul 2025 23:04:05 EST": utc(2025, 7, 3, 4, 4, 5),
        "Wed, 02 Jul 2025 20:04:05 PDT": utc(2025, 7, 3, 3, 4, 5),
        "2 Jan 2025 04:04:05 CET": at,
        "2 Jan 2025 04:04:05 Europe/Paris": at,
        "2 JAN 2025 3:04 Z": utc(2025, 1, 2, 3, 4),
        "31 Feb 2025 03:04:05 GMT": None,
        "2 Jan 2025 25:04:05 GMT": None,
        "2 Jan 2025 03:04:05 NOWHERE": None,
        "2 Jan 68": utc(2068, 1, 2),
        "2 Jan 69": utc(1969, 1, 2),
        "2025-01-02T03:04:05.250+00:00": utc(2025, 1, 2, 3, 4, 5, 250000),
        "2025": None,
        "May be soon": None,
        "soon": None,
        None: None,
    }
    got = evaluate(list(cases), lambda c: times.feed_date(c).cast("timestamp_ntz"))
    assert got == list(cases.values())


def test_feed_date_is_compiled(spark):
    """One cast, within the code that Spark generates; no chain of formats that grows past its limit."""
    df = spark.range(5).select(times.feed_date(F.concat(F.col("id").cast("string"), F.lit(" Jan 2025 03:04:05 GMT"))).alias("d"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "*(1) Project" in plan and plan.count("gettimestamp") == 0
    generated = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenStringSeq(df._jdf.queryExecution().executedPlan())
    sizes = [generated.apply(i)._3().maxMethodCodeSize() for i in range(generated.size())]
    assert sizes and max(sizes) < 64_000


def fields(texts, bodies, path):
    df = payload.with_json(texts(bodies), "t", "v")
    at = payload.variant_path(path)
    df = payload.with_strings(df, "v", {"s": at})
    df = payload.with_time(df, "v", at, "at").withColumn("at", F.col("at").cast("timestamp_ntz"))
    return df.orderBy("n").select("s", "at").collect()


def test_extract_string(texts):
    bodies = ['{"a":{"b":"x"}}', '{"a":{"b":5}}', '{"a.b":"x"}', '{"a":{"b":null}}', '{"a":["b"]}', "{}", '{"a":{"b":""}}']
    assert [r.s for r in fields(texts, bodies, "a.b")] == ["x", None, None, None, None, None, ""]
    assert [r.s for r in fields(texts, ['{"it\'s":"x"}'], "it's")] == ["x"]
    assert [r.s for r in fields(texts, ['{"a":"x"}'], "")] == [None]


def test_extract_time(texts):
    at = utc(2023, 11, 14, 22, 13, 20)
    bodies = ['"2023-11-14T22:13:20Z"', "1700000000", "1700000000.9", "1700000000000", "1700000000000000", "1.7e9", '"2023-11-14"', "true", '"1700000000"', "1e30"]
    got = [r.at for r in fields(texts, [f'{{"t":{b}}}' for b in bodies], "t")]
    assert got == [at] * 6 + [None] * 4


def test_json_must_be_one_value(texts):
    bodies = ['{"a":1}', " {} ", '{"a":1} x', '{"a":1}{"b":2}', '{"a":1}],[{}', "1,2", "", "{'a':1}", '{"a":1', "null", '1,"~end~"']
    rows = payload.with_json(texts(bodies), "t", "v").orderBy("n").select(F.col("v").isNotNull().alias("ok")).collect()
    assert [r.ok for r in rows] == [True, True] + [False] * 7 + [True, False]


def test_repeated_json_key_keeps_the_last(texts):
    assert [r.s for r in fields(texts, ['{"a":"x","a":"y"}'], "a")] == ["y"]


def replies(texts, raws):
    df = scores.with_label_scores(texts(raws), "t").orderBy("n").select("scores", "error")
    return [(None if r.scores is None else {s.label: s.score for s in r.scores}, r.error) for r in df.collect()]


def test_label_scores(texts):
    bad_json, no_map = "invalid json", "reply holds no scores by label"
    cases = {
        '{"Recon": 0.82, "Persistence": 0.4}': ({"Recon": 0.82, "Persistence": 0.4}, None),
        '```json\n{"A": 0.5}\n```': ({"A": 0.5}, None),
        '```\n{"A": 0.5}```': ({"A": 0.5}, None),
        '{"labels": {"A": 0.9, "B": 0.3}}': ({"A": 0.9, "B": 0.3}, None),
        '{"A": "0.75"}': ({"A": 0.75}, None),
        '{"A": " 1e-1 "}': ({"A": 0.1}, None),
        "not json": (None, bad_json),
        "[1]": (None, bad_json),
        '{"A": 1} extra': (None, bad_json),
        "": ({}, None),
        " \n ": ({}, None),
        "{}": (None, no_map),
        '{"A": 0.5, "B": "x"}': (None, no_map),
        '{"A": null}': (None, no_map),
        '{"A": true}': (None, no_map),
        '{"A": "1.5f"}': (None, no_map),
        '{"x": {"A": 1}, "y": {"B": 1}}': (None, no_map),
        '{"x": {"y": {"A": 1}}}': (None, no_map),
        '{"x": "{}"}': (None, no_map),
    }
    assert replies(texts, list(cases)) == list(cases.values())
    assert replies(texts, [None]) == [({}, None)]


def top(spark, pairs, cutoff, n):
    given = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("score")) for a, b in pairs]) if pairs else F.array()
    row = spark.range(1).select(scores.top_scores(given.cast(SCORES), cutoff, n).alias("s")).first()
    return [(s.label, s.score) for s in row.s]


def test_top_scores(spark):
    four = [("D", 0.1), ("B", 0.7), ("A", 0.9), ("C", 0.5)]
    assert top(spark, four, 0.6, 2) == [("A", 0.9), ("B", 0.7)]
    assert top(spark, [("X", 0.1)], 0.75, 1) == [("n/i", 0.0)]
    assert top(spark, four, 0.0, 0) == [("A", 0.9), ("B", 0.7), ("C", 0.5), ("D", 0.1)]
    assert top(spark, [("B", 0.5), ("A", 0.5), ("C", 0.5)], 0.5, 2) == [("A", 0.5), ("B", 0.5)]
    assert top(spark, [], 0.0, 3) == [("n/i", 0.0)]
    assert top(spark, [("A", float("nan")), ("B", 0.2)], 0.1, 3) == [("B", 0.2)]


def test_data_keys_add_and_remove(spark):
    data = F.from_json(F.lit('{"a":[{"label":"x","score":0.5}],"b":[]}'), "map<string,array<struct<label:string,score:double>>>")
    changed = scores.add_keys(scores.remove_keys(data, ["b", "none"]), ["c"])
    row = spark.range(1).select(changed.alias("d"), scores.add_keys(F.lit(None).cast(data_type()), ["c"]).alias("n")).first()
    assert {k: [(s.label, s.score) for s in v] for k, v in row.d.items()} == {"a": [("x", 0.5)], "c": [("n/i", 0.0)]}
    assert row.n is None


def data_type():
    from tidemark.schemas import DATA

    return DATA
