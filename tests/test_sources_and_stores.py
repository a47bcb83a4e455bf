import datetime as dt
import hashlib
import hmac
import json
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.ids import NAMESPACE
from tidemark.operators import merge, rates
from tidemark.sources import feeds, json_api, uploads, webhooks

NOW = dt.datetime(2024, 6, 1, 12, 0, 0)
AT = dt.datetime(2025, 1, 2, 3, 4, 5)


def uid(text):
    return str(uuid.uuid5(NAMESPACE, text))


# --- feeds -----------------------------------------------------------------

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>
<title>feed</title><link>http://home</link>
<item><title>Dated</title><link>http://x/1</link><description>&lt;p&gt;one&lt;/p&gt;</description>
  <content:encoded><![CDATA[<b>full one</b>]]></content:encoded><pubDate>Thu, 02 Jan 2025 03:04:05 GMT</pubDate></item>
<item><title>No link</title><description>two</description></item>
<item><title>Empty</title><link>http://x/3</link><description>&lt;br/&gt;</description></item>
<item><title>Undated</title><link>http://x/4</link><description>four</description></item>
</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><entry><title>E</title>
<link rel="self" href="http://self"/><link rel="alternate" href="http://x/e"/><summary>sum</summary>
<content type="html">body</content><updated>2025-01-02T03:04:05Z</updated></entry></feed>"""


def payloads(spark, *bodies):
    return spark.createDataFrame([(f"s{i}", b) for i, b in enumerate(bodies)], "source_id string, body string")


def test_feed_articles(spark):
    items = feeds.feed_items(payloads(spark, RSS, ATOM, "not xml", "<rss></rss>"))
    rows = {r.link: r for r in feeds.feed_articles(items, NOW).collect()}
    assert set(rows) == {"http://x/1", "http://x/4", "http://x/e"}
    one = rows["http://x/1"]
    assert (one.id, one.title, one.content, one.source_type, one.processed) == (uid("http://x/1"), "Dated", "one", "rss", False)
    assert one.timestamp == AT and rows["http://x/4"].timestamp == NOW
    assert rows["http://x/e"].timestamp == AT and rows["http://x/e"].content == "sum"
    content = {r.content for r in feeds.feed_articles(items, NOW, F.lit("content")).collect()}
    assert content == {"full one", "body"}
    assert feeds.feed_articles(items, NOW, F.lit("link")).count() == 0


def test_feeds_that_do_not_parse(spark):
    """Each document that gives nothing for a reason of its own says so; an empty feed is none."""
    cut = RSS[: RSS.index("</item>") + 3]
    cases = {
        cut: "feed is not xml, or is cut off",
        "not xml": "feed is not xml, or is cut off",
        "<rss><channel>&undefined;</channel></rss>": "feed is not xml, or is cut off",
        "<!DOCTYPE html><html><body>x</body></html>": "not a feed",
        "": "feed is empty",
        " \n ": "feed is empty",
        None: "feed is empty",
        '{"items": [{"url": "u"}]}': "not a feed",
        '{"version": "https://jsonfeed.org/version/1", "items": [{"url"': "feed is not json",
    }
    fine = [RSS, ATOM, "<rss></rss>", "<?xml version='1.0'?>\n<!-- <x> -->\n<rdf:RDF xmlns:rdf='r'><item><link>u</link></item></rdf:RDF>", '{"version": "https://jsonfeed.org/version/1.1", "items": []}']
    df = payloads(spark, *cases, *fine)
    found = feeds.feed_errors(df).collect()
    assert {r.body: r.error for r in found} == cases and len(found) == len(cases)
    # What can be read is read, next to what can not.
    assert feeds.feed_items(df).filter("link = 'u'").count() == 1


def test_json_feed(spark):
    body = """{"version": "https://jsonfeed.org/version/1.1", "title": "f", "items": [
      {"id": "1", "url": "http://j/1", "title": "A", "content_html": "<p>a &amp; b</p>", "summary": "s", "date_published": "2025-01-02T03:04:05Z"},
      {"id": "http://j/2", "content_text": "plain", "summary": "s2", "extra": [1]}, {"title": "no link", "summary": "x"}]}"""
    items = feeds.feed_items(payloads(spark, body))
    got = {r.link: (r.title, r.content, r.timestamp) for r in feeds.feed_articles(items, NOW, F.lit("content")).collect()}
    assert got == {"http://j/1": ("A", "a & b", dt.datetime(2025, 1, 2, 3, 4, 5)), "http://j/2": ("", "plain", NOW)}
    assert {r.content for r in feeds.feed_articles(items, NOW).collect()} == {"s", "s2"}


@pytest.mark.parametrize("kind", ["rss", "atom", "jsonl"])
def test_archives_are_read_in_ranges(spark, tmp_path, kind):
    """One file cut at every few bytes gives each item once, as a batch and as a stream."""
    def one(i):
        link, text = f"http://x/{i}", f"text {i} y" + "y" * (i * 7 % 90)
        if kind == "jsonl":
            return json.dumps({"url": link, "title": f"t{i}", "summary": text}) + "\n"
        if kind == "rss":
            return f"<item><title>t{i}</title>\n<link>{link}</link><description>{text}</description></item>"
        return f'<entry><title>t{i}</title><link href="{link}"/>\n<summary>{text}</summary></entry>'

    head, tail = {"rss": ("<rss><channel>", "</channel></rss>"), "atom": ("<feed>", "</feed>"), "jsonl": ("", "")}[kind]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "all.txt").write_text(head + "".join(map(one, range(60))) + tail)
    wanted = sorted((f"http://x/{i}", f"t{i}", f"text {i} y" + "y" * (i * 7 % 90)) for i in range(60))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "333")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        items = feeds.archive_items(spark, str(tmp_path / "in"), "s", kind)
        assert items.rdd.getNumPartitions() > 5
        assert sorted((r.link, r.title, r.description) for r in items.collect()) == wanted
        stream = feeds.archive_items(spark, str(tmp_path / "in"), "s", kind, stream=True)
        run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r.link, r.title, r.description) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == wanted


def test_feed_limit_is_per_document(spark):
    items = feeds.feed_items(payloads(spark, RSS, RSS, ATOM))
    limits = spark.createDataFrame([("s0", 2), ("s1", 0)], "source_id string, limit int")
    counts = {r.source_id: r["count"] for r in feeds.limit_items(items, limits).groupBy("source_id").count().collect()}
    assert counts == {"s0": 2, "s1": 4, "s2": 1}


def test_feed_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    items = feeds.archive_items(spark, str(tmp_path), "s")
    assert {r.link for r in feeds.feed_articles(items, NOW).collect()} == {"http://x/1", "http://x/4"}
    atom = tmp_path / "atom"
    atom.mkdir()
    (atom / "a.xml").write_text(ATOM)
    assert [r.link for r in feeds.archive_items(spark, str(atom), "s", "atom").collect()] == ["http://x/e"]


# --- json ------------------------------------------------------------------

PATHS = {"title": "t", "content": "c.text", "timestamp": "ts", "link": "l"}


def source(i, items="$", **more):
    row = {"id": f"s{i}", "type": "http", "name": f"n{i}", "url": f"http://s/{i}", "active": True, "trust": "low", "tags": [], "extract": {**PATHS, "items": items}}
    return {**row, **more}


def sources(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.SOURCES)


def test_json_articles_and_errors(spark):
    item = lambda **k: {"t": "T", "c": {"text": "C"}, "ts": "2025-01-02T03:04:05Z", "l": "http://l/1", **k}
    bodies = [
        json.dumps([item(), item(l="http://l/2", ts=1735787045)]),
        json.dumps({"data": {"items": [item(), 5, "x", None]}}),
        json.dumps([item()]),
        "not json",
        '{"x":1}',
        json.dumps([item(t=5, ts=None, l=None), {}]),
    ]
    rows = [source(0), source(1, "data.items"), source(2, extract=None), source(3), source(4), source(5)]
    given = json_api.with_extract(payloads(spark, *bodies), sources(spark, *rows))
    got = json_api.response_articles(given, NOW).collect()
    by_source = lambda s: [r for r in got if r.source_id == s]
    assert sorted(r.id for r in by_source("s0")) == sorted([uid("http://l/1"), uid("http://l/2")])
    assert {r.timestamp for r in by_source("s0")} == {AT}
    assert len(by_source("s1")) == 1
    bare = by_source("s5")
    assert [(r.title, r.link, r.timestamp) for r in bare] == [("", "", NOW)] * 2
    assert sorted(r.content for r in bare) == ["", "C"] and len({r.id for r in bare}) == 2
    errors = {r.source_id: r.error for r in json_api.response_errors(given).collect()}
    assert errors == {"s2": "source names no paths to read", "s3": "body is not json", "s4": "items path does not lead to an array"}


def test_webhooks(spark):
    paths = {"title": "title", "content": "body", "timestamp": "ts", "link": "link", "items": None}
    hook = lambda i, path, **k: source(i, type="webhook", extract=paths, spec=json.dumps({"path": path}), **k)
    table = sources(
        spark,
        hook(0, "/open"),
        hook(1, "signed", auth={"kind": "hmac", "secret": "s3cret"}),
        hook(2, "custom", auth={"kind": "hmac", "secret": "s3cret", "header": "X-Hub"}),
        hook(3, "other", auth={"kind": "basic", "secret": "x"}),
        hook(4, "off", active=False),
        hook(5, "twice"),
        hook(6, "/twice"),
    )
    good = '{"title":"T","body":"B","ts":"2025-01-02T03:04:05Z","link":"http://l"}'
    sign = lambda body: hmac.new(b"s3cret", body.encode(), hashlib.sha256).hexdigest()
    cases = [
        ("open", {}, good, 202),
        ("/open", {}, good, 202),
        ("nobody", {}, good, 404),
        ("off", {}, good, 404),
        ("open", {}, "not-json", 400),
        ("open", {}, '{"title":"x"}', 400),
        ("open", {}, '{"body":""}', 400),
        ("open", {}, '{"body":5}', 400),
        ("open", {}, "[1]", 400),
        ("signed", {"x-signature": sign(good)}, good, 202),
        ("signed", {}, good, 401),
        ("signed", {"X-Signature": ""}, good, 401),
        ("signed", {"X-Signature": sign(good)}, good.replace("T", "t"), 403),
        ("signed", {"X-Signature": sign(good).upper()}, good, 403),
        ("signed", {"X-Signature": "00"}, "not-json", 403),
        ("custom", {"X-Hub": sign(good)}, good, 202),
        ("custom", {"X-Signature": sign(good)}, good, 401),
        ("other", {}, good, 202),
        ("/webhooks/open", {}, good, 202),
        ("webhooks/nobody", {}, good, 404),
        ("twice", {}, good, 202),
    ]
    events = spark.createDataFrame([(str(i), p, h, b, None) for i, (p, h, b, _) in enumerate(cases)], schemas.PAYLOADS)
    judged = webhooks.judge_deliveries(events.withColumn("case", F.col("source_id")), webhooks.routes(table))
    assert {int(r.case): r.status for r in judged.collect()} == {i: c[3] for i, c in enumerate(cases)}
    made = webhooks.delivery_articles(judged, NOW)
    assert made.count() == sum(c[3] == 202 for c in cases)
    first = made.first()
    assert (first.id, first.source_type, first.content, first.timestamp) == (uid("http://l"), "webhook", "B", AT)
    assert webhooks.rejected(judged).count() == sum(c[3] != 202 for c in cases)


def test_uploads(spark, tmp_path):
    line = lambda c, i, t: json.dumps({"classification": c, "id": i, "article_id": "a", "timestamp": t, "data": {"v": [{"label": "L", "score": 0.5}]}})
    (tmp_path / "u.json").write_text("\n".join([line("events", "1", "2025-01-02T03:04:05Z"), line("Events", "2", "not-a-time"), line("brand", "3", None)]))
    got = uploads.uploaded_classifications(uploads.read_uploads(spark, str(tmp_path)), NOW).collect()
    assert {(r.classification, r.id, r.timestamp) for r in got} == {("events", "1", AT), ("events", "2", NOW), ("brand", "3", NOW)}


def test_scraped_results(spark):
    rows = [
        ("completed", "s", "http://p", "T", "C", "2025-01-02T03:04:05Z", ""),
        ("completed", "s", "http://q", "", "C", "", ""),
        ("error", "s", "http://r", "T", "C", "", "boom"),
        ("retry", "s", "http://t", "T", None, "x", "later"),
    ]
    results = spark.createDataFrame(rows, schemas.SCRAPE_RESULTS)
    # An empty title is what marks a placeholder, not a title that is there.
    assert {(r.link, r.content, r.timestamp) for r in uploads.scraped_articles(results, NOW).collect()} == {("http://p", "C", AT), ("http://t", "", NOW)}
    assert uploads.scraped_urls(results).count() == 4


# --- stores ----------------------------------------------------------------


def articles(spark, *rows):
    full = [(i, "s", "rss", title, "c", NOW + dt.timedelta(minutes=n), i, False) for n, (i, title) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.ARTICLES)


def test_insert_if_absent(spark):
    stored = articles(spark, ("1", "orig"), ("9", "nine"))
    batch = articles(spark, ("1", "changed"), ("2", "first"), ("2", "second"), ("3", "three"))
    got = {(r.id, r.title) for r in merge.new_articles(batch, stored).collect()}
    assert got == {("2", "first"), ("3", "three")}
    ordered = batch.withColumn("seq", -F.unix_micros("timestamp"))
    assert ("2", "second") in {(r.id, r.title) for r in merge.new_articles(ordered, stored, order="seq").collect()}
    # With a horizon, older stored rows are not looked at.
    late = (NOW + dt.timedelta(minutes=1), NOW + dt.timedelta(days=1))
    assert merge.new_articles(batch, stored, horizon=late).count() == 3


def test_hot_id_in_a_batch(spark):
    hot = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"), F.lit("").alias("title"), F.lit("").alias("content"), F.lit(NOW).alias("timestamp"))
    none = hot.filter("false")
    new = merge.new_articles(hot, none)
    assert new.count() == hot.select("id").distinct().count()
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan


def test_processed_and_unprocessed(spark):
    stored = articles(spark, *[(str(i), "t") for i in range(5)])
    ledger = spark.createDataFrame([("0",), ("1",), ("1",), ("x",)], "article_id string")
    assert [r.id for r in rates.unprocessed(stored, ledger, 2).collect()] == ["4", "3"]
    assert rates.unprocessed(stored, ledger).count() == 3
    dead = spark.createDataFrame([("4",)], "article_id string")
    assert [r.id for r in rates.unprocessed(stored, ledger, 1, dead).collect()] == ["3"]
    assert {r.id for r in merge.processed_flag(stored, ledger).filter("processed").collect()} == {"0", "1"}


def stored_sources(spark, *rows):
    return merge.with_source_hash(sources(spark, *[{**r, "created_at": dt.datetime(2020, 1, 1)} for r in rows]))


def test_source_upsert(spark):
    stored = stored_sources(spark, source(0), source(1))
    batch = merge.with_source_hash(sources(spark, source(1, id=None, name="renamed", description="d"), source(2, id=None)))
    got = {r.url: r for r in merge.upsert_sources(stored, batch, NOW).collect()}
    assert got["http://s/0"].updated_at is None and got["http://s/0"].name == "n0"
    one, two = got["http://s/1"], got["http://s/2"]
    assert (one.id, one.name, one.description, one.created_at, one.updated_at) == ("s1", "renamed", "d", dt.datetime(2020, 1, 1), NOW)
    assert (two.id, two.created_at, two.updated_at) == (uid("http://s/2"), NOW, None)
    with pytest.raises(Exception, match="url twice in batch"):
        merge.upsert_sources(stored, batch.unionByName(batch), NOW).collect()


def test_source_sync(spark):
    stored = stored_sources(spark, source(0), source(1), source(2))
    config = sources(spark, source(0, id=None), source(1, id=None, description="new"), source(3, id=None))
    actions = {r.url[-1]: r.action for r in merge.source_changes(merge.with_source_hash(config), stored).collect()}
    assert actions == {"0": "keep", "1": "update", "2": "delete", "3": "insert"}
    synced = merge.sync_sources(config, stored, NOW)
    assert {r.url[-1]: r.updated_at for r in synced.collect()} == {"0": None, "1": NOW, "3": None}
    again = merge.source_changes(merge.with_source_hash(config), synced)
    assert {r.action for r in again.collect()} == {"keep"}


def test_source_scans_delete_and_checks(spark):
    table = sources(spark, source(0), source(1, active=False), source(2, type="rss"), source(3, tags=None))
    assert rates.sources_scan(table).count() == 4
    assert [r.id for r in rates.sources_scan(table, "rss").collect()] == ["s2"]
    assert rates.sources_scan(table, active_only=True).count() == 3
    good, bad = schemas.split_valid(table, schemas.source_problem())
    assert good.count() == 3 and [r.error for r in bad.collect()] == ["tags is null"]
    urls = spark.createDataFrame([("s0", "p"), ("s2", "q")], "source_id string, url string")
    left, left_urls = merge.delete_sources(table, urls, table.filter("id = 's0'"))
    assert left.count() == 3 and [r.url for r in left_urls.collect()] == ["q"]


def test_reconcile(spark):
    held = lambda *keys: {k: [{"label": "wet", "score": 0.7}] for k in keys}
    rows = [
        ("harbour", "h1", "x", NOW, held("swell", "wind")),
        ("harbour", "h2", "y", NOW, None),
        ("inland", "i1", "x", NOW, held("rain")),
        ("lake", "l1", "z", NOW, held("ice")),
    ]
    table = spark.createDataFrame(rows, schemas.CLASSIFICATIONS)
    wanted = merge.config_keys(spark, {"Harbour": ["swell", "tide"], "coast": ["fog"], "lake": ["ice"]})
    plan = merge.classification_changes(table, wanted).collect()
    assert {r.classification: (r.action, list(r["add"]), list(r["remove"])) for r in plan} == {
        "harbour": ("update", ["tide"], ["wind"]),
        "coast": ("create", [], []),
        "inland": ("drop", [], []),
        "lake": ("keep", [], []),
    }
    after = {r.id: r.data for r in merge.reconcile(table, plan).collect()}
    assert set(after) == {"h1", "h2", "l1"} and after["h2"] is None
    assert {k: [(s.label, s.score) for s in v] for k, v in after["h1"].items()} == {"swell": [("wet", 0.7)], "tide": [("n/i", 0.0)]}
    scores = spark.createDataFrame([(n, "x", "k", "wet", NOW, 0.7) for n in ("harbour", "inland", "lake")], schemas.METRICS)
    assert {r.classification for r in merge.reconcile_metrics(scores, plan).collect()} == {"harbour", "lake"}
    with pytest.raises(ValueError):
        merge.config_keys(spark, {"harbour": []})


def test_article_checks(spark):
    good, bad = schemas.split_valid(
        articles(spark, ("1", "t"), ("2", "t" * 5000), ("3", "t")).withColumn("source_type", F.when(F.col("id") == "3", "fax").otherwise("rss")),
        schemas.article_problem(),
    )
    assert [(r.id, len(r.title)) for r in good.orderBy("id").collect()] == [("1", 1), ("2", 5000)]
    assert {r.id: r.error for r in bad.collect()} == {"3": "unknown source type"}
