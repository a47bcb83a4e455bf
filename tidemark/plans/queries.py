"""Registered queries: every operator over the whole test tables.

Doubles are rounded and times returned without a zone, so that results compare by value.
"""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import ids, scores, text, times
from ..functions.scores import cut_data, top_scores
from ..operators import classify as c
from ..operators import filters as f
from ..operators import merge, metrics as m, near, points, rates, rollup, titles, uptime
from ..operators.search import linked_classifications, search
from ..session import shared_dir, with_rocksdb
from ..sources import feeds, json_api, uploads, webhooks
from ..specs import Range, SearchRequest
from ..streaming import ingest, sessions
from ..streaming.store import Batch, Store
from .bindings import AS_OF, LABEL_AXIS, SPEC, Tables, category, score
from .views import Panel, Query, View, render
from .views import Tables as ViewTables

START, END = "2024-01-05T00:00:00Z", "2024-01-25T00:00:00Z"
PERIOD_A = ("2024-01-01T00:00:00Z", "2024-01-10T00:00:00Z")
PERIOD_B = ("2024-01-12T00:00:00Z", "2024-01-21T00:00:00Z")
BEAT_GAP = 600

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[build.__name__] = lambda spark, folder: build(Tables(spark, folder))
    return build


def plain(column: str, name: str | None = None) -> Column:
    """A time without its zone (the session's is UTC)."""
    return F.col(column).cast("timestamp_ntz").alias(name or column)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({x: F.round(x, 6) for x in columns})


def exploded(rows: DataFrame, *keep: str) -> DataFrame:
    """Nested scores as rows, to compare without map order."""
    return rows.select(*keep, F.explode("data").alias("category", "scores")).select(
        *keep, "category", F.inline("scores")
    )


# --- aggregates ------------------------------------------------------------


@query
def treemap(t):
    return m.treemap(t.metrics(), "events", start=START, end=END)


@query
def treemap_category_cutoff(t):
    return m.treemap(t.metrics(), "events", category="vector", cutoff=0.5)


@query
def heatmap_all(t):
    return rounded(m.heatmap(t.metrics(), "events"), "value")


@query
def heatmap_label(t):
    return rounded(m.heatmap(t.metrics(), "events", label="click", start=START, end=END), "value")


@query
def label_metrics(t):
    return rounded(
        m.label_metrics(t.metrics(), "events", labels=["view", "click", "error"], start=START, end=END),
        "mean",
        "var",
    )


@query
def signals(t):
    return rounded(
        m.signals(t.metrics(), "events"), "frequency", "mean", "variance", "weight", "entropy"
    )


@query
def classification_count(t):
    return m.classification_count(t.classifications(), "events", START, END)


@query
def label_delta(t):
    return rounded(m.label_delta(t.metrics(), "events", "click", START, END), "mean_confidence")


@query
def label_delta_empty(t):
    return m.label_delta(t.metrics(), "events", "no such label")


@query
def quadrant(t):
    return rounded(
        m.quadrant(t.metrics(), "events", "purchase", PERIOD_A, PERIOD_B), "frequency", "mean_confidence"
    )


@query
def quadrant_zero_base(t):
    never = ("2020-01-01T00:00:00Z", "2020-02-01T00:00:00Z")
    return rounded(
        m.quadrant(t.metrics(), "events", "purchase", never, PERIOD_B), "frequency", "mean_confidence"
    )


@query
def profile(t):
    return rounded(
        m.profile(t.metrics(), "events", *PERIOD_A), "frequency", "mean", "variance", "weight", "entropy"
    )


@query
def profile_delta(t):
    return rounded(
        m.profile_delta(t.metrics(), "events", PERIOD_A, PERIOD_B).select(
            "category", "label", "weight_a", "weight_b", "weight_drift", "entropy_shift", "status"
        ),
        "weight_a",
        "weight_b",
        "weight_drift",
        "entropy_shift",
    )


@query
def data_keys(t):
    return m.data_keys(t.classifications(), "events")


# --- the rollup ------------------------------------------------------------


def _rollup(t) -> rollup.Rollup:
    """The rollup of the whole metrics table, written and read as a table, next to the metrics."""
    path = f"{_fresh_dir(t)}/moments"
    rollup.moments(t.metrics()).write.parquet(path)
    return rollup.Rollup(t.spark.read.schema(rollup.MOMENTS).parquet(path), t.metrics())


@query
def rollup_label_metrics(t):
    found = _rollup(t).label_metrics("events", labels=["view", "click", "error"], start=START, end=END)
    return rounded(found, "mean", "var")


@query
def rollup_signals(t):
    return rounded(_rollup(t).signals("events"), "frequency", "mean", "variance", "weight", "entropy")


@query
def rollup_heatmap(t):
    return rounded(_rollup(t).heatmap("events", label="click", start=START, end=END), "value")


@query
def rollup_label_delta(t):
    return rounded(_rollup(t).label_delta("events", "click", START, END), "mean_confidence")


@query
def rollup_quadrant(t):
    return rounded(_rollup(t).quadrant("events", "purchase", PERIOD_A, PERIOD_B), "frequency", "mean_confidence")


# --- points and search -----------------------------------------------------


def _points(df: DataFrame) -> DataFrame:
    return df.withColumn("x", F.col("x").cast("timestamp_ntz"))


@query
def plot_points(t):
    return _points(points.plot_points(t.metrics(), t.articles(), "click", end="2024-01-01T01:00:00Z"))


@query
def scatter_cutoff(t):
    return _points(
        points.scatter_points(t.metrics(), t.articles(), "events", category="severity", cutoff=0.75)
    )


@query
def scatter3d(t):
    return _points(
        points.scatter3d_points(
            t.metrics(), t.articles(), LABEL_AXIS, category=None, labels=["click", "purchase", "error"], cutoff=0.9
        )
    )


def _found(df: DataFrame) -> DataFrame:
    return exploded(df, "id", "article_id", plain("timestamp"), "title", "link")


@query
def search_labels_all(t):
    request = SearchRequest(
        "events", labels=("click", "purchase", "click"), start=START, end=END, cutoff=0.5, limit=50
    )
    return _found(search(t.classifications(), t.articles(), t.metrics(), request))


@query
def search_title_cutoff(t):
    request = SearchRequest("events", title="customer#_0000000", cutoff=0.3, limit=200)
    return _found(search(t.classifications(), t.articles(), t.metrics(), request))


def _title_index(t) -> DataFrame:
    path = f"{_fresh_dir(t)}/titles"
    titles.trigram_index(t.articles()).write.parquet(path)
    return t.spark.read.schema("gram string, article_id string").parquet(path)


@query
def search_title_index(t):
    """The same through the trigram index."""
    request = SearchRequest("events", title="customer#_0000000", cutoff=0.3, limit=200)
    return _found(search(t.classifications(), t.articles(), t.metrics(), request, _title_index(t)))


@query
def title_candidates(t):
    """How many titles a few needles match, with wildcards, in other case, too short for the index, or empty."""
    index, articles = _title_index(t), t.articles()
    needles = ["CUSTOMER#", "00012", "er#0%7_1", "9", "_", "100%", ""]
    found = [titles.titled(articles, n, index).select(F.lit(n).alias("needle")) for n in needles]
    return reduce(DataFrame.unionByName, found).groupBy("needle").agg(F.count(F.lit(1)).alias("n"))


@query
def search_unlimited(t):
    return _found(linked_classifications(t.classifications(), t.articles(), t.metrics(), SearchRequest("events")))


@query
def score_cutoff(t):
    """Nested re-aggregation on its own: scores under the cutoff and empty attributes go."""
    cut = t.classifications().withColumn("data", cut_data(F.col("data"), 0.8)).filter(F.size("data") > 0)
    return exploded(cut, "id")


# --- articles --------------------------------------------------------------


def _rate(t, fmt):
    return rates.article_rate(t.event_articles(), fmt, AS_OF).select("index", plain("bucket_start"), "count")


@query
def article_rate_day(t):
    return _rate(t, "day")


@query
def article_rate_month(t):
    return _rate(t, "month")


@query
def recent_articles(t):
    return rates.recent_articles(t.event_articles()).withColumn("timestamp", plain("timestamp"))


def _ledger(t) -> DataFrame:
    done = t.events().filter("event_type IN ('view', 'error')")
    return done.select(F.col("event_id").cast("string").alias("article_id"))


@query
def unprocessed_batch(t):
    return rates.unprocessed(t.event_articles(), _ledger(t), 10).select("id", "content", plain("timestamp"))


@query
def processed_flag(t):
    flagged = merge.processed_flag(t.event_articles(), _ledger(t))
    return flagged.groupBy("source_id", "processed").agg(F.count(F.lit(1)).alias("n"))


@query
def mark_processed(t):
    return merge.mark_processed(t.classifications())


# --- near copies -----------------------------------------------------------

NEAR_WINDOW, NEAR_COSINE = 3600, 0.9


def _embedded(vectors: DataFrame) -> DataFrame:
    """Embeddings as articles, one a minute; every third comes again, up to two hours later, turned a little or, every other one, too far."""
    n = F.col("vec_id")
    v = F.col("embedding").cast("array<double>")
    at = lambda minutes: F.timestamp_seconds(F.lit(1704067200) + minutes * 60)
    turn = F.when(n % 6 == 0, 0.2).otherwise(0.9)
    echo = F.when(n % 3 == 0, F.struct((n + 1_000_000).alias("id"), at(n + n % 7 * 20).alias("timestamp"), F.zip_with(v, F.reverse(v), lambda a, b: a + b * turn).alias("embedding")))
    own = F.struct(n.alias("id"), at(n).alias("timestamp"), v.alias("embedding"))
    return vectors.select(F.inline(F.filter(F.array(own, echo), lambda x: x.isNotNull())))


@query
def near_copies(t):
    """Articles kept, and near copies of one up to an hour before."""
    articles = _embedded(t.raw("embeddings"))
    kept = near.without_near_copies(articles, NEAR_WINDOW, NEAR_COSINE).select("id", F.lit(True).alias("kept"))
    return articles.join(kept, "id", "left").select("id", F.coalesce("kept", F.lit(False)).alias("kept"))


# --- uptime ----------------------------------------------------------------


def _intervals(t) -> DataFrame:
    return uptime.uptime_intervals(t.beats(), BEAT_GAP)


def _plain_intervals(df: DataFrame) -> DataFrame:
    return df.select("service", plain("start"), plain("recent"))


@query
def uptime_sessions(t):
    return _plain_intervals(_intervals(t))


@query
def uptime_extend(t):
    """The same intervals, reached in two steps: half the history, then the beats since."""
    half = times.timestamp_literal(AS_OF)
    first = uptime.uptime_intervals(t.beats().filter(F.col("timestamp") <= half), BEAT_GAP)
    return _plain_intervals(
        uptime.extend_uptime(first, t.beats().filter(F.col("timestamp") > half), BEAT_GAP)
    )


@query
def uptime_total(t):
    """Of all services: more than one of them is up at most times, so the share is clamped."""
    return rounded(uptime.uptime_total(_intervals(t), dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 15)), "uptime")


@query
def uptime_total_by_service(t):
    total = uptime.uptime_total(_intervals(t), dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 15), ("service",))
    return rounded(total, "uptime")


def _segments(t, fmt):
    rows = uptime.uptime_segments(_intervals(t), fmt, AS_OF)
    return rounded(rows.select("index", plain("bucket_start"), "percent"), "percent")


@query
def uptime_segments_day(t):
    return _segments(t, "day")


@query
def uptime_segments_month(t):
    return _segments(t, "month")


def _service_segments(t, fmt):
    rows = uptime.uptime_segments(_intervals(t), fmt, AS_OF, ("service",))
    return rounded(rows.select("service", "index", plain("bucket_start"), "percent"), "percent")


@query
def uptime_segments_by_service(t):
    return _service_segments(t, "day")


@query
def uptime_segments_by_service_month(t):
    return _service_segments(t, "month")


# --- filters ---------------------------------------------------------------


def _filtered(t, *texts: str) -> DataFrame:
    return t.documents().filter(f.keep_condition(f.parse_filters(texts))).select("id", "title")


@query
def filter_len(t):
    return _filtered(t, "content.len.gte.1000", "content.len.lt.3000")


@query
def filter_regex(t):
    return _filtered(t, r"content.regex.eq.(?i)\bTHE\b[\s\S]*\.$", "title.regex.ne.^(fr|de)")


@query
def filter_contains(t):
    return _filtered(t, "content.contains.eq.@", "!content.contains.eq.the")


@query
def filter_text_order(t):
    return _filtered(t, "title.gte.en src2", "title.lt.es", "link.ne.doc://1")


@query
def filter_wildcard_negate(t):
    return _filtered(t, "!contains.eq.src1", "!*.regex.eq.password", "!missing.eq.x", "len.gte.1000")


@query
def filter_failing(t):
    """Filters that cannot be evaluated reject all, negated or not; on an unknown field
    they are never looked at."""
    sets = {
        "sim": ["content.sim.gte.0.5"],
        "negated": ["!content.regex.eq.("],
        "ordered_bool": ["content.contains.gt.the"],
        "bad_int": ["title.len.eq.ten"],
        "unknown_field": ["!tags.count.gte.1"],
    }
    one = F.lit(1)
    return t.documents().agg(
        *[F.count(F.when(f.keep_condition(f.parse_filters(s)), one)).alias(k) for k, s in sets.items()]
    )


@query
def filter_per_source(t):
    rules = f.resolve_filters(
        {
            "src0": ["content.len.gte.2000"],
            "src1": ["content.contains.eq.the", "!content.contains.eq.http"],
            "src2": [],
            "src3": ["content.len.gte.2000"],
        },
        default=["title.regex.eq.^en"],
    )
    return f.apply_filters(t.documents(), rules, "source_id").select("id", "source_id")


@query
def filter_empty(t):
    """Empty or missing fields, on their own, on any field, and negated."""
    docs = t.documents().withColumns({"title": F.when(F.col("id") % 3 != 0, F.col("title")), "link": F.when(F.col("id") % 2 == 0, "").otherwise(F.col("link"))})
    sets = {"title": ["title.empty.eq.true"], "no_title": ["!title.empty.eq.x"], "one_is": ["empty.eq."], "none_is": ["!empty.eq.true", "content.empty.ne.true"], "unknown": ["tags.empty.eq.true"]}
    return docs.agg(*[F.count(F.when(f.keep_condition(f.parse_filters(x)), F.lit(1))).alias(k) for k, x in sets.items()])


@query
def filter_source_table(t):
    """Filters of many sources as a table: a tenth of the suppliers have a list of their own, the same three lists over and over."""
    docs = t.documents().withColumn("url", F.concat(F.lit("u"), (F.col("id").cast("int") % 50).cast("string")))
    lists = [["content.len.gte.2000"], ["content.contains.eq.the", "!content.contains.eq.http"], []]
    key = F.col("s_suppkey")
    picked = reduce(lambda c, n: c.when(key % 3 == n, F.array(*map(F.lit, lists[n])).cast("array<string>")), (1, 2), F.when(key % 3 == 0, F.array(*map(F.lit, lists[0]))))
    sources = t.raw("supplier").select(F.concat(F.lit("u"), key).alias("url"), picked.alias("filters"))
    table = f.filter_table(sources, ["title.regex.eq.^en"])
    return f.apply_filter_table(docs, table, "url").select("id", "url")


# --- text, ids, times ------------------------------------------------------


@query
def html_clean(t):
    return t.raw("pages").select("page_id", text.clean(F.col("html")).alias("content"))


@query
def article_ids(t):
    """Ids of events with a link, with an empty one and with none; these by source, title, content and time."""
    link = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("e://"), F.col("event_id"))).when(F.col("event_id") % 3 == 1, "")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return t.events().select("event_id", ids.article_id(link, F.col("event_type"), F.col("user_id"), F.col("props"), stamp).alias("id"))


@query
def uuid5_links(t):
    return t.raw("pages").select("page_id", ids.uuid5(F.col("url")).alias("id"))


@query
def hmac_hex(t):
    secret = F.concat(F.lit("key-"), F.repeat("event_type", (F.col("event_id") % 20).cast("int")))
    keyed = ids.with_hmac_keys(t.events(), secret, "inner", "outer")
    signature = ids.hmac_sha256(F.col("inner"), F.col("outer"), F.col("props"))
    return keyed.select("event_id", signature.alias("signature"))


@query
def unix_time(t):
    at = F.unix_micros("ts")
    number = F.element_at(
        F.array(at, F.floor(at / 1000), F.floor(at / 1000000), F.lit(10**12), F.lit(10**15)),
        (F.col("event_id") % 5 + 1).cast("int"),
    )
    return t.events().select(
        "event_id", F.unix_micros(times.unix_to_time(number)).alias("micros")
    )


@query
def rfc3339_time(t):
    form = F.element_at(
        F.array(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'"),
            F.date_format("ts", "yyyy-MM-dd"),
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        ),
        (F.col("event_id") % 4 + 1).cast("int"),
    )
    return t.events().select("event_id", times.rfc3339(form).cast("timestamp_ntz").alias("stamp"))


@query
def feed_date(t):
    form = F.element_at(
        F.array(
            F.concat(F.lit("Mon, "), F.date_format("ts", "dd MMM yyyy HH:mm:ss"), F.lit(" +0000")),
            F.concat(F.date_format("ts", "d MMM yyyy HH:mm:ss"), F.lit(" GMT")),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
            F.concat(F.lit("Tue, "), F.date_format("ts", "dd MMM yy HH:mm:ss"), F.lit(" GMT")),
            F.date_format("ts", "d MMMM yyyy HH:mm:ss"),
            F.concat(F.lit("Sunday, "), F.date_format("ts", "dd-MMM-yy HH:mm:ss"), F.lit(" GMT")),
            F.concat(F.lit("Fri "), F.date_format("ts", "MMM d HH:mm:ss yyyy")),
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
            F.lit("yesterday"),
        ),
        (F.col("event_id") % 9 + 1).cast("int"),
    )
    return t.events().select("event_id", times.feed_date(form).cast("timestamp_ntz").alias("stamp"))


# --- sources ---------------------------------------------------------------


def _xml(value: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(char), F.lit(entity))
    return value


def _feed_payloads(t) -> DataFrame:
    """Pages as one-item feeds: RSS, RSS with content, Atom, and an RSS item without link."""
    kind = F.col("page_id") % 4
    link, page = _xml(F.col("url")), _xml(F.col("html"))
    rss = lambda *body: F.concat(F.lit("<rss><channel><item><title>t</title>"), *body, F.lit("</item></channel></rss>"))
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    dated = tag("pubDate", F.lit("Thu, 02 Jan 2025 03:04:05 GMT"))
    body = (
        F.when(kind == 0, rss(tag("link", link), tag("description", page), dated))
        .when(kind == 1, rss(tag("link", link), tag("description", page), tag("content:encoded", F.lit("x"))))
        .when(
            kind == 2,
            F.concat(
                F.lit('<feed><entry><title>t</title><link rel="self" href="self"/><link href="'),
                link,
                F.lit('"/><summary>'),
                page,
                F.lit("</summary><updated>2025-01-02T03:04:05Z</updated></entry></feed>"),
            ),
        )
        .otherwise(rss(tag("description", page)))
    )
    names = F.array(*[F.lit(f"f-{x}") for x in ("view", "click", "purchase", "signup", "error")])
    source = F.element_at(names, (F.col("page_id") % 5 + 1).cast("int"))
    return t.raw("pages").select(source.alias("source_id"), body.alias("body"))


@query
def feed_articles(t):
    articles = feeds.feed_articles(feeds.feed_items(_feed_payloads(t)), AS_OF)
    return articles.select(
        "id", "title", F.md5("content").alias("content_md5"), plain("timestamp"), "link"
    )


@query
def feed_errors(t):
    """The same feeds spoiled: cut off, cut inside markup, no feed, no markup, blank, or JSON that is none."""
    n = F.col("page_id") % 8
    page = _xml(F.col("html"))
    body = (
        F.when(n == 0, F.concat(F.lit("<rss><channel><item><link>l</link><description>"), page))
        .when(n == 1, F.concat(F.lit("<html><body>"), page, F.lit("</body></html>")))
        .when(n == 2, F.concat(F.lit("just text "), F.col("url")))
        .when(n == 3, F.lit(" \n"))
        .when(n == 4, F.concat(F.lit('{"version": "https://jsonfeed.org/version/1.1", "items": [{"url": "'), F.col("url")))
        .when(n == 5, F.concat(F.lit('{"items": [], "n": '), F.col("page_id"), F.lit("}")))
        .when(n == 6, F.lit("<?xml version='1.0'?><rss><channel><title>nothing yet</title></channel></rss>"))
        .otherwise(F.concat(F.lit("<feed><entry><link href='l'/><summary>"), page, F.lit("</summary></entry></feed>")))
    )
    spoiled = t.raw("pages").select(F.concat(F.lit("f-"), n).alias("source_id"), body.alias("body"))
    return feeds.feed_errors(spoiled).groupBy("source_id", "error").agg(F.count(F.lit(1)).alias("n"))


@query
def json_feed_articles(t):
    """Pages as JSON feeds of two items, one of them linked by its id alone."""
    item = lambda n, link: F.struct(
        F.concat(F.lit(f"i{n}://"), F.col("page_id")).alias("id"), link.alias("url"), F.lit("t").alias("title"),
        F.col("html").alias("content_html"), F.lit("a summary").alias("summary"), F.lit("2024-05-06T07:08:09+02:00").alias("date_published"),
    )
    feed = F.struct(
        F.lit("https://jsonfeed.org/version/1.1").alias("version"), F.array(item(1, F.col("url")), item(2, F.lit(None).cast("string"))).alias("items")
    )
    payloads = t.raw("pages").select(F.lit("j").alias("source_id"), F.to_json(feed).alias("body"))
    articles = feeds.feed_articles(feeds.feed_items(payloads), AS_OF, F.lit("content"))
    return articles.select("id", "title", F.md5("content").alias("content_md5"), plain("timestamp"), "link")


@query
def feed_limits(t):
    """The first items of each feed document, for sources that set a limit; zero and none keep all three."""
    n = F.col("page_id")
    items = F.transform(F.array(*map(F.lit, range(3))), lambda i: F.struct(F.concat(F.col("url"), F.lit("#"), i.cast("string")).alias("url"), F.lit("s").alias("summary")))
    feed = F.struct(F.lit("https://jsonfeed.org/version/1.1").alias("version"), items.alias("items"))
    payloads = t.raw("pages").select(F.concat(F.lit("f-"), n % 4).alias("source_id"), F.to_json(feed).alias("body"))
    limits = t.spark.createDataFrame([("f-0", 1), ("f-1", 2), ("f-2", 0)], "source_id string, limit int")
    return feeds.limit_items(feeds.feed_items(payloads), limits).select("source_id", "link", F.col("seq").cast("bigint").alias("seq"))


@query
def feed_link_target(t):
    """Feeds whose source wants the link's text give nothing here; those that want the description give all that have one."""
    target = F.when(F.col("source_id") == "f-view", "link").when(F.col("source_id") == "f-click", "other").otherwise("description")
    articles = feeds.feed_articles(feeds.feed_items(_feed_payloads(t)), AS_OF, target)
    return articles.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@query
def archive_articles(t):
    """Documents written as archives of feed items, one RSS file and one of JSON lines a partition, read in ranges and told
    apart by nothing but their items."""
    docs = t.raw("documents")
    folder = _fresh_dir(t)
    link = F.concat(F.lit("doc://"), F.col("doc_id"))
    rows = docs.select(link.alias("link"), F.col("source").alias("title"), F.col("text").alias("description"))
    rows.filter("title < 'src2'").write.format("xml").option("rootTag", "rss").option("rowTag", "item").save(f"{folder}/rss")
    lines = rows.filter("NOT title < 'src2'").select(F.col("link").alias("url"), "title", F.col("description").alias("summary"))
    lines.write.json(f"{folder}/jsonl")
    items = reduce(
        DataFrame.unionByName, [feeds.archive_items(t.spark, f"{folder}/{kind}", kind, kind) for kind in ("rss", "jsonl")]
    )
    articles = feeds.feed_articles(items, AS_OF)
    return articles.select("id", "source_id", "title", F.octet_length("content").cast("bigint").alias("size"), "link")


def _sources(t) -> DataFrame:
    """Event types as sources: one row each."""
    kinds = t.events().select("event_type").distinct()
    paths = F.struct(
        F.lit("t").alias("title"),
        F.lit("body.text").alias("content"),
        F.lit("at").alias("timestamp"),
        F.lit("link").alias("link"),
        F.when(F.col("event_type").isin("view", "click"), "data.items").otherwise("$").alias("items"),
    )
    signed = F.col("event_type").isin("view", "error")
    row = {
        "id": F.concat(F.lit("s-"), F.col("event_type")),
        "type": F.lit("webhook"),
        "name": F.col("event_type"),
        "url": webhooks.webhook_url(F.col("event_type")),
        "active": F.col("event_type") != "signup",
        "trust": F.lit("low"),
        "description": F.lit(""),
        "tags": F.array(F.lit("a")),
        "auth": F.when(
            signed,
            F.struct(
                F.lit("hmac").alias("kind"),
                F.lit(None).cast("string").alias("header"),
                F.concat(F.lit("key-"), "event_type").alias("secret"),
            ),
        ),
        "extract": paths,
        "spec": F.to_json(F.struct(F.concat(F.lit("/"), "event_type").alias("path"))),
    }
    return kinds.select(*[v.alias(k) for k, v in row.items()])


def _json_item(t) -> Column:
    """One JSON item per event, its time given in one of eight ways."""
    at = F.unix_micros("ts")
    forms = [
        F.date_format("ts", "'\"'yyyy-MM-dd'T'HH:mm:ss'Z\"'"),
        F.floor(at / 1000000).cast("string"),
        F.floor(at / 1000).cast("string"),
        at.cast("string"),
        F.date_format("ts", "'\"'yyyy-MM-dd'\"'"),
        F.lit("true"),
        F.lit("null"),
        F.date_format("ts", "'\"'yyyy-MM-dd'T'HH:mm:ss'+02:00\"'"),
    ]
    stamp = reduce(
        lambda chain, n: chain.when(F.col("event_id") % 8 == n, forms[n]),
        range(1, 8),
        F.when(F.col("event_id") % 8 == 0, forms[0]),
    )
    title = F.when(F.col("event_id") % 3 == 0, F.lit("5")).otherwise(
        F.concat(F.lit('"'), "event_type", F.lit('"'))
    )
    return F.concat(
        F.lit('{"t":'),
        title,
        F.lit(',"body":{"text":'),
        F.to_json(F.struct(F.col("props").alias("p"))).substr(F.lit(6), F.length("props") * 2 + 20),
        F.lit(',"at":'),
        stamp,
        F.lit(',"link":"e://'),
        F.col("event_id").cast("string"),
        F.lit('"}'),
    )


def _responses(t) -> DataFrame:
    """Endpoint responses: whole, with a non-object item, cut short, or with the items in
    the wrong place."""
    item = _json_item(t)
    case = F.col("event_id") % 5
    nested = F.col("event_type").isin("view", "click")
    wrap = lambda array: F.when(nested, F.concat(F.lit('{"data":{"items":'), array, F.lit("}}"))).otherwise(array)
    body = (
        F.when(case == 1, wrap(F.concat(F.lit("[5,"), item, F.lit(',"x"]'))))
        .when(case == 3, F.concat(F.lit("["), item))
        .when(case == 4, F.concat(F.lit('{"other":['), item, F.lit("]}")))
        .otherwise(wrap(F.concat(F.lit("["), item, F.lit("]"))))
    )
    payloads = t.events().select(
        F.concat(F.lit("s-"), "event_type").alias("source_id"), body.alias("body")
    )
    return json_api.with_extract(payloads, _sources(t))


def _plain_articles(df: DataFrame) -> DataFrame:
    return df.select("id", "source_id", "title", "content", plain("timestamp"), "link")


@query
def json_articles(t):
    return _plain_articles(json_api.response_articles(_responses(t), AS_OF))


@query
def json_errors(t):
    bad = json_api.response_errors(_responses(t))
    return bad.groupBy("source_id", "error").agg(F.count(F.lit(1)).alias("n"))


def _deliveries(t) -> DataFrame:
    """Deliveries for every event: signed rightly, wrongly or not at all; some with a body
    that is cut short or lacks content; some to a path nobody listens on."""
    item = _json_item(t)
    n = F.col("event_id")
    body = (
        F.when(n % 7 == 3, F.concat(item, F.lit("}")))
        .when(n % 7 == 5, F.lit('{"t":"x"}'))
        .when(n % 7 == 6, F.concat(F.lit("["), item, F.lit("]")))
        .otherwise(item)
    )
    path = F.when(n % 11 == 0, F.lit("/nowhere")).otherwise(F.concat(F.lit("/"), "event_type"))
    # Signed under constant keys per type, padded here.
    padded = {x: f"key-{x}".encode().ljust(64, b"\0") for x in ("view", "click", "purchase", "signup", "error")}
    keys = [
        reduce(
            lambda chain, x: F.when(F.col("event_type") == x, F.lit(bytes(b ^ mask for b in padded[x]))).otherwise(chain),
            padded,
            F.lit(b""),
        )
        for mask in (0x36, 0x5C)
    ]
    events = t.events().withColumn("body", body)
    header = F.when(n % 4 == 1, F.create_map(F.lit("Other"), F.lit("x"))).otherwise(
        F.create_map(
            F.lit("x-signature"),
            F.when(n % 4 == 2, F.lit("00")).otherwise(
                ids.hmac_sha256(*keys, F.col("body"))
            ),
        )
    )
    return events.select(
        n.alias("event_id"), F.lit(None).cast("string").alias("source_id"), path.alias("path"), header.alias("headers"), "body"
    )


@query
def webhook_status(t):
    judged = webhooks.judge_deliveries(_deliveries(t), webhooks.routes(_sources(t)))
    return judged.select("event_id", F.col("status").cast("bigint").alias("status"))


@query
def webhook_articles(t):
    judged = webhooks.judge_deliveries(_deliveries(t), webhooks.routes(_sources(t)))
    return _plain_articles(webhooks.delivery_articles(judged, AS_OF))


@query
def articles_of_all_kinds(t):
    """Feeds, responses and deliveries read into one table; counted per type and source."""
    hooks = _sources(t)
    apis = hooks.withColumns({"type": F.lit("http"), "id": F.concat(F.lit("h"), "id")})
    feed = hooks.withColumns(
        {"type": F.lit("rss"), "id": F.concat(F.lit("f-"), "name"), "spec": F.lit(None).cast("string")}
    )
    responses = _responses(t).drop("paths").withColumn("source_id", F.concat(F.lit("h"), "source_id"))
    every = ingest.read_all(
        {"rss": _feed_payloads(t), "http": responses, "webhook": _deliveries(t)},
        hooks.unionByName(apis).unionByName(feed),
        AS_OF,
    )
    return every.groupBy("source_type", "source_id").agg(F.count(F.lit(1)).alias("n"))


@query
def upload_classifications(t):
    """Classifications written out as upload items and read back; every third has a time
    nobody can read."""
    stamp = F.when(F.col("id").cast("bigint") % 3 == 0, "not-a-time").otherwise(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    )
    items = t.classifications().withColumn("timestamp", stamp)
    texts = items.withColumn("classification", F.lit("Events")).select(F.to_json(F.struct("*")).alias("j"))
    parsed = texts.select(F.from_json("j", schemas.UPLOADS).alias("u")).select("u.*")
    rows = uploads.uploaded_classifications(parsed, AS_OF)
    return exploded(rows, "classification", "id", "article_id", plain("timestamp"))


@query
def scrape_split(t):
    """Scraper results split into url states and articles, as (kind, key, value) rows."""
    n = F.col("page_id")
    results = t.raw("pages").select(
        F.when(n % 5 == 0, "error").when(n % 5 == 1, "retry").otherwise("completed").alias("type"),
        F.lit("s").alias("source_id"),
        F.col("url"),
        F.when(n % 3 == 0, "").otherwise("a title").alias("title"),
        F.col("html").alias("content"),
        F.lit("2024-05-06T07:08:09Z").alias("timestamp"),
        F.when(n % 5 == 0, "boom").otherwise("").alias("reason"),
    )
    urls = uploads.scraped_urls(results).select(
        F.lit("url").alias("kind"), F.col("url").alias("key"), F.concat_ws("/", "type", "error").alias("value")
    )
    made = uploads.scraped_articles(results, AS_OF).select(
        F.lit("article").alias("kind"),
        F.col("id").alias("key"),
        F.concat_ws("/", "title", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).alias("value"),
    )
    return urls.unionByName(made)


@query
def sources_active(t):
    return rates.sources_scan(_sources(t), "webhook").select("id", "url", "trust")


@query
def attach_source(t):
    """Events as articles, matched with active sources; the rest is set aside."""
    articles = t.event_articles().withColumn("source_id", F.concat(F.lit("s-"), "source_id"))
    known, unknown = ingest.attach_source(articles, _sources(t))
    count = lambda df, tag: df.groupBy(F.lit(tag).alias("part"), "source_id").agg(F.count(F.lit(1)).alias("n"))
    return count(known, "known").unionByName(count(unknown, "unknown"))


# --- writes ----------------------------------------------------------------


@query
def insert_if_absent(t):
    """Lineitems as a batch full of repeated links, against the orders already stored."""
    link = F.concat(F.lit("o://"), F.col("l_orderkey"))
    batch = t.raw("lineitem").select(
        ids.article_id(link).alias("id"),
        link.alias("link"),
        F.concat_ws(
            "/", "l_partkey", "l_suppkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("bigint")
        ).alias("title"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias("seq"),
        F.col("l_quantity").alias("quantity"),
    )
    first = batch.withColumn("seq", F.struct("seq", "title"))
    stored = t.raw("orders").filter("o_orderstatus <> 'O'")
    existing = stored.select(ids.article_id(F.concat(F.lit("o://"), "o_orderkey")).alias("id"))
    return merge.new_articles(first, existing, order="seq").select("id", "link", "title")


def _stored_sources(t) -> DataFrame:
    """Suppliers as stored sources."""
    key = F.col("s_suppkey")
    old = t.raw("supplier").select(
        F.concat(F.lit("id-"), key).alias("id"),
        F.lit("rss").alias("type"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("http://s/"), key).alias("url"),
        (key % 2 == 0).alias("active"),
        F.lit("low").alias("trust"),
        F.lit("").alias("description"),
        F.array(F.lit("x")).alias("tags"),
        F.lit("2023-01-01 00:00:00").cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("updated_at"),
    )
    return merge.with_source_hash(old)


def _configured_sources(t) -> DataFrame:
    """The same shifted: a tenth renamed, a third gone, as many new ones."""
    key = F.col("s_suppkey")
    fresh = t.raw("supplier").select(
        F.lit("rss").alias("type"),
        F.when(key % 10 == 1, F.concat("s_name", F.lit(" v2"))).otherwise(F.col("s_name")).alias("name"),
        F.when(key % 3 == 0, F.concat(F.lit("http://new/"), key)).otherwise(F.concat(F.lit("http://s/"), key)).alias("url"),
        (key % 2 == 0).alias("active"),
        F.lit("low").alias("trust"),
        F.lit("").alias("description"),
        F.array(F.lit("x")).alias("tags"),
    )
    return merge.with_source_hash(fresh)


@query
def source_sync_diff(t):
    return merge.source_changes(_configured_sources(t), _stored_sources(t))


@query
def source_sync(t):
    synced = merge.sync_sources(_configured_sources(t), _stored_sources(t), AS_OF)
    return synced.select("id", "name", "url", "active", plain("created_at"), plain("updated_at"))


@query
def source_upsert(t):
    batch = _configured_sources(t).filter("active")
    rows = merge.upsert_sources(_stored_sources(t), batch, AS_OF)
    return rows.select("id", "name", "url", "active", plain("created_at"), plain("updated_at"))


@query
def source_delete(t):
    """Inactive suppliers deleted along with their parts' urls; what is left, counted."""
    stored = _stored_sources(t)
    urls = t.raw("lineitem").select(
        F.concat(F.lit("id-"), "l_suppkey").alias("source_id"), F.col("l_orderkey").alias("url")
    )
    left, left_urls = merge.delete_sources(stored, urls, stored.filter("NOT active"))
    per = left_urls.groupBy("source_id").agg(F.count(F.lit(1)).alias("urls"))
    return left.select(F.col("id").alias("source_id"), "name").join(per, "source_id")


@query
def classification_reconcile_plan(t):
    """Stored attributes per event type against a configuration that drops one type, adds
    one, and changes the attributes of the rest."""
    stored = t.classifications(name=F.col("event_type"))
    wanted = {
        "view": ["vector", "tier"],
        "click": ["vector", "actor"],
        "purchase": ["sector"],
        "error": ["severity", "tier", "actor"],
        "brand": ["only"],
    }
    plan = merge.classification_changes(stored, merge.config_keys(t.spark, wanted))
    return plan.select(
        "classification",
        "action",
        F.concat_ws(",", "add").alias("added"),
        F.concat_ws(",", "remove").alias("removed"),
    )


@query
def classification_reconcile(t):
    """The plan applied: scores left per stored classification and attribute, and metrics left per classification."""
    stored = t.classifications(name=F.col("event_type"))
    wanted = {"view": ["vector", "tier"], "click": ["vector", "actor"], "error": ["severity", "tier", "actor"], "brand": ["only"]}
    changes = merge.classification_changes(stored, merge.config_keys(t.spark, wanted)).collect()
    rows = exploded(merge.reconcile(stored, changes), "classification").groupBy("classification", "category", "label")
    kept = merge.reconcile_metrics(t.metrics().withColumn("classification", F.col("label")), changes)
    left = kept.groupBy("classification").agg(F.count(F.lit(1)).alias("n"))
    counted = rows.agg(F.count(F.lit(1)).alias("n"))
    return counted.unionByName(left.select("classification", F.lit("metrics").alias("category"), F.lit("all").alias("label"), "n"))


@query
def key_drift(t):
    data = scores.add_keys(scores.remove_keys(F.col("data"), ["tier"]), ["vector", "actor"])
    return exploded(t.classifications().withColumn("data", data), "id")


# --- classification --------------------------------------------------------


@query
def flatten_metrics(t):
    rows = c.flatten(t.classifications())
    return rows.groupBy("classification", "category", "label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("score")
    )


@query
def topn_sentinel(t):
    """Three scores per event, cut at 0.6 and trimmed to two."""
    three = F.array(
        F.struct(F.lit("a").alias("label"), score().alias("score")),
        F.struct(F.lit("b").alias("label"), (1.0 - score()).alias("score")),
        F.struct(F.lit("c").alias("label"), ((F.col("event_id") % 10) / 10.0).alias("score")),
    )
    best = top_scores(three.cast(schemas.SCORES), 0.6, 2)
    return t.events().select("event_id", F.posexplode(best).alias("pos", "s")).select(
        "event_id", F.col("pos").cast("bigint").alias("pos"), "s.label", "s.score"
    )


def _classified(df: DataFrame) -> DataFrame:
    return rounded(exploded(df, "classification", "article_id", plain("timestamp")), "score")


@query
def classify_lexical(t):
    return _classified(c.classify(t.documents(), SPEC))


@query
def classify_scorer(t):
    """The same through the Python scorer interface."""
    return _classified(c.split_failures(c.classify_with(t.documents(), SPEC)).rows)


@query
def classify_per_source(t):
    """Sources that want nothing classified, next to those that want everything."""
    wanted = {"src0": [], "src1": ["Other"], "src2": ["Prose"]}
    rows = c.classify(t.documents(), SPEC, wanted)
    return rows.select("classification", "article_id")


def _raw_reply() -> Column:
    """Model replies of every shape, by event."""
    a, b = score().cast("string"), F.lit("0.25")
    flat = F.concat(F.lit('{"A": '), a, F.lit(', "B": '), b, F.lit("}"))
    return F.element_at(
        F.array(
            flat,
            F.concat(F.lit("```json\n"), flat, F.lit("\n```")),
            F.concat(F.lit('{"labels": '), flat, F.lit("}")),
            F.concat(F.lit('{"A": "'), a, F.lit('"}')),
            F.lit("not json"),
            F.lit("  "),
            F.concat(F.lit('{"A": '), a, F.lit(', "B": "x"}')),
        ),
        (F.col("event_id") % 7 + 1).cast("int"),
    )


@query
def label_score_parse(t):
    replies = t.events().select("event_id", _raw_reply().alias("raw"))
    parsed = scores.with_label_scores(replies, "raw")
    return parsed.select("event_id", F.explode_outer("scores").alias("s"), "error").select(
        "event_id", "s.label", "s.score", "error"
    )


@query
def classify_replies(t):
    """Stored replies to two attributes of each event: rows, sentinels and errors."""
    base = t.events().withColumn("raw", _raw_reply())
    one = base.select(
        F.col("event_id").cast("string").alias("article_id"),
        F.lit("Prose").alias("classification"),
        F.explode(F.array(F.lit("language"), F.lit("content"))).alias("attribute"),
        "raw",
    )
    rows = c.classify_replies(one, t.event_articles(), SPEC)
    flat = rows.select(
        "article_id", plain("timestamp"), "error", F.explode_outer("data").alias("category", "scores")
    )
    return flat.select("article_id", "timestamp", "error", "category", F.explode_outer("scores").alias("s")).select(
        "article_id", "timestamp", "error", "category", "s.label", "s.score"
    )


@query
def classify_replies_again(t):
    """Replies given twice, an hour apart: the newer one counts, whichever comes first."""
    base = t.events().withColumn("raw", _raw_reply())
    asked = F.explode(F.array(F.lit("language"), F.lit("content"))).alias("attribute")
    first = base.select(F.col("event_id").cast("string").alias("article_id"), F.lit("Prose").alias("classification"), asked, "raw", F.col("ts").alias("received_at"))
    again = first.withColumns({"raw": F.lit('{"A": 0.75, "B": 0.125}'), "received_at": F.col("received_at") + F.expr("INTERVAL 1 HOUR") * F.when(F.col("article_id") % 2 == 0, 1).otherwise(-1)})
    rows = c.classify_replies(again.unionByName(first), t.event_articles(), SPEC)
    flat = rows.select("article_id", "error", F.explode_outer("data").alias("category", "scores"))
    return flat.select("article_id", "error", "category", F.explode_outer("scores").alias("s")).select("article_id", "error", "category", "s.label", "s.score")


@query
def dead_letters(t):
    failed = t.events().filter("event_type = 'error'").select(
        F.col("user_id").cast("string").alias("article_id"),
        F.lit("events").alias("classification"),
        F.concat(F.lit("boom "), F.col("event_id") % 3).alias("error"),
        F.col("event_id").alias("batch_id"),
    )
    return c.dead_letters(failed, 5)


# --- views -----------------------------------------------------------------

VIEW = View(
    "overview",
    "Overview",
    (
        Panel("p1", Query("heatmap", "events", label="view", range=Range("week", 2))),
        Panel("p2", Query("treemap", "events", attribute="severity", cutoff=0.2)),
        Panel("p3", Query("scatter", "events", labels=("view", "error"), cutoff=0.95)),
        Panel("p4", Query("scatter3d", "events", attribute="vector", cutoff=0.98)),
        Panel("p5", Query("spark", range=Range("month", 1))),
        Panel("p6", Query("list")),
        Panel("p7", Query("list", variant="source")),
        Panel("p8", Query("stats", "events", range=Range("day", 3))),
        Panel("p9", Query("quadrant", "events", label="click", range=Range("week", 1), range_b=Range(start=START))),
        Panel("e1", Query("quadrant", "events", label="click")),
        Panel("e2", Query("status")),
        Panel("e3", Query("tree")),
        Panel("e4", Query("pie")),
        Panel("e5", Query("list", variant="user")),
        Panel("e6", Query("stats", target="articles")),
    ),
)

# Panel kind -> (key, value) of one of its rows.
_PANEL_ROWS = {
    "heatmap": ("cast(day AS string)", "round(value, 6)"),
    "treemap": ("label", "count"),
    "scatter": ("concat_ws('/', article_id, label, title)", "round(y, 6)"),
    "scatter3d": ("concat_ws('/', article_id, label, cast(z AS int))", "round(y, 6)"),
    "spark": ("cast(index AS string)", "value"),
    "list": ("concat_ws('/', id, title)", "0"),
    "stats": ("'count'", "count"),
    "quadrant": ("label", "round(frequency, 6)"),
}


@query
def render_view(t):
    """All panels as (panel, key, value) rows; a panel without data gives its error."""
    # Points link to customers, article panels show events.
    tables = [
        ViewTables(t.metrics(), t.classifications(), articles, _sources(t), LABEL_AXIS)
        for articles in (t.event_articles(), t.articles())
    ]
    of_events, of_customers = ({r.panel.id: r for r in render(VIEW, x, AS_OF)} for x in tables)
    parts = []
    for panel in VIEW.panels:
        kind = panel.query.kind
        shown = (of_customers if kind.startswith("scatter") else of_events)[panel.id]
        if shown.data is None:
            rows = t.spark.range(1).select(F.lit(shown.error).alias("key"), F.lit(None).alias("value"))
        elif panel.query.variant == "source":
            rows = shown.data.selectExpr("concat_ws('/', id, url) AS key", "0 AS value")
        else:
            key, value = _PANEL_ROWS[kind]
            rows = shown.data.selectExpr(f"{key} AS key", f"{value} AS value")
        parts.append(rows.select(F.lit(panel.id).alias("panel"), "key", F.col("value").cast("double")))
    return reduce(DataFrame.unionByName, parts)


# --- streams ---------------------------------------------------------------


def _fresh_dir(t) -> str:
    base = shared_dir(t.spark, tempfile.gettempdir())
    return f"{base}/tidemark-{uuid.uuid4().hex}"


def _document_stream(t) -> DataFrame:
    """Documents as webhook deliveries, read as a stream."""
    columns = t.raw("documents").schema
    body = F.to_json(
        F.struct(
            F.col("source").alias("t"),
            F.struct(F.col("text").alias("text")).alias("body"),
            F.concat(F.lit("doc://"), F.col("doc_id")).alias("link"),
            (F.lit(1704067200) + F.col("doc_id") * 60).alias("at"),
        )
    )
    return t.stream("documents", columns).select(
        F.lit(None).cast("string").alias("source_id"),
        F.lit("/docs").alias("path"),
        F.create_map(F.lit("h"), F.lit("v")).alias("headers"),
        body.alias("body"),
    )


def _document_source(t) -> DataFrame:
    row = {
        "id": "s-docs",
        "type": "webhook",
        "name": "docs",
        "url": "webhook://docs",
        "active": True,
        "trust": "low",
        "tags": [],
        "extract": {"title": "t", "content": "body.text", "timestamp": "at", "link": "link", "items": ""},
        "spec": '{"path":"docs"}',
    }
    return t.spark.createDataFrame([row], schemas.SOURCES)


def _pipeline(t, store: Store, **options) -> ingest.Pipeline:
    return ingest.Pipeline(
        store,
        "webhook",
        _document_source(t),
        SPEC,
        filters={"webhook://docs": f.parse_filters(["content.len.gte.500"])},
        as_of=lambda: AS_OF,
        **options,
    )


@query
def stream_ingest(t):
    """Documents through the whole write path as a stream, run twice: the second run finds
    nothing new."""
    folder = _fresh_dir(t)
    store = Store(t.spark, f"{folder}/tables")
    for attempt in (1, 2):
        # A new checkpoint makes the second run deliver everything again.
        ingest.ingest_available(_document_stream(t), _pipeline(t, store), f"{folder}/checkpoint-{attempt}")
    return store.metrics().groupBy("classification", "category", "label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("score")
    )


def _stored_scores(store: Store) -> DataFrame:
    return store.metrics().groupBy("classification", "category", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("score"))


@query
def classify_brought(t):
    """Articles a caller brings along: classified at once, stored with their metrics, not marked as processed."""
    store = Store(t.spark, f"{_fresh_dir(t)}/tables")
    _pipeline(t, store).classify(t.documents(), 0, mark_processed=False)
    marked = store.processed().agg(F.count(F.lit(1)).alias("n")).select(F.lit("").alias("classification"), F.lit("processed").alias("category"), F.lit("").alias("label"), "n", F.lit(0.0).alias("score"))
    return _stored_scores(store).unionByName(marked)


@query
def drain_unprocessed(t):
    """Articles stored, some of them marked as processed before; a drain classifies the rest, a second one finds nothing."""
    store = Store(t.spark, f"{_fresh_dir(t)}/tables")
    pipeline = _pipeline(t, store)
    docs = t.documents()
    store.write_articles(docs, Batch("landed", 0))
    pipeline.classify(docs.filter("content LIKE '%the%'"), Batch("landed", 0))
    pipeline.drain(0)
    pipeline.drain(1)
    return _stored_scores(store)


@query
def stream_rollup(t):
    """Label metrics out of the rollup that the write path has kept up, batch by batch."""
    folder = _fresh_dir(t)
    store = Store(t.spark, f"{folder}/tables")
    ingest.ingest_available(_document_stream(t), _pipeline(t, store), f"{folder}/checkpoint")
    kept = rollup.Rollup(store.moments(), store.metrics())
    return rounded(kept.label_metrics("prose"), "mean", "var")


def _beat_stream(t) -> DataFrame:
    rows = t.stream("events", t.events().schema)
    return rows.select(F.col("event_type").alias("service"), F.col("ts").alias("timestamp"))


@query
def stream_uptime(t):
    """The uptime table a heartbeat stream leaves, open intervals included."""
    folder = _fresh_dir(t)
    store = Store(t.spark, f"{folder}/tables")
    sessions.start_uptime(_beat_stream(t), store, f"{folder}/checkpoint", BEAT_GAP).awaitTermination()
    return _plain_intervals(store.uptime())


@query
def stream_uptime_closed(t):
    """Of these the intervals that are closed for good, an hour being allowed for late beats."""
    folder = _fresh_dir(t)
    store = Store(t.spark, f"{folder}/tables")
    sessions.start_uptime(_beat_stream(t), store, f"{folder}/checkpoint", BEAT_GAP, dt.timedelta(hours=1)).awaitTermination()
    return _plain_intervals(store.closed_uptime())


def _drained(t, rows: DataFrame, folder: str) -> DataFrame:
    run = (
        rows.writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(f"{folder}/rows")


@query
def stream_closed_intervals(t):
    """Intervals no later beat can extend, given the watermark the stream reached."""
    folder = _fresh_dir(t)
    return _plain_intervals(_drained(t, sessions.closed_intervals(_beat_stream(t), BEAT_GAP, "1 hour"), folder))


@query
def stream_dedupe(t):
    """One article per link out of a stream in which users repeat."""
    rows = t.stream("events", t.events().schema)
    link = F.concat(F.lit("u://"), F.col("user_id"))
    articles = rows.select(ids.article_id(link).alias("id"), link.alias("link"), F.col("ts").alias("timestamp"))
    folder = _fresh_dir(t)
    return _drained(t, ingest.bounded_dedupe(articles, "60 days").select("id", "link"), folder)


@query
def stream_dedupe_all(t):
    """The same against all history, by keyed state."""
    rows = t.stream("events", t.events().schema)
    link = F.concat(F.lit("u://"), F.col("user_id"))
    with_rocksdb(t.spark)
    return _drained(t, ingest.new_in_stream(rows.select(ids.article_id(link).alias("id"), link.alias("link"))), _fresh_dir(t))


@query
def stream_near_copies(t):
    """Near copies told as the articles stream in, with an hour of vectors as state."""
    articles = _embedded(t.stream("embeddings", t.raw("embeddings").schema)).withWatermark("timestamp", "1 hour")
    with_rocksdb(t.spark)
    return _drained(t, near.near_copies(articles, NEAR_WINDOW, NEAR_COSINE).select("id"), _fresh_dir(t)).distinct()
