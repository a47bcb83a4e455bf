"""RSS, RDF, Atom and JSON feeds to articles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import article_id
from ..functions.text import clean, select_content
from ..functions.times import feed_date, timestamp_literal

_RSS_FIELDS = (
    "title string, link string, description string, `content:encoded` string, pubDate string, "
    "`dc:date` string"
)
_ATOM_FIELDS = (
    "title string, link array<struct<_href string, _rel string>>, summary string, content string, "
    "published string, updated string"
)
_RSS_ITEM, _ATOM_ENTRY = f"struct<{_RSS_FIELDS}>", f"struct<{_ATOM_FIELDS}>"
_FEED = f"channel struct<item: array<{_RSS_ITEM}>>, item array<{_RSS_ITEM}>, entry array<{_ATOM_ENTRY}>"


_JSON_ITEM = (
    "struct<id string, url string, external_url string, title string, content_html string, content_text string, summary string, "
    "date_published string, date_modified string>"
)
_JSON_FEED = f"version string, items array<{_JSON_ITEM}>"
_UNREAD = "_unread"
# The first element of a document, past its declaration, comments and document type.
_ROOT = r"^(?:\s|\x{FEFF}|<\?[^>]*>|<!--(?s:.*?)-->|<![A-Za-z][^>]*>)*<([\w:.-]+)"
FEED_ROOTS = ("rss", "rdf:rdf", "rdf", "feed")


def _rss_fields(item: Column) -> Column:
    return F.struct(
        item["title"].alias("title"),
        item["link"].alias("link"),
        item["description"].alias("description"),
        item["content:encoded"].alias("content"),
        F.coalesce(item["pubDate"], item["dc:date"]).alias("published"),
    )


def _atom_fields(entry: Column) -> Column:
    pages = F.filter(entry["link"], lambda x: x["_rel"].isNull() | x["_rel"].isin("", "alternate"))
    return F.struct(
        entry["title"].alias("title"),
        F.get(pages["_href"], 0).alias("link"),
        entry["summary"].alias("description"),
        entry["content"].alias("content"),
        F.coalesce(entry["published"], entry["updated"]).alias("published"),
    )


def _json_fields(item: Column) -> Column:
    return F.struct(
        item["title"].alias("title"),
        F.coalesce(item["url"], item["external_url"], item["id"]).alias("link"),
        item["summary"].alias("description"),
        F.coalesce(item["content_html"], item["content_text"]).alias("content"),
        F.coalesce(item["date_published"], item["date_modified"]).alias("published"),
    )


def read_feeds(payloads: DataFrame) -> DataFrame:
    """Payloads (source_id, body) with the ``items`` of their feed document, in order, and ``error``, why there are none to be
    read: a document that is cut off or no XML or JSON at all, or one that is no feed. A feed without items is no error."""
    is_json = F.col("body").rlike(r"^\s*\{")
    parsed = payloads.withColumns(
        {
            "feed": F.when(~is_json, F.from_xml(F.col("body"), f"{_FEED}, `{_UNREAD}` string", {"columnNameOfCorruptRecord": _UNREAD})),
            "json_feed": F.when(is_json, F.from_json("body", f"{_JSON_FEED}, `{_UNREAD}` string", {"columnNameOfCorruptRecord": _UNREAD})),
            "root": F.lower(F.regexp_extract("body", _ROOT, 1)),
        }
    )
    of = lambda column, kind: F.coalesce(column, F.array().cast(f"array<{kind}>"))
    items = F.concat(
        F.transform(of("feed.channel.item", _RSS_ITEM), _rss_fields),
        F.transform(of("feed.item", _RSS_ITEM), _rss_fields),
        F.transform(of("feed.entry", _ATOM_ENTRY), _atom_fields),
        F.transform(of("json_feed.items", _JSON_ITEM), _json_fields),
    )
    version = F.coalesce("json_feed.version", F.lit(""))
    error = (
        F.when(F.coalesce("body", F.lit("")).rlike(r"^\s*$"), "feed is empty")
        .when(F.col(f"json_feed.{_UNREAD}").isNotNull(), "feed is not json")
        .when(F.col(f"feed.{_UNREAD}").isNotNull(), "feed is not xml, or is cut off")
        .when(F.coalesce(is_json, F.lit(False)) & ~F.contains(version, F.lit("jsonfeed.org")), "not a feed")
        .when(~F.coalesce(is_json, F.lit(False)) & ~F.col("root").isin(*FEED_ROOTS), "not a feed")
    )
    return parsed.select("source_id", "body", F.when(error.isNull(), items).alias("items"), error.alias("error"))


def feed_items(payloads: DataFrame) -> DataFrame:
    """(source_id, seq, title, link, description, content, published), one row per item,
    from (source_id, body) rows that each hold one feed document."""
    # The outer form: for the plain one Spark adds a filter on the array, which parses everything again below.
    return (
        read_feeds(payloads)
        .select("source_id", F.posexplode_outer("items").alias("seq", "item"))
        .filter("item IS NOT NULL")
        .select("source_id", "seq", "item.*")
    )


def feed_errors(payloads: DataFrame) -> DataFrame:
    """(source_id, body, error) of the documents no item can be read from."""
    return read_feeds(payloads).select("source_id", "body", F.explode_outer(F.array("error")).alias("error")).filter("error IS NOT NULL")


def archive_items(spark: SparkSession, path: str, source_id: str, kind: str = "rss", *, stream: bool = False) -> DataFrame:
    """Items of archives of feeds in a folder (UTF-8), as a batch or as files arrive: for documents too large for a column.

    A file is read as text whose lines end with an item's closing tag. Spark reads such files in ranges of bytes: a
    range begins after the first end in it and goes on to the end of the item it is cut in, so a single file of
    any size is read by many tasks and each item once. ``seq`` is not set, as ranges have no common order, and what can't
    be parsed is skipped. A closing tag within CDATA ends its item all the same. ``jsonl`` archives hold one JSON Feed item a line.
    """
    reader = spark.readStream if stream else spark.read
    if kind == "jsonl":
        rows, fields = reader.schema(_JSON_ITEM.removeprefix("struct<").removesuffix(">")).json(path), _json_fields
        item = F.struct(*rows.columns)
    else:
        tag, schema, fields = ("item", _RSS_FIELDS, _rss_fields) if kind == "rss" else ("entry", _ATOM_FIELDS, _atom_fields)
        rows = reader.option("lineSep", f"</{tag}>").text(path)
        begun = F.regexp_extract("value", rf"(?s)<{tag}(?=[\s>]).*", 0)
        rows = rows.select(F.when(begun != "", F.concat(begun, F.lit(f"</{tag}>"))).alias("one")).filter("one IS NOT NULL")
        # A step of its own: each of the fields below would parse again.
        rows = rows.select(F.explode(F.array(F.from_xml("one", f"{schema}, `{_UNREAD}` string", {"columnNameOfCorruptRecord": _UNREAD}))).alias("item"))
        rows = rows.filter(F.col(f"item.{_UNREAD}").isNull())
        item = F.col("item")
    return rows.select(F.explode(F.array(fields(item))).alias("item")).select(
        F.lit(source_id).alias("source_id"), F.lit(None).cast("int").alias("seq"), "item.*"
    )


def limit_items(items: DataFrame, limits: DataFrame) -> DataFrame:
    """The first ``limit`` items of each feed document, for sources that set one
    (source_id, limit); 0 or no limit keeps all. Items are numbered, so nothing is ranked."""
    bounded = items.join(limits.select("source_id", "limit"), "source_id", "left")
    return bounded.filter(
        F.coalesce(F.col("limit"), F.lit(0)).eqNullSafe(0) | (F.col("seq") < F.col("limit"))
    ).drop("limit")


def feed_articles(items: DataFrame, as_of: dt.datetime, target: Column | None = None) -> DataFrame:
    """Articles of feed items. Items without a link, or without text once cleaned, are
    skipped; an item without a readable date gets ``as_of``."""
    picked = select_content(
        F.lit(None).cast("string") if target is None else target, F.col("content"), F.col("description")
    )
    return (
        items.filter(F.coalesce("link", F.lit("")) != "")
        .select(
            article_id(F.col("link")).alias("id"),
            "source_id",
            F.lit("rss").alias("source_type"),
            F.coalesce("title", F.lit("")).alias("title"),
            clean(F.coalesce(picked, F.lit(""))).alias("content"),
            F.coalesce(feed_date(F.col("published")), timestamp_literal(as_of)).alias("timestamp"),
            "link",
            F.lit(False).alias("processed"),
        )
        .filter(F.col("content") != "")
    )
