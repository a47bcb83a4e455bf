"""JSON endpoint responses to articles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import article_id
from ..functions.payload import (
    extract_items,
    is_object,
    items_path,
    variant_path,
    with_json,
    with_strings,
    with_time,
)
from ..functions.times import timestamp_literal


def extract_paths(sources: DataFrame) -> Column:
    """The ``extract`` dot-paths of a source as variant paths, NULL for a source without."""
    named = [variant_path(F.col(f"extract.{x}")).alias(x) for x in ("title", "content", "timestamp", "link")]
    has_items = "items" in sources.schema["extract"].dataType.fieldNames()
    whole = F.col("extract.items") if has_items else F.lit("")
    return F.when(F.col("extract").isNotNull(), F.struct(*named, items_path(whole).alias("items")))


def with_extract(payloads: DataFrame, sources: DataFrame) -> DataFrame:
    """Payloads with the extraction paths of their source. The sources table is as small
    as the configuration, and is broadcast: payloads of one source may be most of a batch."""
    paths = sources.select(F.col("id").alias("source_id"), extract_paths(sources).alias("paths"))
    return payloads.join(F.broadcast(paths), "source_id", "left")


def read_articles(rows: DataFrame, kind: str, as_of: dt.datetime) -> DataFrame:
    """Articles of rows (source_id, value, paths), each value one JSON object. Field by
    field in steps, so the plan stays small enough to be compiled."""
    fields = {x: F.col(f"paths.{x}") for x in ("title", "content", "link")}
    read = with_time(with_strings(rows, "value", fields), "value", F.col("paths.timestamp"), "stamped")
    text = {x: F.coalesce(x, F.lit("")) for x in fields}
    return read.withColumns(text).select(
        article_id(*[F.col(x) for x in ("link", "source_id", "title", "content", "stamped")]).alias("id"),
        "source_id",
        F.lit(kind).alias("source_type"),
        "title",
        "content",
        F.coalesce("stamped", timestamp_literal(as_of)).alias("timestamp"),
        "link",
        F.lit(False).alias("processed"),
    )


def response_items(payloads: DataFrame) -> DataFrame:
    """Payloads (body, paths) with ``value`` and ``items`` (array of variant)."""
    return with_json(payloads, "body", "value").withColumn(
        "items", extract_items(F.col("value"), F.col("paths.items"))
    )


def response_articles(payloads: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Articles of every item of every readable response. Items that are no objects are
    skipped; missing fields become empty text, a missing time becomes ``as_of``."""
    # The outer form: for the plain one Spark adds a filter on the array, which moves below
    # the parsing and parses everything again. NULL items go with those that are no objects.
    items = (
        response_items(payloads)
        .select("source_id", "paths", F.explode_outer("items").alias("value"))
        .filter(is_object(F.col("value")))
    )
    return read_articles(items, "http", as_of)


def response_errors(payloads: DataFrame) -> DataFrame:
    """Responses no article could be read from, and why."""
    error = (
        F.when(F.col("paths").isNull(), "source names no paths to read")
        .when(F.col("value").isNull(), "body is not json")
        .when(F.col("items").isNull(), "items path does not lead to an array")
    )
    return (
        response_items(payloads)
        .select("source_id", "body", F.explode_outer(F.array(error)).alias("error"))
        .filter("error IS NOT NULL")
    )
