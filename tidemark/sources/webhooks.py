"""Webhook deliveries to articles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import hmac_sha256, with_hmac_keys
from ..functions.payload import is_object, with_json, with_strings
from .json_api import extract_paths, read_articles

DEFAULT_SIGNATURE_HEADER = "X-Signature"


def normal_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\A/", "")


def delivered_path(path: Column) -> Column:
    """The route of a delivery, which may carry the prefix that all webhooks are served under."""
    return F.regexp_replace(normal_path(path), r"\Awebhooks/", "")


def webhook_url(path: Column) -> Column:
    """The url a webhook source is known by when it has none of its own."""
    return F.concat(F.lit("webhook://"), path)


def routes(sources: DataFrame, path: Column | None = None) -> DataFrame:
    """Routing rows of active webhook sources: path, paths into the body, signature keys.
    Keys are padded here, once per source."""
    own = path if path is not None else F.get_json_object("spec", "$.path")
    signed = F.coalesce(F.col("auth.kind") == "hmac", F.lit(False))
    header = F.coalesce(F.nullif("auth.header", F.lit("")), F.lit(DEFAULT_SIGNATURE_HEADER))
    listed = sources.filter("active AND type = 'webhook'").select(
        normal_path(own).alias("route"),
        F.col("id").alias("source_id"),
        extract_paths(sources).alias("paths"),
        signed.alias("signed"),
        F.when(signed, F.lower(header)).alias("signature_header"),
        F.when(signed, F.coalesce("auth.secret", F.lit(""))).alias("secret"),
    )
    # One source per route: of several on one path, the one whose id comes last.
    latest = Window.partitionBy("route").orderBy(F.desc("source_id"))
    single = listed.withColumn("_rank", F.row_number().over(latest)).filter("_rank = 1").drop("_rank")
    return with_hmac_keys(single, F.col("secret"), "inner_key", "outer_key").drop("secret")


def header_value(headers: Column, name: Column) -> Column:
    """Header by case-insensitive name (``name`` in lower case)."""
    found = F.filter(F.map_entries(headers), lambda h: F.lower(h["key"]) == name)
    return F.get(found, 0)["value"]


def judge_deliveries(events: DataFrame, routing: DataFrame) -> DataFrame:
    """Deliveries (path, headers, body) with their source and a ``status``: 202 accepted,
    404 no such route, 401 signature missing, 403 signature wrong, 400 unusable body."""
    # Deliveries to one route may be most of a batch, so they are never dealt out by route.
    routed = events.drop("source_id").withColumn("route", delivered_path(F.col("path"))).join(
        F.broadcast(routing), "route", "left"
    )
    given = F.coalesce(header_value(F.col("headers"), F.col("signature_header")), F.lit(""))
    valid = given == hmac_sha256(F.col("inner_key"), F.col("outer_key"), F.col("body"))
    parsed = with_json(routed, "body", "value")
    read = with_strings(parsed, "value", {"content": F.col("paths.content")})
    status = (
        F.when(F.col("source_id").isNull(), 404)
        .when(F.col("signed") & (given == ""), 401)
        .when(F.col("signed") & ~valid, 403)
        .when(F.col("value").isNull() | ~is_object(F.col("value")), 400)
        .when(F.coalesce("content", F.lit("")) == "", 400)
        .otherwise(202)
    )
    return read.withColumn("status", status).drop("content", "inner_key", "outer_key")


def _with_status(judged: DataFrame, wanted: Column) -> DataFrame:
    # A filter on the status itself would be pushed below the step that works it out, and
    # every signature be checked twice; one on a generated column stays where it is.
    kept = F.explode_outer(F.array(F.when(wanted, F.col("status")))).alias("status")
    return judged.select(*[c for c in judged.columns if c != "status"], kept).filter("status IS NOT NULL")


def delivery_articles(judged: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Articles of the accepted deliveries."""
    accepted = _with_status(judged, F.col("status") == 202).select("source_id", "value", "paths")
    return read_articles(accepted, "webhook", as_of)


def rejected(judged: DataFrame) -> DataFrame:
    return _with_status(judged, F.col("status") != 202).select("path", "source_id", "body", "status")
