"""Article listings and ingest rate."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import epoch_micros, timestamp_literal
from .predicates import all_of, equals

# Bucket length in seconds and number of buckets per format.
RATE_BUCKETS = {"day": (3600, 24), "month": (86400, 30)}


def bucketed(fmt: str, table: dict[str, tuple[int, int]]) -> tuple[int, int]:
    if fmt not in table:
        raise ValueError(f"no calendar for {fmt!r}")
    return table[fmt]


def calendar(like: DataFrame, buckets: int, lo_micros: int, step_seconds: int) -> DataFrame:
    """(index, bucket_start) for every bucket, whether or not anything fell into it."""
    return like.sparkSession.range(buckets, numPartitions=1).select(
        F.col("id").alias("index"),
        F.timestamp_micros(F.lit(lo_micros) + F.col("id") * (step_seconds * 1_000_000)).alias("bucket_start"),
    )


def article_rate(articles: DataFrame, fmt: str, as_of: dt.datetime) -> DataFrame:
    """Articles per hour over 24 hours (``day``) or per day over 30 days (``month``), on
    clock-aligned buckets, the last holding ``as_of``; empty buckets give 0.

    Only the horizon is read. Its rows shrink to one count per bucket before meeting the
    calendar, so no range join is needed and the joined sides hold at most 30 rows.
    """
    step, buckets = bucketed(fmt, RATE_BUCKETS)
    step_micros = step * 1_000_000
    lo = epoch_micros(as_of) // step_micros * step_micros - (buckets - 1) * step_micros
    bound = [dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=m) for m in (lo, lo + buckets * step_micros)]
    ts = F.col("timestamp")
    counts = (
        articles.filter((ts >= timestamp_literal(bound[0])) & (ts < timestamp_literal(bound[1])))
        .groupBy(F.expr(f"(unix_micros(timestamp) - {lo}L) div {step_micros}L").alias("index"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        calendar(articles, buckets, lo, step)
        .join(F.broadcast(counts), "index", "left")
        .select("index", "bucket_start", F.coalesce("n", F.lit(0)).alias("count"))
        .orderBy("index")
    )


def recent_articles(articles: DataFrame, limit: int = 10) -> DataFrame:
    return articles.orderBy(F.desc("timestamp"), "id").limit(limit)


def sources_scan(sources: DataFrame, kind: str | None = None, *, active_only: bool = False) -> DataFrame:
    """All sources; those active; or, given a type, those active of that type."""
    active = F.col("active") if (active_only or kind) else None
    return sources.filter(all_of([active, equals("type", kind)]))


def classify_view(articles: DataFrame) -> DataFrame:
    """The columns a classifier reads."""
    return articles.select("id", "content", "timestamp")


def unprocessed(
    articles: DataFrame,
    processed: DataFrame,
    limit: int | None = None,
    dead: DataFrame | None = None,
) -> DataFrame:
    """Articles not in the ledger (nor given up on), newest first where a limit is set."""
    left = articles.join(
        processed.select(F.col("article_id").alias("id")), "id", "left_anti"
    )
    if dead is not None:
        left = left.join(dead.select(F.col("article_id").alias("id")), "id", "left_anti")
    left = classify_view(left)
    return left if limit is None else left.orderBy(F.desc("timestamp"), "id").limit(limit)
