"""Finished classifications and scraper results handed in from outside."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import article_id
from ..functions.times import rfc3339, timestamp_literal
from ..schemas import DATA, UPLOADS


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(UPLOADS).json(path)


def uploaded_classifications(items: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Classification rows of uploaded items; an unreadable time becomes ``as_of``."""
    return items.select(
        F.lower("classification").alias("classification"),
        "id",
        "article_id",
        F.coalesce(rfc3339(F.col("timestamp")), timestamp_literal(as_of)).alias("timestamp"),
        F.col("data").cast(DATA).alias("data"),
    )


def scraped_urls(results: DataFrame) -> DataFrame:
    """The state row every scraped url leaves, whatever came of it."""
    return results.select("source_id", "url", "type", F.col("reason").alias("error"))


def scraped_articles(results: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Articles of the scraper results that are neither errors nor without a title."""
    kept = results.filter((F.col("type") != "error") & (F.coalesce("title", F.lit("")) != ""))
    stamped = rfc3339(F.col("timestamp"))
    return kept.select(
        article_id(F.col("url"), F.col("source_id"), F.col("title"), F.col("content"), stamped).alias("id"),
        "source_id",
        F.lit("page").alias("source_type"),
        "title",
        F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce(stamped, timestamp_literal(as_of)).alias("timestamp"),
        F.col("url").alias("link"),
        F.lit(False).alias("processed"),
    )
