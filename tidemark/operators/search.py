"""Search over classified articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import cut_data
from ..specs import SearchRequest
from .predicates import all_of, named, one_of, within
from .titles import titled


def articles_with_all_labels(metrics: DataFrame, labels, classification: str | None = None) -> DataFrame:
    """article_id of every article that has each of the labels, at any time."""
    labels = list(dict.fromkeys(labels))
    scan = metrics.filter(all_of([named(classification), one_of("label", labels)]))
    # A set holds at most the labels asked for, and is built before the shuffle as well as after.
    held = scan.groupBy("article_id").agg(F.size(F.collect_set("label")).alias("held"))
    return held.filter(F.col("held") == len(labels)).select("article_id")


def newest_per_article(classifications: DataFrame) -> DataFrame:
    """The latest row of each article; equal times go by id. Spark plans this as a group
    limit on both sides of the shuffle, so a hot article sends one row per task."""
    order = Window.partitionBy("article_id").orderBy(F.desc("timestamp"), "id")
    return (
        classifications.withColumn("_rank", F.row_number().over(order))
        .filter("_rank = 1")
        .drop("_rank")
    )


def linked_classifications(
    classifications: DataFrame,
    articles: DataFrame,
    metrics: DataFrame,
    request: SearchRequest,
    titles: DataFrame | None = None,
) -> DataFrame:
    """Search without order and limit. ``titles`` is the trigram index of the articles, where there is one.

    Label and title conditions hold for all rows of an article alike, so they commute with
    taking its newest row. They come first, as semi joins with distinct article ids, so that
    rows they rule out are not ranked; the data is cut for the chosen rows only. The cutoff may
    empty the chosen row, and then the article is dropped: an older row never stands in for it.
    """
    rows = classifications.filter(
        all_of([named(request.classification), within("timestamp", request.start, request.end)])
    )
    rows = rows.select("id", "article_id", "timestamp", "data")
    linked = titled(articles, request.title, titles).select(
        F.col("id").alias("article_id"), "title", "link"
    )
    if request.labels:
        holders = articles_with_all_labels(metrics, request.labels, request.classification)
        rows = rows.join(holders, "article_id", "left_semi")
    if request.title:
        rows = rows.join(linked.select("article_id"), "article_id", "left_semi")
    data = cut_data(F.col("data"), request.cutoff) if request.cutoff > 0 else F.col("data")
    found = newest_per_article(rows).withColumn("data", data).filter(F.size("data") > 0)
    return found.join(linked, "article_id").select(
        "id", "article_id", "timestamp", "data", "title", "link"
    )


def search(
    classifications: DataFrame,
    articles: DataFrame,
    metrics: DataFrame,
    request: SearchRequest,
    titles: DataFrame | None = None,
) -> DataFrame:
    """Newest classification of each matching article, latest first, top ``limit``."""
    return (
        linked_classifications(classifications, articles, metrics, request, titles)
        .orderBy(F.desc("timestamp"), "id")
        .limit(request.limit)
    )
