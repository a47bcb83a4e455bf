"""Metric rows joined with their article, as plot and scatter points."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookup import lookup_frame
from .metrics import metrics_scan
from .predicates import Bound, all_of, within

def linked_metrics(
    metrics: DataFrame,
    articles: DataFrame,
    classification: str | None = None,
    *,
    category: str | None = None,
    labels=(),
    cutoff: float = 0.0,
    start: Bound = None,
    end: Bound = None,
) -> DataFrame:
    """Metrics with the title and link of their article. The range applies to the time of
    the article; the time returned is that of the metric. A cutoff of 0 means none."""
    scan = metrics_scan(
        metrics, classification, category=category, labels=labels, cutoff=cutoff if cutoff > 0 else None
    ).select("article_id", "label", "timestamp", "score")
    linked = articles.filter(all_of([within("timestamp", start, end)])).select(
        F.col("id").alias("article_id"), "title", "link"
    )
    return scan.join(linked, "article_id").select(
        "article_id", "title", "link", "label", "timestamp", "score"
    )


def scatter_points(metrics: DataFrame, articles: DataFrame, classification: str | None = None, **options) -> DataFrame:
    """(article_id, title, link, label, x = time, y = score)."""
    return linked_metrics(metrics, articles, classification, **options).select(
        "article_id", "title", "link", "label", F.col("timestamp").alias("x"), F.col("score").alias("y")
    )


def plot_points(
    metrics: DataFrame,
    articles: DataFrame,
    label: str,
    *,
    classification: str = "events",
    category: str = "vector",
    start: Bound = None,
    end: Bound = None,
) -> DataFrame:
    """Points of one label. An empty label is a label like any other, and matches nothing."""
    return scatter_points(
        metrics, articles, classification, category=category, labels=[label], start=start, end=end
    )


def scatter3d_points(
    metrics: DataFrame,
    articles: DataFrame,
    label_axis: dict[str, float],
    classification: str | None = "events",
    *,
    category: str | None = "vector",
    **options,
) -> DataFrame:
    """Scatter points with z, the axis position of the label (0 for a label without one)."""
    points = scatter_points(metrics, articles, classification, category=category, **options)
    axis = lookup_frame(
        points.sparkSession,
        [{"label": k, "z": v} for k, v in label_axis.items()],
        pa.schema([("label", pa.string()), ("z", pa.float64())]),
    )
    return points.join(axis, "label", "left").select(
        "article_id", "title", "link", "label", "x", "y", F.coalesce("z", F.lit(0.0)).alias("z")
    )
