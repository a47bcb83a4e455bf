"""Aggregates over the long metrics table (one row per article, attribute and label).

Every group key here (label, day, attribute) has few values, so each aggregate reduces to
a handful of rows before its one shuffle, however hot a single label is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import safe_ratio
from .predicates import Bound, all_of, at_least, equals, named, one_of, within


def metrics_scan(
    metrics: DataFrame,
    classification: str | None = None,
    *,
    labels=(),
    label: str | None = None,
    category: str | None = None,
    cutoff: float | None = None,
    start: Bound = None,
    end: Bound = None,
) -> DataFrame:
    """The metrics table under any mix of predicates."""
    return metrics.filter(
        all_of(
            [
                named(classification),
                within("timestamp", start, end),
                one_of("label", labels),
                equals("label", label),
                equals("category", category),
                at_least("score", cutoff),
            ]
        )
    )


def across_groups(column: str) -> Column:
    # Runs over one row per label or day, never over metric rows; a total aggregated beside them would scan the metrics twice.
    return F.sum(column).over(Window.partitionBy())


def label_metrics(metrics: DataFrame, classification: str | None = None, **predicates) -> DataFrame:
    """Per label: n, mean, var (population), and ``total``, the sum of n over all labels."""
    per_label = (
        metrics_scan(metrics, classification, **predicates)
        .groupBy("label")
        .agg(
            F.count("score").alias("n"),
            F.avg("score").alias("mean"),
            F.var_pop("score").alias("var"),
        )
    )
    return per_label.withColumn("total", across_groups("n"))


def binary_entropy(p: Column) -> Column:
    return F.when(
        (p > 0) & (p < 1), -(p * F.log2(p) + (1 - p) * F.log2(1 - p))
    ).otherwise(F.lit(0.0))


def signal_columns(n: Column, total: Column, mean: Column, var: Column) -> list[Column]:
    frequency = safe_ratio(n.cast("double"), total.cast("double"))
    return [
        frequency.alias("frequency"),
        mean.alias("mean"),
        var.alias("variance"),
        (frequency * mean * (1 - var)).alias("weight"),
        binary_entropy(mean).alias("entropy"),
    ]


def signals(metrics: DataFrame, classification: str | None = None, **predicates) -> DataFrame:
    """Per label: count, frequency, mean, variance, weight and entropy."""
    m = label_metrics(metrics, classification, **predicates)
    return m.select(
        "label",
        F.col("n").alias("count"),
        *signal_columns(F.col("n"), F.col("total"), F.col("mean"), F.col("var")),
    )


def heatmap(
    metrics: DataFrame,
    classification: str | None = None,
    *,
    label: str | None = None,
    start: Bound = None,
    end: Bound = None,
) -> DataFrame:
    """Per day: share of all rows in range times mean score, days ascending."""
    per_day = (
        metrics_scan(metrics, classification, label=label, start=start, end=end)
        .groupBy(F.to_date("timestamp").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"))
    )
    share = F.col("n").cast("double") / across_groups("n")
    return per_day.select("day", (share * F.col("mean")).alias("value")).orderBy("day")


def treemap(
    metrics: DataFrame,
    classification: str | None = None,
    *,
    category: str | None = None,
    cutoff: float = 0.0,
    start: Bound = None,
    end: Bound = None,
) -> DataFrame:
    """Rows per label at or above the cutoff, most first; equal counts go by label."""
    scan = metrics_scan(metrics, classification, category=category, cutoff=cutoff, start=start, end=end)
    return (
        scan.groupBy("label").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "label")
    )


def label_delta(
    metrics: DataFrame, classification: str | None, label: str, start: Bound = None, end: Bound = None
) -> DataFrame:
    """One row (label, frequency, mean_confidence), zeros when nothing matches."""
    scan = metrics_scan(metrics, classification, start=start, end=end).filter(F.col("label") == label)
    return scan.agg(
        F.count(F.lit(1)).cast("double").alias("frequency"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_confidence"),
    ).select(F.lit(label).alias("label"), "frequency", "mean_confidence")


def _in_period(period: tuple[Bound, Bound]) -> Column:
    return all_of([within("timestamp", *period)])


def quadrant(
    metrics: DataFrame,
    classification: str | None,
    label: str,
    a: tuple[Bound, Bound],
    b: tuple[Bound, Bound],
) -> DataFrame:
    """Period b against period a for one label, both read in one scan: ratio of counts
    (0 when a is empty) and difference of mean scores."""
    in_a, in_b = _in_period(a), _in_period(b)
    scan = metrics_scan(metrics, classification).filter((F.col("label") == label) & (in_a | in_b))
    mean = lambda period: F.coalesce(F.avg(F.when(period, F.col("score"))), F.lit(0.0))
    return scan.agg(
        safe_ratio(F.count_if(in_b).cast("double"), F.count_if(in_a).cast("double")).alias("frequency"),
        (mean(in_b) - mean(in_a)).alias("mean_confidence"),
    ).select(F.lit(label).alias("label"), "frequency", "mean_confidence")


def classification_count(
    classifications: DataFrame, classification: str | None = None, start: Bound = None, end: Bound = None
) -> DataFrame:
    return classifications.filter(
        all_of([named(classification), within("timestamp", start, end)])
    ).agg(F.count(F.lit(1)).alias("count"))


def data_keys(classifications: DataFrame, classification: str | None = None) -> DataFrame:
    """Distinct attribute names in use, with the classification they are used in."""
    return (
        classifications.filter(all_of([named(classification)]))
        .select("classification", F.explode(F.map_keys("data")).alias("key"))
        .distinct()
    )


def profile(
    metrics: DataFrame, classification: str | None = None, start: Bound = None, end: Bound = None
) -> DataFrame:
    """Signals per (category, label) for one period; frequency is over the whole period."""
    per_label = (
        metrics_scan(metrics, classification, start=start, end=end)
        .groupBy("category", "label")
        .agg(
            F.count("score").alias("n"),
            F.avg("score").alias("mean"),
            F.var_pop("score").alias("var"),
        )
        .withColumn("total", across_groups("n"))
    )
    return per_label.select(
        "category",
        "label",
        *signal_columns(F.col("n"), F.col("total"), F.col("mean"), F.col("var")),
    )


def profile_delta(
    metrics: DataFrame,
    classification: str | None,
    a: tuple[Bound, Bound],
    b: tuple[Bound, Bound],
    flat_band: float = 1e-9,
) -> DataFrame:
    """Per (category, label): signals of periods a and b side by side, the drift of weight
    and shift of entropy from a to b, and a status.

    Both periods come from one scan. Status is ``new`` or ``gone`` when only one period has
    the label, else ``up``, ``down`` or ``flat`` by the sign of the drift.
    """
    in_a, in_b = _in_period(a), _in_period(b)

    def measures(period: Column, tag: str) -> list[Column]:
        score = F.when(period, F.col("score"))
        return [
            F.count(score).alias(f"n_{tag}"),
            F.avg(score).alias(f"mean_{tag}"),
            F.var_pop(score).alias(f"var_{tag}"),
        ]

    per_label = (
        metrics_scan(metrics, classification)
        .filter(in_a | in_b)
        .groupBy("category", "label")
        .agg(*measures(in_a, "a"), *measures(in_b, "b"))
        .withColumn("total_a", across_groups("n_a"))
        .withColumn("total_b", across_groups("n_b"))
    )

    def signal(tag: str) -> list[Column]:
        parts = [F.col(f"{name}_{tag}") for name in ("n", "total", "mean", "var")]
        names = ("frequency", "mean", "variance", "weight", "entropy")
        return [
            F.when(parts[0] > 0, column).alias(f"{name}_{tag}")
            for name, column in zip(names, signal_columns(*parts))
        ]

    sides = per_label.select("category", "label", *signal("a"), *signal("b"))
    zero = F.lit(0.0)
    drift = F.coalesce("weight_b", zero) - F.coalesce("weight_a", zero)
    shift = F.coalesce("entropy_b", zero) - F.coalesce("entropy_a", zero)
    status = (
        F.when(F.col("frequency_a").isNull(), "new")
        .when(F.col("frequency_b").isNull(), "gone")
        .when(drift > flat_band, "up")
        .when(drift < -flat_band, "down")
        .otherwise("flat")
    )
    return sides.select(
        "*", drift.alias("weight_drift"), shift.alias("entropy_shift"), status.alias("status")
    )
