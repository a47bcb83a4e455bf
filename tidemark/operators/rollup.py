"""Daily moments of the metrics: a rollup whose rows merge, so it can be kept up batch by batch.

A row holds, per (classification, category, label, day), how many metrics there are, how many have a score (n), the sum
of these and M2, the sum of squared deviations from their mean. Parts of one key merge by sums alone
(the many-way form of Chan's formula),

    M2 = sum(M2_i) + sum(sum_i^2 / n_i) - sum^2 / n

in any order and grouping, before and after a shuffle, so parts written by different batches, tasks or streams add up to
what one pass over all metrics gives. That is also the policy for late data: a metric counts in its
day whenever it comes; nothing is ever closed, so there is no watermark and nothing is dropped.

Ranges are cut at days: whole days come from the rollup, the rest of the first and of the last day
from the metrics themselves, whose scan those few hours prune.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import safe_ratio
from ..functions.times import timestamp_literal
from .metrics import across_groups, signal_columns
from .predicates import Bound, all_of, equals, named, one_of

KEYS = ("classification", "category", "label", "day")
MOMENTS = T.StructType(
    [
        *[T.StructField(x, T.StringType()) for x in KEYS[:-1]],
        T.StructField("day", T.DateType()),
        T.StructField("rows", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("sum", T.DoubleType()),
        T.StructField("m2", T.DoubleType()),
    ]
)


def moments(metrics: DataFrame) -> DataFrame:
    """The rollup of metric rows."""
    scores = metrics.groupBy("classification", "category", "label", F.to_date("timestamp").alias("day"))
    found = scores.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("score").alias("n"),
        F.coalesce(F.sum("score"), F.lit(0.0)).alias("sum"),
        F.coalesce(F.var_pop("score") * F.count("score"), F.lit(0.0)).alias("m2"),
    )
    return found.select(*MOMENTS.names)


def merged(parts: DataFrame, *keys: str) -> DataFrame:
    """Parts added up per key."""
    between = F.sum(F.when(F.col("n") > 0, F.col("sum") * F.col("sum") / F.col("n")))
    return (
        parts.groupBy(*keys)
        .agg(F.sum("rows").alias("rows"), F.sum("n").alias("_n"), F.sum("sum").alias("_sum"), F.sum("m2").alias("_within"), between.alias("_between"))
        .select(
            *keys,
            F.coalesce("rows", F.lit(0)).alias("rows"),
            F.coalesce("_n", F.lit(0)).alias("n"),
            F.coalesce("_sum", F.lit(0.0)).alias("sum"),
            F.greatest(
                F.col("_within") + F.coalesce("_between", F.lit(0.0)) - safe_ratio(F.col("_sum") * F.col("_sum"), F.col("_n")), F.lit(0.0)
            ).alias("m2"),
        )
    )


def compacted(parts: DataFrame) -> DataFrame:
    """One row a key, to be written in place of its parts."""
    return merged(parts, *KEYS)


def _mean() -> Column:
    return F.when(F.col("n") > 0, F.col("sum") / F.col("n"))


def _var() -> Column:
    return F.when(F.col("n") > 0, F.col("m2") / F.col("n"))


def _instant(bound: Bound) -> dt.datetime | None:
    if not bound:
        return None
    at = dt.datetime.fromisoformat(bound) if isinstance(bound, str) else bound
    return (at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)).astimezone(dt.timezone.utc)


def whole_days(start: Bound, end: Bound) -> tuple[dt.datetime | None, dt.datetime | None]:
    """The first whole day of a range (both ends inclusive), and the day after the last one."""
    lo, hi = _instant(start), _instant(end)
    day = lambda t: t.replace(hour=0, minute=0, second=0, microsecond=0)
    first = None if lo is None else day(lo) if lo == day(lo) else day(lo) + dt.timedelta(days=1)
    after = None if hi is None else day(hi + dt.timedelta(microseconds=1))
    return first, after


@dataclass
class Rollup:
    """Label analytics out of the rollup, and out of the metrics where a range cuts a day."""

    parts: DataFrame
    metrics: DataFrame

    def moments(
        self, classification: str | None = None, *, labels=(), label: str | None = None, category: str | None = None, start: Bound = None, end: Bound = None
    ) -> DataFrame:
        """Parts under the predicates; several rows a key."""
        wanted = all_of([named(classification), one_of("label", labels), equals("label", label), equals("category", category)])
        first, after = whole_days(start, end)
        at = F.col("timestamp")
        if first and after and first >= after:
            inside = self.metrics.filter(wanted & (at >= timestamp_literal(start)) & (at <= timestamp_literal(end)))
            return moments(inside)
        # Dates compare as such, so that they reach the scan.
        days = [F.col("day") >= F.lit(first.date())] if first else []
        days += [F.col("day") < F.lit(after.date())] if after else []
        parts = self.parts.filter(all_of([wanted, *days])).select(*MOMENTS.names)
        edges = [(at >= timestamp_literal(start)) & (at < timestamp_literal(first))] if first else []
        edges += [(at >= timestamp_literal(after)) & (at <= timestamp_literal(end))] if after else []
        for edge in edges:
            parts = parts.unionByName(moments(self.metrics.filter(wanted & edge)))
        return parts

    def label_metrics(self, classification: str | None = None, **predicates) -> DataFrame:
        """Per label: n, mean, var (population), and ``total``, the sum of n over all labels."""
        per_label = merged(self.moments(classification, **predicates), "label")
        found = per_label.select("label", "n", _mean().alias("mean"), _var().alias("var"))
        return found.withColumn("total", across_groups("n"))

    def signals(self, classification: str | None = None, **predicates) -> DataFrame:
        """Per label: count, frequency, mean, variance, weight and entropy."""
        m = self.label_metrics(classification, **predicates)
        return m.select("label", F.col("n").alias("count"), *signal_columns(*(F.col(x) for x in ("n", "total", "mean", "var"))))

    def heatmap(self, classification: str | None = None, **predicates) -> DataFrame:
        """Per day: share of all rows in range times mean score, days ascending."""
        per_day = merged(self.moments(classification, **predicates), "day")
        share = F.col("rows").cast("double") / across_groups("rows")
        return per_day.select("day", (share * _mean()).alias("value")).orderBy("day")

    def label_delta(self, classification: str | None, label: str, start: Bound = None, end: Bound = None) -> DataFrame:
        """One row (label, frequency, mean_confidence), zeros when nothing matches."""
        # An empty label asks for nothing here, not for all.
        found = self.moments(classification, start=start, end=end).filter(F.col("label") == label)
        return merged(found).select(
            F.lit(label).alias("label"), F.col("rows").cast("double").alias("frequency"), F.coalesce(_mean(), F.lit(0.0)).alias("mean_confidence")
        )

    def quadrant(self, classification: str | None, label: str, a: tuple[Bound, Bound], b: tuple[Bound, Bound]) -> DataFrame:
        """Period b against period a for one label: ratio of counts (0 when a is empty) and difference of means."""
        sides = [
            self.moments(classification, start=period[0], end=period[1]).filter(F.col("label") == label).withColumn("side", F.lit(side))
            for side, period in (("a", a), ("b", b))
        ]
        of = lambda side, column: F.coalesce(F.sum(F.when(F.col("side") == side, F.col(column))), F.lit(0))
        mean = lambda side: safe_ratio(of(side, "sum"), of(side, "n"))
        return sides[0].unionByName(sides[1]).agg(
            F.lit(label).alias("label"),
            safe_ratio(of("b", "rows").cast("double"), of("a", "rows").cast("double")).alias("frequency"),
            (mean("b") - mean("a")).alias("mean_confidence"),
        )
