"""Heartbeats folded into uptime intervals, and uptime over time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import epoch_micros, timestamp_literal
from .rates import bucketed, calendar

# Bucket length in seconds and number of buckets per format.
SEGMENT_BUCKETS = {"day": (600, 144), "month": (86400, 30)}
DEFAULT_THRESHOLD = 30

_CHUNK_SECONDS = 86400


def _check(threshold_seconds: int) -> int:
    if threshold_seconds <= 0:
        raise ValueError("threshold_seconds must be positive")
    return threshold_seconds * 1_000_000


def _fold(beats: DataFrame, gap: int) -> DataFrame:
    """(service, start, recent) in micros from (service, start, at, until): beats whose
    ``at`` is at most ``gap`` apart share an interval, from the least ``start`` to the
    greatest ``until`` among them.

    No task ever holds all beats of a service. Beats in one grid cell as long as the gap
    always belong together, so they shrink to one row per cell before the first shuffle.
    Cells are then chained within a chunk of time, and chunks are chained per service on
    one row each, whose number is bounded by the length of history.
    """
    cell = F.expr(f"(at - pmod(at, {gap}L)) div {gap}L")
    span = max(gap, _CHUNK_SECONDS * 1_000_000) // gap
    cells = (
        beats.groupBy("service", cell.alias("cell"))
        .agg(
            F.min("start").alias("start"),
            F.max("until").alias("until"),
            F.min("at").alias("first"),
            F.max("at").alias("last"),
        )
        .withColumn("chunk", F.expr(f"(cell - pmod(cell, {span}L)) div {span}L"))
    )
    in_chunk = Window.partitionBy("service", "chunk").orderBy("cell")
    linked = cells.withColumn("before", F.lag("last").over(in_chunk)).withColumn(
        "opens", F.when(F.col("before").isNotNull(), (F.col("first") - F.col("before") > gap).cast("bigint"))
    )
    chained = linked.withColumn("step", F.sum(F.coalesce("opens", F.lit(0))).over(in_chunk))

    # Per chunk: its edges, and how many intervals open inside it past its first cell.
    of_service = Window.partitionBy("service").orderBy("chunk")
    chunks = (
        linked.groupBy("service", "chunk")
        .agg(
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            F.sum(F.coalesce("opens", F.lit(0))).alias("opened"),
        )
        .withColumn("before", F.lag("last").over(of_service))
        .withColumn(
            "edge",
            F.coalesce((F.col("first") - F.col("before") > gap).cast("bigint"), F.lit(1)),
        )
        .withColumn("number", F.sum(F.col("opened") + F.col("edge")).over(of_service))
        .select("service", "chunk", (F.col("number") - F.col("opened")).alias("base"))
    )
    return (
        chained.join(chunks, ["service", "chunk"])
        .groupBy("service", (F.col("base") + F.col("step")).alias("number"))
        .agg(F.min("start").alias("start"), F.max("until").alias("recent"))
        .select("service", "start", "recent")
    )


def _intervals(folded: DataFrame) -> DataFrame:
    return folded.select(
        "service",
        F.timestamp_micros("start").alias("start"),
        F.timestamp_micros("recent").alias("recent"),
        F.lit(True).alias("up"),
    )


def _points(beats: DataFrame) -> DataFrame:
    at = F.unix_micros("timestamp")
    return beats.select("service", at.alias("start"), at.alias("at"), at.alias("until"))


def uptime_intervals(beats: DataFrame, threshold_seconds: int = DEFAULT_THRESHOLD) -> DataFrame:
    """(service, start, recent, up) from (service, timestamp). A gap of exactly the
    threshold still extends an interval."""
    gap = _check(threshold_seconds)
    return _intervals(_fold(_points(beats), gap))


def _days(first: Column, last: Column) -> Column:
    """The days, counted from the epoch, that the instants from ``first`` to ``last`` fall on."""
    day = _CHUNK_SECONDS * 1_000_000
    return F.sequence(F.floor(first / day), F.floor(last / day))


def _joined(spans: DataFrame, gap: int) -> DataFrame:
    """(service, start, until) of spans in micros, those at most ``gap`` apart made one.

    A span opens an interval where it starts past all that a service has before it. Rows here are
    intervals, not beats: a service has at most one a gap."""
    in_order = Window.partitionBy("service").orderBy("start", "until")
    reached = F.max("until").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("start") - reached > gap).cast("bigint"), F.lit(1))
    numbered = spans.withColumn("opens", opens).withColumn("number", F.sum("opens").over(in_order))
    return numbered.groupBy("service", "number").agg(F.min("start").alias("start"), F.max("until").alias("until")).drop("number")


def extend_uptime(
    intervals: DataFrame, beats: DataFrame, threshold_seconds: int = DEFAULT_THRESHOLD
) -> DataFrame:
    """The uptime table after new beats, in whatever order they come: an interval grows by
    beats within the threshold of it, beats between two may join them, others open new ones.

    Beats are folded among themselves first. Only stored intervals that share a day with one of
    these, widened by the threshold, can be touched; they are found by an equal join on (service, day)
    and joined up whole, by their two ends. The rest of the table passes through.
    """
    gap = _check(threshold_seconds)
    fresh = _fold(_points(beats), gap).withColumnRenamed("recent", "until")
    days = fresh.select("service", F.explode(_days(F.col("start") - gap, F.col("until") + gap)).alias("day")).distinct()
    stored = intervals.withColumns({"a": F.unix_micros("start"), "b": F.unix_micros("recent")})
    on_days = stored.select("service", "a", "b", F.explode(_days(F.col("a"), F.col("b"))).alias("day"))
    near = on_days.join(days, ["service", "day"], "left_semi").select("service", "a", "b").distinct()
    touched = near.select("service", F.col("a").alias("start"), F.col("b").alias("until"))
    untouched = stored.join(near, ["service", "a", "b"], "left_anti").select("service", "start", "recent", "up")
    grown = _joined(touched.unionByName(fresh), gap).withColumnRenamed("until", "recent")
    return untouched.unionByName(_intervals(grown))


def _exact_sum(micros: Column) -> Column:
    # Decimal: sums of micros over many intervals can pass 64 bits.
    return F.sum(micros.cast("decimal(20,0)"))


def uptime_total(intervals: DataFrame, start: dt.datetime, end: dt.datetime, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (uptime): covered share of [start, end], within 0 and 1. With ``by``, one row for
    each of its values that has an interval in the range."""
    lo, hi = epoch_micros(start), epoch_micros(end)
    if lo == hi:
        raise ValueError("uptime range is empty")
    overlap = F.least(F.unix_micros("recent"), F.lit(hi)) - F.greatest(F.unix_micros("start"), F.lit(lo))
    share = F.coalesce(
        _exact_sum(overlap).cast("double"), F.lit(0.0)
    ) / F.lit(float(hi - lo))
    return intervals.filter(
        (F.col("recent") > timestamp_literal(start)) & (F.col("start") < timestamp_literal(end))
    ).groupBy(*by).agg(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)).alias("uptime"))


def uptime_segments(intervals: DataFrame, fmt: str, as_of: dt.datetime, by: tuple[str, ...] = ()) -> DataFrame:
    """Percent covered per bucket: 144 of ten minutes (``day``) or 30 of a day
    (``month``), counted back from ``as_of`` itself. With ``by`` (the service, say), all buckets of each of its
    values that is up in the horizon; without, coverage is added over all services, so it can pass 100.

    A sweep over edges: an interval, however long, gives what it covers of its first and of its last bucket, a
    rise after the first and a fall at the last; the prefix sum of these counts the intervals that cover
    a bucket whole. So an interval makes four rows at most, summed by bucket before any shuffle.
    """
    step_seconds, buckets = bucketed(fmt, SEGMENT_BUCKETS)
    step = step_seconds * 1_000_000
    lo = epoch_micros(as_of) - buckets * step
    horizon = buckets * step
    begin = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=lo)
    cut = intervals.filter(
        F.col("up")
        & (F.col("recent") > timestamp_literal(begin))
        & (F.col("start") < timestamp_literal(as_of))
        & (F.col("recent") > F.col("start"))
    ).select(
        *by,
        F.greatest(F.unix_micros("start") - lo, F.lit(0)).alias("a"),
        F.least(F.unix_micros("recent") - lo, F.lit(horizon)).alias("e"),
    )
    first, last = F.expr(f"a div {step}L"), F.expr(f"(e - 1) div {step}L")
    edge = lambda at, part, rise: F.struct(at.alias("index"), part.alias("part"), F.lit(rise).cast("bigint").alias("rise"))
    none = F.lit(0).cast("bigint")
    edges = F.when(first == last, F.array(edge(first, F.col("e") - F.col("a"), 0))).otherwise(
        F.array(
            edge(first, (first + 1) * step - F.col("a"), 0),
            edge(last, F.col("e") - last * step, 0),
            edge(first + 1, none, 1),
            edge(last, none, -1),
        )
    )
    swept = (
        cut.select(*by, F.inline(edges))
        .groupBy(*by, "index")
        .agg(_exact_sum(F.col("part")).alias("part"), F.sum("rise").alias("rise"))
    )
    if by:
        indexes = F.sequence(F.lit(0).cast("bigint"), F.lit(buckets - 1).cast("bigint"))
        grid = swept.select(*by).distinct().select(*by, F.explode(indexes).alias("index"))
    else:
        grid = calendar(intervals, buckets, lo, step_seconds).select("index")
    # One row a bucket is left, so the window is small whatever the intervals were.
    in_order = Window.partitionBy(*by).orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    exact = "decimal(20,0)"
    whole = F.coalesce(F.sum("rise").over(in_order), none).cast(exact) * F.lit(step).cast(exact)
    covered = (F.coalesce("part", F.lit(0).cast(exact)) + whole).cast("double")
    start = F.timestamp_micros(F.lit(lo) + F.col("index") * step)
    return (
        grid.join(swept, [*by, "index"], "left")
        .select(*by, "index", start.alias("bucket_start"), (covered * 100.0 / float(step)).alias("percent"))
        .orderBy(*by, "index")
    )
