"""Heartbeat streams to uptime intervals: closed ones appended once, open ones carried from batch to batch."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import timestamp_literal
from ..operators.uptime import extend_uptime
from .store import Batch, Store

DEFAULT_LATENESS = dt.timedelta(minutes=1)


def closed_intervals(
    beats: DataFrame, threshold_seconds: int = 30, lateness: str = "1 minute"
) -> DataFrame:
    """Intervals of a heartbeat stream (service, timestamp), each given once no beat can
    extend it any more. The interval ends at its last beat, not at the window's end.

    For a sink that wants closed intervals and nothing else. Sessions are merged in each task before the shuffle; after it
    a service has one task."""
    if threshold_seconds <= 0:
        raise ValueError("threshold_seconds must be positive")
    return (
        beats.withWatermark("timestamp", lateness)
        .groupBy("service", F.session_window("timestamp", f"{threshold_seconds} seconds").alias("w"))
        .agg(F.max("timestamp").alias("recent"))
        .select("service", F.col("w.start").alias("start"), "recent", F.lit(True).alias("up"))
    )


def _watermark(seen: dt.datetime | None, lateness: dt.timedelta) -> dt.datetime:
    return dt.datetime(1, 1, 2) if seen is None else seen - lateness


def extend_on_batch(store: Store, threshold_seconds: int, lateness: dt.timedelta = DEFAULT_LATENESS) -> Callable[[DataFrame, Batch], None]:
    """A foreachBatch step keeping the uptime table current, open intervals included.

    A batch reads its beats and the intervals the batch before left open, never the closed ones, so what it costs
    does not grow with history, and what is stored grows with the intervals alone. Beats shrink to
    a row per grid cell, are chained by (service, day) and only then meet their service's other intervals, so a service with most
    of the beats is worked on by many tasks.

    The watermark is the latest time seen less ``lateness``. An interval closes when no beat from the watermark on
    can extend it, and is then appended, once. A beat from before the watermark of the batches before is late: its
    interval may be closed, so it goes to a table of its own, from which :func:`settle_late` works it in.
    """
    if threshold_seconds <= 0:
        raise ValueError("threshold_seconds must be positive")
    gap = dt.timedelta(seconds=threshold_seconds)

    def step(beats: DataFrame, batch: Batch) -> None:
        staged = store.stage("beats", beats.select("service", "timestamp").filter("service IS NOT NULL AND timestamp IS NOT NULL"), batch)
        carried = store.carried_uptime(batch)
        before = store.seen(batch)
        # Naive times are UTC, as timestamp_literal takes them.
        latest = staged.agg(F.max(F.unix_micros("timestamp")).alias("t")).first()["t"]
        now = None if latest is None else dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=latest)
        seen = max([t for t in (before, now) if t is not None], default=None)
        late = F.col("timestamp") < timestamp_literal(_watermark(before, lateness))
        grown = extend_uptime(carried, staged.filter(~late), threshold_seconds)
        # A gap of exactly the threshold still extends.
        is_open = F.col("recent") >= timestamp_literal(_watermark(seen, lateness) - gap)
        store.write_uptime(grown.withColumn("open", is_open), staged.filter(late), seen, batch)

    return step


def start_uptime(
    beats: DataFrame, store: Store, checkpoint: str, threshold_seconds: int = 30, lateness: dt.timedelta = DEFAULT_LATENESS
) -> StreamingQuery:
    return (
        beats.writeStream.queryName("uptime")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(store.numbered(checkpoint, extend_on_batch(store, threshold_seconds, lateness)))
        .trigger(availableNow=True)
        .start()
    )


def settle_late(store: Store, threshold_seconds: int = 30) -> DataFrame:
    """The uptime table with late beats worked in, as a batch: of the stored intervals only those that share a
    day with a late beat are folded again, the rest pass through."""
    return extend_uptime(store.uptime(), store.late_beats().select("service", "timestamp"), threshold_seconds)
