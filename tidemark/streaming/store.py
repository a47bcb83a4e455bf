"""Parquet tables under one shared root, written one batch directory at a time.

``<root>/<table>/stream=<id>/batch_id=<n>/[classification=<name>/]*.parquet``. A stream's id is that of its
checkpoint, so streams never share a directory, whenever they start; a retried batch overwrites
its own, so running it again leaves the same rows as running it once.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from .. import schemas
from ..operators.classify import flatten
from ..operators.rollup import MOMENTS, moments

_SEEN = schemas.struct(micros=T.LongType())
_EPOCH = dt.datetime(1970, 1, 1)
_KEYS = [T.StructField("stream", T.StringType()), T.StructField("batch_id", T.LongType())]


class Batch(NamedTuple):
    """Which directory a batch owns."""

    stream: str
    number: int

    @property
    def path(self) -> str:
        return f"stream={self.stream}/batch_id={self.number}"

    def mine(self) -> Column:
        return (F.col("stream") == self.stream) & (F.col("batch_id") == self.number)

    def earlier(self) -> Column:
        """Rows of this stream's batches before this one."""
        return (F.col("stream") == self.stream) & (F.col("batch_id") < self.number)


def as_batch(batch: Batch | int) -> Batch:
    """Batches run by hand, outside of any stream, go by their number alone."""
    return batch if isinstance(batch, Batch) else Batch("by-hand", batch)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def numbered(self, checkpoint: str, step: Callable[[DataFrame, Batch], None]) -> Callable[[DataFrame, int], None]:
        """A foreachBatch step given batches of the stream that the checkpoint identifies."""
        known: list[str] = []

        def run(rows: DataFrame, batch_id: int) -> None:
            if not known:
                known.append(self.spark.read.json(f"{checkpoint}/metadata").first()["id"])
            step(rows, Batch(known[0], batch_id))

        return run

    # --- reading ---

    def _read(self, table: str, schema: T.StructType) -> DataFrame:
        full = T.StructType([*schema.fields, *_KEYS])
        try:
            return self.spark.read.schema(full).parquet(f"{self.root}/{table}")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], full)

    def articles(self) -> DataFrame:
        return self._read("articles", schemas.ARTICLES)

    def classifications(self) -> DataFrame:
        return self._read("classifications", schemas.CLASSIFICATIONS)

    def metrics(self) -> DataFrame:
        return self._read("metrics", schemas.METRICS)

    def moments(self) -> DataFrame:
        """Daily moments of the metrics, as each batch left its part of them."""
        return self._read("moments", MOMENTS)

    def processed(self) -> DataFrame:
        return self._read("processed", schemas.PROCESSED)

    def failures(self) -> DataFrame:
        return self._read("failures", schemas.FAILURES)

    def _uptime(self) -> DataFrame:
        return self._read("uptime", T.StructType([*schemas.UPTIME.fields, T.StructField("open", T.BooleanType())]))

    def closed_uptime(self) -> DataFrame:
        """Intervals that no beat in time can extend; each was appended once."""
        return self._uptime().filter("NOT open").select(*schemas.UPTIME.names)

    def open_uptime(self) -> DataFrame:
        """Intervals still open, as the newest batch of each stream left them."""
        newest = self._seen().groupBy("stream").agg(F.max("batch_id").alias("batch_id"))
        return self._uptime().filter("open").join(newest, ["stream", "batch_id"], "left_semi").select(*schemas.UPTIME.names)

    def carried_uptime(self, batch: Batch) -> DataFrame:
        """Intervals that the batch before this one left open."""
        if batch.number == 0:
            return self.spark.createDataFrame([], schemas.UPTIME)
        path = f"{self.root}/uptime/{Batch(batch.stream, batch.number - 1).path}"
        left = self.spark.read.schema(T.StructType([*schemas.UPTIME.fields, T.StructField("open", T.BooleanType())])).parquet(path)
        return left.filter("open").drop("open")

    def _seen(self) -> DataFrame:
        return self._read("uptime_seen", _SEEN)

    def seen(self, batch: Batch) -> dt.datetime | None:
        """The latest beat of the batches before this one (naive, UTC)."""
        if batch.number == 0:
            return None
        micros = self.batch("uptime_seen", _SEEN, Batch(batch.stream, batch.number - 1)).first()["micros"]
        return None if micros is None else _EPOCH + dt.timedelta(microseconds=micros)

    def uptime(self) -> DataFrame:
        """The uptime table: closed intervals and those still open."""
        return self.closed_uptime().unionByName(self.open_uptime())

    def late_beats(self) -> DataFrame:
        return self._read("late_beats", schemas.BEATS)

    # --- writing ---

    def _write(self, df: DataFrame, table: str, schema: T.StructType, batch: Batch, by: list[str], order: list[str]) -> None:
        rows = schemas.conform(df, schema)
        # AQE sizes the files, and splits those of a classification that holds most rows.
        rows = rows.hint("rebalance", *by) if by else rows
        rows = rows.sortWithinPartitions(*order) if order else rows
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.root}/{table}/{batch.path}")

    def stage(self, table: str, rows: DataFrame, batch: Batch) -> DataFrame:
        """Rows written to a table of their own and read back: a step done once."""
        path = f"{self.root}/{table}/{batch.path}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def write_articles(self, articles: DataFrame, batch: Batch) -> None:
        self._write(articles, "articles", schemas.ARTICLES, batch, [], [])

    def write_classified(self, rows: DataFrame, batch: Batch, *, mark_processed: bool = True) -> None:
        """Classification rows, then their metrics, daily moments and ledger entries. These come from the
        rows as written, so scoring runs once and a lost executor costs a re-read."""
        by = ["classification"]
        self._write(rows, "classifications", schemas.CLASSIFICATIONS, batch, by, by)
        written = self.batch("classifications", schemas.CLASSIFICATIONS, batch)
        # Sorted by label and time: row-group ranges then prune label and range predicates.
        self._write(
            flatten(written), "metrics", schemas.METRICS, batch, by, [*by, "label", "timestamp"]
        )
        self._write(moments(self.batch("metrics", schemas.METRICS, batch)), "moments", MOMENTS, batch, [], [])
        if mark_processed:
            ledger = written.select("article_id").distinct()
            self._write(ledger, "processed", schemas.PROCESSED, batch, [], [])

    def write_failures(self, failures: DataFrame, batch: Batch) -> None:
        self._write(failures, "failures", schemas.FAILURES, batch, [], [])

    def write_uptime(self, intervals: DataFrame, late: DataFrame, seen: dt.datetime | None, batch: Batch) -> None:
        """A batch's intervals, split by ``open``; its late beats; and the latest beat so far, last, as its mark of being done."""
        full = T.StructType([*schemas.UPTIME.fields, T.StructField("open", T.BooleanType())])
        self._write(intervals, "uptime", full, batch, ["open"], ["open", "service", "start"])
        self._write(late, "late_beats", schemas.BEATS, batch, [], [])
        micros = None if seen is None else (seen - _EPOCH) // dt.timedelta(microseconds=1)
        self._write(self.spark.createDataFrame([(micros,)], _SEEN), "uptime_seen", _SEEN, batch, [], [])

    def batch(self, table: str, schema: T.StructType, batch: Batch) -> DataFrame:
        """One table's rows of one batch."""
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}/{batch.path}")
