"""Shared helpers: tables, cut points, Arrow text buffers, word hashes, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import configure

# A word is what stands between these: space, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_RANDOM = np.random.default_rng(20240501)
_BYTE_VALUE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = int(_RANDOM.integers(2**61, 2**62)) * 2 + 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, in a session set up as the operators need it."""
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster shares; one of our own only in a local session where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder they share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="tidemark-"))
        base = _own_folder[0]
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Write as a shared table and read it again: cuts lineage, survives lost executors.

    What was shuffled for it is of no more use and goes at once, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of a number as text, modulo n; NULL for NULL."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and the offsets of its rows; NULL is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    raw = np.frombuffer(data, np.uint8, bounds[-1] - bounds[0], bounds[0])
    return raw, bounds - bounds[0]


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_LANE = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words, and the row number each word is in.

    A word is taken eight bytes at a time, each step mixed before the next. (Sums of bytes times powers, modulo 2 ** 64, would
    give some long words of two letters the hash of their opposite, whatever the base.)
    """
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = np.zeros(len(raw) + 8, np.uint8)
    low[: len(raw)] = _LOWER[raw]
    inside = ~_SEPARATOR[low[: len(raw)]]
    first = np.zeros(len(raw) + 1, bool)
    first[bounds] = True
    starts = np.flatnonzero(inside & (first[:-1] | np.concatenate(([True], ~inside[:-1]))))
    ends = np.flatnonzero(inside & (first[1:] | np.concatenate((~inside[1:], [True])))) + 1
    eights = np.ndarray(len(raw) + 1, np.dtype("<u8"), low.data, strides=(1,))
    length = ends - starts
    hashes = mix(length.astype(np.uint64) + np.uint64(_BASE))
    going, at, left = np.arange(len(starts)), starts, length
    while len(going):
        lane = eights[at] & _LANE[np.minimum(left, 8)]
        hashes[going] = mix(hashes[going] * np.uint64(0x9E3779B97F4A7C15) ^ mix(lane + np.uint64(0xD6E8FEB86659FD93)))
        more = left > 8
        going, at, left = going[more], at[more] + 8, left[more] - 8
    return hashes, np.searchsorted(bounds, starts, side="right") - 1


def slices(batches: Iterator[pa.RecordBatch], text: str | int, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``size`` bytes of text, one row at least."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        groups = np.cumsum(lengths) // size
        cuts = np.flatnonzero(np.diff(groups)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b): the smallest id that links lead to.

    Alternates large-star and small-star steps: each sends the neighbours of an id to the
    smallest of them, by joins and minima only, until nothing changes.
    """
    known = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    known, state = materialize(known), None
    while True:
        now = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == state or not now.n:
            return known.select(F.col("a").alias("id"), F.col("b").alias("component"))
        state = now
        both = known.union(known.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        known = materialize(small.union(least.toDF("a", "b")).distinct())
