"""Session settings the results depend on, and where durable state may go."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Runtime-settable only, so an already running session can be brought in line.
SESSION_SETTINGS = {
    # Day and hour buckets are UTC buckets.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # A hot article or label may hold a third of all rows: let AQE split its
    # partition even where that costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # JSON objects with a repeated key keep the last value instead of failing.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Texts run to 20,000 words; keep the Arrow batches sent to scorers small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    # Merge heartbeat sessions before the shuffle, not only after it.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """Keep the state of streams started from here on in RocksDB, on disk, and checkpoint its changes only:
    state that grows without bound must not be held in memory nor written whole with every batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings, and make this package importable in Python workers."""
    for key, value in SESSION_SETTINGS.items():
        spark.conf.set(key, value)
    _ship(spark)
    return spark


_shipped_to: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped_to:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped_to.add(context.applicationId)


def shared_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The folder every executor can reach, as named by the cluster.

    ``fallback`` is for local sessions, where no such folder is configured; on a cluster each machine
    would have another one under that name.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if fallback is None or not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset and no folder was given")
    return fallback.rstrip("/")
