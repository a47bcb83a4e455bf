"""Small tables joined to large ones."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def lookup_frame(spark: SparkSession, rows: list[dict], schema: pa.Schema) -> DataFrame:
    """A driver-made lookup table. Its size is known to Spark, which picks the join."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))
