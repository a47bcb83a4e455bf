"""The model relations, drawn from the test tables (see TESTDATA.md).

Each is a narrow projection of one table, so it costs one scan and no shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import DATA
from ..session import configure
from ..specs import Attribute, InferenceSpec, Label

AS_OF = dt.datetime(2024, 1, 20, 12, 34, 56, tzinfo=dt.timezone.utc)

# events.ts is stored without a zone; reading it as TIMESTAMP under a UTC session gives the
# instants meant, and keeps predicates on it in the scan.
_EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"

VECTOR_TYPES = ("view", "click", "purchase")

SPEC = InferenceSpec.resolve(
    {
        "Prose": [
            Attribute("language", tuple(Label(x) for x in ("the of", "der die", "les une", "los las"))),
            Attribute(
                "content",
                tuple(Label(x) for x in ("license", "password", "http", "email", "phone")),
                top_n=2,
                cutoff=0.5,
            ),
        ]
    },
    default_top_n=1,
    default_cutoff=0.3,
)

LABEL_AXIS = {"view": 0.0, "click": 1.0, "purchase": 2.0, "signup": 3.0}


class Tables:
    """Model relations over one folder of test tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}.parquet"

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(table))

    def stream(self, table: str, schema: T.StructType) -> DataFrame:
        # A pattern, as a plain path to a stream has to be a folder.
        return self.spark.readStream.schema(schema).parquet(f"{self.folder}/{{{table}}}.parquet")

    def events(self) -> DataFrame:
        return self.spark.read.schema(_EVENTS).parquet(self.path("events"))

    def metrics(self) -> DataFrame:
        """One metric per event: the user is the article, the event type the label."""
        return self.events().select(
            F.lit("events").alias("classification"),
            F.col("user_id").cast("string").alias("article_id"),
            category(F.col("event_type")).alias("category"),
            F.col("event_type").alias("label"),
            F.col("ts").alias("timestamp"),
            score().alias("score"),
        )

    def classifications(self, name: Column | None = None) -> DataFrame:
        """One row per event with two attributes: its type scored by value, and a tier
        scored by the number in its props."""
        k = F.get_json_object("props", "$.k").cast("int")
        tier = F.when(k < 34, "low").when(k < 67, "mid").otherwise("high")

        def one(label: Column, value: Column) -> Column:
            return F.array(F.struct(label.alias("label"), value.alias("score")))

        data = F.create_map(
            category(F.col("event_type")),
            one(F.col("event_type"), score()),
            F.lit("tier"),
            one(tier, k / 100.0),
        )
        return self.events().select(
            (F.lit("events") if name is None else name).alias("classification"),
            F.col("event_id").cast("string").alias("id"),
            F.col("user_id").cast("string").alias("article_id"),
            F.col("ts").alias("timestamp"),
            data.cast(DATA).alias("data"),
        )

    def articles(self) -> DataFrame:
        """Customers as the articles events refer to."""
        minutes = F.col("c_custkey") % 43200
        return self.raw("customer").select(
            F.col("c_custkey").cast("string").alias("id"),
            F.col("c_mktsegment").alias("source_id"),
            F.lit("rss").alias("source_type"),
            F.col("c_name").alias("title"),
            F.lit("").alias("content"),
            F.timestamp_seconds(F.lit(1704067200) + minutes * 60).alias("timestamp"),
            F.concat(F.lit("c://"), F.col("c_custkey")).alias("link"),
            F.lit(False).alias("processed"),
        )

    def event_articles(self) -> DataFrame:
        """Events as articles, spread over a month."""
        return self.events().select(
            F.col("event_id").cast("string").alias("id"),
            F.col("event_type").alias("source_id"),
            F.lit("webhook").alias("source_type"),
            F.col("event_type").alias("title"),
            F.col("props").alias("content"),
            F.col("ts").alias("timestamp"),
            F.concat(F.lit("e://"), F.col("event_id")).alias("link"),
            F.lit(False).alias("processed"),
        )

    def documents(self) -> DataFrame:
        """Documents as text articles."""
        return self.raw("documents").select(
            F.col("doc_id").cast("string").alias("id"),
            F.col("source").alias("source_id"),
            F.lit("webhook").alias("source_type"),
            F.concat_ws(" ", "lang", "source").alias("title"),
            F.col("text").alias("content"),
            F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("timestamp"),
            F.concat(F.lit("doc://"), F.col("doc_id")).alias("link"),
            F.lit(False).alias("processed"),
        )

    def beats(self) -> DataFrame:
        return self.events().select(F.col("event_type").alias("service"), F.col("ts").alias("timestamp"))


def category(event_type: Column) -> Column:
    return F.when(event_type.isin(*VECTOR_TYPES), "vector").otherwise("severity")


def score() -> Column:
    return F.least(F.col("value") / 100.0, F.lit(1.0))
