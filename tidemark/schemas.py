"""Table schemas, allowed values, and the write-time checks on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABEL_SCORE = T.StructType(
    [T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())]
)
SCORES = T.ArrayType(LABEL_SCORE)
DATA = T.MapType(T.StringType(), SCORES)


def struct(**fields: T.DataType) -> T.StructType:
    # Built from objects: parsing DDL text would need a session at import.
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_TEXT, _TIME, _INT, _BOOL = T.StringType(), T.TimestampType(), T.IntegerType(), T.BooleanType()
_TEXT_MAP = T.MapType(_TEXT, _TEXT)

ARTICLES = struct(
    id=_TEXT,
    source_id=_TEXT,
    source_type=_TEXT,
    title=_TEXT,
    content=_TEXT,
    timestamp=_TIME,
    link=_TEXT,
    processed=_BOOL,
)
CLASSIFICATIONS = struct(classification=_TEXT, id=_TEXT, article_id=_TEXT, timestamp=_TIME, data=DATA)
METRICS = struct(
    classification=_TEXT,
    article_id=_TEXT,
    category=_TEXT,
    label=_TEXT,
    timestamp=_TIME,
    score=T.DoubleType(),
)
AUTH = struct(kind=_TEXT, token=_TEXT, header=_TEXT, secret=_TEXT, user=_TEXT, **{"pass": _TEXT})
EXTRACT = struct(title=_TEXT, content=_TEXT, timestamp=_TEXT, link=_TEXT, items=_TEXT)
RETRY = struct(max=_INT, backoff_ms=_INT, max_delay_ms=_INT)
SOURCES = struct(
    id=_TEXT,
    type=_TEXT,
    name=_TEXT,
    url=_TEXT,
    hash=T.BinaryType(),
    active=_BOOL,
    trust=_TEXT,
    description=_TEXT,
    tags=T.ArrayType(_TEXT),
    dedupe_key=_TEXT,
    timeout_seconds=_INT,
    auth=AUTH,
    extract=EXTRACT,
    retry=RETRY,
    headers=_TEXT_MAP,
    spec=_TEXT,
    created_at=_TIME,
    updated_at=_TIME,
)
BEATS = struct(service=_TEXT, timestamp=_TIME)
UPTIME = struct(service=_TEXT, start=_TIME, recent=_TIME, up=_BOOL)
FEED_ITEMS = struct(
    source_id=_TEXT,
    seq=_INT,
    title=_TEXT,
    link=_TEXT,
    description=_TEXT,
    content=_TEXT,
    published=_TEXT,
)
PAYLOADS = struct(source_id=_TEXT, path=_TEXT, headers=_TEXT_MAP, body=_TEXT, received_at=_TIME)
MODEL_REPLIES = struct(article_id=_TEXT, classification=_TEXT, attribute=_TEXT, raw=_TEXT)
UPLOADS = struct(classification=_TEXT, id=_TEXT, article_id=_TEXT, timestamp=_TEXT, data=DATA)
SCRAPE_RESULTS = struct(
    type=_TEXT,
    source_id=_TEXT,
    url=_TEXT,
    title=_TEXT,
    content=_TEXT,
    timestamp=_TEXT,
    reason=_TEXT,
)
PROCESSED = struct(article_id=_TEXT)
FAILURES = struct(article_id=_TEXT, classification=_TEXT, error=_TEXT)

# The enumerations the stored tables accept.
SOURCE_TYPES = ("rss", "page", "webhook", "http", "websocket")
SOURCE_TRUST = ("unknown", "low", "medium", "high")
SOURCE_TARGETS = ("content", "description", "link")
SOURCE_URL_TYPES = ("completed", "retry", "discover")

# Fixed value: what stands in for "no label reached the cutoff".
SENTINEL_LABEL = "n/i"


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast to a table schema by name; a missing column is an error."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def article_problem(source_types: tuple[str, ...] = SOURCE_TYPES) -> Column:
    """Why an article row may not be stored, or NULL. One bad row is set aside on
    its own instead of failing the batch it came in."""
    return (
        F.when(F.col("id").isNull(), "id is null")
        .when(F.col("title").isNull(), "title is null")
        .when(F.col("content").isNull(), "content is null")
        .when(~F.coalesce(F.col("source_type").isin(*source_types), F.lit(False)), "unknown source type")
    )


def source_problem() -> Column:
    return (
        F.when(F.col("url").isNull() | (F.col("url") == ""), "url is empty")
        .when(~F.coalesce(F.col("type").isin(*SOURCE_TYPES), F.lit(False)), "unknown source type")
        .when(~F.coalesce(F.col("trust").isin(*SOURCE_TRUST), F.lit(False)), "unknown trust")
        .when(F.col("tags").isNull(), "tags is null")
        .when(F.col("name").isNull(), "name is null")
    )


def split_valid(df: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """(storable rows, quarantined rows with an ``error`` column)."""
    flagged = df.withColumn("error", problem)
    return flagged.filter("error IS NULL").drop("error"), flagged.filter("error IS NOT NULL")
