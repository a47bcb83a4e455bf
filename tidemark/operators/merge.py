"""Writes as table-to-table steps: insert if absent, upsert, delete, reconcile."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import content_hash, uuid5
from ..functions.scores import add_keys, remove_keys
from ..functions.times import timestamp_literal
from .metrics import data_keys
from .predicates import all_of, within


# --- articles --------------------------------------------------------------


def first_per_id(batch: DataFrame, order: str | None = None) -> DataFrame:
    """One row per id: the first by ``order`` (by time where no order column is given).
    Repeats of a hot id shrink to one row per task before the shuffle."""
    by = [order] if order else ["timestamp", "title", "content"]
    return (
        batch.withColumn("_rank", F.row_number().over(Window.partitionBy("id").orderBy(*by)))
        .filter("_rank = 1")
        .drop("_rank")
    )


def new_articles(
    batch: DataFrame,
    existing: DataFrame,
    order: str | None = None,
    horizon: tuple[str | dt.datetime, str | dt.datetime] | None = None,
) -> DataFrame:
    """Rows of the batch whose id is not stored yet; the first row of an id wins.

    History is cut down to the ids of the batch first. For a small batch Spark broadcasts
    those, so the stored table is read (one column) but never shuffled; for a bulk load both
    sides shuffle on the id, unique on either side. ``horizon`` bounds what is read by time,
    for callers who know old links do not come back.
    """
    unique = first_per_id(batch, order)
    stored = existing.filter(all_of([within("timestamp", *horizon)])) if horizon else existing
    # Distinct first, so the copies of a hot id never meet in one task.
    seen = stored.select("id").join(batch.select("id").distinct(), "id", "left_semi")
    return unique.join(seen, "id", "left_anti").select(*[c for c in batch.columns if c != order])


def mark_processed(classified: DataFrame) -> DataFrame:
    """Ledger rows for the articles that got a classification."""
    return classified.select("article_id").distinct()


def processed_flag(articles: DataFrame, ledger: DataFrame) -> DataFrame:
    """Articles with ``processed`` set where the ledger holds them."""
    done = ledger.select(F.col("article_id").alias("id"), F.lit(True).alias("_done")).distinct()
    return (
        articles.join(done, "id", "left")
        .withColumn("processed", F.coalesce("_done", F.lit(False)))
        .select(*articles.columns)
    )


# --- sources ---------------------------------------------------------------

# What a source row is compared by: everything but its key, hash and times.
HASHED_SOURCE_COLUMNS = (
    "type",
    "name",
    "url",
    "active",
    "trust",
    "description",
    "tags",
    "timeout_seconds",
    "auth",
    "extract",
    "retry",
    "headers",
    "spec",
)


def with_source_hash(sources: DataFrame) -> DataFrame:
    """Sources with ``hash`` over the columns whose change should update them."""
    present = [F.col(c) for c in HASHED_SOURCE_COLUMNS if c in sources.columns]
    return sources.withColumn("hash", content_hash(*present))


def source_changes(config: DataFrame, stored: DataFrame) -> DataFrame:
    """(url, action): ``insert``, ``update`` where the hash differs, ``keep``, ``delete``."""
    fresh = config.select("url", F.col("hash").alias("new_hash"), F.lit(True).alias("in_config"))
    old = stored.select("url", F.col("hash").alias("old_hash"), F.lit(True).alias("in_store"))
    action = (
        F.when(F.col("in_config").isNull(), "delete")
        .when(F.col("in_store").isNull(), "insert")
        .when(F.col("new_hash").eqNullSafe(F.col("old_hash")), "keep")
        .otherwise("update")
    )
    return fresh.join(old, "url", "full_outer").select("url", action.alias("action"))


def upsert_sources(stored: DataFrame, batch: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The stored sources after an upsert by url. All columns are replaced but id and
    created_at; updated_at is set. A url twice in one batch is an error."""
    now = timestamp_literal(as_of)
    per_url = F.count(F.lit(1)).over(Window.partitionBy("url"))
    checked = batch.withColumn("_copies", per_url).withColumn(
        "_new",
        F.when(F.col("_copies") > 1, F.raise_error(F.concat(F.lit("url twice in batch: "), F.col("url"))).cast("boolean"))
        .otherwise(F.lit(True)),
    )
    kept = {"id", "created_at"}
    replaced = [c for c in batch.columns if c not in kept | {"url", "updated_at"}]
    new = checked.select(
        "url", "_new", *[F.col(c).alias(f"_n_{c}") for c in replaced]
    )
    is_new = F.coalesce("_new", F.lit(False))
    was_stored = F.col("id").isNotNull()
    columns = {
        "url": F.col("url"),
        "id": F.coalesce("id", uuid5(F.col("url"))),
        "created_at": F.when(was_stored, F.col("created_at")).otherwise(now),
        "updated_at": F.when(is_new & was_stored, now).otherwise(F.col("updated_at")),
        **{c: F.when(is_new, F.col(f"_n_{c}")).otherwise(F.col(c)) for c in replaced},
    }
    joined = stored.join(new, "url", "full_outer")
    return joined.select(*[columns.get(c, F.col(c)).alias(c) for c in stored.columns])


def delete_sources(
    sources: DataFrame, source_urls: DataFrame, gone: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Sources and their page urls without those whose url is listed in ``gone``."""
    left = sources.join(gone.select("url"), "url", "left_anti").select(*sources.columns)
    removed = sources.join(gone.select("url"), "url", "left_semi").select(F.col("id").alias("source_id"))
    return left, source_urls.join(removed, "source_id", "left_anti").select(*source_urls.columns)


def sync_sources(config: DataFrame, stored: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Stored sources brought in line with the configured ones: delete what is gone,
    upsert what is new or changed, leave the rest alone."""
    fresh, old = with_source_hash(config), stored
    changes = source_changes(fresh, old)
    gone = changes.filter("action = 'delete'")
    changed = changes.filter("action IN ('insert', 'update')").select("url")
    left = old.join(gone.select("url"), "url", "left_anti").select(*old.columns)
    return upsert_sources(left, fresh.join(changed, "url", "left_semi").select(*fresh.columns), as_of)


# --- classifications -------------------------------------------------------


def config_keys(spark: SparkSession, wanted: dict[str, list[str]]) -> DataFrame:
    """(classification, key) rows of the configured attributes."""
    for name, keys in wanted.items():
        if not keys:
            raise ValueError(f"classification {name!r} must have at least one attribute")
    rows = [(name.lower(), key) for name, keys in wanted.items() for key in keys]
    return spark.createDataFrame(rows, "classification string, key string")


def classification_changes(
    classifications: DataFrame, configured: DataFrame
) -> DataFrame:
    """(classification, action, add, remove): what brings the stored tables in line with
    (classification, key) rows. Actions are ``create``, ``drop``, ``update``, ``keep``."""
    stored = data_keys(classifications).withColumn("stored", F.lit(True))
    names = classifications.select("classification").distinct().withColumn("has_table", F.lit(True))
    wanted = configured.distinct().withColumn("wanted", F.lit(True))
    diff = wanted.join(stored, ["classification", "key"], "full_outer").groupBy("classification").agg(
        F.max("wanted").alias("wanted"),
        F.sort_array(F.collect_set(F.when(F.col("stored").isNull(), F.col("key")))).alias("add"),
        F.sort_array(F.collect_set(F.when(F.col("wanted").isNull(), F.col("key")))).alias("remove"),
    )
    joined = diff.join(names, "classification", "full_outer")
    action = (
        F.when(F.col("wanted").isNull(), "drop")
        .when(F.col("has_table").isNull(), "create")
        .when((F.size("add") > 0) | (F.size("remove") > 0), "update")
        .otherwise("keep")
    )
    changed = F.col("action") == "update"
    none = F.array().cast("array<string>")
    return joined.withColumn("action", action).select(
        "classification",
        "action",
        F.when(changed, F.col("add")).otherwise(none).alias("add"),
        F.when(changed, F.col("remove")).otherwise(none).alias("remove"),
    )


def reconcile(classifications: DataFrame, changes: list) -> DataFrame:
    """Classification rows after the changes (collected rows of
    :func:`classification_changes`: one per classification)."""
    dropped = [c["classification"] for c in changes if c["action"] == "drop"]
    data = F.col("data")
    for c in changes:
        if c["action"] == "update":
            mine = F.col("classification") == c["classification"]
            updated = add_keys(remove_keys(F.col("data"), list(c["remove"])), list(c["add"]))
            data = F.when(mine, updated).otherwise(data)
    kept = classifications.filter(~F.col("classification").isin(dropped)) if dropped else classifications
    return kept.withColumn("data", data)


def reconcile_metrics(metrics: DataFrame, changes: list) -> DataFrame:
    """Metrics rows after the changes: those of a dropped classification go with it, so that they
    do not come back when its name is used again."""
    dropped = [c["classification"] for c in changes if c["action"] == "drop"]
    return metrics.filter(~F.col("classification").isin(dropped)) if dropped else metrics
