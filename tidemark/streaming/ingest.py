"""Payload stream to articles, classifications and metrics, one micro-batch at a time."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from .. import schemas
from ..operators.classify import LexicalScorer, Scorer, Wanted, classify, classify_with, dead_letters, split_failures
from ..operators.filters import Filter, apply_filters
from ..operators.merge import new_articles
from ..operators.rates import sources_scan, unprocessed
from ..sources import feeds, json_api, webhooks
from ..session import with_rocksdb
from ..specs import InferenceSpec
from .store import Batch, Store, as_batch

Driver = Callable[[DataFrame, DataFrame, dt.datetime], DataFrame]


def _rss(payloads: DataFrame, sources: DataFrame, as_of: dt.datetime) -> DataFrame:
    options = sources.select(
        F.col("id").alias("source_id"),
        F.get_json_object("spec", "$.target").alias("target"),
        F.coalesce(F.get_json_object("spec", "$.limit").try_cast("int"), F.lit(0)).alias("limit"),
        F.col("spec").isNotNull().alias("has_spec"),
    )
    # Payloads of one source may be most of a batch, so they are never dealt out by source.
    options = F.broadcast(options)
    items = feeds.limit_items(feeds.feed_items(payloads), options.select("source_id", "limit"))
    # A spec that names no target asks for nothing; only a missing spec means description.
    target = F.when(F.col("has_spec"), F.coalesce("target", F.lit("")))
    return feeds.feed_articles(items.join(options.drop("limit"), "source_id", "left"), as_of, target)


def _http(payloads: DataFrame, sources: DataFrame, as_of: dt.datetime) -> DataFrame:
    return json_api.response_articles(json_api.with_extract(payloads, sources), as_of)


def _webhook(payloads: DataFrame, sources: DataFrame, as_of: dt.datetime) -> DataFrame:
    judged = webhooks.judge_deliveries(payloads, webhooks.routes(sources))
    return webhooks.delivery_articles(judged, as_of)


# Source type -> how its payloads become articles. Further types can be added by key.
DRIVERS: dict[str, Driver] = {"rss": _rss, "http": _http, "webhook": _webhook}


def _no_paths(payloads: DataFrame, sources: DataFrame) -> DataFrame:
    return json_api.response_errors(json_api.with_extract(payloads, sources))


# Source type -> (source_id, body, error) of payloads no article can be read from. Webhooks answer theirs at once.
UNREADABLE: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "rss": lambda payloads, sources: feeds.feed_errors(payloads),
    "http": _no_paths,
}


def read_all(payloads: dict[str, DataFrame], sources: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Articles of payloads of several source types (by type), as one table."""
    read = [DRIVERS[kind](rows, sources_scan(sources, kind), as_of) for kind, rows in payloads.items()]
    return reduce(DataFrame.unionByName, read)


def with_source_url(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles with the url of their source, NULL where no active source has that id."""
    active = sources_scan(sources, active_only=True).select(
        F.col("id").alias("source_id"), F.col("url").alias("source_url")
    )
    # Articles of one source may be most of a batch, so they are never dealt out by source.
    return articles.join(F.broadcast(active), "source_id", "left")


def attach_source(articles: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles with their source's url, articles whose source is not active)."""
    joined = with_source_url(articles, sources)
    return joined.filter("source_url IS NOT NULL"), joined.filter("source_url IS NULL").drop("source_url")


@dataclass
class Pipeline:
    """What payloads of one kind run through: :meth:`land` parses and keeps them, :meth:`admit` stores new articles
    and classifies them. Run by hand, :meth:`run_batch` does both, checking ids against the stored ones."""

    store: Store
    kind: str
    sources: DataFrame
    spec: InferenceSpec
    filters: dict[str, list[Filter]] = field(default_factory=dict)
    wanted: Wanted | None = None
    make_scorer: Callable[[], Scorer] | None = None
    # A failed article is tried again with each batch; a number here gives up after so many failures.
    attempt_cap: int | None = None
    as_of: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc)

    def read(self, payloads: DataFrame, as_of: dt.datetime) -> DataFrame:
        """Articles of a batch of payloads with ``source_url`` and ``error``, why a row may
        not be stored."""
        found = DRIVERS[self.kind](payloads, sources_scan(self.sources, self.kind), as_of)
        problem = F.when(F.col("source_url").isNull(), "no active source").otherwise(schemas.article_problem())
        return with_source_url(found, self.sources).withColumn("error", problem)

    def land(self, payloads: DataFrame, batch: Batch | int) -> DataFrame:
        """Parsed rows of a batch, written to a table of their own and read back.

        Filters then reach its scan instead of repeating the parsing below it, rows set aside stay there with their
        error, and a lost executor costs a re-read. Payloads that can't be read at all go to a table beside it.
        """
        batch = as_batch(batch)
        if self.kind in UNREADABLE:
            self.store.stage("unreadable", UNREADABLE[self.kind](payloads, sources_scan(self.sources, self.kind)), batch)
        return self.store.stage("incoming", self.read(payloads, self.as_of()), batch)

    def unreadable(self) -> DataFrame:
        """Payloads no article could be read from, and why."""
        return self.store.spark.read.parquet(f"{self.store.root}/unreadable")

    def storable(self, landed: DataFrame) -> DataFrame:
        """Landed rows without an error that pass their source's filters."""
        return apply_filters(landed.filter("error IS NULL").drop("error"), self.filters).drop("source_url")

    def insert(self, payloads: DataFrame, batch: Batch | int) -> None:
        """Store the articles that pass their source's filters and that no earlier batch has
        stored. A first try of this same batch does not count as earlier."""
        batch = as_batch(batch)
        kept = self.storable(self.land(payloads, batch))
        earlier = self.store.articles().filter(~batch.mine())
        self.store.write_articles(new_articles(kept, earlier), batch)

    def quarantined(self, batch: Batch | int | None = None) -> DataFrame:
        """Rows that were set aside, by one batch or by all."""
        part = "" if batch is None else f"/{as_batch(batch).path}"
        return self.store.spark.read.parquet(f"{self.store.root}/incoming{part}").filter("error IS NOT NULL")

    def classify(self, articles: DataFrame, batch: Batch | int, *, mark_processed: bool = True) -> None:
        """Score articles, store rows and metrics, mark them processed, log the failures.
        Articles a caller brings along, stored or not, are scored without the mark."""
        batch = as_batch(batch)
        if self.make_scorer is None:
            rows = classify(articles, self.spec, self.wanted)
            self.store.write_classified(rows, batch, mark_processed=mark_processed)
            return
        tried = classify_with(articles, self.spec, self.make_scorer, self.wanted)
        done = split_failures(self.store.stage("scored", tried, batch))
        self.store.write_failures(done.failures, batch)
        # An article is done when no classification of it failed.
        whole = done.rows.join(done.failures.select("article_id"), "article_id", "left_anti")
        self.store.write_classified(whole, batch, mark_processed=mark_processed)

    def pending(self, batch: Batch | int) -> DataFrame:
        """This batch's new articles, and those earlier batches of its stream failed on, not given up on. What
        another stream failed on is that stream's to try again.
        With no failures the second part is empty and stored articles are not scanned."""
        batch = as_batch(batch)
        failures = self.store.failures().filter(batch.earlier())
        failed = (
            failures.select("article_id")
            .distinct()
            .join(self.store.processed().filter(~batch.mine()), "article_id", "left_anti")
            .join(self._given_up(failures), "article_id", "left_anti")
            .select(F.col("article_id").alias("id"))
        )
        again = self.store.articles().filter(batch.earlier()).join(failed, "id", "left_semi")
        return self._fresh(batch).unionByName(again.drop("stream", "batch_id"))

    def _given_up(self, failures: DataFrame) -> DataFrame:
        if self.attempt_cap is None:
            return dead_letters(failures, 1).where(F.lit(False))
        return dead_letters(failures, self.attempt_cap)

    def _fresh(self, batch: Batch) -> DataFrame:
        return self.store.batch("articles", schemas.ARTICLES, batch)

    def run_batch(self, payloads: DataFrame, batch: Batch | int) -> None:
        batch = as_batch(batch)
        self.insert(payloads, batch)
        self._classify_new(batch)

    def admit(self, articles: DataFrame, batch: Batch) -> None:
        """Store and classify articles that no batch has stored before."""
        self.store.write_articles(articles, batch)
        self._classify_new(batch)

    def _classify_new(self, batch: Batch) -> None:
        if self.make_scorer is not None:
            self.classify(self.pending(batch), batch)
            return
        # The native scorer cannot fail, so it leaves nothing over, and a batch without new articles has nothing to do.
        fresh = self._fresh(batch)
        if not fresh.isEmpty():
            self.classify(fresh, batch)

    def drain(self, number: int) -> None:
        """Classify everything stored and not yet processed, in one distributed pass. Drains have
        directories of their own, so none overwrites what a stream has stored."""
        dead = self._given_up(self.store.failures())
        left = unprocessed(self.store.articles(), self.store.processed(), dead=dead).select("id")
        articles = self.store.articles().drop("stream", "batch_id").join(left, "id", "left_semi")
        self.classify(articles, Batch("drain", number))


def _run(writer: DataStreamWriter, available_now: bool, interval: str) -> StreamingQuery:
    trigger = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return trigger.start()


def start_landing(
    payloads: DataFrame, pipeline: Pipeline, checkpoint: str, *, available_now: bool = True, interval: str = "1 minute"
) -> StreamingQuery:
    """Parse a stream of payloads into the landed table. Any number of these may run; each has directories of its own."""
    writer = (
        payloads.writeStream.queryName(f"land {pipeline.kind} into {checkpoint}")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(pipeline.store.numbered(checkpoint, pipeline.land))
    )
    return _run(writer, available_now, interval)


def new_in_stream(articles: DataFrame) -> DataFrame:
    """The first article of each id that a stream has ever seen.

    Ids are state, kept by Spark in RocksDB and dealt by id: a batch looks up its own ids there and nothing else, however long the
    history is. Of rows that repeat an id within one batch, any one is kept.
    """
    return articles.dropDuplicates(["id"])


def admitted(pipeline: Pipeline, max_files: int | None = None) -> DataFrame:
    """Landed articles, as a stream, that pass their filters and are new."""
    store = pipeline.store
    schema = pipeline.read(pipeline.store.spark.createDataFrame([], schemas.PAYLOADS), dt.datetime(2000, 1, 1)).schema
    # A landing batch that is tried again replaces its files; the new ones are read, the ids in them known.
    reader = store.spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return new_in_stream(pipeline.storable(reader.parquet(f"{store.root}/incoming")))


def start_admission(
    pipeline: Pipeline, *, available_now: bool = True, interval: str = "1 minute", max_files: int | None = None
) -> StreamingQuery:
    """Store and classify new articles out of the landed table. A store has one of these, whatever lands in it, with its
    checkpoint in the store: all ids of the store are in its state, so sources that share articles, streams that
    start together and payloads delivered again leave each article once, and stored articles are never read to tell."""
    checkpoint = f"{pipeline.store.root}/checkpoints/admission"
    with_rocksdb(pipeline.store.spark)
    writer = (
        admitted(pipeline, max_files).writeStream.queryName(f"admit into {pipeline.store.root}")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(pipeline.store.numbered(checkpoint, pipeline.admit))
    )
    return _run(writer, available_now, interval)


def ingest_available(payloads: DataFrame, pipeline: Pipeline, checkpoint: str) -> None:
    """Land what has arrived, then admit it. Batches come from the checkpoints, so a restart redoes at most the last
    batch of each, into the same directories."""
    start_landing(payloads, pipeline, checkpoint).awaitTermination()
    start_admission(pipeline).awaitTermination()


def bounded_dedupe(articles: DataFrame, horizon: str = "1 day") -> DataFrame:
    """Drop ids repeated within the horizon, with state bounded by it: for sinks that need no more."""
    return articles.withWatermark("timestamp", horizon).dropDuplicatesWithinWatermark(["id"])
