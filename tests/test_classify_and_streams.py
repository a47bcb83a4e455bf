import datetime as dt
import json
import os
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import classify as c
from tidemark.operators import filters, rollup, uptime
from tidemark.specs import Attribute, InferenceSpec, Label, classify_prompt
from tidemark.streaming import ingest, sessions
from tidemark.streaming.store import Batch, Store

# Scorers defined here travel to the workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NOW = dt.datetime(2024, 6, 1, 12, 0, 0)

SPEC = InferenceSpec.resolve(
    {
        "Topic": [
            Attribute("animal", (Label("cat"), Label("dog"), Label("big dog"))),
            Attribute("place", (Label("house"), Label("garden")), top_n=2, cutoff=0.6),
        ],
        "Tone": [Attribute("mood", (Label("happy"), Label("sad")), top_n=0, cutoff=0.0)],
    },
    default_top_n=1,
    default_cutoff=0.4,
)

TEXTS = ["Cat cat dog", "a dog in the garden, garden, GARDEN and house house", "", "happy happy sad", "nothing"]


def articles(spark, texts=TEXTS, source="s"):
    rows = [(str(i), source, NOW + dt.timedelta(seconds=i, microseconds=5), t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id string, source_id string, timestamp timestamp, content string")


def as_dict(rows):
    return {
        (r.article_id, r.classification): {k: [(s.label, round(s.score, 6)) for s in v] for k, v in r.data.items()}
        for r in rows
    }


def test_spec_inherits_defaults_but_zero_stays():
    by_name = {a.name: (a.top_n, a.cutoff) for attrs in SPEC.classifications.values() for a in attrs}
    assert by_name == {"animal": (1, 0.4), "place": (2, 0.6), "mood": (0, 0.0)}
    assert SPEC.label_axis() == {"happy": 0.0, "sad": 1.0, "cat": 2.0, "dog": 3.0, "big dog": 4.0, "house": 5.0, "garden": 6.0}
    assert SPEC.restrict(["Tone"]).attribute_names() == {"Tone": ["mood"]}


def test_prompt():
    attr = Attribute("a", (Label("X", "means x"), Label("Y")), instruction="Do it.", cutoff=0.25)
    lines = classify_prompt(attr).split("\n")
    assert lines[:5] == ["Do it.", "", "Available labels:", "- X: means x", "- Y"]
    assert any("at or above 0.25" in x for x in lines)
    assert "at or above" not in classify_prompt(Attribute("a", (Label("X"),), cutoff=0.0))


def test_spec_frame(spark):
    rows = {r.attribute: r for r in SPEC.to_frame(spark).collect()}
    assert rows["place"].top_n == 2 and [x.name for x in rows["animal"].labels] == ["cat", "dog", "big dog"]


def test_lexical_classification(spark):
    got = as_dict(c.classify(articles(spark), SPEC).collect())
    assert got["0", "topic"] == {"animal": [("cat", 0.428571)], "place": [("n/i", 0.0)]}
    assert got["1", "topic"]["place"] == [("garden", 0.75), ("house", 0.666667)]
    assert got["2", "topic"] == {"animal": [("n/i", 0.0)], "place": [("n/i", 0.0)]}
    assert got["3", "tone"]["mood"] == [("happy", 0.6), ("sad", 0.4)]
    row = c.classify(articles(spark), SPEC).filter("article_id = '1'").first()
    assert row.timestamp == NOW + dt.timedelta(seconds=1)


def test_scorer_interface_gives_the_same(spark):
    native = c.classify(articles(spark), SPEC).collect()
    python = c.classify_with(articles(spark), SPEC).collect()
    assert as_dict(native) == as_dict(python)
    assert {r.id for r in native} == {r.id for r in python} and len({r.id for r in native}) == 10


def test_native_scoring_needs_no_python_and_no_shuffle(spark):
    plan = c.flatten(c.classify(articles(spark), SPEC))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan and "Exchange" not in plan


class Picky:
    """Fails on some texts, and on any batch holding one."""

    def score(self, texts, labels, template, multi_label):
        if any("bad" in t for t in texts):
            raise RuntimeError("cannot read")
        return np.full((len(texts), len(labels)), 0.5)


def test_one_bad_text_does_not_take_its_batch_along(spark):
    done = c.split_failures(c.classify_with(articles(spark, ["fine", "bad one", "fine too"]), SPEC, Picky))
    assert {r.article_id for r in done.rows.collect()} == {"0", "2"}
    assert {(r.article_id, r.error) for r in done.failures.collect()} == {("1", "RuntimeError: cannot read")}


@pytest.mark.parametrize("run", [c.classify, lambda a, s, w: c.classify_with(a, s, wanted=w)])
def test_sources_ask_for_classifications(spark, run):
    both = articles(spark, ["x"], "all").unionByName(articles(spark, ["x"], "none")).unionByName(articles(spark, ["x"], "tone"))
    rows = run(both.withColumn("id", F.col("source_id")), SPEC, {"none": [], "tone": ["Tone"]}).collect()
    assert {(r.article_id, r.classification) for r in rows} == {("all", "topic"), ("all", "tone"), ("tone", "tone")}


def test_replies(spark):
    spec = SPEC.restrict(["Topic"])
    rows = [
        ("0", "Topic", "animal", '{"cat": 0.9, "dog": 0.8}'),
        ("0", "Topic", "place", ""),
        ("1", "Topic", "animal", '{"cat": 0.9}'),
        ("1", "Topic", "place", "oops"),
        ("2", "Topic", "animal", '{"cat": 0.9}'),
        ("3", "Topic", "animal", '{"cat": 0.1}'),
        ("3", "Topic", "place", '{"house": 0.7, "garden": 0.9, "x": 0.95}'),
        ("3", "Topic", "place", '{"house": 0.7, "garden": 0.9, "x": 0.95}'),
        ("3", "Topic", "unknown", "{}"),
    ]
    replies = spark.createDataFrame(rows, schemas.MODEL_REPLIES)
    done = c.split_failures(c.classify_replies(replies, articles(spark), spec))
    got = as_dict(done.rows.collect())
    assert got == {
        ("0", "topic"): {"animal": [("cat", 0.9)], "place": [("n/i", 0.0)]},
        ("3", "topic"): {"animal": [("n/i", 0.0)], "place": [("x", 0.95), ("garden", 0.9)]},
    }
    assert {r.article_id: r.error for r in done.failures.collect()} == {"1": "place: invalid json", "2": "reply missing for an attribute"}


# --- streams ---------------------------------------------------------------

SOURCE = {
    "id": "s1",
    "type": "webhook",
    "name": "n",
    "url": "webhook://docs",
    "active": True,
    "trust": "low",
    "tags": [],
    "extract": {"title": "t", "content": "c", "timestamp": "at", "link": "l", "items": None},
    "spec": '{"path":"docs"}',
}


def pipeline(spark, root, **more):
    sources = spark.createDataFrame([SOURCE], schemas.SOURCES)
    rules = {"webhook://docs": filters.parse_filters(["!content.contains.eq.spam"])}
    return ingest.Pipeline(Store(spark, root), "webhook", sources, SPEC, rules, as_of=lambda: NOW, **more)


def land(folder, name, docs):
    folder.mkdir(exist_ok=True)
    lines = [
        json.dumps({"path": "/docs", "headers": {}, "body": json.dumps({"t": title, "c": text, "l": link, "at": 1717243200})})
        for link, title, text in docs
    ]
    (folder / name).write_text("\n".join(lines))


def payload_stream(spark, folder, files_per_batch=1):
    return spark.readStream.schema(schemas.PAYLOADS).option("maxFilesPerTrigger", files_per_batch).json(str(folder))


FIRST = [("u1", "one", "cat cat"), ("u2", "two", "spam"), ("u1", "again", "dog"), ("u3", "t" * 300, "dog")]
SECOND = [("u1", "late", "dog"), ("u4", "four", "happy garden")]


def state(store):
    return (
        sorted((r.link, r.title, r.content) for r in store.articles().collect()),
        sorted((r.article_id, r.category, r.label, r.score) for r in store.metrics().collect()),
        sorted(r.article_id for r in store.processed().collect()),
        sorted(r.id for r in store.classifications().collect()),
    )


def ingest_all(spark, p, folder, checkpoint, files=1):
    ingest.ingest_available(payload_stream(spark, folder, files), p, str(checkpoint))


def test_stream_batches_equal_one_batch(spark, tmp_path):
    split = pipeline(spark, str(tmp_path / "split"))
    for name, docs in (("a.json", FIRST), ("b.json", SECOND)):
        land(tmp_path / "in", name, docs)
        ingest_all(spark, split, tmp_path / "in", tmp_path / "cp1")
    links = [a[0] for a in state(split.store)[0]]
    assert links == ["u1", "u3", "u4"]
    assert state(split.store)[0][0][1] in ("one", "again")
    assert split.quarantined().isEmpty()
    assert split.store.metrics().count() == 3 * 4
    assert split.store.articles().select("batch_id").distinct().count() == 2

    # Nothing new: a restart from the checkpoint, and a replay under a new one.
    before = state(split.store)
    for checkpoint in ("cp1", "cp2"):
        ingest_all(spark, split, tmp_path / "in", tmp_path / checkpoint, 10)
        assert state(split.store) == before

    land(tmp_path / "in", "c.json", [("u5", "five", "sad")])
    ingest_all(spark, split, tmp_path / "in", tmp_path / "cp1")
    assert [a[0] for a in state(split.store)[0]] == ["u1", "u3", "u4", "u5"]
    # The rollup kept up batch by batch is that of all metrics.
    rows = lambda df: sorted((r.label, r.rows, round(r.sum, 9), round(r.m2, 9)) for r in df.collect())
    assert rows(rollup.merged(split.store.moments(), *rollup.KEYS)) == rows(rollup.moments(split.store.metrics()))


def test_admission_reads_no_stored_ids(spark, tmp_path, monkeypatch):
    """Whatever is stored: known ids are told by the stream's state."""
    p = pipeline(spark, str(tmp_path / "t"))
    for n in range(3):
        land(tmp_path / "in", f"{n}.json", [(f"h{n}-{i}", "t", "cat") for i in range(20)])
        ingest_all(spark, p, tmp_path / "in", tmp_path / "cp")
    land(tmp_path / "in", "again.json", [("h0-1", "t", "cat"), ("new", "t", "cat"), ("h2-7", "other", "dog")])

    def unread():
        raise AssertionError("stored articles are read")

    with monkeypatch.context() as m:
        m.setattr(p.store, "articles", unread)
        ingest.start_landing(payload_stream(spark, tmp_path / "in"), p, str(tmp_path / "cp")).awaitTermination()
        admission = ingest.start_admission(p)
        admission.awaitTermination()
    state_of = admission.recentProgress[-1].stateOperators[0]
    assert state_of.numRowsTotal == 61 and state_of.numRowsUpdated <= 1
    assert "rocksdbGetCount" in state_of.customMetrics
    assert p.store.articles().count() == 61


def test_streams_that_share_articles(spark, tmp_path):
    """Two landings that deliver the same articles: each is stored, classified and counted once."""
    p = pipeline(spark, str(tmp_path / "t"), make_scorer=Moody)
    land(tmp_path / "one", "a.json", [("u1", "one", "cat"), ("u2", "two", "dog")])
    land(tmp_path / "two", "a.json", [("u1", "one", "cat"), ("u2", "two", "dog"), ("u3", "three", "cat")])
    queries = [ingest.start_landing(payload_stream(spark, tmp_path / x), p, str(tmp_path / f"cp-{x}")) for x in ("one", "two")]
    for q in queries:
        q.awaitTermination()
    assert p.store.spark.read.parquet(f"{p.store.root}/incoming").groupBy("stream").count().count() == 2
    ingest.start_admission(p).awaitTermination()
    assert sorted(r.link for r in p.store.articles().collect()) == ["u1", "u2", "u3"]
    assert p.store.metrics().groupBy("article_id", "category", "label").count().filter("count > 1").isEmpty()
    # What one stream failed on is not taken up by another one's batch.
    other = Batch("other", 7)
    p.store.write_articles(articles(spark, ["cat"]).withColumns({"source_type": F.lit("http"), "title": F.lit("t"), "link": F.lit("x"), "processed": F.lit(False)}), other)
    assert p.store.failures().count() > 0 and [r.link for r in p.pending(other).collect()] == ["x"]


def test_retried_batch_leaves_the_same_rows(spark, tmp_path):
    land(tmp_path / "in", "a.json", FIRST)
    p = pipeline(spark, str(tmp_path / "t"))
    batch = spark.read.schema(schemas.PAYLOADS).json(str(tmp_path / "in"))
    p.run_batch(batch, 0)
    before = state(p.store)
    p.insert(batch, 0)
    p.run_batch(batch, 0)
    assert state(p.store) == before


def test_articles_brought_along_are_not_marked(spark, tmp_path):
    p = pipeline(spark, str(tmp_path / "t"))
    p.classify(articles(spark), 0, mark_processed=False)
    assert p.store.classifications().count() == 2 * len(TEXTS)
    assert p.store.processed().count() == 0


class Moody:
    def score(self, texts, labels, template, multi_label):
        if any("dog" in t for t in texts):
            raise RuntimeError("no dogs")
        return np.full((len(texts), len(labels)), 0.5)


def test_failures_are_retried_then_given_up(spark, tmp_path):
    p = pipeline(spark, str(tmp_path / "t"), make_scorer=Moody, attempt_cap=2)
    frames = [
        spark.createDataFrame([(None, "/docs", {}, json.dumps({"t": "t", "c": text, "l": link}), None)], schemas.PAYLOADS)
        for link, text in (("u1", "dog"), ("u2", "cat"), ("u3", "cat"), ("u4", "cat"))
    ]
    for n, frame in enumerate(frames):
        p.run_batch(frame, n)
    tries = {r.batch_id for r in p.store.failures().collect()}
    assert tries == {0, 1}
    assert p.store.processed().count() == 3
    # With the cause gone and the cap raised, a drain catches up.
    fixed = pipeline(spark, str(tmp_path / "t"), make_scorer=c.LexicalScorer, attempt_cap=99)
    fixed.drain(10)
    assert fixed.store.processed().count() == 4


def test_failures_are_retried_without_end(spark, tmp_path):
    p = pipeline(spark, str(tmp_path / "t"), make_scorer=Moody)
    frames = [
        spark.createDataFrame([(None, "/docs", {}, json.dumps({"t": "t", "c": text, "l": f"v{n}"}), None)], schemas.PAYLOADS)
        for n, text in enumerate(["dog", *["cat"] * 6])
    ]
    for n, frame in enumerate(frames):
        p.run_batch(frame, n)
    assert p.store.failures().count() >= 7 and p.store.processed().count() == 6
    fixed = pipeline(spark, str(tmp_path / "t"), make_scorer=c.LexicalScorer)
    fixed.drain(10)
    assert fixed.store.processed().count() == 7


def test_a_drain_overwrites_no_batch(spark, tmp_path):
    p = pipeline(spark, str(tmp_path / "t"), make_scorer=Moody)
    for n, text in enumerate(["cat", "dog", "cat"]):
        body = json.dumps({"t": "t", "c": text, "l": f"w{n}"})
        p.run_batch(spark.createDataFrame([(None, "/docs", {}, body, None)], schemas.PAYLOADS), n)
    done = p.store.processed().count()
    fixed = pipeline(spark, str(tmp_path / "t"), make_scorer=c.LexicalScorer)
    fixed.drain(0)
    fixed.drain(1)
    assert done == 2 and fixed.store.processed().count() == 3
    assert fixed.store.metrics().count() == 3 * 4
    # Nor does a later batch take up what a drain has done.
    assert [r.link for r in p.pending(2).collect()] == ["w2"]


def test_last_error_and_newest_reply(spark):
    failed = spark.createDataFrame([("a", "k", "timeout", 1), ("a", "k", "bad reply", 2)], "article_id string, classification string, error string, batch_id long")
    assert [(r.attempts, r.error) for r in c.dead_letters(failed, 2).collect()] == [(2, "bad reply")]


def beats_stream(spark, folder, beats):
    folder.mkdir(exist_ok=True)
    for i, part in enumerate(beats):
        (folder / f"{i}.json").write_text("\n".join(json.dumps({"service": s, "timestamp": t.isoformat() + "Z"}) for s, t in part))
        # Files are read in order of their times.
        os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return (
        spark.readStream.schema("service string, timestamp timestamp").option("maxFilesPerTrigger", 1).json(str(folder))
    )


def intervals_of(df):
    return sorted((r.service, r.start, r.recent) for r in df.collect())


def run_beats(spark, tmp_path, parts, **more):
    store = Store(spark, str(tmp_path / "t"))
    sessions.start_uptime(beats_stream(spark, tmp_path / "in", parts), store, str(tmp_path / "cp"), 30, **more).awaitTermination()
    return store


def test_uptime_stream(spark, tmp_path):
    at = lambda s: NOW + dt.timedelta(seconds=s)
    parts = [[("a", at(0)), ("a", at(20)), ("b", at(5))], [("a", at(45)), ("a", at(100))], [("b", at(35.5)), ("a", at(130))]]
    store = run_beats(spark, tmp_path, parts, lateness=dt.timedelta(minutes=5))
    whole = spark.createDataFrame([b for p in parts for b in p], "service string, timestamp timestamp")
    assert intervals_of(store.uptime()) == intervals_of(uptime.uptime_intervals(whole, 30))
    assert store.late_beats().isEmpty()
    with pytest.raises(ValueError):
        sessions.closed_intervals(whole, 0)
    with pytest.raises(ValueError):
        sessions.extend_on_batch(store, 0)


def test_uptime_stream_carries_open_intervals_only(spark, tmp_path):
    """Closed intervals are appended once; a batch holds what it closed and what is open, not the history."""
    at = lambda s: NOW + dt.timedelta(seconds=s)
    parts = [[("a", at(600 * n + s)) for s in (0, 30, 60)] + [("b", at(600 * n + 90 + s)) for s in (0, 45)] for n in range(4)]
    store = run_beats(spark, tmp_path, parts)
    whole = spark.createDataFrame([b for p in parts for b in p], "service string, timestamp timestamp")
    assert intervals_of(store.uptime()) == intervals_of(uptime.uptime_intervals(whole, 30))
    stored = store._uptime()
    # 3 intervals a batch, each stored once open and once closed.
    assert stored.filter("NOT open").distinct().count() == stored.filter("NOT open").count() == 9
    assert max(r["count"] for r in stored.groupBy("batch_id").count().collect()) <= 6
    assert store.open_uptime().count() == 3


def test_late_beats_are_kept_and_settled(spark, tmp_path):
    """In time: a beat before others, not before the watermark. Late: one that could touch a closed interval."""
    at = lambda s: NOW + dt.timedelta(seconds=s)
    parts = [[("a", at(0)), ("a", at(20)), ("b", at(0))], [("a", at(500)), ("b", at(470))], [("a", at(455)), ("a", at(480)), ("a", at(45)), ("b", at(10_000))], []]
    store = run_beats(spark, tmp_path, parts[:3])
    table = {(s, (x - NOW).total_seconds(), (y - NOW).total_seconds()) for s, x, y in intervals_of(store.uptime())}
    assert table == {("a", 0, 20), ("b", 0, 0), ("b", 470, 470), ("a", 455, 500), ("b", 10_000, 10_000)}
    assert [(r.service, r.timestamp) for r in store.late_beats().collect()] == [("a", at(45))]
    whole = spark.createDataFrame([b for p in parts for b in p], "service string, timestamp timestamp")
    assert intervals_of(sessions.settle_late(store)) == intervals_of(uptime.uptime_intervals(whole, 30))


def test_drivers_cover_feeds_and_json(spark, tmp_path):
    rss = "<rss><channel><item><title>A</title><link>u1</link><description>cat</description></item><item><title>B</title><link>u2</link><description>dog</description></item></channel></rss>"
    cases = {"rss": ({"spec": '{"target":"description","limit":1}'}, rss), "http": ({"extract": {**SOURCE["extract"], "items": "$"}}, '[{"t":"A","c":"cat","l":"u1"}]')}
    for kind, (more, body) in cases.items():
        sources = spark.createDataFrame([{**SOURCE, "type": kind, **more}], schemas.SOURCES)
        p = ingest.Pipeline(Store(spark, str(tmp_path / kind)), kind, sources, SPEC, as_of=lambda: NOW)
        p.run_batch(spark.createDataFrame([("s1", None, None, body, None), ("gone", None, None, body, None)], schemas.PAYLOADS), 0)
        assert [(r.title, r.content, r.source_type) for r in p.store.articles().collect()] == [("A", "cat", kind)]
        p.land(spark.createDataFrame([("s1", None, None, body[:-9], None)], schemas.PAYLOADS), 1)
        assert [(r.source_id, "not" in r.error) for r in p.unreadable().filter("source_id = 's1'").collect()] == [("s1", True)]


def test_payloads_are_not_dealt_out_by_source(spark, tmp_path):
    """One source may send most of a batch: joined by a shuffle on its id or route, one task would read all of that."""
    for kind in ("rss", "http", "webhook"):
        sources = spark.createDataFrame([{**SOURCE, "type": kind}], schemas.SOURCES)
        p = ingest.Pipeline(Store(spark, str(tmp_path / kind)), kind, sources, SPEC, as_of=lambda: NOW)
        found = p.read(spark.createDataFrame([], schemas.PAYLOADS), NOW)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
