import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics as m
from tidemark.operators import points, rates
from tidemark.operators.search import articles_with_all_labels, search
from tidemark.schemas import CLASSIFICATIONS, METRICS
from tidemark.specs import SearchRequest

DAY = dt.datetime(2024, 5, 1)


def at(hours):
    return DAY + dt.timedelta(hours=hours)


def scored(**attributes):
    return {k: [{"label": a, "score": b} for a, b in v] for k, v in attributes.items()}


@pytest.fixture
def small(spark):
    rows = [
        ("events", "c1", "a1", at(10), scored(vector=[("Phishing", 0.9)])),
        ("events", "c2", "a1", at(11), scored(vector=[("Phishing", 0.2)])),
        ("events", "c3", "a2", at(10.5), scored(vector=[("Phishing", 0.8)], severity=[("High", 0.1)])),
        ("events", "c4", "a3", at(9), scored(vector=[("Recon", 0.7)])),
        ("events", "c5", "a4", at(12), None),
        ("events", "c6", "a5", at(12), {}),
        ("brand", "c7", "a6", at(12), scored(vector=[("Phishing", 0.9)])),
    ]
    classifications = spark.createDataFrame(rows, CLASSIFICATIONS)
    ids = ["a1", "a2", "a3", "a4", "a5", "a6"]
    articles = spark.createDataFrame([(i, f"Title {i}", f"l/{i}", at(0)) for i in ids], "id string, title string, link string, timestamp timestamp")
    metrics = spark.createDataFrame(
        [("events", "a1", "vector", "Phishing", at(10), 0.9), ("events", "a2", "vector", "Phishing", at(10.5), 0.8), ("events", "a3", "vector", "Recon", at(9), 0.7)]
        + [("events", f"a{i}", "vector", "Phishing", at(12), 0.5) for i in (4, 5)],
        METRICS,
    )
    return classifications, articles, metrics


def found(small, **request):
    rows = search(*small, SearchRequest("Events", **request)).collect()
    return [(r.id, {k: [s.label for s in v] for k, v in r.data.items()}) for r in rows]


def test_newest_row_counts_even_if_the_cutoff_empties_it(small):
    assert found(small, labels=("Phishing",), cutoff=0.5) == [("c3", {"vector": ["Phishing"]})]


def test_without_cutoff(small):
    assert [i for i, _ in found(small)] == ["c2", "c3", "c4"]
    assert [i for i, _ in found(small, end="2024-05-01T10:15:00Z")] == ["c1", "c4"]
    assert [i for i, _ in found(small, limit=1)] == ["c2"]
    assert [i for i, _ in found(small, title="TITLE a2")] == ["c3"]
    assert found(small, labels=("Phishing", "Recon")) == []
    assert [i for i, _ in found(small, labels=("Recon", "Recon"))] == ["c4"]


def search_model(rows, titles, metrics, labels, start, cutoff, limit):
    best = {}
    for i, a, t, data in rows:
        held = {x for b, x in metrics if b == a}
        if a in titles and set(labels) <= held and t >= start:
            if a not in best or (t, [-ord(ch) for ch in i]) > (best[a][1], [-ord(ch) for ch in best[a][0]]):
                best[a] = (i, t, data)
    out = []
    for i, t, data in best.values():
        kept = {k: [s for s in v if s["score"] >= cutoff] for k, v in (data or {}).items()} if cutoff else (data or {})
        kept = {k: v for k, v in kept.items() if v} if cutoff else kept
        if kept:
            out.append((i, t, sum(len(v) for v in kept.values())))
    return [(i, n) for i, t, n in sorted(out, key=lambda r: (-r[1].timestamp(), r[0]))][:limit]


@pytest.mark.parametrize("seed", range(4))
def test_search_against_model(spark, seed):
    rng = random.Random(seed)
    labels = ["L1", "L2", "L3"]
    # A third of all rows belong to one article.
    pick = lambda: "hot" if rng.random() < 0.34 else f"a{rng.randrange(12)}"
    rows, held = [], []
    for n in range(200):
        data = {k: [{"label": rng.choice(labels), "score": rng.randrange(10) / 10}] for k in rng.sample("xyz", rng.randrange(3))}
        rows.append((f"{n:03d}", pick(), at(rng.randrange(60)), data if rng.random() < 0.95 else None))
        held.append((rows[-1][1], rng.choice(labels)))
    titles = [f"a{i}" for i in range(0, 12, 2)] + ["hot"]
    tables = (
        spark.createDataFrame([("events", *r) for r in rows], CLASSIFICATIONS),
        spark.createDataFrame([(a, a, a) for a in titles], "id string, title string, link string"),
        spark.createDataFrame([("events", a, "x", x, DAY, 0.5) for a, x in held], METRICS),
    )
    cutoff, wanted = rng.choice([0.0, 0.5]), rng.sample(labels, rng.randrange(3))
    request = SearchRequest("events", labels=tuple(wanted), start="2024-05-01T20:00:00Z", cutoff=cutoff, limit=5)
    got = [(r.id, sum(len(v) for v in r.data.values())) for r in search(*tables, request).collect()]
    assert got == search_model(rows, titles, held, wanted, at(20), cutoff, 5)


def test_many_labels_take_the_counting_path(spark):
    labels = [f"L{i}" for i in range(40)]
    rows = [("e", "all", "x", x, DAY, 0.5) for x in labels] * 2 + [("e", "some", "x", x, DAY, 0.5) for x in labels[1:]] * 3
    metrics = spark.createDataFrame(rows, METRICS)
    assert [r.article_id for r in articles_with_all_labels(metrics, labels).collect()] == ["all"]
    assert {r.article_id for r in articles_with_all_labels(metrics, labels[1:5]).collect()} == {"all", "some"}


def test_requests_are_clamped():
    make = lambda **p: SearchRequest.from_params({k: [v] for k, v in p.items()})
    assert [make(limit=x).limit for x in ("500", "abc", "0", "200", "7")] == [50, 50, 50, 200, 7]
    assert [make(cutoff=x).cutoff for x in ("1.5", "0", "0.99", "x", "nan")] == [0.0, 0.0, 0.99, 0.0, 0.0]
    assert SearchRequest.from_params({"label": ["a", "b"]}).labels == ("a", "b")


def metric_frame(spark, rows):
    return spark.createDataFrame([("events", a, c, x, t, s) for a, c, x, t, s in rows], METRICS)


def test_aggregates_by_hand(spark):
    df = metric_frame(
        spark,
        [
            ("1", "v", "A", at(1), 0.2),
            ("1", "v", "A", at(2), 0.6),
            ("2", "s", "B", at(3), 1.0),
            ("2", "v", "A", at(30), 0.4),
        ],
    )
    by_label = {r.label: r for r in m.label_metrics(df, "EVENTS").collect()}
    assert (by_label["A"].n, by_label["A"].total) == (3, 4)
    assert by_label["A"].mean == pytest.approx(0.4) and by_label["A"].var == pytest.approx(0.08 / 3)
    signal = {r.label: r for r in m.signals(df).collect()}
    assert signal["B"].entropy == 0.0 and signal["B"].weight == pytest.approx(0.25)
    assert [(str(r.day), r.value) for r in m.heatmap(df).collect()] == [("2024-05-01", pytest.approx(0.45)), ("2024-05-02", pytest.approx(0.1))]
    assert m.heatmap(df, label="Z").count() == 0
    assert [(r.label, r["count"]) for r in m.treemap(df, cutoff=0.4).collect()] == [("A", 2), ("B", 1)]
    assert m.classification_count(df, "other").first()["count"] == 0
    # Both ends of a range are inclusive.
    assert m.metrics_scan(df, start=at(1), end=at(3)).count() == 3


def test_quadrant(spark):
    df = metric_frame(spark, [("1", "v", "A", at(1), 0.2), ("1", "v", "A", at(30), 0.6), ("1", "v", "A", at(31), 0.8)])
    first, second, never = (at(0), at(24)), (at(24), at(48)), (at(100), at(101))
    q = lambda a, b: tuple(m.quadrant(df, None, "A", a, b).first())
    assert q(first, second) == ("A", 2.0, pytest.approx(0.5))
    assert q(never, second) == ("A", 0.0, pytest.approx(0.7))
    assert q(second, never) == ("A", 0.0, pytest.approx(-0.7))
    # Overlapping and open periods count a row in both.
    assert q((None, None), (None, None)) == ("A", 1.0, 0.0)


def test_profile_delta_status(spark):
    df = metric_frame(spark, [("1", "v", "gone", at(1), 0.5), ("1", "v", "both", at(1), 0.2), ("1", "v", "both", at(30), 0.9), ("1", "s", "new", at(30), 0.5)])
    got = {r.label: r.status for r in m.profile_delta(df, None, (at(0), at(24)), (at(25), at(48))).collect()}
    assert got == {"gone": "gone", "both": "up", "new": "new"}


def test_scatter_axis_defaults_to_zero(spark):
    df = metric_frame(spark, [("1", "vector", "A", at(1), 0.2), ("1", "vector", "B", at(1), 0.3), ("9", "vector", "B", at(1), 0.3)])
    articles = spark.createDataFrame([("1", "t", "l", at(0))], "id string, title string, link string, timestamp timestamp")
    got = {(r.label, r.z) for r in points.scatter3d_points(df, articles, {"B": 7.0}).collect()}
    assert got == {("A", 0.0), ("B", 7.0)}
    # The range is that of the article, not of the metric.
    assert points.scatter_points(df, articles, start=at(0.5)).count() == 0
    assert points.plot_points(df, articles, "").count() == 0


def test_rate_counts_empty_buckets(spark):
    now = dt.datetime(2024, 5, 3, 10, 30)
    times = [now, now, now.replace(minute=0), now - dt.timedelta(hours=23, minutes=30), now - dt.timedelta(hours=24), now + dt.timedelta(hours=1)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(times)], "id string, timestamp timestamp")
    day = [r["count"] for r in rates.article_rate(df, "day", now).collect()]
    assert len(day) == 24 and day[-1] == 3 and day[0] == 1 and sum(day) == 4
    month = [r["count"] for r in rates.article_rate(df, "month", now).collect()]
    assert len(month) == 30 and month[-1] == 4 and sum(month) == 6
    with pytest.raises(ValueError):
        rates.article_rate(df, "year", now)


def test_time_and_label_predicates_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "metrics")
    metric_frame(spark, [("1", "v", "A", at(1), 0.2)]).write.partitionBy("classification").parquet(path)
    df = spark.read.schema(METRICS).parquet(path)
    plan = m.label_metrics(df, "events", labels=["A", "B"], start=at(0), end=at(5))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(classification" in plan
    assert "GreaterThanOrEqual(timestamp" in plan and "In(label, [A,B])" in plan
    assert "article_id" not in plan.split("ReadSchema")[1]


def test_newest_row_is_limited_before_the_shuffle(small):
    plan = search(*small, SearchRequest("events"))._jdf.queryExecution().executedPlan().toString()
    final, partial = plan.index("row_number(), 1, Final"), plan.index("row_number(), 1, Partial")
    assert final < plan.index("Exchange hashpartitioning(article_id", final) < partial
    assert "NestedLoop" not in plan
