"""The rollup against one pass over the metrics, however its parts were cut."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import metrics as m
from tidemark.operators import rollup as r

BASE = dt.datetime(2024, 2, 27, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        at = BASE + dt.timedelta(seconds=rng.choice([0, 86399, rng.uniform(0, 6 * 86400)]) + 86400 * rng.randrange(3))
        score = None if i % 50 == 0 else 1_000_000 + rng.random() if i % 3 else rng.random()
        label = rng.choice("abc")
        rows.append((rng.choice(["one", "two"]), str(i), "k" if label == "a" else "l", label, at, score))
    return spark.createDataFrame(rows, schemas.METRICS).cache()


@pytest.fixture(scope="module")
def kept(spark, table):
    """Three batches, days out of order and some of them in each; one of them compacted with itself."""
    cut = [table.filter(F.col("article_id").cast("int") % 3 == n) for n in range(3)]
    parts = r.moments(cut[2]).unionByName(r.compacted(r.moments(cut[0]).unionByName(r.moments(cut[0].limit(0))))).unionByName(r.moments(cut[1]))
    return r.Rollup(spark.createDataFrame(parts.collect(), r.MOMENTS), table)


def rows(df):
    return sorted((tuple(x) for x in df.collect()), key=str)


RANGES = [
    (None, None),
    ("2024-02-28T00:00:00Z", "2024-03-01T23:59:59.999999Z"),
    ("2024-02-28T07:30:00Z", "2024-03-02T00:00:00Z"),
    ("2024-02-29T07:30:00Z", "2024-02-29T09:00:00Z"),
    ("2024-02-28T23:59:59Z", "2024-02-29T00:00:00Z"),
    (None, "2024-03-01T12:00:00+05:00"),
    (dt.datetime(2024, 3, 1), None),
    ("2030-01-01T00:00:00Z", None),
]


def same(got, expected):
    got, expected = rows(got), rows(expected)
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert [x if isinstance(x, float) else (x,) for x in a] == [pytest.approx(x, rel=1e-6, abs=1e-6) if isinstance(x, float) else (x,) for x in b]


@pytest.mark.parametrize("start, end", RANGES)
def test_ranges(table, kept, start, end):
    small = table.filter("score < 1 OR score IS NULL")
    of_small = r.Rollup(r.moments(small), small)
    for metrics, rollup in ((small, of_small),):
        same(rollup.label_metrics("one", start=start, end=end), m.label_metrics(metrics, "one", start=start, end=end))
        same(rollup.heatmap("one", label="b", start=start, end=end), m.heatmap(metrics, "one", label="b", start=start, end=end))
        same(rollup.label_delta("two", "c", start, end), m.label_delta(metrics, "two", "c", start, end))
    same(kept.label_delta("two", "c", start, end), m.label_delta(table, "two", "c", start, end))


def test_other_forms(table, kept):
    a, b = ("2024-02-27T00:00:00Z", "2024-02-29T10:00:00Z"), ("2024-03-01T00:00:00Z", "2024-03-04T00:00:00Z")
    same(kept.quadrant("one", "a", a, b), m.quadrant(table, "one", "a", a, b))
    same(kept.quadrant("one", "a", ("2030-01-01T00:00:00Z", None), b), m.quadrant(table, "one", "a", ("2030-01-01T00:00:00Z", None), b))
    same(kept.label_delta("one", ""), m.label_delta(table, "one", ""))
    same(kept.label_metrics("one", category="l").select("label", "n", "total"), m.label_metrics(table, "one", category="l").select("label", "n", "total"))


def test_parts_merge_in_any_grouping(table):
    """A late metric of an old day is one more part."""
    whole = {(x.classification, x.label, x.day): x for x in r.moments(table).collect()}
    cut = [r.moments(table.filter(F.col("article_id").cast("int") % 7 == n)) for n in range(7)]
    left = cut[0]
    for part in cut[1:]:
        left = r.compacted(left.unionByName(part))
    got = {(x.classification, x.label, x.day): x for x in left.collect()}
    assert got.keys() == whole.keys()
    for key, x in got.items():
        assert (x.rows, x.n) == (whole[key].rows, whole[key].n)
        assert x.sum == pytest.approx(whole[key].sum) and x.m2 == pytest.approx(whole[key].m2, rel=1e-3, abs=1e-2)


def test_whole_days_are_not_read_from_the_metrics(kept):
    """A range of whole days scans the rollup only; one that cuts days reads these alone from the metrics."""
    plan = kept.moments("one", start="2024-02-28T00:00:00Z")._jdf.queryExecution().optimizedPlan().toString()
    assert "timestamp" not in plan
    plan = kept.moments("one", start="2024-02-28T01:00:00Z")._jdf.queryExecution().optimizedPlan().toString()
    assert "timestamp" in plan
    first, after = r.whole_days("2024-02-28T00:00:00Z", "2024-03-01T23:59:59.999999Z")
    assert (first.day, after.day) == (28, 2)
    first, after = r.whole_days("2024-02-28T00:00:00.000001Z", "2024-03-01T23:59:59Z")
    assert (first.day, after.day) == (29, 1)
