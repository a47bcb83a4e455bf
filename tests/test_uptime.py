import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import uptime as u

DAY = dt.datetime(2024, 3, 10, 12, 0, 0)


def at(seconds):
    return DAY + dt.timedelta(seconds=seconds)


def model(beats, gap):
    """Interval folding, one service at a time."""
    out = []
    for service in sorted({s for s, _ in beats}):
        open_ = None
        for t in sorted(t for s, t in beats if s == service):
            if open_ is None or (t - open_[1]).total_seconds() > gap:
                open_ = [t, t]
                out.append((service, open_))
            open_[1] = t
    return sorted((s, a, b) for s, (a, b) in out)


def frame(spark, beats):
    return spark.createDataFrame(beats, "service string, timestamp timestamp")


def rows(df):
    return sorted((r.service, r.start, r.recent) for r in df.collect())


def random_beats(seed, n, spread):
    rng = random.Random(seed)
    return [(rng.choice("aab"), at(rng.randrange(spread * 1000) / 1000)) for _ in range(n)]


@pytest.mark.parametrize("seed, n, spread, gap", [(1, 300, 400_000, 900), (2, 2000, 3000, 1), (3, 50, 10_000_000, 200_000), (4, 400, 4000, 30)])
def test_intervals_against_model(spark, seed, n, spread, gap):
    beats = random_beats(seed, n, spread)
    assert rows(u.uptime_intervals(frame(spark, beats), gap)) == model(beats, gap)


def test_gap_of_exactly_the_threshold_extends(spark):
    beats = [("a", at(0)), ("a", at(30)), ("a", at(60.001))]
    assert rows(u.uptime_intervals(frame(spark, beats), 30)) == [("a", at(0), at(30)), ("a", at(60.001), at(60.001))]


def test_interval_across_many_chunks_and_before_the_epoch(spark):
    start = dt.datetime(1969, 12, 29)
    beats = [("a", start + dt.timedelta(hours=i)) for i in range(24 * 6)]
    assert rows(u.uptime_intervals(frame(spark, beats), 3600)) == [("a", beats[0][1], beats[-1][1])]


@pytest.mark.parametrize("seed", [5, 6])
def test_extending_in_parts_equals_one_pass(spark, seed):
    beats = random_beats(seed, 400, 40_000)
    whole = u.uptime_intervals(frame(spark, beats), 60)
    cut = sorted(t for _, t in beats)[150]
    table = u.uptime_intervals(frame(spark, [b for b in beats if b[1] <= cut]), 60)
    later = frame(spark, [b for b in beats if b[1] > cut])
    grown = u.extend_uptime(table, later, 60)
    assert rows(grown) == rows(whole)
    assert rows(u.extend_uptime(grown, later, 60)) == rows(whole)


@pytest.mark.parametrize("seed", [7, 8])
def test_beats_may_come_in_any_order(spark, seed):
    beats = random_beats(seed, 240, 20_000)
    rng = random.Random(seed)
    rng.shuffle(beats)
    table = u.uptime_intervals(frame(spark, beats[:80]), 60)
    for part in (beats[80:160], beats[160:], beats[:50]):
        table = spark.createDataFrame(u.extend_uptime(table, frame(spark, part), 60).collect(), table.schema)
    assert rows(table) == model(beats, 60)


def test_threshold_must_be_positive(spark):
    with pytest.raises(ValueError):
        u.uptime_intervals(frame(spark, [("a", DAY)]), 0)


def intervals(spark, spans):
    rows = [("a", a, b, up) for a, b, up in spans]
    return spark.createDataFrame(rows, "service string, start timestamp, recent timestamp, up boolean")


def test_total(spark):
    table = intervals(spark, [(at(-50), at(50), True), (at(80), at(200), False)])
    total = lambda a, b: u.uptime_total(table, at(a), at(b)).first().uptime
    assert total(0, 100) == pytest.approx(0.7)
    assert total(-50, 50) == 1.0
    assert total(60, 70) == 0.0
    twice = table.unionByName(table)
    assert u.uptime_total(twice, at(0), at(100)).first().uptime == 1.0
    with pytest.raises(ValueError):
        u.uptime_total(table, at(0), at(0))


def segment_model(spans, fmt, as_of):
    step, n = u.SEGMENT_BUCKETS[fmt]
    out = []
    for i in range(n):
        lo = as_of - dt.timedelta(seconds=(n - i) * step)
        hi = lo + dt.timedelta(seconds=step)
        cover = sum(
            max(0.0, (min(hi, b) - max(lo, a)).total_seconds()) for a, b, up in spans if up and a < hi and b > lo
        )
        out.append(100.0 * cover / step)
    return out


@pytest.mark.parametrize("fmt, scale", [("day", 3600), ("month", 86400)])
def test_segments_against_model(spark, fmt, scale):
    rng = random.Random(9)
    spans = []
    for _ in range(60):
        a = rng.uniform(-40, 3) * scale
        spans.append((at(round(a, 3)), at(round(a + rng.choice([0, rng.uniform(0, 9)]) * scale, 3)), rng.random() < 0.8))
    got = [r.percent for r in u.uptime_segments(intervals(spark, spans), fmt, DAY).collect()]
    assert got == pytest.approx(segment_model(spans, fmt, DAY))


def test_segments_empty_and_bad_format(spark):
    empty = intervals(spark, [(at(0), at(1), True)]).filter(F.lit(False))
    got = u.uptime_segments(empty, "day", DAY).collect()
    assert len(got) == 144 and {r.percent for r in got} == {0.0}
    with pytest.raises(ValueError):
        u.uptime_segments(empty, "year", DAY)


def test_segments_by_service(spark):
    """Services keep apart: none passes 100, and each equals what it gives alone."""
    rng = random.Random(4)
    rows, spans = [], {}
    for service in "abc":
        t = -40.0 * 3600
        while t < 3600:
            end = t + rng.choice([30, 500, 5000, 90_000])
            spans.setdefault(service, []).append((at(round(t, 3)), at(round(end, 3)), True))
            t = end + rng.choice([31, 700, 20_000])
        rows += [(service, *x) for x in spans[service]]
    table = spark.createDataFrame(rows, "service string, start timestamp, recent timestamp, up boolean")
    for fmt in ("day", "month"):
        got = u.uptime_segments(table, fmt, DAY, ("service",)).collect()
        for service, own in spans.items():
            assert [r.percent for r in got if r.service == service] == pytest.approx(segment_model(own, fmt, DAY))
        assert max(r.percent for r in got) <= 100
    total = [r.percent for r in u.uptime_segments(table, "day", DAY).collect()]
    assert total == pytest.approx([sum(x) for x in zip(*(segment_model(s, "day", DAY) for s in spans.values()))])


def test_a_sweep_has_four_rows_an_interval(spark):
    """However long an interval is; and a beat a year late touches the days around it only."""
    table = intervals(spark, [(at(-86400 * 400), at(0), True)])
    plan = u.uptime_segments(table, "day", DAY)._jdf.queryExecution().toString()
    assert "sequence" not in plan
    year = [("a", at(-86400 * d), at(-86400 * d + 50), True) for d in range(365)]
    stored = spark.createDataFrame(year, "service string, start timestamp, recent timestamp, up boolean")
    late = frame(spark, [("a", at(-86400 * 300 + 70))])
    got = rows(u.extend_uptime(stored, late, 30))
    assert got == sorted((s, a, at(-86400 * 300 + 70) if a == at(-86400 * 300) else b) for s, a, b, _ in year)


def test_no_range_join_is_planned(spark):
    plan = u.uptime_segments(intervals(spark, [(at(0), at(1), True)]), "day", DAY)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
