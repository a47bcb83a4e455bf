"""Near copies in a sliding window, and title search by trigrams, against plain comparisons."""

import datetime as dt
import json
import os
import random

import numpy as np
import pytest

from tidemark.operators import near, titles
from tidemark.operators.predicates import title_like
from tidemark.session import with_rocksdb

BASE = dt.datetime(2024, 1, 1)
SCHEMA = "id long, timestamp timestamp, embedding array<double>"


def turned(rng, v, c):
    """A vector at cosine c to v."""
    w = rng.normal(size=len(v))
    w -= (w @ v) * v / (v @ v)
    return c * v / np.linalg.norm(v) + np.sqrt(1 - c * c) * w / np.linalg.norm(w)


def crowd(seed=1, n=150):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        v = rng.normal(size=24)
        out.append((v, rng.uniform(0, 50_000)))
        for _ in range(rng.integers(0, 4)):
            out.append((turned(rng, v, rng.choice([1.0, 0.99, 0.93, 0.88, 0.7])) * rng.uniform(0.1, 9), out[-1][1] + rng.choice([-2000, 0, 500, 3600, 3601, 9000])))
    return [(i, BASE + dt.timedelta(seconds=int(s)), [float(x) for x in v]) for i, (v, s) in enumerate(out)]


def by_hand(rows, window, threshold):
    out = set()
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    for i, t, _ in rows:
        for j, s, _ in rows:
            if dt.timedelta(0) <= t - s <= dt.timedelta(seconds=window) and (s, j) < (t, i) and unit[i] @ unit[j] >= threshold:
                out.add(i)
    return out


def test_near_copies_against_all_pairs(spark):
    rows = crowd()
    odd = [(9001, BASE, None), (9002, BASE, []), (9003, BASE, [0.0] * 24), (9004, BASE, [float("nan")] * 24), (9005, BASE, [None] * 24), (9006, BASE, [1.0, 2.0]), (9007, BASE, [1e200] * 24)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    got = {r.id for r in near.near_copies(df, 3600).collect()}
    expected = by_hand(rows, 3600, 0.9)
    # Nothing wrong is found, and what is missed is within the recall worked out.
    assert got <= expected and len(expected) > 50
    assert len(got) >= 0.99 * len(expected)
    kept = {r.id for r in near.without_near_copies(df, 3600).collect()}
    assert kept == {r[0] for r in rows + odd} - got
    with pytest.raises(ValueError):
        near.near_copies(df, 0)


def test_measured_recall(spark):
    """Pairs right at a cosine meet as often as worked out, 0.99 of them at 0.9."""
    rng = np.random.default_rng(5)
    for c in (0.9, 0.8):
        rows = []
        for i in range(400):
            v = rng.normal(size=32)
            rows += [(2 * i, BASE + dt.timedelta(days=i), v.tolist()), (2 * i + 1, BASE + dt.timedelta(days=i, seconds=5), (turned(rng, v, c + 1e-9)).tolist())]
        got = near.near_copies(spark.createDataFrame(rows, SCHEMA), 60, c).select("id").distinct().count()
        assert abs(got / 400 - near.recall(c)) < 0.05
    assert near.recall(0.9) > 0.99 and near.recall(0.95) > 0.9999 and near.recall(0.9, 4, 16) < 0.9


def test_a_crowd_of_copies(spark):
    """Each copy is done with its first match."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=16)
    rows = [(i, BASE + dt.timedelta(seconds=i % 50), (v * (1 + i % 3)).tolist()) for i in range(1500)]
    found = near.near_copies(spark.createDataFrame(rows, SCHEMA), 100, 0.99).select("id").distinct()
    assert found.count() == 1499
    assert "LeftSemi" in found._jdf.queryExecution().executedPlan().toString()


def test_rounding_changes_no_result(spark):
    """Cosines at, just below and just above the threshold, odd lengths and rows: as by whole vectors."""
    rng, rows = np.random.default_rng(9), []
    for i in range(240):
        v, at = rng.normal(size=24) * (np.eye(24)[0] * 9 + 1 if i % 5 == 0 else 1), BASE + dt.timedelta(hours=i // 8)
        rows.append((2 * i, at, v.tolist()))
        rows.append((2 * i + 1, at + dt.timedelta(seconds=i), (turned(rng, v, 0.9 + rng.choice([0, 1e-15, -1e-15, 1e-9, -1e-9, 1e-4, -1e-4, 0.02, -0.02, 0.1, -0.1])) * rng.choice([1, 1e-9, 1e9])).tolist()))
    later = BASE + dt.timedelta(days=30)
    # Squares of these are cut to a few steps, so that they are longer than one when divided by their length.
    rows += [(1000 + i, later, [(1 + i / 7) * 1.2e-162] * 20 + [3e-162] * 4) for i in range(8)]
    # No id, no time, an id that comes again with another vector, another number of components.
    rows += [(None, later, rows[0][2]), (None, later + dt.timedelta(seconds=9), rows[0][2]), (2000, None, rows[0][2]), (2001, None, rows[0][2])]
    rows += [(3000, later, rows[2][2]), (3000, later, rows[4][2]), (3001, later, rows[4][2]), (3000, later + dt.timedelta(seconds=5), rows[4][2]), (3002, later, rows[4][2][:20])]
    articles = spark.createDataFrame(rows, SCHEMA)
    expected = {tuple(r) for r in near._exactly(near._units(articles), 3600, 0.9, near._keys(near.BANDS, near.BITS, 7)("v")).collect()}
    got = [tuple(r) for r in near.near_copies(articles, 3600).collect()]
    assert set(got) == expected and len(got) == len(expected) > 100
    assert (None, later + dt.timedelta(seconds=9)) in expected and (3001, later) in expected and max(r[0] for r in expected if r[0] and r[0] < 1900) > 1000


def exchanged(plan, seen):
    """Bytes of each exchange that has run."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return exchanged(plan.executedPlan(), seen)
    if name.endswith("QueryStageExec"):
        return exchanged(plan.plan(), seen)
    if name == "ShuffleExchangeExec":
        seen[plan.id()] = plan.metrics().apply("dataSize").value()
    for i in range(plan.children().size()):
        exchanged(plan.children().apply(i), seen)
    return seen


def test_whole_vectors_are_not_sent_by_band(spark):
    rng = np.random.default_rng(10)
    rows = [(i, BASE + dt.timedelta(minutes=i), rng.normal(size=64).tolist()) for i in range(600)]
    rows += [(1000 + i, t + dt.timedelta(minutes=5), (np.array(v) * 2).tolist()) for i, t, v in rows[::8]]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        copies = near.near_copies(spark.createDataFrame(rows, SCHEMA), 3600)
        assert {r.id for r in copies.collect()} == {r[0] for r in rows[600:]}
        sent = sum(exchanged(copies._jdf.queryExecution().executedPlan(), {}).values())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Vectors of 64 doubles, once as the later and twice as the earlier in each band, would be 30,720 bytes an article.
    assert 2000 < sent / len(rows) < 0.4 * 3 * near.BANDS * 64 * 8


def test_state_of_a_stream_expires(spark, tmp_path):
    rows = sorted(crowd(2, 60), key=lambda r: r[1])
    parts = [rows[i : i + 30] for i in range(0, len(rows), 30)]
    (tmp_path / "in").mkdir()
    for n, part in enumerate(parts):
        file = tmp_path / "in" / f"{n}.json"
        file.write_text("\n".join(json.dumps({"id": i, "timestamp": t.isoformat() + "Z", "embedding": v}) for i, t, v in part))
        os.utime(file, (1_700_000_000 + n, 1_700_000_000 + n))
    with_rocksdb(spark)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withWatermark("timestamp", "1 second")
    query = (
        near.near_copies(stream, 3600).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    expected = by_hand(rows, 3600, 0.9)
    assert got <= expected and len(got) >= 0.98 * len(expected) > 5
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    # A row a band of an article now, two as an earlier one: never those of all articles.
    assert max(held) < len(rows) * 3 * near.BANDS / 2


def test_titles_against_a_scan(spark):
    rng = random.Random(2)
    words = ["Über", "storm", "STORM", "a%b", "x_y", "漢字かな", "İstanbul", "100", "C:\\d", "the", "of ", "-", "ß", "straße"]
    rows = [(str(i), None if i % 97 == 0 else " ".join(rng.choices(words, k=rng.randrange(5)))) for i in range(600)]
    articles = spark.createDataFrame(rows, "id string, title string").cache()
    index = titles.trigram_index(articles).cache()
    needles = ["storm", "STORM the", "orm s", "st%rm", "s_orm", "Über", "über storm", "漢字", "100", "100 c:", "of  of", "İstanbul", "a\\%b", "x\\_y", "ß storm", "th", "%", "", "zzz", "raße", "\\\\d the"]
    for needle in needles:
        plain = articles.filter(title_like("title", needle)) if needle else articles
        expected = sorted(r.id for r in plain.collect())
        assert sorted(r.id for r in titles.titled(articles, needle, index).collect()) == expected, needle
        assert sorted(r.id for r in titles.titled(articles, needle).collect()) == expected, needle


def test_which_needles_use_the_index(spark):
    assert titles.needle_grams("Storm") == ["sto", "tor", "orm"]
    assert titles.needle_grams("ab%cde_f") == ["cde"]
    assert titles.needle_grams("a\\%bc") == ["a%b", "%bc"]
    assert titles.needle_grams("ab") == titles.needle_grams("a_b%") == titles.needle_grams("漢字かな") == []
    index = spark.createDataFrame([], "gram string, article_id string")
    assert titles.candidates(index, "ab") is None and titles.candidates(index, "abc").isEmpty()


def test_the_index_prunes(spark, tmp_path):
    """A search asks the scan for its trigrams, and ilike runs on candidates alone."""
    articles = spark.createDataFrame([(str(i), f"title {i}") for i in range(100)], "id string, title string")
    titles.trigram_index(articles).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    plan = titles.titled(articles, "title 7", index)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan and "LeftSemi" in plan
