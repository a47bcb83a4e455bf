"""The quality classifier: held-out accuracy, its algebra against plain numpy, and awkward rows."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality
from tidemark.llm.queries import QUERIES


def test_held_out(spark):
    folder = "/root/testdata/sf0.01"
    label = dict(duckdb.execute(f"SELECT doc_id, quality FROM '{folder}/labels.parquet' WHERE quality IS NOT NULL").fetchall())
    rows = QUERIES["op12_quality"](spark, folder).collect()
    n_docs = duckdb.execute(f"SELECT count(*) FROM '{folder}/documents.parquet'").fetchall()[0][0]
    assert len(rows) == n_docs and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in label]
    for kind in (0, 1):
        own = [r.predicted == kind for r in held if label[r.doc_id] == kind]
        assert own and sum(own) >= 0.9 * len(own)


def test_algebra(spark):
    """Sums over tasks give the ridge of one matrix, fold by fold, and its calibrated scores."""
    rng = np.random.default_rng(4)
    n, d = 300, len(quality.STATISTICS)
    x = rng.normal(size=(n, d)) * rng.uniform(0.5, 3, d) + rng.normal(size=d)
    x[:, 3] = 7.0
    y = (x[:, 0] + x[:, 1] ** 2 / 4 + rng.normal(size=n) * 0.3 > 0.5).astype(int)
    measured = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, __stats array<double>").repartition(5)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    model = quality.fit(measured, labels)
    scale = np.where(x.std(0) > 1e-9, x.std(0), 1)
    made = quality.Waves(x.mean(0), scale)
    z = made(x)
    weights = quality.fit_ridge(z.T @ z, z.T @ y, n)
    assert np.allclose(model.weights, weights, atol=1e-7)
    folds = {r.id: r.f for r in spark.range(n).select("id", F.pmod(F.xxhash64("id", F.lit(12)), F.lit(quality.FOLDS)).alias("f")).collect()}
    fold = np.array([folds[i] for i in range(n)])
    raw = np.zeros(n)
    for k in range(quality.FOLDS):
        a, b = z[fold != k], y[fold != k]
        raw[fold == k] = z[fold == k] @ quality.fit_ridge(a.T @ a, a.T @ b, len(b))
    at = quality.bin_of(raw)
    steps = quality.pooled(np.bincount(at, minlength=quality.BINS), np.bincount(at, y, quality.BINS))
    assert np.allclose(model.steps, steps) and (np.diff(model.steps) >= -1e-12).all()
    found = dict(quality.apply(measured, model).select("doc_id", "score").collect())
    assert np.allclose([found[i] for i in range(n)], quality.calibrated(z @ weights, steps))
    # The waves approximate the kernel.
    wide = quality.Waves(x.mean(0), scale, 4000)(x[:40])[:, :-1]
    t = np.clip((x[:40] - x.mean(0)) / scale, -8, 8)
    kernel = np.exp(-((t[:, None] - t[None]) ** 2).sum(2) / (2 * quality.WIDTH**2 * d))
    assert np.abs(wide @ wide.T - kernel).max() < 0.1


def test_pooled():
    """Isotonic: the means of the greatest lower sets, as the minimax formula gives them."""
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = rng.integers(1, 9, 12)
        ones = rng.integers(0, n + 1)
        mean = lambda a, b: ones[a : b + 1].sum() / n[a : b + 1].sum()  # noqa: B023, E731
        wanted = [max(min(mean(a, b) for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
        assert np.allclose(quality.pooled(n, ones), wanted)
    assert quality.pooled(np.array([0, 0, 2, 0, 2, 0]), np.array([0, 0, 1, 0, 2, 0])).tolist() == [0, 0, 0.5, 0.5, 1, 1]


def test_statistics():
    found = dict(zip(quality.STATISTICS, quality.statistics("A a a\n\nb | C! É.".encode()), strict=True))
    assert found["distinct_words"] == pytest.approx(6 / 7) and found["repeats_next"] == pytest.approx(1 / 7)
    assert found["ends_in_point"] == 1 and found["bars"] == pytest.approx(1 / 17) and found["beyond_ascii"] == pytest.approx(2 / 17)
    assert not any(quality.statistics(b"")) and np.isfinite(quality.statistics(b" \n")).all()


def test_awkward(spark):
    data = [(1, None, 1.5), (2, "", 1.5), (2, "", 1.5), (3, " \n", 0.0), (None, "no id here.", 2.0), (5, "zz " * 90_000, 3.0), (6, "Good words stand here.", 1.0), (6, "Others of this id.", 1.0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, score double").withColumn("y", F.lit(3))
    labels = spark.createDataFrame([(1, 0), (2, 0), (2, 1), (5, 0), (6, 1), (6, 1), (None, 1), (3, None)], "doc_id long, quality int")
    found = quality.score(docs, labels)
    assert set(found.columns) == {"doc_id", "text", "score", "y", "predicted"}
    assert len(rows := found.collect()) == len(data) and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(docs.limit(0), labels).count() == 0
    for none, share in ((labels.limit(0), 0.0), (labels.where("doc_id = 6"), 1.0)):
        assert {r.score for r in quality.score(docs, none).collect()} == {share}
