"""Near-duplicate embeddings: components by brute force, what is sent and written, and links at the threshold."""

import numpy as np
import pytest

from tidemark.llm import common, embedding_dedup


def by_brute_force(x, threshold=0.9):
    """(links, smallest linked row) of every row."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= threshold
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(x)).min(1))
        if (new == label).all():
            return linked.sum(1) - 1, label
        label = new


def frame(spark, x, kind="float"):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], f"vec_id long, embedding array<{kind}>")


def clouds(rng, clouds, each, dim, noise):
    x = rng.normal(size=(clouds, dim)).repeat(each, 0) + rng.normal(size=(clouds * each, dim)) * noise
    return rng.permutation(x).astype(np.float32)


@pytest.mark.parametrize(("kind", "noise", "cells", "block"), [("float", 0.1, 256, 1024), ("float", 0.3, 24, 16), ("double", 0.33, 8, 64)])
def test_components(spark, kind, noise, cells, block):
    """Links lead to the smallest id, also where a component lies in several cells, shelves and blocks."""
    x = clouds(np.random.default_rng(1), 60, 10, 16, noise)
    links, least = by_brute_force(x.astype(float))
    found = embedding_dedup.near_duplicates(frame(spark, x, kind), cells=cells, block=block).orderBy("vec_id").collect()
    assert [tuple(r) for r in found] == [(i, n, c, c == i) for i, (n, c) in enumerate(zip(links.tolist(), least.tolist(), strict=True))]
    assert 60 <= len(set(least.tolist())) < 600


def test_crowd(spark):
    """A cell with most of all rows is cut up between shelves, and is one component still."""
    rng = np.random.default_rng(2)
    x = np.concatenate((clouds(rng, 1, 500, 64, 0.05), rng.normal(size=(200, 64)))).astype(np.float32)
    found = embedding_dedup.near_duplicates(frame(spark, x), block=32).orderBy("vec_id").collect()
    assert {(r.n_links, r.component_id) for r in found[:500]} == {(499, 0)}
    assert all((r.n_links, r.component_id) == (0, r.vec_id) for r in found[500:])


def test_sent_and_written_in_proportion(spark, tmp_path, monkeypatch):
    """Even vectors, which are near the borders of many cells, are sent for each shelf and not for each cell, and written a few times."""
    sent, place = [], embedding_dedup.placements

    def placements(*a):
        sent.append(place(*a))
        return sent[0]

    monkeypatch.setattr(embedding_dedup, "placements", placements)
    monkeypatch.setattr(common, "_own_folder", [str(tmp_path)])
    x = np.random.default_rng(3).normal(size=(4096, 64)).astype(np.float32)
    assert embedding_dedup.near_duplicates(frame(spark, x), cells=64, block=64).where("kept").count() == 4096
    assert sent[0].count() <= 8 * len(x)
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 4 * x.nbytes


def test_threshold(spark):
    """What single precision cannot tell from the threshold is compared in double."""
    rng = np.random.default_rng(4)
    angle = np.arccos(0.9) + np.tile([-1e-9, 1e-9], 40)
    plane = np.linalg.qr(rng.normal(size=(80, 32, 2)))[0]
    a, b = plane[:, :, 0], plane[:, :, 0] * np.cos(angle)[:, None] + plane[:, :, 1] * np.sin(angle)[:, None]
    x = np.stack((a, b), 1).reshape(160, 32)
    found = embedding_dedup.near_duplicates(frame(spark, x, "double"), cells=8, block=16).orderBy("vec_id").collect()
    assert [r.n_links for r in found] == [1, 1, 0, 0] * 40


@pytest.mark.parametrize("kind", ["int", "float", "decimal(9,3)"])
def test_lengths(spark, kind):
    """Each length by itself, down to one component, whatever the numbers are."""
    rng = np.random.default_rng(6)
    made = [rng.integers(-9, 10, 1 + k % 5) for k in range(400)]
    df = spark.createDataFrame([(i, r.astype(float).tolist()) for i, r in enumerate(made)], "vec_id long, embedding array<double>")
    df = df.select("vec_id", df.embedding.cast(f"array<{kind}>").alias("embedding"))
    found = {r.vec_id: tuple(r)[1:] for r in embedding_dedup.near_duplicates(df, cells=4, block=8).collect()}
    for size in range(1, 6):
        ids = [i for i, r in enumerate(made) if len(r) == size and r.any()]
        links, least = by_brute_force(np.array([made[i] for i in ids], float), 0.9)
        assert [found[i] for i in ids] == [(n, ids[c], ids[c] == i) for i, n, c in zip(ids, links.tolist(), least.tolist(), strict=True)]
    assert all(found[i] == (0, i, True) for i, r in enumerate(made) if not r.any())


def test_forest():
    rng = np.random.default_rng(5)
    for n, links in ((1, 0), (50, 30), (200, 150), (200, 2000)):
        a, b = rng.integers(0, n, (2, links))
        label = np.arange(n)
        edges = np.concatenate([np.zeros((2, 0), int), *embedding_dedup._join_up(label, a[: links // 2], b[: links // 2])], 1)
        more = np.concatenate([np.zeros((2, 0), int), *embedding_dedup._join_up(label, a[links // 2 :], b[links // 2 :])], 1)
        edges = np.concatenate((edges, more), 1)
        linked = np.eye(n, dtype=bool)
        linked[a, b] = linked[b, a] = True
        for _ in range(n):
            linked |= linked @ linked
        assert (label == linked.argmax(1)).all() and len(edges[0]) == n - len(set(label.tolist()))
        assert set(zip(*edges.tolist(), strict=True)) <= set(zip(a.tolist(), b.tolist(), strict=True))
