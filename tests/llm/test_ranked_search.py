"""Ranked search against its SQL and against a plain sum over all documents."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ranked_search
from tidemark.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


def terms(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, k=50):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_all, l_all = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counted:
            m = 100 - 50 + (50 * sum(c.values()) * n_all) // l_all
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if w in c)
            found.append((-score, d is None, d))
        best = sorted((f for f in found if f[0] < 0), key=lambda f: (f[0], f[1], f[2] or 0))[:k]
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(best)]
    return sorted(out, key=str)


def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES["op13_ranked_search"](spark, FOLDER)
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({SQL['op13_ranked_search']})").fetchall())


@pytest.mark.parametrize("sizes", [{}, {"shard": 400, "long": 30, "terms": 20}, {"shard": 10**6, "long": 0}, {"shard": 10**6, "long": 10**9}])
def test_walks(spark, monkeypatch, sizes):
    """Lists summed up, walked or both; many shards, windows and blocks of queries; common and rare words; ties."""
    monkeypatch.setattr(ranked_search, "WINDOW", 64)
    rng = np.random.default_rng(8)
    words = np.array([f"w{i}" for i in range(200)] + ["Été", "漢字", "x1"])
    share = 1 / np.arange(1, len(words) + 1)
    pick = lambda n: " ".join(rng.choice(words, n, p=share / share.sum()))
    docs = [(i, pick(rng.integers(1, 40))) for i in range(600)]
    docs += [(600 + i, docs[7][1]) for i in range(80)] + [(5, docs[5][1])]
    items = [(i, pick(rng.integers(1, 25)).upper()) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = ranked_search.search(df, spark.createDataFrame(items, "item_id long, text string"), **sizes)
    assert sorted(map(tuple, found.collect()), key=str) == by_hand(docs, items)


def test_skips(spark, monkeypatch):
    """Windows that can't reach the kth score are not walked."""
    walked = []
    plain = ranked_search.Shard.walk
    monkeypatch.setattr(ranked_search, "WINDOW", 16)
    monkeypatch.setattr(ranked_search.Shard, "walk", lambda self, walks, window, *rest: walked.append(window) or plain(self, walks, window, *rest))
    n = 1600
    row = {"ids": np.arange(n).tobytes(), "lengths": np.full(n, 10).tobytes(), "terms": np.array([0, 1], np.int32).tobytes(), "sizes": np.array([n, 20], np.int32).tobytes()}
    row |= {"docs": np.concatenate((np.arange(n), np.arange(20))).astype(np.int32).tobytes(), "times": np.ones(n + 20, np.int32).tobytes()}
    best = ranked_search.Shard(row, n, 10 * n, np.array([3, 900])).search([0, 1], 10, [], 30)
    assert [d for _, d in best] == list(range(10)) and len(walked) < 5


def test_awkward(spark):
    docs = [(1, None), (2, ""), (3, " \t- "), (4, "one"), (4, "one"), (None, "one two"), (7, "zz " * 60_000), (8, "ONE É")]
    items = [(1, "one"), (1, "one"), (None, "É zz"), (2, None), (3, "nowhere"), (4, "!")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("x")).withColumn("query", F.lit(1))
    queries = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1))
    assert sorted(map(tuple, ranked_search.search(df, queries).collect()), key=str) == by_hand(docs, items)
    for a, b in ((df.limit(0), queries), (df, queries.limit(0))):
        assert ranked_search.search(a, b).count() == 0
