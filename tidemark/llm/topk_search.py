"""Operator 6: exact top-k inner products by ball trees, one a shard, that share the kth score.

Vectors become integers, floor(scale * x). Each shard of candidates is a ball tree; a node's
upper bound for a query q is q.c + |q| r. A first round looks only into each shard's best leaf; the
k-th best score over all shards is then shared, and a second round searches each tree in order
of bounds, leaving out nodes whose bound is below that score. Nothing that could be
among the first k is left out, so the result is exact.

Queries and shards meet in blocks: a task has one shard and one block of queries. Null vectors
and those with null or non-finite components take no part; vectors of another length than the
query's are no candidates for it. Ties go to the smaller id. A query is never its own candidate; repeated
rows with its id aren't either. Null ids take no part. Empty tables give empty results.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize
from tidemark.llm.embedding_dedup import usable

K = 10
SCALE = 1024
SHARD = 8192
QUERIES = 512
LEAF = 64


def ball_tree(x: np.ndarray, leaf: int = LEAF) -> dict:
    """Nodes split at the median along the widest direction of spread; rows in leaf order."""
    order = np.arange(len(x))
    first, last, child, centre, radius = [], [], [], [], []

    def build(a: int, b: int) -> int:
        here = len(first)
        rows = x[order[a:b]]
        c = rows.mean(0)
        first.append(a)
        last.append(b)
        child.append((-1, -1))
        centre.append(c)
        radius.append(float(np.sqrt(((rows - c) ** 2).sum(1).max())))
        if b - a > leaf and radius[here] > 0:
            far = rows[((rows - c) ** 2).sum(1).argmax()]
            other = rows[((rows - far) ** 2).sum(1).argmax()]
            middle = (b - a) // 2
            along = np.argpartition(rows @ (other - far), middle)
            order[a:b] = order[a:b][along]
            child[here] = (build(a, a + middle), build(a + middle, b))
        return here

    build(0, len(x))
    return {"order": order, "first": np.array(first), "last": np.array(last), "child": np.array(child), "centre": np.array(centre), "radius": np.array(radius)}


def bounds(tree: dict, q: np.ndarray) -> np.ndarray:
    """Upper bounds of inner products: queries by nodes. A little above, for rounding."""
    size = np.sqrt((q * q).sum(1, keepdims=True))
    b = q @ tree["centre"].T + size * tree["radius"]
    return b + 1e-9 * (np.abs(b) + 1) + 1e-6


def _top(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    keep = ids != own
    scores, ids = scores[keep], ids[keep]
    best = np.lexsort((ids, -scores))[:k]
    return scores[best], ids[best]


def search(tree: dict, x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, known: np.ndarray, k: int, best_leaf: bool) -> list[tuple[int, int, int]]:
    """(query position, id, score): what of this tree may be among the first k.

    ``known`` holds a score per query that k candidates are known to reach.
    """
    bound, leaves = bounds(tree, q), np.flatnonzero(tree["child"][:, 0] < 0)
    out = []
    if best_leaf:
        chosen = leaves[bound[:, leaves].argmax(1)]
        for n in np.unique(chosen):
            where = np.flatnonzero(chosen == n)
            rows = tree["order"][tree["first"][n] : tree["last"][n]]
            scores = q[where] @ x[rows].T
            for w, s in zip(where, scores, strict=True):
                top, who = _top(s, ids[rows], own[w], k)
                out += zip([int(w)] * len(top), who.tolist(), top.astype(np.int64).tolist(), strict=True)
        return out
    for w in range(len(q)):
        limit, have_s, have_i = known[w], np.zeros(0), np.zeros(0, np.int64)
        # Descend only where the bound reaches the score; leaves then in order of their bounds.
        stack, open_leaves = [0], []
        while stack:
            n = stack.pop()
            if bound[w, n] < limit:
                continue
            a, b = tree["child"][n]
            if a < 0:
                open_leaves.append(n)
            else:
                stack += [a, b]
        for n in sorted(open_leaves, key=lambda n: -bound[w, n]):
            if bound[w, n] < limit:
                break
            rows = tree["order"][tree["first"][n] : tree["last"][n]]
            have_s, have_i = _top(np.concatenate((have_s, q[w] @ x[rows].T)), np.concatenate((have_i, ids[rows])), own[w], k)
            if len(have_s) == k:
                limit = max(limit, have_s[-1])
        out += [(w, i, int(s)) for s, i in zip(have_s.tolist(), have_i.tolist(), strict=True) if s >= known[w]]
    return out


def top_k(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE, shard: int = SHARD, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query among all rows."""
    whole = F.transform(vector, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("double"))
    rows = vectors.where(usable(vector) & F.col(key).isNotNull())
    rows = materialize(rows.select(F.col(key).alias("id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).withColumn("dim", F.size("v")))
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asks").cast("int")).alias("q"))
    sizes = sizes.select("dim", F.ceil(F.col("n") / shard).cast("int").alias("shards"), F.ceil(F.col("q") / queries).cast("int").alias("blocks"))
    # One row for each length of vectors.
    sizes = materialize(sizes.where("blocks > 0"))
    here = F.pmod(F.xxhash64("id"), F.col("shards")).cast("int").alias("shard")
    candidates = rows.join(F.broadcast(sizes), "dim").select("dim", here, "id", "v", "blocks")

    def plant(frame: pd.DataFrame) -> pd.DataFrame:
        x, ids = np.stack(frame["v"]), frame["id"].to_numpy(np.int64)
        tree = pickle.dumps((ball_tree(x), x, ids), protocol=5)
        return pd.DataFrame({"dim": frame["dim"].iloc[:1].to_numpy(), "shard": frame["shard"].iloc[:1].to_numpy(), "blocks": frame["blocks"].iloc[:1].to_numpy(), "tree": [tree]})

    # The index: a row per shard, of bounded size.
    trees = materialize(candidates.groupBy("dim", "shard").applyInPandas(plant, "dim int, shard int, blocks int, tree binary"))
    asked = rows.where("asks").join(F.broadcast(sizes), "dim")
    asked = asked.select("dim", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.col("id").alias("query"), "v", "shards").distinct()

    def meet(asking: DataFrame, best_leaf: bool) -> DataFrame:
        each = asking.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
        index = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

        def run(questions: pd.DataFrame, planted: pd.DataFrame) -> pd.DataFrame:
            if not len(questions) or not len(planted):
                return pd.DataFrame({"query": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
            tree, x, ids = pickle.loads(planted["tree"].iloc[0])
            own = questions["query"].to_numpy(np.int64)
            known = questions["known"].to_numpy(float)
            hits = search(tree, x, ids, np.stack(questions["v"]), own, known, k, best_leaf)
            return pd.DataFrame({"query": own[[h[0] for h in hits]], "id": [h[1] for h in hits], "score": [h[2] for h in hits]}).astype("int64")

        keys = ["dim", "block", "shard"]
        return each.groupBy(keys).cogroup(index.groupBy(keys)).applyInPandas(run, "query long, id long, score long")

    def ranked(hits: DataFrame) -> DataFrame:
        best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
        # A repeated row is one candidate for each of its rows.
        return hits.withColumn("rank", best).where(F.col("rank") <= k)

    first = ranked(meet(asked.withColumn("known", F.lit(float("-inf"))), True)).where(F.col("rank") == k)
    shared = asked.join(first.select("query", F.col("score").cast("double").alias("known")), "query", "left").fillna(float("-inf"), ["known"])
    return ranked(meet(shared, False)).select(F.col("query").alias("query_id"), F.col("rank").cast("int"), F.col("id").alias(key), "score")

