"""Operator 13: ranked lexical search, term at a time over short lists, document at a time over long ones.

One pass over the documents writes shards of an inverted index: for each term that a query holds, the documents of the shard
with it, how often, and how many terms those documents have. Corpus counts are sums over the shards.

A shard answers all queries. The lists of a query's rarer terms, LONG postings in sum at most, are added up term at a time into one
list of (document, sum), which from then on is an iterator like any other, bounded by its greatest sum. This list and the long ones are
then walked document at a time, in windows of WINDOW documents: a window whose summed bounds can't reach the kth score so far is skipped.
In the others the iterators stand by bound; the first ones, whose bounds together stay below the kth score, never
propose a document, but are only asked about those that the rest propose; a document is dropped once what is left can't lift it.
The kth scores pass from shard to shard within a task, and only documents that beat them leave it.

Queries are taken in blocks of TERMS terms (one query at least), so what is broadcast and held has a fixed size however many
there are. Scores are exact integers. Null texts have no terms and count nowhere; documents without terms are never found. Rows that
repeat a document are documents of their own; equal scores go by id, rows without an id last. A query without terms, or
whose terms no document holds, gives no rows. Each row of the queries is a query of its own, repeats and rows without an id included.
Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, slices

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(TERM)
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
# Terms of a block of queries; postings of a shard; postings summed term at a time; documents of a window.
TERMS = 50_000
SHARD = 1 << 18
LONG = 1 << 13
WINDOW = 1 << 10
_POSTINGS = "n_docs long, n_terms long, terms binary, sizes binary, docs binary, times binary, ids binary, lengths binary"


def terms_of(text: str | None) -> list[str]:
    """The terms of a text in order; only A-Z is lower-cased."""
    if not text:
        return []
    # Ascii letters fold the same way in lower(); other letters must stay as they are.
    return _TERM.findall(text.lower() if text.isascii() else text.translate(_LOWER))


def pack(values, kind) -> bytes:
    return np.asarray(values, kind).tobytes()


def postings(docs: DataFrame, vocabulary: dict[str, int], key: str, text: str, shard: int) -> DataFrame:
    """Shards of the index: postings of the vocabulary, ordered by term and document, and the documents they name.

    ``n_docs`` and ``n_terms`` count all documents with a term and all their terms; a shard takes rows until it has
    ``shard`` postings, so a task holds one shard and a slice of rows.
    """
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    names = ["n_docs", "n_terms", "terms", "sizes", "docs", "times", "ids", "lengths"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, lengths, terms, places, times, n_docs, n_terms = known.value, [], [], [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            t, p, f = np.array(terms, np.int32), np.array(places, np.int32), np.array(times, np.int32)
            order = np.lexsort((p, t))
            found, sizes = np.unique(t, return_counts=True)
            row = (n_docs, n_terms, pack(found, np.int32), pack(sizes, np.int32), p[order].tobytes(), f[order].tobytes(), pack(ids, np.int64), pack(lengths, np.int64))
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in slices(batches, 1):
            keys = pc.fill_null(batch.column(0), np.iinfo(np.int64).max).to_pylist()
            for own, value in zip(keys, batch.column(1), strict=True):
                found = terms_of(value.as_py())
                if not found:
                    continue
                n_docs += 1
                n_terms += len(found)
                held = [(number[w], c) for w, c in Counter(found).items() if w in number]
                if held:
                    t, c = zip(*held, strict=True)
                    terms += t
                    times += c
                    places += [len(ids)] * len(held)
                    ids.append(own)
                    lengths.append(len(found))
                if len(terms) >= shard:
                    yield flush()
                    ids, lengths, terms, places, times, n_docs, n_terms = [], [], [], [], [], 0, 0
        if n_docs:
            yield flush()

    return source.mapInArrow(run, _POSTINGS)


def counts(shards: DataFrame, vocabulary_size: int) -> tuple[int, int, np.ndarray]:
    """N, L and each term's df. The driver gets one row a term of a block at most."""
    n, total = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(vocabulary_size, np.int64)
        for batch in batches:
            for terms, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                df[np.frombuffer(terms, np.int32)] += np.frombuffer(sizes, np.int32)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], names=["term", "df"])

    found = shards.select("terms", "sizes").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(vocabulary_size, np.int64)
    df[found["term"].to_numpy()] = found["df"].to_numpy()
    return n, total, df


def weights_of(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Shard:
    """One shard's lists with impacts, and per list the greatest impact of each window."""

    def __init__(self, row: dict, n: int, total: int, weight: np.ndarray) -> None:
        self.ids = np.frombuffer(row["ids"], np.int64)
        lengths = np.frombuffer(row["lengths"], np.int64)
        terms, sizes = np.frombuffer(row["terms"], np.int32), np.frombuffer(row["sizes"], np.int32)
        self.docs, times = np.frombuffer(row["docs"], np.int32).astype(np.int64), np.frombuffer(row["times"], np.int32).astype(np.int64)
        m = 50 + (50 * lengths * n) // total
        self.impact = np.repeat(weight[terms], sizes) * ((1_000_000_000 * times) // (1000 * times + 20 * m[self.docs]))
        ends = np.cumsum(sizes)
        self.span = {t: (e - s, e) for t, s, e in zip(terms.tolist(), sizes.tolist(), ends.tolist(), strict=True)}
        self.windows = -(-len(self.ids) // WINDOW)
        self.peaks: dict[int, np.ndarray] = {}

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.span[term]
        return self.docs[a:b], self.impact[a:b]

    def peak(self, docs: np.ndarray, impact: np.ndarray) -> np.ndarray:
        top = np.zeros(self.windows, np.int64)
        np.maximum.at(top, docs // WINDOW, impact)
        return top

    def accumulated(self, terms: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Short lists added up term at a time: documents and their sums."""
        docs, impact = (np.concatenate(x) for x in zip(*(self.list_of(t) for t in terms), strict=True))
        found, place = np.unique(docs, return_inverse=True)
        sums = np.zeros(len(found), np.int64)
        np.add.at(sums, place, impact)
        return found, sums

    def search(self, terms: list[int], k: int, best: list[tuple[int, int]], long: int) -> list[tuple[int, int]]:
        """The k best of ``best`` (pairs of -score, id, in order) and this shard."""
        held = sorted((t for t in terms if t in self.span), key=lambda t: self.span[t][1] - self.span[t][0])
        sizes = np.cumsum([self.span[t][1] - self.span[t][0] for t in held])
        n_short = int(np.searchsorted(sizes, long, side="right"))
        lists = [(*self.list_of(t), t) for t in held[n_short:]]
        if n_short:
            lists.append((*self.accumulated(held[:n_short]), None))
        walks = []
        for docs, impact, term in lists:
            if term is None:
                top = self.peak(docs, impact)
            else:
                top = self.peaks.get(term)
                if top is None:
                    top = self.peaks[term] = self.peak(docs, impact)
            walks.append((int(impact.max()), docs, impact, top, np.searchsorted(docs, np.arange(self.windows + 1) * WINDOW)))
        if not walks:
            return best
        walks.sort(key=lambda w: w[0])
        bound = np.sum([w[3] for w in walks], axis=0)
        for window in np.flatnonzero(bound).tolist():
            least = -best[k - 1][0] if len(best) >= k else 1
            if bound[window] >= least:
                best = self.walk(walks, window, least, k, best)
        return best

    def walk(self, walks, window: int, least: int, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Documents of one window: proposed by the lists of high bound, looked up in the rest."""
        base = window * WINDOW
        ahead = np.cumsum([w[3][window] for w in walks])
        first = int(np.searchsorted(ahead, least))
        score = np.zeros(WINDOW, np.int64)
        for _, docs, impact, _, cut in walks[first:]:
            a, b = cut[window], cut[window + 1]
            score[docs[a:b] - base] += impact[a:b]
        here = np.flatnonzero(score)
        for at in range(first - 1, -1, -1):
            here = here[score[here] + ahead[at] >= least]
            if not len(here):
                return best
            _, docs, impact, _, cut = walks[at]
            a, b = cut[window], cut[window + 1]
            if a == b:
                continue
            place = np.minimum(a + np.searchsorted(docs[a:b], here + base), b - 1)
            score[here] += np.where(docs[place] == here + base, impact[place], 0)
        here = here[score[here] >= least]
        if not len(here):
            return best
        found = zip((-score[here]).tolist(), self.ids[base + here].tolist(), strict=True)
        return sorted([*best, *found])[:k]


def search(docs: DataFrame, queries: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", query_key: str = "item_id",
           query_text: str = "text", terms: int = TERMS, shard: int = SHARD, long: int = LONG) -> DataFrame:
    """(query key, rank, key, score): the k best documents of each query."""
    spark, out = docs.sparkSession, []
    for block in blocks(queries, query_key, query_text, terms):
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, held in block for w in held))}
        wanted = spark.sparkContext.broadcast([sorted({vocabulary[w] for w in held}) for _, held in block])
        shards = materialize(postings(docs, vocabulary, key, text, shard))
        n, total, df = counts(shards, len(vocabulary))
        weight = spark.sparkContext.broadcast(weights_of(n, df))

        def run(batches: Iterator[pa.RecordBatch], n=n, total=total, weight=weight, wanted=wanted) -> Iterator[pa.RecordBatch]:
            best: list[list[tuple[int, int]]] = [[] for _ in wanted.value]
            for batch in batches:
                for i in range(batch.num_rows):
                    part = Shard(batch.slice(i, 1).to_pylist()[0], n, total, weight.value)
                    best = [part.search(held, k, kept, long) for held, kept in zip(wanted.value, best, strict=True)]
            rows = [(q, -s, d) for q, kept in enumerate(best) for s, d in kept]
            arrays = [pa.array([r[c] for r in rows], pa.int64()) for c in range(3)]
            yield pa.RecordBatch.from_arrays(arrays, names=["query", "score", "found"])

        # Batches of shards are read one by one: a shard is one row.
        found = shards.select("terms", "sizes", "docs", "times", "ids", "lengths").mapInArrow(run, "query long, score long, found long")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "found")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ids = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(block)], "query long, item long")
        out.append(ranked.join(F.broadcast(ids), "query"))
    whole = spark.createDataFrame([], "item long, rank int, found long, score long")
    for found in out:
        whole = whole.unionByName(found.select("item", "rank", "found", "score"))
    missing = np.iinfo(np.int64).max
    return whole.select(
        F.col("item").alias(query_key), F.col("rank").cast("int").alias("rank"),
        F.nullif(F.col("found"), F.lit(missing)).alias(key), "score",
    )


def blocks(queries: DataFrame, key: str, text: str, size: int) -> Iterator[list[tuple[int | None, list[str]]]]:
    """Queries with their distinct terms, read to the driver in blocks of ``size`` terms, one query at least."""
    rows = queries.select(F.col(key).cast("long"), F.col(text)).orderBy(key, text).toLocalIterator()
    block, held = [], 0
    for own, value in rows:
        terms = list(dict.fromkeys(terms_of(value)))
        if not terms:
            continue
        if block and held + len(terms) > size:
            yield block
            block, held = [], 0
        block.append((own, terms))
        held += len(terms)
    if block:
        yield block
