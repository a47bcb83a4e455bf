"""Operator 3: near-duplicate embeddings by spherical k-means cells and blocked products.

Vectors equal in value are first grouped to one. Centres are fitted on a bounded sample; every
vector lives in the cell of the centre with the largest cosine. Cells lie on shelves of bounded size, a large cell
on several, and each pair of shelves is one task. So a vector is sent once for each shelf: SPREAD times, or
as often as there are shelves of SHELF_BYTES, where that is more, whatever the number of cells.

Two vectors with cosine t lie sqrt(2 - 2 t) apart, and the plane between two centres separates
their cells; so the distances of a linked pair from that plane add up to that at most. Vectors too far from the planes to
all cells of a shelf are not sent to it, and within a task such pairs of blocks are not multiplied. Products of others are
first taken along the widest directions, where a cosine is at most that of the parts along them plus the product of
what is left of both lengths, and in full where that reaches the threshold. What single precision cannot tell is settled in double. No linked pair is lost,
whatever the centres and directions are. A task returns counts, and a spanning forest of its links instead of the links.

Null, zero and non-finite vectors, and those with null components, link with nothing and
keep themselves. Vectors of different lengths are compared within each length only. Repeated
rows link with each other like different vectors of one value; rows with a null id are compared too, but
component ids are the smallest id there is. An empty table gives an empty result. Extra columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement, product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, materialize

THRESHOLD = 0.9
SAMPLE = 20_000
BLOCK = 1024
CELLS = 256
# Shelves there are at least, if they have a block each, so that tasks are many; bytes of a shelf's vectors in single precision.
SPREAD = 8
SHELF_BYTES = 32 << 20
_SLACK = 1e-9
# Links that are looked at together.
_HITS = 1 << 18


def usable(vector: str):
    """No null, no non-finite component."""
    x = F.col(vector)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return x.isNotNull() & F.coalesce(fine, F.lit(False)) & (F.size(x) > 0)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one, as doubles."""
    x = x.astype(float, copy=False)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centres(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        home = (sample @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, home, sample)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(size > 0, total / np.maximum(size, 1e-300), c)
    return np.unique(c, axis=0)


def widest(sample: np.ndarray) -> np.ndarray:
    """Orthogonal directions, as columns, along which unit vectors have most of their lengths: three for eight components."""
    some = sample[:1024]
    return np.linalg.svd(some, full_matrices=False)[2][: -(-3 * some.shape[1] // 8)].T


class Shelves(NamedTuple):
    """Where vectors of one length lie. A cell's residents are cut into pieces by key, and pieces lie on shelves."""

    centre: np.ndarray
    axes: np.ndarray
    parts: np.ndarray  # pieces of each cell
    first: np.ndarray  # each cell's first piece
    shelf: np.ndarray  # of each piece
    pair: np.ndarray  # number of the task of two shelves

    def gaps(self) -> np.ndarray:
        """Distances between centres; beyond bounds for two that are too close to tell sides."""
        gaps = np.sqrt(np.maximum(2 - 2 * self.centre @ self.centre.T, 0))
        return np.where(gaps > 1e-5, gaps, np.inf)


def shelved(centre: np.ndarray, axes: np.ndarray, residents: np.ndarray, shelves: int, number: int) -> Shelves:
    """Deal cells with so many residents to shelves of about one size; tasks are numbered from ``number``."""
    most = max(1, -(-int(residents.sum()) // shelves))
    parts = np.maximum(1, -(-residents // max(1, most // 4)))
    first = np.cumsum(parts) - parts
    each = np.repeat(residents / parts, parts)
    shelf = np.minimum((np.cumsum(each) - each / 2) // most, shelves - 1).astype(int)
    pair = np.zeros((shelves, shelves), int)
    low, high = np.triu_indices(shelves)
    pair[low, high] = pair[high, low] = number + np.arange(len(low))
    return Shelves(centre, axes, parts, first, shelf, pair)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches cut by the length of their vectors."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            yield int(dim), batch.filter(pa.array(dims == dim))


def homes(distinct: DataFrame, fitted: dict[int, np.ndarray]) -> DataFrame:
    """(dim, cell) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part in _lengths(batches):
            home = (unit(matrix(part.column("vector"))) @ fitted[dim].T).argmax(1)
            yield pa.RecordBatch.from_arrays([part.column("dim"), pa.array(home.astype(np.int32))], names=["dim", "cell"])

    return distinct.select("dim", "vector").mapInArrow(run, "dim int, cell int")


def placements(distinct: DataFrame, dealt: dict[int, Shelves], threshold: float) -> DataFrame:
    """A row for each task that a vector takes part in: (pair, shelf, cell, key, copies, vector), with its own shelf and cell."""
    reach = np.sqrt(2 - 2 * threshold) + _SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {}
        for dim, part in _lengths(batches):
            at = dealt[dim]
            if dim not in made:
                holds = np.zeros((len(at.centre), len(at.pair)), np.float32)
                holds[np.repeat(np.arange(len(at.parts)), at.parts), at.shelf] = 1
                made[dim] = at.gaps(), holds
            gaps, holds = made[dim]
            near = unit(matrix(part.column("vector"))) @ at.centre.T
            every, home = np.arange(len(near)), near.argmax(1)
            own = at.shelf[at.first[home] + part.column("key").to_numpy() % at.parts[home]]
            goes = (near[every, home][:, None] - near) / gaps[home] <= reach
            meets = goes.astype(np.float32) @ holds > 0
            meets[every, own] = True
            row, other = np.nonzero(meets)
            taken = part.select(["key", "copies", "vector"]).take(pa.array(row))
            more = [pa.array(x[row].astype(np.int32)) for x in (own, home)]
            yield pa.RecordBatch.from_arrays([pa.array(at.pair[own[row], other].astype(np.int32)), *more, *taken.columns], names=["pair", "shelf", "cell", "key", "copies", "vector"])

    kind = dict(distinct.dtypes)["vector"]
    return distinct.select("dim", "key", "copies", "vector").mapInArrow(run, f"pair int, shelf int, cell int, key long, copies long, vector {kind}")


def _join_up(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Those of the links (a, b) that join what ``label`` holds apart, without circles; ``label`` is brought up to date."""
    out = []
    while True:
        low, high = np.sort((label[a], label[b]), axis=0)
        apart = np.flatnonzero(low != high)
        if not len(apart):
            return out
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        order = np.lexsort((low, high))
        order = order[np.diff(high[order], prepend=-1) > 0]
        out.append(np.stack((a[order], b[order])))
        up = np.arange(len(label))
        up[high[order]] = low[order]
        while (up[up] != up).any():
            up = up[up]
        label[:] = up[label]


def _exactly(x: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether rows i and j of whole vectors link, in double precision."""
    out = np.zeros(len(i), bool)
    for s in range(0, len(i), 1 << 14):
        here = slice(s, s + (1 << 14))
        out[here] = np.einsum("ij,ij->i", unit(x[i[here]]), unit(x[j[here]])) >= threshold
    return out


def _linked(batches: list[pa.RecordBatch], at: Shelves, same: bool, threshold: float, block: int) -> Iterator[pa.RecordBatch]:
    """Counts and forest of the links between the rows of two shelves, or within one. Empties ``batches``."""
    shelf, cell, key, copies = (np.concatenate([b.column(x) for b in batches]) for x in ("shelf", "cell", "key", "copies"))
    whole = np.concatenate([matrix(b.column("vector")) for b in batches])
    batches.clear()
    order = np.lexsort((cell, shelf))
    shelf, cell, key, copies, whole = (column[order] for column in (shelf, cell, key, copies, whole))
    n, dim = whole.shape
    x, short = np.empty((n, dim), np.float32), np.empty((n, at.axes.shape[1] + 1), np.float32)
    for s in range(0, n, 1 << 13):
        here = slice(s, s + (1 << 13))
        x[here] = u = unit(whole[here])
        short[here, :-1] = along = u @ at.axes
        short[here, -1] = np.sqrt(np.maximum(1 - (along * along).sum(1), 0))
    # What sums in single precision may be off by.
    slack = 1e-6 + dim * 2.0**-22
    reach, gaps = np.sqrt(2 - 2 * threshold) + 2 * slack, at.gaps()
    least, most = threshold - slack, threshold + slack
    links, label = np.zeros(n, np.int64), np.arange(n)
    forest, waiting, held = [], [], 0

    def near(c: slice, e: slice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Linked rows of two cells."""
        a, b = np.arange(c.start, c.stop), np.arange(e.start, e.stop)
        one, other = cell[c.start], cell[e.start]
        far_a = far_b = None
        if gaps[one, other] < np.inf and one != other:
            across = ((at.centre[one] - at.centre[other]) / gaps[one, other]).astype(np.float32)
            far_a, far_b = x[c] @ across, -(x[e] @ across)
            order_a, order_b = far_a.argsort(), far_b.argsort()
            a, b, far_a, far_b = a[order_a], b[order_b], far_a[order_a], far_b[order_b]
        short_a, short_b = short[a], short[b]
        for s in range(0, len(a), block):
            stop = len(b) if far_a is None else int(np.searchsorted(far_b, reach - far_a[s], "right"))
            for t in range(s if c == e else 0, stop, 2 * block):
                rows, cols = a[s : s + block], b[t : min(t + 2 * block, stop)]
                hit = np.flatnonzero(short_a[s : s + block] @ short_b[t : t + len(cols)].T >= least)
                full = None
                if len(hit) > len(rows) * len(cols) // 64:
                    full = (x[rows] @ x[cols].T).reshape(-1)
                    hit = np.flatnonzero(full >= least)
                for some in np.array_split(hit, -(-len(hit) // _HITS)) if len(hit) else ():
                    i, j = rows[some // len(cols)], cols[some % len(cols)]
                    cosine = np.einsum("ij,ij->i", x[i], x[j]) if full is None else full[some]
                    ok = (cosine >= least) & ((i < j) if c == e else True)
                    unsure = np.flatnonzero(ok & (cosine < most))
                    ok[unsure] = _exactly(whole, i[unsure], j[unsure], threshold)
                    yield i[ok], j[ok]

    cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(shelf) != 0)) + 1
    runs = [slice(int(p), int(q)) for p, q in zip([0, *cuts], [*cuts, n], strict=True)]
    if same:
        meetings = combinations_with_replacement(runs, 2)
    else:
        meetings = product(*([r for r in runs if (shelf[r.start] == shelf[0]) == side] for side in (True, False)))
    for c, e in meetings:
        for i, j in near(c, e):
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            apart = label[i] != label[j]
            waiting.append((i[apart], j[apart]))
            held += int(apart.sum())
            if held > _HITS:
                forest += _join_up(label, *map(np.concatenate, zip(*waiting, strict=True)))
                waiting, held = [], 0
    if held:
        forest += _join_up(label, *map(np.concatenate, zip(*waiting, strict=True)))
    some = np.flatnonzero(links)
    a, b = np.concatenate((np.zeros((2, 0), int), *forest), axis=1)
    none = np.zeros(len(a), np.int64)
    for columns in ([pa.array(key[some]), pa.nulls(len(some), pa.int64()), pa.array(links[some])], [pa.array(key[a]), pa.array(key[b]), pa.array(none)]):
        yield pa.RecordBatch.from_arrays(columns, names=["key", "other", "links"])


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, cells: int = CELLS, block: int = BLOCK) -> DataFrame:
    """(key, n_links, component_id, kept) of every row.

    Sent to the driver: a sample of about SAMPLE vectors, and a count per cell.
    """
    # Single precision stays so on the way; cosines are taken in double.
    kind = "float" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "double"
    value = F.transform(vector, lambda v: v.cast(kind) + F.lit(0.0).cast(kind))  # -0.0 is 0.0
    fine = usable(vector) & F.exists(vector, lambda v: v != 0)
    rows = vectors.select(F.col(key).alias("id"), F.when(fine, value).alias("vector"))
    hashed = F.when(F.col("vector").isNotNull(), F.xxhash64("vector"))
    rows = materialize(rows.withColumn("key", hashed))
    distinct = rows.where("key is not null").groupBy("key").agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    distinct = materialize(distinct.withColumn("dim", F.size("vector")))
    sizes_of = {r["dim"]: r["count"] for r in distinct.groupBy("dim").count().collect()}
    share = SAMPLE / max(SAMPLE, sum(sizes_of.values()))
    drawn = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = distinct.where(drawn).select("dim", "key", "vector").toArrow().sort_by("key").combine_chunks()
    fitted, axes = {}, {}
    for dim, n in sorted(sizes_of.items()):
        own = sample.filter(pa.array(sample.column("dim").to_numpy() == dim)).combine_chunks().column("vector")
        if len(own):
            own = unit(matrix(own.chunk(0)))
            fitted[dim], axes[dim] = centres(own, min(cells, 1 + n // block)), widest(own)
        else:  # A length that the sample misses has one cell.
            fitted[dim], axes[dim] = np.eye(1, dim), np.eye(dim, 1)
    residents = {dim: np.zeros(len(c), np.int64) for dim, c in fitted.items()}
    for r in homes(distinct, fitted).groupBy("dim", "cell").count().collect():
        residents[r["dim"]][r["cell"]] = r["count"]
    dealt: dict[int, Shelves] = {}
    tasks: list[tuple[int, bool]] = []
    for dim, n in sorted(sizes_of.items()):
        shelves = max(min(SPREAD, -(-n // block)), -(-n * dim * 4 // SHELF_BYTES))
        dealt[dim] = shelved(fitted[dim], axes[dim], residents[dim], shelves, len(tasks))
        tasks += [(dim, bool(a == b)) for a, b in zip(*np.triu_indices(shelves), strict=True)]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            numbers = batch.column("pair").to_numpy()
            for pair in np.unique(numbers).tolist():
                taken.setdefault(pair, []).append(batch.filter(pa.array(numbers == pair)))
        while taken:
            pair, own = taken.popitem()
            dim, same = tasks[pair]
            yield from _linked(own, dealt[dim], same, threshold, block)

    pairs = placements(distinct, dealt, threshold).repartitionById(max(1, len(tasks)), "pair")
    found = materialize(pairs.mapInArrow(compare, "key long, other long, links long"))
    links = found.where("other is null").groupBy("key").agg(F.sum("links").alias("links"))
    joined = components(found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    per_value = distinct.select("key", "copies", "least").join(links, "key", "left").join(joined.withColumnRenamed("id", "key"), "key", "left")
    per_value = per_value.withColumn("component", F.coalesce("component", "key"))
    smallest = per_value.groupBy("component").agg(F.min("least").alias("component_id"))
    per_value = per_value.join(smallest, "component").select("key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.join(per_value, "key", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
