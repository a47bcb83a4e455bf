"""Operator 9: exact n-gram Jaccard join in the metric space of Jaccard distances.

Documents with equal sets of shingles are one point. Regions are the documents that share a
shingle among the first of their sets, in an order that puts common shingles last: two sets as near
as asked share one there, so no link lies outside all regions. In each region a pivot is taken and the
distances to it are measured. Documents near enough are linked to it. Any two others are only
looked at if their distances to the pivot differ by at most the radius (triangle inequality), so a
Voronoi boundary is crossed by those alone that may have a partner beyond. Regions that fell into
one component are done; the rest is split again by a new pivot from outside the first one's
component; and what the windows of all pivots leave is compared directly, once the number of regions
a pair shares and its places in them say that it may be near enough. Before whole sets are fetched, sketches of parities
bound from below in how many shingles a pair differs, and rule out what is too far, so that a crowd of sets that are
nearly near enough costs no row a pair.

Null and blank texts have an empty set and link with nothing. Fewer words than a shingle form one shingle. Rows
with a null id link with nothing and keep a null component. Repeated rows and rows of equal sets
belong together; rows that share an id are one document with several texts. Empty tables give empty
results. Extra columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, components, materialize, mix, slices, text_buffer, word_hashes

ROUNDS = 3  # of splits, before what the windows leave is compared
PIVOTS = 16  # of a region in a split
LEAF = 40  # members of a region that are compared without another pivot
COMMON = 500  # a shingle in more than one of COMMON documents of some task is common
HELD = 1 << 20  # shingles a task holds to count them
ODD = 8  # words of 64 bits of a sketch of parities
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_STEP = np.arange(1, 9, dtype=np.uint64) * _ODD


def shingles(batch: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of shingles (8 words at most) of each row, and row numbers; by row, then hash."""
    hashes, row = word_hashes(*text_buffer(batch.column("text")))
    count = np.bincount(row, minlength=batch.num_rows)
    at = np.flatnonzero(row[words - 1 :] == row[: len(row) - words + 1]) if len(row) >= words else np.zeros(0, np.int64)
    value = np.zeros(len(at), np.uint64)
    for k in range(words):
        value += mix(hashes[at + k] + _STEP[k])
    value, owner = mix(value), row[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        first = np.searchsorted(row, short)
        whole = np.zeros(len(short), np.uint64)
        for k in range(words - 1):
            more = count[short] > k
            whole[more] += mix(hashes[first[more] + k] + _STEP[k])
        value = np.concatenate((value, mix(whole + count[short].astype(np.uint64))))
        owner = np.concatenate((owner, short))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.concatenate(([True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))) if len(value) else np.zeros(0, bool)
    return value[new], owner[new]


_ODDS = [f"odd{w}" for w in range(ODD)]


def parities(value: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """Sketch of each row's set, ODD words: a bit is set where an odd number of its shingles fall on it."""
    out = np.zeros(rows * ODD, np.uint64)
    np.bitwise_xor.at(out, owner * ODD + (value >> np.uint64(6) & np.uint64(ODD - 1)).astype(np.int64), np.uint64(1) << (value & np.uint64(63)))
    return out.view(np.int64).reshape(rows, ODD)


def common_shingles(docs: DataFrame, words: int) -> dict[int, int]:
    """Shingles that stand in a share of over 1 / COMMON of some task's documents, and how often.

    A shingle in that share of all documents is so in some task. A task can name at most
    COMMON times the shingles of a document, and the driver keeps those above the share of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, size = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            often = n > max(3, docs / COMMON)
            yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["shingle", "n"])

        for batch in slices(batches, "text"):
            value, _ = shingles(batch, words)
            held, docs, size = [*held, value], docs + batch.num_rows, size + len(value)
            if size > HELD:
                yield from flush()
                held, docs, size = [], 0, 0
        if held:
            yield from flush()

    total = docs.count()
    found = docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return {r["shingle"]: r["n"] for r in found.where(F.col("n") > total / COMMON).collect()}


def points(docs: DataFrame, words: int, percent: int, common: dict[int, int], whole: bool) -> DataFrame:
    """(doc_id, n, point, shingles): the set's size and hash, and its first shingles or all of them; beside the
    first ones, odd0 and so on: the sketch of :func:`parities`."""
    known = np.array(sorted(common), np.int64)
    often = np.array([common[k] for k in known.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            value, owner = shingles(batch, words)
            signed = value.view(np.int64)
            n = np.bincount(owner, minlength=batch.num_rows)
            ends = np.cumsum(n)
            sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(value ^ np.uint64(0x5851F42D4C957F2D)))))
            point = mix(sums[ends] - sums[ends - n] + n.astype(np.uint64)).view(np.int64)
            odd = []
            if not whole:
                odd = [pa.array(np.ascontiguousarray(x)) for x in parities(value, owner, batch.num_rows).T]
                weight = np.zeros(len(value), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, signed), len(known) - 1)
                    weight = np.where(known[at] == signed, often[at], 0)
                order = np.lexsort((signed, weight, owner))
                place = np.arange(len(value)) - np.repeat(ends - n, n)
                # Sets this similar share one of the first n - ceil(t n) + 1.
                first = n - -(-n * percent // 100) + 1
                keep = place < np.repeat(first, n)
                signed, owner = signed[order][keep], owner[keep]
            offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=batch.num_rows)))).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(point), arrays, *odd], names=["doc_id", "n", "point", "shingles", *(_ODDS if odd else ())])

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = "" if whole else "".join(f", {name} long" for name in _ODDS)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, point long, shingles array<long>{more}")


def _near(percent: int) -> Column:
    return F.col("common") * 100 >= F.col("either") * percent


def _placed(na: Column, at_a: Column, nb: Column, at_b: Column, percent: int) -> Column:
    """Whether sets of these sizes that first meet at these places can be near enough.

    Nothing before the first shared shingle is shared, so at most what follows it in either set is.
    A near pair passes in the region of its first shared shingle, whatever it does in others.
    """
    return F.least(na - at_a, nb - at_b) * (100 + percent) >= (na + nb) * percent


def _least_shared(na: Column, nb: Column, percent: int) -> Column:
    """First shingles that near sets of these sizes share at least; see :func:`_may_link`."""
    ceil = lambda x, y: F.ceil(x / F.lit(y))
    return ceil((na + nb) * percent, 100 + percent) - ceil(F.greatest(na, nb) * percent, 100) + 1


def _alike(a: list[Column], na: Column, b: list[Column], nb: Column, percent: int) -> Column:
    """Whether sets of these sketches of parities can be near enough.

    What both sets hold cancels out of the parities, so each bit that differs stands for a shingle that one set holds
    alone, and near sets differ in at most (1 - t) / (1 + t) of the sum of their sizes.
    """
    apart = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)]
    return sum(apart[1:], apart[0]) * (100 + percent) <= (na + nb) * (100 - percent)


SKETCH = 4  # words of 64 bits


def sketches(firsts: DataFrame) -> DataFrame:
    """(point, bits0, ..., doubled): first shingles as bits of SKETCH words, and how many of them fell on a bit that was set."""
    word = lambda w: F.expr(f"aggregate(firsts, 0L, (s, x) -> IF((x >> 6 & {SKETCH - 1}) = {w}, s | shiftleft(1L, int(x & 63)), s))")
    made = firsts.select("point", F.size("firsts").alias("size"), *[word(w).alias(f"bits{w}") for w in range(SKETCH)])
    held = sum((F.bit_count(f"bits{w}") for w in range(1, SKETCH)), F.bit_count("bits0"))
    return made.withColumn("doubled", F.col("size") - held).drop("size")


def _most_shared(a: str, b: str) -> Column:
    """What sets share at most, by their sketches: each shared shingle has a bit set in both, its own or a doubled one."""
    both = [F.bit_count(F.col(f"{a}.bits{w}").bitwiseAND(F.col(f"{b}.bits{w}"))) for w in range(SKETCH)]
    return sum(both[1:], both[0]) + F.least(f"{a}.doubled", f"{b}.doubled")


def _may_link(pairs: DataFrame, firsts: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and the number of shared first shingles allow.

    Sets of sizes m <= n with this similarity have at least ceil(t (m + n) / (1 + t)) in common, so of
    their first n - ceil(t n) + 1 shingles they share ceil(t (m + n) / (1 + t)) - ceil(t n) + 1 at least.
    """
    known = firsts.join(own.select("point", "n"), "point").select("point", "n", "firsts")
    most, least = F.greatest("na", "nb"), F.least("na", "nb")
    overlap = _least_shared(F.col("na"), F.col("nb"), percent)
    of = lambda side: own.select(F.col("point").alias(side), F.col("n").alias(f"n{side}"), *[F.col(x).alias(f"{side}_{x}") for x in _ODDS])
    odds = lambda side: [F.col(f"{side}_{x}") for x in _ODDS]
    sized = pairs.join(of("a"), "a").join(of("b"), "b")
    sized = sized.where((most * percent <= least * 100) & _alike(odds("a"), F.col("na"), odds("b"), F.col("nb"), percent)).select("a", "b", "na", "nb")
    both = sized.join(known.select(F.col("point").alias("a"), F.col("firsts").alias("fa")), "a").join(known.select(F.col("point").alias("b"), F.col("firsts").alias("fb")), "b")
    return both.where(F.size(F.array_intersect("fa", "fb")) >= overlap).select("a", "b")


def measured(pairs: DataFrame, docs: DataFrame, own: DataFrame, words: int, percent: int) -> DataFrame:
    """pairs (a, b) with ``common`` and ``either``: sizes of intersection and union of the whole sets.

    Whole sets are made for the documents of these pairs alone.
    """
    pairs = materialize(pairs)
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("point")).distinct().join(own, "point").select("point", "doc_id"))
    # Ids alone, and counted: up to 8 MB go to all tasks, more are joined by a shuffle.
    few = wanted.count() <= 1_000_000
    ids = wanted.select("doc_id").distinct()
    chosen = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    sets = points(chosen, words, percent, {}, whole=True).select("point", "shingles").join(wanted.select("point"), "point", "left_semi")
    sets = materialize(sets.dropDuplicates(["point"]))
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return materialize(both.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb") - common).alias("either")))


def join(docs: DataFrame, words: int = 5, percent: int = 80, leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text).

    Linked are documents with 100 * common >= percent * either.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    common = common_shingles(docs, words)
    rows = materialize(points(docs, words, percent, common, whole=False))
    usable = rows.where("n > 0 and doc_id is not null")
    own = materialize(usable.groupBy("point").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), *[F.max(x).alias(x) for x in _ODDS]))
    members = usable.select("point", "n", F.posexplode("shingles").alias("place", "shingle"))
    regions = members.groupBy("shingle").agg(
        F.min("point").alias("pivot"), F.max("point").alias("last"), F.min_by("n", "point").alias("pivot_n"), F.min_by("place", "point").alias("pivot_place")
    ).where("pivot <> last")
    live = materialize(members.join(regions.drop("last"), "shingle").distinct())
    # The shared first shingles of each point: a bounded part of its set.
    firsts = materialize(live.groupBy("point").agg(F.collect_list("shingle").alias("firsts")))
    links = usable.where("1 = 0").select(F.col("point").alias("a"), F.col("point").alias("b"))
    may_meet = _placed(F.col("n"), F.col("place"), F.col("pivot_n"), F.col("pivot_place"), percent)
    ahead = live.where((F.col("point") != F.col("pivot")) & may_meet).select(F.col("point").alias("a"), F.col("pivot").alias("b")).distinct()
    to_pivot = measured(_may_link(ahead, firsts, own, percent), docs, own, words, percent)
    links = links.union(to_pivot.where(_near(percent)).select("a", "b"))
    apart = to_pivot.select(F.col("a").alias("point"), F.col("b").alias("pivot"), (1 - F.col("common") / F.col("either")).alias("d"))
    # Those that the pivot has met keep their distance to it.
    live = live.drop("pivot_n", "pivot_place").join(apart, ["point", "pivot"], "left")
    radius = 1 - percent / 100 + 1e-9

    def window(a: str, b: str) -> Column:
        gap = F.abs(F.col(f"{a}.d") - F.col(f"{b}.d"))
        return (F.col(f"{a}.component") != F.col(f"{b}.component")) & (gap.isNull() | (gap <= radius))

    def placed(a: str, b: str) -> Column:
        return _placed(F.col(f"{a}.n"), F.col(f"{a}.place"), F.col(f"{b}.n"), F.col(f"{b}.place"), percent)

    for turn in range(1, ROUNDS + 1):
        joined = components(links).withColumnRenamed("id", "point")
        links = joined.toDF("a", "b")  # says the same in fewer steps to follow
        live = live.drop("component", "size", "of_pivot").join(joined, "point", "left").withColumn("component", F.coalesce("component", "point"))
        # Regions within one component are done.
        several = live.groupBy("shingle").agg(
            F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("size"),
            F.max(F.when(F.col("point") == F.col("pivot"), F.col("component"))).alias("of_pivot"),
        )
        live = materialize(live.join(several.where("c0 <> c1").select("shingle", "size", "of_pivot"), "shingle"))
        large = live.where(F.col("size") > leaf)
        if turn == ROUNDS or large.isEmpty():
            break
        # Split the large ones again: by members of the first pivot's component, others each time,
        # which draw in what lies near any of them, and by some from outside it.
        inside = F.col("component") == F.col("of_pivot")
        nth = F.row_number().over(Window.partitionBy("shingle", inside).orderBy("point"))
        fresh = (F.col("nth") > (turn - 1) * PIVOTS) & (F.col("nth") <= turn * PIVOTS)
        chosen = large.withColumn("nth", nth).where(F.when(F.coalesce(inside, F.lit(False)), fresh).otherwise(F.col("nth") <= PIVOTS // 4))
        meets = (F.col("x.shingle") == F.col("p.shingle")) & (F.col("x.point") != F.col("p.point")) & window("x", "p") & placed("x", "p")
        ahead = large.alias("x").join(chosen.alias("p"), meets).select(F.greatest("x.point", "p.point").alias("a"), F.least("x.point", "p.point").alias("b")).distinct()
        found = measured(_may_link(ahead, firsts, own, percent), docs, own, words, percent)
        links = links.union(found.where(_near(percent)).select("a", "b"))
    meets = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.point") < F.col("b.point")) & window("a", "b")
    # Regions that fell away lie in one component, and windows hold for pairs, so a pair that is still of interest
    # meets once for each of the first shingles it shares. Sketches rule out most that share too few before they are counted.
    sized = F.greatest("a.n", "b.n") * percent <= F.least("a.n", "b.n") * 100
    enough = _most_shared("a", "b") >= _least_shared(F.col("a.n"), F.col("b.n"), percent)
    odds = lambda side: [F.col(f"{side}.{x}") for x in _ODDS]
    alike = _alike(odds("a"), F.col("a.n"), odds("b"), F.col("b.n"), percent)
    rest = live.join(sketches(firsts), "point").join(own.select("point", *_ODDS), "point")
    left = rest.alias("a").join(rest.alias("b"), meets & sized & alike & enough).select(
        F.col("a.point").alias("a"), F.col("b.point").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"), placed("a", "b").alias("placed")
    )
    left = left.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared"), F.bool_or("placed").alias("placed"))
    left = left.where(F.col("placed") & (F.col("shared") >= _least_shared(F.col("na"), F.col("nb"), percent))).select("a", "b")
    found = measured(left, docs, own, words, percent)
    links = links.union(found.where(_near(percent)).select("a", "b"))
    # Ids that stand for several sets tie those together.
    ties = usable.groupBy("doc_id").agg(F.min("point").alias("b"), F.max("point").alias("m")).where("b <> m").select("doc_id", "b")
    ties = usable.join(ties, "doc_id").select(F.col("point").alias("a"), "b")
    joined = components(links.union(ties)).withColumnRenamed("id", "point")
    named = own.select("point", "doc_id").join(joined, "point", "left").withColumn("component", F.coalesce("component", "point"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    per_point = named.join(smallest, "component").select("point", "component_id")
    out = rows.select("doc_id", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("point")).alias("point"))
    out = out.join(per_point, "point", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group; a row once where rows repeat one id.

    Of different texts of an id, which are of one group, the longest stays. Rows without an id all stay.
    """
    found = join(docs, words, percent)
    # A blank row of an id is in no group; the id's other rows decide.
    kept = found.groupBy("doc_id").agg(F.min("component_id").alias("__first")).where("doc_id = __first").select("doc_id")
    order = [F.regexp_like("text", F.lit(WORD)).desc_nulls_last(), F.octet_length("text").desc_nulls_last(), F.xxhash64(*docs.columns)]
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    whole = docs.join(kept, "doc_id", "left_semi").withColumn("__nth", nth).where("__nth = 1").drop("__nth")
    return whole.union(docs.where("doc_id is null").select(whole.columns)).select(docs.columns)
