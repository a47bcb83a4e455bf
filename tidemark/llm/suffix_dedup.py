"""Operator 2: remove text that occurred before, by difference-cover suffix sorting.

The windows of WINDOW bytes of a text are grouped by an anchor: the first least hash of the GRAM-byte
strings in the window. Equal windows have equal anchors at equal offsets, so no match
lies outside a group. Spark shuffles one row per anchor: where its windows' whole surroundings
occurred before, all of them go at once; where no other surroundings share the anchor, all stay.
For the rest, texts around the anchors are dealt out by anchor and suffix-sorted in each task with
the difference-cover (skew) algorithm: sort the triples at two of three positions, recurse on their names,
merge in the remaining suffixes. Neighbours in that order are compared over their first WINDOW bytes, and
of each run of equals the earliest stays. Anchors with very many different surroundings are no task's to sort: their
windows are grouped by 128-bit hash instead, with minima taken before the shuffle.

Null and empty texts have no bytes; texts shorter than a window lose nothing. Rows without an id are compared
with nothing. Rows that share an id stand at the same place: of equal windows at one offset none is before the
other. Different texts of an id are numbered, so that each is cut by its own windows. Long texts are
whole. Empty tables give empty results. Extra columns are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import _BASE_INVERSE, _BYTE_VALUE, materialize, mix, powers, slices, text_buffer

WINDOW, GRAM = 100, 20
CROWDED = 5000  # different surroundings of an anchor (under 1 MB), beyond which windows are grouped by hash
_CHUNK = 2 << 20
_SORTED = 1 << 19  # bytes of pieces sorted at once


def anchors(raw: np.ndarray, bounds: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Row, anchor position, first and last window start, hash of the gram and of the surroundings."""
    n, none = len(raw), np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[raw] * powers(n), out=running[1:])
    inverse = powers(n, _BASE_INVERSE)
    hashes = mix((running[gram:] - running[:-gram]) * inverse[: n - gram + 1])
    bits = np.uint64(max(22, n.bit_length()))
    least, width, target = hashes >> bits << bits | np.arange(len(hashes), dtype=np.uint64), 1, window - gram + 1
    while width * 2 <= target:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < target:
        least = np.minimum(least[: len(least) - (target - width)], least[target - width :])
    where = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    start = np.arange(len(where))
    row = np.searchsorted(bounds, start, side="right") - 1
    inside = start + window <= bounds[row + 1]
    start, where, row = start[inside], where[inside], row[inside]
    if not len(start):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]) | (row[1:] != row[:-1]))))
    low, high, at = start[new], start[np.concatenate((new[1:] - 1, [len(start) - 1]))], where[new]
    end = high + window
    around = mix((running[end] - running[low]) * inverse[low] + (end - low).astype(np.uint64))
    around = mix(around + (at - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return row[new], at, low, high, hashes[at], around


def _positions(docs: DataFrame) -> tuple[DataFrame, int, bool]:
    """(place, twin, text) with a number in order of ids, one that tells apart different texts of
    an id (0 where it has one), the bits that a byte's offset needs beside the place, and whether there are such ids."""
    known = docs.where("doc_id is not null")
    per_id = known.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("h0"), F.max(F.xxhash64("text")).alias("h1"), F.max(F.octet_length("text")).alias("size"))
    least, most, longest, several = per_id.agg(F.min("doc_id"), F.max("doc_id"), F.max("size"), F.max(F.col("h0") != F.col("h1"))).first()
    if several:
        known = known.withColumn("print", F.sha2("text", 256))
        texts = known.join(per_id.where("h0 <> h1"), "doc_id", "left_semi").select("doc_id", "print").distinct()
        twins = texts.orderBy("doc_id", "print").rdd.map(tuple).zipWithIndex().map(lambda r: (*r[0], r[1] + 1))
        kind = docs.schema["doc_id"].dataType.simpleString()
        known = known.join(materialize(twins.toDF(f"doc_id {kind}, print string, twin long")), ["doc_id", "print"], "left").drop("print")
    known = known.withColumn("twin", F.coalesce("twin", F.lit(0)).cast("long") if several else F.lit(0).cast("long"))
    bits = max(8, (longest or 0).bit_length())
    if least is None or (most - least).bit_length() + bits <= 62:
        return known.withColumn("place", F.col("doc_id") - F.lit(least or 0)), bits, bool(several)
    ids = known.select("doc_id").distinct().orderBy("doc_id").rdd.map(lambda r: r[0]).zipWithIndex()
    return known.join(ids.toDF("doc_id long, place long"), "doc_id"), bits, bool(several)


def anchor_rows(placed: DataFrame, bits: int) -> DataFrame:
    """(gram, around, at, sides): at holds place and offset of the anchor, sides its windows' extent
    in 16 bits and, above them, the twin.

    Surroundings that repeat within a slice are sent once, with their first place; once for each twin there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _CHUNK):
            raw, bounds = text_buffer(batch.column("text"))
            row, at, low, high, gram, around = anchors(raw, bounds)
            place = batch.column("place").to_numpy()[row] << bits | (at - bounds[row])
            twin = batch.column("twin").to_numpy()[row]
            order = np.lexsort((twin, place, around))
            first = order
            if len(order):
                a, p, t = around[order], place[order], twin[order]
                new = np.concatenate(([True], a[1:] != a[:-1]))
                least = p[np.flatnonzero(new)][np.cumsum(new) - 1]
                new[1:] |= (p[1:] == least[1:]) & (t[1:] != t[:-1])
                first = order[new]
            sides = (twin << 16 | (at - low) << 8 | (high - at + WINDOW))[first]
            out = [pa.array(gram[first].view(np.int64)), pa.array(around[first].view(np.int64)), pa.array(place[first]), pa.array(sides)]
            yield pa.RecordBatch.from_arrays(out, names=["gram", "around", "at", "sides"])

    return placed.select("place", "twin", "text").mapInArrow(run, "gram long, around long, at long, sides long")


def _first(rows: DataFrame, keys: list[str], twin: str) -> DataFrame:
    """Of rows with equal keys, those of the least ``at``: one for each twin."""
    least = F.min("at").over(Window.partitionBy(*keys))
    return rows.groupBy(*keys, twin).agg(F.min("at").alias("at")).withColumn("least", least).where("at = least").drop("least")


def by_document(shared: DataFrame, bits: int) -> DataFrame:
    """(place, twin, alone, open): anchors of a document whose windows stay, one number each, and those whose windows are to be compared."""
    packed = F.shiftleft(F.col("at").bitwiseAND((1 << bits) - 1), 16).bitwiseOR(F.col("sides").bitwiseAND(0xFFFF))
    entry = F.struct(packed.alias("packed"), "gram", (F.col("others") > CROWDED).alias("crowded"))
    alone, open_ = F.when(F.col("others") == 1, packed), F.when(F.col("others") > 1, entry)
    place, twin = F.shiftright("at", bits).alias("place"), F.shiftright("sides", 16).alias("twin")
    return shared.groupBy(place, twin).agg(F.collect_list(alone).alias("alone"), F.collect_list(open_).alias("open"))


def suffix_order(s: np.ndarray, need: int) -> np.ndarray:
    """Ranks of all suffixes of s (values from 1), ordered by their first ``need`` symbols at least.

    Suffixes of one rank agree in these; those that agree follow each other.
    """
    n = len(s)
    padded = np.concatenate((s, np.zeros(3, np.int64)))
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # a dummy triple ends the first half where it must
    sample = np.concatenate((one, two))
    padded = np.concatenate((padded, np.zeros(3, np.int64)))
    a, b, c = padded[sample], padded[sample + 1], padded[sample + 2]
    if int(s.max(initial=0)) < 1 << 21:
        key = a << 42 | b << 21 | c
        order = np.argsort(key)
        new = np.concatenate(([True], np.diff(key[order]) != 0)) if len(order) else np.zeros(0, bool)
    else:
        order = np.lexsort((c, b, a))
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0) | (np.diff(c[order]) != 0)
    names = np.zeros(len(sample), np.int64)
    names[order] = np.cumsum(new)
    if need > 3 and len(names) and names.max() < len(names):
        names = suffix_order(names, -(-need // 3)) + 1
    rank = np.zeros(n + 6, np.int64)
    rank[sample] = names
    # The rest: by symbol, then the rank of the sampled suffix behind it.
    rest = np.arange(0, n, 3)
    bits = int(max(rank.max(initial=0), 1)).bit_length()
    wide = int(padded.max(initial=1)).bit_length()
    by_one = lambda i: padded[i] << bits | rank[i + 1]
    rest_key = by_one(rest)
    rest = rest[np.argsort(rest_key)]
    one, two = one[one < n], two
    # Merge: against one kind of sampled suffix after one symbol, against the other after two.
    before_one = np.searchsorted(np.sort(by_one(one)), by_one(rest), side="left")
    if 2 * wide + bits < 63:
        by_two = lambda i: (padded[i] << wide | padded[i + 1]) << bits | rank[i + 2]
        before_two = np.searchsorted(np.sort(by_two(two)), by_two(rest), side="left")
    else:
        both = np.concatenate((two, rest))
        order = np.lexsort((rank[both + 2], padded[both + 1], padded[both]))
        ordered = both[order]
        change = np.ones(len(both), bool)
        if len(both):
            change[1:] = (np.diff(padded[ordered]) != 0) | (np.diff(padded[ordered + 1]) != 0) | (np.diff(rank[ordered + 2]) != 0)
        dense = np.zeros(len(both), np.int64)
        dense[order] = np.cumsum(change)
        before_two = np.searchsorted(np.sort(dense[: len(two)]), dense[len(two) :], side="left")
    # Suffixes equal as far as asked may differ beyond; keep to one order among them.
    spot = np.arange(len(rest)) + before_one + np.maximum.accumulate(before_two)
    taken = np.zeros(n, bool)
    taken[spot] = True
    sampled = np.concatenate((one, two))
    sampled = sampled[np.argsort(rank[sampled])]
    suffixes = np.empty(n, np.int64)
    suffixes[spot], suffixes[~taken] = rest, sampled
    # Equal neighbours keep one rank: they agree as far as was asked for.
    kind = suffixes % 3
    out = np.empty(n, np.int64)
    same = np.zeros(n, bool)
    if n > 1:
        p, q = suffixes[:-1], suffixes[1:]
        shift = np.array([[1, 1, 2], [1, 0, 0], [2, 0, 0]])[kind[:-1], kind[1:]]
        equal = rank[p + shift] == rank[q + shift]
        equal &= (shift == 0) | (padded[p] == padded[q])
        equal &= (shift < 2) | (padded[p + 1] == padded[q + 1])
        same[1:] = equal
    out[suffixes] = np.cumsum(~same) - 1
    return out


def earliest(text: np.ndarray, starts: np.ndarray, at: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Of the windows of ``text`` at ``starts``, those with the least ``at`` among equals."""
    order = starts[np.argsort(suffix_order(text.astype(np.int64) + 1, window)[starts])]
    eight = np.zeros(len(text) - 7, np.uint64)
    for k in range(8):
        eight |= text[k : len(text) - 7 + k].astype(np.uint64) << np.uint64(8 * k)
    p, q = order[:-1], order[1:]
    equal = np.ones(len(p), bool)
    for k in [*range(0, window - 8, 8), window - 8]:
        equal &= eight[p + k] == eight[q + k]
    new = np.concatenate(([True], ~equal))
    place = np.empty(len(text), np.int64)
    place[starts] = at
    group = np.cumsum(new) - 1
    first = np.minimum.reduceat(place[order], np.flatnonzero(new))
    kept = np.zeros(len(text), bool)
    kept[order[place[order] == first[group]]] = True
    return kept[starts]


def _pieces(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Text of all pieces, and each window's start in it, place in the corpus and twin."""
    raw, bounds = text_buffer(batch.column("piece"))
    at, sides = batch.column("at").to_numpy(), batch.column("sides").to_numpy()
    count = np.diff(bounds) - WINDOW + 1
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return raw, np.repeat(bounds[:-1], count) + inner, np.repeat(at - (sides >> 8), count) + inner, np.repeat(batch.column("twin").to_numpy(), count)


def sorted_windows(pieces: DataFrame) -> DataFrame:
    """(start, twin): windows that stay, of pieces partitioned and sorted by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def decide(part: pa.RecordBatch) -> pa.RecordBatch:
            text, starts, at, twin = _pieces(part)
            stay = earliest(text, starts, at)
            return pa.RecordBatch.from_arrays([pa.array(at[stay]), pa.array(twin[stay])], names=["start", "twin"])

        for batch in batches:
            held.append(batch)
            if sum(b.column("piece").nbytes for b in held) < _SORTED:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            gram = whole.column("gram").to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))  # the last anchor may go on
            if cut:
                yield decide(whole.slice(0, cut))
            held = [whole.slice(cut)]
        if held and sum(b.num_rows for b in held):
            yield decide(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return pieces.select("gram", "at", "sides", "twin", "piece").mapInArrow(run, "start long, twin long")


def hashed_windows(pieces: DataFrame, twins: bool) -> DataFrame:
    """(start, twin): windows that stay, for anchors with very many surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "piece", _CHUNK):
            text, starts, at, twin = _pieces(batch)
            values = np.zeros((2, len(text) + 1), np.uint64)
            out = []
            for k, value in enumerate((_BYTE_VALUE[text], mix(_BYTE_VALUE[text]))):
                np.cumsum(value * powers(len(text)), out=values[k, 1:])
                out.append(mix((values[k, starts + WINDOW] - values[k, starts]) * powers(len(text), _BASE_INVERSE)[starts]).view(np.int64))
            yield pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array(at), pa.array(twin)], names=["h1", "h2", "at", "twin"])

    hashed = pieces.select("at", "sides", "twin", "piece").mapInArrow(run, "h1 long, h2 long, at long, twin long")
    if twins:
        first = _first(hashed, ["h1", "h2"], "twin")
    else:
        first = hashed.groupBy("h1", "h2").agg(F.min("at").alias("at")).withColumn("twin", F.lit(0).cast("long"))
    return first.select(F.col("at").alias("start"), "twin")


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets and values of a column of lists; NULL is empty."""
    lengths = column.value_lengths().fill_null(0).to_numpy(False)
    return np.concatenate(([0], np.cumsum(lengths))).astype(np.int64), column.flatten()


def _sides(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offset of an anchor, and first and number of its windows, of one number: the offset above the two sides."""
    at, before = packed >> 16, packed >> 8 & 255
    return at, at - before, before + (packed & 255) - WINDOW + 1


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and length of runs of consecutive ascending numbers."""
    first = np.flatnonzero(np.concatenate(([True], np.diff(starts) != 1)))
    return starts[first], np.diff([*first, len(starts)])


def cut(text: bytes, kept: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What stays of a text whose windows stay at (first, count) only; and the number of removed runs."""
    windows = len(text) - WINDOW + 1
    if windows <= 0:
        return text, 0
    steps = np.zeros(windows + 1, np.int64)
    for first, count in kept:
        steps[first] += 1
        steps[first + count] -= 1
    gone = np.flatnonzero(np.cumsum(steps[:windows]) == 0)
    if not len(gone):
        return text, 0
    first, count = _runs(gone)
    steps = np.zeros(len(text) + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, first + count - 1 + WINDOW, -1)
    removed = np.cumsum(steps[:-1]) > 0
    spans = int(removed[0]) + int((np.diff(removed.astype(np.int8)) > 0).sum())
    return np.frombuffer(text, np.uint8)[~removed].tobytes(), spans


_RESULT = "place long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _result(place: list, texts: list[bytes], kept: list) -> list[pa.Array]:
    done = [cut(t, k) for t, k in zip(texts, kept, strict=True)]
    columns = [place, [len(t) for t in texts], [len(t) - len(d) for t, (d, _) in zip(texts, done, strict=True)], [s for _, s in done]]
    return [*(pa.array(c, pa.int64()) for c in columns), pa.array([hashlib.sha256(d).hexdigest() for d, _ in done], pa.string())]


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    placed, bits, twins = _positions(docs)
    low = (1 << bits) - 1
    found = anchor_rows(placed, bits).repartition("gram")
    if twins:
        first = _first(found, ["gram", "around"], "sides")
    else:
        first = found.groupBy("gram", "around").agg(F.min("at").alias("at"), F.max("sides").alias("sides"))
    shared = first.withColumn("others", F.count(F.lit(1)).over(Window.partitionBy("gram")).cast("int"))
    per_doc = by_document(shared, bits)
    joined = placed.select("doc_id", "place", "twin", "text").join(per_doc, ["place", "twin"], "left")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in open_schema]
        for batch in slices(batches, "text", _CHUNK):
            doc_id, place, twin, text, alone, open_ = (batch.column(c) for c in ("doc_id", "place", "twin", "text", "alone", "open"))
            texts = [t.encode() for t in text.to_pylist()]
            bounds, packed = _lists(alone)
            _, start, count = _sides(packed.to_numpy(False))
            kept = [list(zip(start[a:b].tolist(), count[a:b].tolist(), strict=True)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            bounds, items = _lists(open_)
            gram, crowded, sides = items.field("gram"), items.field("crowded"), items.field("packed").to_numpy(False)
            at, start, count = _sides(sides)
            has_open = np.diff(bounds) > 0
            done = np.flatnonzero(~has_open)
            rows = _result(place.take(pa.array(done)).to_pylist(), [texts[i] for i in done], [kept[i] for i in done])
            yield _filled(names, open_schema, len(done), {"doc_id": doc_id.take(pa.array(done)), **dict(zip(["place", "n_bytes", "n_removed", "n_spans", "kept_sha256"], rows, strict=True))})
            wait = np.flatnonzero(has_open)
            flat = [pa.array([list(x) for x in zip(*kept[i], strict=True)] if kept[i] else [[], []], pa.list_(pa.int32())) for i in wait]
            yield _filled(names, open_schema, len(wait), {
                "doc_id": doc_id.take(pa.array(wait)), "place": place.take(pa.array(wait)), "twin": twin.take(pa.array(wait)), "text": text.take(pa.array(wait)),
                "first": pa.array([f[0].as_py() for f in flat], pa.list_(pa.int32())), "count": pa.array([f[1].as_py() for f in flat], pa.list_(pa.int32())),
            })
            owner = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            where = place.to_numpy()[owner] << bits | at
            pieces = [texts[r][a : a + n + WINDOW - 1] for r, a, n in zip(owner, start, count, strict=True)]
            yield _filled(names, open_schema, len(owner), {
                "gram": gram, "at": pa.array(where, pa.int64()), "sides": pa.array((sides & 0xFFFF).astype(np.int32)), "twin": twin.take(pa.array(owner)),
                "piece": pa.array(pieces, pa.binary()), "crowded": crowded,
            })

    kind = docs.schema["doc_id"].dataType.simpleString()
    open_ddl = f"doc_id {kind}, {_RESULT}, twin long, text string, first array<int>, count array<int>, gram long, at long, sides int, piece binary, crowded boolean"
    open_schema = _arrow_fields(docs.sparkSession, open_ddl)
    stepped = materialize(joined.mapInArrow(split, open_ddl))
    results = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    done = stepped.where("kept_sha256 is not null").select(results)
    pieces = stepped.where("piece is not null")
    quiet = pieces.where("not crowded").select("gram", "at", "sides", "twin", "piece").repartition("gram").sortWithinPartitions("gram")
    stay = sorted_windows(quiet).union(hashed_windows(pieces.where("crowded"), twins))
    stay = stay.groupBy(F.shiftright("start", bits).alias("place"), "twin").agg(F.collect_list(F.col("start").bitwiseAND(low).cast("int")).alias("starts"))
    waiting = stepped.where("text is not null").select("doc_id", "place", "twin", "text", "first", "count").join(stay, ["place", "twin"], "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _CHUNK):
            kept = []
            for first, count, starts in zip(*(batch.column(c).to_pylist() for c in ("first", "count", "starts")), strict=True):
                more = zip(*(x.tolist() for x in _runs(np.sort(np.array(starts)))), strict=True) if starts else ()
                kept.append([*zip(first, count, strict=True), *more])
            rows = _result(batch.column("place").to_pylist(), [t.encode() for t in batch.column("text").to_pylist()], kept)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *rows[1:]], names=results)

    shape = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    rest = waiting.mapInArrow(finish, shape)
    size = F.octet_length("text").cast("long")
    nameless = docs.where("doc_id is null").select("doc_id", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    return done.union(rest).union(nameless)


def _arrow_fields(spark, ddl: str) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return list(to_arrow_schema(StructType.fromDDL(ddl)))


def _filled(names: list[str], fields: list[pa.Field], rows: int, given: dict[str, pa.Array]) -> pa.RecordBatch:
    """A batch of all columns; those not given are null."""
    return pa.RecordBatch.from_arrays([given[f.name].cast(f.type) if f.name in given else pa.nulls(rows, f.type) for f in fields], names=names)
