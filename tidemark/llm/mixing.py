"""Operator 8: mix sources to target weights with the cube method of balanced sampling.

A source's target is its share of all words by weight, at most ``most`` times its own words; what
a full source cannot take goes to the others by weight. A document is taken floor(ratio) times
for sure and once more with the fractional rest as its inclusion probability. The cube method
moves the probabilities of a block through the null space of its constraints (words and documents),
so that both totals stay as they are, until all but two are 0 or 1. The two left of each block
meet in the next round, block by block, until each source has two at most: these land on
whichever of the outcomes lies nearest to the totals.

Blocks are ranges of a hash of the row, so a hot source is many blocks, and reruns agree. Null
texts have size 0. Null sources are a source of their own, last. Rows equal in id, source and text are told apart by
a number: of c copies with fraction p, floor(c p) are taken once more for sure and the fraction of c p is
the probability of one other, so any two are taken equally often or once apart. Documents of size 0 are never
taken. An empty table gives an empty result, one without words takes nothing. Extra
columns are kept, whatever their names (working columns start with ``__``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, materialize

BLOCK = 2000
MOST = 3
# Parts that the copies of one row are numbered in.
SPREAD = 64
_EPS = 1e-9


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], most: float = MOST) -> dict[str | None, float]:
    """Words each source should give: weights 1, 2, 3 repeating in order of name, null last."""
    own = dict(sizes)
    names = sorted((s for s in own if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] * (None in own)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = float(sum(own.values())), set()
    while True:
        rest = total - sum(most * own[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        out = {s: float(most * own[s]) if s in full else rest * weight[s] / free for s in names}
        above = {s for s in names if s not in full and out[s] > most * own[s]}
        if not above:
            return out
        full |= above


def flight(p: np.ndarray, words: np.ndarray, docs: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities until at most two are fractional, keeping p @ words and p @ docs.

    Three units and two constraints leave one direction, the cross product of the constraints.
    Each move ends with a unit at 0 or 1; it goes either way with the chances that
    keep every unit's expectation.
    """
    p = p.copy()
    active: list[int] = []
    for i in np.flatnonzero((p > _EPS) & (p < 1 - _EPS)):
        active.append(int(i))
        while len(active) == 3:
            v, w, d = p[active], words[active], docs[active]
            w = w / max(np.abs(w).max(), 1e-300)
            u = np.cross(w, d / d.max())
            if np.abs(u).max() < 1e-12:  # both constraints say the same
                u = np.array([d[1], -d[0], 0.0])
            u = u / np.abs(u).max()
            rising, falling = u > 1e-12, u < -1e-12
            up = min([*((1 - v) / np.where(rising, u, 1))[rising], *(v / np.where(falling, -u, 1))[falling]])
            down = min([*(v / np.where(rising, u, 1))[rising], *((1 - v) / np.where(falling, -u, 1))[falling]])
            v = v + up * u if rng.random() * (up + down) < down else v - down * u
            p[active] = np.where(v < _EPS, 0.0, np.where(v > 1 - _EPS, 1.0, v))
            active = [j for j in active if 0 < p[j] < 1]
    return p


def land(p: np.ndarray, words: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Round the last fractional units (two at most) to the nearest totals."""
    left = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    w, d = words[left] / max(words.max(initial=0), 1), docs[left] / max(docs.max(initial=0), 1)
    choices = [np.array([c >> k & 1 for k in range(len(left))], float) for c in range(1 << len(left))]
    off = [abs(w @ (c - p[left])) + 0.01 * abs(d @ (c - p[left])) for c in choices]
    out = np.round(p)
    out[left] = choices[int(np.argmin(np.round(off, 12)))]
    return out


def _fly(frame: pd.DataFrame) -> pd.DataFrame:
    """One block of one source."""
    frame = frame.sort_values("key", ignore_index=True)
    words = frame["size"].to_numpy(float)
    docs = np.ones(len(frame))
    rng = np.random.default_rng(int(frame["key"].iloc[0]) & (2**63 - 1))
    p = flight(frame["p"].to_numpy(float), words, docs, rng)
    frame["p"] = land(p, words, docs) if (frame["blocks"] == 1).all() else p
    return frame[["s", "key", "size", "p"]]


def mix(docs: DataFrame, source: str = "source", text: str = "text", most: int = MOST, block: int = BLOCK) -> tuple[Column, DataFrame]:
    """The key of a row of ``docs``, and (key, source_size, target, copies, times) by key: how many rows have the key, and
    how often they are taken in all.

    Per source there is one row of totals on the driver; per document nothing.
    """
    spark = docs.sparkSession
    key = F.xxhash64(F.col("doc_id"), F.col(source), F.col(text))
    units = docs.select(F.col(source).alias("s"), key.alias("key"), word_count(text).alias("size"))
    units = materialize(units.groupBy("s", "key", "size").agg(F.count(F.lit(1)).alias("copies")))
    sizes = [(r["s"], r["n"]) for r in units.groupBy("s").agg(F.sum(F.col("size") * F.col("copies")).alias("n")).collect()]
    goal = targets(sizes, most) if sizes else {}
    totals = spark.createDataFrame(
        [(s, n, goal[s], min(float(most), goal[s] / n) if n else 0.0) for s, n in sizes],
        "s string, source_size long, target double, ratio double",
    )
    of = lambda right: F.col("a.s").eqNullSafe(right["s"])
    units = units.alias("a").join(F.broadcast(totals), of(totals)).select("a.*", "source_size", "target", "ratio")
    part = F.col("ratio") - F.floor("ratio")
    units = units.withColumn("base", F.when(F.col("size") > 0, F.floor(F.col("ratio") + _EPS)).otherwise(0).cast("int"))
    # What all copies of a row are to get beyond the base, for sure and by chance.
    extra = F.when((F.col("size") > 0) & (part > _EPS) & (part < 1 - _EPS), part * F.col("copies")).otherwise(0.0)
    units = units.withColumn("extra", extra).withColumn("sure", F.floor(F.col("extra") + _EPS))
    chance = F.col("extra") - F.col("sure")
    units = units.withColumn("p", F.when((chance > _EPS) & (chance < 1 - _EPS), chance).otherwise(0.0))
    left = units.where("p > 0").select("s", "key", "size", "p")
    decided = spark.createDataFrame([], "key long, more int")
    while True:
        # What is left of many blocks meets in fewer; a source with one block lands there.
        counts = left.groupBy("s").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("blocks")).collect()
        if not counts:
            break
        counts = spark.createDataFrame(counts, "s string, blocks long")
        dealt = left.alias("a").join(F.broadcast(counts), of(counts)).select("a.*", "blocks")
        slot = F.pmod("key", "blocks").alias("slot")
        moved = materialize(dealt.groupBy("s", slot).applyInPandas(_fly, "s string, key long, size long, p double"))
        decided = decided.union(moved.where(f"p <= {_EPS} or p >= 1 - {_EPS}").select("key", F.round("p").cast("int").alias("more")))
        left = moved.where(f"p > {_EPS} and p < 1 - {_EPS}")
    times = F.col("base") * F.col("copies") + F.col("sure") + F.coalesce("more", F.lit(0))
    return key, units.join(decided, "key", "left").select("key", "source_size", "target", "copies", times.alias("times"))


def shared(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` that carry their key's ``__copies`` and ``__times``, with ``__own``, how often each row itself is taken.

    Only rows whose copies are taken unequally are numbered: within a spread of SPREAD parts of a key, after the
    rows of the parts before, so that no task numbers all copies of one document.
    """
    even = F.pmod("__times", "__copies") == 0
    each = F.floor(F.col("__times") / F.col("__copies"))
    plain = rows.where(even).withColumn("__own", each)
    uneven = materialize(rows.where(~even).withColumn("__place", F.monotonically_increasing_id()))
    uneven = uneven.withColumn("__part", F.pmod("__place", F.lit(SPREAD)))
    held = uneven.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(key).orderBy("__part")) - F.col("__n")
    starts = held.select(key, "__part", before.alias("__before"))
    nth = F.row_number().over(Window.partitionBy(key, "__part").orderBy("__place")) + F.col("__before")
    numbered = uneven.join(starts, [key, "__part"]).withColumn("__own", each + (nth <= F.pmod("__times", "__copies")).cast("long"))
    return plain.unionByName(numbered.select(plain.columns))


def mixed(docs: DataFrame, source: str = "source", text: str = "text", most: int = MOST) -> DataFrame:
    """Documents of the mix, a row for each time one is taken; the columns of ``docs``."""
    key, times = mix(docs, source, text, most)
    wanted = times.where("times > 0").select(F.col("key").alias("__key"), F.col("copies").alias("__copies"), F.col("times").alias("__times"))
    chosen = shared(docs.withColumn("__key", key).join(wanted, "__key"), "__key").where("__own > 0")
    return chosen.withColumn("__nth", F.explode(F.sequence(F.lit(1).cast("long"), "__own"))).select(docs.columns)
