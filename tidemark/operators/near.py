"""Semantic dedupe: articles whose embedding is near that of an earlier article within a sliding window of time.

Vectors are filed by random hyperplanes: the signs of ``bits`` projections make a band's key, and two vectors are compared
where they share the key of any band. At a cosine c the signs of one plane agree with chance p = 1 - acos(c) / pi,
so a pair is found with chance 1 - (1 - p^bits)^bands; :func:`recall` works it out (0.999 at a cosine of 0.9 for 20 bands of 8
bits, and more above). What is found is compared exactly: nothing below the threshold is ever dropped.

Time is cut into slots as long as the window, and an article is on offer in its own slot and the next. That makes (band, key, slot) an equal
join key, whose groups hold two windows of articles at most, however long the history is. It is a semi join:
an article is done with its first match, so a crowd of copies costs a comparison each, not one a pair.

What is sent for each band are vectors rounded to a byte a component. They bound the cosine from both sides: most pairs are ruled
out or settled by them, and only articles of pairs in between are fetched with their whole vectors and compared again. The result is that of whole
vectors throughout. Streams do send these: the same join, with each side's recent vectors as state by key, which Spark drops as the watermark passes the window.

Articles without a vector, or with one that is zero or not finite, are nobody's copy. Of equal times the lower id is the earlier.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BANDS, BITS = 20, 8


def recall(cosine: float, bands: int = BANDS, bits: int = BITS) -> float:
    """The share of pairs of that cosine that meet in some band."""
    agree = 1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return 1 - (1 - agree**bits) ** bands


def _keys(bands: int, bits: int, seed: int):
    @F.pandas_udf("array<int>")
    def keys(vectors: pd.Series) -> pd.Series:
        out: list[list[int]] = [[]] * len(vectors)
        sizes = vectors.map(len)
        for size, at in sizes.groupby(sizes).groups.items():
            planes = np.random.default_rng([seed, size]).normal(size=(size, bands * bits))
            places = vectors.index.get_indexer(at)
            signs = np.stack([vectors.iloc[i] for i in places]) @ planes >= 0
            made = (signs.reshape(-1, bands, bits) << np.arange(bits)).sum(2)
            for place, row in zip(places, made.tolist(), strict=True):
                out[place] = row
        return pd.Series(out)

    # Else Spark works the keys out once more to drop rows without any.
    return keys.asNondeterministic()


def _units(articles: DataFrame) -> DataFrame:
    """(id, timestamp, v), the vector at length one, of articles that have one."""
    v, length = F.col("embedding").cast("array<double>"), F.col("length")
    sized = articles.select("id", "timestamp", v.alias("v")).withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    # NULL, NaN and infinity all fail the comparison or the bound.
    whole = (length > 0) & (length < F.lit(float("inf")))
    # Named twice, the length stays a column; else Spark moves its sum into the division, for each component.
    return sized.filter(whole).select("id", "timestamp", F.when(whole, F.transform("v", lambda x: x / length)).alias("v"))


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors; NULL where their lengths differ."""
    products = F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: x * y))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def _sides(keyed: DataFrame, window_seconds: int, *carried: str) -> tuple[DataFrame, DataFrame, Column]:
    """Articles as later ones and as earlier ones (``e_``), a row a band, and when two of them are to be compared."""
    slot = F.floor(F.unix_seconds("timestamp") / window_seconds)
    later = keyed.select("id", "timestamp", *carried, F.posexplode("keys").alias("band", "key"), slot.alias("slot"))
    offered = F.explode(F.array(slot, slot + 1)).alias("e_slot")
    earlier = keyed.select(*[F.col(x).alias(f"e_{x}") for x in ("id", "timestamp", *carried)], offered, "keys").select(
        *[f"e_{x}" for x in ("id", "timestamp", *carried, "slot")], F.posexplode("keys").alias("e_band", "e_key")
    )
    window = F.expr(f"INTERVAL {int(window_seconds)} SECONDS")
    meets = (
        (F.col("band") == F.col("e_band"))
        & (F.col("key") == F.col("e_key"))
        & (F.col("slot") == F.col("e_slot"))
        & (F.col("e_timestamp") <= F.col("timestamp"))
        & (F.col("e_timestamp") >= F.col("timestamp") - window)
        & ((F.col("e_timestamp") < F.col("timestamp")) | (F.col("e_id") < F.col("id")))
    )
    return later, earlier, meets


def _rounded(keyed: DataFrame) -> DataFrame:
    """``v`` as ``rounded``, a byte a component, times ``scale``: off by half a ``scale`` at most in each."""
    largest = F.array_max(F.transform("v", F.abs))
    # Lengths that underflow leave vectors that are not of length one. A scale beyond all bounds settles nothing of them.
    scale = F.when(F.abs(cosine(F.col("v"), F.col("v")) - 1) < 1e-6, largest / 127).otherwise(1e30).cast("float")
    scaled = keyed.withColumn("scale", scale)
    return scaled.withColumn("rounded", F.transform("v", lambda x: F.rint(x / F.col("scale")).cast("tinyint"))).drop("v")


def _bounds() -> tuple[Column, Column]:
    """The least and the most the cosine can be, by rounded vectors."""
    a, b = F.col("rounded"), F.col("e_rounded")
    products = F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: x.cast("int") * y.cast("int")))
    about = F.aggregate(products, F.lit(0).cast("bigint"), lambda s, x: s + x) * F.col("scale").cast("double") * F.col("e_scale")
    off, e_off = (F.sqrt(F.size(a)) / 2 * F.col(x).cast("double") for x in ("scale", "e_scale"))
    # |a.b - a'.b'| <= |a - a'| |b| + |a'| |b - b'|; the rest is for the lengths and sums of doubles.
    slack = (off + e_off + off * e_off) * 1.00001 + 1e-5
    return about - slack, about + slack


def _exactly(made: DataFrame, window_seconds: int, threshold: float, keys: Column) -> DataFrame:
    """Near copies by whole vectors, sent for each band; once for each band in which they are found."""
    later, earlier, meets = _sides(made.withColumn("keys", keys), window_seconds, "v")
    return later.join(earlier, meets & (cosine(F.col("v"), F.col("e_v")) >= threshold), "left_semi").select("id", "timestamp")


def near_copies(
    articles: DataFrame, window_seconds: int, threshold: float = 0.9, *, bands: int = BANDS, bits: int = BITS, seed: int = 7
) -> DataFrame:
    """(id, timestamp) of articles (id, timestamp, embedding) with a cosine of ``threshold`` or more to an
    article at most ``window_seconds`` earlier. In a stream, set a watermark on ``timestamp`` first; an
    article may then come once for each of its bands."""
    if window_seconds <= 0:
        raise ValueError("window_seconds must be positive")
    made = _units(articles)
    keys = _keys(bands, bits, seed)("v")
    if articles.isStreaming:
        return _exactly(made, window_seconds, threshold, keys)
    later, earlier, meets = _sides(_rounded(made.withColumn("keys", keys)), window_seconds, "rounded", "scale")
    least, most = _bounds()
    article, e_article = F.struct("id", "timestamp").alias("article"), F.struct("e_id", "e_timestamp").alias("article")
    # What follows reads these rows several times. They are exchanged, and go through a step that Spark does not look into: with filters and
    # columns of its own, each reader would run the join again. The values at the end are aggregates for the same reason.
    maybe = later.join(earlier, meets & (most >= threshold), "left_semi").select("*", article).repartition("article")
    maybe = maybe.mapInArrow(lambda rows: rows, maybe.schema)
    sure = maybe.join(earlier, meets & (least >= threshold), "left_semi").select("article").distinct()
    unsure = maybe.join(sure, "article", "left_anti")
    beside = earlier.join(unsure, meets & (most >= threshold), "left_semi").select(e_article)
    close = unsure.select("article").union(beside).distinct()
    whole = made.withColumn("article", article).join(close, "article", "left_semi").drop("article")
    found = sure.union(_exactly(whole, window_seconds, threshold, keys).select(article)).groupBy("article")
    return found.agg(F.any_value("article.id").alias("id"), F.any_value("article.timestamp").alias("timestamp")).drop("article")


def without_near_copies(articles: DataFrame, window_seconds: int, threshold: float = 0.9, **more) -> DataFrame:
    """Articles that are no near copy of one up to ``window_seconds`` before, dropped or not."""
    copies = near_copies(articles, window_seconds, threshold, **more).select("id").distinct()
    return articles.join(copies, "id", "left_anti").select(*articles.columns)
