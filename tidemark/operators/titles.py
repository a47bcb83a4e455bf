"""Title search by trigrams: which articles can hold a piece of text, without reading their titles.

The index has a row per article and distinct trigram of its lower-cased title, sorted by trigram, so that a
search reads the row groups of the trigrams it asks for and no others. Articles that hold all trigrams of the needle are the candidates;
``ilike`` decides on those alone. Candidates are never too few: a title that matches holds every trigram of
every literal stretch of the needle. A needle without a stretch of three letters has no trigrams, and is searched for without the index.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .predicates import all_of, title_like

GRAM = 3
# Only these fold to lower case the same way everywhere, so only stretches of them are asked for.
_STRETCH = re.compile(r"[\x20-\x7e]+")


def trigram_index(articles: DataFrame) -> DataFrame:
    """(gram, article_id) of articles (id, title), in ranges of gram."""
    low = F.lower("title")
    starts = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    grams = F.array_distinct(F.transform(starts, lambda at: low.substr(at, F.lit(GRAM))))
    rows = articles.filter("title IS NOT NULL").select(F.explode(grams).alias("gram"), F.col("id").alias("article_id"))
    # A common trigram spreads over ranges, as the id is part of the order.
    return rows.repartitionByRange("gram", "article_id").sortWithinPartitions("gram", "article_id")


def needle_grams(needle: str) -> list[str]:
    """Trigrams any title that matches must hold. ``%`` and ``_`` are wildcards; a backslash takes the next character as it is."""
    stretches, now = [], ""
    i = 0
    while i < len(needle):
        c = needle[i]
        if c == "\\" and i + 1 < len(needle):
            i += 1
            now += needle[i]
        elif c in "%_":
            stretches.append(now)
            now = ""
        else:
            now += c
        i += 1
    pieces = [piece.lower() for stretch in [*stretches, now] for piece in _STRETCH.findall(stretch)]
    return list(dict.fromkeys(piece[at : at + GRAM] for piece in pieces for at in range(len(piece) - GRAM + 1)))


def candidates(index: DataFrame, needle: str) -> DataFrame | None:
    """article_id of the articles that hold all trigrams of the needle; None where it has none."""
    grams = needle_grams(needle)
    if not grams:
        return None
    # An article has a trigram once, so counting rows counts trigrams.
    held = index.filter(F.col("gram").isin(grams)).groupBy("article_id").agg(F.count(F.lit(1)).alias("held"))
    return held.filter(F.col("held") == len(grams)).select("article_id")


def titled(articles: DataFrame, needle: str, index: DataFrame | None = None) -> DataFrame:
    """Articles whose title matches, found through the index where there is one and the needle allows."""
    found = None if index is None or not needle else candidates(index, needle)
    if found is not None:
        articles = articles.join(found, articles["id"] == found["article_id"], "left_semi")
    return articles.filter(all_of([title_like("title", needle)]))
