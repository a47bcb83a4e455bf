"""Operator 5: drop lines that stand on too large a share of their site's pages.

Lines are grouped by host; the pages that hold a line are divided by the pages of the host, and
lines above a ratio go. A line that few pages hold is never boilerplate, however small its host.
Everything is DataFrame code: each page counts a line once before the shuffle, counts are
combined before it too, and a page's lines stay in its row, where only the boilerplate
of its site is looked up.

Null, empty and blank texts keep what they hold; blank lines are never dropped. Rows without a
host form one site of their own. Repeated rows are separate pages. Empty tables give
empty results. Extra columns are kept, whatever their names (working columns start with ``__``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATIO = 0.1
MIN_PAGES = 5
# Ends of blocks in html; what stands between two of them is a line.
_BLOCK = r"(?is)</?(?:p|div|br|li|ul|ol|h[1-6]|nav|article|footer|header|section|table|tr|td|title|head|body|html|pre|blockquote)\b[^>]*>"
_HIDDEN = r"(?is)<(?:script\b.*?</script>|style\b.*?</style>|!--.*?-->)"


def html_lines(html: Column) -> Column:
    """The text of a page, one line per block."""
    shown = F.regexp_replace(html, _HIDDEN, "")
    text = F.regexp_replace(F.regexp_replace(shown, _BLOCK, "\n"), r"(?s)<[^>]*>", "")
    spaced = F.regexp_replace(text, r"[ \t\r]{2,}|[\t\r]", " ")
    return F.trim(F.regexp_replace(spaced, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def boilerplate(pages: DataFrame, site: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, distinct: bool = False) -> DataFrame:
    """(__site, __line, on_pages, site_pages): lines on more than ``ratio`` of a site's pages. With ``distinct``, pages of one text count as one.

    A row per line and site that exceeds the ratio, so at most sum(lines of a page) / ratio a site.
    """
    own = F.filter(F.array_distinct(F.transform(F.split(text, "\n"), _trimmed)), lambda x: x != "")
    page = [F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("__page")] if distinct else []
    lines = pages.select(F.coalesce(F.col(site), F.lit("")).alias("__site"), own.alias("__own"), *page)
    one = (lambda df: df.distinct()) if distinct else (lambda df: df)
    total = one(lines.drop("__own")).groupBy("__site").agg(F.count(F.lit(1)).alias("site_pages"))
    line = [F.xxhash64("__line").alias("__h"), F.crc32(F.col("__line").cast("binary")).alias("__c"), F.length("__line").alias("__n")]
    counted = (
        one(lines.select("__site", F.explode("__own").alias("__line"), *[F.col("__page") for _ in page]).select("__site", *line, *[F.col("__page") for _ in page]))
        .groupBy("__site", "__h", "__c", "__n")
        .agg(F.count(F.lit(1)).alias("on_pages"))
        .where(F.col("on_pages") >= min_pages)
    )
    return counted.join(total, "__site").where(F.col("on_pages") > ratio * F.col("site_pages"))


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def drop_boilerplate(pages: DataFrame, site: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, distinct: bool = False) -> DataFrame:
    """The rows of ``pages`` with ``text`` cut, plus ``__lines`` and ``__dropped`` (line counts)."""
    found = boilerplate(pages, site, text, ratio, min_pages, distinct)
    # As text keys: what a page looks its lines up in. One row per site, bounded as above.
    key = F.concat_ws(":", "__h", "__c", "__n")
    per_site = found.groupBy("__site").agg(F.collect_set(key).alias("__bad"))
    kept_of = lambda lines, bad: F.filter(
        lines, lambda x: (_trimmed(x) == "") | ~F.array_contains(bad, F.concat_ws(":", F.xxhash64(_trimmed(x)), F.crc32(_trimmed(x).cast("binary")), F.length(_trimmed(x))))
    )
    joined = pages.withColumn("__site", F.coalesce(F.col(site), F.lit(""))).join(per_site, "__site", "left")
    lines = F.split(text, "\n")
    kept = F.when(F.col("__bad").isNull(), lines).otherwise(kept_of(lines, F.col("__bad")))
    out = joined.withColumn("__kept", kept).withColumn("__lines", F.coalesce(F.size(lines), F.lit(0)))
    out = out.withColumn("__dropped", F.col("__lines") - F.coalesce(F.size("__kept"), F.lit(0)))
    return out.withColumn(text, F.array_join("__kept", "\n")).drop("__site", "__bad", "__kept")
