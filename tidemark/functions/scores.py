"""Label scores: reading model replies, trimming, and the nested score map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SCORES, SENTINEL_LABEL
from . import payload
from .text import SPACE

_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INFINITE = r"^[+-]?(?i:inf|infinity)$"
_NAN = r"^(?i:nan)$"


def sentinel() -> Column:
    """One placeholder score, so an attribute is never left without an entry."""
    return F.array(
        F.struct(F.lit(SENTINEL_LABEL).alias("label"), F.lit(0.0).alias("score"))
    ).cast(SCORES)


def no_scores() -> Column:
    return F.array().cast(SCORES)


def _as_number(value: Column) -> Column:
    """A variant number, or text holding one, as a double; NULL otherwise."""
    sort = payload.kind(value)
    number = F.try_variant_get(value, "$", "double")
    text = F.trim(F.try_variant_get(value, "$", "string"))
    finite = F.abs(number) != float("inf")
    return F.when(
        (sort == "BIGINT") | (sort == "DOUBLE") | sort.startswith("DECIMAL"), F.when(finite, number)
    ).when(
        sort == "STRING",
        F.when(text.rlike(_DECIMAL), F.when(F.abs(text.try_cast("double")) != float("inf"), text.try_cast("double")))
        .when(text.rlike(_INFINITE) | text.rlike(_NAN), text.try_cast("double")),
    )


def _pairs(fields: Column) -> Column:
    """map<string,variant> to label/score pairs; the score of what is no number is NULL."""
    return F.transform(
        F.map_entries(fields),
        lambda e: F.struct(e["key"].alias("label"), _as_number(e["value"]).alias("score")),
    ).cast(SCORES)


def _whole(pairs: Column) -> Column:
    """The pairs if there are any and all have a score, else NULL."""
    return F.when((F.size(pairs) > 0) & ~F.exists(pairs, lambda p: p["score"].isNull()), pairs)


def strip_fences(raw: Column) -> Column:
    """Model reply without the code fence some models wrap it in."""
    bare = F.regexp_replace(raw, rf"\A{SPACE}+|{SPACE}+\z", "")
    bare = F.regexp_replace(bare, r"\A```json", "")
    bare = F.regexp_replace(bare, r"\A```", "")
    bare = F.regexp_replace(bare, r"```\z", "")
    return F.regexp_replace(bare, rf"\A{SPACE}+|{SPACE}+\z", "")


def with_label_scores(df: DataFrame, raw: str) -> DataFrame:
    """Adds ``scores`` and ``error`` read from a column of model replies. Accepts
    ``{label: number}``, the same under one outer key, and numbers written as text. Blank
    text gives no scores and no error.

    Each step is a projection of its own, so nothing is parsed twice.
    """
    blank = F.coalesce(F.col(raw), F.lit("")).rlike(rf"\A{SPACE}*+\z")
    as_map = "map<string,variant>"
    sole = F.when(F.size("_fields") == 1, F.element_at(F.map_values("_fields"), 1))
    staged = (
        df.withColumn("_frame", payload.frame_json(strip_fences(F.col(raw))))
        .withColumn("_fields", F.try_variant_get(payload.unframe_json(F.col("_frame")), "$", as_map))
        .withColumn("_flat", _pairs(F.col("_fields")))
        .withColumn("_inner", _pairs(F.try_variant_get(sole, "$", as_map)))
        .withColumn("_found", F.coalesce(_whole(F.col("_flat")), _whole(F.col("_inner"))))
    )
    error = (
        F.when(blank, F.lit(None).cast("string"))
        .when(F.col("_fields").isNull(), "invalid json")
        .when(F.col("_found").isNull(), "reply holds no scores by label")
    )
    return staged.withColumns(
        {"scores": F.when(blank, no_scores()).otherwise(F.col("_found")), "error": error}
    ).drop("_frame", "_fields", "_flat", "_inner", "_found")


def top_scores(scores: Column, cutoff: Column | float, top_n: Column | int) -> Column:
    """Scores at or above the cutoff, best first, at most ``top_n`` (0 or less: all);
    the sentinel when none is left. Equal scores go by label."""
    cutoff = cutoff if isinstance(cutoff, Column) else F.lit(cutoff)
    top_n = top_n if isinstance(top_n, Column) else F.lit(top_n)
    kept = F.filter(scores, lambda s: (s["score"] >= cutoff) & ~F.isnan(s["score"]))
    keyed = F.transform(kept, lambda s: F.struct((-s["score"]).alias("rank"), s["label"].alias("label")))
    ranked = F.transform(
        F.sort_array(keyed),
        lambda s: F.struct(s["label"].alias("label"), (-s["rank"]).alias("score")),
    )
    trimmed = F.when(top_n > 0, F.slice(ranked, F.lit(1), F.greatest(top_n, F.lit(1)))).otherwise(ranked)
    return F.when(F.size(trimmed) > 0, trimmed.cast(SCORES)).otherwise(sentinel())


def cut_data(data: Column, cutoff: float) -> Column:
    """Nested scores at or above the cutoff; attributes left without any are dropped."""
    kept = F.transform_values(data, lambda _, s: F.filter(s, lambda x: x["score"] >= cutoff))
    return F.map_filter(kept, lambda _, s: F.size(s) > 0)


def remove_keys(data: Column, keys: list[str]) -> Column:
    return F.map_filter(data, lambda k, _: ~k.isin(keys)) if keys else data


def add_keys(data: Column, keys: list[str]) -> Column:
    """Give the map these attributes, holding the sentinel; one already there is replaced.
    A NULL map stays NULL."""
    if not keys:
        return data
    fresh = F.create_map(*[x for k in keys for x in (F.lit(k), sentinel())])
    return F.when(data.isNotNull(), F.map_concat(remove_keys(data, keys), fresh))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))
