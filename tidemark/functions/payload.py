"""Reading fields out of JSON payloads by dot-path.

Paths are columns, so one plan serves any number of sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import times

_END = "~end~"


def frame_json(body: Column) -> Column:
    """The text read as the first item of a two-item array. The JSON reader stops after the
    first value; framed, whatever follows that value is a syntax error."""
    return F.try_parse_json(F.concat(F.lit("["), body, F.lit(f',"{_END}"]')))


def unframe_json(framed: Column) -> Column:
    sole = (F.try_variant_get(framed, "$[1]", "string") == _END) & F.try_variant_get(
        framed, "$[2]", "variant"
    ).isNull()
    return F.when(sole, F.try_variant_get(framed, "$[0]", "variant"))


def with_json(df: DataFrame, body: str, name: str) -> DataFrame:
    """Adds the VARIANT of a text column holding exactly one JSON value, else NULL."""
    return (
        df.withColumn("_frame", frame_json(F.col(body)))
        .withColumn(name, unframe_json(F.col("_frame")))
        .drop("_frame")
    )


def kind(value: Column) -> Column:
    """STRING, BIGINT, DECIMAL(..), DOUBLE, BOOLEAN, VOID, ARRAY<..> or OBJECT<..>."""
    return F.schema_of_variant(value)


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "struct<x: variant>").isNotNull()


def variant_path(path: str | Column) -> Column:
    """``a.b`` as a variant path. Keys hold no dots; an empty path leads nowhere. Make
    columns of these where the paths are kept, one per source, not one per payload."""
    path = F.lit(path) if isinstance(path, str) else path
    steps = F.transform(
        F.split(path, r"\.", -1),
        lambda k: F.when(F.contains(k, F.lit("'")), F.concat(F.lit('["'), k, F.lit('"]'))).otherwise(
            F.concat(F.lit("['"), k, F.lit("']"))
        ),
    )
    reachable = (path != "") & ~path.rlike(r"(^|\.)(\.|$)") & ~path.rlike("'[^.]*\"|\"[^.]*'")
    return F.when(reachable, F.concat(F.lit("$"), F.concat_ws("", steps)))


def items_path(path: Column) -> Column:
    """Like :func:`variant_path`; an empty path or ``$`` is the payload itself."""
    return F.when(F.coalesce(path, F.lit("")).isin("", "$"), "$").otherwise(variant_path(path))


def string_leaf(found: Column) -> Column:
    """A JSON string as text; NULL for anything else (numbers are not turned into text)."""
    return F.when(kind(found) == "STRING", F.try_variant_get(found, "$", "string"))


def with_strings(df: DataFrame, value: str, paths: dict[str, Column]) -> DataFrame:
    """Adds the string at each variant path, NULL where there is none."""
    found = df.withColumns({f"_at_{n}": F.try_variant_get(value, p, "variant") for n, p in paths.items()})
    return found.withColumns({n: string_leaf(F.col(f"_at_{n}")) for n in paths}).drop(
        *[f"_at_{n}" for n in paths]
    )


def with_time(df: DataFrame, value: str, path: Column, name: str) -> DataFrame:
    """Adds the time at a variant path: RFC 3339 text, or an epoch number cut to an integer;
    NULL for anything else."""
    number = F.try_variant_get("_time", "$", "double")
    numeric = F.col("_kind").isin("BIGINT", "DOUBLE") | F.col("_kind").startswith("DECIMAL")
    staged = (
        df.withColumn("_time", F.try_variant_get(value, path, "variant"))
        .withColumns({"_kind": kind(F.col("_time")), "_text": string_leaf(F.col("_time"))})
        .withColumn("_number", F.when(numeric & (F.abs(number) < 9.2e18), number).cast("bigint"))
    )
    stamp = F.coalesce(times.rfc3339(F.col("_text")), times.unix_to_time(F.col("_number")))
    return staged.withColumn(name, stamp).drop("_time", "_kind", "_text", "_number")


def extract_items(value: Column, path: Column) -> Column:
    """``array<variant>`` at a variant path; NULL when there is no array there."""
    return F.try_variant_get(value, path, "array<variant>")
