"""Optional predicates: only those asked for reach the plan."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.times import timestamp_literal

Bound = str | dt.datetime | None


def all_of(predicates: Iterable[Column | None]) -> Column:
    return reduce(and_, [p for p in predicates if p is not None], F.lit(True))


def within(column: str | Column, start: Bound, end: Bound) -> Column | None:
    """Both ends inclusive, each optional."""
    column = F.col(column) if isinstance(column, str) else column
    ends = []
    if start:
        ends.append(column >= timestamp_literal(start))
    if end:
        ends.append(column <= timestamp_literal(end))
    return reduce(and_, ends) if ends else None


def one_of(column: str, values: Iterable[str]) -> Column | None:
    values = list(dict.fromkeys(values))
    return F.col(column).isin(values) if values else None


def equals(column: str, value: str | None) -> Column | None:
    return F.col(column) == value if value else None


def named(classification: str | None) -> Column | None:
    """Classification names are stored in lower case."""
    return equals("classification", classification.lower() if classification else None)


def at_least(column: str, cutoff: float | None) -> Column | None:
    return F.col(column) >= cutoff if cutoff is not None else None


def title_like(column: str, text: str) -> Column | None:
    """Case-insensitive substring; ``%`` and ``_`` in the text act as wildcards."""
    return F.col(column).ilike(f"%{text}%") if text else None
