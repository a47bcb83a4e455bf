"""Declarative views: each panel names a query, rendering gives one lazy DataFrame per panel."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import metrics as m
from ..operators import points, rates
from ..specs import Range, resolve_range


@dataclass(frozen=True)
class Query:
    kind: str
    classification: str = ""
    label: str = ""
    labels: tuple[str, ...] = ()
    attribute: str = ""
    cutoff: float = 0.0
    range: Range | None = None
    range_b: Range | None = None
    limit: int = 0
    format: str = ""
    target: str = ""
    variant: str = ""


@dataclass(frozen=True)
class Panel:
    id: str
    query: Query
    x: int = 0
    y: int = 0
    w: int = 0
    h: int = 0
    title: str = ""


@dataclass(frozen=True)
class View:
    slug: str
    title: str
    panels: tuple[Panel, ...] = ()
    id: str = ""

    @classmethod
    def from_dict(cls, spec: dict) -> View:
        """From the stored form; unknown keys are ignored."""

        def known(kind, values: dict) -> dict:
            return {k: v for k, v in values.items() if k in kind.__dataclass_fields__}

        panels = []
        for p in spec.get("panels") or ():
            q = known(Query, p["query"])
            for name in ("range", "range_b"):
                if q.get(name) is not None:
                    q[name] = Range(**known(Range, q[name]))
            if "labels" in q:
                q["labels"] = tuple(q["labels"] or ())
            panels.append(Panel(**{**known(Panel, p), "query": Query(**q)}))
        return cls(**{**known(cls, spec), "panels": tuple(panels)})


@dataclass(frozen=True)
class Tables:
    """What panels read."""

    metrics: DataFrame
    classifications: DataFrame
    articles: DataFrame
    sources: DataFrame
    label_axis: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Rendered:
    """A panel with its data, or with the reason there is none."""

    panel: Panel
    data: DataFrame | None = None
    error: str = ""
    variant: str = ""
    format: str = ""


class QueryError(ValueError):
    """A panel query that cannot be answered."""


def _bounds(r: Range | None, t: Tables, as_of: dt.datetime) -> tuple[str, str]:
    """The range's bounds, refused here if they are no times: a panel that fails only when it is
    read would fail a view that reads its panels together."""
    bounds = resolve_range(r, as_of)
    for text in filter(None, bounds):
        read = t.metrics.sparkSession.sql("SELECT try_cast(:bound AS TIMESTAMP) AS time", {"bound": text})
        if read.first()["time"] is None:
            raise QueryError(f"no time can be read from {text!r}")
    return bounds


def _heatmap(q: Query, t: Tables, as_of: dt.datetime) -> DataFrame:
    start, end = _bounds(q.range, t, as_of)
    return m.heatmap(t.metrics, q.classification, label=q.label, start=start, end=end)


def _treemap(q: Query, t: Tables, as_of: dt.datetime) -> DataFrame:
    start, end = _bounds(q.range, t, as_of)
    return m.treemap(
        t.metrics, q.classification, category=q.attribute, cutoff=q.cutoff, start=start, end=end
    )


def _point_options(q: Query, t: Tables, as_of: dt.datetime) -> dict:
    start, end = _bounds(q.range, t, as_of)
    return {"category": q.attribute, "labels": q.labels, "cutoff": q.cutoff, "start": start, "end": end}


def _scatter(q: Query, t: Tables, as_of: dt.datetime) -> DataFrame:
    return points.scatter_points(t.metrics, t.articles, q.classification, **_point_options(q, t, as_of))


def _scatter3d(q: Query, t: Tables, as_of: dt.datetime) -> DataFrame:
    return points.scatter3d_points(
        t.metrics, t.articles, t.label_axis, q.classification, **_point_options(q, t, as_of)
    )


def _spark(q: Query, t: Tables, as_of: dt.datetime) -> DataFrame:
    fmt = "month" if q.range is not None and q.range.unit == "month" else "day"
    return rates.article_rate(t.articles, fmt, as_of).selectExpr("index", "count AS value")


def _list(q: Query, t: Tables, as_of: dt.datetime) -> DataFrame:
    if q.variant == "source":
        return rates.sources_scan(t.sources)
    if q.variant in ("article", ""):
        return rates.recent_articles(t.articles)
    raise QueryError(f"no such list: {q.variant!r}")


def _stats(q: Query, t: Tables, as_of: dt.datetime) -> DataFrame:
    if q.target not in ("classification_count", ""):
        raise QueryError(f"no such number: {q.target!r}")
    return m.classification_count(t.classifications, q.classification, *_bounds(q.range, t, as_of))


def _quadrant(q: Query, t: Tables, as_of: dt.datetime) -> DataFrame:
    if q.range_b is None:
        raise QueryError("a quadrant compares two ranges; the second is missing")
    periods = _bounds(q.range, t, as_of), _bounds(q.range_b, t, as_of)
    return m.quadrant(t.metrics, q.classification, q.label, *periods)


def _unbuilt(q: Query, t: Tables, as_of: dt.datetime) -> DataFrame:
    raise QueryError(f"panels of kind {q.kind!r} cannot be drawn")


PANELS: dict[str, Callable[[Query, Tables, dt.datetime], DataFrame]] = {
    "heatmap": _heatmap,
    "treemap": _treemap,
    "scatter": _scatter,
    "scatter3d": _scatter3d,
    "spark": _spark,
    "list": _list,
    "stats": _stats,
    "quadrant": _quadrant,
    "status": _unbuilt,
    "tree": _unbuilt,
}

_DEFAULT_VARIANT = {"spark": "line", "list": "article"}


def run_query(q: Query, tables: Tables, as_of: dt.datetime) -> DataFrame:
    if q.kind not in PANELS:
        raise QueryError(f"no such panel kind: {q.kind!r}")
    return PANELS[q.kind](q, tables, as_of)


def render(view: View, tables: Tables, as_of: dt.datetime) -> list[Rendered]:
    """Every panel in order. A panel that cannot be answered carries its error; the others
    are not affected. Nothing runs until a panel's data is read, and each panel keeps its
    own pushed-down predicates."""
    out = []
    for panel in view.panels:
        q = panel.query
        try:
            data = run_query(q, tables, as_of)
        except Exception as problem:  # noqa: BLE001 - one bad panel must not break the view
            out.append(Rendered(panel, error=str(problem)))
            continue
        variant = q.variant or _DEFAULT_VARIANT.get(q.kind, "")
        fmt = (q.format or "n") if q.kind in ("spark", "stats") else ""
        out.append(Rendered(panel, data, variant=variant, format=fmt))
    return out
