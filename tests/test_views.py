import datetime as dt

import pytest

from tidemark.plans.bindings import AS_OF, LABEL_AXIS, Tables
from tidemark.plans.queries import VIEW, _sources
from tidemark.plans.views import QueryError, Query, View, render, run_query
from tidemark.plans.views import Tables as ViewTables
from tidemark.specs import Range, resolve_range


@pytest.fixture(scope="module")
def tables(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    return ViewTables(t.metrics(), t.classifications(), t.articles(), _sources(t), LABEL_AXIS)


def test_ranges():
    now = dt.datetime(2024, 1, 31, 12, 0, 0, 5)
    assert resolve_range(None, now) == ("", "")
    assert resolve_range(Range("day", 2), now) == ("2024-01-29T12:00:00Z", "2024-01-31T12:00:00Z")
    assert resolve_range(Range("week", 1), now)[0] == "2024-01-24T12:00:00Z"
    assert resolve_range(Range("month", 1), now)[0] == "2024-01-01T12:00:00Z"
    assert resolve_range(Range("year", 1), now)[0] == "2023-01-31T12:00:00Z"
    assert resolve_range(Range("day", 2, start="2020-01-01T00:00:00Z"), now) == ("2020-01-01T00:00:00Z", "")
    assert resolve_range(Range("day", 0), now) == ("", "") == resolve_range(Range("", 3), now)


def test_a_bad_panel_does_not_break_the_others(tables):
    shown = {r.panel.id: r for r in render(VIEW, tables, AS_OF)}
    assert len(shown) == len(VIEW.panels)
    assert all((r.data is None) == bool(r.error) == k.startswith("e") for k, r in shown.items())
    assert (shown["p5"].variant, shown["p5"].format, shown["p5"].data.count()) == ("line", "n", 30)
    assert shown["p6"].variant == "article" and shown["p7"].variant == "source"
    assert shown["e1"].error == "a quadrant compares two ranges; the second is missing"


def test_stored_form(tables):
    spec = {
        "slug": "s",
        "title": "t",
        "owner": "ignored",
        "panels": [{"id": "a", "w": 2, "query": {"kind": "treemap", "labels": None, "range": {"unit": "day", "count": 1}, "more": 1}}],
    }
    view = View.from_dict(spec)
    assert view.panels[0].query == Query("treemap", range=Range("day", 1)) and view.panels[0].w == 2
    assert render(view, tables, AS_OF)[0].error == ""


def test_unknown_kind(tables):
    with pytest.raises(QueryError, match="no such panel kind"):
        run_query(Query("pie"), tables, AS_OF)
