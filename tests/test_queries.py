"""Every registered query against its SQL, and what its plan must not hold."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_point
from tidemark.plans.oracles import SQL
from tidemark.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

# Those whose feature is running Python.
PYTHON = {"classify_scorer", "near_copies"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def canonical(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            return str(v)
        return f"{float(v):.9g}"

    return sorted(tuple(one(v) for v in r) for r in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert ("Python" in plan or "MapIn" in plan) == (name in PYTHON)
    sql = f"SELECT {', '.join(columns)} FROM ({SQL[name]})"
    assert canonical(df.select(columns).collect()) == canonical(duck.sql(sql).fetchall())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
