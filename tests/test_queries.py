"""Every query against its SQL on the smallest tables, and a look at its plan."""

import math
import re
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    if isinstance(x, (int, float, Decimal)) and not isinstance(x, bool):
        return repr(float(x))
    return str(x)


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


# Queries of the catalog; those of corpus operators have tests of their own.
CATALOG = {n: m for m in entry.MODULES if m.__name__.startswith("rackmeter.catalog") for n in m.QUERIES}


@pytest.mark.parametrize("name", list(CATALOG))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    rows = df.collect()
    assert rows
    assert table(rows, df.columns) == table(cur.fetchall(), names)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|PythonUDF|EvalPython", plan)


def test_every_query_has_sql():
    assert set(CATALOG) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).columns == ["run", "ip", "hour", "cpu_user", "non_idle", "vcore_ratio", "cpu_used", "mem_used"]
