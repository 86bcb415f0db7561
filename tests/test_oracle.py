"""Every registered query against its DuckDB oracle on the smallest driver tables."""

from datetime import date, datetime

import pytest
from final_plan import nested_loop_rows

from parlour.functions.listing import ORDERS
from parlour.plans import ORACLE, QUERIES
from parlour.plans.check import compare, duck

SF = "/root/testdata/sf0.001"


def _number(v):
    return v.timestamp() if isinstance(v, datetime) else v.toordinal() if isinstance(v, date) else v or 0


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    r = compare(df, con, ORACLE[name])
    assert r["ok"], r
    assert "type_mismatch" not in r, r
    # the plan as it ran: no pairing of whole tables
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()
    assert all(n <= 1 for n in nested_loop_rows(df)), nested_loop_rows(df)
    if name in ORDERS:
        keys = [[(v is not None, -_number(v)) if c.startswith("-") else (v is None, v) for c in ORDERS[name] for v in [row[c.lstrip("-")]]] for row in df.collect()]
        assert keys == sorted(keys)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_oracle(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
