"""Plan checks: no Python UDF in any query, no cartesian product."""

import pytest

from parlour.plans import QUERIES

SF = "/root/testdata/sf0.001"
STREAMING = {"stream_net_paid"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMING))
def test_plan_is_jvm_only_and_has_no_cartesian(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "CartesianProduct"):
        assert bad not in plan, (name, bad)
