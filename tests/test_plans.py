"""Plan checks: no cross products or nested-loop joins anywhere; capped
top-k per group is planned as a WindowGroupLimit (partial, before the
shuffle)."""

import pytest

from tests.conftest import SF_SMALL
from vigil.plans import registry

registry.load_all()
# queries that run a streaming job or a checkpoint while being built
SIDE_EFFECT = {n for n in registry.QUERIES if n.startswith("stream_")}
NAMES = sorted(set(registry.QUERIES) - SIDE_EFFECT)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_products(spark, name):
    plan = _plan(registry.QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_index_top_uses_window_group_limit(spark):
    df = registry.QUERIES["index_top100"](spark, SF_SMALL)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in final


def test_filters_reach_the_scan(spark):
    from pyspark.sql import functions as F
    from vigil.sources import fixtures as fx
    df = fx.table(spark, SF_SMALL, "events").where(F.col("event_id") % 15 == 0).select("event_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint>" in plan
