"""The driver contract: entry() runs on sf0.001, oracles map onto queries."""

import __spark_entry__ as entry_module


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0
    assert {"run_day", "topic_name", "fetched", "new", "scored", "passed"} <= set(df.columns)


def test_oracles_have_queries():
    q, o = entry_module.queries(), entry_module.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100
    assert all(isinstance(v, str) and "->" not in v for v in o.values())
