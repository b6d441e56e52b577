"""Sources of one table share the shuffle that gathers its payloads."""

from tests.conftest import SF_SMALL
from vigil.plans import registry
from vigil.sources.landing import pack

registry.load_all()


def test_sources_of_a_table_pack_it_once(spark):
    names = ["norm_gdelt", "norm_rss", "norm_youtube"]  # all of events
    parts = [registry.QUERIES[n](spark, SF_SMALL).select("payload_id", "url") for n in names]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    both.collect()
    final = both._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") == 2


def test_packed_rows_are_in_key_order(spark):
    rows = spark.createDataFrame([(k, f"v{k}") for k in (23, 9, 4, 21, 0, 20)], "k long, v string")
    got = {r.payload_id: [(x.k, x.v) for x in r.rows] for r in pack(rows, "k", ["v"]).collect()}
    assert got == {0: [(0, "v0"), (4, "v4"), (9, "v9")], 20: [(20, "v20"), (21, "v21"), (23, "v23")]}
