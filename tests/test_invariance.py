"""Results do not depend on the number of shuffle partitions."""

import pytest

from tests.conftest import SF_SMALL
from vigil.plans import registry

registry.load_all()
NAMES = ["highlights_ranked", "digest_items", "breaker_state", "budget_allocation",
         "dedup_within_run", "index_top100"]


def _rows(spark, name):
    return sorted(tuple(r) for r in registry.QUERIES[name](spark, SF_SMALL).collect())


@pytest.mark.parametrize("name", NAMES)
def test_same_result_under_1_7_and_8_partitions(spark, name):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for n in ("1", "7", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(_rows(spark, name))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1] == results[2]
