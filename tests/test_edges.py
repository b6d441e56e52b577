"""Edge cases: stored escalation state at the start of the fold, and
positions over NULL keys spread across partitions."""

import datetime as dt

from pyspark.sql import functions as F

from vigil.operators.escalation import escalation_fold
from vigil.operators.positions import with_positions

T0 = dt.datetime(2024, 1, 10)


def test_stored_escalation_blocks_lower_bumps_until_expiry(spark):
    init = spark.createDataFrame([("t", "urgent", "2024-01-10T12:00:00", "big", True)],
                                 "topic_name string, bumped_to string, expires_at string, "
                                 "trigger_tag string, auto_revert boolean")
    m = spark.createDataFrame(
        [("t", T0 + dt.timedelta(hours=1), 1, "high", 24.0, "a", True),    # blocked: urgent active
         ("t", T0 + dt.timedelta(hours=13), 2, "low", 24.0, "b", True)],   # urgent expired → set
        "topic_name string, ts timestamp, seq long, bump_to string, duration_hours double, "
        "escalation_trigger string, auto_revert boolean")
    trans, final = escalation_fold(m, init=init)
    acts = [r.action for r in trans.orderBy("seq").collect()]
    assert acts == ["init", "ignore", "set"]
    r = final.collect()[0]
    assert (r.bumped_to, r.trigger_tag) == ("low", "b")


def test_positions_null_keys(spark):
    rows = [(None if i % 3 == 0 else "k", i) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, v long")
    out = with_positions(df, ["k"], [F.col("v")], partitions=5)
    got = {r.v: r.pos for r in out.collect()}
    for key in (None, "k"):
        vs = sorted(v for k, v in rows if k == key)
        assert [got[v] for v in vs] == list(range(1, len(vs) + 1))
