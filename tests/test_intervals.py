"""Interval join and next-row pass against plain versions, with hot keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vigil.operators.escalation import escalation_fold, escalation_intervals
from vigil.operators.intervals import interval_join
from vigil.operators.positions import with_next

T0 = dt.datetime(2024, 1, 1)
POINT = "topic string, at timestamp, pid long"
SPAN = "topic string, s timestamp, e timestamp, iid long"


def hours(x):
    return T0 + dt.timedelta(hours=x)


def tables(rng, n):
    """Topic "hot" has two thirds of the points; "all" has one interval over
    all bins; some intervals are open, empty, inverted or null."""
    points = [(rng.choice(["hot", "hot", "hot", "hot", "all", "none", None]),
               hours(rng.uniform(0, 900)), i) for i in range(n)] + [("hot", None, n)]
    spans = [("all", hours(-5000), None, 0), ("hot", hours(5), hours(5), 1),
             ("hot", hours(9), hours(3), 2), ("hot", None, hours(30), 3), (None, hours(0), None, 4),
             ("late", hours(2000), None, 5), ("hot", hours(100), None, 6),
             ("hot", hours(-9), hours(0.5), 7), ("hot", hours(899), hours(4000), 8)]
    for i in range(60):
        s = rng.uniform(-10, 900)
        spans.append(("hot", hours(s), hours(s + rng.choice([0.1, 3, 6, 48])), 10 + i))
    points += [("hot", spans[20][1], n + 1), ("hot", spans[20][2], n + 2)]  # both ends
    return points, spans


@pytest.mark.parametrize("width,how", [(6, "left"), (1, "inner"), (500, "left")])
def test_interval_join_equals_brute_force(spark, width, how):
    points, spans = tables(random.Random(width), 400)
    expected = []
    for t, at, pid in points:
        hits = [iid for k, s, e, iid in spans if t is not None and k == t and at is not None
                and s is not None and s <= at and (e is None or at < e)]
        expected += [(pid, i) for i in hits] or ([(pid, None)] if how == "left" else [])
    got = interval_join(spark.createDataFrame(points, POINT).repartition(5),
                        spark.createDataFrame(spans, SPAN), ["topic"], "at", "s", "e", width, how)
    key = lambda r: (r[0], r[1] is not None, r[1] or 0)
    assert sorted(((r.pid, r.iid) for r in got.collect()), key=key) == sorted(expected, key=key)


def test_interval_join_of_nothing(spark):
    points, spans = tables(random.Random(0), 5)
    none, some = spark.createDataFrame([], POINT), spark.createDataFrame(spans, SPAN)
    assert interval_join(none, some, ["topic"], "at", "s", "e").count() == 0
    p = spark.createDataFrame(points, POINT)
    assert interval_join(p, some.limit(0), ["topic"], "at", "s", "e").count() == p.count()


def test_interval_join_is_an_equi_join_over_bins(spark):
    """The hot topic is dealt out by its bins; no loop over pairs."""
    points, spans = tables(random.Random(1), 2000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = interval_join(spark.createDataFrame(points, POINT), spark.createDataFrame(spans, SPAN),
                           ["topic"], "at", "s", "e")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [topic" in plan or "SortMergeJoin [_bin" in plan
        assert "_bin" in plan.split("SortMergeJoin", 1)[1].split("\n", 1)[0]
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        parts = df.where("topic = 'hot'").groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_next_row_of_hot_keys(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.randrange(50), i,
             1_700_000_000_000_001 + i) for i in range(300)] + [("one", 1, 999, 5)]
    expected = {}
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        expected |= {a[2]: b[3] for a, b in zip(mine, mine[1:])} | {mine[-1][2]: None}
    df = spark.createDataFrame(rows, "k string, ts long, seq long, v long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = with_next(df, ["k"], ["ts", "seq"], "v", "nxt", parts).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert {r.seq: r.nxt for r in got} == expected


def test_escalation_intervals(spark):
    """A replacement ends what was in force; a lower bump does not."""
    rows = [("t", hours(0), 1, "high", 48.0, "a", True), ("t", hours(5), 2, "low", 2.0, "b", True),
            ("t", hours(10), 3, "urgent", 1.0, "c", True), ("t", hours(10), 4, "urgent", 3.0, "d", True),
            ("t", hours(20), 5, "low", 4.0, "e", True)]
    m = spark.createDataFrame(rows, "topic_name string, ts timestamp, seq long, bump_to string, "
                              "duration_hours double, escalation_trigger string, auto_revert boolean")
    trans, _ = escalation_fold(m)
    got = sorted((r.trigger_tag, r.start_at, r.end_at) for r in escalation_intervals(trans).collect())
    assert got == [("a", hours(0), hours(10)), ("c", hours(10), hours(10)),
                   ("d", hours(10), hours(13)), ("e", hours(20), hours(24))]
