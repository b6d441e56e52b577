"""Polls by tier, and escalations that end by the stream's clock."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from vigil.operators import commits
from vigil.operators.escalation import effective_urgency, escalation_events, escalation_fold
from vigil.sources import adapters
from vigil.sources import fixture_payloads as FP
from vigil.streaming import poll_stream as S
from vigil.streaming import tiers as P

T0 = dt.datetime(2024, 1, 1)


def landed(spark, source):
    return FP.landed_feed(spark, SF_SMALL, source) if source in FP.FEEDS else FP.landed(
        spark, SF_SMALL, source)


def land(rows, base, part):
    source = rows.first().source
    rows.where(F.pmod(F.floor(F.col("payload_id") / 10), F.lit(3)) == part).drop("source").write.mode(
        "append").parquet(f"{base}/in/source={source}")


def keys(df):
    return sorted((r.adapter, r.payload_id, r.item_pos, r.url) for r in df.collect())


def expected(spark, sources):
    rows = [adapters.normalise(s, landed(spark, s)).withColumn("adapter", F.lit(s)) for s in sources]
    return sorted(k for r in rows for k in keys(r))


def test_a_source_that_moves_is_read_once(spark):
    base = tempfile.mkdtemp(prefix="vigil-tiers-")
    own = {s: landed(spark, s).drop("source").schema
           for s in ("gdelt", "slickdeals")}  # these land without a source column
    first, moved = ({"gdelt": "a", "slickdeals": "b"}, {"gdelt": "b", "slickdeals": ("a", "b")})
    for part, tiers in enumerate((first, moved, first)):
        for s in tiers:
            land(landed(spark, s), base, part)
        for tier in ("a", "b", "none"):
            P.start_poll(spark, f"{base}/in", f"{base}/state", tier, {**tiers, "arxiv": "a"},
                         schemas=own).awaitTermination()
    assert keys(P.poll_results(spark, f"{base}/state")) == expected(spark, ["gdelt", "slickdeals"])


@pytest.mark.parametrize("at", ["before files", "before manifest"])
def test_a_killed_poll_goes_on_where_it_was(spark, monkeypatch, at):
    base = tempfile.mkdtemp(prefix="vigil-tiers-")
    land(landed(spark, "gdelt"), base, 0)
    schemas = {"gdelt": landed(spark, "gdelt").drop("source").schema}

    def poll():
        P.start_poll(spark, f"{base}/in", f"{base}/state", "a", {"gdelt": "a"},
                     schemas=schemas).awaitTermination()

    poll()
    before = keys(P.poll_results(spark, f"{base}/state"))
    land(landed(spark, "gdelt"), base, 1)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(*((P, "commit") if at == "before files" else (commits, "publish")), dies)
        with pytest.raises(Exception, match="lost"):
            poll()
    assert keys(P.poll_results(spark, f"{base}/state")) == before  # nothing of the dead poll
    land(landed(spark, "gdelt"), base, 2)  # more lands before the restart
    poll()
    poll()  # nothing is left
    assert keys(P.poll_results(spark, f"{base}/state")) == expected(spark, ["gdelt"])


def test_unknown_sources_are_refused(spark):
    with pytest.raises(ValueError, match="nowhere"):
        P.start_poll(spark, "/tmp/x", "/tmp/y", "a", {"nowhere": "a"})


# --- expiry ---------------------------------------------------------------------------

MATCH = ("topic_name string, ts timestamp, seq long, bump_to string, duration_hours double, "
         "escalation_trigger string, auto_revert boolean")


def matches(rng, auto):
    """Topic "quiet" has one match and then never another row."""
    rows = [("quiet", T0 + dt.timedelta(hours=1, microseconds=7), 0, "urgent", 30.0, "q", auto)]
    for i in range(1, 60):
        at = T0 + dt.timedelta(hours=rng.randrange(0, 200), minutes=rng.randrange(60))
        rows.append((rng.choice(["a", "b", "c"]), at, i, rng.choice(["low", "medium", "high", "urgent"]),
                     rng.choice([0.5, 6.0, 24.0, 70.0]), f"tag{i}", auto))
    return rows


@pytest.mark.parametrize("auto", [True, False])
def test_stream_equals_effective_urgency_at_every_clock(spark, auto):
    rows = matches(random.Random(int(auto)), auto)
    topics = spark.createDataFrame([(t, "medium", auto) for t in ("a", "b", "c", "quiet", "none")],
                                   "name string, urgency string, auto_revert boolean")
    base = tempfile.mkdtemp(prefix="vigil-esc-")
    cols = ["topic_name", "ts_us", "seq", "level", "rank", "dur_us", "tag", "auto"]
    df = spark.createDataFrame(rows, MATCH)
    schema = escalation_events(df).select(*cols).schema
    for n, (low, high) in enumerate([(0, 20), (20, 50), (50, 51), (51, 120), (120, 400)]):
        clock = T0 + dt.timedelta(hours=high)
        mine = df.where((F.col("ts") >= T0 + dt.timedelta(hours=low)) & (F.col("ts") < clock))
        escalation_events(mine).select(*cols).write.mode("append").parquet(f"{base}/in")
        spark.createDataFrame([(clock,)], "ts timestamp").write.mode("append").parquet(f"{base}/ticks")
        stream = S.escalation_changes_stream(
            spark.readStream.schema(schema).parquet(f"{base}/in"),
            spark.readStream.schema("ts timestamp").parquet(f"{base}/ticks"))
        S.run_available(stream.writeStream.foreachBatch(S.idempotent_batch_writer(
            f"{base}/out", lambda b, i: b)).option("checkpointLocation", f"{base}/ck"), f"esc{n}{auto}")
        now = S.in_force(spark.read.parquet(f"{base}/out"))
        got = effective_urgency(topics, now.select(
            "topic_name", "bumped_to", F.timestamp_micros("expires_us").alias("expires_at")), T0)
        state = escalation_fold(df.where(F.col("ts") < clock))[1]
        want = effective_urgency(topics, state, clock)
        # the stream has ended what is over, so its own clock needs no other
        over = {r.topic_name for r in now.where("bumped_to is null").collect()}
        expected = {r.name: r.effective_urgency for r in want.collect()}
        assert {r.name: "medium" if r.name in over else r.effective_urgency
                for r in got.collect()} == expected
    assert "quiet" in over
    back = spark.read.parquet(f"{base}/out").where("topic_name = 'quiet'").orderBy("at_us").collect()
    assert [(r.change, r.at_us) for r in back] == [
        ("set", back[0].at_us), ("reverted", back[0].at_us + 30 * 3600 * 1_000_000)]
