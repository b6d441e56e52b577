"""Blocked-scan folds equal a plain sequential replay, also when one hot key
spans many range partitions."""

import datetime as dt
import random

import pytest

from vigil.operators.breaker import BreakerMachine, breaker_fold
from vigil.operators.escalation import escalation_fold
from vigil.operators.positions import with_positions

T0 = dt.datetime(2024, 1, 1)


def _seq_breaker(events, threshold=5, cool=dt.timedelta(hours=6)):
    f, dis, at, out = 0, False, None, []
    for ts, seq, failed in events:
        if dis and (at is None or ts - at < cool):
            out.append(("skip", f, dis))
            continue
        if dis:
            f, dis, at = 0, False, None
        if failed:
            f = min(f + 1, threshold)
            if f >= threshold and not dis:
                dis, at = True, ts
                out.append(("trip", f, dis))
                continue
            out.append(("fail", f, dis))
        else:
            f = 0
            out.append(("ok", f, dis))
    return out


@pytest.mark.parametrize("parts", [1, 3, 13])
def test_breaker_hot_key_matches_sequential(spark, parts):
    rng = random.Random(parts)
    ts = T0
    rows = []
    for i in range(600):
        ts += dt.timedelta(minutes=rng.choice([5, 30, 90, 400]))
        rows.append(("hot", "src0", ts, i, rng.random() < 0.65))
    for i in range(40):
        rows.append(("cold", "src1", T0 + dt.timedelta(hours=i), 10_000 + i, i % 3 != 0))
    df = spark.createDataFrame(rows, "topic_name string, adapter string, ts timestamp, seq long, failed boolean")
    trans, final = breaker_fold(df, partitions=parts)
    got = [(r.action.replace("recover_", ""), r.consecutive_failures, r.disabled)
           for r in trans.where("topic_name = 'hot'").orderBy("seq").collect()]
    want = _seq_breaker([(r[2], r[3], r[4]) for r in rows if r[0] == "hot"])
    assert got == want
    fin = {r.topic_name: r for r in final.collect()}
    assert fin["hot"].consecutive_failures == want[-1][1]
    assert fin["hot"].n_events == 600


def test_breaker_init_and_reset(spark):
    attempts = spark.createDataFrame(
        [("t", "a", T0 + dt.timedelta(hours=1), 1, False),
         ("t", "a", T0 + dt.timedelta(hours=7), 2, True)],
        "topic_name string, adapter string, ts timestamp, seq long, failed boolean")
    init = spark.createDataFrame([("t", "a", 5, True, "2024-01-01T00:00:00")],
                                 "topic_name string, adapter string, consecutive_failures int, "
                                 "disabled boolean, disabled_at string")
    trans, final = breaker_fold(attempts, init=init)
    acts = [r.action for r in trans.orderBy("seq").collect()]
    # 1 h after disabling: still cooling down; 7 h after: recovered, then failed once
    assert acts == ["init", "skip", "recover_fail"]
    r = final.collect()[0]
    assert (r.consecutive_failures, r.disabled) == (1, False)


def test_breaker_unknown_disabled_at_stays_disabled(spark):
    attempts = spark.createDataFrame([("t", "a", T0 + dt.timedelta(days=9), 1, False)],
                                     "topic_name string, adapter string, ts timestamp, seq long, failed boolean")
    init = spark.createDataFrame([("t", "a", 5, True, "garbage")],
                                 "topic_name string, adapter string, consecutive_failures int, "
                                 "disabled boolean, disabled_at string")
    trans, _ = breaker_fold(attempts, init=init)
    assert [r.action for r in trans.orderBy("seq").collect()] == ["init", "skip"]


def test_breaker_machine_summary_equals_replay():
    import pandas as pd
    rng = random.Random(7)
    m = BreakerMachine()
    ts = 0
    rows = []
    for i in range(300):
        ts += rng.choice([1, 60, 3600, 5 * 3600]) * 1_000_000
        rows.append(dict(ts_us=ts, seq=i, kind="reset" if rng.random() < 0.02 else "attempt",
                         failed=rng.random() < 0.7, init_failures=None, init_disabled=None,
                         init_at_us=None))
    part = pd.DataFrame(rows)
    summ = m.summarise(part)
    entries = [[c, False, None] for c in range(5)] + [[5, True, None]] + [
        [5, True, rows[0]["ts_us"] - k * 1_000_000] for k in (1, 600, 3 * 3600, 6 * 3600, 9 * 3600)]
    for e in entries:
        assert m.apply(summ, e) == m.run(part, e)[1], e


def _seq_escalation(matches, auto):
    rank = {"low": 0, "medium": 1, "high": 2, "urgent": 3}
    s = None
    for ts, level, hours, tag in matches:
        cur = s
        if cur and auto and ts >= cur[1]:
            cur = None
        if cur is None or rank.get(level, 0) >= rank.get(cur[0], 0):
            s = (level, ts + dt.timedelta(hours=hours), tag)
    return s


@pytest.mark.parametrize("auto", [True, False])
@pytest.mark.parametrize("parts", [1, 5])
def test_escalation_hot_topic_matches_sequential(spark, auto, parts):
    rng = random.Random(11 + parts)
    ts = T0
    rows = []
    for i in range(400):
        ts += dt.timedelta(hours=rng.choice([1, 5, 30]))
        lvl = rng.choice(["low", "medium", "high", "urgent", "bogus"])
        rows.append(("hot", ts, i, lvl, float(rng.choice([1, 12, 48])), f"tag{i % 4}", auto))
    df = spark.createDataFrame(rows, "topic_name string, ts timestamp, seq long, bump_to string, "
                                     "duration_hours double, escalation_trigger string, auto_revert boolean")
    _, final = escalation_fold(df, partitions=parts)
    got = final.collect()[0]
    want = _seq_escalation([(r[1], r[3], r[4], r[5]) for r in rows], auto)
    assert (got.bumped_to, got.expires_at.replace(tzinfo=None), got.trigger_tag) == want


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_positions_hot_key(spark, parts):
    rows = [("hot" if i % 10 else f"k{i % 7}", i, (i * 37) % 101) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, id long, v long")
    from pyspark.sql import functions as F
    out = with_positions(df, ["k"], [F.col("v").desc(), F.col("id")], partitions=parts)
    got = {r.id: r.pos for r in out.collect()}
    for key in {r[0] for r in rows}:
        grp = sorted([r for r in rows if r[0] == key], key=lambda r: (-r[2], r[1]))
        for i, r in enumerate(grp, 1):
            assert got[r[1]] == i


def test_replay_of_many_keys_is_a_frame_per_batch():
    """Keys with few events cost no frame each; keys go on from batch to batch."""
    import json

    import pandas as pd

    from vigil.operators.folds import replay
    from vigil.operators.seen_state import DAY_US, SeenMachine

    m = SeenMachine({"x": 1}, 1)
    rows = [(f"u{i // 3:05d}", (i % 3) * DAY_US, i, "item", "x", None) for i in range(3000)]
    pdf = pd.DataFrame(rows, columns=m.input_columns(["url"]))
    pdf["entry"] = [json.dumps([-DAY_US, "x"]) if i < 3 else None for i in range(3000)]
    batches = [pdf.iloc[i:i + 700].reset_index(drop=True) for i in range(0, 3000, 700)]
    names = ["url", "ts_us", "seq", "action", "seen_us", "stype"]
    frames = list(replay(iter(batches), ["url"], m, names))
    assert [len(f) for f in frames] == [len(b) for b in batches]
    got = pd.concat(frames)
    assert got["seq"].tolist() == list(range(3000))
    assert got["action"].tolist() == ["seen", "pass", "seen"] + ["pass", "seen", "pass"] * 999
