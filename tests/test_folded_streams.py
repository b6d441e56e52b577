"""Micro-batches folded by the blocked scan: a key with a third of all rows over
many partitions equals the sequential rule; repeated and dying batches."""

import datetime as dt
import random
import tempfile

import pytest

from vigil.operators import commits
from vigil.operators.breaker import breaker_fold
from vigil.operators.seen_state import DAY_US, seen_fold
from vigil.streaming import folded as FO

T0 = dt.datetime(2024, 1, 1)
ATTEMPT = "topic_name string, adapter string, ts timestamp, seq long, failed boolean"
ITEM = "event_id long, url string, source_type string, ts timestamp"


def attempts(rng, n):
    rows, ts = [], T0
    for i in range(n):
        ts += dt.timedelta(minutes=rng.choice([1, 20, 90]))
        key = ("hot", "a") if i % 3 == 0 else (f"t{rng.randrange(9)}", rng.choice(["a", "b"]))
        rows.append((*key, ts, i, rng.random() < 0.7))
    return rows


def items(rng, n):
    rows, ts = [], T0
    for i in range(n):
        ts += dt.timedelta(hours=rng.choice([0, 1, 20, 60]))
        url = "hot" if i % 3 == 0 else rng.choice([f"u{rng.randrange(20)}", "", None])
        rows.append((i, url, rng.choice(["short", "long", "odd", None]), ts))
    return rows


KEEP = {"short": 2, "long": 30, "news": 5}


def passing(rows):
    seen, out = {}, []
    for i, url, stype, ts in sorted(rows, key=lambda r: (r[3], r[0])):
        if url in seen:
            at, st = seen[url]
            if (ts - at).days <= KEEP.get(st if st is not None else "news", 9):
                continue
        seen[url] = (ts, stype)
        out.append(i)
    return sorted(out), seen


@pytest.mark.parametrize("parts", [1, 5, 13])
def test_seen_fold_of_hot_urls(spark, parts):
    rows = items(random.Random(parts), 400)
    df = spark.createDataFrame(rows, ITEM).repartition(4)
    trans, final = seen_fold(df, None, KEEP, 9, parts)
    expected, state = passing(rows)
    assert sorted(r.seq for r in trans.where("action = 'pass'").collect()) == expected
    assert {r.url: (r.seen_at, r.source_type) for r in final.collect()} == state


def batches(rows, n, at):
    rows = sorted(rows, key=lambda r: r[at])
    step = len(rows) // n + 1
    return [rows[i:i + step] for i in range(0, len(rows), step)]


def test_seen_batches_equal_the_sequential_rule(spark):
    rows = items(random.Random(7), 500)
    base = tempfile.mkdtemp(prefix="vigil-folded-")
    run = FO.seen_batches(base, KEEP, 9, 13)
    for i, part in enumerate(batches(rows, 3, 3)):
        run(spark.createDataFrame(part, ITEM), i)
        run(spark.createDataFrame(part, ITEM), i)  # delivered again
    expected, state = passing(rows)
    assert sorted(r.event_id for r in FO.output(spark, base, FO.PASSED).collect()) == expected
    assert {r.url: (r.seen_at, r.source_type) for r in FO.state(spark, base, FO.SEEN).collect()} == state


def test_breaker_batches_equal_the_batch_fold(spark, monkeypatch):
    rows = attempts(random.Random(5), 600)
    base = tempfile.mkdtemp(prefix="vigil-folded-")
    run = FO.breaker_batches(base, 13)
    for i, part in enumerate(batches(rows, 4, 2)):
        df = spark.createDataFrame(part, ATTEMPT)
        if i == 2:  # dies between its output and its state
            publish, done = commits.publish, []

            def dies(s, path, *a):
                if path.endswith("/state"):
                    raise RuntimeError("lost")
                done.append(path)
                publish(s, path, *a)

            with monkeypatch.context() as m:
                m.setattr(commits, "publish", dies)
                with pytest.raises(RuntimeError):
                    run(df, i)
            assert done
        run(df, i)
    trans, final = breaker_fold(spark.createDataFrame(rows, ATTEMPT), partitions=1)
    key = lambda r: (r.topic_name, r.adapter)
    got = {key(r): r for r in FO.state(spark, base, FO.BREAKER).collect()}
    assert len(got) == final.count()
    for r in final.collect():
        assert {c: got[key(r)][c] for c in FO.BREAKER.names} == {c: r[c] for c in FO.BREAKER.names}
    actions = {r.seq: r.action for r in FO.output(spark, base, FO.BREAKER_CHANGE).collect()}
    assert actions == {r.seq: r.action for r in trans.collect()}


def test_seen_ends_after_whole_days():
    from vigil.operators.seen_state import SeenMachine
    assert SeenMachine({"x": 3}, 1).ends([0, "x"]) == 4 * DAY_US
    assert SeenMachine({"news": 3}, 1).ends([0, None]) == 4 * DAY_US
    assert SeenMachine({"x": 3}, 1).ends([0, "y"]) == 2 * DAY_US


def test_state_function_passes_on_its_frames():
    """The URL-keyed state function builds no frame per URL: rows that pass are
    rows of the frames it got, in any order over several frames."""
    import pandas as pd

    from vigil.streaming import poll_stream as S

    class State:
        exists, hasTimedOut, get, until = False, False, None, None

        def update(self, value):
            self.exists, self.get = True, value

        def setTimeoutTimestamp(self, ms):
            self.until = ms

    def frame(*days):
        return pd.DataFrame({"event_id": list(days), "url": "u", "source_type": "short",
                             "ts": [pd.Timestamp(T0) + pd.Timedelta(days=d) for d in days]})

    fn, state = S._seen_fn(KEEP, 9), State()
    one = frame(0)
    assert next(fn(("u",), iter([one]), state))["event_id"].tolist() == [0]
    late, early = frame(8, 7), frame(3, 2)
    got = list(fn(("u",), iter([late, early]), state))
    assert [f["event_id"].tolist() for f in got] == [[7], [3]]
    assert state.get[0] == int((pd.Timestamp(T0) + pd.Timedelta(days=7)).value // 1000)
    assert state.until == state.get[0] // 1000 + 3 * 86_400_000


class BucketState:
    exists, hasTimedOut, get, until, clock = False, False, None, None, 0

    def update(self, value):
        self.exists, self.get = True, value

    def remove(self):
        self.exists, self.get, self.until = False, None, None

    def setTimeoutTimestamp(self, ms):
        assert ms > self.clock
        self.until = ms

    def getCurrentWatermarkMs(self):
        return self.clock


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_seen_buckets_equal_the_sequential_rule(seed):
    """All URLs of a bucket in one call, hot ones, empty and null ones among them,
    in any order over several frames and batches."""
    import pandas as pd

    from vigil.streaming import poll_stream as S

    rng = random.Random(seed)
    rows = items(rng, 400)
    want, seen = passing(rows)
    fn, state, got = S._seen_bucket_fn(KEEP, 9), BucketState(), []
    for a in range(0, 400, 80):
        part = rows[a:a + 80]  # in order of time from batch to batch
        rng.shuffle(part)
        frames = [pd.DataFrame(part[i:i + 30], columns=S.SEEN_OUT.names) for i in range(0, 80, 30)]
        frames[0]["ts"] = frames[0]["ts"].astype("datetime64[ns]")
        got += [i for f in fn((0,), iter([frames[0].head(0), *frames]), state) for i in f["event_id"]]
    assert sorted(got) == want
    held = {r["url"]: (r["seen_us"], r["stype"]) for r in S._unpacked(state.get[0]).to_pylist()}
    assert held == {u: (int(pd.Timestamp(ts).value // 1000), k) for u, (ts, k) in seen.items()}


def test_sightings_of_a_bucket_go_one_by_one():
    import pandas as pd

    from vigil.streaming import poll_stream as S

    def urls():
        return sorted(r["url"] for r in S._unpacked(state.get[0]).to_pylist())

    fn, state = S._seen_bucket_fn(KEEP, 9), BucketState()
    rows = [(1, "a", "short", T0), (2, "b", "long", T0), (3, "c", "short", T0 + dt.timedelta(days=1))]
    assert len(next(fn((0,), iter([pd.DataFrame(rows, columns=S.SEEN_OUT.names)]), state))) == 3
    start = int(pd.Timestamp(T0).value // 10 ** 6)
    day = 86_400_000
    assert urls() == ["a", "b", "c"] and state.until == start + 3 * day
    for clock, left, then in ((3, ["b", "c"], 4), (4, ["b"], 31), (31, [], None)):
        state.clock, state.hasTimedOut = start + clock * day, True
        assert list(fn((0,), iter([]), state)) == []
        assert state.until == (then and start + then * day)
        assert (urls() if state.exists else []) == left


def test_seen_filter_keeps_a_state_per_bucket(spark):
    """The stream's states do not grow with the URLs, and both forms pass the
    rows of the sequential rule."""
    from vigil.streaming import poll_stream as S

    rng = random.Random(11)
    rows = items(rng, 300) + [(1000 + i, f"v{i % 2000}", "short", T0 + dt.timedelta(hours=i % 7))
                              for i in range(2500)]
    want = passing(rows)[0]
    for buckets in (64, None):
        base = tempfile.mkdtemp(prefix="seen-")
        spark.createDataFrame(rows, ITEM).repartition(3).write.parquet(f"{base}/in")
        stream = spark.readStream.schema(ITEM).parquet(f"{base}/in")
        q = (S.seen_filter_stream(stream, KEEP, 9, buckets=buckets).writeStream.outputMode("append")
             .option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
             .foreachBatch(S.idempotent_batch_writer(f"{base}/out", lambda b, i: b)).start())
        q.awaitTermination()
        got = sorted(r.event_id for r in spark.read.parquet(f"{base}/out").collect())
        assert got == want
        states = max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress)
        assert states <= 64 if buckets else states > 2000
