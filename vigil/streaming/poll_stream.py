"""Structured Streaming forms of the poll run.

A poll is a micro-batch: landed files arrive in a folder, ``readStream``
picks them up (``trigger(availableNow=True)`` runs what is there and stops,
one run per tier schedule).  Per-key state machines keep their state in the
streaming state store (``applyInPandasWithState``); run-level steps that need
a whole run (the fair-share budget, index merge, archive) run in
``foreachBatch``, idempotent by ``batch_id`` so a replayed batch changes
nothing.  Every folder lives under the session's shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from vigil.conventions import AS_OF, RUN_CAP
from vigil.operators.breaker import BreakerMachine
from vigil.operators.escalation import EscalationMachine
from vigil.session import scratch_path


# T01 -------------------------------------------------------------------------
def read_stream(spark: SparkSession, path: str, schema: T.StructType,
                files_per_batch: int = 1) -> DataFrame:
    """File-source stream of landed files (one day per micro-batch)."""
    return (spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", files_per_batch)
            .parquet(path))


def run_available(stream_writer, name: str) -> None:
    """Start with ``availableNow`` and wait until the backlog is processed."""
    q = stream_writer.trigger(availableNow=True).queryName(name).start()
    q.awaitTermination()
    exc = q.exception()
    if exc is not None:
        raise RuntimeError(str(exc))


# T03 -------------------------------------------------------------------------
BREAKER_STATE = T.StructType([T.StructField("f", T.IntegerType()),
                              T.StructField("dis", T.BooleanType()),
                              T.StructField("at", T.LongType())])
BREAKER_OUT = T.StructType([T.StructField("topic_name", T.StringType()),
                            T.StructField("adapter", T.StringType()),
                            T.StructField("consecutive_failures", T.IntegerType()),
                            T.StructField("disabled", T.BooleanType()),
                            T.StructField("disabled_at_us", T.LongType()),
                            T.StructField("n_skipped", T.LongType()),
                            T.StructField("n_trips", T.LongType()),
                            T.StructField("n_events", T.LongType())])


def _breaker_fn(machine: BreakerMachine):
    def fn(key, pdfs: Iterator[pd.DataFrame], state):
        if state.exists:
            f, dis, at, sk, tr, ne = state.get
            s = [int(f), bool(dis), None if at is None else int(at)]
        else:
            s, sk, tr, ne = machine.initial(), 0, 0, 0
        part = pd.concat(list(pdfs), ignore_index=True).sort_values(["ts_us", "seq"])
        for ts, failed in zip(part["ts_us"].tolist(), part["failed"].tolist()):
            s, act = machine.step(s, "attempt", int(ts), bool(failed), None)
            sk += act == "skip"
            tr += act == "trip"
            ne += 1
        state.update((s[0], s[1], s[2], sk, tr, ne))
        yield pd.DataFrame([(key[0], key[1], s[0], s[1], s[2], sk, tr, ne)],
                           columns=[f.name for f in BREAKER_OUT.fields])
    return fn


def breaker_stream(attempts: DataFrame, machine: BreakerMachine | None = None) -> DataFrame:
    """Streaming breaker: per (topic, adapter) state across micro-batches;
    each batch's events of a key are replayed in (ts, seq) order."""
    machine = machine or BreakerMachine()
    state = T.StructType(BREAKER_STATE.fields + [
        T.StructField("sk", T.LongType()), T.StructField("tr", T.LongType()),
        T.StructField("ne", T.LongType())])
    ev = attempts.select("topic_name", "adapter", F.unix_micros(F.col("ts")).alias("ts_us"),
                         F.col("seq"), F.col("failed"))
    return ev.groupBy("topic_name", "adapter").applyInPandasWithState(
        _breaker_fn(machine), BREAKER_OUT, state, "update", GroupStateTimeout.NoTimeout)


# T04 -------------------------------------------------------------------------
ESC_OUT = T.StructType([T.StructField("topic_name", T.StringType()),
                        T.StructField("bumped_to", T.StringType()),
                        T.StructField("expires_us", T.LongType()),
                        T.StructField("trigger_tag", T.StringType()),
                        T.StructField("n_accepted", T.LongType()),
                        T.StructField("n_matches", T.LongType())])
ESC_STATE = T.StructType([T.StructField("level", T.StringType()),
                          T.StructField("rank", T.IntegerType()),
                          T.StructField("exp", T.LongType()),
                          T.StructField("tag", T.StringType()),
                          T.StructField("acc", T.LongType()),
                          T.StructField("n", T.LongType())])


def _esc_fn(machine: EscalationMachine):
    def fn(key, pdfs, state):
        if state.exists:
            lv, rk, ex, tg, acc, n = state.get
            s = None if lv is None else [lv, int(rk), None if ex is None else int(ex), tg]
        else:
            s, acc, n = None, 0, 0
        part = pd.concat(list(pdfs), ignore_index=True).sort_values(["ts_us", "seq"])
        for r in part.itertuples(index=False):
            s, act = machine._step(s, "match", int(r.ts_us), r.level, int(r.rank), int(r.dur_us),
                                   r.tag, bool(r.auto), None)
            acc += act in ("set", "replace")
            n += 1
        state.update((s[0] if s else None, s[1] if s else None, s[2] if s else None,
                      s[3] if s else None, acc, n))
        yield pd.DataFrame([(key[0], s[0] if s else None, s[2] if s else None,
                             s[3] if s else None, acc, n)],
                           columns=[f.name for f in ESC_OUT.fields])
    return fn


def escalation_stream(events: DataFrame) -> DataFrame:
    """Streaming escalation state per topic (events as built by
    :func:`vigil.operators.escalation.escalation_events`)."""
    ev = events.select("topic_name", "ts_us", "seq", "level", "rank", "dur_us", "tag", "auto")
    return ev.groupBy("topic_name").applyInPandasWithState(
        _esc_fn(EscalationMachine()), ESC_OUT, ESC_STATE, "update", GroupStateTimeout.NoTimeout)


# T04, with its expiry ----------------------------------------------------------
ESC_CHANGE = T.StructType([T.StructField("topic_name", T.StringType()),
                           T.StructField("at_us", T.LongType()),
                           T.StructField("seq", T.LongType()),
                           T.StructField("change", T.StringType()),
                           T.StructField("bumped_to", T.StringType()),
                           T.StructField("expires_us", T.LongType()),
                           T.StructField("trigger_tag", T.StringType())])
ESC_TIMER = T.StructType([T.StructField("level", T.StringType()),
                          T.StructField("rank", T.IntegerType()),
                          T.StructField("exp", T.LongType()),
                          T.StructField("tag", T.StringType()),
                          T.StructField("seq", T.LongType()),
                          T.StructField("auto", T.BooleanType()),
                          T.StructField("over", T.BooleanType())])


def _esc_timer_fn(machine: EscalationMachine):
    def fn(key, pdfs, state):
        held = state.get if state.exists else (None,) * 6 + (True,)
        s = None if held[0] is None else [held[0], int(held[1]), held[2], held[3]]
        seq, auto, over = held[4], held[5], bool(held[6])
        out = []

        def expire(now_us: int) -> None:
            """The state's end, if it has come."""
            nonlocal s, over
            if s is not None and not over and s[2] is not None and s[2] <= now_us:
                out.append((key[0], int(s[2]), int(seq), "reverted", None, int(s[2]), s[3]))
                over = True
                if auto:
                    s = None

        clock_us = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            part = pd.concat(list(pdfs), ignore_index=True).sort_values(["ts_us", "seq"])
            for r in part.itertuples(index=False):
                if r.topic_name is None or r.kind == "tick":
                    continue
                expire(int(r.ts_us))
                s, act = machine._step(s, "match", int(r.ts_us), r.level, int(r.rank),
                                       int(r.dur_us), r.tag, bool(r.auto), None)
                if act in ("set", "replace"):
                    seq, auto, over = int(r.seq), bool(r.auto), False
                    out.append((key[0], int(r.ts_us), seq, act, s[0], int(s[2]), s[3]))
        expire(clock_us)
        if s is None:
            if state.exists:
                state.remove()
        else:
            state.update((s[0], s[1], s[2], s[3], seq, auto, over))
            if not over and s[2] is not None:
                # fires once the clock has reached the expiry
                state.setTimeoutTimestamp((int(s[2]) - 1) // 1000)
        if out:
            yield pd.DataFrame(out, columns=ESC_CHANGE.names)
    return fn


def escalation_changes_stream(events: DataFrame, ticks: DataFrame | None = None) -> DataFrame:
    """Streaming escalations with their expiry: one row whenever a topic's
    escalation is set, replaced or over (``reverted`` at its ``expires_at``).

    An event-time timer per topic ends an escalation when the stream's clock
    (the watermark: the latest time of any event, or of ``ticks(ts)``, the
    times of polls without matches) reaches its expiry, also if the topic gets
    no more rows.  Without ``auto_revert`` the urgency reverts all the same,
    but the state stays and keeps lower bumps out, as in the batch fold.  Each
    poll's events are later than the clock of the poll before.
    """
    cols = ["topic_name", "ts_us", "seq", "level", "rank", "dur_us", "tag", "auto"]
    ev = events.select(*cols, F.lit("match").alias("kind"))
    if ticks is not None:
        none = [F.lit(None).cast(t).alias(c) for c, t in dict(events.select(*cols).dtypes).items()
                if c != "ts_us"]
        tick = ticks.select(F.unix_micros(F.col("ts")).alias("ts_us"), *none)
        ev = ev.unionByName(tick.select(*cols, F.lit("tick").alias("kind")))
    return (ev.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", "0 seconds")
            .groupBy("topic_name").applyInPandasWithState(
        _esc_timer_fn(EscalationMachine()), ESC_CHANGE, ESC_TIMER, "append",
        GroupStateTimeout.EventTimeTimeout))


def in_force(changes: DataFrame) -> DataFrame:
    """Per topic the last change: ``bumped_to`` is null once it is over."""
    last = F.struct("at_us", F.when(F.col("change") == "reverted", 0).otherwise(1).alias("k"), "seq")
    return changes.groupBy("topic_name").agg(F.max_by(F.struct(
        "bumped_to", "expires_us", "trigger_tag"), last).alias("s")).select("topic_name", "s.*")


# T05 / T07 -------------------------------------------------------------------
def idempotent_batch_writer(path: str, build: Callable[[DataFrame, int], DataFrame]):
    """``foreachBatch`` body writing ``build(batch)`` to ``path/batch_id=N``
    (overwrite): a replayed batch rewrites the same folder, never appends."""
    def write(batch: DataFrame, batch_id: int) -> None:
        out = build(batch, batch_id)
        out.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")
    return write


def latest_per_key(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Final rows of an update-mode output: the last batch's row per key."""
    df = spark.read.parquet(path)
    cols = [c for c in df.columns if c not in keys and c != "batch_id"]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("batch_id")).alias("r"))
            .select(*keys, "r.*"))


# T06 -------------------------------------------------------------------------
def drop_late(items: DataFrame, as_of, cutoffs=None, col: str = "published_at") -> DataFrame:
    """Late items are dropped by age against the batch clock (a plain filter;
    a watermark would only bound state)."""
    from vigil.operators.relational import fresh_items
    return fresh_items(items, as_of, col=col) if cutoffs is None else fresh_items(
        items, as_of, cutoffs, col)


def stream_dir(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"streams/{name}")


__all__ = ["read_stream", "run_available", "breaker_stream", "escalation_stream",
           "idempotent_batch_writer", "latest_per_key", "drop_late", "stream_dir", "AS_OF", "RUN_CAP"]


# T02 -------------------------------------------------------------------------
SEEN_OUT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("url", T.StringType()),
                         T.StructField("source_type", T.StringType()),
                         T.StructField("ts", T.TimestampType())])
SEEN_STATE = T.StructType([T.StructField("seen_us", T.LongType()),
                           T.StructField("stype", T.StringType())])
_DAY_US = 86_400 * 1_000_000
#: URLs are dealt out by hash; the sightings of a bucket are one state.
SEEN_BUCKETS = 256
SEEN_BUCKET_STATE = T.StructType([T.StructField("sightings", T.BinaryType())])
_SIGHTINGS = pa.schema([("url", pa.string()), ("seen_us", pa.int64()), ("stype", pa.string())])


def _micros(ts: pd.Series) -> list[int]:
    return ts.to_numpy().astype("datetime64[us]").astype("int64").tolist()


def _seen_fn(retention: dict, default_days: int):
    def _until(seen) -> int:
        """The time from which on a URL with this sighting passes again."""
        days = retention.get(seen[1] if seen[1] is not None else "news", default_days)
        return int(seen[0]) + (days + 1) * _DAY_US

    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        # most URLs have few rows: plain lists, and the passing rows of the given frames
        frames = [p for p in pdfs if len(p)]
        rows = sorted((us, ev, f, i, stype) for f, p in enumerate(frames) for i, (us, ev, stype) in
                      enumerate(zip(_micros(p["ts"]), p["event_id"].tolist(),
                                    p["source_type"].tolist())))
        seen = state.get if state.exists else None
        until = None if seen is None else _until(seen)
        passed = [[] for _ in frames]
        for us, _, f, i, stype in rows:
            if seen is None or us >= until:
                seen = (us, stype)
                until = _until(seen)
                passed[f].append(i)
        if seen is not None:
            state.update(seen)
            # drop the state once it can no longer suppress anything
            state.setTimeoutTimestamp(until // 1000)
        for p, places in zip(frames, passed):
            if places:
                yield (p if len(places) == len(p) else p.iloc[places])[SEEN_OUT.names]
    return fn


def _packed(sightings: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _SIGHTINGS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(sightings)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes | None) -> pa.RecordBatch:
    if data is None:
        return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in _SIGHTINGS], schema=_SIGHTINGS)
    return pa.ipc.open_stream(pa.BufferReader(data)).read_next_batch()


def _joined(parts: list, kind: pa.DataType) -> pa.Array:
    return pa.chunked_array([x if isinstance(x, pa.Array) else pa.array(x, kind, from_pandas=True)
                             for x in parts], kind).combine_chunks()


def _first_from(ts: np.ndarray, lo: np.ndarray, hi: np.ndarray, until: np.ndarray) -> np.ndarray:
    """For each stretch ``lo`` to ``hi`` of ``ts`` its first place with a time of
    ``until`` or later, ``hi`` if there is none."""
    lo, hi = lo.copy(), hi.copy()
    while (left := np.flatnonzero(lo < hi)).size:
        mid = (lo[left] + hi[left]) // 2
        less = ts[mid] < until[left]
        lo[left[less]] = mid[less] + 1
        hi[left[~less]] = mid[~less]
    return lo


def _seen_bucket_fn(retention: dict, default_days: int):
    """The rule of :func:`_seen_fn` for all URLs of a bucket at once: in each step
    every URL goes on to its next row that passes."""
    def spans(kinds: pa.Array) -> np.ndarray:
        codes = kinds.dictionary_encode(null_encoding="encode")
        days = [retention.get(k if k is not None else "news", default_days)
                for k in codes.dictionary.to_pylist()]
        return ((np.array(days, np.int64) + 1) * _DAY_US)[codes.indices.to_numpy()]

    def fn(key, pdfs, state):
        clock = state.getCurrentWatermarkMs()
        frames = [] if state.hasTimedOut else [p for p in pdfs if len(p)]
        held = _unpacked(state.get[0] if state.exists else None)
        h = len(held)
        urls = _joined([held["url"], *(p["url"] for p in frames)],
                       pa.string()).dictionary_encode(null_encoding="encode")
        kinds = _joined([held["stype"], *(p["source_type"] for p in frames)], pa.string())
        us = np.concatenate([held["seen_us"].to_numpy(), *(_micros(p["ts"]) for p in frames)]).astype(np.int64)
        ends_us = us + spans(kinds)  # from then on a URL with this sighting passes again
        code, n = urls.indices.to_numpy()[h:], len(urls.dictionary)  # held URLs come first
        last = np.arange(n)  # the row of each URL's sighting; a new URL has none yet
        until = np.full(n, np.iinfo(np.int64).min)
        until[:h] = ends_us[:h]
        passed = np.zeros(len(us), bool)
        if len(code):
            seq = np.concatenate([p["event_id"].to_numpy() for p in frames])
            order = np.lexsort((seq, us[h:], code)) + h
            ts, size = us[order], np.bincount(code, minlength=n)
            stop = np.cumsum(size)
            at, some = stop - size, np.flatnonzero(size)
            while len(some):
                place = _first_from(ts, at[some], stop[some], until[some])
                more = place < stop[some]
                some, place = some[more], place[more]
                row = order[place]
                passed[row], last[some], until[some], at[some] = True, row, ends_us[row], place + 1
        # a sighting goes once it can no longer suppress anything
        alive = np.flatnonzero(until // 1000 > clock)
        if len(alive):
            rows = pa.array(last[alive])
            state.update((_packed(pa.RecordBatch.from_arrays(
                [urls.dictionary.take(pa.array(alive)), pa.array(us).take(rows), kinds.take(rows)],
                schema=_SIGHTINGS)),))
            state.setTimeoutTimestamp(int(until[alive].min()) // 1000)
        elif state.exists:
            state.remove()
        a = h
        for p in frames:
            mask = passed[a:a + len(p)]
            a += len(p)
            if mask.any():
                yield (p if mask.all() else p[mask])[SEEN_OUT.names]
    return fn


def seen_filter_stream(items: DataFrame, retention: dict | None = None,
                       default_days: int | None = None, watermark: str = "366 days",
                       buckets: int | None = SEEN_BUCKETS) -> DataFrame:
    """The seen set as streaming state keyed by URL.  An item passes when
    its URL has no sighting, or the last one is older (whole days) than the
    retention of that sighting's type; passing items become the new sighting.
    An event-time timeout at ``seen + (days + 1)`` drops expired state.  URLs are
    dealt out to ``buckets`` by hash, and a call folds the URLs of a bucket
    together; without ``buckets`` each URL is a call and a state.  The watermark lies beyond the longest retention, so that only rows that every
    retention would have forgotten can be late for it."""
    from vigil.conventions import RETENTION_DAYS, RETENTION_DEFAULT_DAYS
    rule = (retention or RETENTION_DAYS,
            default_days if default_days is not None else RETENTION_DEFAULT_DAYS)
    rows = items.select("event_id", "url", "source_type", "ts").withWatermark("ts", watermark)
    if buckets is None:
        return rows.groupBy("url").applyInPandasWithState(
            _seen_fn(*rule), SEEN_OUT, SEEN_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    bucket = F.pmod(F.xxhash64("url"), F.lit(buckets))
    return rows.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(
        _seen_bucket_fn(*rule), SEEN_OUT, SEEN_BUCKET_STATE, "append", GroupStateTimeout.EventTimeTimeout)
