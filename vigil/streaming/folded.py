"""Streaming state machines without a task per key.

``applyInPandasWithState`` gives each key's rows of a micro-batch to one task,
which a hot key overloads.  Here a micro-batch is folded by the blocked scan
(``operators/folds.py``), which splits a key over many tasks, inside
``foreachBatch``; the keys' states enter as stored and leave as a new snapshot.
Snapshots and outputs are commits per batch number (``operators/commits.py``),
so a batch that is delivered again changes nothing, and one that died between
its two commits finishes on the state that it began with.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.operators.breaker import breaker_fold
from vigil.operators.commits import commit, is_committed, read_committed, read_latest
from vigil.operators.seen_state import seen_fold

Fold = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def folded(base: str, keys: list[str], state_schema: T.StructType, fold: Fold):
    """A ``foreachBatch`` body.  ``fold(batch, state)`` gives the batch's output
    and the new states of its keys; ``state`` holds the states of these keys
    only.  Keys without rows keep theirs."""
    base = base.rstrip("/")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, f"{batch_id:012d}"
        if is_committed(spark, f"{base}/state", name):
            return
        state = read_latest(spark, f"{base}/state", state_schema)
        here = batch.select(*keys).distinct()
        match = [state[k].eqNullSafe(here[k]) for k in keys]
        out, new = fold(batch, state.join(here, match, "left_semi"))
        new = new.select(*state_schema.names).checkpoint()  # its keys replace the old ones
        commit(out, f"{base}/out", name)
        touched = new.select(*keys)
        rest = state.join(touched, [state[k].eqNullSafe(touched[k]) for k in keys], "left_anti")
        commit(rest.unionByName(new), f"{base}/state", name)

    return run


def output(spark, base: str, schema: T.StructType) -> DataFrame:
    return read_committed(spark, f"{base.rstrip('/')}/out", schema).drop("commit")


def state(spark, base: str, schema: T.StructType) -> DataFrame:
    return read_latest(spark, f"{base.rstrip('/')}/state", schema)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(c, t) for c, t in columns.items()])


BREAKER = _schema(topic_name=T.StringType(), adapter=T.StringType(),
                  consecutive_failures=T.IntegerType(), disabled=T.BooleanType(),
                  disabled_at=T.TimestampType(), n_skipped=T.LongType(), n_trips=T.LongType(),
                  n_events=T.LongType())
BREAKER_CHANGE = _schema(topic_name=T.StringType(), adapter=T.StringType(), seq=T.LongType(),
                         action=T.StringType())
SEEN = _schema(url=T.StringType(), seen_at=T.TimestampType(), source_type=T.StringType())
PASSED = _schema(url=T.StringType(), event_id=T.LongType())


def breaker_batches(base: str, partitions: int | None = None):
    """Attempts ``(topic_name, adapter, ts, seq, failed)``; the output are
    the actions, the state counts them since the stream began."""
    keys = ["topic_name", "adapter"]

    def fold(batch: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
        trans, final = breaker_fold(batch, init=stored, partitions=partitions, keep=True)
        trans = trans.where(F.col("action") != "init")
        counts = trans.groupBy(*keys).agg(
            F.count_if(F.col("action") == "skip").alias("n_skipped"),
            F.count_if(F.col("action") == "trip").alias("n_trips"),
            F.count("*").alias("n_events")).unionByName(
            stored.select(*keys, "n_skipped", "n_trips", "n_events")).groupBy(*keys).agg(
            *[F.sum(c).alias(c) for c in ("n_skipped", "n_trips", "n_events")])
        now = final.select(*keys, "consecutive_failures", "disabled", "disabled_at")
        same = [now[k].eqNullSafe(counts[k]) for k in keys]
        new = now.join(counts, same).select(*[now[c] for c in now.columns], "n_skipped", "n_trips",
                                            "n_events")
        return trans.select(*BREAKER_CHANGE.names), new

    return folded(base, keys, BREAKER, fold)


def seen_batches(base: str, retention: dict | None = None, default_days: int | None = None,
                 partitions: int | None = None):
    """Items ``(event_id, url, source_type, ts)``; the output are those that
    pass, the state is the seen set."""
    def fold(batch: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
        more = {} if default_days is None else {"default_days": default_days}
        trans, final = seen_fold(batch, stored, retention, partitions=partitions, keep=True,
                                 **more)
        passed = trans.where(F.col("action") == "pass")
        return passed.select("url", F.col("seq").alias("event_id")), final

    return folded(base, ["url"], SEEN, fold)
