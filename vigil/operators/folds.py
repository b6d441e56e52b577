"""Ordered per-key state folds that never put a hot key into one task.

A fold over a key's events in time order (circuit breaker, escalation) is
inherently sequential per key, and one key may hold a third of all rows.
The engine here runs it as a *blocked scan*:

1. ``repartitionByRange(keys, order)`` + ``sortWithinPartitions`` splits a
   hot key over many consecutive partitions; the result is checkpointed to
   the shared checkpoint folder so both passes see the same partitions.
2. **Pass A** (``mapInPandas``): in every partition, the key portion that
   may continue from the previous partition is summarised as a *transfer
   function* (exit state for every possible entry state); a key portion
   that starts inside the partition gets its exit from the initial state.
   At most two summary rows per partition.
3. **Carry** (``applyInPandas`` grouped by key over the summaries): folds
   the transfer functions in partition order — at most one row per
   partition per key — giving each continued portion its entry state.
4. **Pass B** (``mapInPandas`` after a broadcast join of that bounded carry
   table): replays every partition forward from its real entry state and
   emits per-event transitions; final states are the last portion's exit.

Pass B reads batch by batch and appends the rows of many keys to one frame, so a
key with few events costs little.  A *machine* supplies ``initial``, ``steps``,
``summarise`` and ``apply``.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.operators.positions import range_sorted
from vigil.session import checkpoint_dir

_PID = "_pid"
# Stored states enter a fold as an event at 1900-01-01, before any real event.
INIT_TS_US = -2208988800 * 1_000_000


def _key(pdf: pd.DataFrame, keys: list[str], row: int) -> tuple:
    return tuple(None if pd.isna(v) else v for v in (pdf[k].iat[row] for k in keys))


def _starts(pdf: pd.DataFrame, keys: list[str], before: tuple | None) -> list[int]:
    """Rows of a sorted frame at which a key begins; ``before`` is the key of the
    row in front of the frame."""
    new = np.zeros(len(pdf), bool)
    for k in keys:
        v, null = pdf[k].to_numpy(), pdf[k].isna().to_numpy()
        new[1:] |= (v[1:] != v[:-1]) & ~(null[1:] & null[:-1])
    new[0] = _key(pdf, keys, 0) != before
    return np.flatnonzero(new).tolist()


def columns(pdf: pd.DataFrame) -> dict[str, list]:
    """The columns as lists, null as None."""
    out = {}
    for c in pdf.columns:
        null = pdf[c].isna()
        out[c] = (pdf[c].astype(object).where(~null, None) if null.any() else pdf[c]).tolist()
    return out


class Machine:
    """``steps(cols, a, b, begun, state, key, rows)`` replays the events ``a`` to
    ``b`` of columns as lists, appends a row for each to ``rows`` (unless None)
    and returns the state; ``begun`` is what ``begin(cols, a)`` said at the
    first event of the portion."""

    def begin(self, cols: dict[str, list], a: int):
        return None

    def run(self, part: pd.DataFrame, state, emit: bool = False):
        if not len(part):
            return [], state
        cols, rows = columns(part), [] if emit else None
        own = set(self.input_columns([])) | {"entry", _PID}
        key = [cols[c][0] for c in part.columns if c not in own]
        state = self.steps(cols, 0, len(part), self.begin(cols, 0), state, key, rows)
        return rows or [], state


def replay(batches, keys: list[str], machine, names: list[str]):
    """Rows of all events of a sorted partition, a frame per batch.  ``entry`` is
    the state at the beginning of a portion, null where it is the initial one."""
    last = state = begun = None
    for pdf in batches:
        if not len(pdf):
            continue
        starts, cols, rows = _starts(pdf, keys, last), columns(pdf), []
        if not starts or starts[0]:  # the portion before goes on
            state = machine.steps(cols, 0, starts[0] if starts else len(pdf), begun, state, last, rows)
        for a, b in zip(starts, starts[1:] + [len(pdf)]):
            last, entry = tuple(cols[k][a] for k in keys), cols["entry"][a]
            state = machine.initial() if entry is None else json.loads(entry)
            begun = machine.begin(cols, a)
            state = machine.steps(cols, a, b, begun, state, last, rows)
        yield pd.DataFrame(rows, columns=names)


def blocked_fold(events: DataFrame, keys: Sequence[str], order: Sequence[str], machine,
                 partitions: int | None = None, keep: bool = False
                 ) -> tuple[DataFrame, DataFrame]:
    """Run ``machine`` over ``events`` per key in ``order``; ``keep`` checkpoints
    the transitions, for callers that use them and the states.

    Returns ``(transitions, final)``: one output row per event (schema
    ``machine.event_schema``) and the final state per key
    (``machine.state_schema``).
    """
    keys = list(keys)
    spark = events.sparkSession
    checkpoint_dir(spark)
    cols = machine.input_columns(keys)
    sorted_df = range_sorted(events.select(*cols), keys, list(order), partitions)
    sorted_df = sorted_df.checkpoint(eager=True)

    key_fields = [events.schema[k] for k in keys]

    # ---- pass A: boundary summaries ---------------------------------------
    sum_schema = T.StructType([T.StructField(_PID, T.IntegerType())] + key_fields + [
        T.StructField("kind", T.StringType()), T.StructField("summary", T.StringType())])

    def pass_a(batches):
        from pyspark import TaskContext

        pid, last, portions = TaskContext.get().partitionId(), None, 0
        rows, first, tail = [], [], []  # frames of the first and of the current portion
        for pdf in batches:
            if not len(pdf):
                continue
            starts = _starts(pdf, keys, last)
            if not starts or starts[0]:
                (first if portions == 1 else tail).append(pdf.iloc[:starts[0] if starts else None])
            if not portions:
                first.append(pdf.iloc[:starts[1] if len(starts) > 1 else None])
            portions += len(starts)
            if starts and portions > 1:
                tail = [pdf.iloc[starts[-1]:]]
            last = _key(pdf, keys, len(pdf) - 1)
        if first:
            part = pd.concat(first, ignore_index=True)
            rows.append((pid, *_key(part, keys, 0), "first", json.dumps(machine.summarise(part))))
        if tail:
            part = pd.concat(tail, ignore_index=True)
            exit_state = machine.run(part, machine.initial())[1]
            rows.append((pid, *last, "last", json.dumps(exit_state)))
        yield pd.DataFrame(rows, columns=[f.name for f in sum_schema.fields])

    summaries = sorted_df.mapInPandas(pass_a, sum_schema)

    # ---- carry: fold summaries per key in partition order (<= #partitions rows)
    carry_schema = T.StructType([T.StructField(_PID, T.IntegerType())] + key_fields + [
        T.StructField("entry", T.StringType())])

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(_PID)
        state = machine.initial()
        out = []
        for rec in pdf.to_dict("records"):
            if rec["kind"] == "first":
                out.append((rec[_PID], *[rec[k] for k in keys], json.dumps(state)))
                state = machine.apply(json.loads(rec["summary"]), state)
            else:
                state = json.loads(rec["summary"])
        return pd.DataFrame(out, columns=[f.name for f in carry_schema.fields])

    # at most one row per partition, read by every later use of the transitions
    entries = summaries.groupBy(*keys).applyInPandas(carry, carry_schema).checkpoint(eager=True)

    # ---- pass B: replay with real entry states --------------------------------
    with_pid = sorted_df.withColumn(_PID, F.spark_partition_id())
    # The carry table has at most one row per partition: a proven bound.
    joined = with_pid.join(F.broadcast(entries.withColumnRenamed(_PID, "_epid")),
                           [F.col(_PID) == F.col("_epid")] +
                           [with_pid[k].eqNullSafe(entries[k]) for k in keys], "left")
    joined = joined.select(with_pid["*"], F.col("entry"))
    out_schema = machine.event_schema(key_fields)

    def pass_b(batches):
        return replay(batches, keys, machine, [f.name for f in out_schema.fields])

    # keep the sort order of each partition into pass B (broadcast join streams
    # the big side in order)
    transitions = joined.mapInPandas(pass_b, out_schema)
    if keep:
        transitions = transitions.checkpoint(eager=True)
    return transitions, machine.final_from(transitions, keys)
