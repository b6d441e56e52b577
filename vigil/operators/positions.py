"""Skew-safe positions and ordered scans over hot groups.

A per-key window (``row_number().over(partitionBy(key))``) puts a whole
key into one task; one topic or URL may hold a third of all rows.  Here a
key is spread over many tasks instead:

1. ``repartitionByRange(keys, order)`` + ``sortWithinPartitions`` — a hot
   key is split across consecutive range partitions;
2. one vectorised pass per partition assigns local positions
   (``mapInPandas``, Arrow batches);
3. per partition a two-row boundary summary (first / last key and its local
   count) — at most ``#partitions`` rows — gives each partition's offset for
   the key it continues; that bounded table is broadcast back.

The partitioned data is checkpointed to the shared checkpoint folder so the
two passes see identical partitions, also after an executor loss.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vigil.session import checkpoint_dir

_PID, _IDX, _LPOS = "_pid", "_idx", "_lpos"


def _sort_cols(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def range_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                 partitions: int | None = None) -> DataFrame:
    """Range-partition on (keys, order) and sort inside each partition."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(k) for k in keys] + _sort_cols(order)
    return df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)


def _local_positions(keys: list[str]):
    def run(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        last_key = None
        run_len = 0
        idx = 0
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            if keys:
                kdf = pdf[keys]
                # new group where any key differs from the previous row
                change = (kdf != kdf.shift(1)) & ~(kdf.isna() & kdf.shift(1).isna())
                brk = change.any(axis=1).to_numpy().copy()
                first = tuple(kdf.iloc[0].tolist())
                brk[0] = not (last_key is not None and _same(first, last_key))
                last_key = tuple(kdf.iloc[-1].tolist())
            else:
                brk = pd.Series(False, index=pdf.index).to_numpy()
                brk[0] = idx == 0
            grp = brk.cumsum()
            lpos = pd.Series(1, index=pdf.index).groupby(grp).cumsum().to_numpy()
            if not brk[0]:
                lpos[grp == grp[0]] += run_len
            run_len = int(lpos[-1])
            out = pdf.copy()
            out[_PID] = pid
            out[_IDX] = range(idx, idx + n)
            out[_LPOS] = lpos
            idx += n
            yield out

    return run


def _same(a: tuple, b: tuple) -> bool:
    return all((x == y) or (pd.isna(x) and pd.isna(y)) for x, y in zip(a, b))


def with_positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                   name: str = "pos", partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based row number within ``keys`` by ``order``.

    ``order`` must be a total order within a key (add a unique tie-breaker).
    Equivalent to ``row_number().over(Window.partitionBy(keys).orderBy(order))``
    without collecting any key into a single task.
    """
    keys = list(keys)
    checkpoint_dir(df.sparkSession)
    sorted_df = range_sorted(df, keys, order, partitions)
    schema = T.StructType(df.schema.fields + [
        T.StructField(_PID, T.IntegerType()), T.StructField(_IDX, T.LongType()),
        T.StructField(_LPOS, T.LongType())])
    local = sorted_df.mapInPandas(_local_positions(keys), schema).checkpoint(eager=True)

    kexpr = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("k"))
    # Boundary summary: <= one row per partition.
    summary = (local.groupBy(_PID).agg(
        F.min_by(kexpr, F.col(_IDX)).alias("first_key"),
        F.max_by(kexpr, F.col(_IDX)).alias("last_key"),
        F.max_by(F.col(_LPOS), F.col(_IDX)).alias("last_n")))
    p, q = summary.alias("p"), summary.alias("q")
    offsets = (p.join(q, F.col("q.last_key").eqNullSafe(F.col("p.first_key"))
                      & (F.col("q._pid") < F.col("p._pid")))
               .groupBy(F.col("p._pid").alias(_PID), F.col("p.first_key").alias("first_key"))
               .agg(F.sum("q.last_n").alias("_off")))
    # offsets has at most #partitions rows: a proven bound, safe to broadcast.
    out = (local.join(F.broadcast(offsets), _PID, "left")
           .withColumn(name, F.col(_LPOS) + F.when(
               kexpr.eqNullSafe(F.col("first_key")), F.coalesce(F.col("_off"), F.lit(0)))
               .otherwise(F.lit(0)))
           .drop(_PID, _IDX, _LPOS, "first_key", "_off"))
    return out


_BACK = "_back"


def _local_previous(keys: list[str], value: str):
    """The value of the row before, batch by batch; the first row of a
    partition has none yet."""
    def run(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        held = None
        idx = 0
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            kdf = pdf[keys].astype(object).where(pdf[keys].notna(), None)
            v = pdf[value].to_numpy(np.int64)
            same = np.zeros(n, bool)
            same[1:] = ((kdf.iloc[1:].to_numpy() == kdf.iloc[:-1].to_numpy()).all(axis=1))
            back = np.zeros(n, np.int64)
            back[1:] = v[:-1]
            first = tuple(kdf.iloc[0].tolist())
            if held is not None and held[0] == first:
                same[0], back[0] = True, held[1]
            held = tuple(kdf.iloc[-1].tolist()), int(v[-1])
            out = pdf.copy()
            out[_PID] = pid
            out[_IDX] = range(idx, idx + n)
            out[_BACK] = pd.array(np.where(same, back, 0), dtype="Int64")
            out.loc[~same, _BACK] = pd.NA
            idx += n
            yield out

    return run


def with_next(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
              name: str = "next", partitions: int | None = None) -> DataFrame:
    """Add ``name`` = ``value`` of the row that follows within ``keys`` by
    ``order`` (null for the last one).  ``value`` is a long without nulls.

    Equivalent to ``lead(value)`` over a window per key, but a hot key spans
    many tasks: rows are sorted backwards by range, one streaming pass takes the
    row before, and the first row of a partition gets the last one of the
    partition before it (a table of one row per partition).
    """
    keys = list(keys)
    checkpoint_dir(df.sparkSession)
    back = range_sorted(df, keys, [F.col(c).desc() for c in order], partitions)
    schema = T.StructType(df.schema.fields + [
        T.StructField(_PID, T.IntegerType()), T.StructField(_IDX, T.LongType()),
        T.StructField(_BACK, T.LongType())])
    local = back.mapInPandas(_local_previous(keys, value), schema).checkpoint(eager=True)
    key = F.struct(*[F.col(k) for k in keys])
    last = local.groupBy(_PID).agg(F.max_by(F.struct(key.alias("k"), F.col(value).alias("v")),
                                            F.col(_IDX)).alias("e"))
    # at most one row per partition
    edge = last.select(_PID, F.lag("e").over(Window.orderBy(_PID)).alias("_edge"))
    joined = local.join(F.broadcast(edge), _PID, "left")
    at_edge = (F.col(_IDX) == 0) & key.eqNullSafe(F.col("_edge.k"))
    return joined.withColumn(name, F.when(at_edge, F.col("_edge.v")).otherwise(F.col(_BACK))).drop(
        _PID, _IDX, _BACK, "_edge")
