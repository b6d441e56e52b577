"""Points in time intervals: which interval of its key holds each point.

A range condition alone would make Spark compare every point with every
interval of its key.  Here time is cut into bins: an interval is copied to
every bin that it covers (open ends reach to the last point), a point lies in
one bin, and (key, bin) is an ordinary equi-join key, with the exact range as a
recheck.  So a hot key is spread over its bins, and a bin that is hot itself is
one that Spark can split, since both sides are plain inputs of the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BIN = "_bin"
#: An hour in microseconds, the unit of bin widths.
HOUR_US = 3600 * 1_000_000


def bin_of(us: Column, width_us: int) -> Column:
    return F.floor(us / F.lit(width_us)).cast("long")


def interval_join(points: DataFrame, intervals: DataFrame, on: Sequence[str], at: str,
                  start: str, end: str, width_hours: int = 6, how: str = "left") -> DataFrame:
    """Points with each interval ``[start, end)`` of equal ``on`` columns that
    holds them; a null ``end`` is open.  ``at``, ``start`` and ``end`` are
    timestamps.  ``how`` is ``left`` (points without an interval stay, with
    nulls) or ``inner``.  A null point or start is in no interval."""
    on, width = list(on), width_hours * HOUR_US
    if how not in ("left", "inner"):
        raise ValueError(f"how must be left or inner, not {how}")

    def us(c: str) -> Column:
        return F.unix_micros(F.col(c))

    first, last = points.agg(F.min(us(at)), F.max(us(at))).first()  # two numbers
    if first is None:
        first = last = 0
    upto = F.least(us(end) - 1, F.lit(last).cast("long"))
    since = F.greatest(us(start), F.lit(first).cast("long"))
    spread = intervals.where(us(start).isNotNull() & (since <= upto) & (
        F.col(end).isNull() | (F.col(start) < F.col(end)))).withColumn(
        _BIN, F.explode(F.sequence(bin_of(since, width), bin_of(upto, width))))
    p = points.withColumn(_BIN, bin_of(us(at), width)).alias("p")
    i = spread.alias("i")
    hit = F.col(f"p.{_BIN}") == F.col(f"i.{_BIN}")
    for c in on:
        hit = hit & (F.col(f"p.{c}") == F.col(f"i.{c}"))
    hit = hit & (F.col(f"i.{start}") <= F.col(f"p.{at}")) & (
        F.col(f"i.{end}").isNull() | (F.col(f"p.{at}") < F.col(f"i.{end}")))
    extra = [F.col(f"i.{c}") for c in intervals.columns if c not in on]
    return p.join(i, hit, how).select(*[F.col(f"p.{c}") for c in points.columns], *extra)
