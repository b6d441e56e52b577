"""The seen set as an ordered fold per URL (T02), on the blocked scan.

An item passes when its URL has no sighting yet or the last one is older, in
whole days, than the retention of that sighting's type; it then is the new
sighting.  A URL may hold a third of all items, so the fold runs on
:func:`vigil.operators.folds.blocked_fold`: what a stretch of items does to any
entry state is a step function of the time at which that state ends.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.conventions import RETENTION_DAYS, RETENTION_DEFAULT_DAYS
from vigil.operators.folds import INIT_TS_US, Machine, blocked_fold, columns

KEYS = ("url",)
DAY_US = 86_400 * 1_000_000


class SeenMachine(Machine):
    """State = ``None | [seen_us, type]``."""

    def __init__(self, retention: dict | None = None, default_days: int = RETENTION_DEFAULT_DAYS):
        self.keep, self.default = retention or RETENTION_DAYS, default_days

    def initial(self):
        return None

    def input_columns(self, keys):
        return [*keys, "ts_us", "seq", "kind", "stype", "seen_us"]

    def event_schema(self, key_fields):
        return T.StructType(key_fields + [
            T.StructField("ts_us", T.LongType()), T.StructField("seq", T.LongType()),
            T.StructField("action", T.StringType()), T.StructField("seen_us", T.LongType()),
            T.StructField("stype", T.StringType())])

    def ends(self, s) -> int:
        """The time from which on a URL with this sighting passes again."""
        days = self.keep.get(s[1] if s[1] is not None else "news", self.default)
        return int(s[0]) + (days + 1) * DAY_US

    def steps(self, cols, a, b, begun, s, key, rows):
        end = None if s is None else self.ends(s)
        for i in range(a, b):
            ts, stype = int(cols["ts_us"][i]), cols["stype"][i]
            if cols["kind"][i] == "init":
                s, action = [int(cols["seen_us"][i]), stype], "init"
                end = self.ends(s)
            elif s is None or ts >= end:
                s, action = [ts, stype], "pass"
                end = self.ends(s)
            else:
                action = "seen"
            if rows is not None:
                rows.append((*key, ts, int(cols["seq"][i]), action, s[0], s[1]))
        return s

    def summarise(self, part: pd.DataFrame):
        cols = columns(part)
        kinds, ts, stype = cols["kind"], cols["ts_us"], cols["stype"]
        if "init" in kinds:
            return {"fixed": self.run(part, None)[1]}
        n = len(ts)
        exits = [None] * n  # exit state if item j passes
        for j in range(n - 1, -1, -1):
            own = [int(ts[j]), stype[j]]
            at = bisect.bisect_left(ts, self.ends(own), lo=j + 1)
            exits[j] = exits[at] if at < n else own
        steps = []  # (last time at which a state may end, exit state)
        for j in range(n):
            if steps and steps[-1][1] == exits[j]:
                steps[-1][0] = int(ts[j])
            else:
                steps.append([int(ts[j]), exits[j]])
        return {"none": exits[0], "steps": steps}

    def apply(self, summary, s):
        if "fixed" in summary:
            return summary["fixed"]
        if s is None:
            return summary["none"]
        end = self.ends(s)
        for last, exit_state in summary["steps"]:
            if last >= end:
                return exit_state
        return s

    def final_from(self, transitions: DataFrame, keys) -> DataFrame:
        last = F.max_by(F.struct("seen_us", "stype"), F.struct("ts_us", "seq"))
        return transitions.groupBy(*keys).agg(last.alias("s")).select(
            *keys, F.timestamp_micros("s.seen_us").alias("seen_at"), F.col("s.stype").alias("source_type"))


def seen_fold(items: DataFrame, init: DataFrame | None = None, retention: dict | None = None,
              default_days: int = RETENTION_DEFAULT_DAYS, partitions: int | None = None,
              keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(transitions, state)`` after ``items(event_id, url, source_type, ts)``
    in (ts, event_id) order; ``init(url, seen_at, source_type)`` are stored
    sightings.  Items that pass have the action ``pass``.  A null URL is a URL."""
    none = F.lit(None).cast("long")
    ev = items.select("url", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
                      F.col("event_id").cast("long").alias("seq"), F.lit("item").alias("kind"),
                      F.col("source_type").alias("stype"), none.alias("seen_us"))
    if init is not None:
        start = F.lit(INIT_TS_US).cast("long")
        ev = ev.unionByName(init.select(
            "url", start.alias("ts_us"), start.alias("seq"), F.lit("init").alias("kind"),
            F.col("source_type").alias("stype"), F.unix_micros("seen_at").alias("seen_us")))
    return blocked_fold(ev, KEYS, ["ts_us", "seq"], SeenMachine(retention, default_days), partitions,
                        keep)
