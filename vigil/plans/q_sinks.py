"""Sinks that write and are read back (K01-K03): one commit per run, a week of
the fixture days each."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.operators import commits as C
from vigil.operators import relational as R
from vigil.operators import seen_filter as SF
from vigil.operators import sinks as K
from vigil.operators.index import index_top
from vigil.plans import poll
from vigil.plans.oracle_views import ts_text as ts_sql
from vigil.plans.oracle_views import with_views
from vigil.plans.registry import ORACLE, query, r6, ts_text
from vigil.session import scratch_path
from vigil.sources import fixtures as fx


def _runs(rows, day):
    """(week, its rows) in order; the driver sees the names of the weeks."""
    week = F.date_format(F.date_trunc("week", F.col(day)), "yyyy-MM-dd")
    names = [r[0] for r in rows.select(week.alias("w")).distinct().orderBy("w").collect()]
    return [(w, rows.where(week == w)) for w in names]


def _table(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


@query("archive_committed", with_views("o_scored_passed") + f"""
SELECT strftime(run_day, '%Y-%m') AS month, strftime(run_day, '%Y-%m-%d') AS run_id, url, title,
       topic_name, {ts_sql('fetched_at')} AS fetched_at, round(novelty_score, 6) AS novelty_score
FROM o_scored_passed""")
def archive_committed(spark, sf_dir):
    """The archive written run by run, read back as records."""
    base = _table(spark, "archive")
    for run, rows in _runs(poll.scored_passed(spark, sf_dir), "run_day"):
        K.commit_archive(rows, base, F.col("run_day"), run)
    return K.read_archive(spark, base).select(
        "month", "run_id", "url", "title", "topic_name", ts_text("fetched_at").alias("fetched_at"),
        r6("novelty_score").alias("novelty_score"))


@query("index_committed", with_views("fx_index") + f"""
SELECT topic_name, CAST(pos AS BIGINT) AS pos, url, title, snippet, source_type,
       {ts_sql('fetched_at')} AS fetched_at, {ts_sql('published_at')} AS published_at,
       round(novelty_score, 6) AS novelty_score, escalation_trigger,
       COALESCE(notified_digest, false) AS notified_digest
FROM fx_index""")
def index_committed(spark, sf_dir):
    """Each run merges its rows with the snapshot that it reads back."""
    base, rows = _table(spark, "index"), fx.fx_over(spark, sf_dir)
    order = ["run_day", "source_ord", "term_ord", "item_pos"]
    stored = T.StructType([T.StructField("json", T.StringType()), *(rows.schema[c] for c in order)])

    def records():
        last = C.read_latest(spark, base, stored).select(
            F.from_json("json", K.RECORD_SCHEMA, K.RECORD_OPTIONS).alias("r"), *order)
        return last.withColumn("topic_name", F.col("r.topic_name"))

    for run, new in _runs(rows, "run_day"):
        both = records().unionByName(new.select(K.record(new).alias("r"), *order, "topic_name"))
        C.commit(index_top(both).select(F.to_json("r", K.RECORD_OPTIONS).alias("json"), *order),
                 base, run)
    return index_top(records()).select(
        "topic_name", F.col("pos").cast("bigint").alias("pos"), "r.url", "r.title", "r.snippet",
        "r.source_type", ts_text("r.fetched_at").alias("fetched_at"),
        ts_text("r.published_at").alias("published_at"),
        r6("r.novelty_score").alias("novelty_score"), "r.escalation_trigger", "r.notified_digest")


@query("seen_committed", ORACLE["seen_upsert"])
def seen_committed(spark, sf_dir):
    """The seen set saved run by run, each on the set it reads back."""
    base = _table(spark, "seen")
    seen = poll.pruned_seen(spark, sf_dir).select(
        "url", "seen_at", F.coalesce("source_type", F.lit("news")).alias("source_type"))
    C.commit(R.upsert_seen(seen, seen.limit(0), F.lit(None).cast("timestamp")), base, "0000-stored")
    for run, rows in _runs(poll.scored_passed(spark, sf_dir), "run_day"):
        C.commit(R.upsert_seen(C.read_latest(spark, base, seen.schema), rows, F.col("run_day")),
                 base, run)
    return C.read_latest(spark, base, seen.schema).select(
        "url", ts_text("seen_at").alias("seen_at"), "source_type")


@query("new_items_filtered", ORACLE["new_items"])
def new_items_filtered(spark, sf_dir):
    """R01 behind the stored filter: built from the first half of the seen set,
    extended by the rest, committed and read back."""
    base, seen = _table(spark, "filter"), fx.fx_seen(spark, sf_dir)
    old = F.col("event_id") % 2 == 0
    held = SF.build(seen.where(old))
    C.commit(held, base, "run-0")
    C.commit(SF.extend(C.read_latest(spark, base, held.schema), seen.where(~old)), base, "run-1")
    held = C.read_latest(spark, base, held.schema)
    rows = SF.unseen(fx.fx_items(spark, sf_dir), seen, held, run_at="run_at")
    return rows.select("event_id", "url", "topic_name")
