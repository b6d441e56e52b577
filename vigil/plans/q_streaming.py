"""Streaming queries (T01–T07): each runs a Structured Streaming job
(``availableNow``) over files Spark derives from the driver tables and
returns the final result as a batch DataFrame.  Their oracles are the batch
queries' SQL, so "stream = batch" is checked exactly."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vigil.operators import budget as Bu
from vigil.operators.escalation import escalation_events
from vigil.operators.index import index_top
from vigil.plans import poll
from vigil.plans.registry import ORACLE, query, ts_text
from vigil.sources import fixtures as fx
from vigil.streaming import poll_stream as S


def _fresh_dir(spark, name):
    return S.stream_dir(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def _weeks(df, day_col, base):
    """Stage rows once, one folder per week of runs; yields the folders in
    order of arrival (their names are all that the driver sees)."""
    week = F.date_format(F.date_trunc("week", day_col), "yyyy-MM-dd")
    staged = f"{base}/staged"
    df.withColumn("week", week).write.mode("overwrite").partitionBy("week").parquet(staged)
    spark = df.sparkSession
    names = [r[0] for r in spark.read.parquet(staged).select(
        F.col("week").cast("string")).distinct().orderBy("week").collect()]
    for w in names:
        yield spark.read.schema(df.schema).parquet(f"{staged}/week={w}")


def _poll_weekly(spark, name, rows, day_col, start):
    """A poll per week: the week's files land, then the stream runs over what
    is new (one micro-batch of any number of files) from its checkpoint."""
    base = _fresh_dir(spark, name)
    for landed in _weeks(rows, day_col, base):
        landed.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        S.run_available(start(stream, base).option("checkpointLocation", f"{base}/_checkpoint"),
                        f"{name}_{uuid.uuid4().hex[:6]}")
    return base


def _keyed_state(spark, name, rows, day_col, build, keys):
    base = _poll_weekly(spark, name, rows, day_col, lambda stream, base: build(stream).writeStream
                        .outputMode("update")
                        .foreachBatch(S.idempotent_batch_writer(f"{base}/out", _with_batch)))
    return S.latest_per_key(spark, f"{base}/out", keys)


def _with_batch(df, batch_id):
    return df.withColumn("batch_id", F.lit(batch_id))


@query("stream_breaker_state", ORACLE["breaker_state"])
def stream_breaker_state(spark, sf_dir):
    """Breaker state kept in the streaming state store, one week of
    attempts per micro-batch."""
    out = _keyed_state(spark, "attempts", fx.fx_attempts(spark, sf_dir), F.col("ts"),
                       S.breaker_stream, ["topic_name", "adapter"])
    return out.select("topic_name", "adapter", "consecutive_failures", "disabled",
                      ts_text(F.timestamp_micros("disabled_at_us")).alias("disabled_at"),
                      "n_skipped", "n_trips", "n_events")


@query("stream_escalation_state", ORACLE["escalation_state"])
def stream_escalation_state(spark, sf_dir):
    """Escalation state per topic across micro-batches."""
    from vigil.plans.q_state import _matches
    m = _matches(spark, sf_dir).withColumn("ts", F.col("fetched_at")).withColumn("seq", F.col("event_id"))
    ev = escalation_events(m).withColumn("ts", F.timestamp_micros("ts_us"))
    out = _keyed_state(spark, "matches", ev, F.col("ts"), S.escalation_stream, ["topic_name"])
    return out.select("topic_name", "bumped_to",
                      ts_text(F.timestamp_micros("expires_us")).alias("expires_at"), "trigger_tag",
                      "n_accepted", "n_matches")


@query("stream_budget", ORACLE["budget_allocation"])
def stream_budget(spark, sf_dir):
    """The fair-share budget of each run inside ``foreachBatch`` (a run
    lies in one micro-batch, over any number of files)."""
    fresh = poll.run(spark, sf_dir).fresh.select("run_day", "topic_ord")

    def build(batch, batch_id):
        counts = batch.groupBy("run_day", "topic_ord").agg(F.count("*").alias("n"))
        return _with_batch(Bu.allocate_budget(counts, fx.N_TOPICS, run="run_day"), batch_id)

    base = _poll_weekly(spark, "budget", fresh, F.col("run_day"), lambda stream, base: stream
                        .writeStream.foreachBatch(S.idempotent_batch_writer(f"{base}/out", build)))
    return spark.read.parquet(f"{base}/out").select(
        ts_text("run_day").alias("run_day"), F.col("topic_ord").cast("bigint").alias("topic_ord"),
        "budget", "used_before", "sent")


@query("stream_index_top100", ORACLE["index_top100"])
def stream_index_top100(spark, sf_dir):
    """Each micro-batch appends its passed rows to the archive and merges
    them into the capped index: previous snapshot ∪ new rows → top 100 per
    topic, written as the batch's own snapshot (a replay rewrites the same)."""
    cols = ["topic_name", "event_id", "run_day", "source_ord", "term_ord", "item_pos"]
    rows = fx.fx_over(spark, sf_dir).select(*cols)

    def start(stream, base):
        def merge(batch, batch_id):
            batch.withColumn("month", F.date_format("run_day", "yyyy-MM")).write.mode(
                "overwrite").partitionBy("month").parquet(f"{base}/archive/batch_id={batch_id}")
            merged = batch.select(*cols)
            if batch_id:  # batches are numbered without gaps; a failing read raises
                merged = merged.unionByName(
                    spark.read.parquet(f"{base}/snap/{batch_id - 1}").select(*cols))
            index_top(merged).drop("pos").write.mode("overwrite").parquet(f"{base}/snap/{batch_id}")
            # the pointer moves once the snapshot is complete
            spark.createDataFrame([(batch_id,)], "batch_id long").coalesce(1).write.mode(
                "overwrite").parquet(f"{base}/pointer")

        return stream.writeStream.foreachBatch(merge)

    base = _poll_weekly(spark, "index", rows, F.col("run_day"), start)
    last = spark.read.parquet(f"{base}/pointer").first()[0]
    return index_top(spark.read.parquet(f"{base}/snap/{last}")).select(
        "topic_name", "event_id", F.col("pos").cast("bigint").alias("pos"))


@query("stream_normalise_gdelt", ORACLE["norm_gdelt"])
def stream_normalise_gdelt(spark, sf_dir):
    """Landed payload files as a stream → normaliser → late filter
    against the batch clock → appended results."""
    from vigil.plans.q_sources import _out
    from vigil.sources import fixture_payloads as FP
    from vigil.sources.json_api import normalise_gdelt
    landed = FP.landed(spark, sf_dir, "gdelt")
    base = _fresh_dir(spark, "landed_gdelt")
    landed.write.mode("overwrite").parquet(f"{base}/in")
    stream = S.read_stream(spark, f"{base}/in", landed.schema, files_per_batch=4)
    res = S.drop_late(normalise_gdelt(stream), S.AS_OF)
    w = (res.writeStream.outputMode("append").option("checkpointLocation", f"{base}/_checkpoint")
         .foreachBatch(S.idempotent_batch_writer(f"{base}/out", lambda b, i: b)))
    S.run_available(w, f"gdelt_{uuid.uuid4().hex[:6]}")
    return _out(spark.read.parquet(f"{base}/out"))


def _seen_oracle() -> str:
    from vigil.conventions import RETENTION_DAYS
    from vigil.plans.oracle_views import case_map, with_views
    keep = case_map("COALESCE(s.stype, 'news')", RETENTION_DAYS, "90")
    return with_views("fx_over") + f"""
, x AS (SELECT event_id, url, source_type, fetched_at AS ts,
               row_number() OVER (PARTITION BY url ORDER BY fetched_at, event_id) AS rn FROM fx_over),
st AS (SELECT 1),
rec AS (
  WITH RECURSIVE r(url, rn, seen, stype, ok, event_id) AS (
    SELECT DISTINCT url, CAST(0 AS BIGINT), CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR), false, CAST(NULL AS BIGINT) FROM x
    UNION ALL
    SELECT x.url, x.rn,
           CASE WHEN s.seen IS NULL OR floor((epoch_us(x.ts) - epoch_us(s.seen)) / 86400000000.0) > ({keep})
                THEN x.ts ELSE s.seen END,
           CASE WHEN s.seen IS NULL OR floor((epoch_us(x.ts) - epoch_us(s.seen)) / 86400000000.0) > ({keep})
                THEN x.source_type ELSE s.stype END,
           s.seen IS NULL OR floor((epoch_us(x.ts) - epoch_us(s.seen)) / 86400000000.0) > ({keep}),
           x.event_id
    FROM r s JOIN x ON x.url = s.url AND x.rn = s.rn + 1)
  SELECT * FROM r)
SELECT event_id, url FROM rec WHERE ok"""


@query("stream_seen_filter", _seen_oracle())
def stream_seen_filter(spark, sf_dir):
    """Passed items streamed week by week through the URL-keyed seen
    state with per-type TTL; returns the items that got through."""
    rows = fx.fx_over(spark, sf_dir).select("event_id", "url", "source_type",
                                            F.col("fetched_at").alias("ts"))
    base = _poll_weekly(spark, "seen", rows, F.col("ts"), lambda stream, base: S.seen_filter_stream(
        stream).writeStream.outputMode("append")
        .foreachBatch(S.idempotent_batch_writer(f"{base}/out", lambda b, i: b)))
    return spark.read.parquet(f"{base}/out").select("event_id", "url")


def _changes_oracle() -> str:
    from vigil.plans.oracle_views import ts_text as ts_sql
    from vigil.plans.oracle_views import with_views
    return with_views("o_esc_steps", "fx_items") + f"""
, kept AS (SELECT s.topic_name, i.fetched_at AS since, s.seq, s.action, s.lvl, s.exp, s.tag
           FROM o_esc_steps s JOIN fx_items i ON i.event_id = s.seq
           WHERE s.action IN ('set', 'replace')),
nxt AS (SELECT *, lead(since) OVER (PARTITION BY topic_name ORDER BY since, seq) AS later FROM kept),
clock AS (SELECT max(run_at) AS now FROM fx_items)
SELECT topic_name, {ts_sql('since')} AS changed_at, seq, action AS change, lvl AS bumped_to, tag AS trigger_tag
FROM kept
UNION ALL
SELECT topic_name, {ts_sql('exp')}, seq, 'reverted', NULL, tag FROM nxt, clock
WHERE exp <= now AND (later IS NULL OR exp <= later)"""


@query("stream_escalation_changes", _changes_oracle())
def stream_escalation_changes(spark, sf_dir):
    """T04 with expiry: escalations set, replaced and over, week by week, with
    the runs' times as the clock."""
    from vigil.plans.q_state import _matches
    m = _matches(spark, sf_dir).withColumn("ts", F.col("fetched_at")).withColumn("seq", F.col("event_id"))
    ev = escalation_events(m)
    cols = ["topic_name", "ts_us", "seq", "level", "rank", "dur_us", "tag", "auto"]
    runs = fx.fx_items(spark, sf_dir).select("run_at").distinct()
    rows = ev.select(*cols, F.timestamp_micros("ts_us").alias("ts")).unionByName(
        runs.select(F.col("run_at").alias("ts"), F.unix_micros("run_at").alias("ts_us")),
        allowMissingColumns=True)

    def start(stream, base):
        got = S.escalation_changes_stream(stream.where(F.col("topic_name").isNotNull()),
                                          stream.where(F.col("topic_name").isNull()))
        return got.writeStream.outputMode("append").foreachBatch(
            S.idempotent_batch_writer(f"{base}/out", lambda b, i: b))

    base = _poll_weekly(spark, "esc_changes", rows, F.col("ts"), start)
    return spark.read.parquet(f"{base}/out").select(
        "topic_name", ts_text(F.timestamp_micros("at_us")).alias("changed_at"), "seq", "change",
        "bumped_to", "trigger_tag")


#: Tiers of the sources before the first and before the second poll.
_TIERS = ({"gdelt": "frequent", "arxiv": "frequent", "slickdeals": "discovery",
           "weather": ("discovery", "broad")},
          {"gdelt": "discovery", "arxiv": "frequent", "slickdeals": "discovery", "weather": "broad"})


@query("stream_poll_tiers", " UNION ALL ".join(
    f"SELECT payload_id, item_pos, url, title, '{s}' AS adapter FROM ({ORACLE['norm_' + s]})"
    for s in _TIERS[0]))
def stream_poll_tiers(spark, sf_dir):
    """Two landings, a poll of every tier after each; a source moves to
    another tier in between."""
    from vigil.sources import fixture_payloads as FP
    from vigil.streaming import tiers as P
    base = _fresh_dir(spark, "tiers")
    for part, tiers in enumerate(_TIERS):
        for s in tiers:
            rows = FP.landed_feed(spark, sf_dir, s) if s in FP.FEEDS else FP.landed(spark, sf_dir, s)
            rows.where(F.pmod(F.floor(F.col("payload_id") / 10), F.lit(2)) == part).write.mode(
                "append").parquet(f"{base}/in/source={s}")
        for tier in ("frequent", "discovery", "broad"):
            P.start_poll(spark, f"{base}/in", f"{base}/state", tier, tiers).awaitTermination()
    return P.poll_results(spark, f"{base}/state").select(
        "payload_id", F.col("item_pos").cast("bigint").alias("item_pos"), "url", "title", "adapter")


@query("stream_breaker_folded", ORACLE["breaker_state"])
def stream_breaker_folded(spark, sf_dir):
    """T03 for hot keys: each week's attempts folded by the blocked scan."""
    from vigil.streaming import folded as FO
    base = _poll_weekly(spark, "attempts_folded", fx.fx_attempts(spark, sf_dir), F.col("ts"),
                        lambda stream, base: stream.writeStream.foreachBatch(FO.breaker_batches(base)))
    return FO.state(spark, base, FO.BREAKER).withColumn("disabled_at", ts_text("disabled_at"))


@query("stream_seen_folded", _seen_oracle())
def stream_seen_folded(spark, sf_dir):
    """T02 for hot URLs: each week's items folded by the blocked scan."""
    from vigil.streaming import folded as FO
    rows = fx.fx_over(spark, sf_dir).select("event_id", "url", "source_type",
                                            F.col("fetched_at").alias("ts"))
    base = _poll_weekly(spark, "seen_folded", rows, F.col("ts"),
                        lambda stream, base: stream.writeStream.foreachBatch(FO.seen_batches(base)))
    return FO.output(spark, base, FO.PASSED).select("event_id", "url")
