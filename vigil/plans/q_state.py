"""State-machine queries: circuit breaker (M01–M04), escalation."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.conventions import AS_OF
from vigil.operators import breaker as B
from vigil.plans.oracle_views import AS_OF as AS_OF_SQL
from vigil.plans.oracle_views import register, ts_text as ts_sql, with_views
from vigil.plans.registry import query, ts_text
from vigil.sources import fixtures as fx

# --- breaker oracle: recursive CTE over each key's attempts -------------------
_RUNS = "(s.dis AND (s.dat IS NULL OR e.ts - s.dat < INTERVAL 6 HOUR))"
_REC = "(s.dis AND NOT " + _RUNS + ")"
_F0 = f"CASE WHEN {_REC} THEN 0 ELSE s.f END"
register("o_breaker_steps", ("fx_attempts",), f"""
WITH RECURSIVE ev AS (
  SELECT topic_name, adapter, ts, seq, failed,
         row_number() OVER (PARTITION BY topic_name, adapter ORDER BY ts, seq) AS rn
  FROM fx_attempts),
st(topic_name, adapter, rn, seq, ts, f, dis, dat, action) AS (
  SELECT DISTINCT topic_name, adapter, CAST(0 AS BIGINT), CAST(NULL AS BIGINT),
         CAST(NULL AS TIMESTAMP), 0, false, CAST(NULL AS TIMESTAMP), 'start'
  FROM ev
  UNION ALL
  SELECT e.topic_name, e.adapter, e.rn, e.seq, e.ts,
    CASE WHEN {_RUNS} THEN s.f WHEN e.failed THEN least({_F0} + 1, 5) ELSE 0 END,
    CASE WHEN {_RUNS} THEN true WHEN e.failed AND {_F0} + 1 >= 5 THEN true ELSE false END,
    CASE WHEN {_RUNS} THEN s.dat WHEN e.failed AND {_F0} + 1 >= 5 THEN e.ts ELSE NULL END,
    CASE WHEN {_RUNS} THEN 'skip' WHEN e.failed AND {_F0} + 1 >= 5 THEN 'trip'
         WHEN {_REC} AND e.failed THEN 'recover_fail' WHEN {_REC} THEN 'recover_ok'
         WHEN e.failed THEN 'fail' ELSE 'ok' END
  FROM st s JOIN ev e ON e.topic_name = s.topic_name AND e.adapter = s.adapter
                     AND e.rn = s.rn + 1)
SELECT * FROM st WHERE rn > 0""")


def _breaker(spark, sf_dir):
    return B.breaker_fold(fx.fx_attempts(spark, sf_dir))


@query("breaker_state", with_views("o_breaker_steps") + f"""
SELECT topic_name, adapter, CAST(f AS INTEGER) AS consecutive_failures, dis AS disabled,
       {ts_sql('dat')} AS disabled_at, n_skipped, n_trips, n_events
FROM (SELECT topic_name, adapter, f, dis, dat,
             CAST(count(*) FILTER (WHERE action = 'skip') OVER w AS BIGINT) AS n_skipped,
             CAST(count(*) FILTER (WHERE action = 'trip') OVER w AS BIGINT) AS n_trips,
             CAST(count(*) OVER w AS BIGINT) AS n_events,
             rn = max(rn) OVER w AS is_last
      FROM o_breaker_steps WINDOW w AS (PARTITION BY topic_name, adapter))
WHERE is_last""")
def breaker_state(spark, sf_dir):
    _, final = _breaker(spark, sf_dir)
    return final.select("topic_name", "adapter", "consecutive_failures", "disabled",
                        ts_text("disabled_at").alias("disabled_at"),
                        F.col("n_skipped").cast("bigint").alias("n_skipped"),
                        F.col("n_trips").cast("bigint").alias("n_trips"),
                        F.col("n_events").cast("bigint").alias("n_events"))


@query("breaker_transitions", with_views("o_breaker_steps") + f"""
SELECT topic_name, adapter, seq, action, CAST(f AS INTEGER) AS consecutive_failures,
       dis AS disabled, {ts_sql('dat')} AS disabled_at
FROM o_breaker_steps""")
def breaker_transitions(spark, sf_dir):
    trans, _ = _breaker(spark, sf_dir)
    return trans.select("topic_name", "adapter", "seq", "action", "consecutive_failures",
                        "disabled", ts_text("disabled_at").alias("disabled_at"))


@query("breaker_is_disabled", with_views("o_breaker_steps") + f"""
SELECT topic_name, adapter,
       COALESCE(dis, false) AND (dat IS NULL OR {AS_OF_SQL} - dat < INTERVAL 6 HOUR) AS is_disabled
FROM (SELECT topic_name, adapter, dis, dat, rn = max(rn) OVER (PARTITION BY topic_name, adapter) AS is_last
      FROM o_breaker_steps) WHERE is_last""")
def breaker_is_disabled(spark, sf_dir):
    _, final = _breaker(spark, sf_dir)
    return B.breaker_is_disabled(final, AS_OF).select("topic_name", "adapter", "is_disabled")


# --- escalation -------------------------------------------------------------------
from vigil.operators import escalation as E  # noqa: E402

register("o_esc_matches", ("fx_over", "fx_triggers"), """
SELECT i.event_id, i.topic_name, i.topic_ord, i.fetched_at, t.tag AS escalation_trigger,
       t.bump_to, t.duration_hours
FROM fx_over i JOIN fx_triggers t ON t.topic_ord = i.topic_ord AND t.tag = i.tag
QUALIFY row_number() OVER (PARTITION BY i.event_id ORDER BY t.pos) = 1""")

_NONE = "(s.lvl IS NULL OR (m.auto_revert AND s.exp IS NOT NULL AND m.ts >= s.exp))"
_ACC = f"({_NONE} OR m.rk >= s.rk)"
register("o_esc_steps", ("o_esc_matches", "fx_topics"), f"""
WITH RECURSIVE m AS (
  SELECT x.topic_name, x.fetched_at AS ts, x.event_id AS seq, x.bump_to AS level,
         CASE x.bump_to WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2
              WHEN 'urgent' THEN 3 ELSE 0 END AS rk,
         x.fetched_at + to_microseconds(CAST(x.duration_hours * 3600000000 AS BIGINT)) AS own_exp,
         x.escalation_trigger AS tag, t.auto_revert,
         row_number() OVER (PARTITION BY x.topic_name ORDER BY x.fetched_at, x.event_id) AS rn
  FROM o_esc_matches x JOIN fx_topics t USING (topic_ord)),
st(topic_name, rn, seq, lvl, rk, exp, tag, action) AS (
  SELECT DISTINCT topic_name, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR),
         CAST(NULL AS INTEGER), CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR), 'start' FROM m
  UNION ALL
  SELECT m.topic_name, m.rn, m.seq,
         CASE WHEN {_ACC} THEN m.level ELSE s.lvl END,
         CASE WHEN {_ACC} THEN m.rk ELSE s.rk END,
         CASE WHEN {_ACC} THEN m.own_exp ELSE s.exp END,
         CASE WHEN {_ACC} THEN m.tag ELSE s.tag END,
         CASE WHEN {_NONE} THEN 'set' WHEN {_ACC} THEN 'replace' ELSE 'ignore' END
  FROM st s JOIN m ON m.topic_name = s.topic_name AND m.rn = s.rn + 1)
SELECT * FROM st WHERE rn > 0""")
register("o_esc_state", ("o_esc_steps",), """
SELECT topic_name, lvl AS bumped_to, exp AS expires_at, tag AS trigger_tag, n_accepted, n_matches
FROM (SELECT *, rn = max(rn) OVER w AS is_last,
             CAST(count(*) FILTER (WHERE action IN ('set', 'replace')) OVER w AS BIGINT) AS n_accepted,
             CAST(count(*) OVER w AS BIGINT) AS n_matches
      FROM o_esc_steps WINDOW w AS (PARTITION BY topic_name)) WHERE is_last""")


def _matches(spark, sf_dir):
    topics = fx.fx_topics(spark)
    m = E.match_triggers(fx.fx_over(spark, sf_dir), topics)
    return m.where(F.col("escalation_trigger").isNotNull())


def _esc(spark, sf_dir):
    m = _matches(spark, sf_dir).withColumn("ts", F.col("fetched_at")).withColumn(
        "seq", F.col("event_id"))
    return E.escalation_fold(m)


@query("escalation_matches", with_views("o_esc_matches") + """
SELECT event_id, topic_name, escalation_trigger, bump_to,
       round(CAST(duration_hours AS DOUBLE), 6) AS duration_hours FROM o_esc_matches""")
def escalation_matches(spark, sf_dir):
    return _matches(spark, sf_dir).select("event_id", "topic_name", "escalation_trigger", "bump_to",
                                          F.round("duration_hours", 6).alias("duration_hours"))


@query("escalation_transitions", with_views("o_esc_steps") + f"""
SELECT topic_name, seq, action, lvl AS bumped_to, {ts_sql('exp')} AS expires_at,
       tag AS trigger_tag FROM o_esc_steps""")
def escalation_transitions(spark, sf_dir):
    trans, _ = _esc(spark, sf_dir)
    return trans.select("topic_name", "seq", "action", "bumped_to",
                        ts_text("expires_at").alias("expires_at"), "trigger_tag")


@query("escalation_state", with_views("o_esc_state") + f"""
SELECT topic_name, bumped_to, {ts_sql('expires_at')} AS expires_at, trigger_tag,
       n_accepted, n_matches FROM o_esc_state""")
def escalation_state(spark, sf_dir):
    _, final = _esc(spark, sf_dir)
    return final.select("topic_name", "bumped_to", ts_text("expires_at").alias("expires_at"),
                        "trigger_tag", F.col("n_accepted").cast("bigint").alias("n_accepted"),
                        F.col("n_matches").cast("bigint").alias("n_matches"))


_RANK_SQL = "CASE {x} WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 WHEN 'urgent' THEN 3 ELSE 0 END"


@query("effective_urgency", with_views("o_esc_state", "fx_topics") + f"""
SELECT t.name, t.urgency,
       CASE WHEN s.bumped_to IS NULL AND s.expires_at IS NULL THEN t.urgency
            WHEN s.expires_at IS NOT NULL AND {AS_OF_SQL} >= s.expires_at THEN t.urgency
            WHEN {_RANK_SQL.format(x='COALESCE(s.bumped_to, t.urgency)')} > {_RANK_SQL.format(x='t.urgency')}
              THEN COALESCE(s.bumped_to, t.urgency)
            ELSE t.urgency END AS effective_urgency,
       COALESCE(s.expires_at IS NOT NULL AND {AS_OF_SQL} >= s.expires_at AND t.auto_revert, false) AS cleared
FROM fx_topics t LEFT JOIN o_esc_state s ON s.topic_name = t.name""")
def effective_urgency(spark, sf_dir):
    _, final = _esc(spark, sf_dir)
    eff = E.effective_urgency(fx.fx_topics(spark), final, AS_OF)
    return eff.select("name", "urgency", "effective_urgency",
                      F.coalesce(F.col("cleared"), F.lit(False)).alias("cleared"))


# --- M03: manual resets inside the replay -------------------------------------------
_RESET = "(event_type = 'purchase' AND value > 45)"
register("o_breaker_reset_steps", (), f"""
WITH RECURSIVE ev AS (
  SELECT 'topic_' || lpad(CAST(user_id % 12 AS VARCHAR), 2, '0') AS topic_name,
         'src' || CAST(event_id % 3 AS VARCHAR) AS adapter, ts, event_id AS seq,
         event_type IN ('error', 'signup', 'view') AS failed, {_RESET} AS is_reset,
         row_number() OVER (PARTITION BY user_id % 12, event_id % 3 ORDER BY ts, event_id) AS rn
  FROM events),
st(topic_name, adapter, rn, seq, f, dis, dat, action) AS (
  SELECT DISTINCT topic_name, adapter, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), 0, false,
         CAST(NULL AS TIMESTAMP), 'start' FROM ev
  UNION ALL
  SELECT e.topic_name, e.adapter, e.rn, e.seq,
    CASE WHEN e.is_reset THEN 0 WHEN {_RUNS} THEN s.f WHEN e.failed THEN least({_F0} + 1, 5) ELSE 0 END,
    CASE WHEN e.is_reset THEN false WHEN {_RUNS} THEN true WHEN e.failed AND {_F0} + 1 >= 5 THEN true ELSE false END,
    CASE WHEN e.is_reset THEN NULL WHEN {_RUNS} THEN s.dat WHEN e.failed AND {_F0} + 1 >= 5 THEN e.ts ELSE NULL END,
    CASE WHEN e.is_reset THEN 'reset' WHEN {_RUNS} THEN 'skip' WHEN e.failed AND {_F0} + 1 >= 5 THEN 'trip'
         WHEN {_REC} AND e.failed THEN 'recover_fail' WHEN {_REC} THEN 'recover_ok'
         WHEN e.failed THEN 'fail' ELSE 'ok' END
  FROM st s JOIN ev e ON e.topic_name = s.topic_name AND e.adapter = s.adapter AND e.rn = s.rn + 1)
SELECT * FROM st WHERE rn > 0""")


@query("breaker_reset", with_views("o_breaker_reset_steps") + f"""
SELECT topic_name, adapter, seq, action, CAST(f AS INTEGER) AS consecutive_failures,
       dis AS disabled, {ts_sql('dat')} AS disabled_at
FROM o_breaker_reset_steps""")
def breaker_reset(spark, sf_dir):
    """Replay with manual resets: a reset clears failures, the disabled flag
    and ``disabled_at`` whatever the state (not gated by the cooldown)."""
    ev = fx.table(spark, sf_dir, "events")
    e = F.col("event_id")
    is_reset = (F.col("event_type") == "purchase") & (F.col("value") > 45)
    base = ev.select(fx.topic_name(F.col("user_id") % 12).alias("topic_name"),
                     F.concat(F.lit("src"), (e % 3).cast("string")).alias("adapter"),
                     F.col("ts").cast("timestamp").alias("ts"), e.alias("seq"),
                     F.col("event_type").isin(*fx.FAILED_TYPES).alias("failed"),
                     is_reset.alias("is_reset"))
    trans, _ = B.breaker_fold(base.where(~F.col("is_reset")).drop("is_reset"),
                              resets=base.where("is_reset").drop("is_reset", "failed"))
    return trans.select("topic_name", "adapter", "seq", "action", "consecutive_failures",
                        "disabled", ts_text("disabled_at").alias("disabled_at"))


@query("topic_hue", """
SELECT c_name AS topic_name,
       CAST(CAST('0x' || substr(md5(c_name), 1, 8) AS BIGINT) % 360 AS INTEGER) AS hue FROM customer""")
def topic_hue(spark, sf_dir):
    """a stable hue per topic name."""
    from vigil.functions.lookups import topic_hue as hue
    names = fx.table(spark, sf_dir, "customer").select(F.col("c_name").alias("topic_name"))
    return names.select("topic_name", hue("topic_name").cast("int").alias("hue"))


# --- scoring calls against the escalations in force -----------------------------------
@query("score_urgency", with_views("o_esc_steps", "fx_items", "fx_topics") + f"""
, kept AS (SELECT s.topic_name, i.fetched_at AS start_at, s.seq, s.lvl, s.exp, s.tag
           FROM o_esc_steps s JOIN fx_items i ON i.event_id = s.seq
           WHERE s.action IN ('set', 'replace')),
span AS (SELECT *, least(exp, lead(start_at) OVER (PARTITION BY topic_name ORDER BY start_at, seq))
           AS end_at FROM kept)
SELECT p.event_id, p.topic_name, {ts_sql('p.fetched_at')} AS call_ts, x.lvl AS bumped_to,
       x.tag AS trigger_tag,
       CASE WHEN {_RANK_SQL.format(x="COALESCE(x.lvl, t.urgency)")} > {_RANK_SQL.format(x='t.urgency')}
            THEN x.lvl ELSE t.urgency END AS effective_urgency
FROM fx_items p JOIN fx_topics t ON t.name = p.topic_name
LEFT JOIN span x ON x.topic_name = p.topic_name AND p.fetched_at >= x.start_at
                AND p.fetched_at < x.end_at""")
def score_urgency(spark, sf_dir):
    """Every scoring call with the escalation of its topic at the call's time."""
    trans, _ = _esc(spark, sf_dir)
    calls = fx.fx_scores(spark, sf_dir).select("event_id", "call_ts").join(
        fx.fx_items(spark, sf_dir).select("event_id", "topic_name"), "event_id")
    out = E.urgency_at(calls, E.escalation_intervals(trans), fx.fx_topics(spark), "call_ts")
    return out.select("event_id", "topic_name", ts_text("call_ts").alias("call_ts"), "bumped_to",
                      "trigger_tag", "effective_urgency")
