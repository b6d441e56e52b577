"""Notification, digest, dashboard and context queries (N*, A02–A08, K01–K06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.conventions import AS_OF
from vigil.operators import aggregates as A
from vigil.operators import context as C
from vigil.operators import escalation as E
from vigil.operators import notify as N
from vigil.operators import sinks as K
from vigil.plans import poll
from vigil.plans.oracle_views import AS_OF as AS_OF_SQL
from vigil.plans.oracle_views import ts_text as ts_sql
from vigil.plans.oracle_views import with_views
from vigil.plans.registry import query, r6, ts_text
from vigil.sources import fixtures as fx

_RANK = "CASE {x} WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 WHEN 'urgent' THEN 3 ELSE 0 END"
_EFF = f"""
SELECT t.name, CASE WHEN s.expires_at IS NOT NULL AND {AS_OF_SQL} >= s.expires_at THEN t.urgency
            WHEN s.bumped_to IS NULL THEN t.urgency
            WHEN {_RANK.format(x='s.bumped_to')} > {_RANK.format(x='t.urgency')} THEN s.bumped_to
            ELSE t.urgency END AS effective_urgency
FROM fx_topics t LEFT JOIN o_esc_state s ON s.topic_name = t.name"""


def _urgency(spark, sf_dir):
    from vigil.plans.q_state import _esc
    _, state = _esc(spark, sf_dir)
    return E.effective_urgency(fx.fx_topics(spark), state, AS_OF)


def _push(spark, sf_dir):
    """What the runs push: their passed items, after the escalations."""
    pr = poll.run(spark, sf_dir)
    return N.push_queue(E.match_triggers(pr.scored_passed, pr.topics), pr.topics,
                        _urgency(spark, sf_dir))


_PUSH_SQL = """
SELECT i.*, g.tag AS escalation_trigger, e.effective_urgency
FROM o_scored_passed i JOIN fx_topics t USING (topic_ord)
LEFT JOIN fx_triggers g ON g.topic_ord = i.topic_ord AND g.tag = i.tag
LEFT JOIN eff e ON e.name = i.topic_name
WHERE t.push AND (g.tag IS NOT NULL OR COALESCE(i.novelty_score, 0.0) >= t.push_threshold)"""


@query("push_queue", with_views("o_scored_passed", "fx_triggers", "fx_topics", "o_esc_state",
                                extra=[("eff", _EFF), ("pq", _PUSH_SQL)]) + """
SELECT event_id, topic_name, effective_urgency FROM pq""")
def push_queue(spark, sf_dir):
    return _push(spark, sf_dir).select("event_id", "topic_name", "effective_urgency")


@query("push_payload", with_views("o_scored_passed", "fx_triggers", "fx_topics", "o_esc_state",
                                  extra=[("eff", _EFF), ("pq", _PUSH_SQL)]) + """
SELECT event_id, topic_name,
       CASE WHEN escalation_trigger IS NOT NULL AND escalation_trigger <> ''
            THEN topic_name || ' · ' || escalation_trigger ELSE topic_name END AS push_title,
       title AS push_body,
       CASE effective_urgency WHEN 'urgent' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3
            WHEN 'low' THEN 2 ELSE 4 END AS priority,
       CASE WHEN escalation_trigger IS NOT NULL AND escalation_trigger <> '' THEN 'rotating_light'
            ELSE 'bell' END AS push_tag,
       url AS click
FROM pq""")
def push_payload(spark, sf_dir):
    return N.push_payload(_push(spark, sf_dir)).withColumn("priority", F.col("priority").cast("int"))


def _digest(spark, sf_dir):
    return N.digest_items(fx.fx_index(spark, sf_dir))


@query("digest_items", with_views("o_digest") + """
SELECT event_id, topic_name, round(novelty_score, 6) AS novelty_score,
       CAST(rank_in_topic AS BIGINT) AS rank_in_topic FROM o_digest""")
def digest_items(spark, sf_dir):
    return _digest(spark, sf_dir).select("event_id", "topic_name",
                                         r6("novelty_score").alias("novelty_score"),
                                         F.col("rank_in_topic").cast("bigint").alias("rank_in_topic"))


def _icon_sql(expr):
    from vigil.plans.q_functions import _icon_sql as icon
    return icon(expr)


@query("digest_groups", with_views("o_digest") + f"""
SELECT topic_name, CAST(count(*) AS BIGINT) AS n_items,
       {_icon_sql('topic_name')} || ' ' || topic_name AS header
FROM o_digest GROUP BY topic_name""")
def digest_groups(spark, sf_dir):
    return N.digest_groups(N.undigested(fx.fx_index(spark, sf_dir))).select(
        "topic_name", F.col("n_items").cast("bigint").alias("n_items"), "header")


def _esc_sql(x: str) -> str:
    return (f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), "
            f"'>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')")


@query("digest_cards", with_views("o_digest") + f"""
SELECT event_id, topic_name, CAST(rank_in_topic AS BIGINT) AS rank_in_topic,
       {_esc_sql('title')} AS title_html,
       md5(substring({_esc_sql("COALESCE(NULLIF(snippet, ''), '')")}, 1, 400)) AS summary_md5,
       array_to_string(list_transform(CASE WHEN tag IS NULL THEN [] ELSE [tag] END,
                                      lambda t: {_esc_sql('t')}), ', ') AS tags_text,
       COALESCE(printf('%.2f', novelty_score), '—') AS score_text,
       CASE WHEN novelty_score IS NULL THEN 'muted' WHEN novelty_score >= 0.75 THEN 'green'
            WHEN novelty_score >= 0.55 THEN 'yellow' ELSE 'red' END AS band
FROM o_digest""")
def digest_cards(spark, sf_dir):
    d = _digest(spark, sf_dir).withColumn("summary", F.lit(None).cast("string")).withColumn(
        "price", F.lit(None).cast("string"))
    return N.digest_cards(d).select(
        "event_id", "topic_name", F.col("rank_in_topic").cast("bigint").alias("rank_in_topic"),
        "title_html", F.md5("summary_html").alias("summary_md5"), "tags_text", "score_text", "band")


@query("digest_mark_back", with_views("fx_index", "fx_delivered") + """
SELECT event_id, COALESCE(url IN (SELECT url FROM fx_delivered), false)
                 OR COALESCE(notified_digest, false) AS notified_digest
FROM fx_index""")
def digest_mark_back(spark, sf_dir):
    out = N.mark_digested(fx.fx_index(spark, sf_dir), fx.fx_delivered(spark, sf_dir))
    return out.select("event_id", "notified_digest")


@query("digest_subject", with_views("o_digest") + """
SELECT DISTINCT strftime(run_day, '%Y-%m-%d') AS run_day,
       'Digest — ' || strftime(run_day, '%b %d, %Y') AS subject FROM o_digest""")
def digest_subject(spark, sf_dir):
    d = N.undigested(fx.fx_index(spark, sf_dir)).select("run_day").distinct()
    return d.select(F.date_format("run_day", "yyyy-MM-dd").alias("run_day"),
                    N.digest_subject(F.col("run_day")).alias("subject"))


@query("digest_footer", with_views("o_digest") + """
SELECT CAST(count(*) AS BIGINT) AS n,
       CAST(count(*) AS VARCHAR) || ' result' || CASE WHEN count(*) <> 1 THEN 's' ELSE '' END
         || ' this week' AS footer
FROM o_digest""")
def digest_footer(spark, sf_dir):
    """One footer per mail."""
    return A.digest_footer(N.undigested(fx.fx_index(spark, sf_dir)))


@query("topic_list", with_views("fx_index") + """
SELECT topic_name, CAST(count(*) AS BIGINT) AS n_results,
       bool_or(escalation_trigger IS NOT NULL) AS escalated
FROM fx_index GROUP BY topic_name""")
def topic_list(spark, sf_dir):
    return A.topic_list(fx.fx_index(spark, sf_dir)).select(
        "topic_name", F.col("n_results").cast("bigint").alias("n_results"), "escalated")


@query("last_fetched", with_views("fx_index") + """
SELECT COALESCE(strftime(max(fetched_at), '%Y-%m-%d %H:%M:%S'), '—') AS last_fetched FROM fx_index""")
def last_fetched(spark, sf_dir):
    return A.last_fetched(fx.fx_index(spark, sf_dir))


@query("feedback_context", with_views("fx_feedback") + """
SELECT topic_ord, CAST(count(*) AS INTEGER) AS n_lines,
       md5('\n\nUser preference history for this topic (use to calibrate your scoring):\n'
           || string_agg(line, chr(10) ORDER BY fb_seq)) AS feedback_md5
FROM (SELECT topic_ord, fb_seq,
             CASE WHEN vote = 1 THEN '👍' ELSE '👎' END || ' "' || substring(COALESCE(title, ''), 1, 70)
               || '"' || CASE WHEN COALESCE(note, '') <> '' THEN ' — "' || note || '"' ELSE '' END AS line
      FROM fx_feedback
      QUALIFY row_number() OVER (PARTITION BY topic_ord ORDER BY fb_seq DESC) <= 8)
GROUP BY topic_ord""")
def feedback_context(spark, sf_dir):
    ctx = C.feedback_context(fx.fx_feedback(spark, sf_dir))
    return ctx.select("topic_ord", F.col("n_lines").cast("int").alias("n_lines"),
                      F.md5("feedback_text").alias("feedback_md5"))


@query("feedback_tally", with_views("fx_feedback") + """
SELECT topic_ord, CAST(count(*) FILTER (WHERE vote = 1) AS BIGINT) AS up,
       CAST(count(*) FILTER (WHERE vote <> 1) AS BIGINT) AS down, CAST(count(*) AS BIGINT) AS n
FROM fx_feedback GROUP BY topic_ord""")
def feedback_tally(spark, sf_dir):
    t = A.feedback_tally(fx.fx_feedback(spark, sf_dir))
    return t.select("topic_ord", *[F.col(c).cast("bigint").alias(c) for c in ("up", "down", "n")])


def _accepted(spark, sf_dir):
    pr = poll.run(spark, sf_dir)
    thr = pr.topics.select("topic_ord", "novelty_threshold")
    scored = (pr.budgeted.join(thr, "topic_ord")
              .withColumn("accepted", F.coalesce(F.col("novelty_score") >= F.col("novelty_threshold"),
                                                 F.lit(False))))
    return C.accepted_context(scored)


_ACC_SQL = """
SELECT b.*, COALESCE(b.novelty_score >= t.novelty_threshold, false) AS accepted
FROM o_budgeted b JOIN fx_topics t USING (topic_ord)"""
_ACC_CTX = """
SELECT event_id, topic_ord, title, snippet, source,
       list_filter(list(CASE WHEN accepted THEN substring(title, 1, 80) END) OVER w,
                   lambda x: x IS NOT NULL) AS titles
FROM acc
WINDOW w AS (PARTITION BY run_day, topic_ord ORDER BY source_ord, term_ord, item_pos
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
_ACC_TEXT = """CASE WHEN COALESCE(len(titles), 0) > 0 THEN
  chr(10) || chr(10) || 'Already accepted in this batch (same topic, this run):' || chr(10)
  || array_to_string(list_transform(list_slice(titles, greatest(len(titles) - 14, 1), len(titles)),
                                    lambda t: '- ' || t), chr(10))
  || chr(10) || 'If this item covers the same story or event as any of the above, score its novelty_score below 0.4 regardless of source.'
  ELSE '' END"""


@query("accepted_context", with_views("o_budgeted", "fx_topics",
                                      extra=[("acc", _ACC_SQL), ("ctx", _ACC_CTX)]) + f"""
SELECT event_id, CAST(COALESCE(len(titles), 0) AS INTEGER) AS n_accepted_before,
       md5({_ACC_TEXT}) AS accepted_md5 FROM ctx""")
def accepted_context(spark, sf_dir):
    return _accepted(spark, sf_dir).select(
        "event_id", F.col("n_accepted_before").cast("int").alias("n_accepted_before"),
        F.md5("accepted_text").alias("accepted_md5"))


_FB_TEXT = """
SELECT topic_ord, '\n\nUser preference history for this topic (use to calibrate your scoring):\n'
           || string_agg(line, chr(10) ORDER BY fb_seq) AS feedback_text
FROM (SELECT topic_ord, fb_seq,
             CASE WHEN vote = 1 THEN '👍' ELSE '👎' END || ' "' || substring(COALESCE(title, ''), 1, 70)
               || '"' || CASE WHEN COALESCE(note, '') <> '' THEN ' — "' || note || '"' ELSE '' END AS line
      FROM fx_feedback
      QUALIFY row_number() OVER (PARTITION BY topic_ord ORDER BY fb_seq DESC) <= 8)
GROUP BY topic_ord"""


@query("scoring_prompt", with_views("o_budgeted", "fx_topics", "fx_feedback",
                                    extra=[("acc", _ACC_SQL), ("ctx", _ACC_CTX), ("fb", _FB_TEXT)]) + f"""
SELECT c.event_id,
       md5('Topic: ' || t.name || chr(10) || 'Description: ' || t.description || chr(10)
           || 'Available tags: [''tag0'', ''tag1'', ''tag2'', ''tag3'', ''tag4'']' || chr(10) || chr(10)
           || 'Title: ' || c.title || chr(10) || 'Snippet: ' || COALESCE(c.snippet, '') || chr(10)
           || 'Source: ' || c.source || COALESCE(fb.feedback_text, '') || {_ACC_TEXT}) AS prompt_md5
FROM ctx c JOIN fx_topics t USING (topic_ord) LEFT JOIN fb USING (topic_ord)""")
def scoring_prompt(spark, sf_dir):
    fb = C.feedback_context(fx.fx_feedback(spark, sf_dir))
    p = C.scoring_prompt(_accepted(spark, sf_dir), fx.fx_topics(spark), fb)
    return p.select("event_id", F.md5("prompt").alias("prompt_md5"))


@query("immediate_queue", with_views("o_scored_passed", "fx_topics") + """
SELECT event_id, '[vigil] ' || topic_name || ': ' || substring(title, 1, 60) AS subject
FROM o_scored_passed WHERE topic_ord IN (SELECT topic_ord FROM fx_topics WHERE email = 'immediate')""")
def immediate_queue(spark, sf_dir):
    pr = poll.run(spark, sf_dir)
    return N.immediate_queue(pr.scored_passed, pr.topics).select("event_id", "subject")


@query("archive_by_month", with_views("o_scored_passed") + """
SELECT strftime(run_day, '%Y-%m') AS month, strftime(run_day, '%Y-%m-%d') AS run_id,
       event_id, topic_name, url FROM o_scored_passed""")
def archive_by_month(spark, sf_dir):
    rows = K.archive_rows(poll.run(spark, sf_dir).scored_passed, F.col("run_day"))
    return rows.select("month", "run_id", "event_id", "topic_name", "url")


@query("index_snapshot", with_views("fx_index") + """
SELECT topic_name, CAST(count(*) AS BIGINT) AS n,
       md5(string_agg(url, ',' ORDER BY pos)) AS urls_md5
FROM fx_index GROUP BY topic_name""")
def index_snapshot(spark, sf_dir):
    snap = K.index_snapshot(fx.fx_index(spark, sf_dir))
    return snap.select("topic_name", F.col("n").cast("bigint").alias("n"),
                       F.md5("urls").alias("urls_md5"))


@query("result_roundtrip", with_views("fx_over") + f"""
SELECT event_id, url, title, snippet, source, source_type, topic_name,
       {ts_sql('fetched_at')} AS fetched_at, {ts_sql('published_at')} AS published_at,
       CASE WHEN source_type = 'shopping' THEN '$' || CAST(event_id % 50 AS VARCHAR) || '.50' END AS price,
       novelty_score, CASE WHEN event_id % 2 = 0 THEN 'Summary "' || title || '"' END AS summary,
       COALESCE(tag, '') AS tags, escalation_trigger, CAST(NULL AS VARCHAR) AS action_url,
       false AS notified_push, COALESCE(notified_digest, false) AS notified_digest
FROM fx_over""")
def result_roundtrip(spark, sf_dir):
    """Records through JSON and back, every persisted field compared."""
    e = F.col("event_id")
    rows = fx.fx_over(spark, sf_dir).withColumn("price", F.when(
        F.col("source_type") == "shopping",
        F.concat(F.lit("$"), (e % 50).cast("string"), F.lit(".50")))).withColumn(
        "summary", F.when(e % 2 == 0, F.concat(F.lit('Summary "'), F.col("title"), F.lit('"'))))
    back = K.roundtrip(rows)
    return back.select(*[ts_text(c).alias(c) if c in ("fetched_at", "published_at") else
                         F.array_join("tags", ",").alias("tags") if c == "tags" else F.col(c)
                         for c in back.columns])
