"""Relational core queries: seen set, dedup, freshness, threshold, index."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.conventions import AS_OF
from vigil.operators import index as W
from vigil.operators import relational as R
from vigil.plans import poll
from vigil.plans.oracle_views import AS_OF as AS_OF_SQL
from vigil.plans.oracle_views import ts_text as ts_sql
from vigil.plans.oracle_views import with_views
from vigil.plans.registry import query, r6, ts_text
from vigil.sources import fixtures as fx


@query("seen_prune", with_views("o_seen_pruned") + f"""
SELECT event_id, url, {ts_sql('seen_at')} AS seen_at, source_type FROM o_seen_pruned""")
def seen_prune(spark, sf_dir):
    return poll.pruned_seen(spark, sf_dir).select(
        "event_id", "url", ts_text("seen_at").alias("seen_at"), "source_type")


@query("new_items", with_views("o_new") + """
SELECT event_id, url, topic_name FROM o_new""")
def new_items(spark, sf_dir):
    return poll.new_items(spark, sf_dir).select("event_id", "url", "topic_name")


@query("dedup_within_run", with_views("o_dedup") + f"""
SELECT event_id, url, {ts_sql('run_day')} AS run_day, topic_name FROM o_dedup""")
def dedup_within_run(spark, sf_dir):
    return poll.deduped(spark, sf_dir).select(
        "event_id", "url", ts_text("run_day").alias("run_day"), "topic_name")


@query("fresh_items", with_views("o_fresh") + f"""
SELECT event_id, source_type, {ts_sql('published_at')} AS published_at FROM o_fresh""")
def fresh_items(spark, sf_dir):
    return poll.fresh(spark, sf_dir).select(
        "event_id", "source_type", ts_text("published_at").alias("published_at"))


@query("passed_items", with_views("o_passed") + """
SELECT event_id, topic_name, round(novelty_score, 6) AS novelty_score FROM o_passed""")
def passed_items(spark, sf_dir):
    return poll.passed(spark, sf_dir).select(
        "event_id", "topic_name", r6("novelty_score").alias("novelty_score"))


_HL = """
SELECT event_id, topic_name, url, round(novelty_score, 6) AS novelty_score,
       escalation_trigger FROM fx_index
WHERE novelty_score >= 0.8 OR escalation_trigger IS NOT NULL"""


@query("highlights", with_views("fx_index") + _HL)
def highlights(spark, sf_dir):
    return W.highlights(fx.fx_index(spark, sf_dir)).select(
        "event_id", "topic_name", "url", r6("novelty_score").alias("novelty_score"),
        "escalation_trigger")


@query("highlights_ranked", with_views("fx_index", "fx_read") + """
SELECT event_id, topic_name, url, round(novelty_score, 6) AS novelty_score, escalation_trigger, is_read,
       CAST(row_number() OVER (ORDER BY is_read, COALESCE(novelty_score, -1.0) DESC,
                               topic_ord, pos) AS BIGINT) AS rank
FROM (SELECT h.*, EXISTS (SELECT 1 FROM fx_read r WHERE r.url = h.url) AS is_read
      FROM fx_index h WHERE novelty_score >= 0.8 OR escalation_trigger IS NOT NULL)""")
def highlights_ranked(spark, sf_dir):
    hl = W.highlights(fx.fx_index(spark, sf_dir))
    ranked = W.rank_unread(hl, fx.fx_read(spark, sf_dir))
    return ranked.select("event_id", "topic_name", "url",
                         r6("novelty_score").alias("novelty_score"), "escalation_trigger",
                         "is_read", F.col("rank").cast("bigint").alias("rank"))


@query("topic_results_ranked", with_views("fx_index", "fx_read") + """
SELECT event_id, topic_name, is_read,
       CAST(row_number() OVER (PARTITION BY topic_name ORDER BY is_read,
            COALESCE(novelty_score, -1.0) DESC, pos) AS BIGINT) AS rank
FROM (SELECT h.*, EXISTS (SELECT 1 FROM fx_read r WHERE r.url = h.url) AS is_read
      FROM fx_index h)""")
def topic_results_ranked(spark, sf_dir):
    ranked = W.rank_unread(fx.fx_index(spark, sf_dir), fx.fx_read(spark, sf_dir),
                           by=("topic_name",), tie=("pos",))
    return ranked.select("event_id", "topic_name", "is_read",
                         F.col("rank").cast("bigint").alias("rank"))


# --- budget / caps / tiers / gate -----------------------------------------------
from vigil.operators import budget as Bu  # noqa: E402
from vigil.operators import breaker as Br  # noqa: E402
from vigil.operators import escalation as Es  # noqa: E402


@query("budget_allocation", with_views("o_budget") + f"""
SELECT {ts_sql('run_day')} AS run_day, CAST(topic_ord AS BIGINT) AS topic_ord, budget,
       used_before, sent FROM o_budget WHERE n > 0""")
def budget_allocation(spark, sf_dir):
    return poll.budgets(spark, sf_dir).select(
        ts_text("run_day").alias("run_day"), F.col("topic_ord").cast("bigint").alias("topic_ord"),
        "budget", "used_before", "sent")


@query("budgeted_items", with_views("o_budgeted") + f"""
SELECT event_id, {ts_sql('run_day')} AS run_day, topic_name FROM o_budgeted""")
def budgeted_items(spark, sf_dir):
    return poll.budgeted(spark, sf_dir).select("event_id", ts_text("run_day").alias("run_day"),
                                               "topic_name")


@query("global_cap", with_views("o_fresh") + f"""
SELECT event_id, {ts_sql('run_day')} AS run_day FROM o_fresh
QUALIFY row_number() OVER (PARTITION BY run_day
                           ORDER BY topic_ord, source_ord, term_ord, item_pos) <= 20""")
def global_cap(spark, sf_dir):
    return Bu.global_cap(poll.fresh(spark, sf_dir), run="run_day").select(
        "event_id", ts_text("run_day").alias("run_day"))


@query("tier_resolution", with_views("o_esc_state", "fx_topics") + f"""
SELECT name, tier_index,
       CASE WHEN eff IN ('urgent', 'high') THEN ['frequent', 'discovery', 'broad', 'broad']
            WHEN eff = 'medium' THEN ['discovery', 'broad', 'broad']
            WHEN eff = 'low' THEN ['broad', 'broad'] ELSE ['discovery'] END[tier_index + 1] AS tier
FROM (SELECT t.name,
             CASE WHEN s.expires_at IS NOT NULL AND {AS_OF_SQL} >= s.expires_at THEN t.urgency
                  WHEN s.bumped_to IS NULL THEN t.urgency
                  WHEN (CASE s.bumped_to WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2
                        WHEN 'urgent' THEN 3 ELSE 0 END) >
                       (CASE t.urgency WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2
                        WHEN 'urgent' THEN 3 ELSE 0 END) THEN s.bumped_to
                  ELSE t.urgency END AS eff
      FROM fx_topics t LEFT JOIN o_esc_state s ON s.topic_name = t.name)
CROSS JOIN (SELECT range AS tier_index FROM range(4))""")
def tier_resolution(spark, sf_dir):
    from vigil.plans.q_state import _esc
    _, state = _esc(spark, sf_dir)
    eff = Es.effective_urgency(fx.fx_topics(spark), state, AS_OF)
    out = None
    for i in range(4):
        part = Bu.resolve_tiers(eff, i).select("name", F.lit(i).cast("bigint").alias("tier_index"), "tier")
        out = part if out is None else out.unionByName(part)
    return out


@query("breaker_gate", with_views("o_breaker_steps", "fx_topics") + f"""
SELECT t.name AS topic_name, s.source
FROM fx_topics t CROSS JOIN (VALUES ('src0'), ('src1'), ('src2')) s(source)
WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT topic_name, adapter, dis, dat,
                        rn = max(rn) OVER (PARTITION BY topic_name, adapter) AS is_last
                 FROM o_breaker_steps) b
  WHERE b.is_last AND b.topic_name = t.name AND b.adapter = s.source
    AND b.dis AND (b.dat IS NULL OR {AS_OF_SQL} - b.dat < INTERVAL 6 HOUR))""")
def breaker_gate(spark, sf_dir):
    _, state = Br.breaker_fold(fx.fx_attempts(spark, sf_dir))
    sources = fx.fx_topics(spark).select(
        F.col("name").alias("topic_name"),
        F.explode(F.array(*[F.lit(f"src{i}") for i in range(3)])).alias("source"))
    return Bu.breaker_gate(sources, state, AS_OF).select("topic_name", "source")


@query("dedup_in_page", """
SELECT page_id, href, CAST(min(pos) AS BIGINT) AS pos
FROM (SELECT page_id, unnest(h) AS href, unnest(generate_series(1, len(h))) AS pos
      FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages))
GROUP BY page_id, href""")
def dedup_in_page(spark, sf_dir):
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    rows = (fx.table(spark, sf_dir, "pages").select("page_id", F.posexplode(hrefs).alias("p", "href"))
            .select("page_id", "href", (F.col("p") + 1).cast("bigint").alias("pos")))
    return Bu.dedup_in_page(rows).select("page_id", "href", "pos")


@query("cap_before_filter", """
SELECT doc_id FROM (SELECT doc_id, lang,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)
WHERE rn <= 10 AND lang = 'en'""")
def cap_before_filter(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    return Bu.cap_per_group(d, ["source"], 10, [F.col("doc_id")], F.col("lang") == "en",
                            before=True).select("doc_id")


@query("cap_after_filter", """
SELECT doc_id FROM (SELECT doc_id,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents WHERE lang = 'en')
WHERE rn <= 10""")
def cap_after_filter(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    return Bu.cap_per_group(d, ["source"], 10, [F.col("doc_id")], F.col("lang") == "en",
                            before=False).select("doc_id")


@query("index_top100", with_views("fx_index") + """
SELECT topic_name, event_id, CAST(pos AS BIGINT) AS pos FROM fx_index""")
def index_top100(spark, sf_dir):
    return W.index_top(fx.fx_over(spark, sf_dir)).select(
        "topic_name", "event_id", F.col("pos").cast("bigint").alias("pos"))


@query("run_summary", with_views("fx_items", "o_new", "o_dedup", "o_budgeted",
                                 "o_scored_passed", "fx_topics") + f"""
SELECT {ts_sql('run_day')} AS run_day, topic_name,
       CAST(sum(fetched) AS BIGINT) AS fetched, CAST(sum(new) AS BIGINT) AS new,
       CAST(sum(scored) AS BIGINT) AS scored, CAST(sum(passed) AS BIGINT) AS passed
FROM (SELECT r.run_day, t.name AS topic_name,
             (SELECT count(*) FROM fx_items i WHERE i.run_day = r.run_day AND i.topic_ord = t.topic_ord) AS fetched,
             (SELECT count(*) FROM o_dedup i WHERE i.run_day = r.run_day AND i.topic_ord = t.topic_ord) AS new,
             (SELECT count(*) FROM o_budgeted i WHERE i.run_day = r.run_day AND i.topic_ord = t.topic_ord) AS scored,
             (SELECT count(*) FROM o_scored_passed i WHERE i.run_day = r.run_day AND i.topic_ord = t.topic_ord) AS passed
      FROM (SELECT DISTINCT run_day FROM fx_items) r CROSS JOIN fx_topics t)
GROUP BY ROLLUP (run_day, topic_name)""")
def run_summary(spark, sf_dir):
    from vigil.operators.aggregates import run_summary as summary
    pr = poll.run(spark, sf_dir)
    return summary(pr.topics, pr.items, pr.deduped, pr.budgets, pr.scored_passed,
                   n_topics=fx.N_TOPICS, run="run_day").select(
        ts_text("run_day").alias("run_day"), "topic_name", "fetched", "new", "scored", "passed")


@query("seen_upsert", with_views("o_seen_pruned", "o_scored_passed") + f"""
SELECT url, {ts_sql('seen_at')} AS seen_at, source_type FROM (
  SELECT url, seen_at, source_type,
         row_number() OVER (PARTITION BY url ORDER BY seen_at DESC, is_new DESC) AS rn
  FROM (SELECT url, seen_at, COALESCE(source_type, 'news') AS source_type, 0 AS is_new FROM o_seen_pruned
        UNION ALL
        SELECT url, run_day, COALESCE(source_type, 'news'), 1 FROM o_scored_passed))
WHERE rn = 1""")
def seen_upsert(spark, sf_dir):
    seen = poll.pruned_seen(spark, sf_dir)
    passed = poll.scored_passed(spark, sf_dir)
    return R.upsert_seen(seen, passed, F.col("run_day")).select(
        "url", ts_text("seen_at").alias("seen_at"), "source_type")


@query("retry_eligible", with_views("fx_items", "o_scored_passed") + """
SELECT DISTINCT url FROM fx_items
WHERE url NOT IN (SELECT url FROM o_scored_passed)""")
def retry_eligible(spark, sf_dir):
    return R.retry_eligible(fx.fx_items(spark, sf_dir), poll.scored_passed(spark, sf_dir))


@query("poll_run", with_views("o_scored_passed", "fx_triggers") + f"""
SELECT p.event_id, {ts_sql('p.run_day')} AS run_day, p.topic_name,
       round(p.novelty_score, 6) AS novelty_score, t.tag AS escalation_trigger
FROM o_scored_passed p
LEFT JOIN fx_triggers t ON t.topic_ord = p.topic_ord AND t.tag = p.tag""")
def poll_run(spark, sf_dir):
    """A whole poll run per fixture day: seen anti-join → dedup → staleness →
    fair-share budget → scoring threshold → escalation trigger match."""
    pr = poll.run(spark, sf_dir)
    m = Es.match_triggers(pr.scored_passed, pr.topics)
    return m.select("event_id", ts_text("run_day").alias("run_day"), "topic_name",
                    r6("novelty_score").alias("novelty_score"), "escalation_trigger")
