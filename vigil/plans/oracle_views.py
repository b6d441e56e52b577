"""DuckDB text of the fixture views, for the SQL oracle of every query.

These are the same definitions as ``vigil.sources.fixtures`` written in
ANSI/DuckDB SQL over the pre-registered driver tables.  ``with_views``
emits a ``WITH`` clause holding the views a query needs (dependencies
first).
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def ts_text(expr: str) -> str:
    """Timestamp as text with microseconds (same as ``functions.ts_text``)."""
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


_TYPES10 = "['news','social','shopping','video','feeds','weather','science','jobs','entertainment','other']"
_TYPES9 = "['news','social','shopping','video','feeds','weather','science','jobs','entertainment']"


def _url(e: str = "event_id") -> str:
    return (f"CASE WHEN {e} % 997 = 0 THEN '' ELSE 'https://x.example.com/i/' || CAST("
            f"CASE WHEN {e} % 20 = 7 THEN {e} % 400 ELSE {e} - {e} % 3 END AS VARCHAR) END")


def _topic(expr: str) -> str:
    return f"'topic_' || lpad(CAST({expr} AS VARCHAR), 2, '0')"


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_topics": ((), f"""
SELECT range AS topic_ord,
       {_topic('range')} AS name,
       'Items about ' || {_topic('range')} AS description,
       CASE WHEN range % 2 = 0 THEN 'high' ELSE 'low' END AS importance,
       CASE WHEN range IN (5, 9) THEN 'high' WHEN range IN (3, 4, 10, 12) THEN 'low'
            ELSE 'medium' END AS urgency,
       CAST(0.40 + 0.03 * range AS DOUBLE) AS novelty_threshold,
       range % 3 = 0 AS push,
       CAST(0.50 + 0.02 * range AS DOUBLE) AS push_threshold,
       CASE WHEN range % 5 = 0 THEN 'immediate' ELSE 'weekly_digest' END AS email,
       range % 4 <> 3 AS auto_revert
FROM range(13)"""),
    # triggers of a topic in config order, one row each (even topics only)
    "fx_triggers": (("fx_topics",), """
SELECT t.topic_ord, t.name, x.pos, x.tag, x.bump_to, x.duration_hours
FROM fx_topics t
JOIN (VALUES (1, 'tag0', 'high', 48.0), (2, 'tag1', 'urgent', 24.0))
     AS x(pos, tag, bump_to, duration_hours) ON t.topic_ord % 2 = 0"""),
    "fx_items": ((), f"""
SELECT event_id,
       user_id % 13 AS topic_ord,
       {_topic('user_id % 13')} AS topic_name,
       event_id % 3 AS source_ord,
       'src' || CAST(event_id % 3 AS VARCHAR) AS source,
       CAST(0 AS BIGINT) AS term_ord,
       event_id AS item_pos,
       {_url()} AS url,
       'Item ' || CAST(event_id AS VARCHAR) || ' ' || event_type AS title,
       props AS snippet,
       {_TYPES10}[event_id % 10 + 1] AS source_type,
       ts AS fetched_at,
       CASE WHEN event_id % 4 = 0 THEN NULL
            WHEN event_id % 50 = 1 THEN date_trunc('day', ts) + INTERVAL 1 DAY - INTERVAL 7 DAY
            WHEN event_id % 50 = 6 THEN date_trunc('day', ts) + INTERVAL 1 DAY - INTERVAL 30 DAY
            ELSE ts - (event_id % 45) * INTERVAL 1 DAY END AS published_at,
       date_trunc('day', ts) AS run_day,
       CAST(date_trunc('day', ts) + INTERVAL 1 DAY AS TIMESTAMP) AS run_at,
       CASE WHEN event_id % 11 = 0 THEN NULL
            ELSE CAST((event_id * 7919) % 1001 AS DOUBLE) / 1000.0 END AS novelty_score,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'tag' || CAST(event_id % 7 AS VARCHAR) END AS tag
FROM events"""),
    "fx_seen": ((), f"""
SELECT event_id, {_url()} AS url,
       {AS_OF} - ((event_id * 13) % 400) * INTERVAL 1 DAY
         - CASE WHEN event_id % 30 = 0 THEN INTERVAL 23 HOUR ELSE INTERVAL 0 HOUR END AS seen_at,
       {_TYPES9}[event_id % 9 + 1] AS source_type
FROM events WHERE event_id % 15 = 0"""),
    "fx_attempts": ((), f"""
SELECT {_topic('user_id % 12')} AS topic_name,
       'src' || CAST(event_id % 3 AS VARCHAR) AS adapter,
       ts, event_id AS seq,
       event_type IN ('error', 'signup', 'view') AS failed
FROM events"""),
    "fx_over": (("fx_items", "fx_topics"), """
SELECT i.*,
       CASE WHEN i.event_id % 13 = 0 THEN NULL ELSE i.event_id % 3 = 0 END AS notified_digest,
       CASE WHEN i.tag IN ('tag0', 'tag1') AND i.topic_ord % 2 = 0 THEN i.tag END
         AS escalation_trigger
FROM fx_items i JOIN fx_topics t USING (topic_ord)
WHERE i.novelty_score >= t.novelty_threshold"""),
    # insertion order of a run: topics, sources, terms, items; the index of a
    # topic shows it backwards and keeps 100 rows
    "fx_index": (("fx_over",), """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY topic_name ORDER BY run_day DESC, source_ord DESC,
                               term_ord DESC, item_pos DESC) AS pos
  FROM fx_over) WHERE pos <= 100"""),
    "fx_read": ((), f"""
SELECT {_url()} AS url FROM events WHERE event_id % 6 = 0"""),
}


def register(name: str, deps: tuple[str, ...], body: str) -> None:
    VIEWS[name] = (deps, body)


def _order(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in VIEWS[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_views(*names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause defining the named views (plus extra CTEs after them)."""
    parts = [f"{n} AS ({VIEWS[n][1]}\n)" for n in _order(list(names))]
    parts += [f"{n} AS ({body}\n)" for n, body in (extra or [])]
    return "WITH " + ",\n".join(parts) + "\n"


# ---------------------------------------------------------------------------
# Poll-chain views (R12 → R01 → R02 → R03 → R09) in SQL.
# ---------------------------------------------------------------------------

def case_map(expr: str, mapping: dict, default: str = "NULL") -> str:
    """``CASE expr WHEN k THEN v ... ELSE default END`` from a constant map."""
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def _install_chain() -> None:
    from vigil.conventions import RETENTION_DAYS, STALE_CUTOFF_DAYS

    keep_days = case_map("COALESCE(s.source_type, 'news')", RETENTION_DAYS, "90")
    register("o_seen_pruned", ("fx_seen",), f"""
SELECT s.* FROM fx_seen s
WHERE seen_at > {AS_OF} - ({keep_days} + 1) * INTERVAL 1 DAY""")
    # each run prunes and reads the seen set at its own time
    register("o_new", ("fx_items", "fx_seen"), f"""
SELECT * FROM fx_items i
WHERE NOT EXISTS (SELECT 1 FROM fx_seen s WHERE s.url = i.url AND s.seen_at < i.run_at
                  AND s.seen_at > i.run_at - ({keep_days} + 1) * INTERVAL 1 DAY)""")
    register("o_dedup", ("o_new",), """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY run_day, url
                               ORDER BY topic_ord, source_ord, term_ord, item_pos) AS rn
  FROM o_new) WHERE rn = 1""")
    cutoff = case_map("source_type", STALE_CUTOFF_DAYS)
    register("o_fresh", ("o_dedup",), f"""
SELECT * FROM o_dedup
WHERE ({cutoff}) IS NULL OR published_at IS NULL
   OR published_at >= run_at - ({cutoff}) * INTERVAL 1 DAY""")
    register("o_passed", ("o_fresh", "fx_topics"), """
SELECT f.* FROM o_fresh f JOIN fx_topics t USING (topic_ord)
WHERE f.novelty_score >= t.novelty_threshold""")


_install_chain()


def _install_budget() -> None:
    register("o_counts", ("o_fresh",), """
SELECT run_day, topic_ord, count(*) AS n FROM o_fresh GROUP BY run_day, topic_ord""")
    register("o_budget", ("o_counts", "fx_topics"), """
WITH RECURSIVE grid AS (
  SELECT r.run_day, t.topic_ord, COALESCE(c.n, 0) AS n
  FROM (SELECT DISTINCT run_day FROM o_counts) r CROSS JOIN fx_topics t
  LEFT JOIN o_counts c ON c.run_day = r.run_day AND c.topic_ord = t.topic_ord),
b(run_day, topic_ord, n, used_before, budget, sent) AS (
  SELECT run_day, topic_ord, n, 0, CAST(ceil(20.0 / 13) AS INTEGER),
         least(n, CAST(ceil(20.0 / 13) AS INTEGER)) FROM grid WHERE topic_ord = 0
  UNION ALL
  SELECT g.run_day, g.topic_ord, g.n, b.used_before + b.sent,
         CAST(ceil(CAST(20 - (b.used_before + b.sent) AS DOUBLE) / (13 - g.topic_ord)) AS INTEGER),
         least(g.n, CAST(ceil(CAST(20 - (b.used_before + b.sent) AS DOUBLE) / (13 - g.topic_ord)) AS INTEGER))
  FROM b JOIN grid g ON g.run_day = b.run_day AND g.topic_ord = b.topic_ord + 1)
SELECT * FROM b""")
    register("o_budgeted", ("o_fresh", "o_budget"), """
SELECT f.* FROM (
  SELECT *, row_number() OVER (PARTITION BY run_day, topic_ord
                               ORDER BY source_ord, term_ord, item_pos) AS rn FROM o_fresh) f
JOIN o_budget b ON b.run_day = f.run_day AND b.topic_ord = f.topic_ord
WHERE f.rn <= b.budget""")
    register("o_scored_passed", ("o_budgeted", "fx_topics"), """
SELECT f.* EXCLUDE (rn) FROM o_budgeted f JOIN fx_topics t USING (topic_ord)
WHERE f.novelty_score >= t.novelty_threshold""")


_install_budget()


def _install_notify() -> None:
    register("fx_feedback", (), """
SELECT l.doc_id % 13 AS topic_ord, l.doc_id AS fb_seq,
       CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 1 ELSE -1 END AS vote,
       d.text AS title,
       CASE WHEN l.doc_id % 2 = 0 THEN NULL ELSE 'note ' || CAST(l.doc_id AS VARCHAR) END AS note
FROM labels l JOIN documents d ON d.doc_id = l.doc_id""")
    register("fx_delivered", ("fx_index",), """
SELECT url FROM fx_index WHERE NOT COALESCE(notified_digest, false) AND event_id % 4 <> 0""")
    register("o_digest", ("fx_index",), """
SELECT *, row_number() OVER (PARTITION BY topic_name ORDER BY COALESCE(novelty_score, 0.0) DESC,
                             pos) AS rank_in_topic
FROM fx_index WHERE NOT COALESCE(notified_digest, false)""")


_install_notify()


def _install_scoring() -> None:
    score = ("CAST(CAST(((event_id * 7919) % 1001 - (event_id * 7919) % 1001 % 1000) / 1000 AS BIGINT) AS VARCHAR)"
             " || '.' || lpad(CAST((event_id * 7919) % 1001 % 1000 AS VARCHAR), 3, '0')")
    register("fx_scores", (), f"""
SELECT event_id, ts AS call_ts,
  CASE WHEN event_id % 17 = 0 THEN '{{"novelty_score": ' || {score}
       WHEN event_id % 19 = 0 THEN '{{"is_relevant": true, "reasoning": "n/a"}}'
       ELSE '{{"novelty_score": ' || {score} || ', "is_relevant": '
            || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END
            || ', "preliminary_tags": ["tag' || CAST(event_id % 7 AS VARCHAR) || '", "tagX"], '
            || '"reasoning": "r' || CAST(event_id AS VARCHAR) || '"}}' END AS response,
  CASE event_id % 8 WHEN 1 THEN '429 Resource exhausted. Please retry in 5s.'
       WHEN 2 THEN '429 quota exceeded' WHEN 3 THEN 'HTTP 500 internal error in JSON gateway'
       WHEN 4 THEN 'Quota exceeded, Retry in 400s' WHEN 5 THEN 'JSONDecodeError: Expecting value'
       WHEN 7 THEN 'rate limited (429): retry in 12.5s' END AS error_text,
  CASE event_id % 8 WHEN 5 THEN 'parse' WHEN 0 THEN NULL WHEN 6 THEN NULL ELSE 'api' END AS error_class,
  CAST((event_id // 8) % 3 + 1 AS INTEGER) AS attempt
FROM events""")
    register("o_parsed", ("fx_scores",), """
SELECT event_id, call_ts, error_text,
       CASE WHEN json_valid(response) THEN TRY_CAST(json_extract(response, '$.novelty_score') AS DOUBLE) END AS score,
       CASE WHEN json_valid(response) THEN TRY_CAST(json_extract(response, '$.is_relevant') AS BOOLEAN) END AS is_relevant,
       CASE WHEN json_valid(response) THEN CAST(json_extract(response, '$.preliminary_tags') AS VARCHAR[]) END AS preliminary_tags
FROM fx_scores""")
    register("o_classified", ("fx_scores",), """
SELECT *, CASE WHEN error_text IS NULL THEN 'ok'
     WHEN error_class = 'parse' THEN CASE WHEN attempt < 3 THEN 'retry' ELSE 'skip' END
     WHEN (contains(error_text, '429') OR contains(lower(error_text), 'quota')) AND w <= 300 AND attempt < 3 THEN 'wait'
     WHEN contains(error_text, '429') OR contains(lower(error_text), 'quota') THEN 'abort'
     ELSE 'skip' END AS class
FROM (SELECT *, TRY_CAST(NULLIF(regexp_extract(error_text, '(?i)retry in (\\d+(?:\\.\\d+)?)s', 1), '') AS DOUBLE) + 2.0 AS w
      FROM fx_scores)""")


_install_scoring()
