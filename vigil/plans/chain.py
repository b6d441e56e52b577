"""Chained poll runs: each run reads the state that the last one wrote.

A run takes the items that landed since the run before.  Sources whose breaker
is open at the run's time are left out; the rest are deduplicated, compared
with the stored seen set (pruned at the run's time), aged, budgeted, scored
from the reply table up to the call that exhausts the quota, and held against
the topic's threshold.  What passes goes to the archive, the capped index and
the seen set; the run's attempts move the breaker state on.  Every table is a
new snapshot under the shared checkpoint folder, so a repeated run rewrites
its own and a failing read raises.

The driver loops over runs, as a scheduler would; each run is a few Spark jobs
whose work grows with the run's items.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import breaker as Br
from vigil.operators import budget as Bu
from vigil.operators import relational as R
from vigil.operators import scoring as S
from vigil.operators.index import index_top
from vigil.plans.registry import query, r6, ts_text
from vigil.session import scratch_path
from vigil.sources import fixtures as fx

RUN = "run_day"
#: Classes of an attempt after which the item has a score.
SCORED = ("ok", "wait", "retry")


def poll_once(items: DataFrame, topics: DataFrame, seen: DataFrame, breaker: DataFrame | None,
              replies: DataFrame, n_topics: int, cap: int | None = None) -> DataFrame:
    """Passed items of one run (columns of ``items``, ``score``); ``items``
    carry ``run_day`` and ``run_at``."""
    if breaker is not None:
        at = items.select("topic_name", F.col("source").alias("adapter"), "run_at").distinct()
        off = Br.breaker_is_disabled(breaker.join(at, ["topic_name", "adapter"]), F.col("run_at"))
        items = items.join(off.where("is_disabled").select(
            "topic_name", F.col("adapter").alias("source")), ["topic_name", "source"], "left_anti")
    unseen = R.new_items(R.dedup_within_run(items), seen, run_at="run_at")
    fresh = R.fresh_items(unseen, F.col("run_at"))
    cap = Bu.run_cap(cap)
    counts = fresh.groupBy(RUN, "topic_ord").agg(F.count("*").alias("n"))
    sent = Bu.apply_budget(fresh, Bu.allocate_budget(counts, n_topics, cap, run=RUN), cap, run=RUN)
    classes = S.classify_attempts(replies).select("event_id", "class")
    calls = sent.join(classes, "event_id").withColumn(
        "call_ord", F.struct("topic_ord", "source_ord", "term_ord", "item_pos")).withColumn(
        "abort", F.col("class") == "abort")
    scored = Bu.quota_prefix(calls, run=RUN).where(F.col("class").isin(*SCORED))
    return S.score_join(scored, replies, topics).where("passed").drop(
        "call_ord", "abort", "class", "passed", "novelty_threshold", "is_relevant",
        "preliminary_tags", "allowed_tags")


def poll_chain(spark: SparkSession, sf_dir: str, unit: str = "week",
               cap: int | None = None) -> DataFrame:
    """Run after run over the fixture tables; returns the archive."""
    base = scratch_path(spark, f"chain-{uuid.uuid4().hex[:12]}")
    span = F.expr("INTERVAL 7 DAYS" if unit == "week" else "INTERVAL 1 DAY")
    day = F.date_trunc(unit, F.col("fetched_at"))
    items = fx.fx_items(spark, sf_dir).withColumn(RUN, day).withColumn("run_at", day + span)
    topics = fx.fx_topics(spark)
    replies = fx.fx_scores(spark, sf_dir)
    attempts = fx.fx_attempts(spark, sf_dir)
    seen = fx.fx_seen(spark, sf_dir).select("url", "seen_at", "source_type")
    breaker = index = None
    runs = [r[0] for r in items.select(RUN).distinct().orderBy(RUN).collect()]
    for i, run in enumerate(runs):
        now = F.lit(run).cast("timestamp")
        passed = _snapshot(poll_once(items.where(F.col(RUN) == now), topics, seen, breaker,
                                     replies, fx.N_TOPICS, cap), f"{base}/archive/run={i}")
        seen = _snapshot(R.upsert_seen(R.prune_seen(seen, now + span), passed, now + span),
                         f"{base}/seen/{i}")
        rows = passed if index is None else index.unionByName(passed)
        index = _snapshot(index_top(rows).drop("pos"), f"{base}/index/{i}")
        mine = attempts.where((F.col("ts") >= now) & (F.col("ts") < now + span))
        breaker = _snapshot(Br.breaker_fold(mine, init=breaker)[1].select(
            "topic_name", "adapter", "consecutive_failures", "disabled", "disabled_at"),
            f"{base}/breaker/{i}")
    if not runs:
        return items.withColumn("score", F.col("novelty_score")).where("false")
    return spark.read.option("basePath", f"{base}/archive").parquet(f"{base}/archive")


def _snapshot(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@query("poll_chain")
def chained(spark, sf_dir):
    """Weekly runs that feed each other; tested against a sequential replay
    (the state of each run depends on what the one before scored)."""
    return poll_chain(spark, sf_dir).select(
        ts_text(RUN).alias(RUN), "event_id", "topic_name", "url", r6("score").alias("score"))
