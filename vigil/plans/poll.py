"""Stages of the poll runs over the fixture views (shared by queries and bench).

``within-run dedup → seen anti-join → staleness → fair-share budget →
threshold`` for every run (a ``run_day``) at once, each at its own time
``run_at`` against the stored seen set.  Runs that feed each other, with the
breaker gate, scored replies, the quota stop and the sinks, are chained in
``vigil.plans.chain``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.conventions import AS_OF
from vigil.operators import budget as Bu
from vigil.operators import relational as R
from vigil.sources import fixtures as fx

RUN = "run_day"


class PollRun:
    """Lazy DataFrames of one poll run (runs are the fixture ``run_day``s)."""

    def __init__(self, spark: SparkSession, sf_dir: str, as_of=AS_OF, cap: int | None = None):
        cap = Bu.run_cap(cap)
        self.spark, self.sf_dir, self.as_of, self.cap = spark, sf_dir, as_of, cap
        self.topics = fx.fx_topics(spark)
        self.items = fx.fx_items(spark, sf_dir, as_of)
        stored = fx.fx_seen(spark, sf_dir, as_of)
        self.seen = R.prune_seen(stored, as_of)
        self.new = R.new_items(self.items, stored, run_at="run_at")
        self.deduped = R.new_items(R.dedup_within_run(self.items), stored, run_at="run_at")
        self.fresh = R.fresh_items(self.deduped, F.col("run_at"))
        self.passed_unbudgeted = R.passed_items(self.fresh, self.topics)
        self.counts = self.fresh.groupBy(RUN, "topic_ord").agg(F.count("*").alias("n"))
        self.budgets = Bu.allocate_budget(self.counts, fx.N_TOPICS, cap, run=RUN)
        self.budgeted = Bu.apply_budget(self.fresh, self.budgets, cap, run=RUN)
        self.scored_passed = R.passed_items(self.budgeted, self.topics)


def run(spark: SparkSession, sf_dir: str, as_of=AS_OF, cap: int | None = None) -> PollRun:
    return PollRun(spark, sf_dir, as_of, cap)


# Compatibility helpers used by the queries.
def pruned_seen(spark, sf_dir, as_of=AS_OF) -> DataFrame:
    return run(spark, sf_dir, as_of).seen


def new_items(spark, sf_dir, as_of=AS_OF) -> DataFrame:
    return run(spark, sf_dir, as_of).new


def deduped(spark, sf_dir, as_of=AS_OF) -> DataFrame:
    return run(spark, sf_dir, as_of).deduped


def fresh(spark, sf_dir, as_of=AS_OF) -> DataFrame:
    return run(spark, sf_dir, as_of).fresh


def passed(spark, sf_dir, as_of=AS_OF) -> DataFrame:
    return run(spark, sf_dir, as_of).passed_unbudgeted


def fresh_counts(spark, sf_dir, as_of=AS_OF) -> DataFrame:
    return run(spark, sf_dir, as_of).counts


def budgets(spark, sf_dir, as_of=AS_OF, cap: int | None = None) -> DataFrame:
    return run(spark, sf_dir, as_of, cap).budgets


def budgeted(spark, sf_dir, as_of=AS_OF, cap: int | None = None) -> DataFrame:
    return run(spark, sf_dir, as_of, cap).budgeted


def scored_passed(spark, sf_dir, as_of=AS_OF, cap: int | None = None) -> DataFrame:
    return run(spark, sf_dir, as_of, cap).scored_passed
