"""Run and dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# A01 -------------------------------------------------------------------------
def run_summary(topics: DataFrame, fetched: DataFrame, new: DataFrame, budgets: DataFrame,
                passed: DataFrame, n_topics: int, run: str = "run_id",
                key: str = "topic_ord") -> DataFrame:
    """Per run and topic: fetched, new, scored (sent), passed — every topic of
    every run appears (zeros included); ``rollup`` adds per-run and overall
    totals (``topic_name`` / ``run`` NULL)."""
    names = ["fetched", "new", "scored", "passed"]
    # each stage is counted by itself; scored is what the budget table sent
    parts = [fetched.groupBy(run, key).agg(F.count("*").alias("fetched")),
             new.groupBy(run, key).agg(F.count("*").alias("new")),
             budgets.select(run, key, F.col("sent").cast("bigint").alias("scored")),
             passed.groupBy(run, key).agg(F.count("*").alias("passed"))]
    tagged = parts[0]
    for part in parts[1:]:
        tagged = tagged.unionByName(part, allowMissingColumns=True)
    counts = tagged.groupBy(run, key).agg(*[F.sum(n).alias(n) for n in names])
    # every topic of every run: topic positions exploded per run, then an
    # equi-join to the topic table (no cross join)
    runs = fetched.select(run).distinct().select(
        run, F.explode(F.sequence(F.lit(0).cast("bigint"),
                                  F.lit(n_topics - 1).cast("bigint"))).alias(key))
    grid = runs.join(topics.select(key, F.col("name").alias("topic_name")), key)
    full = (grid.join(counts, [run, key], "left")
            .select(run, "topic_name", *[F.coalesce(F.col(n), F.lit(0)).alias(n)
                                         for n in names]))
    return (full.rollup(run, "topic_name")
            .agg(*[F.sum(n).cast("bigint").alias(n) for n in names]))


# A02 -------------------------------------------------------------------------
def topic_list(index: DataFrame) -> DataFrame:
    return (index.groupBy("topic_name")
            .agg(F.count("*").alias("n_results"),
                 F.bool_or(F.col("escalation_trigger").isNotNull()).alias("escalated")))


# A03 -------------------------------------------------------------------------
def last_fetched(index: DataFrame) -> DataFrame:
    """Latest instant (not string max) or a dash when the index is empty."""
    return index.agg(F.coalesce(F.date_format(F.max("fetched_at"), "yyyy-MM-dd HH:mm:ss"),
                                F.lit("—")).alias("last_fetched"))


# A04 -------------------------------------------------------------------------
def digest_footer(rows: DataFrame) -> DataFrame:
    n = F.count("*")
    return rows.agg(n.alias("n"), F.concat(n.cast("string"), F.lit(" result"),
                                         F.when(n != 1, F.lit("s")).otherwise(F.lit("")),
                                         F.lit(" this week")).alias("footer"))


# A08 -------------------------------------------------------------------------
def feedback_tally(feedback: DataFrame) -> DataFrame:
    return (feedback.groupBy("topic_ord")
            .agg(F.count_if(F.col("vote") == 1).alias("up"),
                 F.count_if(F.col("vote") != 1).alias("down"),
                 F.count("*").alias("n")))
