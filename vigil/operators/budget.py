"""Scoring budget of a run (R06 fair share, R07 global cap, R08 quota stop),
tier resolution (R04), breaker gate (R05), per-group caps (R10, R11).

R06 in topic order: ``budget_i = ceil((cap - used) / topics_left)``, where
``topics_left`` falls for every topic (skipped ones too) and ``used`` grows
by what the topic actually sent (``min(n_i, budget_i)``).  The recurrence
runs over *per-topic counts*, never items, and is blocked so no group holds
a run's whole topic list: topics are cut into blocks of ``block`` topics;
per block a *transfer vector* ``V[u] = used after the block if used = u
before it`` (``u`` in ``0..cap``) is folded with ``aggregate``; the block
vectors are composed per run (one entry per block); each block then replays
its topics from its real entry.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.conventions import BREAKER_COOLDOWN_HOURS, RUN_CAP, TIER_DEFAULT, TIER_MAP

BLOCK = 1024


def _ceil_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.ceil(a.cast("double") / b.cast("double")).cast("int")).otherwise(F.lit(0))


# R06 -------------------------------------------------------------------------
def allocate_budget(counts: DataFrame, n_topics: DataFrame | int, cap: int = RUN_CAP,
                    run: str = "run_id", block: int = BLOCK) -> DataFrame:
    """Per (run, topic_ord): ``budget``, ``used_before`` and ``sent``.

    ``counts(run, topic_ord, n)`` holds the eligible items per topic (topics
    with nothing to send may be absent); ``n_topics`` is the number of topics
    of the run (int, or a DataFrame ``(run, n_topics)``); ``topic_ord`` is the
    0-based position in config order.
    """
    spark = counts.sparkSession
    if isinstance(n_topics, int):
        nt = counts.select(run).distinct().withColumn("n_topics", F.lit(n_topics))
    else:
        nt = n_topics
    c = (counts.join(nt, run)
         .withColumn("_blk", (F.col("topic_ord") / F.lit(block)).cast("bigint"))
         .withColumn("_left", (F.col("n_topics") - F.col("topic_ord")).cast("int")))
    entry_t = F.struct(F.col("topic_ord"), F.col("n").cast("int").alias("n"), F.col("_left"))
    cap_l = F.lit(cap)

    def step_used(u: Column, t: Column) -> Column:
        budget = _ceil_div(cap_l - u, t["_left"])
        return u + F.least(t["n"], budget)

    # level 1: transfer vector per (run, block) over <= block topic entries
    ident = F.sequence(F.lit(0), cap_l)
    blocks = (c.groupBy(run, "_blk")
              .agg(F.sort_array(F.collect_list(entry_t)).alias("_topics"))
              .withColumn("_vec", F.aggregate(
                  "_topics", ident,
                  lambda v, t: F.transform(v, lambda u: step_used(u, t)))))
    # level 2: compose block vectors in order per run (one entry per block)
    bv = F.struct(F.col("_blk"), F.col("_vec"))
    entries = (blocks.groupBy(run).agg(F.sort_array(F.collect_list(bv)).alias("_bv"))
               .select(run, F.posexplode(F.aggregate(
                   "_bv",
                   F.array().cast("array<struct<blk:bigint,entry:int,exit:int>>"),
                   lambda acc, b: F.concat(acc, F.array(F.struct(
                       b["_blk"].alias("blk"),
                       F.coalesce(F.try_element_at(acc, F.lit(-1))["exit"], F.lit(0)).alias("entry"),
                       F.element_at(b["_vec"], F.coalesce(F.try_element_at(acc, F.lit(-1))["exit"],
                                                          F.lit(0)) + 1).alias("exit"))))))
                       .alias("_i", "_e"))
               .select(run, F.col("_e.blk").alias("_blk"), F.col("_e.entry").alias("_entry")))
    # level 3: replay each block from its entry, emitting per-topic budgets
    out_t = "array<struct<topic_ord:bigint,budget:int,used_before:int,sent:int>>"
    per = (blocks.join(entries, [run, "_blk"])
           .select(run, F.explode(F.aggregate(
               "_topics",
               F.struct(F.col("_entry").alias("u"), F.array().cast(out_t).alias("rows")),
               lambda acc, t: F.struct(
                   step_used(acc["u"], t).alias("u"),
                   F.concat(acc["rows"], F.array(F.struct(
                       t["topic_ord"].cast("bigint").alias("topic_ord"),
                       _ceil_div(cap_l - acc["u"], t["_left"]).alias("budget"),
                       acc["u"].alias("used_before"),
                       F.least(t["n"], _ceil_div(cap_l - acc["u"], t["_left"])).alias("sent"))))),
               lambda acc: acc["rows"])).alias("r"))
           .select(run, "r.*"))
    del spark
    return per


def apply_budget(items: DataFrame, budgets: DataFrame, cap: int = RUN_CAP,
                 run: str = "run_id", order=("source_ord", "term_ord", "item_pos")) -> DataFrame:
    """Keep the first ``budget`` items per (run, topic) in ``order``.

    ``budget <= cap``, so the window carries the literal limit ``cap``: Spark
    plans a partial ``WindowGroupLimit`` before the shuffle (a hot topic ships
    at most ``cap`` rows per map task); the exact per-topic budget is a
    filter after it.
    """
    w = Window.partitionBy(run, "topic_ord").orderBy(*order)
    top = items.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap)
    return (top.join(budgets.select(run, "topic_ord", "budget"), [run, "topic_ord"])
            .where(F.col("_rn") <= F.col("budget")).drop("_rn", "budget"))


def run_cap(cap: int | None = None) -> int:
    """The scoring cap of a run: the argument, else the environment, else 20."""
    return int(cap if cap is not None else os.environ.get("VIGIL_RUN_CAP", RUN_CAP))


# R07 -------------------------------------------------------------------------
def global_cap(items: DataFrame, cap: int = RUN_CAP, run: str = "run_id",
               order=("topic_ord", "source_ord", "term_ord", "item_pos")) -> DataFrame:
    """First ``cap`` items of a run in run order (fair share off)."""
    w = Window.partitionBy(run).orderBy(*order)
    return items.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")


# R08 -------------------------------------------------------------------------
def quota_prefix(attempts: DataFrame, run: str = "run_id", order: str = "call_ord",
                 abort: str = "abort") -> DataFrame:
    """Attempts sent before the run's quota ran out (the aborting call counts
    as sent; nothing after it is).  One ``min`` per run, no window."""
    first = (attempts.where(F.col(abort)).groupBy(run)
             .agg(F.min(order).alias("_first_abort")))
    return (attempts.join(first, run, "left")
            .where(F.col("_first_abort").isNull() | (F.col(order) <= F.col("_first_abort")))
            .drop("_first_abort"))


# R04 -------------------------------------------------------------------------
def resolve_tiers(topics: DataFrame, tier_index: int, urgency: str = "effective_urgency") -> DataFrame:
    """Tier name per topic for ``tier_index`` (NULL: topic has no tier there)."""
    tiers = F.create_map(*[x for k, v in TIER_MAP.items()
                           for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    names = F.coalesce(F.try_element_at(tiers, F.col(urgency)),
                       F.array(*[F.lit(t) for t in TIER_DEFAULT]))
    return topics.withColumn("tier", F.try_element_at(names, F.lit(tier_index + 1)))


# R05 -------------------------------------------------------------------------
def breaker_gate(sources: DataFrame, breaker_state: DataFrame, as_of,
                 cooldown_hours: float = BREAKER_COOLDOWN_HOURS) -> DataFrame:
    """Sources whose (topic, adapter) breaker is not disabled as of ``as_of``."""
    from vigil.operators.breaker import breaker_is_disabled

    off = (breaker_is_disabled(breaker_state, as_of, cooldown_hours)
           .where("is_disabled").select("topic_name", F.col("adapter").alias("source")))
    return sources.join(off, ["topic_name", "source"], "left_anti")


# R10 -------------------------------------------------------------------------
def dedup_in_page(rows: DataFrame, page: str = "page_id", key: str = "href",
                  order: str = "pos") -> DataFrame:
    """First row per (page, href) in page order (partial ``min_by``)."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(page, key).agg(F.min_by(row, F.col(order)).alias("_r")).select("_r.*")


# R11 -------------------------------------------------------------------------
def cap_per_group(df: DataFrame, keys, n: int, order, where: Column | None = None,
                  before: bool = False) -> DataFrame:
    """At most ``n`` rows per group by ``order``; ``where`` applies after the
    cap (``before=True``: top-n of all rows, then filter) or before it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    if where is not None and not before:
        df = df.where(where)
    out = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
    if where is not None and before:
        out = out.where(where)
    return out
