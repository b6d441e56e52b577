"""Relational core of a poll run: seen set, dedup, freshness, threshold.

R01 new_items        anti-join against the (pruned) seen set
R02 dedup_within_run first occurrence of a URL per run wins
R03 fresh_items      per-type staleness cutoff on a publication column
R09 passed_items     score >= topic threshold
R12 prune_seen       per-type retention
R13 upsert_seen      latest sighting per URL
R14 retry_eligible   fetched-but-not-passed URLs stay out of the seen set
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.conventions import (ORD_COLS, RETENTION_DAYS, RETENTION_DEFAULT_DAYS,
                               STALE_CUTOFF_DAYS)


def map_lit(mapping: Mapping) -> Column:
    """A literal MAP column (small fixed lookup, evaluated in codegen)."""
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def _ts(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


# R12 -----------------------------------------------------------------------
def prune_seen(seen: DataFrame, as_of, retention: Mapping[str, int] = RETENTION_DAYS,
               default_days: int = RETENTION_DEFAULT_DAYS) -> DataFrame:
    """Drop URLs whose whole days since ``seen_at`` exceed the type's limit.

    ``floor(days) > max`` is ``seen_at <= as_of - (max + 1) days``; a missing
    type counts as ``news``.
    """
    limit = _ts(as_of) - F.make_dt_interval(
        days=(keep_days(retention, default_days) + 1).cast("int"))
    return seen.where(F.col("seen_at") > limit)


def keep_days(retention: Mapping[str, int] = RETENTION_DAYS,
              default_days: int = RETENTION_DEFAULT_DAYS) -> Column:
    stype = F.coalesce(F.col("source_type"), F.lit("news"))
    return F.coalesce(F.try_element_at(map_lit(retention), stype), F.lit(default_days))


# R01 -----------------------------------------------------------------------
def new_items(items: DataFrame, seen: DataFrame, key: str = "url",
              run_at: str | None = None) -> DataFrame:
    """Items whose key is not in the seen set (left anti-join on ``key``).

    With ``run_at`` each item is judged at its own run's time: only marks made
    before it count, and only while their retention lasts then.  In a run the
    within-run dedup comes first, which gives the same rows (whether a URL is
    seen depends on the URL alone) and leaves one row per run and URL here.
    """
    if run_at is None:
        return items.join(seen.select(key), key, "left_anti")
    marks = seen.select(F.col(key).alias("_key"), F.col("seen_at").alias("_from"),
                        (F.col("seen_at") + F.make_dt_interval(
                            days=(keep_days() + 1).cast("int"))).alias("_until"))
    return items.join(marks, (F.col(key) == F.col("_key")) & (F.col(run_at) > F.col("_from"))
                      & (F.col(run_at) < F.col("_until")), "left_anti")


# R02 -----------------------------------------------------------------------
def dedup_within_run(items: DataFrame, keys: Sequence[str] = ("run_day", "url"),
                     order: Sequence[str] = ORD_COLS) -> DataFrame:
    """Keep the first row per ``keys`` by ``order``.

    ``min_by`` is a declarative aggregate: Spark combines it map-side, so a
    hot key (the empty URL, a viral link) never reaches one task whole.
    """
    cols = [c for c in items.columns]
    rank = F.struct(*[F.col(c) for c in order])
    row = F.struct(*[F.col(c) for c in cols])
    return (items.groupBy(*keys).agg(F.min_by(row, rank).alias("_first"))
            .select("_first.*"))


# R03 -----------------------------------------------------------------------
def fresh_items(items: DataFrame, as_of, cutoffs: Mapping[str, int] = STALE_CUTOFF_DAYS,
                col: str = "published_at") -> DataFrame:
    """Drop iff the type has a cutoff, ``col`` is set, and age > cutoff (strict)."""
    cutoff = F.try_element_at(map_lit(cutoffs), F.col("source_type"))
    too_old = F.col(col) < _ts(as_of) - F.make_dt_interval(days=cutoff.cast("int"))
    return items.where(cutoff.isNull() | F.col(col).isNull() | ~too_old)


# R09 -----------------------------------------------------------------------
def passed_items(scored: DataFrame, topics: DataFrame, score: str = "novelty_score",
                 key: str = "topic_ord") -> DataFrame:
    """Keep rows with ``score >= novelty_threshold`` of their topic (null drops)."""
    thr = topics.select(key, "novelty_threshold")
    return (scored.join(thr, key)
            .where(F.col(score) >= F.col("novelty_threshold"))
            .drop("novelty_threshold"))


# R13 -----------------------------------------------------------------------
def upsert_seen(seen: DataFrame, passed: DataFrame, as_of) -> DataFrame:
    """Seen set after marking ``passed`` URLs seen at ``as_of`` (a value or a
    column such as the run time).

    A URL keeps one row, the latest sighting — a new mark wins a tie
    (``max_by``: a partial aggregate, no per-URL sort).
    """
    marked = passed.select("url", _ts(as_of).alias("seen_at"),
                           F.coalesce(F.col("source_type"), F.lit("news")).alias("source_type"),
                           F.lit(1).alias("_new"))
    old = seen.select("url", "seen_at", F.coalesce(F.col("source_type"), F.lit("news"))
                      .alias("source_type"), F.lit(0).alias("_new"))
    return (old.unionByName(marked).groupBy("url")
            .agg(F.max_by(F.struct("seen_at", "source_type"),
                          F.struct("seen_at", "_new")).alias("s"))
            .select("url", "s.seen_at", "s.source_type"))


# R14 -----------------------------------------------------------------------
def retry_eligible(fetched: DataFrame, passed: DataFrame) -> DataFrame:
    """Fetched URLs not passed this run: they stay eligible next run."""
    return fetched.select("url").distinct().join(passed.select("url"), "url", "left_anti")
