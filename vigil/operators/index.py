"""Index and read-side views: capped index, digest order, highlights.

W01 index_top       newest-first top-N per topic (WindowGroupLimit)
W03 highlights      novelty >= 0.8 or an escalation trigger
W04 rank_unread     unread first, then novelty desc
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.conventions import INDEX_MAX
from vigil.operators.positions import with_positions


def newest_first() -> list[Column]:
    """Insertion order reversed: runs, then sources, terms and items of a run."""
    return [F.col(c).desc() for c in ("run_day", "source_ord", "term_ord", "item_pos")]


# W01 -----------------------------------------------------------------------
def index_top(rows: DataFrame, n: int = INDEX_MAX, key: str = "topic_name",
              order: Sequence[Column] | None = None, name: str = "pos") -> DataFrame:
    """Top ``n`` rows per ``key`` newest insertion first.

    ``row_number() <= n`` over a per-key window is planned as a partial
    ``WindowGroupLimit`` before the shuffle and a final one after it, so a
    hot topic ships at most ``n`` rows per map task.
    """
    order = order or newest_first()
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


# W03 -----------------------------------------------------------------------
def highlights(index: DataFrame, min_score: float = 0.8) -> DataFrame:
    return index.where((F.col("novelty_score") >= min_score)
                       | F.col("escalation_trigger").isNotNull())


def mark_read(rows: DataFrame, read: DataFrame) -> DataFrame:
    """Add ``is_read`` from a read-URL set (semi-join flavour, no duplicates)."""
    r = read.select("url").distinct().withColumn("is_read", F.lit(True))
    return (rows.join(r, "url", "left")
            .withColumn("is_read", F.coalesce(F.col("is_read"), F.lit(False))))


# W04 -----------------------------------------------------------------------
def rank_unread(rows: DataFrame, read: DataFrame, by: Sequence[str] = (),
                tie: Sequence[str] = ("topic_ord", "pos"), name: str = "rank") -> DataFrame:
    """Rank index rows unread first, then novelty desc, then in the order of
    the index (``tie`` columns, unique together).

    Inside a topic the index holds at most its cap of rows, a plain window;
    the ranking over all topics (``by=()``) uses the skew-safe positions
    operator, which spreads it over many range partitions.
    """
    marked = mark_read(rows, read)
    order = [F.col("is_read").asc(),
             F.coalesce(F.col("novelty_score"), F.lit(-1.0)).desc(),
             *(F.col(t).asc() for t in tie)]
    if by:
        return marked.withColumn(name, F.row_number().over(
            Window.partitionBy(*by).orderBy(*order)))
    return with_positions(marked, [], order, name=name)
