"""Scoring context text (A05–A07): feedback lines, already-accepted titles
and the full scoring prompt per item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Vote signs and section headers of the prompt text.
UP, DOWN = "\U0001f44d", "\U0001f44e"
FEEDBACK_HEADER = ("\n\nUser preference history for this topic "
                   "(use to calibrate your scoring):\n")
ACCEPTED_HEADER = "\n\nAlready accepted in this batch (same topic, this run):\n"
ACCEPTED_FOOTER = ("\nIf this item covers the same story or event as any of the above, "
                   "score its novelty_score below 0.4 regardless of source.")


# A05 -------------------------------------------------------------------------
def feedback_lines(feedback: DataFrame) -> Column:
    sign = F.when(F.col("vote") == 1, F.lit(UP)).otherwise(F.lit(DOWN))
    note = F.when(F.coalesce(F.col("note"), F.lit("")) != "",
                  F.concat(F.lit(' — "'), F.col("note"), F.lit('"'))).otherwise(F.lit(""))
    return F.concat(sign, F.lit(' "'), F.substring(F.coalesce(F.col("title"), F.lit("")), 1, 70),
                    F.lit('"'), note)


def feedback_context(feedback: DataFrame, n: int = 8, key: str = "topic_ord") -> DataFrame:
    """Last ``n`` votes per topic in file order (``fb_seq``) as prompt text.

    ``row_number() <= n`` (literal) plans a partial WindowGroupLimit, so a
    topic with a huge feedback log ships at most ``n`` rows per map task; the
    per-topic list then holds at most ``n`` entries.
    """
    w = Window.partitionBy(key).orderBy(F.col("fb_seq").desc())
    last = (feedback.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
            .withColumn("_line", feedback_lines(feedback)))
    return (last.groupBy(key)
            .agg(F.sort_array(F.collect_list(F.struct("fb_seq", "_line"))).alias("_l"))
            .select(key, F.size("_l").alias("n_lines"),
                    F.concat(F.lit(FEEDBACK_HEADER),
                             F.array_join(F.transform("_l", lambda x: x["_line"]), "\n"))
                    .alias("feedback_text")))


# A06 -------------------------------------------------------------------------
def accepted_context(scored: DataFrame, n: int = 15, run: str = "run_day",
                     key: str = "topic_ord", order=("source_ord", "term_ord", "item_pos"),
                     accepted: str = "accepted") -> DataFrame:
    """For each item, the last ``n`` earlier accepted titles of the same
    scoring call (one call per run and topic), each cut to 80 characters.

    A call holds at most the run cap of items, so this window is bounded.
    """
    w = (Window.partitionBy(run, key).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, -1))
    titles = F.collect_list(F.when(F.col(accepted), F.substring("title", 1, 80))).over(w)
    last = F.slice(titles, F.greatest(F.size(titles) - n + 1, F.lit(1)), n)
    text = F.when(F.size(titles) > 0, F.concat(
        F.lit(ACCEPTED_HEADER), F.array_join(F.transform(last, lambda t: F.concat(F.lit("- "), t)),
                                             "\n"), F.lit(ACCEPTED_FOOTER))).otherwise(F.lit(""))
    return scored.withColumn("accepted_text", text).withColumn(
        "n_accepted_before", F.size(titles))


# A07 -------------------------------------------------------------------------
def scoring_prompt(items: DataFrame, topics: DataFrame, fb_context: DataFrame,
                   key: str = "topic_ord") -> DataFrame:
    """Full prompt text per item (topic, tags, item fields, feedback and
    accepted-title context)."""
    t = topics.select(key, F.col("name").alias("_tname"), F.col("description").alias("_tdesc"),
                      F.col("tags").alias("_ttags"))
    tag_list = F.concat(F.lit("["), F.array_join(
        F.transform("_ttags", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    prompt = F.concat(
        F.lit("Topic: "), F.col("_tname"), F.lit("\nDescription: "), F.col("_tdesc"),
        F.lit("\nAvailable tags: "), tag_list,
        F.lit("\n\nTitle: "), F.col("title"), F.lit("\nSnippet: "), F.coalesce(F.col("snippet"), F.lit("")),
        F.lit("\nSource: "), F.col("source"),
        F.coalesce(F.col("feedback_text"), F.lit("")), F.coalesce(F.col("accepted_text"), F.lit("")))
    return (items.join(t, key).join(fb_context.select(key, "feedback_text"), key, "left")
            .withColumn("prompt", prompt).drop("_tname", "_tdesc", "_ttags"))
