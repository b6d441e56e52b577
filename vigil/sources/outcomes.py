"""Attempt outcomes (M04): what was asked of a source against what came back.

``attempt_outcomes(plan, landed)`` reconciles the request plan with the landed
payloads.  An attempt is one source entry of one topic in one run.  It fails if

* a reply failed (an error, a body that cannot be read, missing credentials),
  even if other replies of it gave rows;
* a planned request has no reply at all,

provided that its source reports failures (some never do).  An unhandled
exception fails any source.  Feeds of ``BY_BODY`` fail only if they are
malformed and hold no entry; a publication feed of ``SEARCHED`` that cannot be
read is skipped, only its search can fail.

    plan(run_id, topic_name, source_ord, source, value)
    landed(run_id, topic_name, source_ord, source, term, kind, fetched_ts, status, body)

``kind`` is ``feed`` for the feeds that a search found, else null.  Null values
of the plan and null terms are one request without a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.sources.feeds import feed_failed

# Sources that never report a failure.
NEVER_FAIL = ("google_news", "rss", "reddit", "hacker_news", "mastodon", "bluesky",
              "slickdeals", "camelcamelcamel", "weather")
# Feeds whose failure is told by their body.
BY_BODY = ("arxiv", "indeed")
# Sources that search for feeds and then read them.
SEARCHED = ("substack",)

ATTEMPT = ["run_id", "topic_name", "source_ord", "source"]


def reply_failed() -> Column:
    """Whether a landed payload marks its attempt as failed."""
    src, status = F.col("source"), F.col("status")
    unread = status == "malformed"
    found_feed = src.isin(*SEARCHED) & F.coalesce(F.col("kind") == "feed", F.lit(False))
    reported = (F.when(src.isin(*BY_BODY), status.isin("error", "no_credentials") | (
                    ~status.isin("error", "no_credentials", "exception") & feed_failed()))
                .when(found_feed, status == "error")
                .otherwise(unread | status.isin("error", "no_credentials")))
    return F.coalesce((status == "exception") | (reported & ~src.isin(*NEVER_FAIL)), F.lit(False))


def attempt_outcomes(plan: DataFrame, landed: DataFrame) -> DataFrame:
    """One row per attempt: ``ts`` of its last reply, ``failed``,
    ``n_requests`` planned, ``n_missing`` of them without a reply, and
    ``n_payloads`` landed (also unplanned ones)."""
    asked = plan.select(*ATTEMPT, F.coalesce("value", F.lit("")).alias("value")).groupBy(
        *ATTEMPT, "value").agg(F.lit(1).cast("long").alias("asked"))
    came = landed.select(*ATTEMPT, F.coalesce("term", F.lit("")).alias("value"), "fetched_ts",
                         reply_failed().alias("bad")).groupBy(*ATTEMPT, "value").agg(
        F.max("fetched_ts").alias("ts"), F.bool_or("bad").alias("bad"), F.count("*").alias("n"))
    both = asked.join(came, [*ATTEMPT, "value"], "full")
    missing = F.col("n").isNull()
    reports = ~F.col("source").isin(*NEVER_FAIL)
    zero = F.lit(0).cast("long")
    return both.groupBy(*ATTEMPT).agg(
        F.max("ts").alias("ts"),
        F.bool_or(F.coalesce(F.col("bad"), F.lit(False)) | (missing & reports)).alias("failed"),
        F.sum(F.coalesce("asked", zero)).alias("n_requests"),
        F.count_if(missing).alias("n_missing"), F.sum(F.coalesce("n", zero)).alias("n_payloads"))
