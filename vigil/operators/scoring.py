"""Scoring re-aims (U02, U04, U05, F21, Q1): the external scorer is a
pluggable table of responses; these operators parse, classify and audit it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


RESPONSE_SCHEMA = T.StructType([
    T.StructField("novelty_score", T.DoubleType()),
    T.StructField("is_relevant", T.BooleanType()),
    T.StructField("preliminary_tags", T.ArrayType(T.StringType())),
    T.StructField("reasoning", T.StringType())])

# Retry hint pattern, extra wait, abort limit, pacing gap.
RETRY_HINT = r"(?i)retry in (\d+(?:\.\d+)?)s"
RETRY_EXTRA_SEC = 2.0
ABORT_WAIT_SEC = 300.0
MIN_GAP_SEC = 5.0


# F21 -------------------------------------------------------------------------
def parse_score_response(df: DataFrame, col: str = "response") -> DataFrame:
    """Parsed fields; ``valid`` needs well-formed JSON with a numeric score
    (malformed text parses to NULLs, never an error)."""
    p = F.from_json(F.col(col), RESPONSE_SCHEMA, {"mode": "PERMISSIVE"})
    return (df.withColumn("_p", p)
            .withColumn("score", F.col("_p.novelty_score"))
            .withColumn("is_relevant", F.col("_p.is_relevant"))
            .withColumn("preliminary_tags", F.col("_p.preliminary_tags"))
            .withColumn("valid", F.col("score").isNotNull())
            .drop("_p"))


# U02 / Q1 ------------------------------------------------------------------------
def score_join(items: DataFrame, scores: DataFrame, topics: DataFrame, key: str = "event_id",
               topic_key: str = "topic_ord") -> DataFrame:
    """Items with their parsed score, allowed tags (the reply's tags that the
    topic lists, in reply order) and the threshold decision."""
    # the few scored items meet their replies before any reply is parsed
    s = parse_score_response(scores.select(key, "response").join(
        items.select(key), key, "left_semi")).select(key, "score", "is_relevant",
                                                     "preliminary_tags")
    t = topics.select(topic_key, F.col("tags").alias("_allowed"), "novelty_threshold")
    allowed = F.filter(F.coalesce(F.col("preliminary_tags"), F.array().cast("array<string>")),
                       lambda x: F.array_contains(F.col("_allowed"), x))
    return (items.join(s, key, "left").join(t, topic_key)
            .withColumn("allowed_tags", F.array_distinct(allowed))
            .withColumn("passed", F.coalesce(F.col("score") >= F.col("novelty_threshold"),
                                             F.lit(False)))
            .drop("_allowed"))


# U04 -------------------------------------------------------------------------
def classify_attempts(log: DataFrame, error: str = "error_text", kind: str = "error_class",
                      attempt: str = "attempt", attempts: int = 3) -> DataFrame:
    """Outcome class of one scoring attempt (numbered from 1):
    ``ok`` | ``retry`` (a reply that does not parse, ``kind`` = ``parse``) |
    ``wait`` (quota error with a hint within the limit) | ``abort`` (quota:
    no hint, hint + 2 s over the limit, or no attempt left) | ``skip`` (any
    other error, or a reply that does not parse on the last attempt).  Whether
    a reply failed to parse is told by ``kind``, never by words in the text."""
    e = F.col(error)
    more = F.col(attempt) < attempts
    hint = F.regexp_extract(e, RETRY_HINT, 1)
    wait = F.when(hint != "", hint.try_cast("double") + F.lit(RETRY_EXTRA_SEC))
    quota = e.contains("429") | F.lower(e).contains("quota")
    parse = F.coalesce(F.col(kind) == "parse", F.lit(False))
    cls = (F.when(e.isNull(), "ok")
           .when(parse & more, "retry")
           .when(parse, "skip")
           .when(quota & (wait <= ABORT_WAIT_SEC) & more, "wait")
           .when(quota, "abort")
           .otherwise("skip"))
    return log.withColumn("class", cls).withColumn("wait_sec", F.when(cls == "wait", wait))


# U05 -------------------------------------------------------------------------
def pacing_gaps(calls: DataFrame, run: str = "run_day", ts: str = "call_ts",
                order: tuple = ("call_ts", "event_id")) -> DataFrame:
    """Gap to the previous call of the same run and a flag when it is under
    the minimum spacing.  A run's calls are bounded by its scoring cap, so the
    per-run window is bounded."""
    w = Window.partitionBy(run).orderBy(*order)
    prev = F.lag(F.col(ts)).over(w)
    gap = F.unix_micros(F.col(ts)) - F.unix_micros(prev)
    return (calls.withColumn("gap_sec", gap / F.lit(1_000_000.0))
            .withColumn("too_fast", F.coalesce(F.col("gap_sec") < MIN_GAP_SEC, F.lit(False))))
