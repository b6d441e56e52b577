"""Notification decisions and digest tables.

Delivery (mail, push POST) stays outside: these operators produce the
queues and card tables a delivery worker reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.lookups import push_priority, score_band, topic_icon
from vigil.functions.price import fixed2
from vigil.functions.text import html_escape

# Push tag per topic name (default "bell"; escalated → siren).
PUSH_TOPIC_TAGS = {
    "Immigration & ICE": "rotating_light",
    "Jobs": "briefcase",
    "Shopping": "shopping_cart",
    "Health research": "pill",
    "Drag Race & drag": "crown",
    "Queer & trans": "rainbow",
    "Politics & world": "newspaper",
}
PUSH_TAG_DEFAULT = "bell"
PUSH_TAG_ESCALATED = "rotating_light"
SCORE_MISSING = "—"


# N01 / K05 -----------------------------------------------------------------
def push_queue(passed: DataFrame, topics: DataFrame, urgency: DataFrame,
               key: str = "topic_ord") -> DataFrame:
    """Items to push: topic has push on and (escalated or score >= the topic's
    push threshold, NULL score = 0).  ``urgency(name, effective_urgency)`` is
    the topic urgency after this run's escalations."""
    t = topics.select(key, F.col("push").alias("_push"), "push_threshold")
    u = urgency.select(F.col("name").alias("topic_name"), "effective_urgency")
    want = F.col("_push") & (F.col("escalation_trigger").isNotNull()
                             | (F.coalesce(F.col("novelty_score"), F.lit(0.0))
                                >= F.col("push_threshold")))
    return (passed.join(t, key).where(want)
            .join(u, "topic_name", "left")
            .drop("_push"))


# N02 -----------------------------------------------------------------------
def push_payload(queue: DataFrame) -> DataFrame:
    trig = F.col("escalation_trigger")
    tags = F.create_map(*[F.lit(x) for kv in PUSH_TOPIC_TAGS.items() for x in kv])
    tag = F.when(trig.isNotNull() & (trig != ""), F.lit(PUSH_TAG_ESCALATED)).otherwise(
        F.coalesce(F.try_element_at(tags, F.col("topic_name")), F.lit(PUSH_TAG_DEFAULT)))
    title = F.when(trig.isNotNull() & (trig != ""),
                   F.concat(F.col("topic_name"), F.lit(" · "), trig)).otherwise(F.col("topic_name"))
    return queue.select(
        "event_id", "topic_name", title.alias("push_title"), F.col("title").alias("push_body"),
        push_priority("effective_urgency").alias("priority"), tag.alias("push_tag"),
        F.col("url").alias("click"))


# N03 / W02 -----------------------------------------------------------------
def undigested(index: DataFrame) -> DataFrame:
    return index.where(~F.coalesce(F.col("notified_digest"), F.lit(False)))


def digest_items(index: DataFrame) -> DataFrame:
    """Index rows not yet in a digest, ranked in digest order per topic
    (``coalesce(novelty, 0)`` desc, then index position).  The index holds at
    most its cap of rows per topic, which bounds the window."""
    order = Window.partitionBy("topic_name").orderBy(
        F.coalesce(F.col("novelty_score"), F.lit(0.0)).desc(), F.col("pos").asc())
    return undigested(index).withColumn("rank_in_topic", F.row_number().over(order))


# N04 -----------------------------------------------------------------------
def digest_groups(digest: DataFrame) -> DataFrame:
    return (digest.groupBy("topic_name")
            .agg(F.count("*").alias("n_items"))
            .withColumn("header", F.concat(topic_icon("topic_name"), F.lit(" "),
                                           html_escape("topic_name"))))


# N05 -----------------------------------------------------------------------
def digest_cards(digest: DataFrame) -> DataFrame:
    summary = F.coalesce(F.nullif(F.col("summary"), F.lit("")),
                         F.nullif(F.col("snippet"), F.lit("")), F.lit(""))
    tags = F.array_join(F.transform(F.coalesce(F.col("tags"), F.array().cast("array<string>")),
                                    lambda t: html_escape(t)), ", ")
    score = F.coalesce(fixed2(F.col("novelty_score")), F.lit(SCORE_MISSING))
    return digest.select(
        "event_id", "topic_name", "rank_in_topic",
        html_escape("title").alias("title_html"),
        F.substring(html_escape(summary), 1, 400).alias("summary_html"),
        tags.alias("tags_text"),
        F.when(F.col("price").isNotNull() & (F.col("price") != ""), html_escape("price"))
         .alias("price_badge"),
        score.alias("score_text"), score_band("novelty_score").alias("band"))


# N06 -----------------------------------------------------------------------
def mark_digested(index: DataFrame, delivered: DataFrame) -> DataFrame:
    """Set ``notified_digest`` for every index row (any topic) whose URL was
    delivered; other rows keep their flag."""
    d = delivered.select("url").distinct().withColumn("_sent", F.lit(True))
    return (index.join(d, "url", "left")
            .withColumn("notified_digest",
                        F.coalesce(F.col("_sent"), F.col("notified_digest"), F.lit(False)))
            .drop("_sent"))


# N07 -----------------------------------------------------------------------
def digest_subject(as_of: Column, prefix: str = "Digest") -> Column:
    return F.concat(F.lit(f"{prefix} — "), F.date_format(as_of, "MMM dd, yyyy"))


def immediate_subject(prefix: str = "[vigil]") -> Column:
    return F.concat(F.lit(prefix + " "), F.col("topic_name"), F.lit(": "),
                    F.substring(F.col("title"), 1, 60))


# K06 -----------------------------------------------------------------------
def immediate_queue(passed: DataFrame, topics: DataFrame, key: str = "topic_ord") -> DataFrame:
    t = topics.where(F.col("email") == "immediate").select(key)
    return passed.join(t, key, "left_semi").withColumn("subject", immediate_subject())
