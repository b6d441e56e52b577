"""Fixture views derived from the driver tables (see FIXTURES.md, part B).

Every view is a pure projection / filter of a driver table, so its size
grows with the scale factor and every operator built on it does too.  The
same definitions are written as DuckDB SQL in ``vigil.plans.oracle_views``.
All integer rules use ``%`` on BIGINT only.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.conventions import AS_OF

ITEM_TYPES = ["news", "social", "shopping", "video", "feeds", "weather",
              "science", "jobs", "entertainment", "other"]
SEEN_TYPES = ITEM_TYPES[:9]
N_TOPICS = 13
URL_PREFIX = "https://x.example.com/i/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read anew each time so that a rewritten one is seen."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def as_of_lit(as_of=AS_OF) -> Column:
    return F.lit(as_of).cast("timestamp")


def days(n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.make_dt_interval(days=n.cast("int"))


def topic_name(ord_col: Column) -> Column:
    return F.concat(F.lit("topic_"), F.lpad(ord_col.cast("string"), 2, "0"))


def pick(values: list[str], idx: Column) -> Column:
    """Element ``idx`` (0-based) of a literal list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


# --------------------------------------------------------------------------
# topics
# --------------------------------------------------------------------------

def fx_topics(spark: SparkSession) -> DataFrame:
    o = F.col("topic_ord")
    trig = F.struct
    triggers = F.when(
        o % 2 == 0,
        F.array(trig(F.lit("tag0").alias("tag"), F.lit("high").alias("bump_to"),
                     F.lit(48.0).alias("duration_hours")),
                trig(F.lit("tag1").alias("tag"), F.lit("urgent").alias("bump_to"),
                     F.lit(24.0).alias("duration_hours"))),
    ).otherwise(F.array().cast(
        "array<struct<tag:string,bump_to:string,duration_hours:double>>"))
    return (
        spark.range(N_TOPICS).withColumnRenamed("id", "topic_ord")
        .select(
            o,
            topic_name(o).alias("name"),
            F.concat(F.lit("Items about "), topic_name(o)).alias("description"),
            F.when(o % 2 == 0, "high").otherwise("low").alias("importance"),
            F.when(o.isin(5, 9), "high")
             .when(o.isin(3, 4, 10, 12), "low")
             .otherwise("medium").alias("urgency"),
            (F.lit(Decimal("0.40")) + F.lit(Decimal("0.03")) * o).cast("double").alias("novelty_threshold"),
            (o % 3 == 0).alias("push"),
            (F.lit(Decimal("0.50")) + F.lit(Decimal("0.02")) * o).cast("double").alias("push_threshold"),
            F.when(o % 5 == 0, "immediate").otherwise("weekly_digest").alias("email"),
            F.array(*[F.lit(f"tag{i}") for i in range(5)]).alias("tags"),
            triggers.alias("triggers"),
            (o % 4 != 3).alias("auto_revert"),
        )
    )


# --------------------------------------------------------------------------
# items / seen / attempts
# --------------------------------------------------------------------------

def item_url(event_id: Column) -> Column:
    """Three neighbouring events share a URL; one event in twenty carries a
    URL that comes back on other days; some have none."""
    e = F.when(event_id % 20 == 7, event_id % 400).otherwise(event_id - event_id % 3)
    return F.when(event_id % 997 == 0, F.lit("")).otherwise(
        F.concat(F.lit(URL_PREFIX), e.cast("string")))


def fx_items(spark: SparkSession, sf_dir: str, as_of=AS_OF) -> DataFrame:
    e = F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    run_at = F.date_trunc("day", ts) + days(1)  # a day's run comes at its end
    published = (
        F.when(e % 4 == 0, F.lit(None).cast("timestamp"))
        .when(e % 50 == 1, run_at - days(7))
        .when(e % 50 == 6, run_at - days(30))
        .otherwise(ts - days(e % 45))
    )
    tag = F.when(e % 5 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("tag"), (e % 7).cast("string")))
    return table(spark, sf_dir, "events").select(
        e.alias("event_id"),
        (F.col("user_id") % N_TOPICS).alias("topic_ord"),
        topic_name(F.col("user_id") % N_TOPICS).alias("topic_name"),
        (e % 3).alias("source_ord"),
        F.concat(F.lit("src"), (e % 3).cast("string")).alias("source"),
        F.lit(0).cast("bigint").alias("term_ord"),
        e.alias("item_pos"),
        item_url(e).alias("url"),
        F.concat(F.lit("Item "), e.cast("string"), F.lit(" "), F.col("event_type")).alias("title"),
        F.col("props").alias("snippet"),
        pick(ITEM_TYPES, e % 10).alias("source_type"),
        ts.alias("fetched_at"),
        published.alias("published_at"),
        F.date_trunc("day", ts).alias("run_day"),
        run_at.alias("run_at"),
        F.when(e % 11 == 0, F.lit(None).cast("double")).otherwise(
            ((e * 7919) % 1001).cast("double") / F.lit(1000.0)).alias("novelty_score"),
        tag.alias("tag"),
        F.when(tag.isNull(), F.array().cast("array<string>")).otherwise(F.array(tag)).alias("tags"),
    )


def fx_seen(spark: SparkSession, sf_dir: str, as_of=AS_OF) -> DataFrame:
    e = F.col("event_id")
    now = as_of_lit(as_of)
    seen_at = now - days((e * 13) % 400) - F.when(
        e % 30 == 0, F.make_dt_interval(hours=F.lit(23))).otherwise(F.make_dt_interval())
    return (table(spark, sf_dir, "events").where(e % 15 == 0)
            .select(e.alias("event_id"), item_url(e).alias("url"), seen_at.alias("seen_at"),
                    pick(SEEN_TYPES, e % 9).alias("source_type")))


FAILED_TYPES = ("error", "signup", "view")


def fx_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        topic_name(F.col("user_id") % 12).alias("topic_name"),
        F.concat(F.lit("src"), (e % 3).cast("string")).alias("adapter"),
        F.col("ts").cast("timestamp").alias("ts"),
        e.alias("seq"),
        F.col("event_type").isin(*FAILED_TYPES).alias("failed"),
    )


def fx_over(spark: SparkSession, sf_dir: str, as_of=AS_OF) -> DataFrame:
    """Items over their topic threshold, with digest and escalation flags."""
    items = fx_items(spark, sf_dir, as_of)
    topics = fx_topics(spark).select("topic_ord", "novelty_threshold")
    e = F.col("event_id")
    return (items.join(topics, "topic_ord")
            .where(F.col("novelty_score") >= F.col("novelty_threshold"))
            .drop("novelty_threshold")
            .withColumn("notified_digest",
                        F.when(e % 13 == 0, F.lit(None).cast("boolean")).otherwise(e % 3 == 0))
            .withColumn("escalation_trigger",
                        F.when(F.col("tag").isin("tag0", "tag1") & (F.col("topic_ord") % 2 == 0),
                               F.col("tag"))))


def fx_index(spark: SparkSession, sf_dir: str, as_of=AS_OF) -> DataFrame:
    """The stored index: the newest 100 rows of each topic, with ``pos``."""
    from vigil.operators.index import index_top
    return index_top(fx_over(spark, sf_dir, as_of))


def fx_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return (table(spark, sf_dir, "events").where(e % 6 == 0)
            .select(item_url(e).alias("url")))


def fx_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes from ``labels`` ⋈ ``documents`` in file order ``fb_seq``."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return (table(spark, sf_dir, "labels").join(docs, "doc_id")
            .select((d % N_TOPICS).alias("topic_ord"), d.alias("fb_seq"),
                    F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(-1)
                    .alias("vote"),
                    F.col("text").alias("title"),
                    F.when(d % 2 == 0, F.lit(None).cast("string"))
                    .otherwise(F.concat(F.lit("note "), d.cast("string"))).alias("note")))


def fx_delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery log of a digest: URLs of unsent index rows, a quarter failed."""
    idx = fx_index(spark, sf_dir)
    return (idx.where(~F.coalesce(F.col("notified_digest"), F.lit(False))
                      & (F.col("event_id") % 4 != 0))
            .select("url"))


def _score_text(e: Column) -> Column:
    k = (e * 7919) % 1001
    return F.concat(((k - k % 1000) / 1000).cast("bigint").cast("string"), F.lit("."),
                    F.lpad((k % 1000).cast("string"), 3, "0"))


def fx_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring replies and attempt errors for every item (call time = ts)."""
    e = F.col("event_id")
    body = F.concat(
        F.lit('{"novelty_score": '), _score_text(e),
        F.lit(', "is_relevant": '), F.when(e % 2 == 0, F.lit("true")).otherwise(F.lit("false")),
        F.lit(', "preliminary_tags": ["tag'), (e % 7).cast("string"), F.lit('", "tagX"], '),
        F.lit('"reasoning": "r'), e.cast("string"), F.lit('"}'))
    response = (F.when(e % 17 == 0, F.concat(F.lit('{"novelty_score": '), _score_text(e)))
                .when(e % 19 == 0, F.lit('{"is_relevant": true, "reasoning": "n/a"}'))
                .otherwise(body))
    err = (F.when(e % 8 == 1, F.lit("429 Resource exhausted. Please retry in 5s."))
           .when(e % 8 == 2, F.lit("429 quota exceeded"))
           .when(e % 8 == 3, F.lit("HTTP 500 internal error in JSON gateway"))
           .when(e % 8 == 4, F.lit("Quota exceeded, Retry in 400s"))
           .when(e % 8 == 5, F.lit("JSONDecodeError: Expecting value"))
           .when(e % 8 == 7, F.lit("rate limited (429): retry in 12.5s")))
    return table(spark, sf_dir, "events").select(
        e.alias("event_id"), F.col("ts").cast("timestamp").alias("call_ts"),
        response.alias("response"), err.alias("error_text"),
        F.when(e % 8 == 5, F.lit("parse")).when(err.isNotNull(), F.lit("api")).alias("error_class"),
        (((e - e % 8) / 8).cast("bigint") % 3 + 1).cast("int").alias("attempt"))


def fx_topic_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic records derived from ``customer`` (some invalid enumerations)."""
    k, nk = F.col("c_custkey"), F.col("c_nationkey")
    from vigil.sources.config import ENTRY_TYPE, entry
    term = F.concat(F.lit("term"), (k % 10).cast("string"))
    seg = F.lower("c_mktsegment")
    source = pick(["gdelt", "rss", "reddit", "arxiv"], nk % 4)
    text = "map<string,string>"
    filters = (F.when(source == "gdelt", F.create_map(F.lit("sourcelang"), F.lit("eng")))
               .when(source == "arxiv", F.create_map(F.lit("max_results"), F.lit("50")))
               .when((source == "rss") & (k % 4 == 0), F.create_map(F.lit("feeds"), F.concat(
                   F.lit('["https://f1.example.com/'), k.cast("string"),
                   F.lit('", "https://f2.example.com/x"]'))))
               .otherwise(F.create_map().cast(text)))
    subs = F.when(source == "reddit", F.array(F.concat(F.lit("sub"), (k % 5).cast("string")))) \
        .otherwise(F.array().cast("array<string>"))
    place = F.create_map(F.lit("lat"), F.lit("40.7"), F.lit("lon"), F.lit("-74.0"))
    frequent = F.array(entry(source, F.array(seg, term), filters, subs))
    none = F.array().cast("array<string>")
    discovery = F.array(entry(F.lit("google_news"), F.array(seg)), entry(F.lit("hacker_news"), none))
    discovery = F.when(k % 7 == 0, F.concat(discovery, F.array(
        entry(F.lit("weather"), none, place)))).otherwise(discovery)
    broad = F.array(entry(F.lit("gdelt"), F.array(F.lit("global"))),
                    entry(F.lit("guardian"), F.array(F.lit("global"))))
    nothing = F.create_map().cast(f"map<string,array<{ENTRY_TYPE}>>")
    polling = F.map_concat(
        F.when(k % 2 == 0, F.create_map(F.lit("frequent"), frequent)).otherwise(nothing),
        F.create_map(F.lit("discovery"), discovery),
        F.when(k % 3 == 0, F.create_map(F.lit("broad"), broad)).otherwise(nothing))
    return table(spark, sf_dir, "customer").select(
        k.alias("topic_id"), F.col("c_name").alias("name"),
        pick(["high", "low", "medium"], k % 3).alias("importance"),
        pick(["urgent", "high", "medium", "low", "critical"], k % 5).alias("urgency"),
        polling.alias("polling"))
