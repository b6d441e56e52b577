"""Sinks (K01, K02, K04): archive, index snapshot, record round-trip.  Writes
are commits per run (``commits.py``): a retried run never appends twice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.operators.commits import commit, read_committed

# Columns of a persisted result record, in record order.
RECORD_FIELDS = ["url", "title", "snippet", "source", "source_type", "topic_name",
                 "fetched_at", "published_at", "price", "novelty_score", "summary", "tags",
                 "escalation_trigger", "action_url", "notified_push", "notified_digest"]

RECORD_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("snippet", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("source_type", T.StringType()), T.StructField("topic_name", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()), T.StructField("published_at", T.TimestampType()),
    T.StructField("price", T.StringType()), T.StructField("novelty_score", T.DoubleType()),
    T.StructField("summary", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("escalation_trigger", T.StringType()), T.StructField("action_url", T.StringType()),
    T.StructField("notified_push", T.BooleanType()), T.StructField("notified_digest", T.BooleanType())])


# Instants keep their microseconds (the default format cuts them).
RECORD_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def record(df: DataFrame) -> Column:
    """The persisted record struct (missing optional fields are NULL)."""
    cols = []
    for f in RECORD_SCHEMA.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        if f.name in ("notified_push", "notified_digest"):
            c = F.coalesce(c.cast("boolean"), F.lit(False))
        cols.append(c.cast(f.dataType).alias(f.name))
    return F.struct(*cols)


# K01 -------------------------------------------------------------------------
def archive_rows(passed: DataFrame, written_at: Column) -> DataFrame:
    """One JSON line per passed result, partitioned by UTC month of the write
    time and by run."""
    return passed.select(
        "*", F.date_format(written_at, "yyyy-MM").alias("month"),
        F.date_format(written_at, "yyyy-MM-dd").alias("run_id"),
        F.to_json(record(passed), RECORD_OPTIONS).alias("json"))


ARCHIVE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("run_id", "json", "month")])


def commit_archive(passed: DataFrame, path: str, written_at: Column, run: str) -> bool:
    """Append the rows of one run, all or none; a run that is there already
    changes nothing."""
    rows = archive_rows(passed, written_at).select(*ARCHIVE_SCHEMA.names)
    return commit(rows, path, run, "month")


def read_archive(spark: SparkSession, path: str, months: Sequence[str] | None = None) -> DataFrame:
    """Archived records with their ``month`` and ``run_id``; with ``months``
    only the files of those are read."""
    rows = read_committed(spark, path, ARCHIVE_SCHEMA, "month", months)
    return rows.select("month", "run_id", F.from_json("json", RECORD_SCHEMA, RECORD_OPTIONS)
                       .alias("r")).select("month", "run_id", "r.*")


# K02 -------------------------------------------------------------------------
def index_snapshot(index: DataFrame, key: str = "topic_name") -> DataFrame:
    """Per topic, the (<= 100) index rows in position order as one array."""
    return (index.groupBy(key)
            .agg(F.sort_array(F.collect_list(F.struct("pos", "url"))).alias("_rows"))
            .select(key, F.size("_rows").alias("n"),
                    F.array_join(F.transform("_rows", lambda r: r["url"]), ",").alias("urls")))


# K04 -------------------------------------------------------------------------
def roundtrip(df: DataFrame, key: str = "event_id") -> DataFrame:
    """Each record written as JSON and parsed again: the key and the fields
    that come back (the raw payload is not persisted)."""
    back = F.from_json(F.to_json(record(df), RECORD_OPTIONS), RECORD_SCHEMA, RECORD_OPTIONS)
    return df.select(key, back.alias("r")).select(key, "r.*")
