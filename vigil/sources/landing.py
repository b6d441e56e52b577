"""Landed payloads: the input of every source normaliser.

The network fetch is outside; a fetcher lands one row per response::

    landed(payload_id, run_id, topic_name, source_ord, source, term,
           filters MAP<STRING,STRING>, fetched_ts, status, body)

For tests and the SQL oracle, :func:`land` builds such rows from driver
tables: items are packed ten per payload (in key order) into the JSON shape
of the source's API, and one payload in fifty is cut short (malformed).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.conventions import AS_OF
from vigil.sources.fixtures import N_TOPICS, topic_name

PER_PAYLOAD = 10
BAD_EVERY = 50

LANDED_COLUMNS = ["payload_id", "run_id", "topic_name", "source_ord", "source", "term",
                  "filters", "fetched_ts", "status", "body"]


def payload_of(key: Column, per: int = PER_PAYLOAD) -> Column:
    return key - key % per


def is_bad_payload(pid: Column, per: int = PER_PAYLOAD) -> Column:
    return pid % (per * BAD_EVERY) == 0


def pack(items: DataFrame, key: str, columns: list[str], per: int = PER_PAYLOAD) -> DataFrame:
    """The rows of each payload as one array in key order.

    It is dealt out once more after it is built: sources of one table then read
    one and the same shuffle, and rows are gathered and ordered once for all."""
    row = F.struct(key, *columns)
    return (items.select(payload_of(F.col(key), per).alias("payload_id"), row.alias("row"))
            .groupBy("payload_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
            .repartition(F.xxhash64("payload_id")))


def land(packed: DataFrame, item: Callable[[Callable[[str], Column]], Column],
         wrap: Callable[[Column], Column], source: str, as_of=AS_OF,
         to_text: Callable[[Column], Column] | None = None,
         filters: Callable[[Column], Column] | None = None,
         term: Callable[[Column], Column] | None = None, per: int = PER_PAYLOAD) -> DataFrame:
    """Make an item of each row of a payload (``item`` is told how to get a
    column of it) and a body of the items (``wrap`` builds the API envelope
    around the ordered item array)."""
    packed = packed.select("payload_id", F.transform("rows", lambda r: item(r.getField)).alias("arr"))
    body = (to_text or F.to_json)(wrap(F.col("arr")))
    bad = is_bad_payload(F.col("payload_id"), per)
    return packed.select(
        "payload_id", F.concat(F.lit("run-"), (F.col("payload_id") % 7).cast("string")).alias("run_id"),
        topic_name(F.col("payload_id") % N_TOPICS).alias("topic_name"),
        F.lit(0).alias("source_ord"), F.lit(source).alias("source"),
        (term(F.col("payload_id")) if term else
         F.concat(F.lit("term "), (F.col("payload_id") % 7).cast("string"))).alias("term"),
        (filters(F.col("payload_id")) if filters else F.create_map().cast("map<string,string>"))
        .alias("filters"),
        F.lit(as_of).cast("timestamp").alias("fetched_ts"),
        F.when(bad, F.lit("malformed")).otherwise(F.lit("ok")).alias("status"),
        # a malformed payload: the response cut after 20 characters
        F.when(bad, F.substring(body, 1, 20)).otherwise(body).alias("body"))


def explode_items(landed: DataFrame, parsed: Column, items: Callable[[Column], Column]) -> DataFrame:
    """``posexplode`` the item array of each parsed body (empty or malformed
    payloads yield no rows; their outcome is kept by the attempt table)."""
    return (landed.withColumn("_p", parsed)
            .select("*", F.posexplode_outer(items(F.col("_p"))).alias("item_pos", "it"))
            .where(F.col("it").isNotNull())
            .drop("_p"))
