"""Polls by tier (T01): each tier's sources are read when its schedule says so.

``start_poll`` runs a Structured Streaming query per source of the tier over
``landed_dir/source=<name>``, each with the source's own schema and normaliser,
with ``availableNow``: it takes what has landed since that source was last read
and stops.  A source keeps its checkpoint, whatever tier it is in, so a source
that moves to another tier, or is in several, has each file read once.

A micro-batch is one commit of the results table (``operators/commits.py``).
A poll that is killed leaves either a whole commit or none; the next poll gets
the same files under the same batch number and commits them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.conventions import AS_OF
from vigil.operators.commits import commit, read_committed
from vigil.sources import adapters

_TEXT, _WHEN = T.StringType(), T.TimestampType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(c, t) for c, t in columns.items()])


LANDED_SCHEMA = _schema(
    payload_id=T.LongType(), run_id=_TEXT, topic_name=_TEXT, source_ord=T.IntegerType(),
    source=_TEXT, term=_TEXT, filters=T.MapType(_TEXT, _TEXT), fetched_ts=_WHEN, status=_TEXT,
    body=_TEXT)
RESULT_SCHEMA = _schema(
    payload_id=T.LongType(), run_id=_TEXT, topic_name=_TEXT, source_ord=T.IntegerType(),
    item_pos=T.IntegerType(), url=_TEXT, title=_TEXT, snippet=_TEXT, source=_TEXT,
    source_type=_TEXT, fetched_at=_WHEN, published_at=_WHEN, price=_TEXT, adapter=_TEXT)
#: Sources that one poll reads at the same time.
AT_ONCE = 4


class Poll:
    """The queries of one tier's poll; started a few at a time."""

    def __init__(self, starts: Sequence) -> None:
        self._waiting, self.queries = list(starts), []
        while self._waiting and len(self.queries) < AT_ONCE:
            self.queries.append(self._waiting.pop(0)())

    def awaitTermination(self) -> None:
        """Wait for all sources; one that fails does not keep the others from
        being read, and raises at the end."""
        errors, done = [], 0
        while done < len(self.queries):
            try:
                self.queries[done].awaitTermination()
            except Exception as exc:  # the source's query is over, the others go on
                errors.append(exc)
            done += 1
            if self._waiting:
                self.queries.append(self._waiting.pop(0)())
        if errors:
            raise errors[0]


def results_path(state_dir: str) -> str:
    return f"{state_dir.rstrip('/')}/results"


def start_poll(spark: SparkSession, landed_dir: str, state_dir: str, tier: str,
               tiers: Mapping[str, str | Sequence[str]], as_of=AS_OF,
               schemas: Mapping[str, T.StructType] | None = None) -> Poll:
    """Read what has landed for the sources of ``tier`` (``tiers`` names the
    tier, or tiers, of each source).  Sources that never landed anything are
    left out.  ``schemas`` has the landed columns of sources that differ from
    ``LANDED_SCHEMA``; columns that a source lacks are null."""
    landed_dir, schemas = landed_dir.rstrip("/"), schemas or {}
    mine = sorted(s for s, t in tiers.items() if tier == t or (not isinstance(t, str) and tier in t))
    unknown = [s for s in mine if s not in adapters.NORMALISERS]
    if unknown:
        raise ValueError(f"no adapter for {', '.join(unknown)}")

    def there(source: str) -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{landed_dir}/source={source}")
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    def start(source: str):
        schema = schemas.get(source, LANDED_SCHEMA)
        stream = spark.readStream.schema(schema).parquet(f"{landed_dir}/source={source}")
        lacking = [f for f in LANDED_SCHEMA.fields if f.name not in schema.names]
        for f in lacking:
            stream = stream.withColumn(f.name, F.lit(source) if f.name == "source"
                                       else F.lit(None).cast(f.dataType))

        def write(batch: DataFrame, batch_id: int) -> None:
            rows = adapters.normalise(source, batch, as_of).withColumn("adapter", F.lit(source))
            rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in RESULT_SCHEMA.fields])
            commit(rows, results_path(state_dir), f"{source}-{batch_id:09d}")

        return (stream.writeStream.foreachBatch(write).trigger(availableNow=True)
                .option("checkpointLocation", f"{state_dir.rstrip('/')}/checkpoints/{source}").start())

    return Poll([lambda s=s: start(s) for s in mine if there(s)])


def poll_results(spark: SparkSession, state_dir: str) -> DataFrame:
    """The normalised rows of all finished micro-batches."""
    return read_committed(spark, results_path(state_dir), RESULT_SCHEMA)
