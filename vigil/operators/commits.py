"""Commits per run: a run's rows become visible at once or not at all.

A table is a folder with ``data/commit=<id>/…`` and ``manifests/<id>.json``.
A run writes its data files first and then publishes one manifest by a rename
within the same folder, which file systems do atomically.  Readers list the
manifests and read only the data folders that these name, so the files of a run
that died before its manifest are never seen; the run's next try clears and
rewrites them.  A run that is repeated after its commit changes nothing.

Ids sort in the order of runs.  The driver reads the manifests: one small row
per run, whatever the size of the data.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFEST = "id string, partitions array<string>"


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _manifest(path: str, commit_id: str) -> str:
    return f"{path}/manifests/{commit_id}.json"


def is_committed(spark: SparkSession, path: str, commit_id: str) -> bool:
    fs, p = _file(spark, _manifest(path, commit_id))
    return fs.exists(p)


def publish(spark: SparkSession, path: str, commit_id: str, partitions: Sequence[str]) -> None:
    """The manifest, first under a hidden name of its own, then renamed."""
    fs, target = _file(spark, _manifest(path, commit_id))
    _, hidden = _file(spark, f"{path}/manifests/.{commit_id}-{uuid.uuid4().hex}")
    out = fs.create(hidden, True)
    out.write(bytearray(json.dumps({"id": commit_id, "partitions": list(partitions)}).encode()))
    out.close()
    if not fs.rename(hidden, target) and not fs.exists(target):
        raise OSError(f"manifest of {commit_id} was not published in {path}")


def commit(df: DataFrame, path: str, commit_id: str, partition_by: str | None = None) -> bool:
    """Write ``df`` as the run ``commit_id``; False if it was there already."""
    spark, path = df.sparkSession, path.rstrip("/")
    if is_committed(spark, path, commit_id):
        return False
    folder = f"{path}/data/commit={commit_id}"
    writer = df.write.mode("overwrite")  # also what a dead try has left
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(folder)
    parts = []
    if partition_by:
        fs, p = _file(spark, folder)
        names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
        parts = sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{partition_by}="))
    publish(spark, path, commit_id, parts)
    return True


def committed(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """(id, partitions) of every commit in the order of ids."""
    path = path.rstrip("/")
    fs, p = _file(spark, f"{path}/manifests")
    if not fs.exists(p):
        return []
    rows = spark.read.schema(_MANIFEST).json(f"{path}/manifests").collect()
    return sorted((r.id, list(r.partitions or [])) for r in rows)


def _read(spark: SparkSession, path: str, schema: T.StructType, ids: Sequence[str]) -> DataFrame:
    path = path.rstrip("/")
    full = T.StructType([f for f in schema.fields if f.name != "commit"] + [
        T.StructField("commit", T.StringType())])
    if not ids:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", f"{path}/data").parquet(
        *[f"{path}/data/commit={i}" for i in ids]).select(*full.names)


def read_committed(spark: SparkSession, path: str, schema: T.StructType,
                   partition_by: str | None = None, only: Sequence[str] | None = None) -> DataFrame:
    """Rows of all commits with their ``commit``.  With ``only``, values of the
    column ``partition_by``: commits without them are not opened and of the
    others only those partitions are."""
    found = committed(spark, path)
    if only is not None:
        found = [(i, parts) for i, parts in found if set(parts) & set(only)]
    rows = _read(spark, path, schema, [i for i, _ in found])
    return rows if only is None else rows.where(F.col(partition_by).isin(*only))


def read_latest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The snapshot that the last commit wrote (no rows before the first)."""
    return _read(spark, path, schema, [i for i, _ in committed(spark, path)[-1:]]).drop("commit")
