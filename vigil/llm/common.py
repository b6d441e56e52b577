"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import checkpoint_dir

#: Place of a null doc_id in document order.
NULL_ID = -(2 ** 63)

#: Stand-ins for the two columns that identify a document inside an operator.
ID, UID = "__doc", "__uid"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_col() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID).cast("long"))


def uid_col() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def keyed(docs: DataFrame, *extra: Column | str) -> DataFrame:
    """``__doc`` and ``__uid`` identify a document; ``extra`` columns follow."""
    return docs.select(id_col().alias(ID), uid_col().alias(UID), *extra)


def public_id(name: str = ID) -> Column:
    """The doc_id that ``__doc`` stands for."""
    return F.when(F.col(name) != F.lit(NULL_ID).cast("long"), F.col(name)).alias("doc_id")


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[dict]],
              schema: str) -> DataFrame:
    """``mapInArrow`` for a function from one batch to dicts of columns."""
    arrow_schema = schema_of(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for columns in fn(batch):
                    yield pa.RecordBatch.from_pydict(columns, schema=arrow_schema)

    return df.mapInArrow(run, schema)


def schema_of(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def parts_by_bytes(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Split a list into runs of about ``limit`` bytes (one item at least)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


#: Paths written inside each ``settled`` call that is under way.
_OPEN: list[list[str]] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back.

    Cuts the lineage, so a lost executor costs no recomputation of what went
    before, and fixes the rows that later steps read twice.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _OPEN:
        _OPEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Write what ``build`` returns, then drop the tables written on the way."""
    _OPEN.append([])
    try:
        df = build()
        _OPEN.append([])
        try:
            out = written(df, label)
        finally:
            mine = _OPEN.pop()
    finally:
        for path in _OPEN.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if _OPEN:
        _OPEN[-1].extend(mine)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche a uint64 array (the 64-bit finaliser of splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: What each operator remembers in a Python worker from task to task: its name
#: and how to forget it.
_CACHES: dict[str, Callable[[], None]] = {}
_HOLDER: list[str] = []


def remembers(name: str, forget: Callable[[], None]) -> None:
    _CACHES[name] = forget


def claim(name: str) -> None:
    """Call at the start of a task: workers are used again for the next
    operator, which must not pay for the memory of the one before."""
    if _HOLDER == [name]:
        return
    _HOLDER[:] = [name]
    for other, forget in _CACHES.items():
        if other != name:
            forget()
    gc.collect()
    try:  # hand freed memory back to the system
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
