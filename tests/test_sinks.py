"""Sinks survive retries: a re-run of the same run / batch leaves the same
data (no duplicates)."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from vigil.operators import commits as C
from vigil.operators import sinks as K
from vigil.streaming import poll_stream as S


def _passed(spark):
    rows = [(f"https://x.example.com/{i}", f"t{i}", "news", "topic_00",
             dt.datetime(2024, 1, 1 + i % 3), 0.5 + i / 100) for i in range(20)]
    return spark.createDataFrame(rows, "url string, title string, source_type string, "
                                       "topic_name string, run_day timestamp, novelty_score double")


def test_archive_append_is_idempotent(spark):
    path = tempfile.mkdtemp(prefix="vigil-archive-")
    df = _passed(spark)
    assert K.commit_archive(df, path, F.col("run_day"), "r1")
    assert not K.commit_archive(df, path, F.col("run_day"), "r1")  # retried run
    later = df.withColumn("run_day", F.col("run_day") + F.expr("INTERVAL 31 DAYS"))
    assert K.commit_archive(later, path, F.col("run_day"), "r2")
    back = K.read_archive(spark, path)
    assert back.count() == 40
    assert {r.url for r in back.collect()} == {r.url for r in df.collect()}
    assert {r.month for r in back.collect()} == {"2024-01", "2024-02"}


def test_archive_reads_only_its_months(spark):
    path = tempfile.mkdtemp(prefix="vigil-archive-")
    df = _passed(spark)
    for i, days in enumerate((0, 30, 60)):  # the second run spans two months
        rows = df.withColumn("run_day", F.col("run_day") + F.expr(f"INTERVAL {days} DAYS"))
        K.commit_archive(rows, path, F.col("run_day"), f"r{i}")
    feb = K.read_archive(spark, path, ["2024-02"])
    assert {r.month for r in feb.collect()} == {"2024-02"}
    files = feb.inputFiles()  # before the partitions are pruned
    assert files and all("commit=r1" in f for f in files)
    plan = feb._jdf.queryExecution().executedPlan().toString()
    assert "month" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert K.read_archive(spark, path, ["2031-01"]).count() == 0


def test_a_run_that_dies_before_its_manifest_leaves_no_trace(spark, monkeypatch):
    path = tempfile.mkdtemp(prefix="vigil-commit-")
    df = _passed(spark)
    assert C.read_latest(spark, path, df.schema).count() == 0
    C.commit(df.limit(3), path, "r1")

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(C, "publish", dies)
        try:
            C.commit(df, path, "r2")  # the files are there, the manifest is not
        except KeyboardInterrupt:
            pass
    assert C.read_committed(spark, path, df.schema).count() == 3
    assert C.read_latest(spark, path, df.schema).count() == 3
    assert C.commit(df.limit(5), path, "r2")  # the next try, now with other rows
    assert C.read_committed(spark, path, df.schema).count() == 8
    assert C.read_latest(spark, path, df.schema).count() == 5
    assert [i for i, _ in C.committed(spark, path)] == ["r1", "r2"]


def test_an_empty_run_is_a_commit(spark):
    path = tempfile.mkdtemp(prefix="vigil-commit-")
    df = _passed(spark).withColumn("month", F.lit("2024-01"))
    C.commit(df, path, "r1", "month")
    C.commit(df.limit(0), path, "r2", "month")
    assert C.committed(spark, path) == [("r1", ["2024-01"]), ("r2", [])]
    assert C.read_latest(spark, path, df.schema).count() == 0
    assert C.read_committed(spark, path, df.schema).count() == 20


def test_replayed_batch_rewrites_same_folder(spark):
    path = tempfile.mkdtemp(prefix="vigil-batches-")
    w = S.idempotent_batch_writer(path, lambda b, i: b.withColumn("batch_id", F.lit(i)))
    df = _passed(spark)
    w(df, 0)
    w(df, 0)  # the same micro-batch delivered again after a failure
    assert spark.read.parquet(path).count() == 20


def test_roundtrip_keeps_persisted_fields(spark):
    rows = _passed(spark).withColumn("event_id", F.xxhash64("title")).withColumn(
        "fetched_at", F.lit("2024-01-01 00:00:01.123456").cast("timestamp"))
    back = {r.event_id: r for r in K.roundtrip(rows).collect()}
    for r in rows.collect():
        assert (back[r.event_id].url, back[r.event_id].title, back[r.event_id].fetched_at) == (
            r.url, r.title, r.fetched_at)  # instants keep their microseconds
