"""Session construction and cluster-shared folders.

On a cluster the session is built by the platform; we only read what it
configures.  ``spark.checkpoint.dir`` must name a shared folder there; a
local default is set only when it is missing (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.ansi.enabled": "true",
}
# Only for sessions this module creates locally (tests, bench): a cluster
# session brings its own memory settings.
_LOCAL_CONF = {"spark.driver.memory": "12g"}


def build_session(master: str | None = None, app: str = "vigil",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Local/test session with the conventions every operator assumes."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULT_CONF)
    if master and master.startswith("local"):
        conf.update(_LOCAL_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_conventions(spark)
    return spark


def ensure_conventions(spark: SparkSession) -> None:
    """UTC clock, bounded Arrow batches, the package on every executor and a
    checkpoint folder; never overrides a cluster setting."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # The default of 10,000 rows is too much for rows that hold whole texts.
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    ship_package(spark)
    checkpoint_dir(spark)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors as a zip, once per application, so
    that Python workers can import it wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_vigil_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="vigil-pkg-"), "vigil.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("vigil", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._vigil_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only a local master (tests, local runs) may leave it unset; there a
    private folder is made.  Any other master without it is an error, since a
    machine-local folder would lose data.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if current:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(current)
        return current
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return sc._jsc.sc().getCheckpointDir().get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="vigil-ckpt-", dir=os.environ.get("VIGIL_SCRATCH"))
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
