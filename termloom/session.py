"""Session helpers: shared work folder, pinned tables and recommended settings."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even when the next aggregate then needs its own shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # An aggregate on (a, b) after a join on a must not inherit a's hot partition.
    "spark.sql.requireAllClusterKeysForDistribution": "true",
    "spark.sql.session.timeZone": "UTC",
}


def apply_recommended_conf(spark: SparkSession) -> SparkSession:
    """Set the skew-related SQL settings the operators are designed for."""
    for key, value in RECOMMENDED_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, taken from ``spark.checkpoint.dir``.

    Without that setting the session's checkpoint folder is taken, and without either the
    work cannot be shared and an error is raised.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", "") or ""
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if current is not None:
        return current.rstrip("/")
    raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")


def use_local_dir(spark: SparkSession) -> None:
    """For programs run by hand or by a test: a temporary folder, if there is none yet.

    Only a local session gets one, because there the driver and the executors share one
    machine; ``local-cluster`` is no local session.
    """
    sc = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", "") or sc.getCheckpointDir() is not None:
        return
    if sc.master == "local" or sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="termloom-"))


_local = threading.local()


def _made() -> list[str]:
    """Work paths made by this thread; every stream runs its batches on its own thread."""
    if not hasattr(_local, "paths"):
        _local.paths = []
    return _local.paths


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/termloom-{name}-{uuid.uuid4().hex}"
    _made().append(path)
    return path


def remove_work(spark: SparkSession, keep: int = 0) -> int:
    """Delete the work paths of this thread but the first ``keep``, once they are done with."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    while len(_made()) > keep:
        path = jvm.org.apache.hadoop.fs.Path(_made().pop())
        removed += bool(path.getFileSystem(conf).delete(path, True))
    return removed


@contextmanager
def work_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the work paths made inside, for instance by one micro-batch."""
    before = len(_made())
    try:
        yield
    finally:
        remove_work(spark, keep=before)


def pinned(df: DataFrame, name: str = "pinned") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The table survives lost executors, cuts the lineage, is read column by column, and
    tells the optimizer its size. ``remove_work`` deletes it.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
