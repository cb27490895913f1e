"""Session helpers: building a local session for tests/bench and finding the
shared checkpoint folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, partitions: int = 8,
                  app: str = "tessera") -> SparkSession:
    """Session used by tests and bench.py. On a cluster the caller's own
    session is used instead; nothing in the library creates one."""
    master = master or os.environ.get("TESSERA_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEM", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    Reads ``spark.checkpoint.dir`` from the session (set by the cluster).
    Only when it is unset -- local tests -- a private folder is created."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        configured = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table that was written at a :func:`scratch_path`."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Within this, Spark removes the shuffle files of every finished query, for
    jobs that write a table a step and never go back behind it."""
    with _conf(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


@contextmanager
def planned_once(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Within this, queries keep the plan and the partitioning they start with, for long
    chains of small steps over tables that are partitioned alike, into ``partitions``: with more of them set
    for shuffles, every step would deal the tables out again."""
    with _conf(spark, "spark.sql.adaptive.enabled", "false"):
        if partitions is None:
            yield
            return
        with _conf(spark, "spark.sql.shuffle.partitions", str(partitions)):
            yield


@contextmanager
def _conf(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never localCheckpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tessera`` importable in Python workers (pandas functions refer
    to its helpers). The package is zipped once per driver and handed to
    ``addPyFile``, which distributes it to every executor through Spark's
    file server; the zip only needs to exist on the driver."""
    import zipfile

    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    import tessera
    root = os.path.dirname(os.path.abspath(tessera.__file__))
    out_dir = tempfile.mkdtemp(prefix="tessera-pkg-")
    path = os.path.join(out_dir, "tessera.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(key)
