"""Session set-up and the one place that decides where intermediate data may live."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "wardscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on.

    Only UTC is required for right results.  Adaptive execution is what splits
    skewed join partitions and merges small shuffle partitions, so it stays on.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # no Python call-site capture per column expression: plans are built twice as fast
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, which may run in another folder than the driver."""
    if getattr(spark, "_wardscope_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="wardscope-code-")  # the driver serves the file to its executors from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "wardscope_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for at, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(target)
    spark._wardscope_shipped = True


def shared_root(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Where it is unset, a local master sets a folder of its own that goes when the
    process ends; on a cluster the setting is required, since a machine-local
    path would be lost together with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = getattr(shared_root, "_local", None)
    if root is None:
        root = tempfile.mkdtemp(prefix="wardscope-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        shared_root._local = root
    return root


def fresh_path(spark: SparkSession, label: str) -> str:
    return os.path.join(shared_root(spark), f"{label}-{uuid.uuid4().hex}")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, drop_shuffles: bool = False) -> DataFrame:
    """Write the rows once to the shared folder and go on from those files.

    The plan restarts from storage that outlives executors.  Unlike an RDD
    checkpoint this runs the plan a single time, and the reader knows the file
    size, so later joins are planned from what was really written.  With
    ``drop_shuffles`` Spark removes the plan's shuffle files once the rows are
    written, not only when the driver collects garbage.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "table")
    before = spark.conf.get(_CLEANUP, None) if drop_shuffles else None
    if before is not None:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
