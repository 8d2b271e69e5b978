"""Sinks: versioned tables, CSV and JSON exports, publication behind the contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardscope.operators.contract import publish_if_clean


POINTER = "turn bigint, version string, path string"


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet; the committer makes a finished write visible as a whole."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def publish(spark: SparkSession, tables: dict[str, DataFrame], violations: DataFrame | Callable[[dict[str, DataFrame]], DataFrame], root: str, version: str) -> str:
    """Write all tables under a new version and move the pointer only if the contract holds.

    ``violations`` is a table, or a function from the written tables to one, so
    that what is checked is what readers will get.  Pointers are numbered files
    and never replaced: readers follow the newest, so a run that fails at any
    point leaves the last good version in place.  A version is written once; a
    second run under its name is an error.
    """
    target = f"{root}/version={version}"
    pointers = pointer_rows(spark, root)
    if pointers is not None and not pointers.filter(F.col("version") == version).isEmpty():
        raise ValueError(f"version {version} is already published")
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{target}/{name}")
    written = {name: spark.read.schema(df.schema).parquet(f"{target}/{name}") for name, df in tables.items()}

    def point() -> None:
        turn = 0 if pointers is None else pointers.agg(F.max("turn")).first()[0] + 1
        spark.createDataFrame([(turn, version, target)], POINTER).coalesce(1).write.json(f"{root}/pointers/turn={turn:09d}")

    publish_if_clean(violations(written) if callable(violations) else violations, point)
    return target


def pointer_rows(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(POINTER).option("recursiveFileLookup", True).json(f"{root}/pointers")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error.getCondition()):
            raise
        return None


def current_version(spark: SparkSession, root: str) -> str:
    """Folder of the newest published version."""
    return pointer_rows(spark, root).agg(F.max_by("path", "turn")).first()[0]
