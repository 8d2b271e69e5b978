"""Registry that keeps each query next to the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


# schema by session, path and file version (names, sizes and times as the listing gives them)
_SCHEMAS: dict[tuple, StructType] = {}


def _version(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    listed = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(at)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in listed))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table; its schema is looked up once per session and file version, which saves a footer job per use."""
    path = f"{folder}/{name}.parquet"
    key = (id(spark), path, _version(spark, path))
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def r6(column: Column | str, name: str | None = None) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value, 6).alias(name or column)


def with_ctes(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + select
