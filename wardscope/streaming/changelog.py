"""Keyed state as a log of changes: a batch writes its changed rows, not the whole state.

The part of batch ``b`` (counted from 1) holds the newest row per key of the last ``b & -b`` batches: its own changes
merged with the few parts before it that together cover the rest of that span.  The state after any
batch is then the newest row per key of at most log2(b) + 1 parts, and a changed row is written
again at most log2(b) times, however large the state is.  A part is written once and never changed;
writing a batch again replaces its own part with the same rows.

A row with ``_gone`` tells that its key has left the state; it hides older rows of the key and is
dropped for good where a later part reaches back to the first batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardscope.operators.dedupe import keep_last
from wardscope.session import cut_lineage

GONE = "_gone"
PART = "batch"


def covering(batch: int, least: int = 0) -> list[int]:
    """Batches whose parts make up the state after ``batch``, newest first, back to (not including) batch ``least``."""
    found = []
    while batch > least:
        found.append(batch)
        batch -= batch & -batch
    return found


def advance(changes: DataFrame, out: str, batch_id: int, keys: list[str]) -> None:
    """Write the part of a batch; ``changes`` holds one row per changed key, with ``_gone`` for keys that left."""
    spark = changes.sparkSession
    if GONE not in changes.columns:
        changes = changes.withColumn(GONE, F.lit(False))
    number = batch_id + 1
    first = number - (number & -number)  # the part reaches back to the batch after this one
    before = covering(number - 1, first)
    rows = changes.withColumn("_by", F.lit(",".join(keys)))
    if before:
        rows = cut_lineage(rows)  # the stream's state is advanced once
        older = spark.read.schema(rows.schema).parquet(*[f"{out}/{PART}={b - 1}" for b in before])
        older = older.withColumn("_at", F.regexp_extract(F.input_file_name(), f"{PART}=(\\d+)", 1).cast("long"))
        rows = keep_last(older.unionByName(rows.withColumn("_at", F.lit(batch_id).cast("long"))), keys, ["_at"])
        if first == 0:
            rows = rows.filter(~F.col(GONE) | (F.col("_at") == batch_id))
        rows = rows.drop("_at")
    rows.write.mode("overwrite").parquet(f"{out}/{PART}={batch_id}")


def state_after(spark: SparkSession, out: str, batch_id: int | None = None) -> DataFrame:
    """The state after a batch (the newest if not told): one row per key that has not left."""
    log = spark.read.parquet(out)
    if batch_id is None:
        batch_id = log.agg(F.max(PART)).first()[0]
    parts = log.filter(F.col(PART).isin([b - 1 for b in covering(batch_id + 1)]))
    named = parts.select("_by").first()
    if named is None:
        return parts.drop(PART, GONE, "_by")
    newest = keep_last(parts, named[0].split(","), [PART])
    return newest.filter(~F.col(GONE)).drop(PART, GONE, "_by")
