"""The polled feed as Structured Streaming: history, last known rows, hourly means.

Late rows are kept and flagged by the snapshot masks; the watermark only bounds
how long duplicate keys and open windows stay in state.  Results go to files in
the shared folder, one directory per micro-batch, so a replayed batch
overwrites its own output and nothing passes through the driver.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardscope.functions import fixed_values as V
from wardscope.session import fresh_path
from wardscope.streaming import changelog


def read_stream(spark: SparkSession, path: str, schema: T.StructType, name_filter: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """File stream over landed Parquet with a declared schema."""
    reader = spark.readStream.schema(schema)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def utc_event_time(df: DataFrame, column: str) -> DataFrame:
    """Event time as an instant; a zone-less stamp counts as UTC."""
    text = F.date_format(F.col(column), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return df.withColumn(column, F.to_timestamp(F.concat(text, F.lit("Z"))))


def run_available(
    stream: DataFrame, label: str, mode: str = "append", shape: Callable[[DataFrame, int], DataFrame] | None = None,
    location: str | None = None, newest_of: list[str] | None = None,
) -> str:
    """Process everything that has arrived, then stop; returns the output folder.

    Every micro-batch writes ``batch=<id>``; writing the same batch twice
    replaces it, which makes the sink exactly-once.  With ``newest_of`` the folders are
    a log of changes to the state keyed by those columns (see ``changelog``), read by
    ``latest_state``.  A run with the same ``location`` goes on where the last one stopped.
    """
    spark = stream.sparkSession
    root = location or fresh_path(spark, label)
    out = f"{root}/out"

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = shape(batch, batch_id) if shape else batch
        if newest_of:
            changelog.advance(rows, out, batch_id, newest_of)
            return
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .foreachBatch(sink)
        .start()
    )
    query.awaitTermination()
    return out


def read_output(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def unique_history(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """Each (entity, collection time) once; keys are remembered for the delay only."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def last_known_state(stream: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Running last row and row count per entity, kept in the state store.

    Use update mode: only entities that changed are written per micro-batch.
    """
    return stream.groupBy(key).agg(
        F.max_by(F.struct(*values), F.struct(*order)).alias("row"), F.count(F.lit(1)).alias("n_seen")
    ).select(key, "n_seen", "row.*")


def with_run(stream: DataFrame, column: str = "run") -> DataFrame:
    """The number of the slice a row landed in, from the folder of its file."""
    return stream.withColumn(column, F.regexp_extract("_metadata.file_path", r"slice=(\d+)", 1).cast("int"))


def keep_last_good(stream: DataFrame, failed: DataFrame, on: list[str], key: str, order: list[str], values: list[str]) -> DataFrame:
    """Last good row per entity where regions may fail in single runs.

    ``failed`` is a table of (run, region) keys.  What a failed region delivered in that run is not trusted and does not enter
    the state, so its entities keep the rows of their last good run.  Use update mode with ``newest_of=[key]``.
    """
    good = stream.join(failed.select(*on).distinct(), on, "left_anti")
    return last_known_state(good, key, order, values)


def deadline_per_batch(spark: SparkSession, path: str, source_at: str, max_age_hours: float = V.SOURCE_MAX_AGE_HOURS) -> DataFrame:
    """Earliest expiry after every micro-batch of a run with ``newest_of``.

    A row that was replaced or has left the state no longer counts: the minimum is taken over the
    state as it stood after each batch, which the changelog still holds.
    """
    from wardscope.functions.scalars import hours

    newest = read_output(spark, path).agg(F.max(changelog.PART)).first()[0]
    found = None
    for batch in range(newest + 1):
        state = changelog.state_after(spark, path, batch)
        one = state.agg(F.lit(batch).alias("run"), F.min(F.col(source_at) + hours(max_age_hours)).alias("deadline_at"), F.count(F.lit(1)).alias("n_entities"))
        found = one if found is None else found.unionByName(one)
    return found


def expiring_state(stream: DataFrame, key: str, event_time: str, keep_hours: float, delay: str) -> DataFrame:
    """Last row per entity, dropped from the state store once the watermark is ``keep_hours`` past it.

    Use update mode with ``newest_of=[key]``: a changed entity comes with its newest row, an expired one with
    ``_gone``.  Of two rows of one time the one with the greater remaining values counts.  An entity that
    expired and is heard of again starts anew.
    """
    rest = [f for f in stream.schema.fields if f.name not in (key, event_time)]
    names, keep = [f.name for f in rest], int(keep_hours * 3_600_000)
    schema = ", ".join(["_us long", *[f"`{f.name}` {f.dataType.simpleString()}" for f in rest]])
    kind = stream.schema[key].dataType.simpleString()
    columns = [key, "_us", *names, changelog.GONE]

    def step(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            row, gone = state.get, True
            state.remove()
        else:
            # an entity has few rows in a batch: plain lists cost less than a frame of them
            rows = (max(zip(*(b[c].tolist() for c in ("_us", *names)))) for b in batches if len(b))
            row = max([*rows, *([state.get] if state.exists else [])])
            ends = int(row[0]) // 1000 + keep
            gone = ends <= state.getCurrentWatermarkMs()  # too old to be kept at all
            if gone:
                if state.exists:
                    state.remove()
            else:
                state.update(row)
                state.setTimeoutTimestamp(ends)
        yield pd.DataFrame({c: [v] for c, v in zip(columns, (*group, *row, gone))})

    marked = stream.withWatermark(event_time, delay).withColumn("_us", F.unix_micros(event_time))
    found = marked.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, {schema}, {changelog.GONE} boolean", schema, "update", "EventTimeTimeout")
    return found.withColumn(event_time, F.timestamp_micros("_us")).drop("_us")


def keep_days(event_time: str, days: int, root: str) -> Callable[[DataFrame, int], DataFrame]:
    """Batch step: rows go to a folder per day below ``root``; days older than ``days`` before the newest day are dropped.

    Dropping removes whole folders; no row is read or rewritten for it.  A batch that is replayed
    replaces its own folders.  The step returns what the batch added and how many folders it dropped.
    """

    def step(batch: DataFrame, batch_id: int) -> DataFrame:
        spark = batch.sparkSession
        added = f"{root}/batch={batch_id}"
        batch.withColumn("day", F.to_date(event_time)).write.partitionBy("day").mode("overwrite").parquet(added)
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        found = {str(s.getPath()): str(s.getPath()).rsplit("day=", 1)[1] for s in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/batch=*/day=*"))}
        dated = {p: dt.date.fromisoformat(d) for p, d in found.items() if d[:1].isdigit()}  # rows without a readable time stay
        last = max(dated.values(), default=None)
        old = [p for p, d in dated.items() if d < last - dt.timedelta(days=days)]
        for folder in old:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder), True)
        return spark.createDataFrame([(batch_id, len(found) - len(old), len(old))], "run long, folders long, dropped long")

    return step


def latest_state(spark: SparkSession, path: str) -> DataFrame:
    """The state after the newest micro-batch of a run with ``newest_of``."""
    return changelog.state_after(spark, path)


def land_in_slices(rows: DataFrame, arrival: Column, slices: int, label: str) -> tuple[str, int]:
    """Write rows as files that arrive in order of ``arrival`` (0 to slices - 1); (folder, files of every slice).

    All slices have the same number of files, some of them without rows where a slice is small, so that a stream
    that takes that many files at a time takes one whole slice.
    """
    spark = rows.sparkSession
    root = fresh_path(spark, label)
    files = rows.rdd.getNumPartitions()
    for k in range(slices):
        path = f"{root}/slice={k}"
        rows.filter(arrival == k).repartition(files).write.parquet(path)
        for _ in range(files - len(spark.read.schema(rows.schema).parquet(path).inputFiles())):
            rows.limit(0).write.mode("append").parquet(path)
    return f"{root}/*", files


def hourly_means(stream: DataFrame, event_time: str, value: str, delay: str = "1 hour") -> DataFrame:
    """Sum and count per clock hour; both combine later into weekday-by-hour means."""
    return (
        stream.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, "1 hour").alias("w"))
        .agg(F.sum(value).alias("value_sum"), F.count(value).alias("value_count"))
        .select(F.col("w.start").alias("hour_start"), "value_sum", "value_count")
    )


def heatmap_from_hours(hours: DataFrame, zone: str = V.SOURCE_ZONE) -> DataFrame:
    """Weekday-by-hour means out of hourly sums and counts."""
    local = F.from_utc_timestamp(F.col("hour_start"), zone)
    return (
        hours.groupBy(F.weekday(local).alias("day_no"), F.hour(local).alias("hour"))
        .agg((F.sum("value_sum") / F.sum("value_count")).alias("mean_value"))
    )


def last_seen(stream: DataFrame, key: str, at: str) -> DataFrame:
    """Running last sighting per entity, kept in the state store (update mode)."""
    return stream.groupBy(key).agg(F.max(at).alias("last_seen"))


def misses_since(seen: DataFrame, polls: DataFrame, key: str, at: str = "polled_at", most: int | None = None) -> DataFrame:
    """Polls after each entity's last sighting; beyond ``most`` misses in a row the entity is marked for review.

    Polls are few (one per collection), so their times enter as one array and
    no entity is expanded to its polls.
    """
    times = polls.agg(F.array_sort(F.collect_set(at)).alias("t")).scalar()
    after = F.filter(F.col("_polls"), lambda t: t > F.col("last_seen"))
    rows = seen.withColumn("_polls", times).withColumn("_after", after).filter(F.size("_after") > 0)
    count = F.size("_after").cast("bigint")
    return rows.select(
        key, count.alias("consecutive_misses"), F.element_at("_after", 1).alias("first_missing_at"), F.element_at("_after", -1).alias("last_missing_at"),
        (count > most if most is not None else F.lit(False)).alias("expired"),
    )


def miss_counters(polls: DataFrame, members: str = "entity_id", present: str = "present", at: str = "polled_at") -> DataFrame:
    """Misses in a row per entity up to its newest poll, with the first miss time.

    The last seen time and the newest poll are combinable maxima; misses after
    the last sighting are then counted, so no per-entity sequence is collected.
    """
    seen = polls.groupBy(members).agg(F.max(F.when(F.col(present), F.col(at))).alias("last_seen"))
    missed = polls.filter(~F.col(present)).join(seen, members)
    after = F.col("last_seen").isNull() | (F.col(at) > F.col("last_seen"))
    return missed.filter(after).groupBy(members).agg(
        F.min(at).alias("first_missing_at"), F.max(at).alias("last_missing_at"), F.count(F.lit(1)).alias("consecutive_misses")
    )


def earliest_deadline(stream: DataFrame, source_at: str, max_age_hours: float = V.SOURCE_MAX_AGE_HOURS) -> DataFrame:
    """Running earliest expiry; use complete mode."""
    from wardscope.functions.scalars import hours

    return stream.agg(F.min(F.col(source_at) + hours(max_age_hours)).alias("deadline_at"))
