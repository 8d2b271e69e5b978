"""Last-known-good merge of a new feed into a fixed population.

Age is metadata: an old value stays and is flagged, only an impossible one
(future or unparseable stamp, non-positive capacity, negative availability)
is masked.  The whole merge is three equi-joins on the entity id over tables
that hold one row per entity, so all of them can share one partitioning.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardscope.functions import fixed_values as V
from wardscope.functions.scalars import (
    clip, hours, instant_of, load_status, minutes_between, non_empty, number_of, region_key, saturation,
    source_time, usable,
)
from wardscope.operators.dedupe import keep_last

VALUE_COLUMNS = ["available", "total", "source_ts", "collected_ts"]
SNAPSHOT_COLUMNS = [
    "entity_id", "name", "grade", "province", "district", "available", "total", "saturation", "status",
    "source_ts", "collected_ts",
]


def positive(value: float, name: str) -> float:
    number_value = float(value)
    if not 0 < number_value < float("inf"):
        raise ValueError(f"{name} must be a positive finite number")
    return number_value


def moment(reference: datetime | str | Column) -> Column:
    if isinstance(reference, Column):
        return reference
    if isinstance(reference, str):
        return F.to_timestamp(F.lit(reference))
    if reference.tzinfo is None:
        reference = reference.replace(tzinfo=timezone.utc)
    return F.timestamp_micros(F.lit(int(reference.timestamp() * 1_000_000)))


def source_valid(source: Column, reference: Column, skew_minutes: float = V.FUTURE_SKEW_MINUTES) -> Column:
    """Parseable and not more than the skew in the future."""
    return F.coalesce(source <= reference + hours(skew_minutes / 60.0), F.lit(False))


def source_fresh(
    source: Column, reference: Column, max_age_hours: float = V.SOURCE_MAX_AGE_HOURS,
    skew_minutes: float = V.FUTURE_SKEW_MINUTES,
) -> Column:
    """Valid and not older than the age limit, both ends included."""
    age = hours(positive(max_age_hours, "max_age_hours"))
    return source_valid(source, reference, skew_minutes) & F.coalesce(source >= reference - age, F.lit(False))


def validity_masks(df: DataFrame, source: str, collected: str, reference: Column) -> DataFrame:
    """The two masks against a common time and against each row's own collection time."""
    own = instant_of(df, collected)
    parsed = df.withColumn("source_at", source_time(F.col(source)))
    at = F.col("source_at")
    return (
        parsed.withColumn("valid_now", source_valid(at, reference))
        .withColumn("fresh_now", source_fresh(at, reference))
        .withColumn("valid_at_collection", source_valid(at, own))
        .withColumn("fresh_at_collection", source_fresh(at, own))
    )


def with_load(df: DataFrame, valid: Column) -> DataFrame:
    """Saturation and status of a row, NULL / missing where it is not valid."""
    return df.withColumn(
        "saturation", F.when(valid, saturation(F.col("available"), F.col("total")))
    ).withColumn("status", load_status(F.col("saturation")))


def last_known(previous: DataFrame, reference: Column, order: list[str]) -> DataFrame:
    """Last previous row per entity, values nulled unless they are trustworthy.

    Timestamps are left untouched.  Adds ``prev_ok`` and ``prev_fresh``.
    """
    rows = previous.withColumn("entity_id", F.trim(F.col("entity_id").cast("string"))).filter(
        non_empty(F.col("entity_id"))
    )
    last = keep_last(rows.select("entity_id", *VALUE_COLUMNS, *[c for c in order if c not in VALUE_COLUMNS]), ["entity_id"], order)
    checked = validity_masks(
        last.withColumn("available", number_of(last, "available")).withColumn("total", number_of(last, "total")),
        "source_ts", "collected_ts", reference,
    )
    collected_ok = F.coalesce(
        instant_of(checked, "collected_ts") <= reference + hours(V.FUTURE_SKEW_MINUTES / 60.0), F.lit(False)
    )
    ok = (
        usable(F.col("available"), F.col("total"))
        & F.col("valid_now") & F.col("valid_at_collection") & collected_ok
    )
    return checked.withColumn("prev_ok", ok).select(
        "entity_id",
        F.when(ok, F.col("available")).alias("available"),
        F.when(ok, F.col("total")).alias("total"),
        "source_ts", "collected_ts", "prev_ok", (ok & F.col("fresh_now")).alias("prev_fresh"),
    )


def merge_decisions(
    master: DataFrame, feed: DataFrame, previous: DataFrame, failed_regions: DataFrame,
    reference: Column, feed_order: list[str], previous_order: list[str],
) -> DataFrame:
    """One row per population entity (and per unknown feed entity) with both versions side by side."""
    new = keep_last(
        feed.withColumn("entity_id", F.trim(F.col("entity_id").cast("string"))), ["entity_id"], feed_order
    ).select(
        "entity_id", number_of(feed, "available").alias("new_available"), number_of(feed, "total").alias("new_total"),
        F.col("source_ts").cast("string").alias("new_source_ts"), F.lit(True).alias("in_feed"),
    )
    old = last_known(previous, reference, previous_order).select(
        "entity_id", *[F.col(c).alias(f"old_{c}") for c in VALUE_COLUMNS], F.lit(True).alias("has_previous"),
        "prev_ok", "prev_fresh",
    )
    failed = failed_regions.select("province", "district", F.lit(True).alias("region_failed")).distinct()
    known = master.withColumn("entity_id", F.trim(F.col("entity_id").cast("string"))).withColumn("in_master", F.lit(True))
    joined = (
        known.join(failed, ["province", "district"], "left")
        .join(new, "entity_id", "full")
        .join(old, "entity_id", "left")
    )
    flags = ["in_master", "region_failed", "in_feed", "has_previous", "prev_ok", "prev_fresh"]
    return joined.select(
        *[c for c in joined.columns if c not in flags],
        *[F.coalesce(F.col(f), F.lit(False)).alias(f) for f in flags],
    )


def merged_rows(decisions: DataFrame, reference: Column) -> DataFrame:
    """Choose the new row, else the last known one, then mask, score and label."""
    fallback = ~F.col("in_feed") & F.col("in_master") & F.col("has_previous")

    def pick(name: str) -> Column:
        return F.when(F.col("in_feed"), F.col(f"new_{name}")).when(fallback, F.col(f"old_{name}"))

    chosen = (
        decisions.withColumn("has_row", F.col("in_feed") | fallback)
        .withColumn("source_ts", pick("source_ts"))
        .withColumn("collected_ts", F.when(F.col("in_feed"), reference).when(fallback, instant_of(decisions, "old_collected_ts")))
        .withColumn("source_at", source_time(F.col("source_ts")))
        .withColumn("row_valid_time", source_valid(F.col("source_at"), reference))
        .withColumn("row_fresh", source_fresh(F.col("source_at"), reference))
        .withColumn("available", F.when(F.col("row_valid_time"), pick("available")))
        .withColumn("total", F.when(F.col("row_valid_time"), pick("total")))
    )
    valid = usable(F.col("available"), F.col("total")) & F.col("row_valid_time")
    return with_load(chosen.withColumn("row_usable", valid), F.col("row_usable"))


def snapshot_rows(rows: DataFrame) -> DataFrame:
    return rows.filter("in_master").select(*SNAPSHOT_COLUMNS)


def response_count(previous: DataFrame) -> DataFrame:
    """Number of rows that carry any value at all."""
    return previous.agg(
        F.count_if(F.coalesce(*[F.col(c).cast("string") for c in ("available", "total", "source_ts")]).isNotNull())
        .alias("previous_response_count")
    )


def snapshot_audit(rows: DataFrame) -> DataFrame:
    """All merge counters in one pass over the decision rows."""
    m, failed = F.col("in_master"), F.col("in_master") & F.col("region_failed")
    omitted = m & ~F.col("region_failed") & ~F.col("in_feed")
    ok, fresh, had = F.col("prev_ok"), F.col("prev_fresh"), F.col("has_previous")

    def n(condition: Column, name: str) -> Column:
        return F.count_if(condition).alias(name)

    region = F.struct("province", "district")
    has_region = m & F.col("province").isNotNull() & F.col("district").isNotNull()
    return rows.agg(
        F.count_distinct(F.when(has_region, region)).alias("requested_regions"),
        F.count_distinct(F.when(has_region & F.col("region_failed"), region)).alias("failed_regions"),
        n(m & F.col("in_feed"), "new_response"),
        n(m & F.col("row_usable"), "usable"),
        n(F.col("has_row") & ~F.col("row_fresh"), "stale_source"),
        n(failed, "failed_region_entities"),
        n(failed & had, "failed_candidates"),
        n(failed & fresh, "failed_fresh"),
        n(failed & ok & ~fresh, "failed_stale"),
        n(failed & ok, "failed_retained"),
        n(failed & ~ok, "failed_masked"),
        n(omitted, "omitted_entities"),
        n(omitted & had, "omitted_candidates"),
        n(omitted & fresh, "omitted_fresh"),
        n(omitted & ok & ~fresh, "omitted_stale"),
        n(omitted & ok, "omitted_retained"),
        n(omitted & ~ok, "omitted_masked"),
        n((failed | omitted) & ok, "retained_total"),
        n((failed | omitted) & ~ok, "masked_total"),
    )


def build_snapshot(
    master: DataFrame, feed: DataFrame, previous: DataFrame, failed_regions: DataFrame, reference,
    feed_order: list[str], previous_order: list[str], minimum_live: int = V.MIN_LIVE_MATCHES,
) -> tuple[DataFrame, dict]:
    """Guarded snapshot build: counters first, rows only if the feed has not collapsed."""
    now = moment(reference)
    rows = merged_rows(
        merge_decisions(master, feed, previous, failed_regions, now, feed_order, previous_order), now
    )
    audit = snapshot_audit(rows).first().asDict()
    audit["previous_response"] = response_count(previous).first()[0]
    audit["required"] = max(minimum_live, int(audit["previous_response"] * V.LIVE_DROP_RATIO))
    if audit["new_response"] < audit["required"]:
        raise RuntimeError(f"live rows dropped: {audit['new_response']} < {audit['required']}")
    if audit["usable"] < minimum_live:
        raise RuntimeError(f"usable rows below the floor: {audit['usable']} < {minimum_live}")
    return snapshot_rows(rows), audit


def append_history(history: DataFrame, new: DataFrame, order: list[str], keys: tuple[str, ...] = ("entity_id", "collected_ts")) -> DataFrame:
    """History plus the new rows, later generation wins per (entity, collection time)."""
    both = history.withColumn("_generation", F.lit(0)).unionByName(new.withColumn("_generation", F.lit(1)))
    return keep_last(both, list(keys), ["_generation", *order]).drop("_generation")


def trim_history(history: DataFrame, collected: str, reference: Column, retention_days: int | None) -> DataFrame:
    """Rows inside the window; rows without a readable time are kept; None switches it off."""
    if retention_days is None:
        return history
    if int(retention_days) < 1:
        raise ValueError("retention_days must be a positive integer")
    at = instant_of(history, collected)
    return history.filter(at.isNull() | (at >= reference - hours(24.0 * int(retention_days))))


def reuse_violations(
    master: DataFrame, snapshot: DataFrame, reference: Column, tolerance: float = 1e-8
) -> DataFrame:
    """Rows (check, key, detail) that forbid reusing a stored snapshot; empty means reusable."""
    known = master.select(F.trim(F.col("entity_id").cast("string")).alias("entity_id"))
    rows = snapshot.withColumn("entity_id", F.trim(F.col("entity_id").cast("string")))
    ids = rows.select("entity_id")
    a, t, s = (number_of(snapshot, c) for c in ("available", "total", "saturation"))
    good_values = usable(a, t)
    expected = saturation(a, t)
    sane = good_values & s.between(0, 100) & (F.abs(s - expected) <= tolerance)
    text = F.trim(F.col("collected_ts").cast("string"))
    has_time = non_empty(F.col("collected_ts"))
    at = instant_of(snapshot, "collected_ts")
    usable_row = F.coalesce(sane, F.lit(False)) & source_valid(source_time(F.col("source_ts")), reference)

    def report(df: DataFrame, check: str, detail: Column) -> DataFrame:
        return df.select(
            F.lit(check).alias("check"), F.col("entity_id").alias("key"), detail.cast("string").alias("detail")
        )

    def repeated(df: DataFrame) -> DataFrame:
        return df.groupBy("entity_id").count().filter("count > 1 or entity_id is null or entity_id = ''")

    return (
        report(repeated(known), "master_id_unique", F.col("count"))
        .unionByName(report(repeated(ids), "snapshot_id_unique", F.col("count")))
        .unionByName(report(known.join(ids, "entity_id", "left_anti"), "missing_in_snapshot", F.lit(None)))
        .unionByName(report(ids.join(known, "entity_id", "left_anti"), "unknown_in_snapshot", F.lit(None)))
        .unionByName(report(rows.filter(s.isNotNull() & ~F.coalesce(sane, F.lit(False))), "saturation_formula", F.lit(None)))
        .unionByName(report(rows.filter((has_time & at.isNull()) | (usable_row & at.isNull())), "collected_unreadable", text))
        .unionByName(
            report(rows.filter(at > reference + hours(V.FUTURE_SKEW_MINUTES / 60.0)), "collected_in_future", text)
        )
    )


def reuse_audit(snapshot: DataFrame, reference: Column, max_age_hours: float = 12.0, max_source_age_hours: float = 12.0) -> DataFrame:
    """Age and freshness facts of a reusable snapshot in one row."""
    positive(max_age_hours, "max_age_hours")
    a, t, s = (number_of(snapshot, c) for c in ("available", "total", "saturation"))
    sane = F.coalesce(usable(a, t) & (F.abs(s - saturation(a, t)) <= 1e-8), F.lit(False))
    at = source_time(F.col("source_ts"))
    valid, fresh = source_valid(at, reference), source_fresh(at, reference, max_source_age_hours)
    facts = snapshot.agg(
        F.min(instant_of(snapshot, "collected_ts")).alias("snapshot_collected_at"),
        F.count_if(sane & valid).alias("usable"),
        F.count_if(non_empty(F.col("source_ts")) & valid & ~fresh).alias("stale_source"),
        F.count_if(sane & valid & ~fresh).alias("retained_stale"),
    )
    age = minutes_between(reference, F.col("snapshot_collected_at"))
    return facts.select(
        "snapshot_collected_at",
        F.round(clip(age, 0.0, 1e15), 3).alias("snapshot_age_minutes"),
        (age > 60.0 * max_age_hours).alias("snapshot_stale"),
        "usable", "stale_source", "retained_stale",
    )


def rebase_snapshot(master: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Stored values under the new master's names, grades and regions."""
    values = snapshot.select("entity_id", "available", "total", "saturation", "status", "source_ts", "collected_ts")
    return master.join(values, "entity_id", "left").select(*SNAPSHOT_COLUMNS)


def region_of(df: DataFrame) -> DataFrame:
    return df.withColumn("region_key", region_key(F.col("province"), F.col("district")))
