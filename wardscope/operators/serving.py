"""Serving tables: facility and region detail, freshness, indicators, deadlines.

Region detail holds counts and states; the facilities of a region are a table
of their own keyed by region_key, never a list inside one region row, because
such a list would gather a whole region into one record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardscope.functions import fixed_values as V
from wardscope.functions.scalars import (
    age_minutes, hours, instant_of, key_province, missing_names, number_of, ratio, region_key,
    set_fingerprint, source_time,
)
from wardscope.operators.nearest import distance_basis
from wardscope.operators.score import top_factors


def facility_detail(master: DataFrame, snapshot: DataFrame, routes: DataFrame | None = None, max_age_hours: float = V.SOURCE_MAX_AGE_HOURS) -> DataFrame:
    """Master row with its usable load values, their expiry and its route."""
    values = snapshot.select(
        "entity_id", number_of(snapshot, "available").alias("_a"), number_of(snapshot, "total").alias("_t"), number_of(snapshot, "saturation").alias("_s"),
        F.col("status").alias("_status"), F.col("source_ts").cast("string").alias("source_ts"), "collected_ts",
    )
    good = F.coalesce((F.col("_a") >= 0) & (F.col("_t") > 0) & F.col("_s").isNotNull(), F.lit(False))
    rows = (
        master.withColumn("region_key", region_key(F.col("province"), F.col("district")))
        .join(values, "entity_id", "left")
        .withColumn("available", F.when(good, F.col("_a")))
        .withColumn("total", F.when(good, F.col("_t")))
        .withColumn("saturation", F.when(good, F.col("_s")))
        .withColumn("status", F.when(good, F.coalesce("_status", F.lit(V.STATUS_MISSING))).otherwise(V.STATUS_MISSING))
        .withColumn("valid_until", F.when(good, source_time(F.col("source_ts")) + hours(max_age_hours)))
        .drop("_a", "_t", "_s", "_status")
    )
    if routes is None:
        return rows
    fields = ["road_km", "eta_min", "straight_km", "route_status"]
    return distance_basis(rows.join(routes.select("entity_id", *fields), "entity_id", "left"))


def coverage_label(reporting: Column, total: Column) -> Column:
    return F.when(reporting == 0, V.COVERAGE_NONE).when(reporting == total, V.COVERAGE_FULL).otherwise(V.COVERAGE_PART)


def region_detail(risk: DataFrame, facilities: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Risk row with facility counts, coverage, expiry and cluster label."""
    per_region = facilities.groupBy("region_key").agg(
        F.count(F.lit(1)).alias("n_facilities"),
        F.count("saturation").alias("n_contributing"),
        F.count(F.when(F.col("saturation").isNotNull(), F.col("valid_until"))).alias("n_dated"),
        F.min(F.when(F.col("saturation").isNotNull(), F.col("valid_until"))).alias("first_expiry"),
    )
    rows = risk.join(per_region, "region_key", "left")
    zero = F.lit(0).cast("bigint")
    for c in ("n_facilities", "n_contributing", "n_dated", "n_reporting"):
        rows = rows.withColumn(c, F.coalesce(F.col(c), zero))
    unknown = (F.col("n_contributing") != F.col("n_reporting")) | (F.col("n_dated") != F.col("n_reporting"))
    rows = (
        rows.withColumn("province", key_province(F.col("region_key")))
        .withColumn("missing_components", F.array_join(missing_names(V.COMPONENT_SHORT), ","))
        .withColumn("coverage", ratio(F.col("n_reporting"), F.col("n_facilities")))
        .withColumn("coverage_label", coverage_label(F.col("n_reporting"), F.col("n_facilities")))
        .withColumn("freshness_unknown", unknown)
        .withColumn("risk_valid_until", F.when(~unknown, F.col("first_expiry")))
        .drop("first_expiry", "n_contributing", "n_dated")
    )
    if clusters is not None:
        rows = rows.join(clusters.select("region_key", "cluster", "cluster_label"), "region_key", "left")
    return rows


def facility_freshness(facilities: DataFrame, now: Column) -> DataFrame:
    has = F.coalesce(F.col("available"), F.col("total"), F.col("saturation")).isNotNull()
    stale = has & (F.col("valid_until").isNull() | (F.col("valid_until") <= now))
    return facilities.withColumn("is_stale", stale).withColumn(
        "freshness", F.when(~has, "missing").when(stale, "last-known").otherwise("current")
    )


def region_freshness(regions: DataFrame, now: Column) -> DataFrame:
    missing = F.col("risk").isNull()
    expired = ~missing & (
        F.col("freshness_unknown") | F.col("risk_valid_until").isNull() | (F.col("risk_valid_until") <= now)
    )
    return regions.withColumn("is_expired", expired).withColumn(
        "freshness", F.when(missing, "missing").when(expired, "last-known").otherwise("current")
    )


def next_expiry(regions: DataFrame, now: Column) -> DataFrame:
    """Earliest expiry that still lies ahead."""
    ahead = F.when(F.col("risk").isNotNull() & (F.col("risk_valid_until") > now), F.col("risk_valid_until"))
    return regions.agg(F.min(ahead).alias("next_expiry"))


def oldest_snapshot(snapshot: DataFrame) -> DataFrame:
    return snapshot.agg(F.min(instant_of(snapshot, "collected_ts")).alias("as_of"))


def indicators(risk: DataFrame) -> DataFrame:
    """Mean risk, high-risk count, complete, total and missing regions."""
    return risk.agg(
        F.avg("risk").alias("avg_risk"),
        F.count_if(F.col("risk") > 50).alias("n_high"),
        F.count("risk").alias("n_complete"),
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col("risk").isNull()).alias("n_missing"),
    )


def analysis_snapshot(regions: DataFrame, as_of: Column, now: Column) -> DataFrame:
    """How many scores were valid when calculated, are still current, or have expired."""
    fresh = region_freshness(regions, now)
    complete = F.col("risk").isNotNull()
    return fresh.agg(
        F.count_if(complete).alias("source_complete"),
        F.count_if(complete & F.coalesce(F.col("risk_valid_until") > as_of, F.lit(False))).alias("source_policy_valid"),
        F.count_if(complete & ~F.coalesce(F.col("risk_valid_until") > as_of, F.lit(False))).alias("source_policy_invalid"),
        F.count_if(complete & ~F.col("is_expired")).alias("current_complete"),
        F.count_if(~complete).alias("source_missing"),
        F.count_if(F.col("is_expired")).alias("expired_regions"),
    )


def missing_regions(regions: DataFrame) -> DataFrame:
    return regions.filter("risk is null").select("region_key", "district", "province", "missing_components").orderBy("region_key")


def health_summary(regions: DataFrame, facilities: DataFrame, as_of: Column, now: Column, stale_after_minutes: int = V.DATA_STALE_AFTER_MINUTES) -> DataFrame:
    """One row: state, data age, region and facility counters, next expiry."""
    r = region_freshness(regions, now).agg(
        F.count(F.lit(1)).alias("regions"), F.count("risk").alias("complete_regions"),
        F.count_if("is_expired").alias("expired_regions"),
        F.min(F.when(F.col("risk").isNotNull() & (F.col("risk_valid_until") > now), F.col("risk_valid_until"))).alias("next_expiry"),
    )
    f = facility_freshness(facilities, now).agg(F.count_if("is_stale").alias("expired_facilities"))
    age = age_minutes(now, as_of)
    return (
        r.withColumn("expired_facilities", f.scalar())
        .withColumn("data_age_minutes", age)
        .withColumn("data_stale", F.coalesce(F.col("data_age_minutes") > stale_after_minutes, F.lit(True)) | (F.col("expired_regions") > 0))
        .withColumn("status", F.when(F.col("data_stale"), "degraded").otherwise("ok"))
    )


def source_deadline(snapshot: DataFrame, max_age_hours: float = V.SOURCE_MAX_AGE_HOURS) -> DataFrame:
    """Earliest source expiry of usable rows and a fingerprint of the ids that share it."""
    a, t, s = (number_of(snapshot, c) for c in ("available", "total", "saturation"))
    at = source_time(F.col("source_ts"))
    rows = snapshot.filter((t > 0) & (a >= 0) & s.isNotNull() & at.isNotNull()).select(
        F.trim(F.col("entity_id").cast("string")).alias("entity_id"), at.alias("source_at")
    )
    # rows are first combined per instant, then the earliest instant is kept
    per_instant = rows.groupBy("source_at").agg(
        set_fingerprint(F.col("entity_id")).alias("fingerprint"), F.count(F.lit(1)).alias("n_entities")
    )
    return per_instant.agg(
        F.min(F.col("source_at") + hours(max_age_hours)).alias("deadline_at"),
        F.min_by("fingerprint", "source_at").alias("fingerprint"),
        F.min_by("n_entities", "source_at").alias("n_entities"),
    )


def content_version(df: DataFrame, identifier: str, length: int = 20) -> DataFrame:
    return df.agg(set_fingerprint(F.col(identifier), length).alias("version"))


def region_sentence(risk: DataFrame) -> DataFrame:
    """One sentence per complete region: score, grade, two leading factors with their scores, cluster label if known."""
    factors = top_factors(V.COMPONENT_SHORT, scores=True)
    label = F.col("cluster_label") if "cluster_label" in risk.columns else F.lit(None).cast("string")
    values = [F.col("district"), F.format_string("%.1f", F.col("risk")), F.col("risk_grade_name")]
    for i in (0, 1):
        factor = F.get(factors, i)
        values += [factor["label"], F.format_string("%.0f", factor["score"])]
    told = [part for pair in zip(values, map(F.lit, V.SENTENCE_TEXTS)) for part in pair]
    before, after = map(F.lit, V.SENTENCE_LABEL)
    text = F.concat(*told, F.coalesce(F.concat(before, label, after), F.lit(V.SENTENCE_END)))
    return risk.filter("risk is not null").select("region_key", text.alias("sentence"))


def province_counts(regions: DataFrame) -> DataFrame:
    """Regions per province, largest first."""
    return (
        regions.groupBy(key_province(F.col("region_key")).alias("province"))
        .agg(F.count(F.lit(1)).alias("n_regions"))
        .orderBy(F.col("n_regions").desc(), "province")
    )


def search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows whose name in any of the columns contains the text."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).contains(text.strip()), F.lit(False))
    return df.filter(hit)


def serving_tables(
    master: DataFrame, snapshot: DataFrame, risk: DataFrame, routes: DataFrame | None, clusters: DataFrame | None, now: Column
) -> dict[str, DataFrame]:
    """All tables a dashboard reads, as separate frames."""
    facilities = facility_freshness(facility_detail(master, snapshot, routes), now)
    regions = region_freshness(region_detail(risk, facilities, clusters), now)
    return {
        "facilities": facilities,
        "regions": regions,
        "indicators": indicators(risk),
        "as_of": oldest_snapshot(snapshot),
        "next_expiry": next_expiry(regions, now),
        "missing_regions": missing_regions(regions),
        "sentences": region_sentence(regions),
        "deadline": source_deadline(snapshot),
    }


