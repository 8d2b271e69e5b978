"""Why a value is missing: ordered reasons per row, rolled up per region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardscope.functions import fixed_values as V
from wardscope.functions.scalars import instant_of, missing_names, non_empty, number_of, region_key, source_time, text_map
from wardscope.operators.snapshot import source_fresh

REPORT_COLUMNS = [
    "entity_type", "entity_id", "region_key", "name", "missing_fields", "reason_code", "reason", "priority",
    "status", "next_action", "source_checked_at",
]


def bed_reason(snapshot: DataFrame) -> Column:
    """First applicable reason code; staleness is judged before the numbers are looked at."""
    a, t, s = (number_of(snapshot, c) for c in ("available", "total", "saturation"))
    fresh = source_fresh(source_time(F.col("source_ts")), instant_of(snapshot, "collected_ts"))
    return (
        F.when(~non_empty(F.col("source_ts")), "BED_API_NO_RESPONSE")
        .when(~fresh, "BED_SOURCE_STALE")
        .when(t.isNull() | (t <= 0), "BED_TOTAL_MISSING")
        .when(a.isNull(), "BED_AVAILABLE_MISSING")
        .when(a < 0, "BED_AVAILABLE_NEGATIVE")
        .when(s.isNull(), "BED_SATURATION_MISSING")
    )


def bed_issues(snapshot: DataFrame) -> DataFrame:
    keyed = snapshot.withColumn("region_key", region_key(F.col("province"), F.col("district"))).withColumn(
        "reason_code", bed_reason(snapshot)
    )
    return keyed.filter("reason_code is not null").select(
        F.lit("hospital_bed").alias("entity_type"),
        F.col("entity_id").cast("string").alias("entity_id"), "region_key", "name",
        text_map(V.MISSING_FIELDS, F.col("reason_code")).alias("missing_fields"), "reason_code",
        text_map(V.REASON_LABELS, F.col("reason_code")).alias("reason"),
        F.lit("P1").alias("priority"), F.lit("open").alias("status"),
        text_map(V.NEXT_ACTIONS, F.col("reason_code")).alias("next_action"),
        F.coalesce(F.col("collected_ts").cast("string"), F.lit("")).alias("source_checked_at"),
    )


def region_issues(snapshot: DataFrame, risk: DataFrame, issues: DataFrame) -> DataFrame:
    """Regions without a score, with the counted reasons of their facilities."""
    counted = issues.groupBy("region_key", "reason_code").agg(F.count(F.lit(1)).alias("n"))
    # at most six reason codes per region, so the list below is bounded
    causes = counted.groupBy("region_key").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("reason_code", "n"))),
                lambda x: F.concat(x["reason_code"], F.lit(" "), x["n"].cast("string"), F.lit("건")),
            ),
            ", ",
        ).alias("causes")
    )
    checked = (
        snapshot.withColumn("region_key", region_key(F.col("province"), F.col("district")))
        .groupBy("region_key")
        .agg(F.max(instant_of(snapshot, "collected_ts")).alias("checked"))
    )
    missing = missing_names(V.COMPONENT_NAMES)
    open_rows = risk.withColumn("missing", missing).filter((F.size("missing") > 0) | F.col("risk").isNull())
    joined = open_rows.join(causes, "region_key", "left").join(checked, "region_key", "left")
    reason = F.concat(
        F.array_join("missing", ", "), F.lit(" 결측"),
        F.coalesce(F.concat(F.lit("; 소속 병원 원인: "), F.col("causes")), F.lit("")),
    )
    code = "REGION_COMPONENT_MISSING"
    return joined.select(
        F.lit("region").alias("entity_type"), F.col("region_key").alias("entity_id"), "region_key",
        F.coalesce(F.col("district"), F.regexp_replace("region_key", r"^[^|]*\|", "")).alias("name"),
        F.array_join(F.concat("missing", F.array(F.lit("regionRisk"), F.lit("위험등급"))), "|").alias("missing_fields"),
        F.lit(code).alias("reason_code"), reason.alias("reason"), F.lit("P0").alias("priority"),
        F.lit("open").alias("status"), F.lit(V.NEXT_ACTIONS[code]).alias("next_action"),
        F.coalesce(F.col("checked").cast("string"), F.lit("")).alias("source_checked_at"),
    )


def match_issues(matches: DataFrame, checked_at: str = "") -> DataFrame:
    state = F.trim(F.coalesce(F.col("match_state"), F.lit("")))
    code = "HIRA_MATCH_DEFERRED"
    return matches.filter(~state.isin(V.MATCHED_STATES)).select(
        F.lit("hospital_hira").alias("entity_type"), F.col("entity_id").cast("string").alias("entity_id"),
        region_key(F.col("province"), F.col("district")).alias("region_key"), "name",
        F.lit(V.MATCH_MISSING_FIELDS).alias("missing_fields"), F.lit(code).alias("reason_code"),
        F.concat(F.lit(V.REASON_LABELS[code] + " ("), F.when(state == "", V.STATE_NONE).otherwise(state), F.lit(")")).alias("reason"),
        F.lit("P2").alias("priority"), F.lit("open").alias("status"),
        F.lit(V.NEXT_ACTIONS[code]).alias("next_action"), F.lit(checked_at).alias("source_checked_at"),
    )


def missingness_report(snapshot: DataFrame, risk: DataFrame, matches: DataFrame | None = None, checked_at: str = "") -> DataFrame:
    issues = bed_issues(snapshot)
    report = issues.unionByName(region_issues(snapshot, risk, issues))
    if matches is not None:
        report = report.unionByName(match_issues(matches, checked_at))
    return report.select(*REPORT_COLUMNS)


def sorted_report(report: DataFrame) -> DataFrame:
    """Report in reading order: priority, kind, region, entity."""
    return report.orderBy("priority", "entity_type", "region_key", "entity_id")


def missingness_summary(report: DataFrame, risk: DataFrame) -> DataFrame:
    """Long-form counters: open items, per entity type, per reason, per missing component."""
    def rows(df: DataFrame, kind: str, item: Column) -> DataFrame:
        return df.groupBy(item.alias("item")).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(kind).alias("kind"), "item", "n"
        )

    missing = risk.select(F.explode(missing_names(V.COMPONENT_NAMES)).alias("component"))
    return (
        rows(report, "total_open_items", F.lit("all"))
        .unionByName(rows(report, "entity_type", F.col("entity_type")))
        .unionByName(rows(report.filter("entity_type <> 'region'"), "reason", F.col("reason_code")))
        .unionByName(rows(missing, "missing_component", F.col("component")))
    )


def reason_by_score_state(report: DataFrame, risk: DataFrame) -> DataFrame:
    """Reason counts overall and inside regions that have no score."""
    unscored = risk.filter("risk is null").select("region_key", F.lit(True).alias("_unscored"))
    joined = report.filter("entity_type <> 'region'").join(unscored, "region_key", "left")
    return joined.groupBy("reason_code").agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(F.coalesce("_unscored", F.lit(False))).alias("n_unscored"),
    )


def staffing_by_region(detail: DataFrame) -> DataFrame:
    """Specialists per region with match rate; the total is withheld where matching is weak."""
    keyed = detail.filter(F.col("province").isNotNull() & F.col("district").isNotNull())
    grouped = keyed.groupBy("province", "district").agg(
        F.sum("specialists").alias("_sum"),
        F.count("entity_id").alias("n_total"),
        F.count_if(F.col("match_state").isin(V.MATCHED_STATES)).alias("n_matched"),
        F.count("specialists").alias("n_known"),
    )
    rated = grouped.withColumn(
        "match_rate", F.try_divide(F.col("n_matched").cast("double"), F.col("n_total").cast("double"))
    )
    ok = F.coalesce(F.col("match_rate") >= V.QUALITY_RATE, F.lit(False))
    return rated.select(
        "province", "district", F.when(ok, F.col("_sum")).alias("specialists"), "n_total", "n_matched", "n_known",
        "match_rate", F.when(ok, V.QUALITY_OK).otherwise(V.QUALITY_REVIEW).alias("quality"),
    )


def quality_gaps(staffing: DataFrame, detail: DataFrame) -> DataFrame:
    """Weak regions, matches still needed, and how many exclusions explain the gap."""
    weak = staffing.filter(F.col("quality") != V.QUALITY_OK)
    excluded = (
        detail.filter(F.col("match_state") == V.STATE_EXCLUDED)
        .groupBy("province", "district")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    # double arithmetic on purpose: ceil(n * 0.8) must round like a float product
    need = F.ceil(F.col("n_total").cast("double") * F.lit(V.QUALITY_RATE)).cast("bigint") - F.col("n_matched")
    return (
        weak.join(excluded, ["province", "district"], "left")
        .select(
            "province", "district", "n_total", "n_matched",
            F.greatest(need, F.lit(0).cast("bigint")).alias("additional_needed"),
            F.coalesce("_n", F.lit(0).cast("bigint")).alias("n_excluded"),
        )
        .withColumn("explained", F.col("additional_needed") <= F.col("n_excluded"))
    )
