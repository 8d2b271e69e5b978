"""Fixed population: bounded carry-forward, conformance checks, resident sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardscope.functions import fixed_values as V
from wardscope.functions.scalars import hours, instant, number, region_key
from wardscope.operators.dedupe import keep_first


def carry_forward(
    current: DataFrame, previous: DataFrame, audit_state: DataFrame, reference: Column
) -> DataFrame:
    """Previous entities absent from the current list, with their omission clock.

    ``audit_state``: entity_id, first_missing_at, consecutive_misses.
    """
    missing = previous.join(current.select("entity_id"), "entity_id", "left_anti")
    state = audit_state.select("entity_id", F.col("first_missing_at").alias("_first"), F.col("consecutive_misses").alias("_n"))
    return missing.join(state, "entity_id", "left").select(
        *previous.columns,
        F.coalesce(instant(F.col("_first")), reference).alias("first_missing_at"),
        reference.alias("last_missing_at"),
        (F.coalesce(F.col("_n"), F.lit(0)) + 1).alias("consecutive_misses"),
    )


def population_violations(
    current: DataFrame, previous: DataFrame, carried: DataFrame, reference: Column,
    expected_entities: int, expected_regions: int, max_carried: int = V.MAX_CARRIED,
    max_misses: int = V.MAX_CONSECUTIVE_MISSES, max_age_hours: float = V.MAX_MISSING_AGE_HOURS,
) -> DataFrame:
    """Reasons (check, key, detail) why the omission may not be carried forward."""
    if expected_entities <= 0 or expected_regions <= 0 or max_carried < 0 or max_misses < 1 or max_age_hours <= 0:
        raise ValueError("population limits must be positive")

    def rows(df: DataFrame, check: str, key: Column, detail: Column) -> DataFrame:
        return df.select(F.lit(check).alias("check"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))

    def bad_ids(df: DataFrame, check: str) -> DataFrame:
        ids = df.select(F.trim(F.col("entity_id").cast("string")).alias("id"))
        return rows(
            ids.groupBy("id").count().filter("count > 1 or id is null or id = ''"), check, F.col("id"), F.col("count")
        )

    added = current.join(previous.select("entity_id"), "entity_id", "left_anti")
    shape = previous.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct("province", "district")).alias("r")
    ).filter((F.col("n") != expected_entities) | (F.col("r") != expected_regions))
    too_many = carried.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_carried)
    size = current.join(carried.select("entity_id"), "entity_id", "full").agg(
        F.count(F.lit(1)).alias("n")
    ).filter(F.col("n") != expected_entities)
    none = F.lit(None).cast("string")
    age_over = F.col("last_missing_at") > F.col("first_missing_at") + hours(max_age_hours)
    return (
        bad_ids(current, "current_id")
        .unionByName(bad_ids(previous, "previous_id"))
        .unionByName(rows(added, "added", F.col("entity_id"), none))
        .unionByName(rows(shape, "previous_shape", none, F.concat_ws("/", "n", "r")))
        .unionByName(rows(too_many, "too_many_missing", none, F.col("n")))
        .unionByName(rows(size, "population_size", none, F.col("n")))
        .unionByName(rows(carried.filter(F.col("consecutive_misses") > max_misses), "too_many_misses", F.col("entity_id"), F.col("consecutive_misses")))
        .unionByName(rows(carried.filter(age_over), "missing_too_long", F.col("entity_id"), F.col("first_missing_at")))
        .unionByName(rows(carried.filter(F.col("first_missing_at") > reference + hours(5 / 60)), "first_missing_in_future", F.col("entity_id"), F.col("first_missing_at")))
    )


def regions_of(master: DataFrame) -> DataFrame:
    return master.select("province", "district").distinct()


def residents_from_registry(raw: DataFrame, regions: DataFrame, file_period: str | None = None) -> DataFrame:
    """Resident counts from the registry layout: region text with a 10-digit code, one total column."""
    region_column = raw.columns[0]
    totals = [c for c in raw.columns if c.endswith(V.REGISTRY_COLUMN_SUFFIX)]
    if len(totals) != 1:
        raise ValueError("exactly one total-population column expected")
    period = _header_period(totals[0])
    if file_period is not None and file_period != period:
        raise ValueError(f"file period {file_period} differs from header period {period}")
    text = F.col(f"`{region_column}`")
    code = F.nullif(F.regexp_extract(text, r"\((\d{10})\)\s*$", 1), F.lit(""))
    rows = raw.select(
        F.trim(F.regexp_replace(F.regexp_replace(text, r"\s*\((\d{10})\)\s*$", ""), r"\s+", " ")).alias("path"),
        code.alias("code10"),
        number(F.replace(F.col(f"`{totals[0]}`"), F.lit(","), F.lit(""))).alias("population"),
    )
    is_district = F.coalesce(F.substring("code10", 3, 3) != "000", F.lit(True))
    one = keep_first(rows, ["path"], [~is_district, F.col("code10")])
    single = (F.col("province") == V.SINGLE_TIER_PROVINCE) & (F.col("district") == V.SINGLE_TIER_DISTRICT)
    wanted = regions.withColumn(
        "path", F.when(single, V.SINGLE_TIER_PROVINCE).otherwise(F.concat_ws(" ", "province", "district"))
    )
    return wanted.join(one, "path", "left").select(
        "province", "district", "population",
        F.when(single, V.SINGLE_TIER_CODE).otherwise(F.substring("code10", 1, 5)).alias("admin_code"),
        F.lit(period).alias("period"), F.lit(V.REGISTRY_SOURCE).alias("source"),
    )


def duplicate_registry_paths(raw: DataFrame) -> DataFrame:
    """Region texts that occur twice although only the single-tier province may."""
    text = F.col(f"`{raw.columns[0]}`")
    path = F.trim(F.regexp_replace(F.regexp_replace(text, r"\s*\((\d{10})\)\s*$", ""), r"\s+", " "))
    return raw.select(path.alias("path")).groupBy("path").count().filter(
        (F.col("count") > 1) & (F.col("path") != V.SINGLE_TIER_PROVINCE)
    )


def _header_period(column: str) -> str:
    import re

    found = re.match(r"^(\d{4})년(\d{2})월_", column)
    if not found:
        raise ValueError(f"no period in column name {column}")
    return found.group(1) + found.group(2)


def residents_from_fallback(raw: DataFrame, regions: DataFrame, year: str | None) -> DataFrame:
    """Resident counts from the positional layout (code, name, age code, .., .., count)."""
    c = [F.col(f"`{name}`") for name in raw.columns]

    def bare(column: Column) -> Column:
        return F.trim(F.replace(column.cast("string"), F.lit("'"), F.lit("")))

    rows = raw.filter(bare(c[2]) == "000").select(
        bare(c[0]).alias("admin_code"),
        F.regexp_replace(F.trim(c[1].cast("string")), r"\(통합\)$", "").alias("area"),
        number(c[5]).alias("population"),
    )
    top = rows.filter(F.length("admin_code") == 2)
    districts = (
        rows.filter(F.length("admin_code") > 2)
        .join(top.select(F.col("admin_code").alias("_p"), F.col("area").alias("src_province")), F.substring("admin_code", 1, 2) == F.col("_p"))
        .select("src_province", F.col("area").alias("src_district"), "population", "admin_code")
        .dropna(subset=["src_province", "src_district", "population"])
    )
    merged = F.col("province") == V.MERGED_PROVINCE
    origin = (
        F.when(merged & F.col("district").isin(V.MERGED_CITY_DISTRICTS), V.MERGED_CITY)
        .when(merged, V.MERGED_RURAL)
        .otherwise(F.col("province"))
    )
    joined = regions.withColumn("_origin", origin).join(
        districts, (F.col("_origin") == F.col("src_province")) & (F.col("district") == F.col("src_district")), "left"
    )
    single = top.filter(F.col("area") == V.SINGLE_TIER_PROVINCE).agg(F.max("population").alias("p")).first()["p"]
    fill = (F.col("province") == V.SINGLE_TIER_PROVINCE) & F.col("population").isNull() & F.lit(single is not None)
    return joined.select(
        "province", "district",
        F.when(fill, F.lit(single)).otherwise(F.col("population")).cast("double").alias("population"),
        F.when(fill, V.SINGLE_TIER_CODE).otherwise(F.col("admin_code")).alias("admin_code"),
        F.lit(f"{year}12" if year else "").alias("period"), F.lit(V.FALLBACK_SOURCE).alias("source"),
    )


def resident_violations(residents: DataFrame, regions: DataFrame) -> DataFrame:
    """Unmatched regions, non-positive counts and malformed or repeated codes."""
    key = region_key(F.col("province"), F.col("district"))

    def rows(df: DataFrame, check: str, detail: str) -> DataFrame:
        return df.select(F.lit(check).alias("check"), key.alias("key"), F.col(detail).cast("string").alias("detail"))

    code_count = residents.groupBy("admin_code").agg(
        F.count(F.lit(1)).alias("n"), F.min("province").alias("province"), F.min("district").alias("district")
    )
    lost = regions.join(residents.select("province", "district"), ["province", "district"], "left_anti")
    return (
        rows(residents.filter("population is null or admin_code is null"), "unmatched", "population")
        .unionByName(rows(residents.filter("population <= 0"), "not_positive", "population"))
        .unionByName(rows(residents.filter(~F.col("admin_code").rlike(r"^\d{5}$")), "code_format", "admin_code"))
        .unionByName(rows(code_count.filter("n > 1 and admin_code is not null"), "code_repeated", "admin_code"))
        .unionByName(rows(lost, "region_lost", "province"))
    )
