"""Column expressions: numbers, bins, keys and clocks.  All run inside codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, TimestampNTZType, TimestampType

from wardscope.functions import fixed_values as V


def number(column: Column | str) -> Column:
    """Text or number to a finite double, otherwise NULL (never an error, never NaN)."""
    value = (F.col(column) if isinstance(column, str) else column).try_cast("double")
    return F.when(F.isnan(value) | F.abs(value).isin(float("inf")), None).otherwise(value)


def number_of(df: DataFrame, name: str) -> Column:
    """``number`` for a text column, the column itself if it is numeric already."""
    kind = df.schema[name].dataType
    return F.col(name).cast("double") if isinstance(kind, NumericType) else number(name)


def instant_of(df: DataFrame, name: str) -> Column:
    """``instant`` for a text column, the column itself if it is a timestamp already."""
    kind = df.schema[name].dataType
    return F.col(name).cast("timestamp") if isinstance(kind, (TimestampType, TimestampNTZType)) else instant(F.col(name))


def clip(value: Column, low, high) -> Column:
    """Clamp that keeps NULL; plain greatest/least would turn NULL into a bound."""
    bounded = F.least(F.greatest(value, F.lit(low)), F.lit(high))
    return F.when(value.isNotNull(), bounded)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient with NULL for a zero divisor."""
    return F.try_divide(numerator.cast("double"), F.nullif(denominator.cast("double"), F.lit(0.0)))


def right_closed(value: Column, edges: list[float], labels: list) -> Column:
    """Label of the bin (previous edge, edge]; NULL stays NULL."""
    cases = F.when(value.isNull(), None)
    for edge, label in zip(edges, labels):
        cases = cases.when(value <= edge, F.lit(label))
    return cases.otherwise(F.lit(labels[len(edges)]))


def risk_grade(value: Column) -> Column:
    return right_closed(value, V.RISK_UPPER_EDGES, V.RISK_GRADES)


def risk_grade_name(value: Column) -> Column:
    return right_closed(value, V.RISK_UPPER_EDGES, V.RISK_GRADE_NAMES)


def load_status(saturation: Column) -> Column:
    return F.coalesce(
        right_closed(saturation, V.STATUS_UPPER_EDGES, V.STATUS_NAMES), F.lit(V.STATUS_MISSING)
    )


def saturation(available: Column, total: Column) -> Column:
    """Occupied share in percent, clamped to 0..100; NULL when it cannot be formed."""
    return clip(ratio(total - available, total) * 100, 0.0, 100.0)


def usable(available: Column, total: Column) -> Column:
    return F.coalesce((total > 0) & (available >= 0), F.lit(False))


def non_empty(column: Column) -> Column:
    return F.coalesce(F.trim(column.cast("string")) != "", F.lit(False))


def region_key(province: Column, district: Column) -> Column:
    return F.concat(
        F.trim(F.coalesce(province, F.lit(""))), F.lit("|"), F.trim(F.coalesce(district, F.lit("")))
    )


def key_province(key: Column) -> Column:
    return F.when(key.contains("|"), F.substring_index(key, "|", 1)).otherwise(F.lit(""))


def key_district(key: Column) -> Column:
    return F.when(key.contains("|"), F.regexp_replace(key, r"^[^|]*\|", "")).otherwise(key)


def parent_city(name: Column) -> Column:
    """Parent city of a child district name, or NULL when there is none."""
    return F.nullif(F.regexp_extract(name, "^(.+?시)(.+구)$", 1), F.lit(""))


def address_region(address: Column) -> tuple[Column, Column]:
    """First two address tokens as (province, district), single-tier province included."""
    tokens = F.split(F.trim(F.coalesce(address, F.lit(""))), r"\s+")
    province = F.coalesce(F.get(tokens, 0), F.lit(""))
    second = F.coalesce(F.get(tokens, 1), F.lit(""))
    district = F.when(province == V.SINGLE_TIER_PROVINCE, V.SINGLE_TIER_DISTRICT).otherwise(second)
    return province, district


def short_province(province: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in V.PROVINCE_SHORT.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, province), province)


def short_district(name: Column) -> Column:
    return F.regexp_replace(name, "(시|군|구)$", "")


def source_text(column: Column) -> Column:
    """14-digit source stamp from text that may have been written as a float."""
    plain = F.trim(column.cast("string")).try_cast("decimal(24,4)").cast("string")
    digits = F.nullif(F.regexp_extract(plain, r"^(\d{1,14})\.0000$", 1), F.lit(""))
    return F.lpad(digits, 14, "0")


def source_time(column: Column, zone: str = V.SOURCE_ZONE) -> Column:
    """Instant of a local 14-digit stamp; impossible dates give NULL.

    The zone is part of the parsed text, so the session zone has no say.
    """
    return F.try_to_timestamp(F.concat(source_text(column), F.lit(zone)), F.lit("yyyyMMddHHmmssVV"))


def instant(column: Column) -> Column:
    """ISO-8601 text with any offset (none means UTC session time) to an instant."""
    return F.try_to_timestamp(F.trim(column.cast("string")))


def hours(value: float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(value) * 3600.0).cast("decimal(18,6)"))


def minutes_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(60_000_000.0)


def age_minutes(now: Column, moment: Column) -> Column:
    """Whole minutes since ``moment``, never below zero, halves rounded up."""
    return clip(F.floor(minutes_between(now, moment) + 0.5).cast("double"), 0.0, float(2**53)).cast("bigint")


def display_time(moment: Column, zone: str = V.SOURCE_ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(moment, zone), "MM.dd. HH:mm")


def latest_of(*moments: Column) -> Column:
    """Newest of several instants; unparseable (NULL) ones are passed over."""
    return F.greatest(*moments) if len(moments) > 1 else moments[0]


def strict_date(text: Column) -> Column:
    """``YYYY-MM-DD`` that survives a round trip, otherwise NULL."""
    day = F.to_date(F.try_to_timestamp(F.trim(text), F.lit("yyyy-MM-dd")))
    return F.when(F.date_format(day, "yyyy-MM-dd") == F.trim(text), day)


def evidence_url_ok(url: Column, domain: str, expected_id: Column | None = None, id_name: str = "ykiho") -> Column:
    """https, host is the domain or below it, and the id in the query equals the row's id."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    good = (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & (
        (host == domain) | host.endswith("." + domain)
    )
    if expected_id is not None:
        good = good & (F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit(id_name)), F.lit("")) == expected_id)
    return F.coalesce(good, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def count_present(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])


def missing_names(names: dict[str, str]) -> Column:
    """Array of display names whose column is NULL, in the given order."""
    return F.filter(
        F.array(*[F.when(F.col(c).isNull(), F.lit(label)) for c, label in names.items()]),
        lambda x: x.isNotNull(),
    )


def correlation_level(value: Column) -> Column:
    edge = F.lit(V.CORRELATION_LEVELS[0][1])
    for floor, label in V.CORRELATION_LEVELS[1:]:
        edge = F.when(F.abs(value) >= floor, F.lit(label)).otherwise(edge)
    return edge


def text_map(pairs: dict[str, str], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.try_element_at(table, key)


def set_fingerprint(identifier: Column, length: int = 16) -> Column:
    """Order-free fingerprint of a set of ids as an aggregate expression.

    A sum of 60-bit digests combines map-side, so no list of ids is ever built,
    however many ids share the group.
    """
    digest = F.conv(F.substring(F.sha2(identifier.cast("string"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    body = F.concat_ws(":", F.count(identifier).cast("string"), F.coalesce(F.sum(digest), F.lit(0).cast("decimal(38,0)")).cast("string"))
    return F.substring(F.sha2(body, 256), 1, length)
