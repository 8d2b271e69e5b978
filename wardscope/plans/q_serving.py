"""Serving and streaming queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardscope.functions import fixed_values as V
from wardscope.operators import serving as D
from wardscope.operators import snapshot as N
from wardscope.plans import bindings as B
from wardscope.plans import q_feed as Q
from wardscope.plans.registry import query, r6, with_ctes
from wardscope.session import cut_lineage, fresh_path
from wardscope.streaming import feeds as S

# facility values of the merged snapshot, expiring twelve hours after their source time
SERVE_SQL = """
fac AS (
  SELECT entity_id, region_key, saturation, CASE WHEN saturation IS NOT NULL THEN status ELSE '결측' END AS status,
    CASE WHEN saturation IS NOT NULL THEN source_at + INTERVAL 12 HOUR END AS valid_until FROM snapshot),
loads AS (SELECT region_key, avg(saturation) AS s_load, count(saturation) AS n_reporting, count(*) AS n_facilities, min(valid_until) AS first_expiry FROM fac GROUP BY 1),
det AS (
  SELECT r.region_key, r.district, r.risk, s_access, s_pop, s_staff, r.s_load, l.n_reporting, n_facilities, n_reporting::DOUBLE / n_facilities AS coverage,
    CASE WHEN l.n_reporting = 0 THEN '결측' WHEN l.n_reporting = n_facilities THEN '전체응답' ELSE '부분응답' END AS coverage_label, first_expiry,
    concat_ws(',', CASE WHEN r.s_load IS NULL THEN '병상포화도' END, CASE WHEN s_access IS NULL THEN '접근성' END, CASE WHEN s_pop IS NULL THEN '인구대비병상' END, CASE WHEN s_staff IS NULL THEN '의료진부족' END) AS missing_components
  FROM (SELECT * EXCLUDE (n_reporting) FROM risks) r JOIN loads l USING (region_key))
"""
SERVE_PARTS = (*Q.SNAP_PARTS, Q.RISK_ONLY, SERVE_SQL)
FRESH_NOW = "2024-01-20 18:00:00"


def tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(facility detail, region detail); the snapshot is written once and read by both."""
    rows = cut_lineage(Q.snapshot(spark, sf))
    facilities = D.facility_detail(B.master(spark, sf).select("entity_id", "name", "grade", "province", "district"), rows)
    reporting = rows.withColumn("region_key", F.concat_ws("|", "province", "district")).groupBy("region_key").agg(F.count("saturation").alias("n_reporting"))
    risk = B.region_risk(spark, sf).drop("n_reporting").join(reporting, "region_key")
    return facilities, D.region_detail(risk, facilities)


@query(
    "q55_region_detail",
    with_ctes(
        *SERVE_PARTS,
        select="""
SELECT region_key, district, round(risk, 6) AS risk, n_facilities, n_reporting, round(coverage, 6) AS coverage, coverage_label, missing_components,
  strftime(first_expiry, '%Y-%m-%d %H:%M:%S') AS risk_valid_until FROM det""",
    ),
)
def region_detail(spark: SparkSession, sf: str) -> DataFrame:
    _, regions = tables(spark, sf)
    return regions.select(
        "region_key", "district", r6("risk"), "n_facilities", "n_reporting", r6("coverage"), "coverage_label", "missing_components", Q.stamp("risk_valid_until")
    )


@query(
    "q56_freshness",
    with_ctes(
        *SERVE_PARTS,
        select=f"""
SELECT 'facility' AS kind, entity_id AS key, CASE WHEN saturation IS NULL THEN 'missing' WHEN valid_until <= TIMESTAMP '{FRESH_NOW}' THEN 'last-known' ELSE 'current' END AS freshness, strftime(valid_until, '%Y-%m-%d %H:%M:%S') AS valid_until FROM fac
UNION ALL SELECT 'region', region_key, CASE WHEN risk IS NULL THEN 'missing' WHEN first_expiry IS NULL OR first_expiry <= TIMESTAMP '{FRESH_NOW}' THEN 'last-known' ELSE 'current' END, strftime(first_expiry, '%Y-%m-%d %H:%M:%S') FROM det
UNION ALL SELECT 'next_expiry', 'all', '', strftime(min(first_expiry), '%Y-%m-%d %H:%M:%S') FROM det WHERE risk IS NOT NULL AND first_expiry > TIMESTAMP '{FRESH_NOW}'""",
    ),
)
def freshness(spark: SparkSession, sf: str) -> DataFrame:
    facilities, regions = tables(spark, sf)
    now = N.moment(FRESH_NOW)
    regions = cut_lineage(regions)
    f = D.facility_freshness(facilities, now).select(F.lit("facility").alias("kind"), F.col("entity_id").alias("key"), "freshness", Q.stamp("valid_until"))
    r = D.region_freshness(regions, now).select(F.lit("region").alias("kind"), F.col("region_key").alias("key"), "freshness", Q.stamp("risk_valid_until", "valid_until"))
    n = D.next_expiry(regions, now).select(F.lit("next_expiry").alias("kind"), F.lit("all").alias("key"), F.lit("").alias("freshness"), Q.stamp("next_expiry", "valid_until"))
    return f.unionByName(r).unionByName(n)


@query(
    "q57_analysis_snapshot",
    with_ctes(
        *SERVE_PARTS,
        "as_of_row AS (SELECT min(collected_at) AS t FROM snapshot)",
        select=f"""
SELECT count(risk) AS source_complete, count(*) FILTER (risk IS NOT NULL AND coalesce(first_expiry > t, false)) AS source_policy_valid,
  count(*) FILTER (risk IS NOT NULL AND NOT coalesce(first_expiry > t, false)) AS source_policy_invalid,
  count(*) FILTER (risk IS NOT NULL AND coalesce(first_expiry > TIMESTAMP '{FRESH_NOW}', false)) AS current_complete, count(*) FILTER (risk IS NULL) AS source_missing,
  count(*) FILTER (risk IS NOT NULL AND NOT coalesce(first_expiry > TIMESTAMP '{FRESH_NOW}', false)) AS expired_regions,
  count(*) AS regions, CAST(floor(epoch(TIMESTAMP '{FRESH_NOW}' - any_value(t)) / 60 + 0.5) AS BIGINT) AS data_age_minutes, 'degraded' AS status,
  (SELECT count(*) FROM fac WHERE saturation IS NOT NULL AND valid_until <= TIMESTAMP '{FRESH_NOW}') AS expired_facilities
FROM det, as_of_row""",
    ),
)
def analysis_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    facilities, regions = tables(spark, sf)
    facilities, regions = cut_lineage(facilities), cut_lineage(regions)
    as_of = D.oldest_snapshot(facilities).first()["as_of"]
    now = N.moment(FRESH_NOW)
    counts = D.analysis_snapshot(regions, F.lit(as_of), now)
    health = D.health_summary(regions, facilities, F.lit(as_of), now)
    columns = ["regions", "data_age_minutes", "status", "expired_facilities"]
    return counts.select("*", *[health.select(c).scalar().alias(c) for c in columns])


@query(
    "q58_deadline_fingerprint",
    with_ctes(
        B.FEED_SQL,
        """u AS (SELECT entity_id, date_trunc('hour', source_at) AS s FROM feed_all WHERE total > 0 AND available >= 0),
m AS (SELECT min(s) AS s0 FROM u),
d AS (SELECT count(entity_id) AS n, sum(('0x' || substr(sha256(entity_id), 1, 15))::BIGINT::HUGEINT) AS t FROM u, m WHERE s = s0)""",
        select="""
SELECT (SELECT strftime(s0 + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') FROM m) AS deadline_at, substr(sha256(n::VARCHAR || ':' || t::VARCHAR), 1, 16) AS fingerprint, n AS n_entities FROM d""",
    ),
)
def deadline_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    hour = F.date_format(F.date_trunc("hour", F.from_utc_timestamp(F.date_trunc("second", "ts"), "Asia/Seoul")), "yyyyMMddHHmmss")
    rows = B.feed_all(spark, sf).withColumn("source_ts", hour).withColumn("saturation", F.lit(1.0))
    return D.source_deadline(rows).select(Q.stamp("deadline_at"), "fingerprint", "n_entities")


@query(
    "q66_region_sentence",
    with_ctes(
        B.RISK_SQL,
        "u AS (SELECT region_key, label, v, row_number() OVER (PARTITION BY region_key ORDER BY v DESC, i) AS rn FROM ("
        + " UNION ALL ".join(f"SELECT region_key, '{label}' AS label, {i} AS i, {c} AS v FROM risks" for i, (c, label) in enumerate(V.COMPONENT_SHORT.items()))
        + "))",
        select="SELECT r.region_key, "
        + " || ".join(
            f"{value} || '{text}'"
            for value, text in zip(
                ["district", "printf('%.1f', risk)", "risk_grade_name", "a.label", "printf('%.0f', a.v)", "b.label", "printf('%.0f', b.v)"], V.SENTENCE_TEXTS
            )
        )
        + f" || '{V.SENTENCE_END}' AS sentence FROM risks r JOIN u a ON a.region_key = r.region_key AND a.rn = 1"
        + " JOIN u b ON b.region_key = r.region_key AND b.rn = 2 WHERE risk IS NOT NULL",
    ),
)
def region_sentence(spark: SparkSession, sf: str) -> DataFrame:
    return D.region_sentence(B.region_risk(spark, sf, readers=1))


# -------------------------------------------------------------------- streaming
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
    ]
)


SLICES = 4


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Events as four arrivals, each a micro-batch; rows of the last half day of a slice may come one slice late."""
    events = spark.read.schema(EVENT_SCHEMA).parquet(f"{sf}/events.parquet")
    span = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    at, first = F.col("ts").cast("timestamp").cast("double"), F.lit(span["a"]).cast("timestamp").cast("double")
    width = (F.lit(span["b"]).cast("timestamp").cast("double") - first) / SLICES
    place = (at - first) / width
    late = (F.col("event_id") % 5 == 0) & (((F.floor(place) + 1) - place) * width <= 12 * 3600)
    arrival = F.least(F.floor(place) + late.cast("int"), F.lit(SLICES - 1))
    folder, files = S.land_in_slices(events, arrival, SLICES, "events")
    return S.utc_event_time(S.read_stream(spark, folder, EVENT_SCHEMA, files_per_batch=files), "ts")


@query(
    "q61_stream_dedup",
    "SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour FROM events GROUP BY 1, 2",
)
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = event_stream(spark, sf).select("user_id", F.date_trunc("hour", "ts").alias("hour"))
    out = S.run_available(S.unique_history(rows, ["user_id", "hour"], "hour", "2 days"), "dedup")
    return S.read_output(spark, out).select("user_id", Q.stamp("hour"))


@query(
    "q62_stream_hourly",
    """
WITH h AS (SELECT isodow(ts + INTERVAL 9 HOUR) - 1 AS day_no, hour(ts + INTERVAL 9 HOUR) AS hour, value FROM events)
SELECT day_no, hour, round(avg(value), 6) AS mean_value FROM h GROUP BY 1, 2""",
)
def stream_hourly(spark: SparkSession, sf: str) -> DataFrame:
    # update mode: windows that are still open are written too, closed ones leave the state by the watermark
    out = S.run_available(S.hourly_means(event_stream(spark, sf), "ts", "value", "1 day"), "hourly", "update", newest_of=["hour_start"])
    return S.heatmap_from_hours(S.latest_state(spark, out)).select("day_no", "hour", r6("mean_value"))


@query(
    "q63_stream_last_known",
    """
SELECT user_id, event_id, round(value, 6) AS value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, n_seen FROM (
  SELECT *, count(*) OVER (PARTITION BY user_id) AS n_seen, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def stream_last_known(spark: SparkSession, sf: str) -> DataFrame:
    state = S.last_known_state(event_stream(spark, sf), "user_id", ["ts", "event_id"], ["ts", "event_id", "value"])
    out = S.run_available(state, "lastknown", "update", newest_of=["user_id"])
    return S.latest_state(spark, out).select("user_id", "event_id", r6("value"), Q.stamp("ts"), "n_seen")


@query(
    "q67_omission_counters",
    """
WITH polls AS (SELECT u.user_id, d.day FROM (SELECT DISTINCT user_id FROM events) u, (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) d),
seen AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
last AS (SELECT user_id, max(day) AS last_seen FROM seen GROUP BY 1)
SELECT p.user_id, count(*) AS consecutive_misses, strftime(min(p.day), '%Y-%m-%d') AS first_missing, strftime(max(p.day), '%Y-%m-%d') AS last_missing
FROM polls p JOIN last l ON l.user_id = p.user_id WHERE p.day > last_seen GROUP BY 1""",
)
def omission_counters(spark: SparkSession, sf: str) -> DataFrame:
    from wardscope.plans.registry import table

    # the days of the table are the polls; the stream keeps the last sighting of each entity
    polls = table(spark, sf, "events").select(F.to_date("ts").alias("polled_at")).distinct()
    stream = event_stream(spark, sf).select("user_id", F.to_date("ts").alias("day"))
    out = S.run_available(S.last_seen(stream, "user_id", "day"), "misses", "update", newest_of=["user_id"])
    counted = S.misses_since(S.latest_state(spark, out), polls, "user_id")
    return counted.select(
        "user_id", "consecutive_misses", F.date_format("first_missing_at", "yyyy-MM-dd").alias("first_missing"), F.date_format("last_missing_at", "yyyy-MM-dd").alias("last_missing")
    )


KEPT_HOURS, KEPT_DAYS = 6, 9


@query(
    "q83_stream_expiry",
    f"""
WITH last AS (SELECT user_id, max(ts) AS ts, arg_max(struct_pack(event_id, value), struct_pack(ts, event_id)) AS row FROM events GROUP BY 1)
SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, row.event_id AS event_id, round(row.value, 6) AS value FROM last
WHERE date_trunc('millisecond', ts) + INTERVAL {KEPT_HOURS} HOUR > (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM events)""",
)
def stream_expiry(spark: SparkSession, sf: str) -> DataFrame:
    """Last rows of users heard of lately; the others leave the state as the watermark passes, over four batches."""
    rows = event_stream(spark, sf).select("user_id", "ts", "event_id", "value")
    out = S.run_available(S.expiring_state(rows, "user_id", "ts", KEPT_HOURS, "1 day"), "expiry", "update", newest_of=["user_id"])
    return S.latest_state(spark, out).select("user_id", Q.stamp("ts"), "event_id", r6("value"))


@query(
    "q84_stream_retention",
    f"""
SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events
WHERE CAST(ts AS DATE) >= (SELECT CAST(max(ts) AS DATE) FROM events) - {KEPT_DAYS}""",
)
def stream_retention(spark: SparkSession, sf: str) -> DataFrame:
    """History in a folder per day; four batches add rows and drop whole days that have become too old."""
    root = fresh_path(spark, "history")
    S.run_available(event_stream(spark, sf), "retention", shape=S.keep_days("ts", KEPT_DAYS, root))
    return spark.read.parquet(root).select("event_id", "user_id", Q.stamp("ts"))


#: The slice each event arrives in, as in ``event_stream``.
ARRIVAL_SQL = f"""
span AS (SELECT epoch(min(ts)) AS a, (epoch(max(ts)) - epoch(min(ts))) / {SLICES} AS w FROM events),
placed AS (SELECT e.*, w, (epoch(ts) - a) / w AS place FROM events e, span),
arrived AS (
  SELECT *, least(floor(place) + CASE WHEN event_id % 5 = 0 AND ((floor(place) + 1) - place) * w <= 43200 THEN 1 ELSE 0 END, {SLICES - 1})::INT AS run FROM placed)
"""


@query(
    "q85_stream_failed_regions",
    with_ctes(
        ARRIVAL_SQL,
        "good AS (SELECT * FROM arrived WHERE user_id % 5 <> (run * 2 + 1) % 5)",
        select="""
SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, run, n_seen FROM (
  SELECT *, count(*) OVER (PARTITION BY user_id) AS n_seen, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM good) WHERE rn = 1""",
    ),
)
def stream_failed_regions(spark: SparkSession, sf: str) -> DataFrame:
    """In every run one fifth of the users, a region, fails; its entities keep their last good rows."""
    stream = S.with_run(event_stream(spark, sf)).withColumn("region", (F.col("user_id") % 5).cast("int"))
    failed = spark.range(SLICES).select(F.col("id").cast("int").alias("run"), ((F.col("id") * 2 + 1) % 5).cast("int").alias("region"))
    state = S.keep_last_good(stream, failed, ["run", "region"], "user_id", ["ts", "event_id"], ["ts", "event_id", "run"])
    out = S.run_available(state, "lastgood", "update", newest_of=["user_id"])
    return S.latest_state(spark, out).select("user_id", "event_id", Q.stamp("ts"), "run", "n_seen")


@query(
    "q86_stream_deadline",
    with_ctes(
        ARRIVAL_SQL,
        f"last AS (SELECT r.run, user_id, max(ts) AS ts FROM (SELECT unnest(range({SLICES}))::INT AS run) r JOIN arrived a ON a.run <= r.run GROUP BY 1, 2)",
        select="SELECT run, strftime(min(ts) + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS deadline_at, count(*) AS n_entities FROM last GROUP BY 1",
    ),
)
def stream_deadline(spark: SparkSession, sf: str) -> DataFrame:
    """Earliest expiry after each of four runs; an entity's older rows stop counting when a newer one arrives."""
    state = S.last_known_state(event_stream(spark, sf), "user_id", ["ts", "event_id"], ["ts", "event_id"])
    out = S.run_available(state, "deadline", "update", newest_of=["user_id"])
    return S.deadline_per_batch(spark, out, "ts", 12.0).select("run", Q.stamp("deadline_at"), "n_entities")
