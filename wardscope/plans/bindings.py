"""The driver tables seen as facilities, feeds, regions and catalogues.

Customers play the facilities, nations their districts, regions the provinces;
events are the polled feed.  Every rule below is a plain expression over whole
tables, and each has its SQL twin (``*_SQL``) for the side-by-side check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardscope.functions.scalars import load_status, region_key, saturation, usable
from wardscope.operators.score import composite_risk, percentile_score, population_component, staff_component
from wardscope.plans.registry import table
from wardscope.session import cut_lineage

# ----------------------------------------------------------------- facilities
PLACES_SQL = """
places AS (
  SELECT n_nationkey, r_name AS province, n_name AS district, r_name || '|' || n_name AS region_key
  FROM nation JOIN region ON n_regionkey = r_regionkey)
"""


def places(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        "n_nationkey", F.col("r_name").alias("province"), F.col("n_name").alias("district"),
        region_key(F.col("r_name"), F.col("n_name")).alias("region_key"),
    )


MASTER_SQL = """
master AS (
  SELECT CAST(c_custkey AS VARCHAR) AS entity_id, c_name AS name, c_mktsegment AS grade, province, district, region_key
  FROM customer JOIN places ON c_nationkey = n_nationkey)
"""


def master(spark: SparkSession, sf: str) -> DataFrame:
    c, p = table(spark, sf, "customer"), places(spark, sf)
    return c.join(p, c.c_nationkey == p.n_nationkey).select(
        F.col("c_custkey").cast("string").alias("entity_id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("grade"), "province", "district", "region_key",
    )


# capacity from the key, availability from the balance (negative balances are invalid readings)
BEDS_SQL = """
beds AS (
  SELECT entity_id, name, grade, province, district, region_key, available, total,
    CASE WHEN total > 0 AND available >= 0
         THEN least(greatest((total - available) / total * 100, 0), 100) END AS saturation
  FROM (SELECT CAST(c_custkey AS VARCHAR) AS entity_id, c_name AS name, c_mktsegment AS grade, province, district, region_key,
          floor(c_acctbal / 250) AS available, CAST((c_custkey * 7) % 40 AS DOUBLE) AS total
        FROM customer JOIN places ON c_nationkey = n_nationkey))
"""


def beds(spark: SparkSession, sf: str) -> DataFrame:
    c, p = table(spark, sf, "customer"), places(spark, sf)
    a, t = F.col("available"), F.col("total")
    rows = c.join(p, c.c_nationkey == p.n_nationkey).select(
        F.col("c_custkey").cast("string").alias("entity_id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("grade"), "province", "district", "region_key",
        F.floor(F.col("c_acctbal") / 250).cast("double").alias("available"),
        ((F.col("c_custkey") * 7) % 40).cast("double").alias("total"),
    )
    return rows.withColumn("saturation", F.when(usable(a, t), saturation(a, t))).withColumn(
        "status", load_status(F.col("saturation"))
    )


# ------------------------------------------------------------------ components
COMPONENTS_SQL = PLACES_SQL + "," + BEDS_SQL + """,
load_c AS (
  SELECT region_key, min(district) AS district, avg(saturation) AS s_load, count(saturation) AS n_reporting
  FROM beds GROUP BY region_key),
order_facts AS (
  SELECT region_key, avg(CASE WHEN n_nationkey % 8 <> 5 THEN o_totalprice / 10000 END) AS road_km, CAST(count(*) AS DOUBLE) AS population
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = n_nationkey GROUP BY region_key),
access_q AS (SELECT quantile_cont(road_km, 0.05) AS lo, quantile_cont(road_km, 0.95) AS hi FROM order_facts),
access_c AS (
  SELECT region_key, road_km,
    CASE WHEN hi <= lo THEN 50::DOUBLE WHEN road_km IS NULL THEN NULL
         ELSE (least(greatest(road_km, lo), hi) - lo) / (hi - lo) * 100 END AS s_access
  FROM order_facts, access_q),
totals AS (SELECT region_key, sum(total) AS total_beds FROM beds WHERE saturation IS NOT NULL GROUP BY region_key),
pop_r AS (
  SELECT region_key, population, total_beds, population / nullif(total_beds, 0) AS residents_per_bed
  FROM order_facts LEFT JOIN totals USING (region_key)),
pop_q AS (SELECT quantile_cont(residents_per_bed, 0.05) AS lo, quantile_cont(residents_per_bed, 0.95) AS hi FROM pop_r),
pop_c AS (
  SELECT region_key, population, total_beds, residents_per_bed,
    CASE WHEN hi <= lo THEN 50::DOUBLE WHEN residents_per_bed IS NULL THEN NULL
         ELSE (least(greatest(residents_per_bed, lo), hi) - lo) / (hi - lo) * 100 END AS s_pop
  FROM pop_r, pop_q),
staff_n AS (
  SELECT region_key, sum(CASE WHEN s_suppkey IS NULL THEN NULL WHEN s_acctbal > 7000 THEN 1::DOUBLE ELSE 0::DOUBLE END) AS specialists
  FROM places LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY region_key),
staff_r AS (
  SELECT region_key, specialists, total_beds, total_beds / nullif(specialists, 0) AS beds_per_specialist
  FROM staff_n LEFT JOIN totals USING (region_key)),
staff_q AS (SELECT quantile_cont(beds_per_specialist, 0.05) AS lo, quantile_cont(beds_per_specialist, 0.95) AS hi FROM staff_r),
staff_c AS (
  SELECT region_key, specialists, total_beds, beds_per_specialist,
    CASE WHEN specialists = 0 THEN 100::DOUBLE WHEN hi <= lo THEN 50::DOUBLE WHEN beds_per_specialist IS NULL THEN NULL
         ELSE (least(greatest(beds_per_specialist, lo), hi) - lo) / (hi - lo) * 100 END AS s_staff
  FROM staff_r, staff_q)
"""

RISK_SQL = COMPONENTS_SQL + """,
scores AS (
  SELECT coalesce(l.region_key, a.region_key) AS region_key, district, s_load, coalesce(n_reporting, 0) AS n_reporting,
    s_access, s_pop, s_staff
  FROM load_c l FULL JOIN access_c a ON l.region_key = a.region_key
  LEFT JOIN pop_c p ON p.region_key = coalesce(l.region_key, a.region_key)
  LEFT JOIN staff_c s ON s.region_key = coalesce(l.region_key, a.region_key)),
weighted AS (
  SELECT *,
    (s_load IS NOT NULL)::INT + (s_access IS NOT NULL)::INT + (s_pop IS NOT NULL)::INT + (s_staff IS NOT NULL)::INT AS n_components,
    0.35::DOUBLE * s_load + 0.30::DOUBLE * s_access + 0.20::DOUBLE * s_pop + 0.15::DOUBLE * s_staff AS risk
  FROM scores),
risks AS (
  SELECT *,
    CASE WHEN risk IS NULL THEN NULL WHEN risk <= 20 THEN 1 WHEN risk <= 35 THEN 2 WHEN risk <= 50 THEN 3 WHEN risk <= 65 THEN 4 ELSE 5 END AS risk_grade,
    CASE WHEN risk IS NULL THEN NULL WHEN risk <= 20 THEN '매우낮음' WHEN risk <= 35 THEN '낮음' WHEN risk <= 50 THEN '보통' WHEN risk <= 65 THEN '높음' ELSE '매우높음' END AS risk_grade_name,
    CASE WHEN n_components = 4 THEN '완료' ELSE '원천데이터부족' END AS calc_state
  FROM weighted)
"""


def order_facts(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    # orders are summed per customer before they meet the dimension tables
    per_customer = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("price"), F.count(F.lit(1)).alias("n"))
    open_route = F.when(F.col("n_nationkey") % 8 != 5, True)
    return (
        per_customer.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey").agg(F.sum("price").alias("price"), F.sum("n").alias("n"))
        .join(places(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "region_key",
            F.when(open_route, F.col("price") / F.col("n") / 10000).alias("road_km"),
            F.col("n").cast("double").alias("population"),
        )
    )


def staff_counts(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    per_nation = s.groupBy("s_nationkey").agg(F.sum(F.when(F.col("s_acctbal") > 7000, 1.0).otherwise(0.0)).alias("specialists"))
    p = places(spark, sf)
    return p.join(per_nation, p.n_nationkey == per_nation.s_nationkey, "left").select("region_key", "specialists")


def region_facts(spark: SparkSession, sf: str) -> DataFrame:
    """All raw measures, one row per region, written once for their several readers."""
    load = beds(spark, sf).groupBy("region_key").agg(
        F.min("district").alias("district"), F.avg("saturation").alias("s_load"), F.count("saturation").alias("n_reporting"),
        F.sum(F.when(F.col("saturation").isNotNull(), F.col("total"))).alias("total_beds"),
    )
    facts = order_facts(spark, sf).withColumn("has_orders", F.lit(True))
    return cut_lineage(staff_counts(spark, sf).join(load, "region_key", "left").join(facts, "region_key", "left"))


def components(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The four component tables, computed from region-level rows only."""
    facts = region_facts(spark, sf)
    totals = facts.filter("total_beds is not null").select("region_key", "total_beds")
    served = facts.filter("has_orders")
    return {
        "load": facts.filter("district is not null").select("region_key", "district", "s_load", "n_reporting"),
        "access": percentile_score(served.select("region_key", "road_km"), "road_km", "s_access"),
        "population": population_component(served.select("region_key", "population"), totals),
        "staff": staff_component(facts.select("region_key", "specialists"), totals),
    }


def region_risk(spark: SparkSession, sf: str, readers: int = 2) -> DataFrame:
    """Composite risk, one row per region; written once if it has more than one reader."""
    c = components(spark, sf)
    risk = composite_risk(c["load"], c["access"], c["population"], c["staff"])
    risk = risk.withColumn("n_reporting", F.coalesce("n_reporting", F.lit(0).cast("bigint")))
    return cut_lineage(risk) if readers > 1 else risk


# ------------------------------------------------------------------------ feed
NOW = "2024-01-20 12:00:00"
FEED_START = "2024-01-20 04:00:00"

FEED_SQL = f"""
feed_all AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS entity_id, ts, value - 5 AS available,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS total,
    strftime(ts + INTERVAL 9 HOUR, '%Y%m%d%H%M%S') AS source_ts, date_trunc('second', ts) AS source_at,
    date_trunc('second', ts) + INTERVAL 2 MINUTE AS collected_at
  FROM events),
feed_new AS (SELECT * FROM feed_all WHERE ts >= TIMESTAMP '{FEED_START}' AND ts <= TIMESTAMP '{NOW}'),
feed_old AS (SELECT * FROM feed_all WHERE ts < TIMESTAMP '{FEED_START}')
"""


def feed_all(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    local = F.col("ts") + F.expr("INTERVAL 9 HOURS")
    second = F.date_trunc("second", F.col("ts").cast("timestamp"))
    return e.select(
        "event_id", F.col("user_id").cast("string").alias("entity_id"), F.col("ts").cast("timestamp").alias("ts"),
        (F.col("value") - 5).alias("available"), F.get_json_object("props", "$.k").try_cast("double").alias("total"),
        F.date_format(local, "yyyyMMddHHmmss").alias("source_ts"),
        (second + F.expr("INTERVAL 2 MINUTES")).alias("collected_ts"),
    )


def feed_new(spark: SparkSession, sf: str) -> DataFrame:
    return feed_all(spark, sf).filter((F.col("ts") >= FEED_START) & (F.col("ts") <= NOW))


def feed_old(spark: SparkSession, sf: str) -> DataFrame:
    return feed_all(spark, sf).filter(F.col("ts") < FEED_START)


# regions whose call failed in this round
FAILED_SQL = "failed AS (SELECT DISTINCT province, district FROM places WHERE n_nationkey % 7 = 0)"


def failed_regions(spark: SparkSession, sf: str) -> DataFrame:
    return places(spark, sf).filter(F.col("n_nationkey") % 7 == 0).select("province", "district")


# ----------------------------------------------------------------- coordinates
def spread_lat(key):
    return F.lit(33.0) + ((key * 7919) % 6000) / 1000.0


def spread_lon(key):
    return F.lit(124.0) + ((key * 104729) % 8000) / 1000.0


def lat_sql(key: str) -> str:
    return f"(33.0::DOUBLE + (({key} * 7919) % 6000)::DOUBLE / 1000.0::DOUBLE)"


def lon_sql(key: str) -> str:
    return f"(124.0::DOUBLE + (({key} * 104729) % 8000)::DOUBLE / 1000.0::DOUBLE)"


def haversine_sql(a: str, b: str, c: str, d: str, radius: str = "6371.0") -> str:
    raw = (
        f"pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c}))"
        f" * pow(sin((radians({d}) - radians({b})) / 2), 2)"
    )
    return f"{radius}::DOUBLE * 2 * asin(sqrt(least(greatest({raw}, 0), 1)))"
