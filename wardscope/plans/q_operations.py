"""Population upkeep, resident sources, origin reuse and match-table checks over the driver tables.

Defects are seeded by rules on the keys of whole tables; the SQL names every row they hit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardscope.functions import fixed_values as V
from wardscope.operators import joins as J
from wardscope.operators import matching as M
from wardscope.operators import nearest as R
from wardscope.operators import population as P
from wardscope.operators import publication as PUB
from wardscope.plans import bindings as B
from wardscope.plans.registry import query, table, with_ctes

NOW = "1998-01-15T00:00:00Z"


def _now():
    return F.lit(NOW).cast("timestamp")


# every seventh customer is missing from the current list; every other of those was missing before
MISSING_SQL = """
previous AS (SELECT c_custkey AS k, entity_id, name, province, district FROM master JOIN customer ON entity_id = c_custkey::VARCHAR),
carried AS (
  SELECT entity_id, CASE WHEN k % 14 = 0 THEN TIMESTAMP '1998-01-10 00:00:00' + INTERVAL 1 HOUR * (k % 120) ELSE TIMESTAMP '1998-01-15 00:00:00' END AS first_missing,
    CASE WHEN k % 14 = 0 THEN k % 5 ELSE 0 END + 1 AS misses FROM previous WHERE k % 7 = 0)
"""


def lists(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(current, previous, audit state)."""
    k = F.col("entity_id").cast("bigint")
    previous = B.master(spark, sf).select("entity_id", "name", "province", "district")
    first = F.date_format(F.lit("1998-01-10 00:00:00").cast("timestamp") + F.make_dt_interval(hours=(k % 120).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    state = previous.filter(k % 14 == 0).select("entity_id", first.alias("first_missing_at"), (k % 5).alias("consecutive_misses"))
    return previous.filter(k % 7 != 0), previous, state


@query(
    "q72_carry_forward",
    with_ctes(
        B.PLACES_SQL, B.MASTER_SQL, MISSING_SQL,
        select="SELECT entity_id, strftime(first_missing, '%Y-%m-%d %H:%M:%S') AS first_missing_at, misses AS consecutive_misses FROM carried",
    ),
)
def carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.carry_forward(*lists(spark, sf), _now())
    return rows.select("entity_id", F.date_format("first_missing_at", "yyyy-MM-dd HH:mm:ss").alias("first_missing_at"), F.col("consecutive_misses").cast("bigint").alias("consecutive_misses"))


@query(
    "q73_population_violations",
    with_ctes(
        B.PLACES_SQL, B.MASTER_SQL, MISSING_SQL,
        select="""
SELECT 'added' AS "check", 'new-' || entity_id AS key FROM previous WHERE k % 50 = 1
UNION ALL SELECT 'previous_shape', NULL FROM (SELECT count(*) AS n FROM previous) WHERE n <> 7
UNION ALL SELECT 'too_many_missing', NULL FROM (SELECT count(*) AS n FROM carried) WHERE n > 3
UNION ALL SELECT 'population_size', NULL FROM (SELECT count(*) AS n FROM previous) WHERE n <> 7
UNION ALL SELECT 'too_many_misses', entity_id FROM carried WHERE misses > 3
UNION ALL SELECT 'missing_too_long', entity_id FROM carried WHERE TIMESTAMP '1998-01-15 00:00:00' > first_missing + INTERVAL 72 HOUR""",
    ),
)
def population_violations(spark: SparkSession, sf: str) -> DataFrame:
    current, previous, state = lists(spark, sf)
    carried = P.carry_forward(current, previous, state, _now())
    new = previous.filter(F.col("entity_id").cast("bigint") % 50 == 1).withColumn("entity_id", F.concat(F.lit("new-"), "entity_id"))
    return P.population_violations(current.unionByName(new), previous, carried, _now(), 7, 25).select("check", "key")


@query(
    "q74_registry_residents",
    with_ctes(
        B.PLACES_SQL,
        # code 0 is the region itself and has three zeros; every ninth nation has no line
        "r AS (SELECT n_nationkey, count(*) * 1000 + n_nationkey AS population FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)",
        select=f"""
SELECT province, district, CASE WHEN p.n_nationkey % 9 <> 8 THEN population::DOUBLE END AS population,
  CASE WHEN p.n_nationkey % 9 <> 8 THEN lpad((p.n_nationkey + 10)::VARCHAR, 2, '0') || '111' END AS admin_code, '202607' AS period, '{V.REGISTRY_SOURCE}' AS source
FROM places p JOIN r ON r.n_nationkey = p.n_nationkey""",
    ),
)
def registry_residents(spark: SparkSession, sf: str) -> DataFrame:
    p, c = B.places(spark, sf), table(spark, sf, "customer")
    per = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    k = F.col("n_nationkey")
    people = F.format_number(F.coalesce("n", F.lit(0)) * 1000 + k, 0)  # thousands separators, as in the file
    lines = p.join(per, k == F.col("c_nationkey"), "left").filter(k % 9 != 8)
    code = F.lpad((k + 10).cast("string"), 2, "0")
    name = F.concat_ws(" ", "province", "district")
    district = lines.select(F.concat(name, F.lit("  ("), code, F.lit("11100000)")).alias("행정구역"), people.alias("p"))
    area = lines.select(F.concat(name, F.lit(" ("), code, F.lit("00000000)")).alias("행정구역"), F.lit("1").alias("p"))  # the same text with the code of the upper area
    raw = district.unionByName(area).withColumnRenamed("p", f"2026년07월{V.REGISTRY_COLUMN_SUFFIX}")
    return P.residents_from_registry(raw, p.select("province", "district"), "202607")


@query(
    "q75_origin_reuse",
    f"""
SELECT c_custkey AS region_key, c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 60 BETWEEN 0 AND {V.ROUTE_TTL_DAYS} AS reusable FROM customer""",
)
def origin_reuse(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("region_key")
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("region_key"), B.spread_lat(F.col("c_custkey")).alias("lat"), B.spread_lon(F.col("c_custkey")).alias("lon"))
    keyed = base.withColumn("origin_key", R.origin_key(k.cast("string"), F.col("lat"), F.col("lon"), F.lit("m"), F.lit("1")))
    stamp = F.date_format(_now() - F.make_dt_interval(days=(k % 60).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    # every fifth key was made with another version, every seventh probe failed, every third region was never probed
    other = R.origin_key(k.cast("string"), F.col("lat"), F.col("lon"), F.lit("m"), F.lit("0"))
    cached = keyed.filter(k % 3 != 0).select(
        "region_key", F.when(k % 5 == 0, other).otherwise(F.col("origin_key")).alias("origin_key"),
        F.when(k % 7 == 0, "경로오류:1").otherwise(V.ROUTE_OK).alias("probe_status"), stamp.alias("collected_ts"),
    )
    return R.reusable_origins(keyed, cached, _now()).select("region_key", "reusable")


DETAIL_SQL = f"""
detail AS (
  SELECT c_custkey AS k, c_custkey::VARCHAR AS entity_id, CASE WHEN c_custkey % 6 < 4 THEN 'id' || (c_custkey - CASE WHEN c_custkey % 60 = 3 THEN 1 ELSE 0 END) END AS catalog_id,
    CASE c_custkey % 6 WHEN 0 THEN '{V.STATE_MANUAL}' WHEN 4 THEN '{V.STATE_LOW}' WHEN 5 THEN CASE WHEN c_custkey % 90 = 5 THEN 'odd' ELSE '{V.STATE_EXCLUDED}' END ELSE '{V.STATE_AUTOMATIC}' END AS match_state,
    CASE WHEN c_custkey % 6 < 4 THEN CASE WHEN c_custkey % 75 = 1 THEN 1.5 ELSE (c_custkey % 4)::DOUBLE END END AS specialists FROM customer),
matched AS (SELECT * FROM detail WHERE match_state IN ('{V.STATE_MANUAL}', '{V.STATE_AUTOMATIC}'))
"""


def detail(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    turn = k % 6
    state = F.when(turn == 0, V.STATE_MANUAL).when(turn == 4, V.STATE_LOW).when((turn == 5) & (k % 90 == 5), "odd").when(turn == 5, V.STATE_EXCLUDED).otherwise(V.STATE_AUTOMATIC)
    return table(spark, sf, "customer").select(
        k.cast("string").alias("entity_id"),
        F.when(turn < 4, F.concat(F.lit("id"), (k - F.when(k % 60 == 3, 1).otherwise(0)).cast("string"))).alias("catalog_id"), state.alias("match_state"),
        F.when(turn < 4, F.when(k % 75 == 1, 1.5).otherwise((k % 4).cast("double"))).alias("specialists"), "c_nationkey",
    )


@query(
    "q76_match_checks",
    with_ctes(
        DETAIL_SQL,
        select=f"""
SELECT 'match_catalog_id' AS "check", catalog_id AS key FROM detail WHERE catalog_id IS NOT NULL GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'match_uses_excluded_id', catalog_id FROM detail WHERE k % 100 = 2 AND catalog_id IS NOT NULL
UNION ALL SELECT 'match_state', entity_id FROM detail WHERE match_state = 'odd'
UNION ALL SELECT 'match_excluded_set', entity_id FROM detail WHERE (match_state = '{V.STATE_EXCLUDED}') <> (k % 6 = 5 OR (k % 100 = 2 AND catalog_id IS NOT NULL))
UNION ALL SELECT 'match_values', entity_id FROM matched WHERE specialists <> floor(specialists)
UNION ALL SELECT 'match_floor', 'count' FROM (SELECT count(*) AS n FROM matched) WHERE n < 1000000000""",
    ),
)
def match_checks(spark: SparkSession, sf: str) -> DataFrame:
    rows = detail(spark, sf)
    k = F.col("entity_id").cast("bigint")
    out = rows.filter((k % 6 == 5) | ((k % 100 == 2) & F.col("catalog_id").isNotNull())).select("entity_id", "catalog_id")
    return M.match_violations(rows, rows, out, 1_000_000_000).select("check", "key")


@query(
    "q77_match_manifest",
    with_ctes(
        DETAIL_SQL,
        f"per AS (SELECT c_nationkey, count(*) FILTER (match_state IN ('{V.STATE_MANUAL}', '{V.STATE_AUTOMATIC}')) AS m FROM detail JOIN customer ON c_custkey = k GROUP BY 1)",
        select=f"""
SELECT count(*) FILTER (match_state IN ('{V.STATE_MANUAL}', '{V.STATE_AUTOMATIC}')) AS matched, count(*) FILTER (match_state = '{V.STATE_AUTOMATIC}') AS automatic, count(*) FILTER (match_state = '{V.STATE_MANUAL}') AS manual,
  count(*) FILTER (match_state NOT IN ('{V.STATE_MANUAL}', '{V.STATE_AUTOMATIC}')) AS deferred, count(*) FILTER (match_state IN ('{V.STATE_LOW}', 'odd')) AS algorithmic_deferred,
  count(*) FILTER (match_state = '{V.STATE_EXCLUDED}') AS excluded, sum(specialists) AS specialist_total, (SELECT count(*) FROM per) AS regional_rows, (SELECT count(*) FROM per WHERE m % 2 = 0) AS usable_regions FROM detail""",
    ),
)
def match_manifest(spark: SparkSession, sf: str) -> DataFrame:
    rows = detail(spark, sf)
    matched = F.count_if(F.col("match_state").isin(V.MATCHED_STATES))
    staffing = rows.groupBy("c_nationkey").agg(F.when(matched % 2 == 0, V.QUALITY_OK).otherwise("x").alias("quality"))
    return M.match_manifest(rows, staffing)


@query(
    "q78_rebuild_identity",
    """
SELECT s_suppkey::VARCHAR AS key, concat_ws(',', CASE WHEN s_suppkey % 11 = 0 THEN 'name' END, CASE WHEN s_suppkey % 13 = 0 THEN 'lat' END) AS detail FROM supplier WHERE (s_suppkey % 11 = 0 OR s_suppkey % 13 = 0) AND s_suppkey % 17 <> 0
UNION ALL SELECT s_suppkey::VARCHAR, 'not_stored' FROM supplier WHERE s_suppkey % 17 = 0""",
)
def rebuild_identity(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    master = table(spark, sf, "supplier").select(k.cast("string").alias("entity_id"), F.col("s_name").alias("name"), B.spread_lat(k).alias("lat"), B.spread_lon(k).alias("lon"), "s_suppkey")
    stored = master.filter(k % 17 != 0).withColumn("name", F.when(k % 11 == 0, "old").otherwise(F.col("name"))).withColumn(
        "lat", F.col("lat") + F.when(k % 13 == 0, 1e-6).otherwise(1e-12)
    )
    return M.rebuild_violations(stored, master).select("key", "detail")


@query(
    "q79_eligible_facilities",
    with_ctes(B.PLACES_SQL, B.MASTER_SQL, select="SELECT entity_id, grade FROM master WHERE regexp_matches(grade, 'BUILD|^MACHINERY$')"),
)
def eligible_facilities(spark: SparkSession, sf: str) -> DataFrame:
    return R.eligible_facilities(B.master(spark, sf), pattern="BUILD|^MACHINERY$").select("entity_id", "grade")


@query(
    "q80_route_lookup",
    """
WITH cache AS (SELECT o_custkey, max(o_orderdate) AS t, max_by(o_totalprice, (o_orderdate, o_totalprice)) AS road FROM orders
  WHERE o_orderstatus = 'F' AND o_orderdate <= TIMESTAMP '1998-01-15 00:00:00' AND o_orderdate >= TIMESTAMP '1998-01-15 00:00:00' - INTERVAL 900 DAY GROUP BY 1)
SELECT o_orderkey, 'r' || o.o_custkey AS route_key, round(road, 6) AS road_km, CASE WHEN road IS NOT NULL THEN '성공' END AS route_status
FROM orders o LEFT JOIN cache c ON c.o_custkey = o.o_custkey""",
)
def route_lookup(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("route_key")
    orders = table(spark, sf, "orders")
    stored = orders.select(
        key, F.col("o_totalprice").alias("road_km"), F.lit(1.0).alias("eta_min"), F.lit(0).alias("route_code"),
        F.when(F.col("o_orderstatus") == "F", V.ROUTE_OK).otherwise("경로오류:1").alias("route_status"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("collected_ts"),
    )
    cache = R.reusable_routes([stored], _now(), 900)
    return R.attach_results(orders.select("o_orderkey", key), cache).select("o_orderkey", "route_key", F.round("road_km", 6).alias("road_km"), "route_status")


@query(
    "q81_one_to_one_join",
    """
SELECT 'orders:left' AS "check", o_custkey::VARCHAR AS key, count(*)::VARCHAR AS detail FROM orders GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'orders:right', c_nationkey::VARCHAR, count(*)::VARCHAR FROM customer GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'joined', NULL, count(*)::VARCHAR FROM orders o LEFT JOIN customer c ON o_custkey = c_nationkey""",
)
def one_to_one_join(spark: SparkSession, sf: str) -> DataFrame:
    """A join on the wrong column: both sides repeat the key, and the contract says so."""
    left = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("bigint").alias("key"))
    right = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("key"))
    joined, violations = J.one_to_one(left, right, ["key"], check="orders")
    total = joined.agg(F.count(F.lit(1)).cast("string").alias("detail")).select(F.lit("joined").alias("check"), F.lit(None).cast("string").alias("key"), "detail")
    return violations.select("check", "key", "detail").unionByName(total)


# seeded: every 20th latitude outside the country, every 30th probe failed, every 40th key cut, every 50th an average of facilities
@query(
    "q82_origin_contract",
    """
SELECT 'origin_base_lat' AS "check", c_custkey::VARCHAR AS key, NULL::VARCHAR AS side FROM customer WHERE c_custkey % 20 = 0
UNION ALL SELECT 'origin_probe', c_custkey::VARCHAR, NULL FROM customer WHERE c_custkey % 30 = 1
UNION ALL SELECT 'origin_key', c_custkey::VARCHAR, NULL FROM customer WHERE c_custkey % 40 = 2
UNION ALL SELECT 'origin_method', c_custkey::VARCHAR, NULL FROM customer WHERE c_custkey % 50 = 3
UNION ALL SELECT 'origin_version', c_custkey::VARCHAR, NULL FROM customer WHERE c_custkey % 60 = 4
UNION ALL SELECT 'origin_adjustment', c_custkey::VARCHAR, NULL FROM customer WHERE c_custkey % 70 = 5
UNION ALL SELECT 'origin_population', 'x' || c_custkey, 'only_left' FROM customer WHERE c_custkey % 80 = 6
UNION ALL SELECT 'origin_population', c_custkey::VARCHAR, 'only_right' FROM customer WHERE c_custkey % 80 = 6""",
)
def origin_contract(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    region = F.when(k % 80 == 6, F.concat(F.lit("x"), k.cast("string"))).otherwise(k.cast("string"))
    lat, lon = B.spread_lat(k), B.spread_lon(k)
    digest = R.origin_key(k.cast("string"), lat, lon, F.lit("m"), F.lit("1"))
    origins = table(spark, sf, "customer").select(
        region.alias("region_key"), F.when(k % 20 == 0, 10.0).otherwise(lat).alias("base_lat"), lon.alias("base_lon"), lat.alias("origin_lat"), lon.alias("origin_lon"),
        F.when(k % 70 == 5, -1.0).otherwise(0.0).alias("adjust_km"), F.when(k % 30 == 1, "경로오류:1").otherwise(V.ROUTE_OK).alias("probe_status"),
        F.when(k % 60 == 4, "0").otherwise("1").alias("boundary_version"), F.when(k % 50 == 3, V.WEAK_ORIGIN_METHOD).otherwise("m").alias("method"),
        F.when(k % 40 == 2, F.substring(digest, 1, 40)).otherwise(digest).alias("origin_key"),
    )
    master = table(spark, sf, "customer").select(k.cast("string").alias("region_key"))
    # a region under a wrong name is missing on one side and unknown on the other
    found = PUB.origin_contract(origins, master, "1")
    return found.select("check", "key", F.when(F.col("check") == "origin_population", F.col("detail")).alias("side"))
