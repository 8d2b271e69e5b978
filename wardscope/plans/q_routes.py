"""Route and geometry queries: customers look for suppliers on synthetic coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardscope.functions import fixed_values as V
from wardscope.operators import contract as C
from wardscope.operators import nearest as R
from wardscope.operators import polygons as P
from wardscope.plans import bindings as B
from wardscope.plans.registry import query, r6, table, with_ctes
from wardscope.session import cut_lineage

POINTS_SQL = f"""
o AS (SELECT c_custkey AS region_key, {B.lat_sql('(c_custkey * 3 + 11)')} AS la, {B.lon_sql('(c_custkey * 5 + 7)')} AS lo FROM customer),
f AS (SELECT s_suppkey AS entity_id, {B.lat_sql('s_suppkey')} AS fa, {B.lon_sql('s_suppkey')} AS fo FROM supplier),
pairs AS (SELECT region_key, entity_id, {B.haversine_sql('la', 'lo', 'fa', 'fo')} AS km FROM o, f),
ranked AS (SELECT *, row_number() OVER (PARTITION BY region_key ORDER BY km, entity_id) AS rank FROM pairs)
"""


def origins(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("region_key"), B.spread_lat(k * 3 + 11).alias("origin_lat"), B.spread_lon(k * 5 + 7).alias("origin_lon")
    )


def facilities(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("entity_id"), B.spread_lat(k).alias("dest_lat"), B.spread_lon(k).alias("dest_lon"))


@query(
    "q40_haversine_candidates",
    with_ctes(POINTS_SQL, select="SELECT region_key, entity_id, rank, round(km, 6) AS straight_km FROM ranked WHERE rank <= 10"),
)
def haversine_candidates(spark: SparkSession, sf: str) -> DataFrame:
    near = R.nearest_candidates(origins(spark, sf), facilities(spark, sf), 10)
    return near.select("region_key", "entity_id", "rank", r6("straight_km"))


# a road is the straight line times a detour factor; one pair in nine has no road, one in fourteen failed
ROADS_SQL = """
roads AS (
  SELECT *, CASE WHEN (region_key + entity_id) % 9 = 0 THEN '경로오류:102' WHEN (region_key + 2 * entity_id) % 14 = 0 THEN '경로오류:9' ELSE '성공' END AS st,
    km * (1 + ((region_key * 7 + entity_id * 3) % 11)::DOUBLE / 10) AS road FROM ranked),
run AS (
  SELECT *, min(CASE WHEN st = '성공' THEN road END) OVER (PARTITION BY region_key ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bar FROM roads),
ev AS (SELECT * FROM run WHERE rank <= 10 OR bar IS NULL OR km < bar),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region_key ORDER BY road, rank) AS rn FROM roads WHERE st = '성공') WHERE rn = 1)
"""


def with_roads(df: DataFrame) -> DataFrame:
    o, f = F.col("region_key"), F.col("entity_id")
    status = F.when((o + f) % 9 == 0, "경로오류:102").when((o + 2 * f) % 14 == 0, "경로오류:9").otherwise(V.ROUTE_OK)
    road = F.col("straight_km") * (1 + ((o * 7 + f * 3) % 11).cast("double") / 10)
    rows = df.withColumn("route_status", status).withColumn("route_code", F.when((o + f) % 9 == 0, 102).when((o + 2 * f) % 14 == 0, 9).otherwise(0))
    ok = F.col("route_status") == V.ROUTE_OK
    return rows.withColumn("road_km", F.when(ok, road)).withColumn("eta_min", F.when(ok, road * 1.5))


def evaluated(spark: SparkSession, sf: str) -> DataFrame:
    return R.evaluated_candidates(origins(spark, sf), facilities(spark, sf), with_roads)


@query(
    "q41_prefix_pruned_nearest",
    with_ctes(
        POINTS_SQL, ROADS_SQL,
        select="""
SELECT b.region_key, b.entity_id, b.rank, round(b.km, 6) AS straight_km, round(b.road, 6) AS road_km, n AS n_evaluated
FROM best b JOIN (SELECT region_key, count(*) AS n FROM ev GROUP BY 1) e ON e.region_key = b.region_key""",
    ),
)
def prefix_pruned_nearest(spark: SparkSession, sf: str) -> DataFrame:
    rows = cut_lineage(evaluated(spark, sf))
    n = rows.groupBy("region_key").agg(F.count(F.lit(1)).alias("n_evaluated"))
    return R.best_by_road(rows).join(n, "region_key").select("region_key", "entity_id", "rank", r6("straight_km"), r6("road_km"), "n_evaluated")


@query(
    "q42_optimality_proof",
    with_ctes(
        POINTS_SQL, ROADS_SQL,
        "kept AS (SELECT * FROM ev WHERE (region_key + entity_id) % 7 <> 0)",
        "kb AS (SELECT region_key, min(CASE WHEN st = '성공' THEN road END) AS best FROM kept GROUP BY 1)",
        select="""
SELECT 'no_road' AS "check", region_key::VARCHAR AS key, NULL AS detail FROM kb WHERE best IS NULL
UNION ALL SELECT 'uncertain_failure', k.region_key::VARCHAR, entity_id::VARCHAR FROM kept k JOIN kb USING (region_key) WHERE st = '경로오류:9' AND km < best
UNION ALL SELECT 'not_evaluated', r.region_key::VARCHAR, entity_id::VARCHAR FROM ranked r JOIN kb USING (region_key)
  WHERE km < best AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.region_key = r.region_key AND k.entity_id = r.entity_id)""",
    ),
)
def optimality_proof(spark: SparkSession, sf: str) -> DataFrame:
    # a search that lost every seventh pair: the proof must name what is missing
    kept = cut_lineage(evaluated(spark, sf).filter((F.col("region_key") + F.col("entity_id")) % 7 != 0))
    return R.proof_violations(kept, facilities(spark, sf), origins(spark, sf))


CACHE_SQL = """
tasks AS (
  SELECT o_orderkey, sha256('kakao-directions-v1-distance|' || printf('%.7f,%.7f', c.lo, c.la) || '|' || printf('%.7f,%.7f', s.fo, s.fa)) AS route_key,
    date_diff('day', o_orderdate, TIMESTAMP '1998-01-15 00:00:00') AS age, o_orderdate, o_totalprice, o_orderstatus
  FROM orders JOIN o c ON c.region_key = o_custkey JOIN f s ON s.entity_id = o_custkey % (SELECT count(*) FROM supplier)),
good AS (SELECT * FROM tasks WHERE o_orderstatus = 'F' AND o_orderdate <= TIMESTAMP '1998-01-15 00:00:00' AND o_orderdate >= TIMESTAMP '1997-12-16 00:00:00'),
cache AS (SELECT route_key, max(o_orderdate) AS c FROM good GROUP BY 1)
"""


@query(
    "q43_route_cache_pending",
    with_ctes(
        POINTS_SQL, CACHE_SQL,
        select="""
SELECT 'reuse' AS kind, route_key, strftime(c, '%Y-%m-%d') AS day FROM cache
UNION ALL SELECT 'pending', route_key, NULL FROM (SELECT DISTINCT route_key FROM tasks) WHERE route_key NOT IN (SELECT route_key FROM cache)""",
    ),
)
def route_cache_pending(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "supplier").count()
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    o = origins(spark, sf).withColumnRenamed("region_key", "o_custkey")
    # the distinct origin-destination pairs get their key once, before the orders join them
    keyed = o.withColumn("entity_id", F.col("o_custkey") % n).join(facilities(spark, sf), "entity_id").select(
        "o_custkey", R.route_key(F.col("origin_lat"), F.col("origin_lon"), F.col("dest_lat"), F.col("dest_lon")).alias("route_key")
    )
    tasks = orders.join(keyed, "o_custkey").select(
        "route_key", F.col("o_totalprice").alias("road_km"), F.col("o_totalprice").alias("eta_min"), F.lit(0).alias("route_code"),
        F.when(F.col("o_orderstatus") == "F", V.ROUTE_OK).otherwise("경로오류:1").alias("route_status"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("collected_ts"),
    )
    now = F.lit("1998-01-15T00:00:00Z").cast("timestamp")
    cache = R.reusable_routes([tasks], now)
    return cache.select(F.lit("reuse").alias("kind"), "route_key", F.substring("collected_ts", 1, 10).alias("day")).unionByName(
        R.pending_routes(tasks, cache).select(F.lit("pending").alias("kind"), "route_key", F.lit(None).cast("string").alias("day"))
    )


def ring(points: list[tuple]):
    return F.array(*[F.struct(F.lit(x).cast("double").alias("x") if not hasattr(x, "alias") else x.alias("x"), y.alias("y")) for x, y in points])


def land(spark: SparkSession, sf: str) -> DataFrame:
    """A five-sided outline with a square hole around each supplier."""
    k = F.col("s_suppkey")
    x, y, s = B.spread_lon(k), B.spread_lat(k), 0.05 + (k % 7) / 100.0
    outer = ring([(x - s, y - s), (x + s, y - s), (x + s * 1.5, y), (x + s, y + s), (x - s, y + s)])
    hole = ring([(x - s / 4, y - s / 4), (x, y - s / 4), (x, y), (x - s / 4, y)])
    return table(spark, sf, "supplier").select(k.alias("polygon_id"), F.array(outer, hole).alias("rings"))


# SQL twin: edges of both rings as rows
LAND_SQL = f"""
base AS (SELECT s_suppkey AS polygon_id, {B.lon_sql('s_suppkey')} AS x, {B.lat_sql('s_suppkey')} AS y, 0.05::DOUBLE + (s_suppkey % 7)::DOUBLE / 100 AS s FROM supplier),
pts AS (
  SELECT polygon_id, 0 AS r, 5 AS n, unnest([0, 1, 2, 3, 4]) AS i, unnest([x - s, x + s, x + s * 1.5::DOUBLE, x + s, x - s]) AS px, unnest([y - s, y - s, y, y + s, y + s]) AS py FROM base
  UNION ALL SELECT polygon_id, 1, 4, unnest([0, 1, 2, 3]), unnest([x - s / 4, x, x, x - s / 4]), unnest([y - s / 4, y - s / 4, y, y]) FROM base),
edges AS (SELECT a.polygon_id, a.r, a.px AS x1, a.py AS y1, b.px AS x2, b.py AS y2 FROM pts a JOIN pts b ON a.polygon_id = b.polygon_id AND a.r = b.r AND b.i = (a.i + 1) % a.n),
rings_ AS (
  SELECT polygon_id, r, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area, sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS cx,
    sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS cy FROM edges GROUP BY 1, 2)
"""


@query(
    "q44_polygon_centroid",
    with_ctes(
        LAND_SQL,
        select="""
SELECT o.polygon_id, round(o.area - h.area, 6) AS area, round((o.area * o.cx - h.area * h.cx) / (o.area - h.area), 5) AS cx, round((o.area * o.cy - h.area * h.cy) / (o.area - h.area), 5) AS cy,
  round(b.min_x, 6) AS min_x, round(b.max_y, 6) AS max_y
FROM rings_ o JOIN rings_ h ON o.polygon_id = h.polygon_id AND o.r = 0 AND h.r = 1 JOIN (SELECT polygon_id, min(px) AS min_x, max(py) AS max_y FROM pts GROUP BY 1) b ON b.polygon_id = o.polygon_id""",
    ),
)
def polygon_centroid(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.with_measure(land(spark, sf)).withColumn("box", P.bounding_box(F.col("rings")))
    return rows.select("polygon_id", r6("area"), F.round("cx", 5).alias("cx"), F.round("cy", 5).alias("cy"), r6("box.min_x", "min_x"), r6("box.max_y", "max_y"))


@query(
    "q45_point_in_polygon",
    with_ctes(
        POINTS_SQL, LAND_SQL,
        "box AS (SELECT polygon_id, min(px) AS a, max(px) AS b, min(py) AS c, max(py) AS d FROM pts GROUP BY 1)",
        """near AS (SELECT region_key, lo, la, polygon_id FROM o JOIN box ON lo BETWEEN a AND b AND la BETWEEN c AND d),
hits AS (SELECT region_key, n.polygon_id, r, count(*) FILTER ((y2 > la) <> (y1 > la) AND lo < (x1 - x2) * (la - y2) / nullif(y1 - y2, 0) + x2) % 2 AS odd
  FROM near n JOIN edges e ON e.polygon_id = n.polygon_id GROUP BY 1, 2, 3)""",
        select="SELECT region_key AS point_id, polygon_id FROM hits GROUP BY 1, 2 HAVING max(CASE WHEN r = 0 THEN odd END) = 1 AND max(CASE WHEN r = 1 THEN odd END) = 0",
    ),
)
def point_in_polygon(spark: SparkSession, sf: str) -> DataFrame:
    points = origins(spark, sf).select(F.col("region_key").alias("point_id"), F.col("origin_lon").alias("lon"), F.col("origin_lat").alias("lat"))
    return P.points_in_polygons(points, land(spark, sf), ["point_id"]).select("point_id", "polygon_id")


@query(
    "q46_coord_contract",
    with_ctes(
        POINTS_SQL,
        "x AS (SELECT entity_id, fa + CASE WHEN entity_id % 31 = 0 THEN 3 ELSE 0 END AS la, fo FROM f)",
        select="""
SELECT 'latitude' AS "check", entity_id::VARCHAR AS key FROM x WHERE la NOT BETWEEN 33 AND 39
UNION ALL SELECT 'longitude', entity_id::VARCHAR FROM x WHERE fo NOT BETWEEN 124 AND 131.5
UNION ALL SELECT 'code', entity_id::VARCHAR FROM x WHERE NOT regexp_matches(entity_id::VARCHAR, '^[0-9]{2}$')
UNION ALL SELECT 'box:' || round(min(la), 5)::VARCHAR || ':' || round(max(fo), 5)::VARCHAR, 'all' FROM x""",
    ),
)
def coord_contract(spark: SparkSession, sf: str) -> DataFrame:
    rows = facilities(spark, sf).withColumn("dest_lat", F.col("dest_lat") + F.when(F.col("entity_id") % 31 == 0, 3).otherwise(0))
    box = rows.agg(F.round(F.min("dest_lat"), 5).alias("a"), F.round(F.max("dest_lon"), 5).alias("b"))
    return C.union_all(
        [
            C.in_range(rows, ["entity_id"], "dest_lat", *V.COUNTRY_BOX["lat"], "latitude"),
            C.in_range(rows, ["entity_id"], "dest_lon", 124.0, 131.5, "longitude"),
            C.matches_format(rows, ["entity_id"], "entity_id", r"^[0-9]{2}$", "code"),
        ]
    ).select("check", "key").unionByName(
        box.select(F.concat_ws(":", F.lit("box"), F.col("a").cast("string"), F.col("b").cast("string")).alias("check"), F.lit("all").alias("key"))
    )


@query(
    "q60_distance_basis",
    with_ctes(
        POINTS_SQL, ROADS_SQL,
        select="""
SELECT region_key, entity_id, round(CASE WHEN st = '성공' THEN road WHEN entity_id % 5 <> 0 THEN km END, 6) AS distance_km, round(CASE WHEN st = '성공' THEN road * 1.5::DOUBLE END, 6) AS shown_eta_min,
  CASE WHEN st = '성공' THEN '카카오 도로거리' WHEN entity_id % 5 <> 0 THEN '직선거리 대체' ELSE '미산출' END AS distance_basis FROM roads WHERE rank <= 2""",
    ),
)
def distance_basis(spark: SparkSession, sf: str) -> DataFrame:
    near = with_roads(R.nearest_candidates(origins(spark, sf), facilities(spark, sf), 2))
    failed = F.col("route_status") != V.ROUTE_OK
    rows = near.withColumn("straight_km", F.when(failed & (F.col("entity_id") % 5 == 0), None).otherwise(F.col("straight_km")))
    return R.distance_basis(rows).select("region_key", "entity_id", r6("distance_km"), r6("shown_eta_min"), "distance_basis")
