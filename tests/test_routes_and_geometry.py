import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from wardscope.functions import fixed_values as V
from wardscope.operators import nearest as R
from wardscope.operators import polygons as P

O = "region_key string, origin_lat double, origin_lon double"
D = "entity_id string, dest_lat double, dest_lon double"


def km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def brute(origins, places, k):
    return {o: [e for _, e in sorted((km(a, b, c, d), e) for e, c, d in places)[:k]] for o, a, b in origins}


def check_nearest(spark, origins, places, k):
    got = {}
    for r in R.nearest_candidates(spark.createDataFrame(origins, O), spark.createDataFrame(places, D), k).orderBy("region_key", "rank").collect():
        got.setdefault(r["region_key"], []).append(r["entity_id"])
    assert got == brute(origins, places, k)


@pytest.mark.parametrize("box", [(33, 39, 124, 132), (-89.9, 89.9, -180, 180), (59.9, 60.1, 179.9, 180.0), (37.5, 37.5001, 127, 127.0001)])
def test_nearest_equals_brute_force(spark, box):
    random.seed(int(box[0]))
    place = lambda: (random.uniform(box[0], box[1]), random.uniform(box[2], box[3]))
    origins = [(f"o{i:02d}", *place()) for i in range(15)]
    places = [(f"e{i:03d}", *place()) for i in range(120)]
    check_nearest(spark, origins, places, 4)


def test_nearest_with_a_third_of_the_places_on_one_spot(spark):
    random.seed(5)
    places = [(f"h{i:03d}", 37.5, 127.0) for i in range(60)] + [(f"e{i:03d}", random.uniform(33, 39), random.uniform(124, 132)) for i in range(120)]
    check_nearest(spark, [("a", 37.5, 127.0), ("b", 37.6, 127.2), ("c", 33.0, 124.0)], places, 5)


def test_more_neighbours_wanted_than_places(spark):
    check_nearest(spark, [("a", 37.0, 127.0)], [("x", 37.1, 127.0), ("y", -30.0, 10.0)], 10)


def line(spark, spec, roads):
    """Facilities due north of one origin at given straight distances."""
    places = [(f"f{i}", 37.0 + s / (6371.0 * math.pi / 180), 127.0) for i, s in enumerate(spec)]
    table = spark.createDataFrame(
        [(f"f{i}", None if r is None else float(r), c) for i, (r, c) in enumerate(roads)], "entity_id string, road_km double, route_code int"
    )

    def attach(df):
        ok = F.col("road_km").isNotNull()
        joined = df.join(table, "entity_id")
        return joined.withColumn("eta_min", F.col("road_km")).withColumn("route_status", F.when(ok, V.ROUTE_OK).otherwise("경로오류:x"))

    return spark.createDataFrame([("A", 37.0, 127.0)], O), spark.createDataFrame(places, D), attach


def test_search_grows_until_the_bound_holds(spark):
    o, f, attach = line(spark, [1, 2, 3, 8], [(10, 0), (8, 0), (4, 0), (9, 0)])
    got = R.evaluated_candidates(o, f, attach, 2)
    assert sorted(r["rank"] for r in got.collect()) == [1, 2, 3]
    assert rows(R.best_by_road(got), "entity_id", "rank", "road_km") == [("f2", 3, 4.0)]
    assert R.proof_violations(got, f, o).isEmpty()


def test_search_stops_at_once(spark):
    o, f, attach = line(spark, [1, 2, 2.1], [(1.5, 0), (2.5, 0), (2.2, 0)])
    assert [r["rank"] for r in R.evaluated_candidates(o, f, attach, 1).collect()] == [1]


def test_failures_extend_the_search(spark):
    o, f, attach = line(spark, [1, 2, 3, 400], [(None, 102), (None, 102), (None, 102), (500, 0)])
    got = R.evaluated_candidates(o, f, attach, 1)
    assert got.count() == 4
    assert rows(R.best_by_road(got), "entity_id") == [("f3",)]
    assert R.proof_violations(got, f, o).isEmpty()


@pytest.mark.parametrize("code,checks", [(9, ["uncertain_failure"]), (102, [])])
def test_only_confirmed_failures_may_lie_below_the_best(spark, code, checks):
    o, f, attach = line(spark, [1, 2], [(None, code), (5, 0)])
    got = R.evaluated_candidates(o, f, attach, 2)
    assert [r["check"] for r in R.proof_violations(got, f, o).collect()] == checks


def test_skipped_candidate_breaks_the_proof(spark):
    o, f, attach = line(spark, [1, 2], [(5, 0), (3, 0)])
    got = R.evaluated_candidates(o, f, attach, 1)
    assert got.count() == 2
    assert [r["check"] for r in R.proof_violations(got.filter("rank = 1"), f, o).collect()] == ["not_evaluated"]
    none = got.withColumn("route_status", F.lit("경로오류:9"))
    assert "no_road" in [r["check"] for r in R.proof_violations(none, f, o).collect()]


def test_best_route_takes_the_first_minimum(spark):
    df = spark.createDataFrame(
        [("A", 1, 8.0, V.ROUTE_OK), ("A", 2, 4.0, V.ROUTE_OK), ("A", 3, 4.0, V.ROUTE_OK), ("A", 4, 0.5, "경로오류:9"), ("B", 1, 0.0, V.ROUTE_OK_ZERO)],
        "region_key string, rank int, road_km double, route_status string",
    ).withColumn("eta_min", F.lit(1.0))
    assert rows(R.best_by_road(df), "region_key", "rank") == [("A", 2), ("B", 1)]


def test_route_keys_and_cache_age(spark):
    def key(*xy):
        return spark.range(1).select(R.route_key(*[F.lit(float(v)) for v in xy])).first()[0]

    assert key(37, 127, 38, 128) == key(37.00000001, 127, 38, 128) != key(37.0000002, 127, 38, 128)
    assert len(key(1, 2, 3, 4)) == 64
    now = F.lit("2026-09-04T00:00:00Z").cast("timestamp")
    fresh = {
        "2026-08-05T00:00:00+00:00": True, "2026-08-04T23:59:59Z": False, "2026-09-04T09:00:00+09:00": True, "2026-09-04T00:00:01Z": False,
        "2026-09-01T00:00:00": False, "": False, None: False,
    }
    df = spark.createDataFrame([(k,) for k in fresh], "t string")
    assert [r[0] for r in df.select(R.cache_fresh(F.col("t"), now, 30)).collect()] == list(fresh.values())
    with pytest.raises(ValueError):
        R.cache_fresh(F.col("t"), now, 0)


def test_later_table_wins_in_the_cache_and_origins_are_reused(spark):
    schema = "route_key string, road_km double, eta_min double, route_code int, route_status string, collected_ts string"
    a = spark.createDataFrame([("k", 1.0, 1.0, 0, V.ROUTE_OK, "2026-09-03T00:00:00Z"), ("f", None, None, 9, "x", "2026-09-03T00:00:00Z")], schema)
    b = spark.createDataFrame([("k", 2.0, 1.0, 0, V.ROUTE_OK, "2026-09-02T00:00:00Z")], schema)
    now = F.lit("2026-09-04T00:00:00Z").cast("timestamp")
    cache = R.reusable_routes([a, b], now)
    assert rows(cache, "route_key", "road_km") == [("k", 2.0)]
    assert rows(R.pending_routes(a, cache)) == [("f",)]
    base = spark.createDataFrame([("r", "k1"), ("s", "k2")], "region_key string, origin_key string")
    old = spark.createDataFrame([("r", "k1", V.ROUTE_OK, "2026-09-03T00:00:00Z"), ("s", "other", V.ROUTE_OK, "2026-09-03T00:00:00Z")], "region_key string, origin_key string, probe_status string, collected_ts string")
    assert rows(R.reusable_origins(base, old, now), "region_key", "reusable") == [("r", True), ("s", False)]


RING = "array<array<struct<x:double,y:double>>>"


def shapes(spark, data):
    return spark.createDataFrame(data, f"region_key string, rings {RING}")


SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
HOLE = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0), (1.0, 1.0)]


def test_measures(spark):
    got = P.with_measure(shapes(spark, [("a", [SQUARE]), ("b", [SQUARE, HOLE]), ("c", [[(0.0, 0.0), (1.0, 1.0)]]), ("d", [[(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]])]))
    assert rows(got, "region_key", "area", "cx", "cy") == [("a", 16.0, 2.0, 2.0), ("b", 12.0, 2.0, 2.0), ("c", 0.0, 0.0, 0.0), ("d", 0.0, 1.0, 1.0)]


def test_representative_points(spark):
    far = [(10.0, 0.0), (11.0, 0.0), (11.0, 1.0), (10.0, 1.0), (10.0, 0.0)]
    got = {r["region_key"]: (r["lon"], r["lat"]) for r in P.representative_points(shapes(spark, [("sq", [SQUARE]), ("ring", [SQUARE, HOLE]), ("two", [SQUARE]), ("two", [far])])).collect()}
    assert got["sq"] == (2.0, 2.0)
    x, y = got["ring"]
    assert 0 <= x <= 4 and 0 <= y <= 4 and not (1 < x < 3 and 1 < y < 3)
    assert got["two"][0] < 4


def test_points_in_polygons(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 5.0, 5.0), (4, 3.5, 3.9)], "p int, lon double, lat double")
    got = P.points_in_polygons(points, shapes(spark, [("b", [SQUARE, HOLE])]), ["p"])
    assert rows(got, "p", "region_key") == [(1, "b"), (4, "b")]


def test_probe_points(spark):
    origins = spark.createDataFrame([("r", 37.0, 127.0), ("s", 35.0, 128.0)], O)
    local = spark.createDataFrame([("r", "e", 37.1, 127.1)], "region_key string, entity_id string, dest_lat double, dest_lon double")
    got = R.probe_points(origins, local).groupBy("region_key").count()
    assert rows(got) == [("r", 12), ("s", 9)]


def test_rounding_and_box(spark):
    df = shapes(spark, [("a", [[(1.123456789, 2.0), (3.0, 4.0), (5.0, 6.0)]])])
    assert df.select(P.round_rings(F.col("rings"))[0][0]["x"]).first()[0] == 1.12346
    assert tuple(df.select(P.bounding_box(F.col("rings")).alias("b")).first()["b"]) == (1.123456789, 2.0, 5.0, 6.0)


def test_distance_basis(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, V.ROUTE_OK), (1.0, 2.0, None, V.ROUTE_OK), (1.0, None, None, "x"), (None, None, None, None)], "straight_km double, road_km double, eta_min double, route_status string")
    assert [tuple(r) for r in R.distance_basis(df).select("distance_km", "distance_basis").collect()] == [(2.0, V.BASIS_ROAD), (1.0, V.BASIS_STRAIGHT), (1.0, V.BASIS_STRAIGHT), (None, V.BASIS_NONE)]


def test_a_spot_with_many_origins_is_searched_once(spark):
    origins = spark.createDataFrame([(f"r{i}", 37.5 + i % 2 / 10, 127.0) for i in range(200)], O)
    places = spark.createDataFrame([(f"e{j}", 37.4 + j / 50, 127.01) for j in range(20)], D)
    near = R.nearest_candidates(origins, places, 3)
    assert near.count() == 600
    assert "Window [row_number() windowspecdefinition(origin_lat" in near._jdf.queryExecution().optimizedPlan().toString()
    wide = origins.withColumn("own", F.when(F.col("region_key") == "r0", 50000.0).otherwise(12.0))
    shared = R.within_own_radius(wide, places, F.col("own"), strict=False)
    alone = R.within_radius(wide, places, F.col("own"), strict=False)
    assert rows(shared, "region_key", "entity_id", "straight_km") == rows(alone, "region_key", "entity_id", "straight_km")


def test_points_on_one_spot_are_tested_once(spark):
    points = spark.createDataFrame([(f"p{i}", 2.0 + i % 2 * 20, 2.0) for i in range(50)], "p string, lon double, lat double")
    found = P.points_in_polygons(points, shapes(spark, [("b", [SQUARE])]), ["p"])
    assert found.count() == 25
    assert "Aggregate [lat" in found._jdf.queryExecution().optimizedPlan().toString()
