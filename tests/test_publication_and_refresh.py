import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from wardscope.functions import fixed_values as V
from wardscope.operators import nearest as R
from wardscope.operators import publication as P
from wardscope.operators import score
from wardscope.plans import refresh
from wardscope.session import cut_lineage
from wardscope.sources import sinks

NOW = dt.datetime(2026, 9, 4, 0, 0, tzinfo=dt.timezone.utc)


def names(df):
    return {r["check"] for r in df.collect()}


def master(spark, n=24, regions=12):
    data = [(f"E{i:02d}", f"n{i}", "g", f"P{i % regions % 3}", f"D{i % regions}", f"P{i % regions % 3} D{i % regions} 1", 36.0 + i / 50, 127.0 + (i % 5) / 20) for i in range(n)]
    return spark.createDataFrame(data, "entity_id string, name string, grade string, province string, district string, address string, lat double, lon double")


def test_master_and_ledger(spark):
    m = master(spark)
    assert P.master_contract(m, 24, 12).isEmpty()
    assert names(P.master_contract(m.withColumn("lat", F.lit(10.0)), 23, 11)) == {"master_lat", "master_count", "master_regions"}
    schema = "entity_id string, name string, from_province string, from_district string, province string, district string, evidence_url string, confirmed_on string"
    good = ("E00", "n0", "P0", "old", "P0", "D0", "https://x.kr", "2026-01-02")
    assert P.region_ledger_contract(spark.createDataFrame([good], schema), m).isEmpty()
    bad = [("E01", "other", "P1", "D1", "P1", "D1", "http://x.kr", "2026-1-2"), ("X", "n", "a", "b", "c", "d", "https://x", "2026-01-02")]
    assert names(P.region_ledger_contract(spark.createDataFrame(bad, schema), m)) == {
        "region_ledger_no_change", "region_ledger_url", "region_ledger_date", "region_ledger_name", "region_ledger_unknown",
    }


def routes(spark):
    m = master(spark)
    keyed = m.withColumn("region_key", F.concat_ws("|", "province", "district"))
    origins = keyed.groupBy("region_key").agg((F.min("lat") + 0.013).alias("origin_lat"), (F.min("lon") + 0.007).alias("origin_lon"))
    places = m.select("entity_id", F.col("lat").alias("dest_lat"), F.col("lon").alias("dest_lon"))

    def attach(df):
        df = df.withColumn("road_km", F.col("straight_km") * (1.1 + F.col("entity_id").substr(2, 2).cast("int") % 4 / 10))
        df = df.withColumn("eta_min", F.col("road_km") * 2).withColumn("route_code", F.lit(0)).withColumn("route_status", F.lit(V.ROUTE_OK))
        return df.withColumn("route_key", R.route_key(*[F.col(c) for c in ("origin_lat", "origin_lon", "dest_lat", "dest_lon")]))

    origins, places = cut_lineage(origins), cut_lineage(places)
    found = cut_lineage(R.evaluated_candidates(origins, places, attach, 3))
    best = cut_lineage(R.best_by_road(found))
    access = score.percentile_score(best, "road_km", "s_access")
    own = attach(R.local_facilities(origins, places.join(keyed.select("entity_id", "region_key"), "entity_id")))
    return origins, found, best, access, places, own, m


def test_route_contract(spark):
    origins, found, best, access, places, own, m = routes(spark)
    assert P.route_contract(origins, found, best, access, places, own, m).isEmpty()
    region = best.first()["region_key"]
    broken = found.filter(~((F.col("rank") == 1) & (F.col("region_key") == region)))
    got = names(P.route_contract(origins, broken, best, access.withColumn("s_access", F.lit(1.0)), places, own.filter("entity_id <> 'E00'"), m))
    assert {"candidate_prefix", "candidate_skipped", "access_score", "facility_route_population"} <= got
    zero = own.withColumn("road_km", F.when(F.col("entity_id") == "E01", 0.0).otherwise(F.col("road_km")))
    assert names(P.route_rows_contract(zero, ["entity_id"], "r")) == {"r_zero"}


def test_sources_bounds_and_explained_gaps(spark):
    note = spark.createDataFrame([("sgg", "EPSG:4326", "light", "v1", "CC-BY-4.0 x", "from SGIS")], "level string, crs string, resolution string, version string, license string, attribution string")
    assert P.boundary_source_contract(note, "v1").isEmpty()
    assert names(P.boundary_source_contract(note.withColumn("crs", F.lit("x")).withColumn("license", F.lit("none")), "v2")) == {"boundary_source_crs", "boundary_source_version", "boundary_source_license"}
    stored = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1)], "region_key string, rank int")
    eligible = spark.createDataFrame([("x",), ("y",)], "entity_id string")
    assert rows(P.candidate_bounds_contract(stored, eligible), "key") == [("a",)]
    d = "entity_id string, province string, district string, match_state string, specialists double"
    detail = spark.createDataFrame([("A", "P", "D", V.STATE_LOW, None), ("B", "P", "E", V.STATE_EXCLUDED, None)], d)
    from wardscope.operators.missingness import staffing_by_region

    assert rows(P.explained_quality_contract(staffing_by_region(detail), detail), "key") == [("P|D",)]


RING = "array<array<struct<x:double,y:double>>>"


def test_boundaries_and_origins(spark):
    square = lambda x: [[(x, 36.0), (x + 1, 36.0), (x + 1, 37.0), (x, 37.0), (x, 36.0)]]
    data = [("41111", "수원시영통구", "41", "경기도", "v", "Polygon", square(126.0)), ("41113", "수원시권선구", "41", "경기도", "v", "Polygon", square(127.0)), ("41290", "과천시", "41", "경기도", "v", "Polygon", square(128.0))]
    polygons = spark.createDataFrame(data, f"code string, name string, province_code string, province string, version string, geometry_type string, rings {RING}")
    regions = spark.createDataFrame([("경기도|수원시",), ("경기도|과천시",)], "region_key string")
    assert P.boundary_contract(polygons, regions, 3, "v").isEmpty()
    more = regions.union(spark.createDataFrame([("경기도|없는시",)], "region_key string"))
    assert names(P.boundary_contract(polygons.withColumn("code", F.lit("x")), more, 3, "w")) >= {"boundary_code_format", "boundary_version", "region_without_boundary", "boundary_code"}
    got = rows(P.origins_from_boundaries(polygons, more), "region_key", "n_boundaries")
    assert got == [("경기도|과천시", 1), ("경기도|수원시", 2), ("경기도|없는시", None)]
    assert names(P.missing_origins(P.origins_from_boundaries(polygons, more))) == {"origin_missing"}
    table = spark.createDataFrame([("경기도", "수원시", "37", "x")], "province string, district string, lat string, lon string")
    assert names(P.origins_from_table(table, regions)[1]) == {"origin_population", "origin_coordinate"}


def test_match_tables(spark):
    d = "entity_id string, province string, district string, catalog_id string, match_score double, match_state string, specialists double"
    detail = spark.createDataFrame([("A", "P", "D", "c1", 1.0, V.STATE_AUTOMATIC, 2.0), ("B", "P", "D", None, 0.5, V.STATE_LOW, None), ("C", "P", "E", "c3", 1.0, V.STATE_MANUAL, 0.0)], d)
    review = spark.createDataFrame([("A", 1, "c1", 1.0, True, True, True), ("B", 1, "c9", 0.5, False, True, False)], "entity_id string, rank int, catalog_id string, match_score double, gate_passed boolean, facility_matches boolean, selected boolean")
    from wardscope.operators.matching import match_manifest, review_queues
    from wardscope.operators.missingness import staffing_by_region

    staffing = staffing_by_region(detail)
    none, rest = review_queues(detail)
    assert P.match_contract(detail, detail, review, staffing, none, rest).isEmpty()
    wrong = P.match_contract(detail, detail, review.withColumn("catalog_id", F.lit("zz")), staffing.withColumn("n_matched", F.lit(9)), none, none)
    assert names(wrong) == {"selected_is_automatic", "staffing", "review_queues:cover"}
    manifest = match_manifest(detail, staffing).first()
    assert (manifest["matched"], manifest["manual"], manifest["deferred"], manifest["specialist_total"], manifest["usable_regions"]) == (2, 1, 1, 2.0, 1)


def test_residents_and_serving(spark):
    m = master(spark)
    res = m.select("province", "district").distinct().withColumn("population", F.lit(5.0)).withColumn("period", F.lit("202607"))
    res = res.withColumn("admin_code", F.format_string("%05d", F.regexp_replace("district", "D", "").cast("int")))
    assert P.resident_contract(res, m, "202607").isEmpty()
    assert names(P.resident_contract(res.withColumn("population", F.lit(0.0)).filter("district <> 'D1'"), m, "202606")) == {"resident_positive", "resident_population", "resident_period"}
    risk = spark.createDataFrame([("a", 1.0), ("b", None)], "region_key string, risk double")
    labelled = spark.createDataFrame([("a", 0)], "region_key string, cluster int")
    assert P.serving_contract(risk, labelled, m, m, ["road_km"], ["road_km"]).isEmpty()
    assert names(P.serving_contract(risk, labelled.limit(0), m, m, ["straight_km"], ["road_km"])) == {"serving_clustered", "regression_features"}


def test_refresh_publishes_a_checked_version(spark, tmp_path):
    m = master(spark)
    feed = m.select("entity_id", (F.col("lat") * 10 % 7).alias("available"), F.lit(9.0).alias("total"), F.lit("20260904083000").alias("source_ts"), F.lit(1).alias("seq"))
    previous = feed.limit(0).withColumn("collected_ts", F.lit("x")).select("entity_id", "available", "total", "source_ts", "collected_ts", "seq")
    regions = m.select("province", "district").distinct()
    number = F.regexp_replace("district", "D", "").cast("double")
    inputs = refresh.Inputs(
        master=m.drop("address", "lat", "lon"), feed=feed, previous=previous, failed_regions=regions.limit(0),
        history=spark.createDataFrame([], "entity_id string, name string, grade string, province string, district string, available double, total double, saturation double, status string, source_ts string, collected_ts timestamp"),
        residents=regions.withColumn("population", 1000 + number * number), staffing=regions.withColumn("specialists", number % 4),
        access_routes=regions.select(F.concat_ws("|", "province", "district").alias("region_key"), (number + 1).alias("road_km")),
    )
    audit = refresh.publish_refresh(spark, inputs, NOW, str(tmp_path / "out"), "7", refresh.Limits(minimum_live=20, complete_regions=12, max_clusters=3, cluster_restarts=2))
    assert audit["usable"] == 24 and audit["regression"]["status"] == "complete"
    root = sinks.current_version(spark, str(tmp_path / "out"))
    assert root.endswith("version=7")
    assert spark.read.parquet(f"{root}/risk").filter("risk is not null").count() == 12
    assert spark.read.parquet(f"{root}/heatmap").filter("day_no = 4 and h09 is not null").count() == 1
    with pytest.raises(RuntimeError, match="risk_floor"):
        refresh.publish_refresh(spark, inputs, NOW, str(tmp_path / "out"), "8", refresh.Limits(minimum_live=20, complete_regions=13, max_clusters=2, cluster_restarts=2))
    assert sinks.current_version(spark, str(tmp_path / "out")) == root
    with pytest.raises(ValueError, match="already"):
        sinks.publish(spark, {}, inputs.master.limit(0), str(tmp_path / "out"), "7")
    # seeded defects in what was written are all named
    read = {n: spark.read.parquet(f"{root}/{n}") for n in ("snapshot", "risk", "missingness", "clusters", "cluster_evaluation", "component_access")}
    limits = refresh.Limits(minimum_live=20, complete_regions=12, entities=24, regions=12)
    inputs.master, inputs.residents = m, inputs.residents.withColumn("admin_code", F.lit("1")).withColumn("period", F.lit("202607"))
    inputs.match_staffing = inputs.staffing.withColumn("quality", F.lit(V.QUALITY_OK))
    broken = {**read, "clusters": read["clusters"].limit(3), "missingness": read["missingness"].limit(0), "snapshot": read["snapshot"].limit(21)}
    assert names(refresh.gate(read, inputs, limits)) == {"resident_code", "resident_code_unique"}
    assert names(refresh.gate(broken, inputs, limits)) >= {"serving_clustered", "snapshot_population", "resident_code"}


def test_manifest_in_the_gate(spark, tmp_path):
    from wardscope.operators import manifest as MF
    from wardscope.operators.missingness import staffing_by_region

    d = "entity_id string, province string, district string, catalog_id string, match_score double, match_state string, specialists double"
    data = [("A", "P", "D", "c1", 1.0, V.STATE_AUTOMATIC, 2.0), ("B", "P", "D", None, None, V.STATE_EXCLUDED, None), ("C", "P", "E", "c3", 1.0, V.STATE_MANUAL, 1.0)]
    detail = spark.createDataFrame(data, d)
    ledger = spark.createDataFrame([("B", "n", "closed", "r", "old", "https://x", "2026-01-02")], ", ".join(f"{c} string" for c in MF.LEDGER))
    catalog = spark.range(9)
    staffing = staffing_by_region(detail)
    made = MF.build_manifest(detail, staffing, ledger, catalog, 2, detail.withColumn("match_state", F.lit(V.STATE_MANUAL)))
    assert rows(made["gaps"], "district", "additional_needed") == [("D", 1)]
    assert rows(made["gap_codes"], "entity_id") == rows(made["transitions"], "entity_id") == [("B",)]
    assert MF.manifest_contract(made, detail, staffing, ledger, catalog, detail, 2).isEmpty()
    empty = {name: df.limit(0) for name, df in made.items()}
    assert names(MF.manifest_contract(empty, detail, staffing, ledger, catalog, detail, 2)) == {"manifest_counter", "manifest_manual", "manifest_exclusion", "manifest_gap", "manifest_gap_code"}
    none = MF.build_manifest(detail.limit(0), staffing.limit(0), ledger.limit(0), catalog.limit(0), 0)
    assert dict(rows(none["counters"], "name", "value"))["specialist_total"] == 0.0 and none["gaps"].isEmpty()
