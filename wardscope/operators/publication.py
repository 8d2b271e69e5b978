"""Contracts of whole tables, assembled from the check kinds in ``contract``.

Every function returns violation rows (check, key, detail); a generation may be
published when the union of all of them is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardscope.functions import fixed_values as V
from wardscope.functions import geodesy as G
from wardscope.functions.scalars import non_empty, number_of, region_key, source_time, strict_date, usable
from wardscope.operators import contract as C
from wardscope.operators import joins as J
from wardscope.operators import nearest as R
from wardscope.operators import polygons as P
from wardscope.operators.missingness import quality_gaps, staffing_by_region
from wardscope.operators.score import percentile_score

ID = ["entity_id"]
REGION = ["region_key"]


def _keyed(df: DataFrame) -> DataFrame:
    return df if "region_key" in df.columns else df.withColumn("region_key", region_key(F.col("province"), F.col("district")))


def master_contract(master: DataFrame, expected_entities: int, expected_regions: int, box: dict | None = None) -> DataFrame:
    """Unique ids, present regions, coordinates in the country box, reviewed population size."""
    box = box or V.COUNTRY_BOX
    places = master.select("province", "district").distinct()
    return C.union_all(
        [
            C.unique(master, ID, "master_id"),
            C.not_null(master, ID, ["province", "district"], "master_region"),
            C.in_range(master, ID, "lat", *box["lat"], "master_lat"),
            C.in_range(master, ID, "lon", *box["lon"], "master_lon"),
            C.expected_count(master, expected_entities, "master_count"),
            C.expected_count(places, expected_regions, "master_regions"),
        ]
    )


def region_ledger_contract(ledger: DataFrame, master: DataFrame) -> DataFrame:
    """Manual region corrections: complete, real changes, and in line with the master and its address."""
    columns = ["entity_id", "name", "from_province", "from_district", "province", "district", "evidence_url", "confirmed_on"]
    C.require_columns(ledger, columns, "region ledger")
    side = master.select(
        "entity_id", F.trim("name").alias("_n"), F.trim("province").alias("_p"), F.trim("district").alias("_d"),
        F.split(F.trim(F.coalesce(F.col("address"), F.lit(""))), r"\s+").alias("_tokens"), F.lit(True).alias("_in"),
    )
    joined = ledger.join(side, "entity_id", "left")
    known = joined.filter("_in")
    changed = (F.trim("from_province") != F.trim("province")) | (F.trim("from_district") != F.trim("district"))
    return C.union_all(
        [
            C.unique(ledger, ID, "region_ledger_id"),
            C.not_null(ledger, ID, columns, "region_ledger_blank"),
            C.holds(ledger, ID, changed, "region_ledger_no_change"),
            C.matches_format(ledger, ID, "evidence_url", "^https://", "region_ledger_url"),
            C.holds(ledger, ID, strict_date(F.col("confirmed_on")).isNotNull(), "region_ledger_date"),
            C.holds(joined, ID, F.col("_in"), "region_ledger_unknown"),
            C.holds(known, ID, F.col("_n") == F.trim("name"), "region_ledger_name"),
            C.holds(known, ID, (F.col("_p") == F.trim("province")) & (F.col("_d") == F.trim("district")), "region_ledger_region"),
            C.holds(known, ID, F.array_contains("_tokens", F.trim("from_province")) | F.array_contains("_tokens", F.trim("province")), "region_ledger_address"),
        ]
    )


def snapshot_contract(snapshot: DataFrame, master: DataFrame, minimum_live: int) -> DataFrame:
    """Snapshot covers exactly the population, enough rows answer, usable rows carry a readable stamp."""
    a, t, s = (number_of(snapshot, c) for c in ("available", "total", "saturation"))
    answered = F.coalesce(a.cast("string"), t.cast("string"), F.col("source_ts").cast("string")).isNotNull()
    good = usable(a, t) & s.isNotNull()
    return C.union_all(
        [
            C.unique(snapshot, ID, "snapshot_id"),
            C.same_set(snapshot, master, ID, "snapshot_population"),
            C.count_at_least(snapshot, answered, minimum_live, "snapshot_answers"),
            C.count_at_least(snapshot, good, minimum_live, "snapshot_usable"),
            C.implies(snapshot, ID, good, source_time(F.col("source_ts")).isNotNull(), "snapshot_stamp"),
            C.implies(snapshot, ID, s.isNotNull(), s.between(0, 100), "snapshot_range"),
        ]
    )


def resident_contract(residents: DataFrame, master: DataFrame, period: str | None = None) -> DataFrame:
    """Residents for exactly the master's regions, positive, with unique five-digit codes and one period."""
    rows = _keyed(residents)
    return C.union_all(
        [
            C.unique(rows, REGION, "resident_region"),
            C.same_set(rows, _keyed(master), REGION, "resident_population"),
            C.holds(rows, REGION, F.col("population") > 0, "resident_positive", F.col("population")),
            C.matches_format(rows, REGION, "admin_code", r"^\d{5}$", "resident_code"),
            C.unique(rows, ["admin_code"], "resident_code_unique"),
            C.single_value(rows, "period", "resident_period", period),
        ]
    )


def match_contract(
    detail: DataFrame, master: DataFrame, review: DataFrame, staffing: DataFrame, no_candidate: DataFrame, other_review: DataFrame, logic_version: str | None = None,
    overrides: DataFrame | None = None, exclusions: DataFrame | None = None, evidence: str | None = None,
) -> DataFrame:
    """Match table, candidate audit, staffing table, ledgers and review queues against each other."""
    state = F.col("match_state")
    matched = detail.filter(state.isin(V.MATCHED_STATES))
    automatic = detail.filter(state == V.STATE_AUTOMATIC)
    manual = detail.filter(state == V.STATE_MANUAL)
    excluded = detail.filter(state == V.STATE_EXCLUDED)
    selected = review.filter("selected")
    again = staffing_by_region(detail)
    place = ["province", "district"]
    checks = [
        C.same_set(detail, master, ID, "match_population"),
        C.unique(matched.filter(non_empty(F.col("catalog_id"))), ["catalog_id"], "match_catalog_id"),
        C.holds(matched, ID, non_empty(F.col("catalog_id")), "match_without_id"),
        C.holds(excluded, ID, F.col("catalog_id").isNull() & F.col("specialists").isNull(), "excluded_carries_values"),
        C.unique(review, ["entity_id", "rank"], "review_rank"),
        C.prefix_ranks(review, ID, "rank", "review_prefix"),
        C.same_set(review.select(*ID).distinct(), detail.filter(state != V.STATE_MANUAL).select(*ID), ID, "review_population"),
        C.disjoint(review, manual, ID, "review_of_manual"),
        C.equal_tables(selected, automatic, ID, ["catalog_id"], ["match_score"], "selected_is_automatic", 1e-12),
        C.holds(selected, ID, F.col("gate_passed") & F.col("facility_matches"), "selected_without_gate"),
        C.disjoint(review.filter("selected or gate_passed"), excluded, ID, "excluded_has_candidate"),
        C.partition_of([no_candidate, other_review], detail.filter(~state.isin(V.MATCHED_STATES)), ID, "review_queues"),
        C.equal_tables(staffing, again, place, ["quality", "n_total", "n_matched"], ["specialists", "match_rate"], "staffing"),
    ]
    if logic_version is not None:
        checks.append(C.in_domain(review, ["entity_id", "rank"], "logic_version", [logic_version], "review_logic"))
    if "collected_ts" in review.columns:
        checks.append(C.holds(review, ["entity_id", "rank"], F.col("collected_ts").try_cast("timestamp").isNotNull(), "review_stamp", F.col("collected_ts")))
    if evidence is not None:
        checks.append(C.in_domain(review, ["entity_id", "rank"], "evidence", [evidence], "review_evidence"))
    if overrides is not None:
        checks.append(C.same_set(overrides, manual, ID, "manual_is_ledger"))
    if exclusions is not None:
        old = review.filter(non_empty(F.col("catalog_id"))).join(exclusions.select(*ID), ID, "left_semi")
        checks += [
            C.same_set(exclusions, excluded, ID, "excluded_is_ledger"),
            C.disjoint(old, exclusions, ["catalog_id"], "excluded_id_reviewed"),
            C.subset(exclusions, review, ID, "excluded_without_review"),
        ]
    return C.union_all(checks)


def risk_table_contract(risk: DataFrame, master: DataFrame, staffing: DataFrame, floor: int) -> DataFrame:
    """Risk covers exactly the regions; a missing staff score means exactly a withheld staff total."""
    regions = _keyed(master).select("region_key").distinct()
    weak = _keyed(staffing).filter(F.col("quality") != V.QUALITY_OK)
    return C.union_all(
        [
            C.same_set(risk, regions, REGION, "risk_population"),
            C.same_set(risk.filter("s_staff is null"), weak, REGION, "risk_staff_withheld"),
            C.risk_contract(risk, floor=floor),
        ]
    )


def report_contract(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    return C.equal_rows(stored, recomputed, "missingness_report")


def boundary_contract(
    polygons: DataFrame, regions: DataFrame, expected_features: int, version: str | None = None,
    expected_none: DataFrame | None = None, expected_parent: DataFrame | None = None, box: dict | None = None,
) -> DataFrame:
    """Feature shape, codes, coordinates, and how features map to data regions."""
    box = box or V.COUNTRY_BOX
    key = ["code"]
    features = polygons.groupBy("code", "name", "province_code", "province").agg(
        F.sum(F.size(F.flatten("rings"))).alias("n_points"), F.min(P.bounding_box(F.col("rings"))["min_x"]).alias("x0"),
        F.max(P.bounding_box(F.col("rings"))["max_x"]).alias("x1"), F.min(P.bounding_box(F.col("rings"))["min_y"]).alias("y0"),
        F.max(P.bounding_box(F.col("rings"))["max_y"]).alias("y1"), F.max("geometry_type").alias("geometry_type"),
    )
    mapped = J.boundary_keys(features, regions)
    inside = (F.col("x0") >= box["lon"][0]) & (F.col("x1") <= box["lon"][1]) & (F.col("y0") >= box["lat"][0]) & (F.col("y1") <= box["lat"][1])
    checks = [
        C.expected_count(features, expected_features, "boundary_count"),
        C.unique(features, key, "boundary_code"),
        C.matches_format(features, key, "code", r"^\d{5}$", "boundary_code_format"),
        C.matches_format(features, key, "province_code", r"^\d{2}$", "boundary_province_format"),
        C.holds(features, key, F.col("code").startswith(F.col("province_code")), "boundary_code_prefix"),
        C.not_null(features, key, ["name", "province"], "boundary_name"),
        C.in_domain(features, key, "geometry_type", ["Polygon", "MultiPolygon"], "boundary_type"),
        C.holds(features, key, F.col("n_points") >= 4, "boundary_points"),
        C.holds(features, key, inside, "boundary_range"),
        C.subset(regions, mapped.select(F.col("matched_key").alias("region_key")), REGION, "region_without_boundary"),
    ]
    if version is not None:
        checks.append(C.single_value(polygons, "version", "boundary_version", version))
    if expected_none is not None:
        checks.append(C.same_set(mapped.filter("match_kind = 'none'"), expected_none, key, "boundary_without_region"))
    if expected_parent is not None:
        checks.append(C.same_set(mapped.filter("match_kind = 'parent'"), expected_parent, ["code", "matched_key"], "boundary_parent"))
    return C.union_all(checks)


def boundary_source_contract(source: DataFrame, version: str) -> DataFrame:
    """The boundary collection's own record: level, reference system, resolution, version, licence and attribution."""
    wanted = {**V.BOUNDARY_SOURCE, "version": version}
    checks = [C.single_value(source, column, f"boundary_source_{column}", value) for column, value in wanted.items()]
    for column, text in V.BOUNDARY_SOURCE_TEXTS.items():
        checks.append(C.holds(source, ["version"], F.col(column).contains(text), f"boundary_source_{column}", F.col(column)))
    return C.union_all(checks)


def origin_contract(origins: DataFrame, master: DataFrame, version: str, box: dict | None = None) -> DataFrame:
    """Route origins: exactly the master's regions, points in the country, a road found, one version, digest keys."""
    box = box or V.COUNTRY_BOX
    checks = [C.unique(origins, REGION, "origin_region"), C.same_set(origins, _keyed(master), REGION, "origin_population")]
    for place in ("base", "origin"):
        for axis in ("lat", "lon"):
            checks.append(C.in_range(origins, REGION, f"{place}_{axis}", *box[axis], f"origin_{place}_{axis}"))
    return C.union_all(
        [
            *checks,
            C.holds(origins, REGION, F.col("adjust_km") >= 0, "origin_adjustment", F.col("adjust_km")),
            C.in_domain(origins, REGION, "probe_status", [V.ROUTE_OK], "origin_probe"),
            C.in_domain(origins, REGION, "boundary_version", [version], "origin_version"),
            C.holds(origins, REGION, ~F.col("method").contains(V.WEAK_ORIGIN_METHOD), "origin_method", F.col("method")),
            C.matches_format(origins, REGION, "origin_key", "^[0-9a-f]{64}$", "origin_key"),
        ]
    )


def candidate_bounds_contract(candidates: DataFrame, eligible: DataFrame) -> DataFrame:
    """Every region stores at least one candidate and at most as many as there are eligible facilities."""
    sizes = candidates.groupBy(*REGION).agg(F.count(F.lit(1)).alias("n"))
    return C.in_range(sizes, REGION, "n", 1, eligible.count(), "candidate_number")


def explained_quality_contract(staffing: DataFrame, detail: DataFrame) -> DataFrame:
    """A region with a withheld total must be explained by its excluded facilities."""
    gaps = quality_gaps(staffing, detail).withColumn("region_key", region_key(F.col("province"), F.col("district")))
    return C.holds(gaps, REGION, F.col("explained"), "quality_unexplained", F.col("additional_needed"))


def route_rows_contract(routes: DataFrame, key: list[str], name: str) -> DataFrame:
    """Success carries values and code 0 or 104, failure carries none, zero needs code 104."""
    ok = F.col("route_status").isin(V.ROUTE_OK, V.ROUTE_OK_ZERO)
    road, eta = F.col("road_km"), F.col("eta_min")
    return C.union_all(
        [
            C.matches_format(routes, key, "route_key", "^[0-9a-f]{64}$", f"{name}_key"),
            C.holds(routes, key, F.col("straight_km") >= 0, f"{name}_straight"),
            C.implies(routes, key, ok, (road >= 0) & (eta >= 0), f"{name}_success"),
            C.implies(routes, key, ~ok, road.isNull() & eta.isNull(), f"{name}_failure"),
            C.implies(routes, key, ok, F.col("route_code").isin(0, 104), f"{name}_code"),
            C.implies(routes, key, ok & ((road == 0) | (eta == 0)), F.col("route_code") == 104, f"{name}_zero"),
        ]
    )


def route_contract(
    origins: DataFrame, candidates: DataFrame, best: DataFrame, access: DataFrame, facilities: DataFrame,
    facility_routes: DataFrame, master: DataFrame, share: float = 0.95,
) -> DataFrame:
    """Candidates are the proven distance-ordered prefix, the chosen road is the shortest, scores recompute.

    The prefix is checked without listing all pairs: ranks have no hole, stored
    distances equal the recomputed ones, order follows (distance, id), and no
    facility nearer than the farthest stored candidate is absent.
    """
    pair = ["region_key", "rank"]
    joined = candidates.join(origins.select("region_key", F.col("origin_lat").alias("_a"), F.col("origin_lon").alias("_o")), "region_key", "left").join(
        facilities.select("entity_id", F.col("dest_lat").alias("_x"), F.col("dest_lon").alias("_y")), "entity_id", "left"
    )
    exact = F.abs(F.col("straight_km") - G.haversine_km(F.col("_a"), F.col("_o"), F.col("_x"), F.col("_y"))) <= 1e-9
    following = candidates.select(
        "region_key", (F.col("rank") - 1).alias("rank"), F.col("straight_km").alias("_next"), F.col("entity_id").alias("_next_id")
    )
    stepped = candidates.join(following, pair)
    ordered = (F.col("straight_km") < F.col("_next")) | ((F.col("straight_km") == F.col("_next")) & (F.col("entity_id") < F.col("_next_id")))
    reach = candidates.groupBy("region_key").agg(F.max("straight_km").alias("_far"))
    near = R.within_radius(origins.join(reach, "region_key"), facilities, F.col("_far"), strict=True)
    absent = near.join(candidates.select("region_key", "entity_id"), ["region_key", "entity_id"], "left_anti")
    chosen = R.best_by_road(candidates)
    score = percentile_score(access.select("region_key", "road_km"), "road_km", "s_access")
    ok = F.col("route_status").isin(V.ROUTE_OK, V.ROUTE_OK_ZERO)
    covered = facility_routes.agg(F.count_if(ok).alias("n"), F.count(F.lit(1)).alias("all")).withColumn("k", F.lit("share"))
    home = _keyed(master).select("entity_id", "region_key")
    return C.union_all(
        [
            C.unique(origins, REGION, "origin_region"),
            C.same_set(origins, _keyed(master), REGION, "origin_population"),
            route_rows_contract(candidates, pair, "candidate"),
            route_rows_contract(facility_routes, ID, "facility_route"),
            C.unique(candidates, pair, "candidate_rank"),
            C.prefix_ranks(candidates, REGION, "rank", "candidate_prefix"),
            C.same_set(candidates, origins, REGION, "candidate_regions"),
            C.subset(candidates, facilities, ID, "candidate_eligible"),
            C.holds(joined, pair, exact, "candidate_distance"),
            C.holds(stepped, pair, ordered, "candidate_order"),
            C.holds(absent, ["region_key", "entity_id"], F.lit(False), "candidate_skipped"),
            R.proof_violations(candidates, facilities, origins),
            C.equal_tables(best, chosen, REGION, ["entity_id"], ["road_km"], "best_road", 1e-9),
            C.same_set(facility_routes, master, ID, "facility_route_population"),
            C.equal_tables(facility_routes, home, ID, ["region_key"], [], "facility_route_region"),
            C.holds(covered, ["k"], F.col("n") >= F.ceil(F.col("all") * share), "facility_route_share", F.col("n")),
            C.equal_tables(access, best, REGION, ["entity_id"], ["road_km", "eta_min"], "access_routes", 1e-9),
            C.equal_tables(access, score, REGION, [], ["s_access"], "access_score"),
        ]
    )


def serving_contract(risk: DataFrame, clusters: DataFrame, facilities: DataFrame, master: DataFrame, features: list[str], allowed: list[str]) -> DataFrame:
    """What the serving tables rely on: unique ids, equal sets, regression on the road distance."""
    complete = risk.filter("risk is not null")
    unknown = [f for f in features if f not in allowed]
    named = risk.select(F.lit("features").alias("k")).limit(1)
    return C.union_all(
        [
            C.unique(facilities, ID, "serving_facility"),
            C.same_set(facilities, master, ID, "serving_population"),
            C.unique(clusters, REGION, "serving_cluster"),
            C.same_set(clusters, complete, REGION, "serving_clustered"),
            C.holds(named, ["k"], F.lit(not unknown), "regression_features", F.lit(",".join(unknown))),
        ]
    )


def origins_from_boundaries(polygons: DataFrame, regions: DataFrame) -> DataFrame:
    """Representative point per region; child districts count towards their parent city."""
    mapped = J.boundary_keys(polygons, regions).filter("matched_key is not null").withColumn("region_key", F.col("matched_key"))
    points = P.representative_points(mapped.select("region_key", "rings"))
    version = mapped.groupBy("region_key").agg(F.max("version").alias("boundary_version"), F.count_distinct("code").alias("n_boundaries"))
    return regions.join(points.drop("n_polygons"), "region_key", "left").join(version, "region_key", "left").select(
        "region_key", F.col("lat").alias("base_lat"), F.col("lon").alias("base_lon"), "boundary_version", "n_boundaries"
    )


def origins_from_table(centroids: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Supplied centre points and their violations (keys equal the regions, coordinates numeric)."""
    rows = _keyed(centroids).withColumn("base_lat", number_of(centroids, "lat")).withColumn("base_lon", number_of(centroids, "lon"))
    bad = C.union_all(
        [
            C.unique(rows, REGION, "origin_region"), C.same_set(rows, regions, REGION, "origin_population"),
            C.holds(rows, REGION, F.col("base_lat").isNotNull() & F.col("base_lon").isNotNull(), "origin_coordinate"),
        ]
    )
    return rows.select("region_key", "base_lat", "base_lon"), bad


def missing_origins(origins: DataFrame) -> DataFrame:
    return C.holds(origins, REGION, F.col("base_lat").isNotNull(), "origin_missing")
