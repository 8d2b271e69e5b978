"""Nearest facility by road with a proof, without pairing every origin with every facility.

Facilities are indexed on nested grid cells.  An origin is joined only with the
cells that can hold an answer: first cells dense enough to contain its k nearest,
then the cells inside its best road distance.  A road is never shorter than the
straight line, so nothing outside that circle can win and the result is exact.
All joins are equi-joins on a packed cell number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardscope.functions import fixed_values as V
from wardscope.functions import geodesy as G
from wardscope.functions.scalars import hours, instant, number
from wardscope.operators.dedupe import keep_first, keep_last
from wardscope.operators.ordering import top_per_group
from wardscope.session import cut_lineage

LEVELS = list(range(0, G.FINEST_LEVEL + 1, 2))
HALF_WORLD_KM = 20_040.0
# a point in the 3 x 3 block around a cell is at most sqrt(8) cell heights away
BLOCK_REACH = 2.84


def _axis_cells(lat: Column, lon: Column) -> tuple[Column, Column]:
    size = G.cell_degrees(F.lit(G.FINEST_LEVEL))
    return F.floor((lat + 90.0) / size).cast("bigint"), F.floor((lon + 180.0) / size).cast("bigint")


def _even(level: Column) -> Column:
    return level - F.pmod(level, F.lit(2))


def _indexed(facilities: DataFrame) -> DataFrame:
    """Facilities once per grid level, keyed by cell."""
    levels = F.array(*[F.lit(level) for level in LEVELS])
    return facilities.select("*", F.explode(levels).alias("_level")).select(
        *facilities.columns, G.cell_id(F.col("dest_lat"), F.col("dest_lon"), F.col("_level")).alias("_cell")
    )


def _search_level(origins: DataFrame, facilities: DataFrame, k: int) -> DataFrame:
    """Finest even level whose 3 x 3 block around each origin's cell holds k facilities.

    Worked out once per occupied finest cell, not per origin; coarser cells are
    sums of finer ones, so the facility table is counted a single time.
    """
    row, col = _axis_cells(F.col("dest_lat"), F.col("dest_lon"))
    fine = facilities.groupBy(row.alias("r"), col.alias("c")).agg(F.count(F.lit(1)).alias("n"))
    # a coarser row or column is an integer halving of the finest one
    def coarse(level: int, r: Column, c: Column) -> Column:
        half = 1 << (G.FINEST_LEVEL - level)
        return G.pack_cell(F.lit(level), F.floor(r / half), F.floor(c / half))

    up = F.array(*[F.struct(F.lit(v).alias("level"), coarse(v, F.col("r"), F.col("c")).alias("cell")) for v in LEVELS])
    occupied = fine.select("n", F.inline(up)).groupBy("cell").agg(F.sum("n").alias("n"))
    orow, ocol = _axis_cells(F.col("origin_lat"), F.col("origin_lon"))
    homes = origins.select(orow.alias("hr"), ocol.alias("hc")).distinct()
    levels = F.array(*[F.lit(v) for v in LEVELS])
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))

    def block(level: Column) -> Column:
        half = F.pow(F.lit(2.0), F.lit(G.FINEST_LEVEL) - level)
        r, c = F.floor(F.col("hr") / half), F.floor(F.col("hc") / half)
        return F.transform(
            steps,
            lambda dr: F.transform(
                steps, lambda dc: F.struct(level.alias("level"), G.pack_cell(level, r + dr, c + dc).alias("cell"))
            ),
        )

    around = homes.select("hr", "hc", F.inline(F.array_distinct(F.flatten(F.flatten(F.transform(levels, block))))))
    filled = (
        around.join(occupied, "cell")
        .groupBy("hr", "hc", "level")
        .agg(F.sum("n").alias("n"))
        .filter((F.col("n") >= k) | (F.col("level") == 0))
    )
    best = filled.groupBy("hr", "hc").agg(F.max("level").alias("level"))
    return origins.withColumn("hr", orow).withColumn("hc", ocol).join(best, ["hr", "hc"]).drop("hr", "hc")


def within_radius(origins: DataFrame, facilities: DataFrame, radius: Column, strict: bool) -> DataFrame:
    """Origin-facility pairs closer than each origin's radius."""
    reach = origins.withColumn("_radius", F.least(radius, F.lit(HALF_WORLD_KM)))
    level = _even(G.level_for_radius(F.col("_radius")))
    cells = reach.withColumn("_level", level).withColumn(
        "_cell",
        F.explode(G.cells_in_radius(F.col("origin_lat"), F.col("origin_lon"), F.col("_radius"), F.col("_level"))),
    )
    pairs = cells.join(_indexed(facilities), "_cell").withColumn(
        "straight_km",
        G.haversine_km(F.col("origin_lat"), F.col("origin_lon"), F.col("dest_lat"), F.col("dest_lon")),
    )
    near = F.col("straight_km") < F.col("_radius") if strict else F.col("straight_km") <= F.col("_radius")
    return pairs.filter(near | (F.col("_radius") >= HALF_WORLD_KM)).drop("_cell", "_level", "_radius")


SPOT = ["origin_lat", "origin_lon"]


def within_own_radius(origins: DataFrame, facilities: DataFrame, radius: Column, strict: bool) -> DataFrame:
    """``within_radius`` where many origins may share a spot: a spot is searched once, as far as its widest origin.

    Origins that search the whole world are searched on their own, so that they widen no other's circle.
    """
    reach = origins.withColumn("_own", F.least(radius, F.lit(HALF_WORLD_KM)))
    some = reach.filter(F.col("_own") < HALF_WORLD_KM)
    spots = some.groupBy(*SPOT).agg(F.max("_own").alias("_widest"))
    found = within_radius(spots, facilities, F.col("_widest"), strict).drop("_widest")
    near = F.col("straight_km") < F.col("_own") if strict else F.col("straight_km") <= F.col("_own")
    world = within_radius(reach.filter(F.col("_own") >= HALF_WORLD_KM), facilities, F.col("_own"), strict)
    return some.join(found, SPOT).filter(near).unionByName(world).drop("_own")


def nearest_candidates(origins: DataFrame, facilities: DataFrame, k: int = V.ROUTE_INITIAL_CANDIDATES) -> DataFrame:
    """The k nearest facilities of each origin by straight line, ties by id.

    ``origins``: region_key, origin_lat, origin_lon; ``facilities``: entity_id,
    dest_lat, dest_lon.  Of facilities on one spot only the k smallest ids can
    be among k nearest, so a spot shared by many is cut to k before the join.
    Origins on one spot have the same candidates, which are searched once.
    """
    reduced = top_per_group(facilities, ["dest_lat", "dest_lon"], [F.col("entity_id")], k, "_n").drop("_n")
    levelled = _search_level(origins.select(*SPOT).distinct(), reduced, k)
    radius = F.when(F.col("level") == 0, F.lit(HALF_WORLD_KM)).otherwise(
        G.cell_degrees(F.col("level")) * (BLOCK_REACH * G.KM_PER_DEGREE)
    )
    pairs = within_radius(levelled, reduced, radius, strict=False).drop("level")
    return origins.join(top_per_group(pairs, SPOT, [F.col("straight_km"), F.col("entity_id")], k), SPOT)


def evaluated_candidates(
    origins: DataFrame, facilities: DataFrame, attach_route, initial: int = V.ROUTE_INITIAL_CANDIDATES
) -> DataFrame:
    """The candidates that have to be looked up before the nearest by road is proven.

    ``attach_route`` adds road_km, eta_min, route_status to origin-facility rows.
    Rank order is (straight_km, entity_id); a candidate past the first ``initial``
    is evaluated while its straight distance is below the best road before it.
    The facilities inside the first best road are a superset of those, and
    because straight distances only grow and the best road only falls, the
    running minimum decides each of them exactly.  An origin whose first
    candidates have no road is searched again with four times as many until one
    has; only an origin that no facility can be reached from meets them all,
    which is what its proof takes.
    """
    if not 1 <= initial <= 30:
        raise ValueError("initial candidates must be 1..30")
    valid = valid_route()

    def found(some: DataFrame, k: int) -> DataFrame:
        rows = attach_route(nearest_candidates(some, facilities, k).drop("rank"))
        return cut_lineage(rows.groupBy("region_key").agg(F.min(F.when(valid, F.col("road_km"))).alias("_best"), F.max("straight_km").alias("_seen")))

    k, total = initial, facilities.count()
    best = found(origins, k)
    while k < total and not (open_rows := best.filter("_best is null")).isEmpty():
        k *= 4
        again = found(origins.join(open_rows.select("region_key"), "region_key", "left_semi"), k)
        best = best.filter("_best is not null").unionByName(again)
    reach = origins.join(best, "region_key").withColumn(
        "_circle", F.greatest(F.coalesce("_best", F.lit(HALF_WORLD_KM)), F.col("_seen") * (1 + 1e-12) + 1e-9)
    )
    inside = within_own_radius(reach, facilities, F.col("_circle"), strict=False).drop("_best", "_seen", "_circle")
    by = Window.partitionBy("region_key").orderBy("straight_km", "entity_id")
    ranked = attach_route(inside).withColumn("rank", F.row_number().over(by))
    before = F.min(F.when(valid, F.col("road_km"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return (
        ranked.withColumn("_bar", before)
        .filter((F.col("rank") <= initial) | F.col("_bar").isNull() | (F.col("straight_km") < F.col("_bar")))
        .drop("_bar")
    )


def valid_route() -> Column:
    road = F.col("road_km")
    return F.coalesce(
        F.col("route_status").isin(V.ROUTE_OK, V.ROUTE_OK_ZERO) & road.isNotNull() & (road >= 0) & ~F.isnan(road),
        F.lit(False),
    )


def best_by_road(candidates: DataFrame) -> DataFrame:
    """Shortest road per region, first in rank order on ties."""
    usable = candidates.filter(valid_route() & F.col("eta_min").isNotNull())
    return keep_first(usable, ["region_key"], [F.col("road_km"), F.col("rank")])


def proof_violations(
    evaluated: DataFrame, facilities: DataFrame, origins: DataFrame, keep: str = "entity_id"
) -> DataFrame:
    """Why the chosen road is not proven shortest: (check, key, detail), empty when proven."""
    ok = valid_route()
    best = evaluated.groupBy("region_key").agg(F.min(F.when(ok, F.col("road_km"))).alias("best"))
    none = best.filter("best is null").select(
        F.lit("no_road").alias("check"), F.col("region_key").cast("string").alias("key"), F.lit(None).cast("string").alias("detail")
    )
    confirmed = F.coalesce(F.col("route_code").isin(V.ROUTE_CONFIRMED_NONE_CODES), F.lit(False)) & ~F.coalesce(
        F.col("route_status").isin(V.ROUTE_OK, V.ROUTE_OK_ZERO), F.lit(False)
    )
    proven = best.filter("best is not null")
    open_rows = evaluated.join(proven, "region_key").filter((F.col("straight_km") < F.col("best")) & ~ok & ~confirmed)
    uncertain = open_rows.select(
        F.lit("uncertain_failure").alias("check"), F.col("region_key").cast("string").alias("key"), F.col(keep).cast("string").alias("detail")
    )
    circle = origins.join(proven, "region_key")
    near = within_own_radius(circle, facilities, F.col("best"), strict=True)
    unseen = near.join(evaluated.select("region_key", keep), ["region_key", keep], "left_anti").select(
        F.lit("not_evaluated").alias("check"), F.col("region_key").cast("string").alias("key"), F.col(keep).cast("string").alias("detail")
    )
    return none.unionByName(uncertain).unionByName(unseen)


def local_facilities(origins: DataFrame, facilities: DataFrame) -> DataFrame:
    """Facilities of the origin's own region with their straight distance."""
    return origins.join(facilities, "region_key").withColumn(
        "straight_km",
        G.haversine_km(F.col("origin_lat"), F.col("origin_lon"), F.col("dest_lat"), F.col("dest_lon")),
    )


def route_key(olat: Column, olon: Column, dlat: Column, dlon: Column) -> Column:
    return F.sha2(F.format_string(V.ROUTE_SCHEMA_VERSION + "|%.7f,%.7f|%.7f,%.7f", olon, olat, dlon, dlat), 256)


def origin_key(region: Column, lat: Column, lon: Column, method: Column, version: Column) -> Column:
    return F.sha2(F.format_string("%s|%.7f,%.7f|%s|%s", region, lon, lat, method, F.coalesce(version, F.lit(""))), 256)


def cache_fresh(collected: Column, reference: Column, ttl_days: int = V.ROUTE_TTL_DAYS) -> Column:
    """Zone-aware stamp with 0 <= age <= ttl, both ends included."""
    if not 1 <= ttl_days <= 3650:
        raise ValueError("ttl_days must be 1..3650")
    text = F.trim(collected.cast("string"))
    at = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))
    return F.coalesce((at <= reference) & (at >= reference - hours(24.0 * ttl_days)), F.lit(False))


def reusable_routes(stored: list[DataFrame], reference: Column, ttl_days: int = V.ROUTE_TTL_DAYS) -> DataFrame:
    """Successful fresh routes per key; a later table wins."""
    fields = ["route_key", "road_km", "eta_min", "route_code", "route_status", "collected_ts"]
    union = None
    for turn, df in enumerate(stored):
        good = df.filter(
            valid_route() & F.col("eta_min").isNotNull() & cache_fresh(F.col("collected_ts"), reference, ttl_days)
        ).select(*fields, F.lit(turn).alias("_turn"))
        union = good if union is None else union.unionByName(good)
    return keep_last(union, ["route_key"], ["_turn", "collected_ts", "road_km", "eta_min"]).drop("_turn")


def eligible_facilities(facilities: DataFrame, grade: str = "grade", pattern: str = V.ROUTE_TARGET_PATTERN) -> DataFrame:
    """Facilities that may be a destination, by their grade; one without a grade may not."""
    return facilities.filter(F.coalesce(F.col(grade).cast("string").rlike(pattern), F.lit(False)))


def attach_results(tasks: DataFrame, cache: DataFrame) -> DataFrame:
    """Route results by request key; a task without one keeps its row with empty fields.

    ``cache`` has one row per key (``reusable_routes``).
    """
    fields = [c for c in ("road_km", "eta_min", "route_code", "route_status", "collected_ts") if c in cache.columns]
    kept = [c for c in tasks.columns if c not in fields]
    return tasks.select(*kept).join(cache.select("route_key", *fields), "route_key", "left").select(*kept, *fields)


def pending_routes(tasks: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct route keys that still have to be looked up."""
    return tasks.select("route_key").distinct().join(cache.select("route_key"), "route_key", "left_anti")


def reusable_origins(base: DataFrame, cached: DataFrame, reference: Column, ttl_days: int = V.ROUTE_TTL_DAYS) -> DataFrame:
    """Base origins flagged as reusable when input key, success and age all hold."""
    side = cached.select("region_key", F.col("origin_key").alias("_k"), F.col("probe_status").alias("_s"), F.col("collected_ts").alias("_t"))
    same = (F.col("_k") == F.col("origin_key")) & (F.col("_s") == V.ROUTE_OK) & cache_fresh(F.col("_t"), reference, ttl_days)
    return base.join(side, "region_key", "left").withColumn("reusable", F.coalesce(same, F.lit(False))).drop("_k", "_s", "_t")


def distance_basis(df: DataFrame) -> DataFrame:
    """Distance shown to users: the road if usable, else the straight line, else nothing."""
    road, eta, straight = number("road_km"), number("eta_min"), number("straight_km")
    has_road = F.coalesce(F.col("route_status").isin(V.ROUTE_OK, V.ROUTE_OK_ZERO), F.lit(False)) & road.isNotNull() & eta.isNotNull()
    return (
        df.withColumn("distance_km", F.when(has_road, road).otherwise(straight))
        .withColumn("shown_eta_min", F.when(has_road, eta))
        .withColumn(
            "distance_basis",
            F.when(has_road, V.BASIS_ROAD).when(straight.isNotNull(), V.BASIS_STRAIGHT).otherwise(V.BASIS_NONE),
        )
    )


def probe_points(origins: DataFrame, local: DataFrame) -> DataFrame:
    """Points to try as road-connected origins: base, 8 compass points at 1 km, 3 towards the nearest facility.

    Emits (region_key, turn, lat, lon); keep those inside the region with
    ``polygons.points_in_polygons`` and drop repeats at seven decimals there.
    """
    nearest = keep_first(
        local_facilities(origins, local).select("region_key", "entity_id", "straight_km", "dest_lat", "dest_lon"),
        ["region_key"], [F.col("straight_km"), F.col("entity_id")],
    ).select("region_key", "dest_lat", "dest_lon")
    lat, lon = F.col("origin_lat"), F.col("origin_lon")
    km_north = 1 / V.KM_PER_LATITUDE
    km_east = 1 / (V.KM_PER_LATITUDE * F.greatest(F.cos(F.radians(lat)), F.lit(V.LEAST_LONGITUDE_COSINE)))
    points = [(lat + north * km_north, lon + east * km_east) for east, north in [(0, 0), *V.PROBE_MOVES]]
    points += [
        (lat + (F.col("dest_lat") - lat) * part, lon + (F.col("dest_lon") - lon) * part) for part in V.PROBE_PARTS
    ]
    structs = F.array(
        *[F.struct(F.lit(i).alias("turn"), a.alias("lat"), b.alias("lon")) for i, (a, b) in enumerate(points)]
    )
    rows = origins.join(nearest, "region_key", "left").select("region_key", F.inline(structs)).filter(
        "lat is not null and lon is not null"
    )
    spot = rows.withColumn("_a", F.round("lat", 7)).withColumn("_b", F.round("lon", 7))
    return keep_first(spot, ["region_key", "_a", "_b"], [F.col("turn")]).drop("_a", "_b")
