"""Manifest of a matching run and the contracts of whole tables, over the driver tables.

Customers play the facilities, orders the catalogue.  Defects are seeded by rules on the keys
of whole tables; every finding is returned and the SQL names each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardscope.functions import fixed_values as V
from wardscope.operators import contract as C
from wardscope.operators import manifest as MF
from wardscope.operators import matching as M
from wardscope.operators import missingness as MS
from wardscope.operators import publication as PUB
from wardscope.plans import bindings as B
from wardscope.plans.registry import query, table, with_ctes
from wardscope.session import fresh_path
from wardscope.sources import readers as R

TARGET = 20

RUN_SQL = f"""
run AS (
  SELECT entity_id, entity_id::BIGINT AS k, name, province, district,
    CASE WHEN k10 = 0 THEN '{V.STATE_MANUAL}' WHEN k10 = 9 THEN '{V.STATE_EXCLUDED}' WHEN k10 = 8 AND c_nationkey % 2 = 0 THEN '{V.STATE_LOW}' ELSE '{V.STATE_AUTOMATIC}' END AS match_state
  FROM (SELECT m.*, c_nationkey, c_custkey % 10 AS k10 FROM master m JOIN customer ON entity_id = c_custkey::VARCHAR)),
detail AS (SELECT *, match_state IN ('{V.STATE_MANUAL}', '{V.STATE_AUTOMATIC}') AS hit FROM run),
staff AS (SELECT province, district, count(*) AS n_total, count(*) FILTER (hit) AS n_matched, count(*) FILTER (k % 10 = 9) AS n_excluded FROM detail GROUP BY 1, 2),
gaps AS (SELECT *, greatest(ceil(n_total::DOUBLE * {V.QUALITY_RATE}::DOUBLE)::BIGINT - n_matched, 0) AS need FROM staff WHERE n_matched::DOUBLE / n_total::DOUBLE < {V.QUALITY_RATE}::DOUBLE),
counters AS (
  UNPIVOT (SELECT count(*) FILTER (hit)::DOUBLE AS matched, count(*) FILTER (match_state = '{V.STATE_AUTOMATIC}')::DOUBLE AS automatic, count(*) FILTER (match_state = '{V.STATE_MANUAL}')::DOUBLE AS manual,
    count(*) FILTER (NOT hit)::DOUBLE AS deferred, coalesce(sum(k % 4) FILTER (hit), 0)::DOUBLE AS specialist_total, count(*) FILTER (k % 10 = 9)::DOUBLE AS excluded,
    count(*) FILTER (NOT hit AND k % 10 <> 9)::DOUBLE AS algorithmic_deferred, (SELECT count(*) FROM staff)::DOUBLE AS regional_rows,
    (SELECT count(*) FROM staff WHERE n_matched::DOUBLE / n_total::DOUBLE >= {V.QUALITY_RATE}::DOUBLE)::DOUBLE AS usable_regions,
    (SELECT count(*) FROM orders)::DOUBLE AS catalog_rows, {TARGET}::DOUBLE AS target_usable_regions FROM detail) ON COLUMNS(*) INTO NAME name VALUE value)
"""


def run_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(match table, staffing, exclusion ledger, catalogue) of a run without defects."""
    k = F.col("entity_id").cast("bigint")
    nation = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("entity_id"), "c_nationkey")
    turn = k % 10
    state = (
        F.when(turn == 0, V.STATE_MANUAL).when(turn == 9, V.STATE_EXCLUDED)
        .when((turn == 8) & (F.col("c_nationkey") % 2 == 0), V.STATE_LOW).otherwise(V.STATE_AUTOMATIC)
    )
    detail = B.master(spark, sf).join(nation, "entity_id").withColumn("match_state", state)
    hit = F.col("match_state").isin(V.MATCHED_STATES)
    detail = detail.withColumn("catalog_id", F.when(hit, F.concat(F.lit("id"), "entity_id"))).withColumn(
        "specialists", F.when(hit, (k % 4).cast("double"))
    ).withColumn("match_score", F.when(hit, F.lit(1.0)))
    ledger = detail.filter(k % 10 == 9).select(
        "entity_id", F.concat("name", F.lit(" ")).alias("name"), F.lit("closed").alias("reason_code"), F.concat(F.lit("r"), (k % 3).cast("string")).alias("reason"),
        F.concat(F.lit("old"), "entity_id").alias("catalog_id"), F.concat(F.lit("https://x/"), "entity_id").alias("evidence_url"), F.lit("2026-01-02").alias("confirmed_on"),
    )
    return detail, MS.staffing_by_region(detail), ledger, table(spark, sf, "orders").select("o_orderkey")


def _manifest(spark: SparkSession, sf: str) -> tuple[dict[str, DataFrame], tuple]:
    k = F.col("entity_id").cast("bigint")
    run = run_tables(spark, sf)
    detail = run[0]
    before = detail.withColumn("match_state", F.when(k % 3 != 0, V.STATE_AUTOMATIC).otherwise(V.STATE_LOW))
    return MF.build_manifest(*run, TARGET, before), run


@query(
    "q87_manifest",
    with_ctes(
        B.PLACES_SQL, B.MASTER_SQL, RUN_SQL,
        select="""
SELECT 'counter' AS part, name AS key, value::BIGINT::VARCHAR AS value FROM counters
UNION ALL SELECT 'manual', entity_id, NULL FROM detail WHERE k % 10 = 0
UNION ALL SELECT 'exclusion', entity_id, concat_ws(',', name, 'closed', 'r' || (k % 3), 'old' || k, 'https://x/' || k, '2026-01-02') FROM detail WHERE k % 10 = 9
UNION ALL SELECT 'transition', entity_id, NULL FROM detail WHERE k % 10 = 9 AND k % 3 <> 0
UNION ALL SELECT 'gap', province || '|' || district, concat_ws(',', n_total, n_matched, need) FROM gaps
UNION ALL SELECT 'gap_code', province || '|' || district, entity_id FROM detail JOIN gaps USING (province, district) WHERE k % 10 = 9""",
    ),
)
def manifest(spark: SparkSession, sf: str) -> DataFrame:
    parts, _ = _manifest(spark, sf)
    place, none = F.concat_ws("|", "province", "district"), F.lit(None).cast("string")
    shown = {
        "counter": ("counters", F.col("name"), F.col("value").cast("bigint").cast("string")), "manual": ("manual", F.col("entity_id"), none),
        "exclusion": ("exclusions", F.col("entity_id"), F.concat_ws(",", *MF.LEDGER[1:])), "transition": ("transitions", F.col("entity_id"), none),
        "gap": ("gaps", place, F.concat_ws(",", *[F.col(c).cast("string") for c in MF.GAP])), "gap_code": ("gap_codes", place, F.col("entity_id")),
    }
    return C.union_all([parts[t].select(F.lit(part).alias("part"), key.alias("key"), value.alias("value")) for part, (t, key, value) in shown.items()])


# seeded: one counter raised, one left out, a catalogue of five rows, hand matches, reasons, transitions, needs and gap codes changed
@query(
    "q88_manifest_contract",
    with_ctes(
        B.PLACES_SQL, B.MASTER_SQL, RUN_SQL,
        """codes AS (SELECT province, district, count(*) FILTER (k % 10 = 9 AND k % 30 <> 9) AS n FROM detail GROUP BY 1, 2)""",
        select="""
SELECT 'manifest_counter' AS "check", 'matched' AS key, 'value' AS detail
UNION ALL SELECT 'manifest_counter', 'usable_regions', 'not_stored'
UNION ALL SELECT 'manifest_counter', 'catalog_rows', 'value'
UNION ALL SELECT 'manifest_catalog_size', 'catalog_rows', '5.0'
UNION ALL SELECT 'manifest_manual', entity_id, 'only_right' FROM detail WHERE k % 70 = 0
UNION ALL SELECT 'manifest_exclusion', entity_id, 'reason' FROM detail WHERE k % 50 = 9
UNION ALL SELECT 'manifest_transition', entity_id, 'unknown' FROM detail WHERE k % 100 = 1
UNION ALL SELECT 'manifest_gap', province || '|' || district, 'additional_needed' FROM gaps WHERE n_total % 2 = 0
UNION ALL SELECT 'manifest_gap_code', province || '|' || district || '|' || entity_id, 'only_right' FROM detail JOIN gaps USING (province, district) WHERE k % 30 = 9
UNION ALL SELECT 'manifest_gap_unexplained', province || '|' || district, (need + CASE WHEN n_total % 2 = 0 THEN n_total ELSE 0 END)::VARCHAR FROM gaps JOIN codes USING (province, district)
  WHERE need + CASE WHEN n_total % 2 = 0 THEN n_total ELSE 0 END > n""",
    ),
)
def manifest_contract(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("entity_id").cast("bigint")
    good, (detail, staffing, ledger, catalog) = _manifest(spark, sf)
    name = F.col("name")
    bad = {
        **good,
        "counters": good["counters"].filter(name != "usable_regions").withColumn(
            "value", F.when(name == "matched", F.col("value") + 1).when(name == "catalog_rows", 5.0).otherwise(F.col("value"))
        ),
        "manual": good["manual"].filter(k % 70 != 0),
        "exclusions": good["exclusions"].withColumn("reason", F.when(k % 50 == 9, "other").otherwise(F.col("reason"))),
        "transitions": good["transitions"].unionByName(detail.filter(k % 100 == 1).select("entity_id")),
        "gaps": good["gaps"].withColumn("additional_needed", F.col("additional_needed") + F.when(F.col("n_total") % 2 == 0, F.col("n_total")).otherwise(0)),
        "gap_codes": good["gap_codes"].filter(k % 30 != 9),
    }
    return MF.manifest_contract(bad, detail, staffing, ledger, catalog, detail, TARGET)


# seeded: other ids, ranks with a hole, old logic, unreadable stamps, excluded ids that come back, ledgers, reviews and queues with holes
@query(
    "q89_match_contract",
    with_ctes(
        B.PLACES_SQL, B.MASTER_SQL, RUN_SQL,
        "review AS (SELECT * FROM detail WHERE (k % 10 <> 0 OR k % 200 = 0) AND k % 130 <> 19)",
        select=f"""
SELECT 'selected_is_automatic' AS "check", entity_id AS key, 'catalog_id' AS detail FROM detail WHERE k % 40 = 1
UNION ALL SELECT 'review_prefix', entity_id, '2' FROM detail WHERE k % 60 = 2
UNION ALL SELECT 'review_logic', entity_id || '|1', 'v0' FROM detail WHERE k % 80 = 3
UNION ALL SELECT 'review_stamp', entity_id || '|' || r, 'bad' FROM detail, (VALUES (1), (2)) t(r) WHERE k % 80 = 4
UNION ALL SELECT 'excluded_id_reviewed', 'old' || k, 'in_both' FROM review WHERE k % 90 = 9 AND k % 110 <> 9
UNION ALL SELECT 'manual_is_ledger', entity_id, 'only_right' FROM detail WHERE k % 50 = 0
UNION ALL SELECT 'excluded_is_ledger', entity_id, 'only_right' FROM detail WHERE k % 110 = 9
UNION ALL SELECT 'excluded_without_review', entity_id, 'unknown' FROM detail WHERE k % 130 = 19 AND k % 110 <> 9
UNION ALL SELECT 'review_population', entity_id, 'only_right' FROM detail WHERE k % 130 = 19
UNION ALL SELECT 'review_population', entity_id, 'only_left' FROM detail WHERE k % 200 = 0
UNION ALL SELECT 'review_of_manual', entity_id, 'in_both' FROM detail WHERE k % 200 = 0
UNION ALL SELECT 'excluded_has_candidate', entity_id, 'in_both' FROM review WHERE k % 70 = 29
UNION ALL SELECT 'review_queues:cover', entity_id, 'only_right' FROM detail WHERE NOT hit AND k % 140 = 8
UNION ALL SELECT 'staffing', province || '|' || district, 'n_matched' FROM staff WHERE n_total % 2 = 1""",
    ),
)
def match_contract(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("entity_id").cast("bigint")
    detail, staffing, ledger, _ = run_tables(spark, sf)
    state = F.col("match_state")
    automatic = state == V.STATE_AUTOMATIC
    first = detail.filter(((k % 10 != 0) | (k % 200 == 0)) & (k % 130 != 19))
    text = k.cast("string")
    found = (
        F.when(k % 40 == 1, F.concat(F.lit("zz"), text)).when(k % 90 == 9, F.concat(F.lit("old"), text))
        .when(automatic, F.col("catalog_id")).otherwise(F.concat(F.lit("x"), text))
    )
    rank = F.explode(F.when((k % 2 == 0) & (k % 10 != 0), F.when(k % 60 == 2, F.array(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(1), F.lit(2)))).otherwise(F.array(F.lit(1))))
    top = F.col("rank") == 1
    review = first.select("*", rank.alias("rank")).select(
        "entity_id", "rank", F.when(top, found).otherwise(F.concat(F.lit("y"), text)).alias("catalog_id"), F.lit(1.0).alias("match_score"),
        (top & (automatic | (k % 70 == 29))).alias("gate_passed"), F.lit(True).alias("facility_matches"), (top & automatic).alias("selected"),
        F.when(k % 80 == 3, "v0").otherwise("v1").alias("logic_version"), F.when(k % 80 == 4, "bad").otherwise("2026-01-02T00:00:00Z").alias("collected_ts"),
        F.lit("list").alias("evidence"),
    )
    none, rest = M.review_queues(detail)
    stored = staffing.withColumn("n_matched", F.col("n_matched") + F.col("n_total") % 2)
    overrides = detail.filter((k % 10 == 0) & (k % 50 != 0)).select("entity_id")
    return PUB.match_contract(detail, detail, review, stored, none, rest.filter(k % 140 != 8), "v1", overrides, ledger.filter(k % 110 != 9), "list")


@query(
    "q90_master_and_ledger",
    with_ctes(
        B.PLACES_SQL, B.MASTER_SQL, "m AS (SELECT entity_id, entity_id::BIGINT AS k FROM master)",
        select="""
SELECT 'master_lat' AS "check", entity_id AS key FROM m, (VALUES (1), (2)) t(r) WHERE k % 25 = 0 AND (r = 1 OR k % 45 = 4)
UNION ALL SELECT 'master_region', entity_id FROM m, (VALUES (1), (2)) t(r) WHERE k % 35 = 3 AND (r = 1 OR k % 45 = 4)
UNION ALL SELECT 'master_id', entity_id FROM m WHERE k % 45 = 4
UNION ALL SELECT 'master_count', 'count' FROM (SELECT count(*) AS n FROM m) WHERE n <> 1
UNION ALL SELECT 'master_regions', 'count'
UNION ALL SELECT 'region_ledger_name', entity_id FROM m WHERE k % 16 = 0 AND k % 64 <> 0
UNION ALL SELECT 'region_ledger_url', CASE WHEN k % 64 = 0 THEN 'X' ELSE '' END || entity_id FROM m WHERE k % 24 = 0
UNION ALL SELECT 'region_ledger_date', CASE WHEN k % 64 = 0 THEN 'X' ELSE '' END || entity_id FROM m WHERE k % 32 = 0
UNION ALL SELECT 'region_ledger_no_change', CASE WHEN k % 64 = 0 THEN 'X' ELSE '' END || entity_id FROM m WHERE k % 56 = 0
UNION ALL SELECT 'region_ledger_address', entity_id FROM m WHERE k % 64 <> 0 AND (k % 40 = 0 OR k % 56 = 0)
UNION ALL SELECT 'region_ledger_unknown', 'X' || entity_id FROM m WHERE k % 64 = 0""",
    ),
)
def master_and_ledger(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("entity_id").cast("bigint")
    clean = B.master(spark, sf).withColumn("lat", B.spread_lat(k)).withColumn("lon", B.spread_lon(k))
    clean = clean.withColumn("address", F.when(k % 40 == 0, "elsewhere").otherwise("was here"))
    broken = clean.withColumn("lat", F.when(k % 25 == 0, 10.0).otherwise(F.col("lat"))).withColumn("district", F.when(k % 35 == 3, " ").otherwise(F.col("district")))
    same, unknown = k % 56 == 0, k % 64 == 0
    ledger = clean.filter(k % 8 == 0).select(
        F.when(unknown, F.concat(F.lit("X"), "entity_id")).otherwise(F.col("entity_id")).alias("entity_id"), F.when(k % 16 == 0, "other").otherwise(F.col("name")).alias("name"),
        F.when(same, F.col("province")).otherwise("was").alias("from_province"), F.when(same, F.col("district")).otherwise("was").alias("from_district"), "province", "district",
        F.when(k % 24 == 0, "http://x").otherwise("https://x").alias("evidence_url"), F.when(k % 32 == 0, "2026-1-2").otherwise("2026-01-02").alias("confirmed_on"),
    )
    master = broken.unionByName(broken.filter(k % 45 == 4))
    return PUB.master_contract(master, 1, 1).unionByName(PUB.region_ledger_contract(ledger, clean)).select("check", "key")


@query(
    "q91_snapshot_and_residents",
    with_ctes(
        B.PLACES_SQL, B.MASTER_SQL, "m AS (SELECT entity_id, entity_id::BIGINT AS k FROM master)",
        select="""
SELECT 'snapshot_population' AS "check", entity_id AS key FROM m WHERE k % 30 = 0
UNION ALL SELECT 'snapshot_answers', 'count'
UNION ALL SELECT 'snapshot_usable', 'count'
UNION ALL SELECT 'snapshot_stamp', entity_id FROM m WHERE k % 30 <> 0 AND k % 20 = 1 AND k % 9 <> 0
UNION ALL SELECT 'snapshot_range', entity_id FROM m WHERE k % 30 <> 0 AND k % 25 = 2
UNION ALL SELECT 'resident_population', region_key FROM places WHERE n_nationkey % 11 = 10
UNION ALL SELECT 'resident_positive', region_key FROM places WHERE n_nationkey % 11 <> 10 AND n_nationkey % 5 = 0
UNION ALL SELECT 'resident_code', region_key FROM places WHERE n_nationkey % 11 <> 10 AND n_nationkey % 6 = 1
UNION ALL SELECT 'resident_code_unique', '00099' FROM (SELECT count(*) AS n FROM places WHERE n_nationkey % 11 <> 10 AND n_nationkey % 6 <> 1 AND n_nationkey % 7 = 2) WHERE n > 1
UNION ALL SELECT 'resident_period', 'period'""",
    ),
)
def snapshot_and_residents(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("entity_id").cast("bigint")
    m, p = B.master(spark, sf), B.places(spark, sf)
    good = k % 9 != 0
    rows = m.filter(k % 30 != 0).select(
        "entity_id", F.when(good, 1.0).alias("available"), F.when(good, 2.0).alias("total"), F.when(k % 25 == 2, 150.0).otherwise(50.0).alias("saturation"),
        F.when(k % 20 == 1, "soon").otherwise("20260904083000").alias("source_ts"),
    )
    n = F.col("n_nationkey")
    residents = p.filter(n % 11 != 10).select(
        "province", "district", F.when(n % 5 == 0, 0.0).otherwise(10.0).alias("population"),
        F.when(n % 6 == 1, F.concat(F.lit("x"), n.cast("string"))).when(n % 7 == 2, "00099").otherwise(F.lpad((n + 100).cast("string"), 5, "0")).alias("admin_code"),
        F.when(n == 3, "202606").otherwise("202607").alias("period"),
    )
    found = PUB.snapshot_contract(rows, m, 1_000_000_000).unionByName(PUB.resident_contract(residents, p, "202607"))
    return found.select("check", "key")


ROUTE_SQL = f"""
r AS (
  SELECT o_orderkey AS k, o_custkey, CASE WHEN o_orderstatus = 'F' THEN '{V.ROUTE_OK}' ELSE 'failed' END AS status FROM orders)
"""


@query(
    "q92_route_rows",
    with_ctes(
        ROUTE_SQL,
        select=f"""
SELECT 'route_key' AS "check", k::VARCHAR AS key FROM r WHERE k % 50 = 0
UNION ALL SELECT 'route_straight', k::VARCHAR FROM r WHERE k % 60 = 1
UNION ALL SELECT 'route_success', k::VARCHAR FROM r WHERE status = '{V.ROUTE_OK}' AND k % 70 = 2
UNION ALL SELECT 'route_failure', k::VARCHAR FROM r WHERE status = 'failed' AND k % 80 = 3
UNION ALL SELECT 'route_code', k::VARCHAR FROM r WHERE status = '{V.ROUTE_OK}' AND k % 90 = 4
UNION ALL SELECT 'route_zero', k::VARCHAR FROM r WHERE status = '{V.ROUTE_OK}' AND k % 100 = 5 AND k % 70 <> 2
UNION ALL SELECT 'candidate_number', o_custkey::VARCHAR FROM r GROUP BY o_custkey HAVING count(*) > (SELECT count(*) FROM nation)""",
    ),
)
def route_rows(spark: SparkSession, sf: str) -> DataFrame:
    k, ok = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    digest = F.sha2(k.cast("string"), 256)
    road = F.when(ok, F.when(k % 70 == 2, -1.0).when(k % 100 == 5, 0.0).otherwise(3.0)).when(k % 80 == 3, 4.0)
    rows = table(spark, sf, "orders").select(
        k.cast("string").alias("id"), F.col("o_custkey").cast("string").alias("region_key"), F.when(k % 50 == 0, F.substring(digest, 1, 8)).otherwise(digest).alias("route_key"),
        F.when(k % 60 == 1, -2.0).otherwise(2.0).alias("straight_km"), road.alias("road_km"), F.when(ok, 5.0).alias("eta_min"),
        F.when(ok, F.when(k % 90 == 4, 7).otherwise(0)).alias("route_code"), F.when(ok, V.ROUTE_OK).otherwise("failed").alias("route_status"),
    )
    bounds = PUB.candidate_bounds_contract(rows.select("region_key"), table(spark, sf, "nation"))
    return PUB.route_rows_contract(rows, ["id"], "route").unionByName(bounds).select("check", "key")


@query(
    "q93_sources_and_gaps",
    with_ctes(
        B.PLACES_SQL, B.MASTER_SQL, RUN_SQL,
        select="""
SELECT 'quality_unexplained' AS "check", province || '|' || district AS key, need::VARCHAR AS detail FROM gaps WHERE need > n_excluded
UNION ALL SELECT 'boundary_source_level', 'level', 'sgg'
UNION ALL SELECT 'boundary_source_license', 'v1', 'none' FROM nation WHERE n_nationkey % 5 = 0
UNION ALL SELECT 'origin_population', region_key, 'only_right' FROM places WHERE n_nationkey % 7 = 1
UNION ALL SELECT 'origin_coordinate', region_key, NULL FROM places WHERE n_nationkey % 7 <> 1 AND n_nationkey % 6 = 0""",
    ),
)
def sources_and_gaps(spark: SparkSession, sf: str) -> DataFrame:
    detail, staffing, _, _ = run_tables(spark, sf)
    n = F.col("n_nationkey")
    source = table(spark, sf, "nation").select(
        F.when(n == 3, "town").otherwise("sgg").alias("level"), F.lit("EPSG:4326").alias("crs"), F.lit("light").alias("resolution"), F.lit("v1").alias("version"),
        F.when(n % 5 == 0, "none").otherwise("CC-BY-4.0").alias("license"), F.lit("SGIS 2026").alias("attribution"),
    )
    p = B.places(spark, sf)
    centres = p.filter(n % 7 != 1).select("province", "district", F.when(n % 6 == 0, "north").otherwise("36.5").alias("lat"), F.lit("127").alias("lon"))
    return C.union_all(
        [
            PUB.explained_quality_contract(staffing, detail), PUB.boundary_source_contract(source, "v1"),
            PUB.origins_from_table(centres, p.select("region_key"))[1],
        ]
    )


@query(
    "q94_positional_lines",
    """SELECT o_orderkey::VARCHAR AS c0, '상태 ' || o_orderstatus AS c1, CASE WHEN o_custkey % 3 = 0 THEN 'a, "b"' ELSE o_orderpriority END AS c2 FROM orders""",
)
def positional_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written as files in the Korean code page, each with a header line, and read by position."""
    key = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        key.cast("string").alias("key"), F.concat(F.lit("상태 "), "o_orderstatus").alias("state"),
        F.when(F.col("o_custkey") % 3 == 0, 'a, "b"').otherwise(F.col("o_orderpriority")).alias("note"),
    )
    path = fresh_path(spark, "lines")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    rows.write.option("header", True).option("encoding", R.KOREAN_CHARSET).csv(path)
    return R.read_positional(spark, path, 3, skip=0)
