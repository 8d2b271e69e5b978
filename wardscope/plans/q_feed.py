"""Feed, snapshot, missingness and contract queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardscope.functions import fixed_values as V
from wardscope.functions.scalars import load_status, saturation, usable
from wardscope.operators import contract as C
from wardscope.operators import missingness as M
from wardscope.operators import snapshot as N
from wardscope.operators.score import grade
from wardscope.plans import bindings as B
from wardscope.plans.registry import query, r6, table, with_ctes
from wardscope.session import cut_lineage

TS = "%Y-%m-%d %H:%M:%S"


def stamp(column: str, name: str | None = None):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(name or column)


# stamps written as floats, some impossible, some before and after the reference time
MASK_SQL = with_ctes(
    """raw AS (
  SELECT event_id, CASE WHEN event_id % 97 = 0 THEN '20240230090000' WHEN event_id % 89 = 0 THEN NULL
      WHEN event_id % 2 = 0 THEN strftime(ts + INTERVAL 9 HOUR, '%Y%m%d%H%M%S') || '.0' ELSE strftime(ts + INTERVAL 9 HOUR, '%Y%m%d%H%M%S') END AS source_ts,
    CASE WHEN event_id % 97 = 0 OR event_id % 89 = 0 THEN NULL ELSE date_trunc('second', ts) END AS s,
    date_trunc('second', ts) + ((event_id % 30) - 10) * INTERVAL 1 HOUR AS c FROM events)""",
    select="""
SELECT event_id, source_ts, strftime(s, '%Y-%m-%d %H:%M:%S') AS source_at,
  coalesce(s <= TIMESTAMP '2024-01-20 12:05:00', false) AS valid_now,
  coalesce(s <= TIMESTAMP '2024-01-20 12:05:00' AND s >= TIMESTAMP '2024-01-20 00:00:00', false) AS fresh_now,
  coalesce(s <= c + INTERVAL 5 MINUTE, false) AS valid_at_collection,
  coalesce(s <= c + INTERVAL 5 MINUTE AND s >= c - INTERVAL 12 HOUR, false) AS fresh_at_collection
FROM raw""",
)


@query("q19_validity_masks", MASK_SQL)
def validity_masks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    local = F.date_format(F.col("ts") + F.expr("INTERVAL 9 HOURS"), "yyyyMMddHHmmss")
    text = (
        F.when(F.col("event_id") % 97 == 0, "20240230090000")
        .when(F.col("event_id") % 89 == 0, None)
        .when(F.col("event_id") % 2 == 0, F.concat(local, F.lit(".0")))
        .otherwise(local)
    )
    second = F.date_trunc("second", F.col("ts").cast("timestamp"))
    rows = e.select(
        "event_id", text.alias("source_ts"),
        (second + F.make_dt_interval(F.lit(0), ((F.col("event_id") % 30) - 10).cast("int"))).cast("string").alias("collected_ts"),
    )
    masked = N.validity_masks(rows, "source_ts", "collected_ts", N.moment(B.NOW))
    return masked.select("event_id", "source_ts", stamp("source_at"), "valid_now", "fresh_now", "valid_at_collection", "fresh_at_collection")


@query(
    "q20_saturation_status",
    with_ctes(
        B.FEED_SQL,
        "s AS (SELECT event_id, available, total, CASE WHEN total > 0 AND available >= 0 THEN least(greatest((total - available) / nullif(total, 0) * 100, 0), 100) END AS saturation FROM feed_all)",
        select="""
SELECT event_id, round(available, 6) AS available, total, round(saturation, 6) AS saturation,
  CASE WHEN saturation IS NULL THEN '결측' WHEN saturation <= 50 THEN '여유' WHEN saturation <= 80 THEN '주의' ELSE '포화' END AS status FROM s""",
    ),
)
def saturation_status(spark: SparkSession, sf: str) -> DataFrame:
    a, t = F.col("available"), F.col("total")
    rows = B.feed_all(spark, sf).withColumn("saturation", F.when(usable(a, t), saturation(a, t)))
    return rows.select("event_id", r6("available"), "total", r6("saturation"), load_status(F.col("saturation")).alias("status"))


LAST_SQL = """
old_last AS (
  SELECT entity_id, available AS a, total AS t, source_ts, source_at, collected_at,
    total > 0 AND available >= 0 AND source_at <= TIMESTAMP '2024-01-20 12:05:00' AND source_at <= collected_at + INTERVAL 5 MINUTE
      AND collected_at <= TIMESTAMP '2024-01-20 12:05:00' AS ok,
    source_at >= TIMESTAMP '2024-01-20 00:00:00' AND source_at <= TIMESTAMP '2024-01-20 12:05:00' AS fresh
  FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id DESC) AS rn FROM feed_old) WHERE rn = 1),
new_last AS (
  SELECT entity_id, available AS a, total AS t, source_ts, source_at,
    source_at <= TIMESTAMP '2024-01-20 12:05:00' AS time_ok
  FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id DESC) AS rn FROM feed_new) WHERE rn = 1)
"""


@query(
    "q21_last_known_fallback",
    with_ctes(
        B.FEED_SQL, LAST_SQL,
        select="""
SELECT entity_id, round(CASE WHEN ok THEN a END, 6) AS available, CASE WHEN ok THEN t END AS total, source_ts,
  strftime(collected_at, '%Y-%m-%d %H:%M:%S') AS collected_ts, ok AS prev_ok, ok AND fresh AS prev_fresh FROM old_last""",
    ),
)
def last_known_fallback(spark: SparkSession, sf: str) -> DataFrame:
    rows = N.last_known(B.feed_old(spark, sf), N.moment(B.NOW), ["ts", "event_id"])
    return rows.select("entity_id", r6("available"), "total", "source_ts", stamp("collected_ts"), "prev_ok", "prev_fresh")


SNAP_SQL = """
decided AS (
  SELECT m.entity_id, m.name, m.grade, m.province, m.district, m.region_key, n.entity_id IS NOT NULL AS in_feed, o.entity_id IS NOT NULL AS has_prev,
    coalesce(o.ok, false) AS prev_ok, coalesce(o.ok AND o.fresh, false) AS prev_fresh, f.province IS NOT NULL AS region_failed,
    CASE WHEN n.entity_id IS NOT NULL THEN n.a WHEN o.ok THEN o.a END AS available,
    CASE WHEN n.entity_id IS NOT NULL THEN n.t WHEN o.ok THEN o.t END AS total,
    CASE WHEN n.entity_id IS NOT NULL THEN n.source_ts ELSE o.source_ts END AS source_ts,
    CASE WHEN n.entity_id IS NOT NULL THEN n.source_at ELSE o.source_at END AS source_at,
    CASE WHEN n.entity_id IS NOT NULL THEN TIMESTAMP '2024-01-20 12:00:00' ELSE o.collected_at END AS collected_at
  FROM master m LEFT JOIN new_last n USING (entity_id) LEFT JOIN old_last o USING (entity_id)
  LEFT JOIN failed f ON f.province = m.province AND f.district = m.district),
snap AS (
  SELECT *, CASE WHEN total > 0 AND available >= 0 THEN least(greatest((total - available) / nullif(total, 0) * 100, 0), 100) END AS saturation FROM decided),
snapshot AS (
  SELECT *, CASE WHEN saturation IS NULL THEN '결측' WHEN saturation <= 50 THEN '여유' WHEN saturation <= 80 THEN '주의' ELSE '포화' END AS status FROM snap)
"""
SNAP_PARTS = (B.PLACES_SQL, B.MASTER_SQL, B.FEED_SQL, B.FAILED_SQL, LAST_SQL, SNAP_SQL)


def merge_rows(spark: SparkSession, sf: str) -> DataFrame:
    now = N.moment(B.NOW)
    decisions = N.merge_decisions(
        B.master(spark, sf), B.feed_new(spark, sf), B.feed_old(spark, sf), B.failed_regions(spark, sf), now,
        ["ts", "event_id"], ["ts", "event_id"],
    )
    return N.merged_rows(decisions, now)


def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return N.snapshot_rows(merge_rows(spark, sf))


@query(
    "q22_snapshot_merge",
    with_ctes(
        *SNAP_PARTS,
        select="""
SELECT entity_id, name, grade, province, district, round(available, 6) AS available, total, round(saturation, 6) AS saturation, status, source_ts,
  strftime(collected_at, '%Y-%m-%d %H:%M:%S') AS collected_ts FROM snapshot""",
    ),
)
def snapshot_merge(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot(spark, sf).select(
        "entity_id", "name", "grade", "province", "district", r6("available"), "total", r6("saturation"), "status", "source_ts", stamp("collected_ts")
    )


AUDIT_SQL = """
SELECT (SELECT count(DISTINCT (province, district)) FROM master) AS requested_regions,
  count(DISTINCT CASE WHEN region_failed THEN region_key END) AS failed_regions,
  count(*) FILTER (in_feed) AS new_response, count(*) FILTER (saturation IS NOT NULL) AS usable,
  count(*) FILTER ((in_feed OR has_prev) AND NOT coalesce(source_at >= TIMESTAMP '2024-01-20 00:00:00', false)) AS stale_source,
  count(*) FILTER (region_failed) AS failed_region_entities, count(*) FILTER (region_failed AND has_prev) AS failed_candidates,
  count(*) FILTER (region_failed AND prev_fresh) AS failed_fresh, count(*) FILTER (region_failed AND prev_ok AND NOT prev_fresh) AS failed_stale,
  count(*) FILTER (region_failed AND prev_ok) AS failed_retained, count(*) FILTER (region_failed AND NOT prev_ok) AS failed_masked,
  count(*) FILTER (NOT region_failed AND NOT in_feed) AS omitted_entities, count(*) FILTER (NOT region_failed AND NOT in_feed AND has_prev) AS omitted_candidates,
  count(*) FILTER (NOT region_failed AND NOT in_feed AND prev_fresh) AS omitted_fresh,
  count(*) FILTER (NOT region_failed AND NOT in_feed AND prev_ok AND NOT prev_fresh) AS omitted_stale,
  count(*) FILTER (NOT region_failed AND NOT in_feed AND prev_ok) AS omitted_retained,
  count(*) FILTER (NOT region_failed AND NOT in_feed AND NOT prev_ok) AS omitted_masked,
  count(*) FILTER ((region_failed OR NOT in_feed) AND prev_ok) AS retained_total, count(*) FILTER ((region_failed OR NOT in_feed) AND NOT prev_ok) AS masked_total
FROM snapshot"""


@query("q23_snapshot_audit", with_ctes(*SNAP_PARTS, select=AUDIT_SQL))
def snapshot_audit(spark: SparkSession, sf: str) -> DataFrame:
    return N.snapshot_audit(merge_rows(spark, sf))


@query(
    "q24_history_append_trim",
    with_ctes(
        B.FEED_SQL,
        """both_h AS (
  SELECT entity_id, date_trunc('hour', collected_at) AS c, available, total, ts, event_id, 0 AS g FROM feed_old
  UNION ALL SELECT entity_id, date_trunc('hour', collected_at), available + 1, total, ts, event_id, 1 FROM feed_all WHERE ts >= TIMESTAMP '2024-01-18 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'),
h AS (SELECT *, row_number() OVER (PARTITION BY entity_id, c ORDER BY g DESC, ts DESC, event_id DESC) AS rn FROM both_h)""",
        select="""
SELECT entity_id, strftime(c, '%Y-%m-%d %H:%M:%S') AS collected_ts, round(available, 6) AS available, total FROM h
WHERE rn = 1 AND c >= TIMESTAMP '2024-01-13 12:00:00'""",
    ),
)
def history_append_trim(spark: SparkSession, sf: str) -> DataFrame:
    def hourly(df: DataFrame) -> DataFrame:
        return df.select("entity_id", F.date_trunc("hour", "collected_ts").alias("collected_ts"), "available", "total", "ts", "event_id")

    new = B.feed_all(spark, sf).filter((F.col("ts") >= "2024-01-18 00:00:00") & (F.col("ts") <= B.NOW))
    history = N.append_history(
        hourly(B.feed_old(spark, sf)), hourly(new).withColumn("available", F.col("available") + 1), ["ts", "event_id"]
    )
    kept = N.trim_history(history, "collected_ts", N.moment(B.NOW), 7)
    return kept.select("entity_id", stamp("collected_ts"), r6("available"), "total")


# a stored snapshot with defects: missing and unknown ids, a wrong formula, a future collection time
REUSE_SQL = with_ctes(
    *SNAP_PARTS,
    """stored AS (
  SELECT CASE WHEN entity_id::BIGINT % 401 = 1 THEN 'X' || entity_id ELSE entity_id END AS entity_id, available, total,
    CASE WHEN entity_id::BIGINT % 53 = 2 AND saturation IS NOT NULL THEN saturation + 1 ELSE saturation END AS saturation, source_at,
    CASE WHEN entity_id::BIGINT % 67 = 3 THEN collected_at + INTERVAL 2 DAY ELSE collected_at END AS c FROM snapshot),
rows_ AS (SELECT *, total > 0 AND available >= 0 AS vals, abs(saturation - least(greatest((total - available) / nullif(total, 0) * 100, 0), 100)) <= 1e-8 AND saturation BETWEEN 0 AND 100 AS fit FROM stored)""",
    select="""
SELECT 'missing_in_snapshot' AS "check", entity_id AS key FROM master WHERE entity_id NOT IN (SELECT entity_id FROM stored)
UNION ALL SELECT 'unknown_in_snapshot', entity_id FROM stored WHERE entity_id NOT IN (SELECT entity_id FROM master)
UNION ALL SELECT 'saturation_formula', entity_id FROM rows_ WHERE saturation IS NOT NULL AND NOT coalesce(vals AND fit, false)
UNION ALL SELECT 'collected_in_future', entity_id FROM rows_ WHERE c > TIMESTAMP '2024-01-20 12:05:00'""",
)


@query("q25_snapshot_reuse_check", REUSE_SQL)
def snapshot_reuse_check(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("entity_id").try_cast("bigint")
    stored = (
        snapshot(spark, sf)
        .withColumn("saturation", F.when((k % 53 == 2) & F.col("saturation").isNotNull(), F.col("saturation") + 1).otherwise(F.col("saturation")))
        .withColumn("collected_ts", F.when(k % 67 == 3, F.col("collected_ts") + F.expr("INTERVAL 2 DAYS")).otherwise(F.col("collected_ts")))
        .withColumn("entity_id", F.when(k % 401 == 1, F.concat(F.lit("X"), F.col("entity_id"))).otherwise(F.col("entity_id")))
    )
    return N.reuse_violations(B.master(spark, sf), cut_lineage(stored), N.moment(B.NOW)).select("check", "key")


REASON_SQL = """
reasons AS (
  SELECT *, CASE WHEN source_ts IS NULL THEN 'BED_API_NO_RESPONSE'
    WHEN NOT coalesce(source_at <= collected_at + INTERVAL 5 MINUTE AND source_at >= collected_at - INTERVAL 12 HOUR, false) THEN 'BED_SOURCE_STALE'
    WHEN total IS NULL OR total <= 0 THEN 'BED_TOTAL_MISSING' WHEN available IS NULL THEN 'BED_AVAILABLE_MISSING'
    WHEN available < 0 THEN 'BED_AVAILABLE_NEGATIVE' WHEN saturation IS NULL THEN 'BED_SATURATION_MISSING' END AS reason_code FROM snapshot)
"""


@query(
    "q26_missing_reason",
    with_ctes(
        *SNAP_PARTS, REASON_SQL,
        select="""
SELECT entity_id, region_key, reason_code, CASE WHEN reason_code IN ('BED_API_NO_RESPONSE', 'BED_SOURCE_STALE') THEN '가용병상|전체병상|포화율'
  WHEN reason_code = 'BED_TOTAL_MISSING' THEN '전체병상|포화율' WHEN reason_code = 'BED_SATURATION_MISSING' THEN '포화율' ELSE '가용병상|포화율' END AS missing_fields
FROM reasons WHERE reason_code IS NOT NULL""",
    ),
)
def missing_reason(spark: SparkSession, sf: str) -> DataFrame:
    # the snapshot is a published table: reasons are read from its written form
    return M.bed_issues(cut_lineage(snapshot(spark, sf))).select("entity_id", "region_key", "reason_code", "missing_fields")


REPORT_SQL = """
causes AS (
  SELECT region_key, string_agg(reason_code || ' ' || n || '건', ', ' ORDER BY reason_code) AS causes FROM (SELECT region_key, reason_code, count(*) AS n FROM reasons WHERE reason_code IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
checked AS (SELECT region_key, max(collected_at) AS seen_at FROM snapshot GROUP BY 1),
miss AS (SELECT region_key, district, risk, concat_ws(', ', CASE WHEN s_load IS NULL THEN '병상포화도점수' END, CASE WHEN s_access IS NULL THEN '접근성점수' END,
    CASE WHEN s_pop IS NULL THEN '인구대비병상점수' END, CASE WHEN s_staff IS NULL THEN '의료진부족점수' END) AS names FROM risks),
report AS (
  SELECT 'hospital_bed' AS entity_type, entity_id, region_key, reason_code, 'P1' AS priority, '' AS reason_text, coalesce(strftime(collected_at, '%Y-%m-%d %H:%M:%S'), '') AS checked FROM reasons WHERE reason_code IS NOT NULL
  UNION ALL
  SELECT 'region', m.region_key, m.region_key, 'REGION_COMPONENT_MISSING', 'P0', names || ' 결측' || coalesce('; 소속 병원 원인: ' || causes, ''), coalesce(strftime(seen_at, '%Y-%m-%d %H:%M:%S'), '')
  FROM miss m LEFT JOIN causes USING (region_key) LEFT JOIN checked USING (region_key) WHERE risk IS NULL)
"""
RISK_ONLY = B.RISK_SQL[B.RISK_SQL.index("beds AS") :]
REPORT_PARTS = (B.PLACES_SQL, B.MASTER_SQL, B.FEED_SQL, B.FAILED_SQL, LAST_SQL, SNAP_SQL, RISK_ONLY, REASON_SQL, REPORT_SQL)


def report(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    risk = B.region_risk(spark, sf)
    rows = cut_lineage(snapshot(spark, sf))
    return M.missingness_report(rows, risk), risk


@query(
    "q27_missing_report",
    with_ctes(*REPORT_PARTS, select="SELECT entity_type, entity_id, region_key, reason_code, priority, reason_text, checked FROM report"),
)
def missing_report(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = report(spark, sf)
    return rows.select(
        "entity_type", "entity_id", "region_key", "reason_code", "priority",
        F.when(F.col("entity_type") == "region", F.col("reason")).otherwise("").alias("reason_text"), F.col("source_checked_at").alias("checked"),
    )


@query(
    "q28_missing_summary",
    with_ctes(
        *REPORT_PARTS,
        select="""
SELECT 'total_open_items' AS kind, 'all' AS item, count(*) AS n, CAST(NULL AS DOUBLE) AS n_unscored FROM report
UNION ALL SELECT 'entity_type', entity_type, count(*), NULL FROM report GROUP BY 2
UNION ALL SELECT 'reason', reason_code, count(*), NULL FROM report WHERE entity_type <> 'region' GROUP BY 2
UNION ALL SELECT 'missing_component', c, count(*), NULL FROM (SELECT unnest(string_split(names, ', ')) AS c FROM miss) WHERE c <> '' GROUP BY 2
UNION ALL SELECT 'reason_by_state', reason_code, count(*), (count(*) FILTER (region_key IN (SELECT region_key FROM risks WHERE risk IS NULL)))::DOUBLE FROM report WHERE entity_type <> 'region' GROUP BY 2""",
    ),
)
def missing_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows, risk = report(spark, sf)
    stored = cut_lineage(rows)
    cross = M.reason_by_score_state(stored, risk).select(
        F.lit("reason_by_state").alias("kind"), F.col("reason_code").alias("item"), F.col("n_all").alias("n"), F.col("n_unscored").cast("double").alias("n_unscored")
    )
    return M.missingness_summary(stored, risk).withColumn("n_unscored", F.lit(None).cast("double")).unionByName(cross)


@query(
    "q29_contract_uniqueness",
    """
SELECT 'line_key' AS "check", l_orderkey || '|' || l_linenumber AS key, count(*)::VARCHAR AS detail FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'order_key', o_orderkey::VARCHAR, count(*)::VARCHAR FROM orders GROUP BY o_orderkey HAVING count(*) > 1
UNION ALL SELECT 'line_prefix', l_orderkey::VARCHAR, count(*)::VARCHAR FROM lineitem GROUP BY l_orderkey
  HAVING NOT (min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*))""",
)
def contract_uniqueness(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    orders = table(spark, sf, "orders").select("o_orderkey")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return C.union_all(
        [
            C.unique(lines, ["l_orderkey", "l_linenumber"], "line_key", tasks),
            C.unique(orders, ["o_orderkey"], "order_key", tasks),
            C.prefix_ranks(lines, ["l_orderkey"], "l_linenumber", "line_prefix", tasks),
        ]
    )


@query(
    "q30_contract_sets_formula",
    with_ctes(
        B.RISK_SQL,
        "stored AS (SELECT region_key, CASE WHEN district = 'NATION_3' THEN risk + 1 ELSE risk END AS risk, CASE WHEN district = 'NATION_4' THEN 9 ELSE risk_grade END AS risk_grade FROM risks WHERE district <> 'NATION_7')",
        select="""
SELECT 'risk_formula' AS "check", r.region_key AS key, concat_ws(',', CASE WHEN s.region_key IS NULL THEN 'not_stored' END,
  CASE WHEN s.region_key IS NOT NULL AND s.risk_grade IS DISTINCT FROM r.risk_grade THEN 'risk_grade' END,
  CASE WHEN s.region_key IS NOT NULL AND abs(s.risk - r.risk) > 1e-8 THEN 'risk' END) AS detail
FROM risks r LEFT JOIN stored s USING (region_key)
WHERE s.region_key IS NULL OR s.risk_grade IS DISTINCT FROM r.risk_grade OR abs(s.risk - r.risk) > 1e-8
UNION ALL SELECT 'risk_keys', region_key, 'only_right' FROM places WHERE region_key NOT IN (SELECT region_key FROM stored)
UNION ALL SELECT 'high_regions_known', region_key, 'in_both' FROM risks WHERE risk > 50
UNION ALL SELECT 'line_suppliers', s_suppkey::VARCHAR, 'unknown' FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1)
UNION ALL SELECT 'quantity_range', l_orderkey || '|' || l_linenumber, l_quantity::VARCHAR FROM lineitem WHERE l_quantity NOT BETWEEN 1 AND 49.5
UNION ALL SELECT 'status_domain', o_orderkey::VARCHAR, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('O', 'F')""",
    ),
)
def contract_sets_formula(spark: SparkSession, sf: str) -> DataFrame:
    risk = B.region_risk(spark, sf)
    stored = (
        risk.filter("district <> 'NATION_7'")
        .withColumn("risk", F.when(F.col("district") == "NATION_3", F.col("risk") + 1).otherwise(F.col("risk")))
        .withColumn("risk_grade", F.when(F.col("district") == "NATION_4", 9).otherwise(F.col("risk_grade")))
    )
    again = grade(risk.select("region_key", *V.RISK_WEIGHTS))
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    heavy = lines.filter("l_quantity = 50 and l_discount = 0.1").select(F.col("l_suppkey").alias("s_suppkey"))
    return C.union_all(
        [
            C.equal_tables(stored, again, ["region_key"], ["risk_grade"], ["risk"], "risk_formula"),
            C.same_set(stored, B.places(spark, sf), ["region_key"], "risk_keys"),
            C.disjoint(risk.filter("risk > 50"), B.places(spark, sf), ["region_key"], "high_regions_known"),
            C.subset(table(spark, sf, "supplier"), heavy, ["s_suppkey"], "line_suppliers"),
            C.in_range(lines, ["l_orderkey", "l_linenumber"], "l_quantity", 1, 49.5, "quantity_range"),
            C.in_domain(orders, ["o_orderkey"], "o_orderstatus", ["O", "F"], "status_domain"),
        ]
    )


# staffing detail: customers are the facilities, matched when their balance is positive, excluded below -900
STAFF_SQL = """
detail AS (
  SELECT entity_id, province, district, CASE WHEN c_acctbal > 2500 THEN '자동매칭' WHEN c_acctbal < -800 THEN 'HIRA원천불일치' ELSE '낮은유사도' END AS match_state,
    CASE WHEN c_acctbal > 2500 THEN CAST(c_custkey % 6 AS DOUBLE) END AS specialists
  FROM master JOIN customer ON entity_id = c_custkey::VARCHAR),
staffing AS (
  SELECT province, district, count(*) AS n_total, count(*) FILTER (match_state = '자동매칭') AS n_matched, count(specialists) AS n_known, sum(specialists) AS s FROM detail GROUP BY 1, 2)
"""


@query(
    "q31_quality_gap",
    with_ctes(
        B.PLACES_SQL, B.MASTER_SQL, STAFF_SQL,
        "ex AS (SELECT province, district, count(*) AS n FROM detail WHERE match_state = 'HIRA원천불일치' GROUP BY 1, 2)",
        select="""
SELECT s.province, s.district, n_total, n_matched, n_known, round(n_matched::DOUBLE / n_total, 6) AS match_rate,
  CASE WHEN n_matched::DOUBLE / n_total >= 0.8 THEN '사용가능' ELSE '검토필요' END AS quality, CASE WHEN n_matched::DOUBLE / n_total >= 0.8 THEN s.s END AS specialists,
  CASE WHEN n_matched::DOUBLE / n_total < 0.8 THEN greatest(ceil(n_total::DOUBLE * 0.8::DOUBLE)::BIGINT - n_matched, 0)::DOUBLE END AS additional_needed,
  CASE WHEN n_matched::DOUBLE / n_total < 0.8 THEN coalesce(n, 0)::DOUBLE END AS n_excluded,
  CASE WHEN n_matched::DOUBLE / n_total < 0.8 THEN greatest(ceil(n_total::DOUBLE * 0.8::DOUBLE)::BIGINT - n_matched, 0) <= coalesce(n, 0) END::VARCHAR AS explained
FROM staffing s LEFT JOIN ex ON ex.province = s.province AND ex.district = s.district""",
    ),
)
def quality_gap(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("entity_id"), "c_custkey", "c_acctbal")
    good = F.col("c_acctbal") > 2500
    state = F.when(good, V.STATE_AUTOMATIC).when(F.col("c_acctbal") < -800, V.STATE_EXCLUDED).otherwise(V.STATE_LOW)
    detail = B.master(spark, sf).join(c, "entity_id").select(
        "entity_id", "province", "district", state.alias("match_state"), F.when(good, (F.col("c_custkey") % 6).cast("double")).alias("specialists")
    )
    staffing = M.staffing_by_region(detail)
    gaps = M.quality_gaps(staffing, detail).select(
        "province", "district", F.col("additional_needed").cast("double").alias("additional_needed"),
        F.col("n_excluded").cast("double").alias("n_excluded"), F.col("explained").cast("string").alias("explained"),
    )
    return staffing.join(gaps, ["province", "district"], "left").withColumn("match_rate", F.round("match_rate", 6))
