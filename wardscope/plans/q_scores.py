"""Score, join, ledger and ranking queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardscope.functions import fixed_values as V
from wardscope.operators import joins as J
from wardscope.operators import score as S
from wardscope.operators import serving as D
from wardscope.operators import statistics as T
from wardscope.operators.dedupe import flag_duplicates, keep_last
from wardscope.plans import bindings as B
from wardscope.plans.registry import query, r6, table, with_ctes
from wardscope.session import cut_lineage

CUSTOMER_SCORE_SQL = with_ctes(
    B.PLACES_SQL,
    "spend AS (SELECT c_custkey, c_nationkey, sum(o_totalprice) AS spend FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)",
    "q AS (SELECT quantile_cont(spend, 0.05) AS lo, quantile_cont(spend, 0.95) AS hi FROM spend)",
    select="""
SELECT c_custkey, round(spend, 6) AS spend,
  round(CASE WHEN spend IS NULL THEN NULL ELSE (least(greatest(spend, lo), hi) - lo) / (hi - lo) * 100 END, 6) AS score,
  round(CASE WHEN spend IS NULL THEN NULL ELSE 100 - (least(greatest(spend, lo), hi) - lo) / (hi - lo) * 100 END, 6) AS inverse_score
FROM spend, q""",
)


@query("q01_percentile_score", CUSTOMER_SCORE_SQL)
def percentile_score(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    spend = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spend"))
    rows = c.select("c_custkey").join(spend, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "spend")
    rows = cut_lineage(rows)
    both = S.percentile_scores(rows, "spend", {"score": True, "inverse_score": False})
    return both.select("c_custkey", r6("spend"), r6("score"), r6("inverse_score"))


@query(
    "q02_percentile_score_degenerate",
    """
SELECT s_suppkey, 50::DOUBLE AS constant_score, 50::DOUBLE AS constant_inverse, CAST(NULL AS DOUBLE) AS empty_score FROM supplier""",
)
def percentile_score_degenerate(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(
        "s_suppkey",
        F.when(F.col("s_suppkey") % 11 != 0, 7.0).alias("constant"),  # NULL rows get 50 as well
        F.lit(None).cast("double").alias("empty"),
    )
    rows = S.percentile_scores(s, "constant", {"constant_score": True, "constant_inverse": False})
    return S.percentile_score(rows, "empty", "empty_score").select("s_suppkey", "constant_score", "constant_inverse", "empty_score")


@query(
    "q03_ratio_component",
    with_ctes(
        B.COMPONENTS_SQL,
        select="SELECT region_key, population, total_beds, round(residents_per_bed, 6) AS residents_per_bed, round(s_pop, 6) AS s_pop FROM pop_c",
    ),
)
def ratio_component(spark: SparkSession, sf: str) -> DataFrame:
    return B.components(spark, sf)["population"].select("region_key", "population", "total_beds", r6("residents_per_bed"), r6("s_pop"))


@query(
    "q04_staff_component_zero_rule",
    with_ctes(
        B.COMPONENTS_SQL,
        select="SELECT region_key, specialists, total_beds, round(beds_per_specialist, 6) AS beds_per_specialist, round(s_staff, 6) AS s_staff FROM staff_c",
    ),
)
def staff_component(spark: SparkSession, sf: str) -> DataFrame:
    return B.components(spark, sf)["staff"].select("region_key", "specialists", "total_beds", r6("beds_per_specialist"), r6("s_staff"))


RISK_COLUMNS_SQL = """region_key, district, round(s_load, 6) AS s_load, n_reporting, round(s_access, 6) AS s_access,
  round(s_pop, 6) AS s_pop, round(s_staff, 6) AS s_staff, n_components, round(risk, 6) AS risk, risk_grade::DOUBLE AS risk_grade, risk_grade_name, calc_state"""


@query("q05_composite_risk", with_ctes(B.RISK_SQL, select=f"SELECT {RISK_COLUMNS_SQL} FROM risks"))
def composite_risk(spark: SparkSession, sf: str) -> DataFrame:
    return B.region_risk(spark, sf, readers=1).select(
        "region_key", "district", r6("s_load"), "n_reporting", r6("s_access"), r6("s_pop"), r6("s_staff"),
        "n_components", r6("risk"), F.col("risk_grade").cast("double").alias("risk_grade"), "risk_grade_name", "calc_state",
    )


@query(
    "q06_placeholder_rejection",
    with_ctes(
        B.COMPONENTS_SQL,
        select="""
SELECT region_key, round(s_load, 6) AS s_load, CAST(NULL AS DOUBLE) AS s_pop, round(s_staff, 6) AS s_staff,
  (s_load IS NOT NULL)::INT + (s_access IS NOT NULL)::INT + (s_staff IS NOT NULL)::INT AS n_components, CAST(NULL AS DOUBLE) AS risk
FROM load_c JOIN access_c USING (region_key) LEFT JOIN staff_c USING (region_key)""",
    ),
)
def placeholder_rejection(spark: SparkSession, sf: str) -> DataFrame:
    placeholder = B.places(spark, sf).select("region_key", F.lit(50.0).alias("s_pop"))
    c = B.components(spark, sf)
    risk = S.composite_risk(S.load_component(B.beds(spark, sf)), c["access"], placeholder, c["staff"])
    return risk.select("region_key", r6("s_load"), "s_pop", r6("s_staff"), "n_components", "risk")


LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


@query(
    "q07_keep_last_dedupe",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, strftime(l_shipdate, '%Y-%m-%d') AS ship_day
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax DESC) AS rn FROM lineitem)
WHERE rn = 1""",
)
def keep_last_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *LINE_ORDER)
    return keep_last(rows, ["l_orderkey", "l_linenumber"], LINE_ORDER).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_day")
    )


@query(
    "q08_duplicate_flag",
    """
SELECT l_returnflag, is_duplicate, count(*) AS n_rows, sum(l_quantity) AS quantity
FROM (SELECT l_returnflag, l_quantity, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS is_duplicate FROM lineitem)
GROUP BY 1, 2""",
)
def duplicate_flag(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    flagged = flag_duplicates(rows, ["l_orderkey", "l_linenumber"])
    return flagged.groupBy("l_returnflag", "is_duplicate").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("quantity"))


@query(
    "q09_left_population_join",
    """
SELECT s_suppkey, s_name, n_lines::DOUBLE AS n_lines, round(revenue, 4) AS revenue
FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n_lines, sum(l_extendedprice * (1 - l_discount)) AS revenue
  FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey""",
)
def left_population_join(spark: SparkSession, sf: str) -> DataFrame:
    facts = (
        table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey"))
        .agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.expr("l_extendedprice * (1 - l_discount)")).alias("revenue"))
    )
    return J.conform(table(spark, sf, "supplier").select("s_suppkey", "s_name"), facts, ["s_suppkey"]).select(
        "s_suppkey", "s_name", F.col("n_lines").cast("double").alias("n_lines"), F.round("revenue", 4).alias("revenue")
    )


@query(
    "q10_full_outer_coalesce",
    """
SELECT coalesce(a.k, b.k) AS custkey, urgent_orders::DOUBLE AS urgent_orders, open_total,
  CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS origin
FROM (SELECT o_custkey AS k, count(*) AS urgent_orders FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) a
FULL JOIN (SELECT o_custkey AS k, round(sum(o_totalprice), 4) AS open_total FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.k = b.k""",
)
def full_outer_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "custkey")
    urgent = o.filter("o_orderpriority = '1-URGENT'").groupBy("custkey").agg(F.count(F.lit(1)).alias("urgent_orders"))
    opened = o.filter("o_orderstatus = 'O'").groupBy("custkey").agg(F.round(F.sum("o_totalprice"), 4).alias("open_total"))
    return J.outer_with_origin(urgent, opened, ["custkey"]).select("custkey", F.col("urgent_orders").cast("double").alias("urgent_orders"), "open_total", "origin")


@query(
    "q11_semi_anti",
    """
SELECT c_custkey, c_nationkey, c_mktsegment, 'no_open_order' AS kind FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
UNION ALL
SELECT c_custkey, c_nationkey, c_mktsegment, 'known_pair' FROM customer
WHERE (c_nationkey, c_mktsegment) IN (SELECT s_nationkey, CASE WHEN s_acctbal > 5000 THEN 'BUILDING' ELSE 'MACHINERY' END FROM supplier)
UNION ALL
SELECT c_custkey, c_nationkey, c_mktsegment, 'unknown_pair' FROM customer
WHERE (c_nationkey, c_mktsegment) NOT IN (SELECT s_nationkey, CASE WHEN s_acctbal > 5000 THEN 'BUILDING' ELSE 'MACHINERY' END FROM supplier)""",
)
def semi_anti(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    opened = table(spark, sf, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    segment = F.when(F.col("s_acctbal") > 5000, "BUILDING").otherwise("MACHINERY")
    pairs = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), segment.alias("c_mktsegment"))
    on = ["c_nationkey", "c_mktsegment"]
    return (
        J.drop_known(c, opened, ["c_custkey"]).withColumn("kind", F.lit("no_open_order"))
        .unionByName(J.keep_known(c, pairs, on).withColumn("kind", F.lit("known_pair")))
        .unionByName(J.drop_known(c, pairs, on).withColumn("kind", F.lit("unknown_pair")))
    )


# a ledger drawn from all orders: customers whose largest order is large are re-assigned, some with an outdated name
LEDGER_SQL = """
ledger AS (
  SELECT o_custkey AS c_custkey, CASE WHEN o_custkey % 5 = 0 THEN 'outdated' ELSE 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') END AS expected_name,
    'MOVED-' || max(o_orderpriority) AS c_mktsegment
  FROM orders GROUP BY 1, 2 HAVING max(o_totalprice) > 400000)
"""


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    name = F.when(F.col("o_custkey") % 5 == 0, "outdated").otherwise(F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")))
    facts = o.groupBy(F.col("o_custkey").alias("c_custkey"), name.alias("expected_name")).agg(
        F.concat(F.lit("MOVED-"), F.max("o_orderpriority")).alias("c_mktsegment"), F.max("o_totalprice").alias("_largest")
    )
    return facts.filter("_largest > 400000").drop("_largest")


@query(
    "q12_override_upsert",
    with_ctes(
        LEDGER_SQL,
        select="""
SELECT c.c_custkey, c.c_name, CASE WHEN l.expected_name = c.c_name THEN l.c_mktsegment ELSE c.c_mktsegment END AS c_mktsegment,
  CASE WHEN l.expected_name = c.c_name THEN 1::DOUBLE ELSE 0::DOUBLE END AS match_score
FROM customer c LEFT JOIN ledger l ON c.c_custkey = l.c_custkey""",
    ),
)
def override_upsert(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", F.lit(0.0).alias("match_score"))
    return J.apply_overrides(
        c, _ledger(spark, sf), "c_custkey", ["c_mktsegment"], {"c_name": "expected_name"}, {"match_score": F.lit(1.0)}
    )


@query(
    "q13_exclusion_null_out",
    """
SELECT s_suppkey, CASE WHEN x.k IS NULL THEN s_name END AS s_name, CASE WHEN x.k IS NULL THEN s_acctbal END AS s_acctbal,
  CASE WHEN x.k IS NULL THEN '자동매칭' ELSE 'HIRA원천불일치' END AS match_state
FROM supplier LEFT JOIN (SELECT l_suppkey AS k FROM lineitem GROUP BY 1 HAVING avg(l_quantity) >= 25.5) x ON s_suppkey = x.k""",
)
def exclusion_null_out(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal", F.lit(V.STATE_AUTOMATIC).alias("match_state"))
    out = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.avg("l_quantity").alias("q")).filter("q >= 25.5").select("s_suppkey")
    return J.apply_exclusions(s, out, "s_suppkey", ["s_name", "s_acctbal"], "match_state")


@query(
    "q14_hierarchical_key_join",
    """
WITH known AS (SELECT DISTINCT CASE WHEN p_size > 48 THEN p_name ELSE split_part(p_name, ' ', 1) END AS k FROM part WHERE p_size > 48 OR p_size = 1 AND p_type = 'ECONOMY'),
m AS (SELECT p_partkey, CASE WHEN p_name IN (SELECT k FROM known) THEN p_name WHEN split_part(p_name, ' ', 1) IN (SELECT k FROM known) THEN split_part(p_name, ' ', 1) END AS matched_key,
  CASE WHEN p_name IN (SELECT k FROM known) THEN 'direct' WHEN split_part(p_name, ' ', 1) IN (SELECT k FROM known) THEN 'parent' ELSE 'none' END AS match_kind FROM part)
SELECT * FROM m""",
)
def hierarchical_key_join(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    first = F.substring_index("p_name", " ", 1)
    known = p.filter("p_size > 48 or (p_size = 1 and p_type = 'ECONOMY')").select(
        F.when(F.col("p_size") > 48, F.col("p_name")).otherwise(first).alias("k")
    )
    rows = p.select("p_partkey", "p_name", first.alias("first_word"))
    return J.resolve_key(rows, known, "p_name", "first_word", "k").select("p_partkey", "matched_key", "match_kind")


@query(
    "q15_longest_containment",
    """
WITH names AS (SELECT DISTINCT p_name AS n, replace(p_name, ' ', '') AS bare FROM part),
texts AS (SELECT p_partkey, p_brand, replace(p_brand || ' ' || p_name || ' of ' || p_type, ' ', '') AS t FROM part),
hits AS (SELECT p_partkey, n, row_number() OVER (PARTITION BY p_partkey ORDER BY length(bare) DESC, n) AS rn FROM texts JOIN names ON contains(t, bare))
SELECT t.p_partkey, h.n AS matched_name FROM texts t LEFT JOIN hits h ON t.p_partkey = h.p_partkey AND rn = 1""",
)
def longest_containment(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    texts = p.select("p_partkey", F.concat_ws(" ", "p_brand", "p_name", F.lit("of"), "p_type").alias("t"))
    return J.longest_contained(texts, p.select("p_name"), "p_partkey", "t", "p_name").select("p_partkey", "matched_name")


@query(
    "q16_key_set_diff",
    """
WITH a AS (SELECT s_suppkey AS k, s_nationkey::VARCHAR AS v FROM supplier WHERE s_acctbal < 9000),
b AS (SELECT s_suppkey AS k, (CASE WHEN s_acctbal > 8000 THEN s_nationkey + 1 ELSE s_nationkey END)::VARCHAR AS v FROM supplier WHERE s_acctbal > 0)
SELECT coalesce(a.k, b.k) AS s_suppkey, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'moved' END AS change, a.v AS before, b.v AS after
FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v""",
)
def key_set_diff(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    before = s.filter("s_acctbal < 9000").select("s_suppkey", F.col("s_nationkey").cast("string").alias("v"))
    moved = F.when(F.col("s_acctbal") > 8000, F.col("s_nationkey") + 1).otherwise(F.col("s_nationkey"))
    after = s.filter("s_acctbal > 0").select("s_suppkey", moved.cast("string").alias("v"))
    return J.list_changes(before, after, "s_suppkey", "v")


@query(
    "q17_region_rank_topk",
    with_ctes(
        B.PLACES_SQL,
        "r AS (SELECT c_custkey, region_key, c_acctbal, rank() OVER (ORDER BY c_acctbal DESC) AS overall_rank, row_number() OVER (PARTITION BY region_key ORDER BY c_acctbal DESC, c_custkey) AS region_rank FROM customer JOIN places ON c_nationkey = n_nationkey)",
        select="SELECT * FROM r WHERE region_rank <= 3",
    ),
)
def region_rank_topk(spark: SparkSession, sf: str) -> DataFrame:
    from wardscope.operators.ordering import global_rank, top_per_group

    c, p = table(spark, sf, "customer"), B.places(spark, sf)
    ranked = global_rank(c.select("c_custkey", "c_nationkey", "c_acctbal"), "c_acctbal", "overall_rank")
    rows = ranked.join(p, ranked.c_nationkey == p.n_nationkey).select("c_custkey", "region_key", "c_acctbal", "overall_rank")
    return top_per_group(rows, ["region_key"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 3, "region_rank")


@query(
    "q18_kpi",
    with_ctes(
        B.RISK_SQL,
        select="""
SELECT round(avg(risk), 6) AS avg_risk, count(*) FILTER (risk > 50) AS n_high, count(risk) AS n_complete, count(*) AS n_total, count(*) FILTER (risk IS NULL) AS n_missing,
  (SELECT count(DISTINCT (province, district)) FROM beds) AS n_districts FROM risks""",
    ),
)
def kpi(spark: SparkSession, sf: str) -> DataFrame:
    districts = B.beds(spark, sf).agg(F.count_distinct(F.struct("province", "district")))
    return D.indicators(B.region_risk(spark, sf)).withColumn("n_districts", districts.scalar()).withColumn("avg_risk", F.round("avg_risk", 6))


@query(
    "q59_contribution",
    with_ctes(
        B.RISK_SQL,
        "m AS (SELECT avg(s_load) AS a, avg(s_access) AS b, avg(s_pop) AS c, avg(s_staff) AS d FROM risks WHERE risk IS NOT NULL)",
        select="""
SELECT 's_load' AS component, 0.35::DOUBLE AS weight, round(a, 6) AS mean_score, round(0.35::DOUBLE * a, 6) AS points FROM m
UNION ALL SELECT 's_access', 0.30::DOUBLE, round(b, 6), round(0.30::DOUBLE * b, 6) FROM m
UNION ALL SELECT 's_pop', 0.20::DOUBLE, round(c, 6), round(0.20::DOUBLE * c, 6) FROM m
UNION ALL SELECT 's_staff', 0.15::DOUBLE, round(d, 6), round(0.15::DOUBLE * d, 6) FROM m""",
    ),
)
def contribution(spark: SparkSession, sf: str) -> DataFrame:
    return S.contributions(B.region_risk(spark, sf, readers=1)).select("component", "weight", r6("mean_score"), r6("points"))


@query(
    "q64_region_ranking",
    with_ctes(
        B.RISK_SQL,
        select="""
SELECT region_key, round(risk, 6) AS risk, rank() OVER (ORDER BY risk DESC) AS risk_rank,
  rank() OVER (PARTITION BY split_part(region_key, '|', 1) ORDER BY risk DESC) AS province_rank FROM risks WHERE risk IS NOT NULL""",
    ),
)
def region_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return T.ranked_by_risk(B.region_risk(spark, sf)).select("region_key", r6("risk"), "risk_rank", "province_rank")
