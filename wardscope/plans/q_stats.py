"""Statistics queries: heatmap, correlation, inflation, regression, clusters, grades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardscope.functions import fixed_values as V
from wardscope.functions.scalars import saturation, usable
from wardscope.operators import clusters as K
from wardscope.operators import score as S
from wardscope.operators import statistics as T
from wardscope.plans import bindings as B
from wardscope.plans.registry import query, r6, table, with_ctes
from wardscope.session import cut_lineage

HEAT_SQL = with_ctes(
    """h AS (SELECT ts + INTERVAL 9 HOUR AS l, value - 5 AS a, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS t FROM events),
c AS (SELECT isodow(l) - 1 AS day_no, hour(l) AS hr, least(greatest((t - a) / nullif(t, 0) * 100, 0), 100) AS s FROM h WHERE t > 0 AND a >= 0)""",
    select="SELECT day_no, CASE day_no WHEN 0 THEN '월' WHEN 1 THEN '화' WHEN 2 THEN '수' WHEN 3 THEN '목' WHEN 4 THEN '금' WHEN 5 THEN '토' ELSE '일' END AS day, "
    + ", ".join(f"round(avg(s) FILTER (hr = {h}), 6) AS h{h:02d}" for h in range(24))
    + " FROM c GROUP BY day_no",
)


def _history(spark: SparkSession, sf: str) -> DataFrame:
    a, t = F.col("available"), F.col("total")
    return B.feed_all(spark, sf).select(F.col("ts").alias("collected_ts"), F.when(usable(a, t), saturation(a, t)).alias("saturation"))


@query("q32_heatmap", HEAT_SQL)
def heatmap(spark: SparkSession, sf: str) -> DataFrame:
    wide = T.heatmap(_history(spark, sf))
    return wide.select("day_no", "day", *[r6(f"h{h:02d}") for h in range(24)])


# customer features: balance, order count, mean price, spend; the last is nearly a product of two others
FEATURES_SQL = """
f AS (
  SELECT c_custkey, c_acctbal AS balance, CAST(count(*) AS DOUBLE) AS n_orders, avg(o_totalprice) / 1000 AS mean_price,
    CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS DOUBLE) AS n_open, sum(o_totalprice) / 1000 + c_acctbal / 10 AS target
  FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
"""
FEATURES = ["balance", "n_orders", "mean_price", "n_open"]


def features(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    per = o.groupBy("o_custkey").agg(
        F.count(F.lit(1)).cast("double").alias("n_orders"), F.sum("o_totalprice").alias("spend"),
        F.sum(F.when(F.col("o_orderstatus") == "O", 1.0).otherwise(0.0)).alias("n_open"),
    )
    rows = c.join(per, F.col("c_custkey") == F.col("o_custkey"))
    return rows.select(
        "c_custkey", F.col("c_acctbal").alias("balance"), "n_orders", (F.col("spend") / F.col("n_orders") / 1000).alias("mean_price"),
        "n_open", (F.col("spend") / 1000 + F.col("c_acctbal") / 10).alias("target"),
    )


CORR_COLUMNS = FEATURES + ["target"]


def _corr_sql() -> str:
    rows = []
    for a in CORR_COLUMNS:
        cells = ", ".join("1::DOUBLE" if a == b else f"round(corr({a}, {b}), 6)" for b in CORR_COLUMNS)
        strength = "NULL, NULL" if a == "target" else (
            f"CASE WHEN abs(corr({a}, target)) >= 0.8 THEN '매우 강함' WHEN abs(corr({a}, target)) >= 0.6 THEN '강함' "
            f"WHEN abs(corr({a}, target)) >= 0.4 THEN '보통' WHEN abs(corr({a}, target)) >= 0.2 THEN '약함' ELSE '매우 약함' END, "
            f"CAST(floor(abs(corr({a}, target)) * 100 + 0.5) AS DOUBLE)"
        )
        rows.append(f"SELECT '{a}', {cells}, {strength} FROM f")
    names = ", ".join(["variable", *CORR_COLUMNS, "level", "percent"])
    return f"SELECT * FROM (" + " UNION ALL ".join(rows) + f") t({names})"


@query("q33_corr_matrix", with_ctes(FEATURES_SQL, select=_corr_sql()))
def corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    matrix = T.correlation_matrix(features(spark, sf), CORR_COLUMNS)
    strength = T.correlation_ranking(matrix, "target", FEATURES).select("variable", "level", "percent")
    return matrix.join(strength, "variable", "left").select("variable", *[r6(c) for c in CORR_COLUMNS], "level", F.col("percent").cast("double").alias("percent"))


def _elimination_sql(prefix: str, source: str, size: int) -> tuple[str, str]:
    """CTEs that solve a small symmetric system (columns a{i}_{j}, right side a{i}_{size}) by elimination."""
    parts, last = [], source
    for k in range(size):
        columns = []
        for i in range(size):
            for j in range(k, size + 1):
                if i == k:
                    columns.append(f"a{k}_{j} / a{k}_{k} AS a{i}_{j}")
                else:
                    columns.append(f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k} AS a{i}_{j}")
        parts.append(f"{prefix}{k} AS (SELECT {', '.join(columns)} FROM {last})")
        last = f"{prefix}{k}"
    return ",\n".join(parts), last


def _vif_sql() -> str:
    parts, selects = [], []
    for t in FEATURES:
        others = [c for c in FEATURES if c != t]
        cells = [f"covar_pop({a}, {b}) AS a{i}_{j}" for i, a in enumerate(others) for j, b in enumerate(others)]
        cells += [f"covar_pop({a}, {t}) AS a{i}_{len(others)}" for i, a in enumerate(others)]
        parts.append(f"m_{t} AS (SELECT {', '.join(cells)} FROM f)")
        steps, last = _elimination_sql(f"e_{t}_", f"m_{t}", len(others))
        parts.append(steps)
        explained = " + ".join(f"a{i}_{len(others)} * (SELECT covar_pop({a}, {t}) FROM f)" for i, a in enumerate(others))
        selects.append(f"SELECT '{t}' AS variable, round(1 / (1 - ({explained}) / (SELECT var_pop({t}) FROM f)), 6) AS vif FROM {last}")
    return with_ctes(FEATURES_SQL, *parts, select=" UNION ALL ".join(selects))


@query("q34_vif", _vif_sql())
def vif(spark: SparkSession, sf: str) -> DataFrame:
    return T.variance_inflation(features(spark, sf), FEATURES).select("variable", r6("vif"))


def _regression_sql() -> str:
    cells = [f"covar_pop({a}, {b}) AS a{i}_{j}" for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES)]
    cells += [f"covar_pop({a}, target) AS a{i}_4" for i, a in enumerate(FEATURES)]
    steps, last = _elimination_sql("e", "m", 4)
    fit = " + ".join(f"b{i} * {c}" for i, c in enumerate(FEATURES))
    means = " - ".join(f"a{i}_4 * (SELECT avg({c}) FROM tr)" for i, c in enumerate(FEATURES))
    rows = [f"SELECT '{c}' AS variable, round(b{i}, 4) AS value FROM beta" for i, c in enumerate(FEATURES)]
    rows += [
        "SELECT 'intercept', round(b, 4) FROM beta", "SELECT 'mae', round(avg(abs(target - p)), 4) FROM pr",
        "SELECT 'r2', round(1 - sum((target - p) * (target - p)) / (var_pop(target) * count(*)), 6) FROM pr", "SELECT 'rows', CAST(count(*) AS DOUBLE) FROM f",
    ]
    return with_ctes(
        FEATURES_SQL,
        "s AS (SELECT *, ('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::BIGINT % 100 < 80 AS train FROM f)",
        "tr AS (SELECT * FROM s WHERE train)", f"m AS (SELECT {', '.join(cells)} FROM tr)", steps,
        f"beta AS (SELECT {', '.join(f'a{i}_4 AS b{i}' for i in range(4))}, (SELECT avg(target) FROM tr) - {means} AS b FROM {last})",
        f"pr AS (SELECT target, b + {fit} AS p FROM s, beta WHERE NOT train)",
        select=" UNION ALL ".join(rows),
    )


@query("q35_regression", _regression_sql())
def regression(spark: SparkSession, sf: str) -> DataFrame:
    table_, metrics = T.linear_regression(features(spark, sf), "c_custkey", FEATURES, "target")
    extra = [("intercept", round(metrics["intercept"], 4)), ("mae", round(metrics["mae"], 4)), ("r2", round(metrics["r2"], 6)), ("rows", float(metrics["rows"]))]
    facts = spark.createDataFrame(extra, "variable string, value double")
    return table_.select("variable", F.round("coefficient", 4).alias("value")).unionByName(facts)


# one feature vector per district and segment, as the clustering works on regions
GROUPS_SQL = """
g AS (
  SELECT n_name || '/' || c_mktsegment AS region_key, c_mktsegment AS cluster, avg(c_acctbal) AS s_load, avg(o_totalprice) AS s_access,
    CAST(count(*) AS DOUBLE) AS s_pop, avg(CASE WHEN o_orderstatus = 'F' THEN 100::DOUBLE ELSE 0::DOUBLE END) AS s_staff
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
"""
GROUP_FEATURES = ["s_load", "s_access", "s_pop", "s_staff"]


def groups(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "nation")
    per = o.groupBy("o_custkey").agg(
        F.sum("o_totalprice").alias("p"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("o_orderstatus") == "F", 100.0).otherwise(0.0)).alias("f")
    )
    joined = per.join(c.select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"))
    by = joined.groupBy("c_nationkey", "c_mktsegment").agg(
        F.sum(F.col("c_acctbal") * F.col("n")).alias("a"), F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum("f").alias("f")
    )
    rows = by.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat_ws("/", "n_name", "c_mktsegment").alias("region_key"), F.col("c_mktsegment").alias("cluster"), (F.col("a") / F.col("n")).alias("s_load"),
        (F.col("p") / F.col("n")).alias("s_access"), F.col("n").cast("double").alias("s_pop"), (F.col("f") / F.col("n")).alias("s_staff"),
    )
    return cut_lineage(rows)


@query("q36_kmeans_k_choice")
def kmeans_k_choice(spark: SparkSession, sf: str) -> DataFrame:
    evaluation, labelled = K.choose_clusters(groups(spark, sf).drop("cluster").withColumn("risk", F.col("s_load")), GROUP_FEATURES)
    sizes = labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_regions"))
    return evaluation.select(F.lit("k").alias("kind"), "k", r6("silhouette", "value")).unionByName(
        sizes.select(F.lit("size").alias("kind"), F.col("cluster").alias("k"), F.col("n_regions").cast("double").alias("value"))
    )


SILHOUETTE_SQL = with_ctes(
    GROUPS_SQL,
    "z AS (SELECT region_key, cluster, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in GROUP_FEATURES) + " FROM g)",
    "d AS (SELECT a.region_key, a.cluster AS own, b.cluster AS other, sum(sqrt(" + " + ".join(f"pow(a.{c} - b.{c}, 2)" for c in GROUP_FEATURES)
    + ")) AS total, count(*) AS n FROM z a, z b GROUP BY 1, 2, 3)",
    "s AS (SELECT region_key, min(CASE WHEN own <> other THEN total / n END) AS b, max(CASE WHEN own = other AND n > 1 THEN total / (n - 1) END) AS a FROM d GROUP BY 1)",
    select="SELECT region_key, round(coalesce((b - a) / greatest(a, b), 0), 6) AS silhouette FROM s",
)


@query("q65_silhouette", SILHOUETTE_SQL)
def silhouette(spark: SparkSession, sf: str) -> DataFrame:
    rows = K.standardise(groups(spark, sf), GROUP_FEATURES)
    z = [f"z_{c}" for c in GROUP_FEATURES]
    return K.silhouette_per_row(rows.select("region_key", "cluster", *z), z, "cluster").select("region_key", r6("silhouette"))


@query(
    "q37_quantile_grades",
    """
WITH q AS (SELECT quantile_cont(o_totalprice, 0.2) AS a, quantile_cont(o_totalprice, 0.4) AS b, quantile_cont(o_totalprice, 0.5) AS m,
  quantile_cont(o_totalprice, 0.6) AS c, quantile_cont(o_totalprice, 0.8) AS d, avg(o_totalprice) AS mean, max(o_totalprice) AS mx, count(*) AS n FROM orders),
g AS (SELECT CASE WHEN o_totalprice < a THEN 1 WHEN o_totalprice < b THEN 2 WHEN o_totalprice < c THEN 3 WHEN o_totalprice < d THEN 4 ELSE 5 END AS quintile, o_totalprice FROM orders, q)
SELECT 'grade_' || quintile AS item, CAST(count(*) AS DOUBLE) AS value FROM g GROUP BY quintile
UNION ALL SELECT 'p20', round(a, 4) FROM q UNION ALL SELECT 'p40', round(b, 4) FROM q UNION ALL SELECT 'median', round(m, 4) FROM q
UNION ALL SELECT 'p60', round(c, 4) FROM q UNION ALL SELECT 'p80', round(d, 4) FROM q UNION ALL SELECT 'mean', round(mean, 4) FROM q
UNION ALL SELECT 'maximum', round(mx, 4) FROM q UNION ALL SELECT 'n', CAST(n AS DOUBLE) FROM q""",
)
def quantile_grades(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_totalprice")
    graded = T.quintile_grade(o, "o_totalprice").groupBy(F.concat(F.lit("grade_"), F.col("quintile").cast("string")).alias("item")).agg(
        F.count(F.lit(1)).cast("double").alias("value")
    )
    facts = T.distribution_summary(o, "o_totalprice")
    names = ["p20", "p40", "median", "p60", "p80", "mean", "maximum", "n"]
    rows = F.array(*[F.struct(F.lit(c).alias("item"), F.round(F.col(c).cast("double"), 4).alias("value")) for c in names])
    return graded.unionByName(facts.select(F.inline(rows)))


@query(
    "q38_percentile_main_factor",
    with_ctes(
        B.RISK_SQL,
        "p AS (SELECT *, " + ", ".join(f"percent_rank() OVER (ORDER BY {c}) AS pr_{c}" for c in V.RISK_WEIGHTS) + " FROM risks WHERE risk IS NOT NULL)",
        """t AS (SELECT *, greatest(pr_s_load, pr_s_access, pr_s_pop, pr_s_staff) AS m FROM p)""",
        """u AS (SELECT region_key, label, row_number() OVER (PARTITION BY region_key ORDER BY v DESC, i) AS rn FROM (
  SELECT region_key, '병상포화도' AS label, 0 AS i, s_load AS v FROM p UNION ALL SELECT region_key, '접근성', 1, s_access FROM p
  UNION ALL SELECT region_key, '인구대비병상', 2, s_pop FROM p UNION ALL SELECT region_key, '의료진부족', 3, s_staff FROM p))""",
        select="""
SELECT t.region_key, round(pr_s_load, 6) AS pr_s_load, round(pr_s_access, 6) AS pr_s_access, round(pr_s_pop, 6) AS pr_s_pop, round(pr_s_staff, 6) AS pr_s_staff,
  CASE WHEN pr_s_load = m THEN '병상포화도' WHEN pr_s_access = m THEN '접근성' WHEN pr_s_pop = m THEN '인구대비병상' ELSE '의료진부족' END AS main_factor,
  u1.label || ',' || u2.label AS top_two
FROM t JOIN u u1 ON u1.region_key = t.region_key AND u1.rn = 1 JOIN u u2 ON u2.region_key = t.region_key AND u2.rn = 2""",
    ),
)
def percentile_main_factor(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.main_factor(B.region_risk(spark, sf), V.COMPONENT_SHORT)
    top = F.array_join(S.top_factors(V.COMPONENT_SHORT), ",")
    return rows.select("region_key", *[r6(f"pr_{c}") for c in V.RISK_WEIGHTS], "main_factor", top.alias("top_two"))


@query(
    "q39_cluster_labels_profile",
    with_ctes(
        GROUPS_SQL,
        "p AS (SELECT cluster, avg(s_load) AS s_load, avg(s_access) AS s_access, avg(s_pop) AS s_pop, avg(s_staff) AS s_staff, avg(s_load) AS risk, count(*) AS n FROM g GROUP BY 1)",
        "l AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY risk DESC, cluster DESC) = 1 THEN '접근성·의료진 복합취약형' ELSE '접근성 양호·병상부담형' END AS label FROM p)",
        select="""
SELECT cluster AS item, label, round(s_load, 4) AS s_load, round(s_access, 4) AS s_access, round(s_pop, 4) AS s_pop, round(s_staff, 4) AS s_staff, n::DOUBLE AS n_regions FROM l
UNION ALL SELECT 'BUILDING-MACHINERY', NULL, round(sum(CASE cluster WHEN 'BUILDING' THEN s_load WHEN 'MACHINERY' THEN -s_load END), 4),
  round(sum(CASE cluster WHEN 'BUILDING' THEN s_access WHEN 'MACHINERY' THEN -s_access END), 4), round(sum(CASE cluster WHEN 'BUILDING' THEN s_pop WHEN 'MACHINERY' THEN -s_pop END), 4),
  round(sum(CASE cluster WHEN 'BUILDING' THEN s_staff WHEN 'MACHINERY' THEN -s_staff END), 4), NULL FROM p""",
    ),
)
def cluster_labels_profile(spark: SparkSession, sf: str) -> DataFrame:
    profile = cut_lineage(K.cluster_profile(groups(spark, sf).withColumn("risk", F.col("s_load")), [*GROUP_FEATURES, "risk"]))
    named = K.cluster_labels(profile).select(
        F.col("cluster").alias("item"), F.col("cluster_label").alias("label"), *[F.round(c, 4).alias(c) for c in GROUP_FEATURES], F.col("n_regions").cast("double").alias("n_regions")
    )
    gap = K.mean_difference(profile, GROUP_FEATURES, "BUILDING", "MACHINERY")
    wide = gap.groupBy().pivot("component", GROUP_FEATURES).agg(F.round(F.first("difference"), 4))
    return named.unionByName(
        wide.select(F.lit("BUILDING-MACHINERY").alias("item"), F.lit(None).cast("string").alias("label"), *GROUP_FEATURES, F.lit(None).cast("double").alias("n_regions"))
    )
