"""Heatmap, correlation, variance inflation, regression and distribution summaries.

Each is one pass of combinable aggregates; only matrices of a few numbers
reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardscope.functions import fixed_values as V
from wardscope.functions.scalars import correlation_level, instant_of, number_of
from wardscope.operators.ordering import global_rank, percent_rank, quantiles

MINIMUM_ROWS = 10


def heatmap_cells(history: DataFrame, collected: str = "collected_ts", value: str = "saturation", zone: str = V.SOURCE_ZONE) -> DataFrame:
    """Mean per local weekday (Monday 0) and hour in long form."""
    local = F.from_utc_timestamp(instant_of(history, collected), zone)
    rows = history.select(F.weekday(local).alias("day_no"), F.hour(local).alias("hour"), number_of(history, value).alias("v"))
    return rows.dropna().groupBy("day_no", "hour").agg(F.avg("v").alias("mean_value"))


def heatmap(history: DataFrame, collected: str = "collected_ts", value: str = "saturation", zone: str = V.SOURCE_ZONE) -> DataFrame:
    """Weekday rows by 24 fixed hour columns ``h00`` .. ``h23``."""
    cells = heatmap_cells(history, collected, value, zone)
    names = F.array(*[F.lit(d) for d in V.DAY_NAMES])
    # 168 cells at most; the fixed pivot list saves the job that would look for values
    wide = cells.groupBy("day_no").pivot("hour", list(range(24))).agg(F.first("mean_value"))
    return wide.select("day_no", F.get(names, F.col("day_no")).alias("day"), *[F.col(str(h)).alias(f"h{h:02d}") for h in range(24)])


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlations over rows where every column is present, one row per variable."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.dropna(subset=columns).agg(*[F.corr(a, b).alias(f"{a}~{b}") for a, b in pairs])

    def cell(a: str, b: str) -> Column:
        if a == b:
            return F.lit(1.0)
        return F.col(f"`{a}~{b}`") if (a, b) in pairs else F.col(f"`{b}~{a}`")

    rows = F.array(
        *[F.struct(F.lit(a).alias("variable"), *[cell(a, b).alias(b) for b in columns]) for a in columns]
    )
    return one.select(F.inline(rows))


def correlation_ranking(matrix: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """Correlations with the target, strongest first, with level and percent."""
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("r")) for c in columns])
    return (
        matrix.filter(F.col("variable") == target)
        .select(F.inline(rows))
        .select("variable", "r", correlation_level(F.col("r")).alias("level"), F.floor(F.abs("r") * 100 + 0.5).cast("bigint").alias("percent"))
        .orderBy(F.abs("r").desc(), "variable")
    )


def _moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and population covariances from one aggregate."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    n = row["n"]
    if n == 0:
        return 0, np.zeros(len(columns)), np.zeros((len(columns), len(columns)))
    cov = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    return n, np.array([row[f"m{i}"] for i in range(len(columns))]), cov


def variance_inflation(df: DataFrame, columns: list[str]) -> DataFrame:
    """1 / (1 - R2) of each column on the others; infinite when it is a combination of them."""
    data = df.dropna(subset=columns)
    n, _, cov = _moments(data, columns)
    rows = []
    for i, c in enumerate(columns):
        if n < MINIMUM_ROWS:
            rows.append((c, None))
            continue
        others = [j for j in range(len(columns)) if j != i]
        beta = np.linalg.lstsq(cov[np.ix_(others, others)], cov[others, i], rcond=None)[0]
        explained = float(beta @ cov[others, i])
        r2 = explained / cov[i, i] if cov[i, i] > 0 else 1.0
        rows.append((c, math.inf if r2 >= 1 else float(1.0 / (1.0 - r2))))
    return df.sparkSession.createDataFrame(rows, "variable string, vif double")


def in_training(key: Column, share: int = 80) -> Column:
    """Stable split: the first 32 bits of the key's md5, modulo 100, below the share."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % 100 < share


def linear_regression(df: DataFrame, key: str, features: list[str], target: str, share: int = 80) -> tuple[DataFrame, dict]:
    """Least squares on the training part, R2 and MAE on the rest.

    The fit needs the training means and covariances, the metrics one pass over
    the test rows with the coefficients as constants.
    """
    spark = df.sparkSession
    data = df.dropna(subset=features + [target]).withColumn("_train", in_training(F.col(key), share))
    columns = features + [target]
    rows = data.count()
    if rows < MINIMUM_ROWS:
        return spark.createDataFrame([], "variable string, coefficient double"), {"status": "insufficient_data", "rows": rows}
    _, means, cov = _moments(data.filter("_train"), columns)
    p = len(features)
    beta = np.linalg.lstsq(cov[:p, :p], cov[:p, p], rcond=None)[0]
    intercept = float(means[p] - beta @ means[:p])
    predicted = F.lit(intercept)
    for b, c in zip(beta, features):
        predicted = predicted + F.lit(float(b)) * F.col(c)
    error = F.col(target) - predicted
    test = data.filter("not _train").agg(
        F.avg(F.abs(error)).alias("mae"), F.sum(error * error).alias("sse"), F.count(F.lit(1)).alias("n"), F.var_pop(target).alias("var")
    ).first()
    spread = (test["var"] or 0.0) * test["n"]
    r2 = 1.0 - test["sse"] / spread if spread > 0 else None
    table = spark.createDataFrame([(c, float(b)) for c, b in zip(features, beta)], "variable string, coefficient double")
    return table, {"status": "complete", "rows": rows, "r2": r2, "mae": test["mae"], "intercept": intercept}


def regression_display(table: DataFrame, metrics: dict, labels: dict[str, str]) -> DataFrame:
    """Finite coefficients under their display names, in the given order; nothing if the fit is incomplete."""
    order = F.create_map(*[F.lit(x) for i, (c, label) in enumerate(labels.items()) for x in (c, F.struct(F.lit(i).alias("turn"), F.lit(label).alias("label")))])
    entry = F.try_element_at(order, F.col("variable"))
    rows = table.filter(F.lit(metrics.get("status") == "complete") & (F.abs("coefficient") < float("inf")))
    return rows.filter(entry.isNotNull()).select(entry["turn"].alias("turn"), entry["label"].alias("label"), "coefficient").orderBy("turn")


def distribution_summary(df: DataFrame, column: str) -> DataFrame:
    """Mean, median, quintile edges and maximum."""
    shares = {"p20": 0.2, "p40": 0.4, "median": 0.5, "p60": 0.6, "p80": 0.8}
    totals = df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.max(column).alias("maximum"))
    both = totals.withColumn("_q", quantiles(df, column, list(shares.values())).scalar())
    return both.select("n", "mean", *[F.get(F.col("_q"), i).alias(k) for i, k in enumerate(shares)], "maximum")


def quintile_grade(df: DataFrame, column: str, name: str = "quintile") -> DataFrame:
    """Grade 1..5 by the quintile edges, each bin closed on the left."""
    edges = quantiles(df, column, [0.2, 0.4, 0.6, 0.8]).scalar()
    below = F.size(F.filter(F.col("_q"), lambda e: e <= F.col(column).cast("double")))
    return df.withColumn("_q", edges).select(*df.columns, F.when(F.col(column).isNotNull(), below + 1).alias(name))


def main_factor(risk: DataFrame, names: dict[str, str]) -> DataFrame:
    """Percentile rank of each component among complete regions; the highest one leads."""
    data = risk.filter(F.col("risk").isNotNull())
    for c in names:
        data = percent_rank(data, c, f"pr_{c}")
    entries = F.array(
        *[F.struct(F.col(f"pr_{c}").alias("p"), F.lit(-i).alias("turn"), F.lit(label).alias("label")) for i, (c, label) in enumerate(names.items())]
    )
    return data.withColumn("main_factor", F.array_max(entries)["label"])


def ranked_by_risk(risk: DataFrame) -> DataFrame:
    """Complete regions with their place in the whole list and within their province."""
    complete = risk.filter(F.col("risk").isNotNull()).withColumn("province", F.substring_index("region_key", "|", 1))
    from pyspark.sql import Window

    placed = global_rank(complete, "risk", "risk_rank")
    # a province holds a bounded number of regions
    return placed.withColumn("province_rank", F.rank().over(Window.partitionBy("province").orderBy(F.col("risk").desc())))
