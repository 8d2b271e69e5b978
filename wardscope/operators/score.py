"""Robust component scores and the weighted composite risk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardscope.functions import fixed_values as V
from wardscope.functions.scalars import count_present, ratio, risk_grade, risk_grade_name
from wardscope.operators.ordering import quantiles


def percentile_score(
    df: DataFrame, column: str, name: str, higher_is_risk: bool = True, shares: tuple[float, float] = (0.05, 0.95)
) -> DataFrame:
    """Scale ``column`` to 0..100 between its low and high quantile.

    No value at all gives NULL everywhere; equal quantiles give 50 to every
    row, NULL ones included.  The quantiles are a scalar subquery, so scoring
    itself is a projection without join or shuffle.
    """
    return percentile_scores(df, column, {name: higher_is_risk}, shares)


def percentile_scores(df: DataFrame, column: str, names: dict[str, bool], shares: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """Several scores (name: is a higher value riskier) of one column from one pair of bounds."""
    value = F.col(column).cast("double")
    source = df.withColumn("_q", quantiles(df, column, list(shares)).scalar())
    low, high = F.get(F.col("_q"), 0), F.get(F.col("_q"), 1)
    scaled = (F.when(value.isNotNull(), F.least(F.greatest(value, low), high)) - low) / F.nullif(high - low, F.lit(0.0)) * 100
    score = F.when(low.isNull(), None).when(high <= low, 50.0).otherwise(scaled)
    return source.select(*df.columns, *[(score if up else F.lit(100.0) - score).alias(n) for n, up in names.items()])


def group_totals(df: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """Sums per key; a group with no present value has a NULL total."""
    return df.groupBy(*keys).agg(*[F.sum(F.col(c).cast("double")).alias(n) for n, c in values.items()])


def ratio_component(df: DataFrame, numerator: str, denominator: str, ratio_name: str, score_name: str) -> DataFrame:
    """Ratio of two totals (NULL for a zero divisor) and its percentile score."""
    with_ratio = df.withColumn(ratio_name, ratio(F.col(numerator), F.col(denominator)))
    return percentile_score(with_ratio, ratio_name, score_name)


def population_component(population: DataFrame, totals: DataFrame) -> DataFrame:
    """Residents per bed; ``population`` (region_key, population), ``totals`` (region_key, total_beds)."""
    joined = population.join(totals, "region_key", "left")
    return ratio_component(joined, "population", "total_beds", "residents_per_bed", "s_pop")


def staff_component(staff: DataFrame, totals: DataFrame) -> DataFrame:
    """Beds per specialist; a confirmed zero staff count scores exactly 100, beds known or not."""
    joined = staff.join(totals, "region_key", "left").withColumn("no_staff", F.col("specialists") == 0)
    scored = ratio_component(joined, "total_beds", "specialists", "beds_per_specialist", "s_staff")
    return scored.withColumn(
        "s_staff", F.when(F.coalesce("no_staff", F.lit(False)), F.lit(100.0)).otherwise(F.col("s_staff"))
    )


def load_component(facilities: DataFrame) -> DataFrame:
    """Mean saturation per region and the number of facilities that reported."""
    return facilities.groupBy("region_key").agg(
        F.min("district").alias("district"),
        F.avg("saturation").alias("s_load"),
        F.count("saturation").alias("n_reporting"),
    )


def without_placeholder(df: DataFrame, column: str, placeholder: float = 50.0) -> DataFrame:
    """A column whose only distinct value is the placeholder counts as missing."""
    only = df.agg(((F.min(column) == placeholder) & (F.max(column) == placeholder)).alias("only")).scalar()
    kept = F.when(~F.coalesce(only, F.lit(False)), F.col(column))
    return df.select(*[kept.alias(c) if c == column else F.col(c) for c in df.columns])


def weighted_total(weights: dict[str, float]) -> Column:
    """Weighted sum, NULL as soon as one component is missing."""
    return reduce(lambda a, b: a + b, [F.lit(w) * F.col(c) for c, w in weights.items()])


def composite_risk(
    load: DataFrame, access: DataFrame, population: DataFrame | None = None, staff: DataFrame | None = None
) -> DataFrame:
    """Join the components by region, then weight and grade the complete ones.

    Load and access are outer-joined; the two optional components are attached
    to the regions those give.  An absent or placeholder table counts as missing.
    """
    result = load.join(access.select("region_key", "s_access"), "region_key", "full")
    for table, column in ((population, "s_pop"), (staff, "s_staff")):
        if table is None or column not in table.columns:
            result = result.withColumn(column, F.lit(None).cast("double"))
        else:
            result = result.join(without_placeholder(table.select("region_key", column), column), "region_key", "left")
    return grade(result)


def grade(components: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    weights = weights or V.RISK_WEIGHTS
    columns = list(weights)
    complete = F.col("n_components") == len(columns)
    return (
        components.withColumn("n_components", count_present(columns))
        .withColumn("risk", weighted_total(weights))
        .withColumn("risk_grade", risk_grade(F.col("risk")))
        .withColumn("risk_grade_name", risk_grade_name(F.col("risk")))
        .withColumn("calc_state", F.when(complete, V.STATE_COMPLETE).otherwise(V.STATE_INCOMPLETE))
    )


def top_factors(names: dict[str, str], limit: int = 2, scores: bool = False) -> Column:
    """Display names (``scores``: with their scores) of the highest components of a row, ties in the given order."""
    entries = F.array(
        *[
            F.struct(F.col(c).alias("score"), F.lit(-i).alias("turn"), F.lit(label).alias("label"))
            for i, (c, label) in enumerate(names.items())
        ]
    )
    present = F.filter(entries, lambda e: e["score"].isNotNull())
    best = F.slice(F.sort_array(present, asc=False), 1, limit)
    return F.transform(best, lambda e: F.struct(e["label"].alias("label"), e["score"].alias("score")) if scores else e["label"])


def contributions(risk: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Mean contribution of each component over complete regions; they add up to the mean risk."""
    weights = weights or V.RISK_WEIGHTS
    means = risk.filter(F.col("risk").isNotNull()).agg(*[F.avg(c).alias(c) for c in weights])
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("component"), F.lit(w).alias("weight"), F.col(c).alias("mean_score"),
                (F.lit(w) * F.col(c)).alias("points"),
            )
            for c, w in weights.items()
        ]
    )
    return means.select(F.inline(rows))
