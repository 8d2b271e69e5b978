"""Exact order statistics and ranks that never need one task to see all rows.

Everything rests on ``running_counts``, whatever the number of rows: rows are first
reduced to value counts (map-side, so repeated values cost nothing), spread over ordered
buckets whose edges come from a fixed-size quantile sketch, and only then accumulated
inside each bucket.  The edges steer the balance, not the result: any edges give the same
exact answer.  One bounded aggregate gives edges and count when a plan is made; the rest
stays lazy, and quantiles enter it as a scalar subquery.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def _bucket(value: Column, edges: list[float]) -> Column:
    """Ordered bucket by a balanced tree of comparisons (six deep for 64 buckets)."""

    def branch(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < edges[middle], branch(low, middle)).otherwise(branch(middle + 1, high))

    return branch(0, len(edges))


def split_points(df: DataFrame, column: str, buckets: int = BUCKETS) -> tuple[list[float], int]:
    """At most ``buckets - 1`` ordered edges from one bounded sketch, and the number of present values."""
    shares = [i / buckets for i in range(1, buckets)]
    # text has no number; its values all meet in one bucket, where they are ordered by themselves
    value = F.lit(None).cast("double") if dict(df.dtypes)[column] == "string" else F.col(column).cast("double")
    row = df.agg(F.percentile_approx(value, shares, 10_000).alias("e"), F.count(column).alias("n")).first()
    return sorted(set(row["e"] or [])), row["n"]


def running_counts(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Per distinct non-null value, in its own type: ``n`` rows, and ``before`` rows with a smaller value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("bucket", _bucket(F.col("value").cast("double"), edges) if edges else F.lit(0))
    totals = counts.groupBy("bucket").agg(F.sum("n").alias("t"))
    # at most BUCKETS rows, so a single ordered window is safe here
    before = F.sum("t").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return counts.join(F.broadcast(offsets), "bucket").select(
        "value", "n", (F.col("offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("before")
    )


def quantiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row with ``q``: linearly interpolated quantiles (position ``(n - 1) * p``), all NULL without a value."""
    values = df.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    edges, total = split_points(values, "v")
    table = running_counts(values, "v", edges)

    def at(rank: int) -> Column:
        return F.max(F.when((F.col("before") <= rank) & (F.lit(rank) < F.col("before") + F.col("n")), F.col("value")))

    parts = []
    for p in shares:
        position = (total - 1) * p
        low, high = at(floor(position)), at(ceil(position))
        parts.append(low + (high - low) * (position - floor(position)))
    return table.agg(F.array(*parts).alias("q"))


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    return list(quantiles(df, column, shares).first()["q"])


def global_rank(df: DataFrame, column: str, name: str = "rank", descending: bool = True) -> DataFrame:
    """1 + number of rows strictly ahead; equal values share a rank, NULL gets NULL."""
    return _ranked(df, column, name, descending)[0]


def _ranked(df: DataFrame, column: str, name: str, descending: bool) -> tuple[DataFrame, int]:
    edges, total = split_points(df, column)
    place = F.lit(total) - F.col("before") - F.col("n") + 1 if descending else F.col("before") + 1
    position = running_counts(df, column, edges).select(F.col("value").alias("_v"), place.cast("bigint").alias(name))
    return df.join(position, F.col(column) == F.col("_v"), "left").select(*df.columns, name), total


def percent_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """(rank - 1) / (rows - 1) ascending over the present values, 0 for a single row."""
    ranked, present = _ranked(df, column, "_r", descending=False)
    share = (F.col("_r") - 1) / F.lit(float(max(present - 1, 1)))
    return ranked.select(*df.columns, share.alias(name))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], limit: int, rank: str = "rank") -> DataFrame:
    """First ``limit`` rows of each key with their rank.

    Spark evaluates the ``rank <= limit`` filter before the shuffle too
    (window group limit), so a map task sends at most ``limit`` rows per key.
    """
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= limit)
