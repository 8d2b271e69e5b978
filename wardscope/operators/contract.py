"""Publication contract: every check yields rows (check, key, detail); none may remain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardscope.functions import fixed_values as V

COLUMNS = ["check", "key", "detail"]


def _key(columns: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def _rows(df: DataFrame, check: str, key: list[str] | Column, detail: Column | None = None) -> DataFrame:
    shown = _key(key) if isinstance(key, list) else key
    text = F.lit(None).cast("string") if detail is None else detail.cast("string")
    return df.select(F.lit(check).alias("check"), shown.cast("string").alias("key"), text.alias("detail"))


def require_columns(df: DataFrame, columns: list[str], name: str) -> None:
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise ValueError(f"{name} lacks columns: {', '.join(lost)}")


def _dealt(df: DataFrame, columns: list[str], tasks: int | None) -> DataFrame:
    """Rows dealt to a fixed number of tasks.

    Adaptive execution merges tasks by the size of their files, and keys in order shrink there to
    a few bytes, so that one task would count the keys of a whole table.
    """
    return df.repartition(tasks, *columns) if tasks else df


def unique(df: DataFrame, columns: list[str], check: str, tasks: int | None = None) -> DataFrame:
    """Keys that repeat, and keys with an empty part; ``tasks`` bounds the memory where most keys differ."""
    counted = _dealt(df.select(*columns), columns, tasks).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    empty = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    return _rows(counted.filter((F.col("n") > 1) | empty), check, columns, F.col("n"))


def not_null(df: DataFrame, key: list[str], columns: list[str], check: str) -> DataFrame:
    lost = F.array_join(
        F.filter(F.array(*[F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(c)) for c in columns]), lambda x: x.isNotNull()), ","
    )
    return _rows(df.withColumn("_lost", lost).filter("_lost <> ''"), check, key, F.col("_lost"))


def holds(df: DataFrame, key: list[str], condition: Column, check: str, detail: Column | None = None) -> DataFrame:
    """Rows where the condition is false or unknown (range, domain, format, formula, implication)."""
    return _rows(df.filter(~F.coalesce(condition, F.lit(False))), check, key, detail)


def in_range(df: DataFrame, key: list[str], column: str, low, high, check: str) -> DataFrame:
    return holds(df, key, F.col(column).between(low, high), check, F.col(column))


def in_domain(df: DataFrame, key: list[str], column: str, allowed: list, check: str) -> DataFrame:
    return holds(df, key, F.col(column).isin(allowed), check, F.col(column))


def matches_format(df: DataFrame, key: list[str], column: str, pattern: str, check: str) -> DataFrame:
    return holds(df, key, F.col(column).cast("string").rlike(pattern), check, F.col(column))


def implies(df: DataFrame, key: list[str], premise: Column, conclusion: Column, check: str) -> DataFrame:
    return holds(df.filter(F.coalesce(premise, F.lit(False))), key, conclusion, check)


def same_set(left: DataFrame, right: DataFrame, columns: list[str], check: str) -> DataFrame:
    a, b = left.select(*columns).distinct(), right.select(*columns).distinct()
    return _rows(a.join(b, columns, "left_anti"), check, columns, F.lit("only_left")).unionByName(
        _rows(b.join(a, columns, "left_anti"), check, columns, F.lit("only_right"))
    )


def subset(left: DataFrame, right: DataFrame, columns: list[str], check: str) -> DataFrame:
    return _rows(left.select(*columns).distinct().join(right, columns, "left_anti"), check, columns, F.lit("unknown"))


def disjoint(left: DataFrame, right: DataFrame, columns: list[str], check: str) -> DataFrame:
    return _rows(left.select(*columns).distinct().join(right, columns, "left_semi"), check, columns, F.lit("in_both"))


def partition_of(parts: list[DataFrame], whole: DataFrame, columns: list[str], check: str) -> DataFrame:
    """The parts are pairwise disjoint and together equal the whole."""
    union = reduce(lambda a, b: a.unionByName(b), [p.select(*columns) for p in parts])
    return unique(union, columns, check + ":overlap").unionByName(same_set(union, whole, columns, check + ":cover"))


def count_at_least(df: DataFrame, condition: Column, floor: int, check: str) -> DataFrame:
    n = df.agg(F.count_if(condition).alias("n"))
    return _rows(n.filter(F.col("n") < floor), check, F.lit("count"), F.col("n"))


def expected_count(df: DataFrame, expected: int, check: str) -> DataFrame:
    n = df.agg(F.count(F.lit(1)).alias("n"))
    return _rows(n.filter(F.col("n") != expected), check, F.lit("count"), F.col("n"))


def single_value(df: DataFrame, column: str, check: str, expected=None) -> DataFrame:
    v = df.agg(F.count_distinct(column).alias("n"), F.min(column).cast("string").alias("v"))
    bad = F.col("n") != 1
    if expected is not None:
        bad = bad | ~F.col("v").eqNullSafe(F.lit(str(expected)))
    return _rows(v.filter(bad), check, F.lit(column), F.col("v"))


def equal_tables(
    stored: DataFrame, recomputed: DataFrame, keys: list[str], exact: list[str], close: list[str], check: str, tolerance: float = 1e-8
) -> DataFrame:
    """Stored table against its recomputation: same keys, equal text, numbers within tolerance."""
    a = stored.select(*keys, *[F.col(c).alias(f"a_{c}") for c in exact + close], F.lit(True).alias("_a"))
    b = recomputed.select(*keys, *[F.col(c).alias(f"b_{c}") for c in exact + close], F.lit(True).alias("_b"))
    differs = [F.when(F.col("_a").isNull(), F.lit("not_stored")), F.when(F.col("_b").isNull(), F.lit("not_expected"))]
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    for c in exact:
        differs.append(F.when(both & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)))
    for c in close:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        same = (x.isNull() & y.isNull()) | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))
        differs.append(F.when(both & ~same, F.lit(c)))
    text = F.array_join(F.filter(F.array(*differs), lambda x: x.isNotNull()), ",")
    return _rows(a.join(b, keys, "full").withColumn("_d", text).filter("_d <> ''"), check, keys, F.col("_d"))


def equal_rows(left: DataFrame, right: DataFrame, check: str) -> DataFrame:
    """Bag equality of whole rows."""
    key = F.sha2(F.to_json(F.struct(*left.columns)), 256)
    return _rows(left.exceptAll(right.select(*left.columns)), check, key, F.lit("only_left")).unionByName(
        _rows(right.select(*left.columns).exceptAll(left), check, key, F.lit("only_right"))
    )


def prefix_ranks(df: DataFrame, keys: list[str], rank: str, check: str, tasks: int | None = None) -> DataFrame:
    """Ranks of each key are 1..n without holes or repeats; ``tasks`` bounds the memory where there are many keys."""
    facts = _dealt(df.select(*keys, rank), keys, tasks).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max(rank).alias("hi"), F.min(rank).alias("lo"), F.count_distinct(rank).alias("d")
    )
    good = (F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("d") == F.col("n"))
    return holds(facts, keys, good, check, F.col("n"))


def risk_contract(risk: DataFrame, weights: dict[str, float] | None = None, floor: int = 0) -> DataFrame:
    """State matches score, range, recomputed grade, and the completeness floor."""
    from wardscope.functions.scalars import risk_grade
    from wardscope.operators.score import grade

    weights = weights or V.RISK_WEIGHTS
    again = grade(risk.select("region_key", *weights), weights)
    complete = F.col("calc_state") == V.STATE_COMPLETE
    return union_all(
        [
            unique(risk, ["region_key"], "risk_key"),
            holds(risk, ["region_key"], complete == F.col("risk").isNotNull(), "risk_state"),
            implies(risk, ["region_key"], F.col("risk").isNotNull(), F.col("risk").between(0, 100), "risk_range"),
            holds(risk, ["region_key"], F.col("risk_grade").eqNullSafe(risk_grade(F.col("risk"))), "risk_grade"),
            equal_tables(risk, again, ["region_key"], ["risk_grade", "calc_state"], ["risk"], "risk_formula"),
            count_at_least(risk, F.col("risk").isNotNull(), floor, "risk_floor"),
        ]
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def publish_if_clean(violations: DataFrame, write) -> None:
    """Run ``write`` only when no violation exists; otherwise raise with a few examples."""
    bad = violations.take(5)
    if bad:
        shown = "; ".join(f"{r['check']}[{r['key']}] {r['detail']}" for r in bad)
        raise RuntimeError(f"contract violated: {shown}")
    write()
