import random

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardscope.operators import dedupe as D
from wardscope.operators import ordering as O


SHARES = [0.0, 0.05, 0.2, 0.5, 0.95, 1.0]


@pytest.mark.parametrize("n,spread", [(1, 5), (2, 2), (57, 9), (1000, 10_000), (1000, 3)])
def test_distributed_quantiles_are_exact(spark, n, spread):
    random.seed(n + spread)
    values = [float(random.randint(0, spread)) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    assert O.exact_quantiles(df, "x", SHARES) == pytest.approx(list(np.quantile(values, SHARES)))


def test_quantiles_with_one_value_holding_most_rows(spark):
    values = [5.0] * 900 + [float(i) for i in range(100)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert O.exact_quantiles(df, "x", SHARES) == pytest.approx(list(np.quantile(values, SHARES)))


def test_small_and_empty_quantiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    assert O.exact_quantiles(df, "x", [0.5, 0.75]) == [2.0, 3.0]
    assert O.exact_quantiles(df.limit(0), "x", [0.5]) == [None]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=1, max_size=40))
def test_global_ranks_equal_pandas(spark, values):
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i int, x double")
    got = {r["i"]: r["rank"] for r in O.global_rank(df, "x").collect()}
    want = pd.Series([np.nan if v is None else v for v in values], dtype=float).rank(method="min", ascending=False)
    assert got == {i: None if np.isnan(r) else int(r) for i, r in enumerate(want)}
    share = {r["i"]: r["p"] for r in O.percent_rank(df, "x", "p").collect()}
    n = sum(v is not None for v in values)
    low = pd.Series([np.nan if v is None else v for v in values], dtype=float).rank(method="min")
    for i, r in enumerate(low):
        assert share[i] is None if np.isnan(r) else share[i] == pytest.approx((r - 1) / max(n - 1, 1))


def test_ranks_keep_the_type_of_the_value(spark):
    big = spark.createDataFrame([(1, 2**53), (2, 2**53 + 1), (3, None)], "i int, x bigint")
    assert rows(O.global_rank(big, "x"), "i", "rank") == [(1, 2), (2, 1), (3, None)]
    text = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b")], "i int, x string")
    assert rows(O.global_rank(text, "x", descending=False), "i", "rank") == [(1, 2), (2, 1), (3, 2)]
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None), (4, 1.0)], "i int, x double")
    assert rows(O.global_rank(df, "x"), "i", "rank") == [(1, 1), (2, 1), (3, None), (4, 3)]


def test_keep_first_and_last_follow_the_given_order(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, None)], "k string, o int, v string")
    assert rows(D.keep_last(df, ["k"], ["o"])) == [("a", 3, "y"), ("b", 1, None)]
    assert rows(D.keep_first(df, ["k"], ["o"])) == [("a", 1, "x"), ("b", 1, None)]


def test_duplicate_members_are_all_flagged(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5)], "k string, v int")
    flagged = {r["v"]: r["is_duplicate"] for r in D.flag_duplicates(df, ["k"]).collect()}
    assert flagged == {1: True, 2: True, 3: False, 4: False, 5: False}
    nulled = D.null_where_duplicate(df.withColumn("s", F.lit("ok")), "k", ["v"], "s", "twice")
    assert sorted((r["s"], r["v"]) for r in nulled.filter("k = 'a'").collect()) == [("twice", None), ("twice", None)]


def test_top_per_group_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id"))
    top = O.top_per_group(df, ["k"], [F.col("id").desc()], 2)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert rows(top, "k", "rank", "id") == [(0, 1, 999), (0, 2, 996), (1, 1, 997), (1, 2, 994), (2, 1, 998), (2, 2, 995)]
