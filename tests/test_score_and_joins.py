import pytest
from conftest import rows
from pyspark.sql import functions as F

from wardscope.operators import joins as J
from wardscope.operators import score as S


def scores(spark, values, **options):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    return [r["s"] for r in S.percentile_score(df, "x", "s", **options).orderBy("i").collect()]


def test_percentile_score_corners(spark):
    assert scores(spark, [None, None]) == [None, None]
    assert scores(spark, [3.0, 3.0, None]) == [50.0, 50.0, 50.0]
    got = scores(spark, [0.0, 50.0, 100.0, None])
    assert got == [pytest.approx(0.0), pytest.approx(50.0), pytest.approx(100.0), None]
    assert scores(spark, [0.0, 50.0, 100.0], higher_is_risk=False) == pytest.approx([100.0, 50.0, 0.0])


def test_scores_stay_in_range(spark):
    got = scores(spark, [float(i * i) for i in range(50)])
    assert min(got) == 0.0 and max(got) == 100.0


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_staff_zero_is_100_even_without_beds(spark):
    staff = frame(spark, [("a", 0.0), ("b", 2.0), ("c", None), ("d", 4.0), ("e", 0.0)], "region_key string, specialists double")
    totals = frame(spark, [("a", 10.0), ("b", 10.0), ("d", 10.0)], "region_key string, total_beds double")
    got = {r["region_key"]: r["s_staff"] for r in S.staff_component(staff, totals).collect()}
    assert got["a"] == got["e"] == 100.0
    assert got["c"] is None


def test_composite_needs_every_component(spark):
    load = frame(spark, [("a", "A", 10.0, 1), ("b", "B", None, 0)], "region_key string, district string, s_load double, n_reporting long")
    access = frame(spark, [("a", 20.0), ("b", 20.0), ("c", 1.0)], "region_key string, s_access double")
    pop = frame(spark, [("a", 30.0), ("b", 31.0)], "region_key string, s_pop double")
    staff = frame(spark, [("a", 40.0), ("b", 40.0)], "region_key string, s_staff double")
    got = {r["region_key"]: r for r in S.composite_risk(load, access, pop, staff).collect()}
    assert got["a"]["risk"] == pytest.approx(0.35 * 10 + 0.30 * 20 + 0.20 * 30 + 0.15 * 40)
    assert (got["a"]["risk_grade"], got["a"]["calc_state"]) == (2, "완료")
    assert (got["b"]["risk"], got["b"]["n_components"], got["b"]["calc_state"]) == (None, 3, "원천데이터부족")
    assert got["c"]["n_components"] == 1
    absent = S.composite_risk(load, access, None, staff).filter("region_key = 'a'").first()
    assert absent["s_pop"] is None and absent["risk"] is None


def test_placeholder_column_counts_as_missing(spark):
    df = frame(spark, [("a", 50.0), ("b", None)], "region_key string, s_pop double")
    assert rows(S.without_placeholder(df, "s_pop")) == [("a", None), ("b", None)]
    real = frame(spark, [("a", 50.0), ("b", 49.0)], "region_key string, s_pop double")
    assert rows(S.without_placeholder(real, "s_pop")) == [("a", 50.0), ("b", 49.0)]


def test_contributions_add_up_to_the_mean_risk(spark):
    parts = frame(spark, [("a", 10.0, 20.0, 30.0, 40.0), ("b", 50.0, 60.0, 70.0, 80.0), ("c", None, 1.0, 1.0, 1.0)], "region_key string, s_load double, s_access double, s_pop double, s_staff double")
    risk = S.grade(parts)
    assert S.contributions(risk).agg(F.sum("points")).first()[0] == pytest.approx(risk.agg(F.avg("risk")).first()[0])


def test_group_totals_of_nothing_are_null(spark):
    df = frame(spark, [("a", None), ("b", 1.0), ("b", None)], "k string, v double")
    assert rows(S.group_totals(df, ["k"], {"t": "v"})) == [("a", None), ("b", 1.0)]


def test_override_applies_only_on_the_expected_row(spark):
    df = frame(spark, [("1", "X", "old"), ("2", "Y", "old"), ("3", "Z", "old")], "id string, name string, v string")
    ledger = frame(spark, [("1", "X", "new"), ("2", "other", "new")], "id string, n string, v string")
    assert rows(J.apply_overrides(df, ledger, "id", ["v"], {"name": "n"}), "id", "v") == [("1", "new"), ("2", "old"), ("3", "old")]


def test_boundary_keys_fall_back_to_the_parent_city(spark):
    features = frame(spark, [("1", "경기도", "수원시영통구"), ("2", "경기도", "과천시"), ("3", "경기도", "없는군")], "code string, province string, name string")
    regions = frame(spark, [("경기도|수원시",), ("경기도|과천시",)], "region_key string")
    got = rows(J.boundary_keys(features, regions), "code", "matched_key", "match_kind")
    assert got == [("1", "경기도|수원시", "parent"), ("2", "경기도|과천시", "direct"), ("3", None, "none")]


def test_longest_contained_name_wins_within_scope(spark):
    texts = frame(spark, [(1, "경기도", "경기도 수원시 영통구 1"), (2, "경기도", "부산 남구"), (3, "부산", "부산 남구"), (4, "부산", "")], "id int, p string, t string")
    names = frame(spark, [("경기도", "수원시"), ("경기도", "수원시영통구"), ("부산", "남구"), ("부산", "구")], "p string, n string")
    assert rows(J.longest_contained(texts, names, "id", "t", "n", "p"), "id", "matched_name") == [(1, "수원시영통구"), (2, None), (3, "남구"), (4, None)]


def test_substrings_are_never_the_collected_side(spark):
    texts = spark.range(2000).selectExpr("id", "concat('Brand ', id % 7, ' hot bolt of large ring ', repeat('x', 40)) AS t")
    names = frame(spark, [("hot bolt",), ("large ring",), ("bolt",)], "n string")
    found = J.longest_contained(texts, names, "id", "t", "n")
    assert rows(found, "id", "matched_name") == [(i, "large ring") for i in range(2000)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "strategy=merge" in plan
    assert found.filter("id = 5").count() == 1


def test_changes_between_versions(spark):
    a = frame(spark, [("1", "x"), ("2", "x"), ("3", "x")], "id string, v string")
    b = frame(spark, [("2", "x"), ("3", "y"), ("4", "x")], "id string, v string")
    assert [r[:2] for r in rows(J.list_changes(a, b, "id", "v"))] == [("1", "removed"), ("3", "moved"), ("4", "added")]
