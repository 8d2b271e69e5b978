import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from wardscope.operators import clusters as K
from wardscope.operators import statistics as T


def test_heatmap_groups_in_local_time(spark):
    df = spark.createDataFrame(
        [("2026-09-07T23:30:00+09:00", "10"), ("2026-09-07T14:30:00Z", "30"), ("2026-09-07T15:30:00Z", "50"), ("bad", "1"), ("2026-09-07T15:30:00Z", "x")],
        "collected_ts string, saturation string",
    )
    got = {r["day_no"]: r for r in T.heatmap(df).collect()}
    assert (got[0]["h23"], got[1]["h00"], got[0]["h00"], got[0]["day"], got[1]["day"]) == (20.0, 50.0, None, "월", "화")


def sample(spark, n=200, seed=1):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, 3))
    x[:, 2] += 0.8 * x[:, 0]
    y = 2 + x @ np.array([1.0, -0.5, 0.25]) + g.normal(scale=0.1, size=n)
    data = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(data + [(n, None, 1.0, 1.0, 1.0)], "k long, a double, b double, c double, y double")


def test_correlation_and_inflation(spark):
    x, y, df = sample(spark)
    matrix = {r["variable"]: r for r in T.correlation_matrix(df, ["a", "b", "c", "y"]).collect()}
    want = np.corrcoef(np.column_stack([x, y]).T)
    for i, p in enumerate("abcy"):
        for j, q in enumerate("abcy"):
            assert matrix[p][q] == pytest.approx(want[i, j])
    inverse = np.linalg.inv(np.corrcoef(x.T))
    assert [r["vif"] for r in T.variance_inflation(df, ["a", "b", "c"]).collect()] == pytest.approx(list(np.diag(inverse)))
    few = df.limit(5)
    assert [r["vif"] for r in T.variance_inflation(few, ["a", "b"]).collect()] == [None, None]
    same = df.withColumn("d", F.col("a") * 2)
    assert T.variance_inflation(same, ["a", "d"]).first()["vif"] > 1e10
    ranking = T.correlation_ranking(T.correlation_matrix(df, ["a", "b", "c", "y"]), "y", ["a", "b", "c"]).collect()
    assert abs(ranking[0]["r"]) >= abs(ranking[1]["r"]) >= abs(ranking[2]["r"])


def test_regression_equals_least_squares(spark):
    x, y, df = sample(spark)
    train = {r["k"] for r in df.filter(T.in_training(F.col("k"))).select("k").collect()}
    part = np.array([i in train for i in range(len(y))])
    design = np.column_stack([np.ones(len(y)), x])
    beta = np.linalg.lstsq(design[part], y[part], rcond=None)[0]
    table, metrics = T.linear_regression(df, "k", ["a", "b", "c"], "y")
    assert [r["coefficient"] for r in table.collect()] == pytest.approx(list(beta[1:]))
    error = y[~part] - design[~part] @ beta
    assert metrics["mae"] == pytest.approx(np.abs(error).mean())
    assert metrics["r2"] == pytest.approx(1 - (error**2).sum() / ((y[~part] - y[~part].mean()) ** 2).sum())
    empty, facts = T.linear_regression(df.limit(4), "k", ["a"], "y")
    assert empty.count() == 0 and facts["status"] == "insufficient_data"


def test_quintiles_are_closed_on_the_left(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 7)], "x double")
    got = {r["x"]: r["quintile"] for r in T.quintile_grade(df, "x").collect()}
    assert got == {1.0: 1, 2.0: 2, 3.0: 3, 4.0: 4, 5.0: 5, 6.0: 5}


COLUMNS = ["a", "b"]


def blobs(spark):
    g = np.random.default_rng(0)
    data = [(f"{c}{i}", float(c * 10 + g.normal()), float(c * 10 + g.normal()), float(c)) for c in (0, 1) for i in range(30)]
    return spark.createDataFrame(data, "region_key string, a double, b double, risk double")


def test_clusters_find_two_groups(spark):
    evaluation, labelled = K.choose_clusters(blobs(spark), COLUMNS, max_k=4)
    best = max(evaluation.collect(), key=lambda r: r["silhouette"])
    assert best["k"] == 2 and labelled.select("cluster").distinct().count() == 2
    profile = K.cluster_profile(labelled, [*COLUMNS, "risk"])
    named = K.cluster_labels(profile)
    assert named.filter("risk > 0.5").first()["cluster_label"] == "접근성·의료진 복합취약형"
    wide = K.profile_by_component(profile, COLUMNS, [0, 1])
    assert wide.columns == ["component", "c0", "c1"]
    gap = rows(K.mean_difference(profile, COLUMNS, 0, 1))
    assert len(gap) == 2 and all(abs(d) > 5 for _, d in gap)


def test_silhouette_equals_direct_computation(spark):
    g = np.random.default_rng(4)
    x, label = g.normal(size=(40, 2)), np.array([0] * 20 + [1] * 19 + [2])
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, label)], "a double, b double, cluster int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = []
    for i, c in enumerate(label):
        if (label == c).sum() == 1:
            want.append(0.0)
            continue
        inside = d[i][(label == c)].sum() / ((label == c).sum() - 1)
        outside = min(d[i][label == o].mean() for o in set(label) - {c})
        want.append((outside - inside) / max(inside, outside))
    assert K.silhouette(df, COLUMNS, "cluster") == pytest.approx(np.mean(want))


def test_degenerate_clusters_are_typed_and_empty(spark):
    same = spark.createDataFrame([("x", 1.0, 1.0, 1.0)] * 5, "region_key string, a double, b double, risk double")
    for df in (same, same.limit(2)):
        evaluation, labelled = K.choose_clusters(df, COLUMNS)
        assert evaluation.columns == ["k", "silhouette"] and evaluation.isEmpty() and labelled.isEmpty() and "cluster" in labelled.columns


def test_regression_display_keeps_order_and_drops_incomplete(spark):
    table = spark.createDataFrame([("b", 2.0), ("a", 1.0), ("c", None), ("x", 9.0)], "variable string, coefficient double")
    labels = {"a": "first", "b": "second", "c": "third"}
    got = T.regression_display(table, {"status": "complete"}, labels).collect()
    assert [(r["label"], r["coefficient"]) for r in got] == [("first", 1.0), ("second", 2.0)]
    assert T.regression_display(table, {"status": "insufficient_data"}, labels).isEmpty()


def test_joint_starts_equal_single_runs(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(m, 0.4, (60, 2)) for m in ((0, 0), (3, 0), (0, 3), (3, 3))])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double").repartition(3)
    fitted = K.fit_many(df, ["a", "b"], [2, 4], seed=1, restarts=5)
    drawn = np.array([list(r) for r in df.orderBy(F.xxhash64("a", "b"), "a", "b").collect()])
    for k in (2, 4):
        costs = []
        for turn in range(5):
            centres = K._first_centres(drawn, k, np.random.default_rng(1 + 1000 * k + turn))
            while True:
                gaps = ((x[:, None] - centres[None]) ** 2).sum(2)
                new = np.array([x[gaps.argmin(1) == j].mean(0) if (gaps.argmin(1) == j).any() else centres[j] for j in range(k)])
                if np.abs(new - centres).max() <= 1e-9:
                    break
                centres = new
            costs.append(gaps.min(1).sum())
        assert fitted[k][1] == pytest.approx(min(costs))
    labelled = K.with_clusters(df, ["a", "b"], fitted)
    assert sorted(r["count"] for r in labelled.groupBy(F.col("clusters")[1]).count().collect()) == [60] * 4
    each = labelled.select("a", "b", F.posexplode("clusters").alias("at", "cluster"))
    joint = {r["at"]: r.s for r in K.silhouette_per_row(each, ["a", "b"], "cluster", "at").groupBy("at").agg(F.avg("silhouette").alias("s")).collect()}
    for at in (0, 1):
        alone = K.silhouette(labelled.withColumn("cluster", F.col("clusters")[at]), ["a", "b"], "cluster")
        assert joint[at] == pytest.approx(alone)
