import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from wardscope.functions import fixed_values as V
from wardscope.operators import contract as C
from wardscope.operators import missingness as M
from wardscope.operators import serving as D
from wardscope.operators import snapshot as N

SNAP = "entity_id string, name string, grade string, province string, district string, available double, total double, saturation double, status string, source_ts string, collected_ts string"
AT = "2026-09-04T00:30:00Z"


def bed(i, available, total, saturation, source="20260904093000", at=AT):
    return (i, i, "g", "P", "D", available, total, saturation, "여유", source, at)


RISK = "region_key string, district string, s_load double, s_access double, s_pop double, s_staff double, risk double"


def report(spark):
    beds = spark.createDataFrame(
        [bed("A1", None, None, None, None), bed("A2", 1.0, 2.0, 50.0, "20260901000000"), bed("A3", 1.0, None, None), bed("A4", -1.0, 2.0, None), bed("A5", 1.0, 2.0, 50.0), bed("A6", None, 2.0, None), bed("A7", 1.0, 2.0, None)],
        SNAP,
    )
    risk = spark.createDataFrame([("P|D", "D", 1.0, None, 1.0, 1.0, None), ("P|E", "E", 1.0, 1.0, 1.0, 1.0, 1.0)], RISK)
    matches = spark.createDataFrame([("A1", "a", "P", "D", V.STATE_AUTOMATIC), ("A2", "b", "P", "D", V.STATE_AMBIGUOUS)], "entity_id string, name string, province string, district string, match_state string")
    return M.missingness_report(beds, risk, matches, "2026-09-04"), risk


def test_one_reason_each(spark):
    got, risk = report(spark)
    codes = dict(rows(got.filter("entity_type = 'hospital_bed'"), "entity_id", "reason_code"))
    assert codes == {
        "A1": "BED_API_NO_RESPONSE", "A2": "BED_SOURCE_STALE", "A3": "BED_TOTAL_MISSING", "A4": "BED_AVAILABLE_NEGATIVE",
        "A6": "BED_AVAILABLE_MISSING", "A7": "BED_SATURATION_MISSING",
    }
    region = got.filter("entity_type = 'region'").first()
    assert region["priority"] == "P0" and region["missing_fields"] == "접근성점수|regionRisk|위험등급"
    assert region["reason"].startswith("접근성점수 결측; 소속 병원 원인: BED_API_NO_RESPONSE 1건, BED_AVAILABLE_MISSING 1건")
    match = got.filter("entity_type = 'hospital_hira'").first()
    assert match["reason"].endswith("(후보모호)") and match["priority"] == "P2"
    summary = {(r["kind"], r["item"]): r["n"] for r in M.missingness_summary(got, risk).collect()}
    assert summary["total_open_items", "all"] == 8 and summary["missing_component", "접근성점수"] == 1
    cross = {r["reason_code"]: (r["n_all"], r["n_unscored"]) for r in M.reason_by_score_state(got, risk).collect()}
    assert cross["BED_SOURCE_STALE"] == (1, 1)


def test_staffing_withholds_weakly_matched_regions(spark):
    detail = [(f"a{i}", "P", "A", V.STATE_AUTOMATIC, 1.0) for i in range(4)] + [("a4", "P", "A", V.STATE_LOW, None)]
    detail += [("b1", "P", "B", V.STATE_AUTOMATIC, 5.0), ("b2", "P", "B", V.STATE_EXCLUDED, None), ("n", None, "B", V.STATE_LOW, None)]
    df = spark.createDataFrame(detail, "entity_id string, province string, district string, match_state string, specialists double")
    staffing = M.staffing_by_region(df)
    assert rows(staffing, "district", "specialists", "n_total", "n_matched", "quality") == [("A", 4.0, 5, 4, V.QUALITY_OK), ("B", None, 2, 1, V.QUALITY_REVIEW)]
    assert rows(M.quality_gaps(staffing, df), "district", "additional_needed", "n_excluded", "explained") == [("B", 1, 1, True)]


def checks(df):
    return sorted((r["check"], r["key"]) for r in df.collect())


def test_check_kinds(spark):
    df = spark.createDataFrame([("a", 1.0, "x1"), ("a", 9.0, "zz"), (None, None, None)], "k string, v double, f string")
    assert checks(C.unique(df, ["k"], "u")) == [("u", ""), ("u", "a")]
    assert checks(C.not_null(df, ["k"], ["k", "v"], "n")) == [("n", "")]
    assert checks(C.in_range(df, ["k"], "v", 0, 5, "r")) == [("r", ""), ("r", "a")]
    assert checks(C.matches_format(df, ["k"], "f", "^x[0-9]$", "f")) == [("f", ""), ("f", "a")]
    assert checks(C.implies(df, ["k"], F.col("v") > 5, F.col("f") == "x1", "i")) == [("i", "a")]
    other = spark.createDataFrame([("a",), ("b",)], "k string")
    assert checks(C.same_set(df.dropna(), other, ["k"], "s")) == [("s", "b")]
    assert checks(C.subset(other, df.dropna(), ["k"], "s")) == [("s", "b")]
    assert checks(C.disjoint(other, df.dropna(), ["k"], "d")) == [("d", "a")]
    assert checks(C.partition_of([other.filter("k = 'a'"), other.filter("k = 'a'")], other, ["k"], "p")) == [("p:cover", "b"), ("p:overlap", "a")]
    assert checks(C.expected_count(df, 3, "c")) == [] and checks(C.expected_count(df, 4, "c")) == [("c", "count")]
    assert checks(C.single_value(other, "k", "v")) == [("v", "k")]
    assert checks(C.equal_rows(other, other.filter("k = 'a'"), "e"))[0][0] == "e"
    ranks = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 3)], "k string, r int")
    assert checks(C.prefix_ranks(ranks, ["k"], "r", "p")) == [("p", "b")]
    near = df.dropna().limit(1)
    assert checks(C.equal_tables(near, near.withColumn("v", F.col("v") + 1e-9), ["k"], ["f"], ["v"], "q")) == []
    with pytest.raises(ValueError):
        C.require_columns(df, ["missing"], "t")


def test_risk_contract_and_publication(spark):
    from wardscope.operators.score import grade

    parts = spark.createDataFrame([("a", 10.0, 20.0, 30.0, 40.0), ("b", None, 1.0, 1.0, 1.0)], "region_key string, s_load double, s_access double, s_pop double, s_staff double")
    risk = grade(parts)
    assert C.risk_contract(risk, floor=1).isEmpty()
    bad = C.risk_contract(risk.withColumn("risk_grade", F.lit(5)), floor=2)
    assert {"risk_grade", "risk_formula", "risk_floor"} <= {r["check"] for r in bad.collect()}
    done = []
    C.publish_if_clean(C.risk_contract(risk), lambda: done.append(1))
    with pytest.raises(RuntimeError, match="contract violated"):
        C.publish_if_clean(bad, lambda: done.append(2))
    assert done == [1]


def serving(spark):
    master = spark.createDataFrame([(i, i, "g", "P", "D") for i in ("A", "B", "C")], "entity_id string, name string, grade string, province string, district string")
    snapshot = spark.createDataFrame([bed("A", 1.0, 2.0, 50.0), bed("B", 1.0, 2.0, 50.0, "20260903080000"), bed("C", -1.0, 2.0, None)], SNAP)
    risk = spark.createDataFrame([("P|D", "D", 50.0, 40.0, 30.0, 20.0, 39.5, "보통", 2)], RISK + ", risk_grade_name string, n_reporting long")
    return master, snapshot, risk


def test_freshness_states(spark):
    master, snapshot, risk = serving(spark)
    now = N.moment("2026-09-04 01:00:00")
    tables = D.serving_tables(master, snapshot, risk, None, None, now)
    assert dict(rows(tables["facilities"], "entity_id", "freshness")) == {"A": "current", "B": "last-known", "C": "missing"}
    region = tables["regions"].first()
    assert (region["n_facilities"], region["n_reporting"], region["coverage_label"], region["freshness"]) == (3, 2, V.COVERAGE_PART, "last-known")
    assert region["risk_valid_until"] == dt.datetime(2026, 9, 3, 11, 0)
    assert tables["next_expiry"].first()[0] is None
    assert "39.5점 (보통)" in tables["sentences"].first()["sentence"] and "병상포화도(50점)과 접근성(40점)이" in tables["sentences"].first()["sentence"]
    unknown = D.region_detail(risk.withColumn("n_reporting", F.lit(3).cast("long")), D.facility_detail(master, snapshot)).first()
    assert unknown["freshness_unknown"] and unknown["risk_valid_until"] is None
    health = D.health_summary(tables["regions"], tables["facilities"], N.moment("2026-09-04 00:30:00"), now).first()
    assert (health["status"], health["data_age_minutes"], health["expired_facilities"]) == ("degraded", 30, 1)


def test_source_deadline(spark):
    rows_ = [bed("A", 1.0, 2.0, 50.0, "20260904093000"), bed("B", None, None, None, "20260904080000"), bed("C", 1.0, 2.0, 50.0, "20260904090000")]
    got = D.source_deadline(spark.createDataFrame(rows_, SNAP)).first()
    assert got["deadline_at"] == dt.datetime(2026, 9, 4, 12, 0) and len(got["fingerprint"]) == 16 and got["n_entities"] == 1
    empty = D.source_deadline(spark.createDataFrame(rows_[1:2], SNAP)).first()
    assert empty["deadline_at"] is None and empty["fingerprint"] is None


def test_search_and_province_counts(spark):
    df = spark.createDataFrame([("P|수원시",), ("P|과천시",), ("Q|중구",)], "region_key string")
    assert rows(D.search(df, " 수원 ", ["region_key"])) == [("P|수원시",)]
    assert [tuple(r) for r in D.province_counts(df).collect()] == [("P", 2), ("Q", 1)]
