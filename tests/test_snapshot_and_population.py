import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from wardscope.operators import population as P
from wardscope.operators import snapshot as N

NOW = dt.datetime(2026, 9, 4, 0, 0, tzinfo=dt.timezone.utc)
OLD = "2026-09-03T23:00:00+00:00"
MASTER = "entity_id string, name string, grade string, province string, district string"
FEED = "entity_id string, available double, total double, source_ts string, seq int"
PREVIOUS = "entity_id string, available double, total double, source_ts string, collected_ts string, seq int"


def build(spark, master, feed, previous, failed, floor=1):
    return N.build_snapshot(
        spark.createDataFrame([(m, m, "g", p, d) for m, p, d in master], MASTER), spark.createDataFrame(feed, FEED),
        spark.createDataFrame(previous, PREVIOUS), spark.createDataFrame(failed, "province string, district string"),
        NOW, ["seq"], ["seq"], floor,
    )


def fixture(spark, floor=1):
    master = [(f"NEW{i}", "S", "J") for i in (1, 2, 3)] + [(n, "B", "D") for n in ("FRESH", "EXPIRED", "INVALID")]
    feed = [(f"NEW{i}", float(i + 2), 10.0, "20260904085500", i) for i in (1, 2, 3)]
    previous = [
        ("FRESH", 6.0, 10.0, "20260904080000", OLD, 1), ("EXPIRED", 6.0, 10.0, "20260903200000", OLD, 2),
        ("INVALID", -1.0, 10.0, "20260904080000", OLD, 3),
    ]
    return build(spark, master, feed, previous, [("B", "D")], floor)


def test_failed_region_keeps_fresh_and_stale_values(spark):
    snapshot, audit = fixture(spark)
    got = {r["entity_id"]: r for r in snapshot.collect()}
    for name in ("FRESH", "EXPIRED"):
        assert (got[name]["available"], got[name]["total"], got[name]["saturation"], got[name]["status"]) == (6.0, 10.0, 40.0, "여유")
        assert got[name]["collected_ts"] == dt.datetime(2026, 9, 3, 23, 0)
    assert (got["INVALID"]["available"], got["INVALID"]["saturation"], got["INVALID"]["status"]) == (None, None, "결측")
    assert got["NEW1"]["collected_ts"] == dt.datetime(2026, 9, 4, 0, 0)
    want = dict(failed_fresh=1, failed_stale=1, failed_retained=2, failed_masked=1, usable=5, new_response=3, omitted_entities=0, failed_regions=1, requested_regions=2)
    assert {k: audit[k] for k in want} == want


def test_omitted_row_keeps_its_last_value(spark):
    master = [("A", "S", "J"), ("B", "S", "J")]
    snapshot, audit = build(
        spark, master, [("A", 1.0, 2.0, "20260904085500", 1)],
        [("B", 1.0, 4.0, "20260904080000", OLD, 1), ("B", 2.0, 4.0, "20260904080300", OLD, 2)], [],
    )
    assert rows(snapshot.filter("entity_id = 'B'"), "available", "saturation") == [(2.0, 50.0)]
    assert audit["omitted_retained"] == 1


def test_later_feed_row_wins(spark):
    snapshot, _ = build(spark, [("A", "S", "J")], [("A", 1.0, 2.0, "20260904085500", 1), ("A", 2.0, 2.0, "20260904085500", 2)], [], [])
    assert rows(snapshot, "saturation") == [(0.0,)]


def test_future_source_time_is_masked(spark):
    snapshot, _ = build(spark, [("A", "S", "J")], [("A", 1.0, 2.0, "20260904090501", 1)], [], [], floor=0)
    assert rows(snapshot, "available", "status") == [(None, "결측")]
    snapshot, _ = build(spark, [("A", "S", "J")], [("A", 1.0, 2.0, "20260904090500", 1)], [], [], floor=0)
    assert rows(snapshot, "available", "status") == [(1.0, "여유")]


def test_collapsed_feed_is_refused(spark):
    previous = [(f"E{i}", 1.0, 2.0, "20260904080000", OLD, i) for i in range(10)]
    master = [(f"E{i}", "S", "J") for i in range(10)]
    with pytest.raises(RuntimeError, match="dropped"):
        build(spark, master, [("E0", 1.0, 2.0, "20260904085500", 1)], previous, [])
    with pytest.raises(RuntimeError, match="below the floor|dropped"):
        fixture(spark, floor=6)


def test_history_append_and_retention(spark):
    schema = "entity_id string, collected_ts string, v int"
    old = spark.createDataFrame([("a", "2026-09-01T00:00:00Z", 1), ("b", "2026-08-01T00:00:00Z", 1), ("c", "unknown", 1)], schema)
    new = spark.createDataFrame([("a", "2026-09-01T00:00:00Z", 2)], schema)
    history = N.append_history(old, new, ["v"])
    kept = N.trim_history(history, "collected_ts", N.moment(NOW), 30)
    assert rows(kept, "entity_id", "v") == [("a", 2), ("c", 1)]
    assert N.trim_history(history, "collected_ts", N.moment(NOW), None).count() == 3
    with pytest.raises(ValueError):
        N.trim_history(history, "collected_ts", N.moment(NOW), 0)


def test_masks_include_both_ends(spark):
    df = spark.createDataFrame([("20260903210000", OLD), ("20260903205959", OLD), ("20260904090500", OLD), ("x", OLD)], "s string, c string")
    got = [tuple(r) for r in N.validity_masks(df, "s", "c", N.moment(NOW)).select("valid_now", "fresh_now").collect()]
    assert got == [(True, True), (True, False), (True, True), (False, False)]
    with pytest.raises(ValueError):
        N.source_fresh(F.col("s"), F.col("c"), 0)


def stored(spark, **changes):
    row = dict(entity_id="A", available=6.0, total=10.0, saturation=40.0, status="여유", source_ts="20260904080000", collected_ts=OLD)
    row.update(changes)
    return spark.createDataFrame([tuple(row.values())], "entity_id string, available double, total double, saturation double, status string, source_ts string, collected_ts string")


@pytest.mark.parametrize(
    "changes,checks",
    [
        ({}, set()), ({"source_ts": "20260901080000"}, set()), ({"saturation": 41.0}, {"saturation_formula"}), ({"saturation": None}, set()),
        ({"entity_id": "B"}, {"missing_in_snapshot", "unknown_in_snapshot"}), ({"collected_ts": "2026-09-04T01:00:00Z"}, {"collected_in_future"}),
        ({"collected_ts": "later"}, {"collected_unreadable"}),
    ],
)
def test_snapshot_reuse(spark, changes, checks):
    master = spark.createDataFrame([("A", "n", "g", "p", "d")], MASTER)
    bad = N.reuse_violations(master, stored(spark, **changes), N.moment(NOW))
    assert {r["check"] for r in bad.collect()} == checks


def test_reuse_audit_and_rebase(spark):
    audit = N.reuse_audit(stored(spark, source_ts="20260901080000"), N.moment(NOW)).first()
    assert (audit["snapshot_age_minutes"], audit["snapshot_stale"], audit["retained_stale"], audit["usable"]) == (60.0, False, 1, 1)
    moved = N.rebase_snapshot(spark.createDataFrame([("A", "new", "g", "p", "d")], MASTER), stored(spark)).first()
    assert (moved["name"], moved["saturation"]) == ("new", 40.0)


POP = "entity_id string, province string, district string"


def people(spark, ids):
    return spark.createDataFrame([(i, "p", i) for i in ids], POP)


def plan(spark, current, previous, state=(), **limits):
    now = N.moment(NOW)
    cur, prev = people(spark, current), people(spark, previous)
    audit = spark.createDataFrame(list(state), "entity_id string, first_missing_at string, consecutive_misses int")
    carried = P.carry_forward(cur, prev, audit, now)
    return carried, P.population_violations(cur, prev, carried, now, len(previous), len(previous), **limits)


def test_small_omission_is_carried_forward(spark):
    carried, bad = plan(spark, "ABC", "ABCD")
    assert rows(carried, "entity_id", "consecutive_misses") == [("D", 1)]
    assert bad.isEmpty()


@pytest.mark.parametrize(
    "current,previous,state,check",
    [
        ("ABC", "ABCD", [("D", "2026-09-01T12:00:00Z", 3)], "too_many_misses"), ("ABC", "ABCD", [("D", "2026-08-01T00:00:00Z", 1)], "missing_too_long"),
        ("ABCX", "ABCD", [], "added"), ("A", "ABCDE", [], "too_many_missing"), ("ABC", "ABCD", [("D", "2026-09-05T00:00:00Z", 1)], "first_missing_in_future"),
        ("AABC", "ABCD", [], "current_id"),
    ],
)
def test_unsafe_omissions_are_reported(spark, current, previous, state, check):
    _, bad = plan(spark, current, previous, state)
    assert check in {r["check"] for r in bad.collect()}


REGIONS = [("서울특별시", "종로구"), ("세종특별자치시", "세종시")]


def test_registry_residents(spark):
    raw = spark.createDataFrame(
        [("서울특별시  종로구 (1111000000)", "1,234"), ("세종특별자치시  (3600000000)", "9"), ("세종특별자치시 (3611000000)", "380,000")],
        "`행정구역` string, `2026년07월_계_총인구수` string",
    )
    regions = spark.createDataFrame(REGIONS, "province string, district string")
    got = P.residents_from_registry(raw, regions, "202607")
    assert rows(got, "district", "population", "admin_code", "period") == [("세종시", 380000.0, "36110", "202607"), ("종로구", 1234.0, "11110", "202607")]
    assert P.resident_violations(got, regions).isEmpty()
    with pytest.raises(ValueError, match="differs"):
        P.residents_from_registry(raw, regions, "202606")


def test_fallback_residents(spark):
    data = [
        ("'11", "서울특별시", "'000", "", "", "10"), ("'11110", "종로구", "'000", "", "", "5"), ("'11110", "종로구", "'010", "", "", "1"), ("'36", "세종특별자치시", "'000", "", "", "7"),
        ("'29", "광주광역시", "'000", "", "", "1"), ("'29110", "동구", "'000", "", "", "3"), ("'46", "전라남도", "'000", "", "", "1"), ("'46110", "목포시(통합)", "'000", "", "", "4"),
    ]
    raw = spark.createDataFrame(data, "c0 string, c1 string, c2 string, c3 string, c4 string, c5 string")
    regions = spark.createDataFrame(REGIONS + [("전남광주통합특별시", "동구"), ("전남광주통합특별시", "목포시")], "province string, district string")
    got = P.residents_from_fallback(raw, regions, "2025")
    assert rows(got, "district", "population", "admin_code") == [("동구", 3.0, "29110"), ("목포시", 4.0, "46110"), ("세종시", 7.0, "36110"), ("종로구", 5.0, "11110")]
