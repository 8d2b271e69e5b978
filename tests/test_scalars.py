import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardscope.functions import identity_text as N
from wardscope.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def text(value):
    return F.lit(value).cast("string")


def test_clip_keeps_null_and_clamps(spark):
    assert one(spark, S.clip(F.lit(None).cast("double"), 0.0, 1.0)) is None
    assert one(spark, S.clip(F.lit(7.0), 0.0, 1.0)) == 1.0
    assert one(spark, S.clip(F.lit(-7.0), 0.0, 1.0)) == 0.0


def test_number_never_fails(spark):
    for bad in ("abc", "", "NaN", "Infinity", None):
        assert one(spark, S.number(text(bad))) is None
    assert one(spark, S.number(text("12.5"))) == 12.5


def test_ratio_with_zero_divisor(spark):
    assert one(spark, S.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, S.ratio(F.lit(1.0), F.lit(4.0))) == 0.25


@pytest.mark.parametrize("value,grade", [(0.0, 1), (20.0, 1), (20.01, 2), (35.0, 2), (50.0, 3), (65.0, 4), (65.1, 5), (None, None)])
def test_risk_bins_are_closed_on_the_right(spark, value, grade):
    assert one(spark, S.risk_grade(F.lit(value).cast("double"))) == grade


@pytest.mark.parametrize("value,name", [(0.0, "여유"), (50.0, "여유"), (50.1, "주의"), (80.0, "주의"), (100.0, "포화"), (None, "결측")])
def test_status(spark, value, name):
    assert one(spark, S.load_status(F.lit(value).cast("double"))) == name


def test_saturation_clamps(spark):
    assert one(spark, S.saturation(F.lit(6.0), F.lit(10.0))) == 40.0
    assert one(spark, S.saturation(F.lit(12.0), F.lit(10.0))) == 0.0
    assert one(spark, S.saturation(F.lit(1.0), F.lit(0.0))) is None


def test_region_keys(spark):
    assert one(spark, S.region_key(text(" A "), text(None))) == "A|"
    assert one(spark, S.key_province(text("A|B|C"))) == "A"
    assert one(spark, S.key_district(text("A|B|C"))) == "B|C"
    assert one(spark, S.key_province(text("plain"))) == ""
    assert one(spark, S.parent_city(text("수원시영통구"))) == "수원시"
    assert one(spark, S.parent_city(text("영통구"))) is None


def test_address_region(spark):
    province, district = S.address_region(text("  경기도 수원시 팔달구 1"))
    assert (one(spark, province), one(spark, district)) == ("경기도", "수원시")
    province, district = S.address_region(text("세종특별자치시 보듬7로 20"))
    assert (one(spark, province), one(spark, district)) == ("세종특별자치시", "세종시")
    province, district = S.address_region(text(""))
    assert (one(spark, province), one(spark, district)) == ("", "")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_source_time_ignores_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        epoch = one(spark, F.unix_seconds(S.source_time(text("20260904093000.0"))))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert epoch == int(dt.datetime(2026, 9, 4, 0, 30, tzinfo=dt.timezone.utc).timestamp())


@pytest.mark.parametrize("value", ["20260230090000", "2026090409300x", "20260904093000.5", "", None])
def test_bad_source_stamps(spark, value):
    assert one(spark, S.source_time(text(value))) is None


def test_short_stamp_is_padded(spark):
    assert one(spark, S.source_text(text("123"))) == "00000000000123"


def test_instant_accepts_offsets(spark):
    assert one(spark, F.unix_seconds(S.instant(text("2026-09-04T09:00:00+09:00")))) == one(
        spark, F.unix_seconds(S.instant(text("2026-09-04T00:00:00Z")))
    )
    assert one(spark, S.instant(text("not a time"))) is None


def test_strict_date(spark):
    assert one(spark, S.strict_date(text("2026-02-03"))) == dt.date(2026, 2, 3)
    for bad in ("2026-2-3", "2026-02-30", "20260203", ""):
        assert one(spark, S.strict_date(text(bad))) is None


@pytest.mark.parametrize(
    "url,ok",
    [
        ("https://hira.or.kr/a?ykiho=X1", True), ("https://www.hira.or.kr/a?b=1&ykiho=X1", True), ("http://hira.or.kr/a?ykiho=X1", False),
        ("https://nothira.or.kr/a?ykiho=X1", False), ("https://hira.or.kr/a?ykiho=X2", False), ("https://hira.or.kr/a", False), ("garbage", False),
    ],
)
def test_evidence_url(spark, url, ok):
    assert one(spark, S.evidence_url_ok(text(url), "hira.or.kr", F.lit("X1"))) is ok


def test_age_display_and_levels(spark):
    now, then = F.lit("2026-09-04 12:00:00").cast("timestamp"), F.lit("2026-09-04 10:59:30").cast("timestamp")
    assert one(spark, S.age_minutes(now, then)) == 61
    assert one(spark, S.age_minutes(then, now)) == 0
    assert one(spark, S.display_time(F.lit("2026-09-04 00:30:00").cast("timestamp"))) == "09.04. 09:30"
    assert [one(spark, S.correlation_level(F.lit(v))) for v in (-0.1, 0.2, -0.45, 0.6, 0.9)] == ["매우 약함", "약함", "보통", "강함", "매우 강함"]
    assert one(spark, S.short_province(text("전남광주통합특별시"))) == "전남·광주"
    assert one(spark, S.short_district(text("수원시"))) == "수원"


def test_normalised_identity_text(spark):
    assert one(spark, N.normalize_name(text("의료법인 새봄중앙병원(본원)"))) == "새봄중앙"
    assert one(spark, N.normalize_address(text("강원도 춘천시 (효자동) 백령로 156"))) == "강원특별자치도춘천시백령로156"
    assert one(spark, N.road_key(text("서울특별시 강남구 테헤란로 10-0, 3층"))) == "서울특별시강남구테헤란로10"
    assert one(spark, N.road_key(text("서울특별시 강남구"))) == ""
    assert one(spark, N.normalize_phone(text("+82-2-123-4567"))) == "21234567"
    assert one(spark, N.normalize_phone(text("119"))) == "119"
    kinds = {"왜관 한의원": "한의원", "가나 치과 병원": "치과병원", "보건지소": "보건기관", "튼튼의원": "의원", "중앙병원": "병원"}
    for name, kind in kinds.items():
        assert one(spark, N.facility_kind(text(name))) == kind


def test_sequence_similarity_matches_difflib(spark):
    import difflib

    pairs = [("abcdef", "abxdef"), ("새봄중앙응급", "새봄중앙의료원"), ("", "a"), ("same", "same"), ("xyz", "zyx")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(N.sequence_ratio("a", "b")).collect()]
    want = [difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in pairs]
    assert got == pytest.approx(want)


def test_fingerprint_ignores_order_and_sees_changes(spark):
    def mark(ids):
        return spark.createDataFrame([(i,) for i in ids], "id string").agg(S.set_fingerprint(F.col("id"))).first()[0]

    assert mark(["a", "b"]) == mark(["b", "a"]) != mark(["a", "c"])
    assert len(mark(["a"])) == 16
