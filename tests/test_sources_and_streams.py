import datetime as dt
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardscope.functions import fixed_values as V
from wardscope.operators import contract as C
from wardscope.sources import readers as R
from wardscope.sources import sinks as W
from wardscope.streaming import feeds as S


def test_csv_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿기관코드,병원명,가용병상\r\n0012,이름,3\r\n".encode())
    df = R.canonical(R.read_csv(spark, str(tmp_path / "a.csv"), ["기관코드"]))
    assert rows(df) == [("0012", "이름", "3")] and df.columns == ["entity_id", "name", "available"]
    with pytest.raises(ValueError):
        R.read_csv(spark, str(tmp_path / "a.csv"), ["없는열"])


def test_optional_table(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    assert R.read_optional(spark, str(tmp_path / "none.csv"), schema).collect() == []
    (tmp_path / "x.csv").write_text("a\n1\nz\n")
    assert R.read_optional(spark, str(tmp_path / "x.csv"), schema).collect() == [(1, None), (None, None)]
    assert R.with_optional_columns(spark.range(1), {"x": "double"}).first()["x"] is None


def test_registry_file_is_chosen_first(spark, tmp_path):
    regions = spark.createDataFrame([("서울특별시", "종로구")], "province string, district string")
    fallback = "가\n나\nc0,c1,c2,c3,c4,c5\n'11,서울특별시,'000,x,y,9\n'11110,종로구,'000,x,y,5\n"
    (tmp_path / "101_DT_1B04006_Y_2025.csv").write_bytes(fallback.encode("cp949"))
    got = R.choose_residents(spark, str(tmp_path), regions)
    assert rows(got, "population", "period", "source") == [(5.0, "202512", V.FALLBACK_SOURCE)]
    for period, n in (("202606", "7"), ("202607", "8")):
        header = f'행정구역,{period[:4]}년{period[4:]}월_계_총인구수\n"서울특별시 종로구 (1111000000)","1,00{n}"\n'
        (tmp_path / f"mois_population_{period}.csv").write_bytes(header.encode("cp949"))
    got = R.choose_residents(spark, str(tmp_path), regions)
    assert rows(got, "population", "admin_code", "period") == [(1008.0, "11110", "202607")]
    assert rows(R.choose_residents(spark, str(tmp_path), regions, period="202606"), "population") == [(1007.0,)]
    with pytest.raises(ValueError):
        R.choose_residents(spark, str(tmp_path), regions, period="26")


def response(code, total, items):
    body = "".join("<item>" + "".join(f"<{k}>{v}</{k}>" for k, v in i.items()) + "</item>" for i in items)
    return f"<response><header><resultCode>{code}</resultCode></header><body><items>{body}</items><totalCount>{total}</totalCount></body></response>"


def test_xml_items_and_response_gate(spark, tmp_path):
    items = [
        {"hpid": "A1", "dutyName": "가", "dutyEmcls": "G006", "wgs84Lat": "37.5", "wgs84Lon": "127", "dutyAddr": "경기도 수원시 1", "dutyTel1": "1"},
        {"phpid": "A2", "dutyName": "나", "dutyEmcls": "G999", "dutyAddr": "세종특별자치시 2", "dutyTel3": "3", "dutyTel1": "1"},
        {"dutyName": "no id"},
    ]
    (tmp_path / "good.xml").write_text(response("00", 3, items))
    got = R.master_rows(R.read_xml_items(spark, str(tmp_path / "good.xml"), R.MASTER_ITEM))
    assert rows(got, "entity_id", "grade", "lat", "phone", "province", "district", "coord_missing") == [
        ("A1", "지역응급의료센터", 37.5, "1", "경기도", "수원시", False), ("A2", "G999", None, "3", "세종특별자치시", "세종시", True),
    ]
    (tmp_path / "bad.xml").write_text(response("22", 0, []))
    (tmp_path / "short.xml").write_text(response("00", 2, items[:1]))
    found = {(r["key"].rsplit("/", 1)[-1], r["check"]) for r in R.response_violations(R.response_facts(spark, str(tmp_path))).collect()}
    assert found == {("bad.xml", "result_code"), ("short.xml", "incomplete")}


def test_specialists_and_catalogue(spark):
    df = spark.createDataFrame([("x", "24", "2"), ("x", "24", ""), ("x", "10", "9"), ("y", "24", "-1")], "catalog_id string, dgsbjtCd string, dtlSdrCnt string")
    assert rows(R.specialist_counts(df)) == [("x", 2.0, 0), ("y", -1.0, 1)]
    ids = spark.createDataFrame([("a",), ("a",), (" ",)], "catalog_id string")
    assert {r["check"] for r in R.catalog_violations(ids, 4).collect()} == {"catalog_rows", "catalog_id"}


def test_route_payloads(spark):
    def body(code, distance, duration):
        return json.dumps({"routes": [{"result_code": code, "summary": {"distance": distance, "duration": duration}}]})

    cases = [
        (body(0, 1500, 120), (1.5, 2.0, 0, V.ROUTE_OK)), (body(104, 0, 0), (0.0, 0.0, 104, V.ROUTE_OK_ZERO)), (body(102, 1, 1), (None, None, 102, "경로오류:102")),
        ('{"routes": []}', (None, None, None, V.ROUTE_NONE)), (body(0, "x", 1), (None, None, 0, V.ROUTE_BAD_FORMAT)), (body(0, -1, 1), (None, None, 0, V.ROUTE_BAD_VALUE)),
        ('{"routes":[{"summary":{}}]}', (None, None, None, "경로오류:None")), ("not json", (None, None, None, V.ROUTE_NONE)),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, payload string")
    got = R.route_results(df).orderBy("i").select("road_km", "eta_min", "route_code", "route_status").collect()
    assert [tuple(r) for r in got] == [c[1] for c in cases]


def test_boundaries(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]
    def feature(code, name, kind, shape):
        return {"type": "Feature", "properties": {"code": code, "name": name, "sidoCode": code[:2], "sido": "경기도", "areaSqm": 1}, "geometry": {"type": kind, "coordinates": shape}}

    doc = {"type": "FeatureCollection", "metadata": {"version": "v1"}, "features": [feature("41111", "수원시", "Polygon", square), feature("41112", "과천시", "MultiPolygon", [square, square])]}
    (tmp_path / "g.json").write_text(json.dumps(doc, ensure_ascii=False))
    got = R.read_boundaries(spark, str(tmp_path / "g.json"))
    assert rows(got, "code", "version", "province", "geometry_type") == [("41111", "v1", "경기도", "Polygon")] + [("41112", "v1", "경기도", "MultiPolygon")] * 2
    assert tuple(got.first()["rings"][0][1]) == (1.0, 0.0)


def test_publication_moves_the_pointer_only_when_clean(spark, tmp_path):
    root, df = str(tmp_path / "out"), spark.range(3)
    clean, dirty = C.expected_count(df, 3, "n"), C.expected_count(df, 4, "n")
    W.publish(spark, {"t": df}, clean, root, "1")
    with pytest.raises(RuntimeError):
        W.publish(spark, {"t": df}, dirty, root, "2")
    assert W.current_version(spark, root).endswith("version=1")
    assert spark.read.parquet(W.current_version(spark, root) + "/t").count() == 3


EVENT = "entity_id string, ts timestamp, value double"


def arrivals(spark, folder, batches):
    for i, data in enumerate(batches):
        stamped = [(e, dt.datetime.fromisoformat(t), v) for e, t, v in data]
        spark.createDataFrame(stamped, EVENT).coalesce(1).write.parquet(f"{folder}/part{i}")
    return S.read_stream(spark, f"{folder}/*", spark.createDataFrame([], EVENT).schema, files_per_batch=1)


BATCHES = [
    [("a", "2026-09-04T00:10:00", 1.0), ("a", "2026-09-04T00:10:00", 1.0), ("b", "2026-09-04T00:20:00", 2.0)],
    [("a", "2026-09-04T00:10:00", 1.0), ("a", "2026-09-04T01:10:00", 3.0), ("b", "2026-09-03T23:50:00", 9.0)],
]


def test_stream_history_has_each_key_once(spark, tmp_path):
    stream = arrivals(spark, str(tmp_path / "in"), BATCHES)
    out = S.run_available(S.unique_history(stream, ["entity_id", "ts"], "ts", "2 days"), "h", location=str(tmp_path / "o"))
    assert S.read_output(spark, out).groupBy("entity_id").count().orderBy("entity_id").collect() == [("a", 2), ("b", 2)]


def test_last_known_survives_a_late_row(spark, tmp_path):
    stream = arrivals(spark, str(tmp_path / "in"), BATCHES)
    out = S.run_available(S.last_known_state(stream, "entity_id", ["ts"], ["ts", "value"]), "l", "update", location=str(tmp_path / "o"), newest_of=["entity_id"])
    assert rows(S.latest_state(spark, out), "entity_id", "value", "n_seen") == [("a", 3.0, 4), ("b", 2.0, 2)]


def test_hourly_stream_equals_batch(spark, tmp_path):
    stream = arrivals(spark, str(tmp_path / "in"), BATCHES)
    out = S.read_output(spark, S.run_available(S.hourly_means(stream, "ts", "value", "2 days"), "m", "complete", location=str(tmp_path / "o")))
    last = out.filter(F.col("batch") == out.agg(F.max("batch")).first()[0])
    flat = spark.createDataFrame([(t, v) for b in BATCHES for _, t, v in b], "collected_ts string, saturation double")
    from wardscope.operators.statistics import heatmap_cells

    assert rows(S.heatmap_from_hours(last)) == rows(heatmap_cells(flat))


def test_miss_counters(spark):
    polls = [("a", d, p) for d, p in ((1, True), (2, False), (3, False))] + [("b", 1, False), ("b", 2, True), ("c", 1, False)]
    got = S.miss_counters(spark.createDataFrame(polls, "entity_id string, polled_at int, present boolean"))
    assert rows(got) == [("a", 2, 3, 2), ("c", 1, 1, 1)]


def test_running_deadline_and_partial_failure(spark, tmp_path):
    stream = arrivals(spark, str(tmp_path / "in"), BATCHES)
    out = S.run_available(S.earliest_deadline(stream, "ts", 12), "d", "complete", location=str(tmp_path / "o"))
    last = S.read_output(spark, out).orderBy(F.col("batch").desc()).first()
    assert last["deadline_at"] == dt.datetime(2026, 9, 4, 11, 50)
    failed = spark.createDataFrame([("b",)], "entity_id string")

    def advance(batch, batch_id):
        return batch.join(failed, "entity_id", "left_anti").withColumn("run", F.lit(batch_id))

    again = S.read_stream(spark, f"{tmp_path}/in/*", spark.createDataFrame([], EVENT).schema, files_per_batch=1)
    out = S.run_available(again, "r", "append", advance, location=str(tmp_path / "p"))
    assert rows(S.read_output(spark, out).groupBy("entity_id").count()) == [("a", 4)]


def test_a_stopped_stream_goes_on_where_it_was(spark, tmp_path):
    for k in range(len(BATCHES)):
        arrivals(spark, str(tmp_path / f"in/{k}"), BATCHES[k : k + 1])
        stream = S.read_stream(spark, f"{tmp_path}/in/*/*", spark.createDataFrame([], EVENT).schema, files_per_batch=1)
        state = S.last_known_state(stream, "entity_id", ["ts"], ["ts", "value"])
        out = S.run_available(state, "l", "update", location=str(tmp_path / "o"), newest_of=["entity_id"])
    assert rows(S.latest_state(spark, out), "entity_id", "value", "n_seen") == [("a", 3.0, 4), ("b", 2.0, 2)]


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    day = [[("a", "2026-09-01T00:10:00", 1.0)], [("a", "2026-09-09T00:10:00", 2.0)], [("a", "2026-09-09T00:15:00", 0.0)], [("a", "2026-09-01T00:20:00", 5.0), ("a", "2026-09-09T00:20:00", 4.0)]]
    stream = arrivals(spark, str(tmp_path / "in"), day)
    out = S.run_available(S.hourly_means(stream, "ts", "value", "1 day"), "m", "update", location=str(tmp_path / "o"), newest_of=["hour_start"])
    assert rows(S.latest_state(spark, out), "value_sum", "value_count") == [(1.0, 1), (6.0, 3)]  # rows are told late by the watermark of the batch before


def test_misses_since_the_last_sighting(spark):
    seen = spark.createDataFrame([("a", 1), ("b", 3)], "entity_id string, last_seen int")
    polls = spark.createDataFrame([(1,), (2,), (3,)], "polled_at int")
    assert rows(S.misses_since(seen, polls, "entity_id", most=1)) == [("a", 2, 2, 3, True)]


def test_changelog_equals_the_whole_state(spark, tmp_path):
    import random

    from wardscope.streaming import changelog

    rng, state, written = random.Random(2), {}, []
    out = str(tmp_path / "log")
    for batch in range(11):
        changed = rng.sample(range(30), rng.randrange(0, 6)) if batch else list(range(30))
        facts = [(k, batch * 100 + k, rng.random() < 0.3) for k in changed]
        for _ in range(2 if batch == 5 else 1):  # a replayed batch changes nothing
            changelog.advance(spark.createDataFrame(facts, "k long, v long, _gone boolean"), out, batch, ["k"])
        for k, v, gone in facts:
            state.pop(k, None)
            if not gone:
                state[k] = v
        assert rows(changelog.state_after(spark, out), "k", "v") == sorted(state.items())
        written.append(spark.read.parquet(f"{out}/batch={batch}").count())
    assert changelog.covering(11) == [11, 10, 8] and changelog.covering(6, 4) == [6]
    assert all(n <= 12 for n in written[2::2])  # every other batch writes its own changes and at most one part more
    assert rows(changelog.state_after(spark, out, 0), "k").__len__() <= 30


def test_a_state_that_empties_stays_empty(spark, tmp_path):
    from wardscope.streaming import changelog

    out = str(tmp_path / "log")
    for batch, gone in enumerate([False, False, False, True]):
        changelog.advance(spark.createDataFrame([(1, batch, gone)], "k long, v long, _gone boolean"), out, batch, ["k"])
    assert changelog.state_after(spark, out).collect() == []


def test_entities_expire_and_may_come_back(spark, tmp_path):
    day = "2026-09-{:02d}T00:00:00".format
    batches = [[("a", day(1), 1.0), ("b", day(1), 2.0), ("b", day(1), 5.0)], [("b", day(9), 3.0)], [("c", day(10), 4.0)], [("a", day(11), 6.0), ("c", day(3), 9.0)], [("d", day(20), 7.0)]]
    out = {}
    for k in (3, 4, 5):
        stream = arrivals(spark, str(tmp_path / f"in{k}"), batches[:k])
        found = S.expiring_state(stream, "entity_id", "ts", 48, "1 hour")
        out[k] = rows(S.latest_state(spark, S.run_available(found, "e", "update", location=str(tmp_path / f"o{k}"), newest_of=["entity_id"])), "entity_id", "value")
    assert out == {3: [("b", 3.0), ("c", 4.0)], 4: [("a", 6.0), ("b", 3.0), ("c", 4.0)], 5: [("d", 7.0)]}


def test_old_days_are_dropped_as_folders(spark, tmp_path):
    day = "2026-09-{:02d}T00:00:00".format
    stream = arrivals(spark, str(tmp_path / "in"), [[("a", day(d), 1.0) for d in (1, 2, 3)], [("b", day(4), 1.0), ("b", day(2), 2.0)], [("c", day(9), 1.0)]])
    root = str(tmp_path / "history")
    out = S.run_available(stream, "k", shape=S.keep_days("ts", 2, root), location=str(tmp_path / "o"))
    assert rows(spark.read.parquet(root), "entity_id", "value") == [("c", 1.0)]
    assert rows(S.read_output(spark, out), "run", "folders", "dropped")[:2] == [(0, 3, 0), (1, 4, 1)]
    assert len(list((tmp_path / "history").glob("batch=*/day=*"))) == 1


def test_failed_regions_keep_their_last_good_rows(spark, tmp_path):
    for k, data in enumerate(([("a", 1.0), ("b", 1.0)], [("a", 2.0), ("b", 2.0)], [("a", 3.0)])):
        stamped = [(e, dt.datetime(2026, 9, 4, k), v) for e, v in data]
        spark.createDataFrame(stamped, EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/slice={k}")
    stream = S.with_run(S.read_stream(spark, f"{tmp_path}/in/*", spark.createDataFrame([], EVENT).schema, files_per_batch=1)).withColumn("region", F.col("entity_id"))
    failed = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (0, "b")], "run int, region string")
    state = S.keep_last_good(stream, failed, ["run", "region"], "entity_id", ["ts"], ["ts", "value", "run"])
    out = S.run_available(state, "g", "update", location=str(tmp_path / "o"), newest_of=["entity_id"])
    assert rows(S.latest_state(spark, out), "entity_id", "value", "run", "n_seen") == [("a", 3.0, 2, 2), ("b", 2.0, 1, 1)]
    found = S.deadline_per_batch(spark, out, "ts", 12)
    assert rows(found, "run", "deadline_at", "n_entities") == [(0, dt.datetime(2026, 9, 4, 12), 1), (1, dt.datetime(2026, 9, 4, 12), 2), (2, dt.datetime(2026, 9, 4, 13), 2)]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    from wardscope.sources import readers

    names = ["가", "나다", "x, y"]
    for name, n in (("a", 700), ("b", 3)):
        body = [f"제목 {name}", "", "둘째", "c0,c1,c2"] + [f'{k},"{names[k % 3]}",{k * k}' for k in range(n)]
        (tmp_path / f"{name}.csv").write_bytes("\n".join(body).encode("cp949"))
    (tmp_path / "empty.csv").write_bytes(b"")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = readers.numbered_lines(spark, str(tmp_path), readers.KOREAN_CHARSET)
        assert lines.filter("path like '%/a.csv'").select("line").distinct().count() == 703
        assert lines.agg({"line": "max"}).first()[0] == 702
        got = sorted(tuple(r) for r in readers.read_positional(spark, str(tmp_path), 3).collect())
        whole = sorted(tuple(r) for r in readers.read_positional(spark, str(tmp_path), 3, multi_line=True).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = sorted((str(k), names[k % 3], str(k * k)) for n in (700, 3) for k in range(n))
    assert got == whole == want


def test_slices_have_as_many_files_whatever_their_rows(spark):
    """A stream that takes that many files at a time takes one whole slice, also where a slice has few rows."""
    rows = spark.range(0, 1000, 1, 8)
    arrival = F.when(F.col("id") < 3, 0).when(F.col("id") < 900, 1).otherwise(2)
    folder, files = S.land_in_slices(rows, arrival, 3, "slices")
    stream = S.with_run(S.read_stream(spark, folder, rows.schema, files_per_batch=files))
    out = S.run_available(stream, "slices_read")
    per_batch = S.read_output(spark, out).groupBy("batch", "run").count()
    assert sorted(tuple(r) for r in per_batch.collect()) == [(0, 0, 3), (1, 1, 897), (2, 2, 100)]
