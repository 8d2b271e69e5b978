import itertools
import random

import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from wardscope.functions import fixed_values as V
from wardscope.operators import assignment as A
from wardscope.operators import matching as M
from wardscope.operators.assignment import _solve

T = "entity_id string, name string, address string, phone string, lat string, lon string, province string, district string"
C = "catalog_id string, name string, address string, phone string, lat string, lon string, kind string, province string, district string"
PROVINCES = ["서울특별시", "부산광역시", "경기도", "강원특별자치도", "강원도"]


def target(code, name="새봄중앙병원", address="서울특별시 강남구 테헤란로 10", phone="02-123-4567", lat="37.5", lon="127.0", province="서울특별시", district="강남구"):
    return (code, name, address, phone, lat, lon, province, district)


def candidate(code, name="의료법인 새봄중앙병원", address="서울특별시 강남구 테헤란로 10", phone="02-123-4567", lat="37.5", lon="127.0", kind=None, province=None, district=None):
    return (code, name, address, phone, lat, lon, kind, province, district)


def run(spark, targets, candidates, **options):
    return M.match_catalog(spark.createDataFrame(targets, T), spark.createDataFrame(candidates, C), PROVINCES, **options)


def full_pairs(spark, targets, candidates, similarity="edit"):
    """Brute force over the whole pool."""
    t, c = M.prepare_targets(spark.createDataFrame(targets, T)), M.prepare_catalog(spark.createDataFrame(candidates, C))
    tiers = M.target_tiers(t, c, PROVINCES)
    pairs = t.crossJoin(c).join(tiers, "entity_id")
    pairs = pairs.withColumn("province_matches", F.exists("t_provinces", lambda p: F.col("c_region").contains(p)))
    pairs = pairs.withColumn("district_matches", F.arrays_overlap("t_districts", "c_tokens"))
    pool = ((F.col("tier") == 1) & F.col("province_matches") & F.col("district_matches")) | ((F.col("tier") == 2) & F.col("province_matches")) | (F.col("tier") == 3)
    from wardscope.functions import geodesy as G

    distance = G.haversine_km(F.col("t_lat"), F.col("t_lon"), F.col("c_lat"), F.col("c_lon"), G.MATCH_EARTH_KM)
    return M.scored_pairs(pairs.filter(pool).withColumn("distance_km", distance), similarity)


def score(spark, t, c):
    return full_pairs(spark, [t], [c]).first()


def test_same_place_matches_automatically(spark):
    got = run(spark, [target("N1")], [candidate("H1")])
    assert rows(got["states"]) == [("N1", "H1", 1.0, V.STATE_AUTOMATIC)]
    review = got["review"].first()
    assert review["selected"] and review["gate_reason"] == V.GATE_PASSED and review["distance_m"] == 0.0


def test_each_signal_raises_the_score(spark):
    t = target("N1", name="새봄중앙응급병원")
    base = dict(name="새봄중앙의료원", address="", phone="", lat="", lon="")
    low = score(spark, t, candidate("B", **base))["match_score"]
    for better in (dict(address=t[2]), dict(phone="02 123 4567"), dict(lat="37.5001", lon="127.0001")):
        assert score(spark, t, candidate("X", **{**base, **better}))["match_score"] > low


def test_district_needs_a_whole_token(spark):
    t = target("N1", province="경기도", district="양주시", address="경기도 양주시 평화로 10")
    far = score(spark, t, candidate("R", address="경기도 남양주시 평화로 10", district="남양주시"))
    near = score(spark, t, candidate("L", address="경기도 양주시 평화로 10", district="양주시"))
    assert not far["district_matches"] and near["district_matches"]


def test_gate_reasons_come_in_order(spark):
    t = target("N1")
    assert score(spark, t, candidate("1", name="새봄중앙한의원"))["gate_reason"] == V.GATE_FACILITY
    foreign = candidate("2", address="부산광역시 강서구 테헤란로 10", phone="", lat="35.17", lon="129.07")
    assert score(spark, t, foreign)["gate_reason"] == V.GATE_REGION
    assert score(spark, t, candidate("3", name="다른곳병원", address="서울특별시 강남구 다른로 9", phone=""))["gate_reason"] == V.GATE_SCORE
    lone = candidate("4", address="서울특별시 강남구 테헤란로 11", phone="", lat="37.51", lon="127.0")
    assert score(spark, t, lone)["gate_reason"] == V.GATE_CROSS


def test_old_province_names_still_match(spark):
    t = target("N1", province="강원특별자치도", district="춘천시", address="강원특별자치도 춘천시 백령로 1")
    got = score(spark, t, candidate("H", address="강원도 춘천시 백령로 1"))
    assert got["province_matches"] and got["address_exact"]


def test_close_candidates_are_deferred(spark):
    got = run(spark, [target("N1")], [candidate("H1"), candidate("H2")])
    assert rows(got["states"], "match_state") == [(V.STATE_AMBIGUOUS,)]


def test_one_id_is_never_given_twice(spark):
    weaker = target("N2", address="서울특별시 강남구 다른로 20", phone="02-999-9999", lat="37.503", lon="127.0")
    got = run(spark, [weaker, target("N1")], [candidate("S")])
    states = {r["entity_id"]: r["match_state"] for r in got["states"].collect()}
    assert states["N1"] == V.STATE_AUTOMATIC and states["N2"] in (V.STATE_CONFLICT, V.STATE_LOW)
    assert got["assignments"].count() == 1


def test_manual_and_excluded_targets_stay_out(spark):
    manual = spark.createDataFrame([("N1", "H1")], "entity_id string, catalog_id string")
    got = run(spark, [target("N1"), target("N2")], [candidate("H1"), candidate("H2")], manual=manual)
    assert rows(got["assignments"], "entity_id", "catalog_id") == [("N2", "H2")]
    excluded = spark.createDataFrame([("N1",)], "entity_id string")
    got = run(spark, [target("N1")], [candidate("H1")], excluded=excluded)
    assert got["assignments"].isEmpty() and got["review"].count() == 1


def test_copies_in_the_catalogue_are_all_ranked(spark):
    many = [candidate(f"H{i:03d}") for i in range(60)]
    kept = M.prepare_catalog(spark.createDataFrame(many, C))
    assert kept.count() == 60
    got = run(spark, [target("N1")], many)
    assert rows(got["ranked"], "catalog_id") == [(f"H{i:03d}",) for i in range(20)]
    assert rows(got["states"], "match_state") == [(V.STATE_AMBIGUOUS,)]


def test_first_received_row_of_an_id_stays(spark):
    both = spark.createDataFrame([(*candidate("H", name="나중"), 2), (*candidate("H", name="먼저"), 1)], C + ", seq int")
    assert rows(M.prepare_catalog(both, "seq"), "c_name") == [("먼저",)]


def test_every_target_has_review_rows(spark):
    lone = target("N2", name="딴이름", address="제주도 어딘가 1", phone="", lat="", lon="", province="제주도", district="서귀포시")
    got = run(spark, [target("N1"), lone], [candidate("H1"), candidate("H2", name="푸른의원", address="서울특별시 강남구 먼길 3", phone="", lat="38", lon="128")])
    assert {r["entity_id"] for r in got["review"].collect()} == {"N1", "N2"}
    first = {r["entity_id"]: r["top_margin"] for r in got["review"].filter("rank = 1").collect()}
    assert first["N1"] < 1.0  # the runner-up shares nothing with the target, and still counts


@pytest.mark.parametrize("salts", [1, 16])
def test_pools_equal_the_definition(spark, monkeypatch, salts):
    """Random places, some in no known province: every pair of each pool, once."""
    monkeypatch.setattr(M, "POOL_SALTS", salts)
    random.seed(7)
    names = ["새봄중앙병원", "새봄중앙의료원", "푸른의원", "푸른병원", "한빛병원", "한빛중앙병원"]
    roads = ["테헤란로 10", "테헤란로 11", "중앙로 3", "중앙로 3-0"]
    phones = ["02-123-4567", "02-765-4321", ""]
    places = [("37.5", "127.0"), ("37.505", "127.0"), ("37.512", "127.003"), ("", "")]

    def pick(i, kind):
        province, district = random.choice([("서울특별시", "강남구"), ("서울특별시", "중구"), ("부산광역시", "중구")])
        lat, lon = random.choice(places)
        common = (i, random.choice(names), f"{province} {district} {random.choice(roads)}", random.choice(phones), lat, lon)
        return common + ((province, district) if kind == "t" else (None, province, district))

    targets = [pick(f"T{i}", "t") for i in range(25)]
    candidates = [pick(f"C{i}", "c") for i in range(60)]
    targets += [target("L1", province="제주도", district="서귀포시"), target("L2", district="없는구"), target("L3", province="", district="")]
    candidates.append(candidate("C99", address="서울특별시 강남구 중구 테헤란로 10 부산광역시"))
    t, c = M.prepare_targets(spark.createDataFrame(targets, T)), M.prepare_catalog(spark.createDataFrame(candidates, C))
    made = M.scored_pairs(M.pool_pairs(t, c, M.target_tiers(t, c)))
    wanted = full_pairs(spark, targets, candidates)
    key = ["entity_id", "catalog_id", F.round("match_score", 9)]
    assert rows(made.select(*key)) == rows(wanted.select(*key))


def pool_of(spark, n_targets, n_candidates):
    random.seed(11)
    words = ["새봄", "중앙", "푸른", "한빛", "병원", "의료원", "의원", "12", "71"]

    def name():
        return "".join(random.choice(words) for _ in range(random.randint(1, 4)))

    targets = [target(f"T{i}", name=name(), address=f"서울특별시 강남구 테헤란로 {random.randint(1, 400)}") for i in range(n_targets)]
    candidates = [candidate(f"C{i:03}", name=name(), address=f"서울특별시 강남구 테헤란로 {random.randint(1, 400)}") for i in range(n_candidates)]
    return M.prepare_targets(spark.createDataFrame(targets, T)), M.prepare_catalog(spark.createDataFrame(candidates, C))


@pytest.mark.parametrize("similarity", ["edit", "sequence"])
def test_best_pairs_equal_the_best_of_all_pairs(spark, monkeypatch, similarity):
    monkeypatch.setattr(M, "PARTS", (8, 2))
    t, c = pool_of(spark, 12, 200)
    tiers = M.target_tiers(t, c)
    key = ["entity_id", "catalog_id", "rank", "match_score", "name_similarity", "address_similarity", "gate_reason"]
    made = M.best_pairs(t, c, tiers, similarity=similarity, limit=5)
    assert rows(made, *key) == rows(M.ranked_pairs(M.scored_pairs(M.pool_pairs(t, c, tiers), similarity), 5), *key)


def test_a_crowded_pool_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(M, "POOL_PAIRS", 100)
    t, c = pool_of(spark, 20, 150)
    pairs = M.pool_pairs(t, c, M.target_tiers(t, c)).select("entity_id", F.spark_partition_id().alias("p"))
    assert pairs.count() == 3000
    assert pairs.select("p").distinct().count() >= 8


def odd_pool(spark):
    """Places of all tiers, texts of 0 to 90 letters, ids that repeat, coordinates that are missing or just at a limit."""
    random.seed(5)
    words = ["새봄", "중앙", "푸른", "한빛", "병원", "의료원", "의원", "12", "71", "clinic", "annex"]
    places = [("서울특별시", "강남구"), ("서울특별시", "중구"), ("부산광역시", "중구"), ("부산광역시", "동구"), ("제주도", "없는구"), ("", "")]

    def text():
        return "".join(random.choice(words) for _ in range(random.choice([0, 1, 2, 3, 30])))

    def near():
        return random.choice([("37.5", "127.0"), ("37.50225", "127.0"), ("37.6", "127.1"), ("", "")])

    def row(i, side):
        province, district = random.choice(places if side == "t" else places[:3])
        address = f"{province} {district} 테헤란로 {random.randint(1, 40)} {text()}"
        common = (i, text(), address, random.choice(["02-123-4567", "02-765-4321", ""]), *near())
        return common + ((province, district) if side == "t" else (random.choice(["의원", None]), province, district))

    targets = [row(f"T{i // 2 if i < 6 else i}", "t") for i in range(40)] + [target("twice")] * 2
    candidates = [row(f"C{i:03}", "c") for i in range(150)] + [candidate("both", address="서울특별시 강남구 중구 테헤란로 10 부산광역시")]
    return M.prepare_targets(spark.createDataFrame(targets, T)).cache(), M.prepare_catalog(spark.createDataFrame(candidates, C)).cache()


@pytest.mark.parametrize("pairs", [1 << 24, 100])
def test_scored_pools_equal_the_scores_of_all_pairs(spark, monkeypatch, pairs):
    monkeypatch.setattr(M, "POOL_PAIRS", pairs)
    t, c = odd_pool(spark)
    tiers = M.target_tiers(t, c).cache()
    key = ["entity_id", "catalog_id", "tier", "province_matches", "district_matches", F.coalesce(F.round("distance_km", 9), F.lit(-1.0)), "name_similarity", "address_similarity",
           "name_exact", "name_contains", "address_exact", "road_matches", "phone_matches", "facility_matches", "match_score", "gate_reason", "gate_passed"]
    wanted = rows(M.scored_pairs(M.pool_pairs(t, c, tiers)), *key)
    assert {r[2] for r in wanted} == {1, 2, 3} and rows(M.scored_pool(t, c, tiers), *key) == wanted


@pytest.mark.parametrize("similarity", ["edit", "sequence"])
def test_best_of_cells_equal_the_best_of_odd_pools(spark, monkeypatch, similarity):
    for name, value in (("BEST_TARGETS", 7), ("BEST_ROWS", 40), ("PARTS", (5, 9))):
        monkeypatch.setattr(M, name, value)
    t, c = odd_pool(spark)
    tiers = M.target_tiers(t, c)
    key = ["entity_id", "catalog_id", "rank", "match_score", "name_similarity", "address_similarity", "gate_reason"]
    assert rows(M.best_pairs(t, c, tiers, similarity=similarity, limit=6), *key) == rows(M.ranked_pairs(M.scored_pairs(M.pool_pairs(t, c, tiers), similarity), 6), *key)


def test_rows_of_a_crowded_place_travel_few_times(spark, monkeypatch):
    """Thirty targets and 600 rows in cells of 100 pairs: each target goes to the parts of the other side, not to every cell."""
    monkeypatch.setattr(M, "POOL_PAIRS", 100)
    t, c = pool_of(spark, 30, 600)
    tiers = M.target_tiers(t, c)
    wanted, offered = M._pool_sides(t.join(tiers, "entity_id"), c, M.province_names(t))
    left, right, _ = M._dealt(wanted, offered, M.pool_plan(wanted, offered, (10, 10)), "entity_id")
    assert left.count() == 30 * 60 and right.count() == 600 * 3


def test_few_pairs_of_a_pool_are_compared(monkeypatch):
    """The best of 20 targets among 5,000 rows: texts of few pairs are compared step by step."""
    import pyarrow as pa

    from wardscope.operators import pools

    random.seed(2)
    names = ["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=10)) for _ in range(5000)]
    made = [(0, k < 20, n, random.random()) for k, n in enumerate([x[:9] + "!" for x in names[:20]] + names)]
    columns = {x.split()[0]: [None] * len(made) for x in pools.SCHEMA.split(",")}
    columns |= {"cell": [0] * len(made), "side": [0 if t else 1 for _, t, _, _ in made], "tid": [k if k < 20 else None for k in range(len(made))], "id": [str(k) for k in range(len(made))]}
    columns |= {"name": [n for _, _, n, _ in made], "addr": [""] * len(made), "kind_key": [1] * len(made), "tier": [1 if t else None for _, t, _, _ in made]}
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
    batch = pa.RecordBatch.from_arrays([pa.array(columns[x.split()[0]], kinds[x.split()[1]]) for x in pools.SCHEMA.split(",")], names=list(columns))
    compared = []
    texts = pools.Cell.texts
    monkeypatch.setattr(pools.Cell, "texts", lambda self, what, how, i, j: compared.append(len(i)) or texts(self, what, how, i, j))
    found = [r for b in pools.best_of_cells(1, "edit", (64, 512))(iter([batch])) for r in b.to_pylist()]
    assert sorted((r["tid"], r["catalog_id"]) for r in found) == [(k, str(k + 20)) for k in range(20)]
    assert sum(compared) < 0.2 * 20 * 5000


def test_components_are_solved_across_batches():
    edges = [("1", "a", "x", 0.9), ("1", "a", "y", 0.85), ("1", "b", "x", 0.95), ("2", "c", "z", 0.9), ("3", "d", "w", 0.9), ("3", "e", "w", 0.95)]
    names = ["component", "entity_id", "catalog_id", "score"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, e)) for e in edges[i : i + 2]]) for i in range(0, len(edges), 2)]
    found = [tuple(r.values()) for b in _solve(iter(batches)) for r in b.to_pylist()]
    assert sorted(found) == [("a", "y", 0.85), ("b", "x", 0.95), ("c", "z", 0.9), ("e", "w", 0.95)]
    assert [b.num_rows for b in _solve(iter([]))] == [0]


def brute(edges):
    targets = sorted({t for t, _, _ in edges})
    options = [[(None, 0.0)] + [(c, s) for t, c, s in edges if t == name] for name in targets]
    best = (0, 0.0)
    for combo in itertools.product(*options):
        used = [c for c, _ in combo if c]
        if len(used) == len(set(used)):
            best = max(best, (len(used), round(sum(s for _, s in combo), 9)))
    return best


def test_solver_is_optimal_on_random_graphs():
    random.seed(3)
    for _ in range(150):
        n, m = random.randint(1, 5), random.randint(1, 5)
        edges = [(f"t{i}", f"c{j}", round(random.uniform(0.84, 1.0), 3)) for i in range(n) for j in range(m) if random.random() < 0.6]
        if not edges:
            continue
        got = A.solve_component(edges)
        assert len({c for _, c, _ in got}) == len({t for t, _, _ in got}) == len(got)
        assert (len(got), round(sum(s for _, _, s in got), 9)) == brute(edges)


def test_global_optimum_beats_greedy(spark):
    edges = [("A", "H1", 0.91), ("A", "H2", 0.85), ("B", "H1", 0.90)]
    got = A.assign(spark.createDataFrame(edges, "entity_id string, catalog_id string, score double"))
    assert rows(got) == [("A", "H2", 0.85), ("B", "H1", 0.90)]


def test_a_candidate_wanted_by_a_crowd_needs_no_big_component(spark):
    crowd = [(f"t{i:04d}", "H1", 0.9) for i in range(500)] + [(f"u{i:04d}", c, s) for i in range(500) for c, s in (("H1", 0.95), ("H2", 0.9))]
    edges = spark.createDataFrame(crowd, "entity_id string, catalog_id string, score double")
    assert A.interchangeable_cut(edges).count() == 1 + 2 * 2
    got = A.assign(edges).collect()
    assert sorted(r["catalog_id"] for r in got) == ["H1", "H2"] and sum(r["score"] for r in got) == pytest.approx(1.85)


def test_distributed_assignment_equals_one_big_solve(spark):
    random.seed(11)
    edges = [(f"t{i:02d}", f"c{random.randint(0, 30):02d}", round(random.uniform(0.84, 1.0), 4)) for i in range(40) for _ in range(3)]
    edges = list({(t, c): (t, c, s) for t, c, s in edges}.values())
    got = A.assign(spark.createDataFrame(edges, "entity_id string, catalog_id string, score double")).collect()
    want = A.solve_component(edges)
    assert len({r["catalog_id"] for r in got}) == len(got) == len(want)
    assert sum(r["score"] for r in got) == pytest.approx(sum(s for _, _, s in want))


def test_long_chains_and_wide_stars_are_settled(spark):
    random.seed(5)
    edges = []
    for n in (3, 17, 50):
        for i in range(n):
            edges += [(f"t{n}-{i:03d}", f"c{n}-{i:03d}", round(random.uniform(0.84, 1), 4)), (f"t{n}-{i:03d}", f"c{n}-{i + 1:03d}", round(random.uniform(0.84, 1), 4))]
    edges += [(f"s{i:03d}", f"d{j}", round(random.uniform(0.84, 1), 4)) for i in range(50) for j in range(25) if (i + j) % 2]
    got = A.assign(spark.createDataFrame(edges, "entity_id string, catalog_id string, score double")).collect()
    want = A.solve_component(edges)
    assert len({r["catalog_id"] for r in got}) == len({r["entity_id"] for r in got}) == len(got) == len(want)
    assert sum(r["score"] for r in got) == pytest.approx(sum(s for _, _, s in want))


def test_name_only_match(spark):
    targets = spark.createDataFrame([("1", "새봄병원", "강남구"), ("2", "새봄병원", "강남구"), ("3", "새봄병원", "강남구"), ("4", "새봄병원", "강남구")], "entity_id string, name string, district string")
    found = spark.createDataFrame(
        [("1", "a", "새봄병원", "서울 강남구"), ("1", "b", "새봄", "서울 중구"), ("2", "c", "새봄병원", "부산 중구"), ("4", "d", "xyz", "서울 강남구")],
        "entity_id string, catalog_id string, name string, address string",
    )
    got = {r["entity_id"]: (r["catalog_id"], r["match_score"], r["match_state"]) for r in M.name_only_match(targets, found).collect()}
    assert got == {"1": ("a", 1.0, "자동매칭"), "2": (None, 1.0, "지역불일치"), "3": (None, 0.0, "미매칭"), "4": (None, 0.25, "낮은유사도")}


ID = "A" * 80


def test_override_ledger(spark):
    schema = "entity_id string, catalog_name string, catalog_address string, catalog_id string, specialists string, evidence_url string, confirmed_on string"
    good = ("1", "새봄병원", "서울 중구 중앙로 1", ID, "2", f"https://www.hira.or.kr/x?ykiho={ID}", "2026-01-05")
    today = F.lit("2026-01-10").cast("date")
    catalog = spark.createDataFrame([(ID, "의료법인 새봄병원", "서울 중구 중앙로 1-0")], "catalog_id string, name string, address string")

    def checks(row, against=None):
        return {r["check"] for r in M.override_violations(spark.createDataFrame([row], schema), today, against).collect()}

    assert checks(good) == checks(good, catalog) == set()
    assert checks((*good[:4], "1.5", *good[5:])) == {"override_specialists"}
    assert checks((*good[:6], "2026-02-01")) == {"override_date"}
    assert checks((*good[:5], "http://hira.or.kr", good[6])) == {"override_url"}
    assert "override_name" in checks(("1", "다른병원", *good[2:]), catalog)
    assert "override_not_in_catalog" in checks((*good[:3], "B" * 80, *good[4:]), catalog)


def test_exclusion_ledger_against_other_tables(spark):
    schema = "entity_id string, name string, reason_code string, reason string, catalog_id string, evidence_url string, confirmed_on string"
    row = ("1", "병원", "HIRA_SOURCE_NOT_FOUND", "r", ID, f"https://hira.or.kr/x?ykiho={ID}", "2026-01-05")
    ledger, today = spark.createDataFrame([row], schema), F.lit("2026-01-10").cast("date")
    master = spark.createDataFrame([("1", "병원")], "entity_id string, name string")
    assert M.exclusion_violations(ledger, today, master).isEmpty()
    late = {r["check"] for r in M.exclusion_violations(ledger, F.lit("2026-03-10").cast("date")).collect()}
    assert late == {"exclusion_age"}
    renamed = spark.createDataFrame([("1", "새이름")], "entity_id string, name string")
    back = spark.createDataFrame([(ID,)], "catalog_id string")
    ranked = spark.createDataFrame([("1", True)], "entity_id string, gate_passed boolean")
    got = {r["check"] for r in M.exclusion_violations(ledger, today, renamed, ledger, back, ranked).collect()}
    assert got == {"exclusion_name", "exclusion_and_override", "exclusion_id_in_override", "exclusion_id_reappeared", "exclusion_has_candidate"}


def test_final_match_checks(spark):
    schema = "entity_id string, catalog_id string, match_state string, specialists double"
    detail = spark.createDataFrame([("1", "a", V.STATE_AUTOMATIC, 2.0), ("2", None, V.STATE_EXCLUDED, None), ("3", None, V.STATE_LOW, None)], schema)
    master = detail.select("entity_id")
    out = spark.createDataFrame([("2", "z")], "entity_id string, catalog_id string")
    assert M.match_violations(detail, master, out, 1).isEmpty()
    before = spark.createDataFrame([("1", "a", V.STATE_AUTOMATIC, 9.0), ("2", "z", V.STATE_AUTOMATIC, 1.0), ("3", "c", V.STATE_MANUAL, 1.0)], schema)
    got = {r["check"] for r in M.match_violations(detail, master, out, 2, before).collect()}
    assert got == {"match_floor", "match_drop", "specialist_drop"}
    none, rest = M.review_queues(detail)
    assert (none.count(), rest.count()) == (0, 2)
