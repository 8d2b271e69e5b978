"""Every operator on odd tables: nulls everywhere, empty and long texts, ties, repeats, no rows, clashing names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import DOC, check_packed, prose
from wardscope.llm import contamination, language, packing, passages, quality, queries, repeats, secret_scan, simhash, token_files, topk

CLASHING = ["text_", "_text", "fp", "key", "h", "score", "lang_pred", "piece", "length", "root", "node", "side", "n", "a", "b", "x", "y", "data", "held_out"]


def odd_rows():
    rng = random.Random(20)
    long = prose(rng, 30_000)
    normal = [prose(rng, rng.randrange(5, 200)) for _ in range(12)]
    rows = [(None, normal[0], None, None, None), (None, None, None, None, None), (3, None, "a", None, 1), (3, "", None, "s", None), (4, "   \n\t ", "a", "s", 0), (5, "x", "b", "s", 1)]
    rows += [(6, long, "a", "s", len(long)), (7, normal[1], "a", "s", 9), (7, normal[1], "a", "s", 9), (7, normal[2], "a", "s", 9), (8, normal[1], "b", "s", 9), (9, "\x00﻿ \U0001f600 " + normal[3], "a", "s", 5)]
    return rows + [(20 + k, t, "ab"[k % 2], "s", len(t)) for k, t in enumerate(normal)] + [(40, normal[1] + " password=abcdefgh", None, "s", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(odd_rows(), DOC)
    for name in CLASHING:
        df = df.withColumn(name, F.lit("z"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def marks(spark, empty=False):
    rows = [] if empty else [(k, k % 2, 0) for k in range(20, 30)] + [(None, 1, 0), (7, None, None), (8, 1, 0), (8, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("x", F.lit(1))


def bench(spark, empty=False):
    rows = [] if empty else [(1, odd_rows()[7][1]), (None, None), (2, ""), (3, odd_rows()[7][1])]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("share", F.lit(1))


def ids(rows):
    return sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i))


@pytest.mark.parametrize("make", [
    lambda s, d, e: quality.classify(d, marks(s, e)),
    lambda s, d, e: token_files.tokenize_to_files(d),
    lambda s, d, e: simhash.near_duplicates(d),
    lambda s, d, e: secret_scan.find_secrets(d),
    lambda s, d, e: repeats.without_repeats(d),
    lambda s, d, e: language.identify(d),
], ids=["quality", "tokens", "simhash", "secrets", "repeats", "language"])
def test_one_row_per_row(spark, odd, none, make):
    assert ids(make(spark, odd, False).collect()) == ids(odd.collect())
    assert make(spark, none, True).collect() == []


def test_equal_rows_get_equal_results(spark, odd):
    for df in (quality.classify(odd, marks(spark)), simhash.near_duplicates(odd), secret_scan.find_secrets(odd), language.identify(odd)):
        rows = [r for r in df.filter("doc_id = 7").collect()]
        assert len(rows) == 3 and len(set(rows)) <= 2


def test_quality_without_labels(spark, odd):
    assert {r.score for r in quality.classify(odd, marks(spark, True)).collect()} == {0.5}


def test_empty_and_null_texts(spark, odd):
    for row in secret_scan.find_secrets(odd).filter("doc_id = 3").collect():
        assert (row.n_assign, row.spans) == (0, "")
    assert {r.component_id for r in simhash.near_duplicates(odd).filter("doc_id in (3, 4)").collect()} == {3}
    assert {(r.n_bytes, r.n_removed) for r in repeats.without_repeats(odd).filter("doc_id = 3").collect()} == {(0, 0)}


def test_packing_of_odd_rows(spark, odd, none):
    rows = packing.pack(odd).collect()
    check_packed(rows, packing.CAPACITY)
    assert {r.doc_id for r in rows} == {r.doc_id for r in odd.collect()}
    assert sum(r.doc_id == 7 for r in rows) == 3
    assert packing.pack(none).collect() == []


def test_contamination_of_odd_rows(spark, odd, none):
    got = {(r.doc_id, r.item_id) for r in contamination.contaminated(odd, bench(spark)).collect()}
    assert got == {(d, i) for d in (7, 8, 21, 40) for i in (1, 3)}
    assert contamination.contaminated(odd, bench(spark, True)).collect() == []
    assert contamination.contaminated(none, bench(spark)).collect() == []


def test_passages_of_odd_rows(spark, odd, none):
    got = passages.repeated_passages(odd).collect()
    assert {7, 8, 21, 40} <= {r.doc_id for r in got if r.class_id == 7}
    assert all(r.doc_id is not None for r in got)
    assert passages.repeated_passages(none).collect() == []


def test_top_k_of_odd_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert topk.top_k(empty).collect() == []
    one = spark.createDataFrame([(0, [1.0], 1)], "vec_id long, embedding array<float>, label int").withColumn("v", F.lit(1)).withColumn("score", F.lit(1))
    assert topk.top_k(one).collect() == []


def test_registered_queries():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]


def test_pipeline_of_odd_rows(spark, odd, none, tmp_path):
    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            columns = docs.columns
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == columns, name
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()


def test_pipeline_stages_take_effect(spark, tmp_path):
    """The stages against a plain restatement of each decision."""
    rng = random.Random(21)
    item = prose(rng, 30)
    rows = [(k, prose(rng, 120, "ab"[k % 2]), "ab"[k % 2], "s", 1) for k in range(60)]
    rows += [(100, rows[0][1], "a", "s", 1), (101, rows[4][1] + " " + item, "a", "s", 1), (102, "12 34", "a", "s", 1), (103, None, "a", "s", 1), (104, rows[6][1] + " more token=abcdef99 end", "a", "s", 1)]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        after[name] = docs
        if name != "packing":
            docs = docs.cache()
    kept = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in after.items()}
    every = {r[0] for r in rows}
    assert kept["language"] == every - {102, 103}
    prints = {r[0]: simhash.fingerprint(r[1]) for r in rows if r[0] in kept["language"]}
    roots = {i: i for i in prints}
    for _ in range(3):
        for i in prints:
            roots[i] = min(roots[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 2 or i == j)
    assert kept["near_duplicates"] == {i for i in prints if roots[i] == i}
    assert 100 not in kept["near_duplicates"]
    assert kept["decontamination"] == kept["near_duplicates"] - {101}
    texts = {r.doc_id: r.text for r in after["secrets"].collect()}
    assert texts == {r[0]: secret_scan.without_secrets(r[1], "[secret]") for r in rows if r[0] in kept["decontamination"]}
    assert kept["packing"] == kept["decontamination"]
