import numpy as np

from wardscope.llm import phrases


def test_entries_take_few_bytes():
    rng = np.random.default_rng(5)
    ids = np.minimum(rng.zipf(1.3, (20_000, 3)), 70_000)
    ids = np.unique(ids, axis=0)
    entries = np.column_stack([ids, rng.integers(1, 4, len(ids))])
    data = phrases._press_entries(entries)
    assert (phrases._entries(data, 3).T == entries).all()
    assert len(data) < 3.5 * len(entries)
    sequence = rng.integers(0, 1000, 5000).astype(np.int32)
    assert (phrases._sequence(phrases._press(sequence)) == sequence).all()
    assert not len(phrases._sequence(phrases._press(sequence[:0])))


def test_frequent_words_have_small_ids(spark):
    texts = [(k, " ".join(["most"] * 5 + ["some"] * 3 + ["few"] * 2)) for k in range(40)]
    words, _, _ = phrases.phrase_counts(spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'en' lang"))
    assert [r.word for r in words.orderBy("id").collect()] == ["most", "some", "few"]
