"""Phrase mining against counting every phrase directly."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardscope.llm import phrases

LOWER = {k: k + 32 for k in range(65, 91)}


def by_definition(rows, least, longest=4, top=2000):
    counts = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            for k in range(1, longest + 1):
                counts["und" if lang is None else lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in found.items():
            parts = {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1)} - {p}
            gone |= {q for q in parts if q in found and 100 * a >= 80 * found[q]}
        rows = []
        for p in found.keys() - gone:
            score, _, l, r = min((2000000 * f[p] // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -f[p], " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def corpus(seed, size):
    rng = random.Random(seed)
    words = ["a", "b", "C", "Dé", "日本", "e-f", "\x00g", " h", "ÉI"]
    fixed = ["new york city", "of the", "a b a b a"]
    texts = []
    for _ in range(size):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(0, 40))]
        texts.append("".join(p + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!"]) for p in parts))
    return [(t, rng.choice(["x", "y", None])) for t in texts] + [(None, "x"), ("", "y"), (" .,! ", None), ("w" * 70_000 + " a", "z")]


@pytest.mark.parametrize("least,longest,size", [(1, 4, 60), (30, 4, 200), (3, 2, 80), (3, 3, 80), (5, 6, 150)])
def test_collocations_by_definition(spark, monkeypatch, least, longest, size):
    rows = corpus(least * 10 + longest, size)
    monkeypatch.setattr(phrases, "SHARD_BYTES", 900)
    monkeypatch.setattr(phrases, "BUCKET", 300)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(df, least=least, longest=longest).collect())
    assert got == by_definition(rows, least, longest)
    monkeypatch.setattr(phrases, "HELD_BYTES", 500)  # shards of several languages cut early
    again = phrases.collocations(df.withColumn("n", F.lit("z")).withColumn("word", F.lit("z")), least=least, longest=longest, top=3)
    assert sorted(tuple(r) for r in again.collect()) == [r for r in got if r[1] <= 3]


@pytest.mark.parametrize("seed", range(8))
def test_both_intervals_and_counts(seed):
    rng = np.random.default_rng(seed)
    sequence = phrases.without_rare(rng.integers(0, 6, 300), np.arange(6))
    index = phrases.BidirectionalIndex(sequence, 4)
    want = Counter(tuple(sequence[i:i + k].tolist()) for k in range(1, 5) for i in range(len(sequence) - k + 1))
    want = {p: n for p, n in want.items() if 0 not in p}
    starts = ["".join(map(str, sequence[i:i + 4].tolist())) for i in index.order]
    for sides in ([True] * 3, [False] * 3, [True, False, True], [False, True, False]):
        found = index.single()
        for side in [None, *sides]:
            found = found if side is None else index.extend(found, right=side)
            got = {tuple(p): n for p, n in zip(index.words(found).tolist(), found.count.tolist())}
            assert got == {p: n for p, n in want.items() if len(p) == found.size}
            for p, low, n in zip(index.words(found).tolist(), found.low, found.count):
                assert all(s.startswith("".join(map(str, p))) for s in starts[low:low + n])


def test_odd_tables(spark):
    schema = "text string, lang string, doc_id long, id string, n string, key string, place string"
    assert phrases.collocations(spark.createDataFrame([], schema)).collect() == []
    rows = [("a b", None, None, "z", "z", "z", "z")] * 40 + [(None, None, None, None, None, None, None), ("", "x", 1, "z", "z", "z", "z"), ("rare words", "x", 1, "z", "z", "z", "z")]
    got = phrases.collocations(spark.createDataFrame(rows, schema)).collect()
    assert [tuple(r) for r in got] == [("und", 1, "a b", 40, 40, 40, 80, 1000000)]
    assert phrases.collocations(spark.createDataFrame(rows[-2:], schema)).collect() == []
    with pytest.raises(ValueError):
        phrases.phrase_counts(spark.createDataFrame(rows, schema), longest=1)
