"""Cross-tokenizer alignment against the definition: all overlapping pairs, all common ends."""

import hashlib
import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import prose
from wardscope.llm import alignment

TEXTS = [
    "  a   b \n c\n \n d  ", "x▁y z", "<|endoftext|> <s> hi </s><0x41>", "日本語 テスト😀 é x", " ", "a\t\tb\r\n\r\n  c", "", None,
    "don't can't  won't x", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "12345 67.89 -- ... !!", "\x00 ﻿ \x85 x",
]


def by_definition(rows):
    """Ids over whole texts, groups from the common ends, links from all overlapping ranges."""
    pair = alignment.tokenizer_pair(alignment.tokenizer_path(alignment.BYTE_BPE), alignment.tokenizer_path(alignment.PIECE_BPE))
    counts, found = Counter(), {}
    for key, text in rows:
        a = pair.a.encode(" " + (text or ""), add_special_tokens=False).ids
        b, raw = pair.b.encode(text or ""), (" " + (text or "")).encode()
        if not text or b"".join(pair.bytes_a[k] for k in a) != raw or b"".join(pair.bytes_b[k] for k in b) != raw:
            found[key] = None
            continue
        ends_a = list(itertools.accumulate(len(pair.bytes_a[k]) for k in a))
        ends_b = list(itertools.accumulate(len(pair.bytes_b[k]) for k in b))
        groups, links, low_a, low_b = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            high_a, high_b = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, a[low_a:high_a])) + "|" + ",".join(map(str, b[low_b:high_b])))
            for i, j in itertools.product(range(low_a, high_a), range(low_b, high_b)):
                if max(([0] + ends_a)[i], ([0] + ends_b)[j]) < min(ends_a[i], ends_b[j]):
                    links.append((a[i], b[j]))
            low_a, low_b = high_a, high_b
        counts.update(links)
        found[key] = (len(a), len(b), len(groups), links, ";".join(groups))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    result = {}
    for key, v in found.items():
        result[key] = (0, 0, 0, 0, "", 0, 0) if v is None else (*v[:3], len(v[3]), v[4], sum(counts[p] == best[p[1]] for p in v[3]), sum(counts[p] for p in v[3]))
    return result, counts, best


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    odd = ["".join(rng.choice("  \n\t.,'’-aAéñß12²日😀") for _ in range(40)) for _ in range(60)]
    return TEXTS + odd + [prose(rng, rng.randrange(1, 300), "ab"[k % 2]) for k in range(40)]


def test_alignment_by_definition(spark, texts, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_TEXTS", 7)
    rows = list(enumerate(texts))
    want, counts, best = by_definition(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align_tokenizers(df).collect()}
    assert got == want
    digests = {r.doc_id: r.groups_sha256 for r in alignment.align_tokenizers(df, digest=True).collect()}
    assert digests == {k: hashlib.sha256(v[4].encode()).hexdigest() if v[4] else "" for k, v in want.items()}
    table = {(r.id_a, r.id_b): (r.links, r.best) for r in alignment.pair_counts(df).collect()}
    assert table == {k: (n, n == best[k[1]]) for k, n in counts.items()}


@pytest.mark.parametrize("seed", range(30))
def test_align_ends_on_random_tilings(seed):
    rng = random.Random(seed)
    size, same = rng.randrange(1, 400), rng.random()
    cuts_a = sorted(rng.sample(range(1, size + 1), rng.randrange(size))) if size > 1 else []
    cuts_b = [c for c in cuts_a if rng.random() < same] + [c for c in range(1, size) if rng.random() < (1 - same) / 3]
    a, b = sorted({*cuts_a, size}), sorted({*cuts_b, size})
    group_a, group_b, (i, j) = alignment.align_ends(a, b)
    common = sorted(set(a) & set(b))
    assert [a[k - 1] for k in group_a] == common == [b[k - 1] for k in group_b]
    starts_a, starts_b = [0, *a], [0, *b]
    want = {(x, y) for x in range(len(a)) for y in range(len(b)) if max(starts_a[x], starts_b[y]) < min(a[x], b[y])}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def test_a_long_one_to_one_stretch_is_jumped():
    class Watched(list):
        compared = 0

        def __getitem__(self, at):
            Watched.compared += isinstance(at, slice)
            return super().__getitem__(at)

    ends = list(range(1, 100_001))
    group_a, _, links = alignment.align_ends(Watched(ends), Watched(ends))
    assert len(group_a) == len(links[0]) == 100_000 and Watched.compared < 50


def test_odd_tables(spark, texts):
    schema = "doc_id long, text string, n_a string, _chunk string, links string, groups string"
    assert alignment.align_tokenizers(spark.createDataFrame([], schema)).collect() == []
    assert alignment.pair_counts(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "a b", "z", "z", "z", "z"), (None, "a b", "z", "z", "z", "z"), (1, None, None, None, None, None), (1, "a b", "z", "z", "z", "z"), (2, "x" * 300_000, "z", "z", "z", "z")]
    got = alignment.align_tokenizers(spark.createDataFrame(rows, schema), keep=["doc_id", "n_a", "_chunk"])
    assert got.columns == ["doc_id", "n_a", "_chunk", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    kept = sorted(((r[0], r[1], r[3], r[-1]) for r in got.collect()), key=str)
    assert [k[:2] for k in kept] == sorted([(r[0], r[2]) for r in rows], key=str)
    assert len({k[2:] for k in kept if k[1] == "z" and k[0] != 2}) == 1  # equal rows, equal results
    assert [k[2:] for k in kept if k[1] is None] == [(0, 0)]


def test_short_chunks_change_nothing(spark, texts, monkeypatch):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    whole = sorted(map(tuple, alignment.align_tokenizers(df, digest=True).collect()))
    monkeypatch.setattr(alignment, "CHUNK_CHARS", 100)
    assert sorted(map(tuple, alignment.align_tokenizers(df.withColumn("x", F.lit(1)), digest=True).collect())) == whole
