"""The latent space has fewer dimensions than passages and decides what is retrieved."""

from __future__ import annotations

import random

import numpy as np

from wardscope.llm import contamination


def word(r: random.Random) -> str:
    return "".join(r.choice("bcdfghklmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 3)))


def test_space_is_smaller_and_changes_the_cosines(spark, monkeypatch):
    r, spaces, made = random.Random(4), [], []
    own = contamination.latent_space

    def seen(rows, n_rows, *rest, **named):
        spaces.append((n_rows, own(rows, n_rows, *rest, **named)))
        return spaces[-1][1]

    begin = contamination.Retriever.__init__

    def begun(self, *args):
        begin(self, *args)
        made.append(self)

    monkeypatch.setattr(contamination, "latent_space", seen)
    monkeypatch.setattr(contamination.Retriever, "__init__", begun)
    items = [" ".join(word(r) for _ in range(r.randrange(24, 48))) for _ in range(40)]
    docs, want = [], set()
    for k in range(40):
        part = [w if n % 5 else word(r) for n, w in enumerate(items[k].split())]
        docs.append((k, " ".join([word(r) for _ in range(50)] + part + [word(r) for _ in range(50)])))
        want.add((k, k))
    bench = spark.createDataFrame(list(enumerate(items)) + [(None, "no name stands " * 4)], "item_id long, text string")
    docs.append((90, "before it no name stands no name stands no name stands no name stands and after"))
    found = contamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(x.doc_id, x.item_id) for x in found} == want | {(90, None)}
    (n, space), one = spaces[0], made[0]
    assert space.shape[1] < n
    plain = np.zeros((n, one.own))
    for k, words in enumerate(one.words):
        for w in words:
            plain[k, one.place[w]] += one.idf[one.place[w]]
    plain /= np.linalg.norm(plain, axis=1, keepdims=True)
    assert np.abs(plain @ plain.T - one.items @ one.items.T).max() > 0.01


def test_words_of_plain_texts():
    text = "".join(map(chr, range(128))) + " It's A_b 9.5"
    assert contamination.words_of(text) == contamination.WORD.findall(text.lower())
