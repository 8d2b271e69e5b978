import numpy as np

from wardscope.llm import contamination


def _retriever(texts):
    terms = sorted({w for t in texts for w in contamination.words_of(t)})
    return contamination.Retriever(list(enumerate(texts)), terms, np.ones(len(terms)), 2.0, np.eye(len(terms), dtype=np.float32))


def test_few_common_words_need_no_alignment(monkeypatch):
    passage = " ".join(f"word{k}" for k in range(20))
    found = _retriever([passage])
    calls = []
    real = contamination.lcs_length
    monkeypatch.setattr(contamination, "lcs_length", lambda a, b: calls.append(1) or real(a, b))
    strewn = "word1 word2 word3 word4 word5 " * 8
    assert len(found.candidates(found.ids_of(strewn.split()))) > 0
    assert found.settle(strewn.split()) == [] and not calls
    near = passage.replace("word7", "other").replace("word12", "another").split()
    assert [h[:3] for h in found.settle(near)] == [(0, 0, 20)] and calls


def test_sums_of_steps_are_those_of_windows():
    found = _retriever(["a b c d e f g h", "d e f x y z q r"])
    ids = found.ids_of("a b b zz d e q r a a x".split())
    padded = np.append(ids, [-1] * 8)
    sums = found._latent(padded, 3)
    for k in range(3):
        own = ids[4 * k : 4 * k + 4]
        assert np.allclose(sums[k + 1] - sums[k], found.weighted[own[own >= 0]].sum(axis=0))
    square = np.append(found.idf**2, 4.0)
    for row, got in zip(padded[:16].reshape(2, 8), found._repeats(padded[:16].reshape(2, 8))):
        own, times = np.unique(row[row >= 0], return_counts=True)
        assert np.isclose(got, ((times**2 - times) * square[own]).sum())
