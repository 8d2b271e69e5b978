import numpy as np

from wardscope.llm import tokens


def test_words_with_signs_are_made_once():
    encoder = tokens.WordEncoder(tokens.tokenizer_path())
    text = "Some words, Été, 3.5% of a_b end. '<|ENDOFTEXT|>'"
    first = encoder.encode(text)
    whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(first, "<u4").tolist() == whole
    made = []
    real = type(encoder.cache).__missing__
    encoder.cache.__class__ = type("Counted", (type(encoder.cache),), {"__missing__": lambda self, w: made.append(w) or real(self, w)})
    plain = "Some words, of a_b end. 3.5%"
    assert encoder.encode(plain) == encoder.encode(plain)
    assert made == []
