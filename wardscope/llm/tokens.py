"""Whole texts to token ids with the ``tokenizers`` library, in bounded memory."""

from __future__ import annotations

import os
import re

import numpy as np

#: Below U+0250: numbers that are no digits, and the capital that lowers to two characters.
NOT_SIMPLE = re.compile("[\u00b2\u00b3\u00b9\u00bc-\u00be\u0130]")
PARTS = re.compile(r"[^\W\d_]+|\d|(?:[^\w\s]|_)+|\s")
#: Signs that often end a word; each is a pre-token of its own there.
SIGNS = tuple(".,;:!?")
WORD_BPE = "word_bpe_49k.json"


def tokenizer_path(name: str = WORD_BPE) -> str:
    """Place of a public vocabulary file on this machine; every operator that encodes takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Encodes a text word by word through a bounded cache; equal to encoding it whole.

    Right only for a vocabulary whose pre-tokens never hold white space: the
    library drops white space and merges inside one pre-token, so the parts
    between blanks and line feeds encode on their own.  Where a text holds one
    of the special strings it is passed to the library whole.  A part that ends
    in one full stop or comma after plain letters is two pre-tokens, and ASCII
    capitals are lowered by the tokenizer, so such parts share the entry of the
    bare word.
    """

    def __init__(self, path: str, limit: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = _Words(self.tokenizer, limit)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null and empty give none."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if text.isascii() and not any(s in (low := text.lower()) for s in self.special):  # the tokenizer lowers anyway
            text = low
        return b"".join(map(self.cache.__getitem__, text.replace("\n", " ").split(" ")))


def byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Words(dict):
    """Ids of words; forms with capitals are made from those in lower case and not kept.

    Characters below U+0250 lower one by one and do not compose; a word of such
    letters is one pre-token, and a mixed word without apostrophe splits into
    letter runs, single digits and runs of other signs.  At most twice ``limit``
    words are kept: a full generation becomes the old one, and of that only the
    words that are asked for again come back.
    """

    def __init__(self, tokenizer, limit: int):
        self.limit = limit
        self.old: dict[str, bytes] = {}
        self.tokenizer = tokenizer
        self.merge = tokenizer.model.tokenize
        self.letters = byte_letters()

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is not None:
            return self._keep(word, ids)
        if word.isascii() and word[-1:] in SIGNS and word[:-1].isalpha():  # letters and one sign
            return self._keep(word, self[word[:-1]] + self[word[-1]])
        plain = word.isascii() or max(word) < "\u0250" and not NOT_SIMPLE.search(word)
        if word.isalpha() and plain:
            low = word.lower()
            if low != word:
                return self[low]
            mapped = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
            ids = np.array([t.id for t in self.merge(mapped)], dtype="<u4").tobytes()
        elif plain and "'" not in word and len(parts := PARTS.findall(word)) > 1:
            return self._keep(word, b"".join([self[p] for p in parts]))
        else:
            ids = np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self._keep(word, ids)

    def _keep(self, word: str, ids: bytes) -> bytes:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process, so that its cache serves later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
