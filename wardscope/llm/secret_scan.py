"""Secret scan with a recursive decoding worklist.

Every whole text is scanned as it stands (the base spans).  Then a worklist unwraps it:
percent runs and ``\\u``/``\\x`` escapes are replaced in place, base64 tokens that hold text
or a gzip, zlib or bzip2 stream become layers of their own.  Each layer is scanned again and
unwrapped again until nothing new appears; a layer that was seen before at the same place
(a cycle) is not taken up again.  Every character of a layer knows which characters of the
document it came from, so spans found below map back; only spans that touch a decoded
character are added, and base spans always stay.

Compressed streams are read to their end, all members of them, in pieces of ``PIECE`` characters
that overlap by ``OVERLAP``; each piece is a layer, so memory is bounded while nothing is left
out, and a piece that was seen before at the same place (streams that expand without end repeat
themselves) is not taken up again.  What spans a border between pieces is found if it is no longer
than the overlap.  Null and empty texts have no spans.  Rows that repeat an id are scanned each
by itself.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from wardscope.llm.common import per_text, ship_package

KINDS = ("assign", "access", "hex")
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones fail as a whole
ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})+")
UNIT = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
LINE = re.compile(r"(?m)^[\x20\t>]*([A-Za-z0-9+/_-]{4,}={0,2})[\x20\t\r]*$")
PIECE, OVERLAP = 1 << 20, 1 << 16

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def scan(text: str) -> list[Span]:
    """Spans of all kinds in one layer, leftmost and non-overlapping per kind."""
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


class Layer:
    """A text whose characters know their source: characters [low, high) of the document, decoded or not."""

    def __init__(self, text: str, low: np.ndarray, high: np.ndarray, decoded: np.ndarray):
        self.text, self.low, self.high, self.decoded = text, low, high, decoded

    @classmethod
    def whole(cls, text: str) -> Layer:
        at = np.arange(len(text), dtype=np.int64)
        return cls(text, at, at + 1, np.zeros(len(text), bool))

    def spans(self) -> set[Span]:
        return {(int(self.low[s]), kind, int(self.high[s:e].max())) for s, kind, e in scan(self.text) if self.decoded[s:e].any()}


def _utf8(data: bytes) -> str | None:
    """The text of bytes that are text: UTF-8, hardly any control characters."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    odd = sum(c < " " and c not in "\t\n\r" for c in text)
    return text if text and odd * 20 <= len(text) else None


def _unescape(run: str) -> list[tuple[str, int, int, bool]]:
    """Characters of one escape run with their place in it and whether they were decoded; what cannot be stays as it is."""
    out, k = [], 0

    def raw(start: int, end: int) -> None:
        out.extend((run[j], j, j + 1, False) for j in range(start, end))

    if run[0] == "%":
        for c in bytes.fromhex(run.replace("%", "")).decode("utf-8", "surrogateescape"):
            n = 1 if "\udc80" <= c <= "\udcff" else len(c.encode("utf-8"))
            if "\udc80" <= c <= "\udcff":  # a byte that is no UTF-8
                raw(3 * k, 3 * (k + 1))
            else:
                out.append((c, 3 * k, 3 * (k + n), True))
            k += n
        return out
    units = [(int(m[1] or m[2], 16), m.start(), m.end()) for m in UNIT.finditer(run)]
    while k < len(units):
        value, start, end = units[k]
        if 0xD800 <= value < 0xDC00 and k + 1 < len(units) and 0xDC00 <= units[k + 1][0] < 0xE000:
            value, end, k = 0x10000 + ((value - 0xD800) << 10) + units[k + 1][0] - 0xDC00, units[k + 1][2], k + 1
        if 0xD800 <= value < 0xE000:
            raw(start, end)
        else:
            out.append((chr(value), start, end, True))
        k += 1
    return out


def _escapes(layer: Layer) -> Layer | None:
    text = layer.text
    if "%" not in text and "\\" not in text:
        return None
    parts, low, high, decoded, at = [], [], [], [], 0
    for m in ESCAPES.finditer(text):
        made = _unescape(m[0])
        if not any(c[3] for c in made):
            continue
        s = m.start()
        parts += [text[at:s], "".join(c[0] for c in made)]
        low += [layer.low[at:s], np.array([layer.low[s + c[1]] for c in made], np.int64)]
        high += [layer.high[at:s], np.array([layer.high[s + c[2] - 1] for c in made], np.int64)]
        # a character that stays was decoded if it was so in this layer
        decoded += [layer.decoded[at:s], np.array([c[3] or layer.decoded[s + c[1]] for c in made], bool)]
        at = m.end()
    if not parts:
        return None
    parts.append(text[at:])
    return Layer("".join(parts), np.concatenate([*low, layer.low[at:]]), np.concatenate([*high, layer.high[at:]]), np.concatenate([*decoded, layer.decoded[at:]]))


def _decompressor(head: bytes):
    """A maker of decompressors for data that starts so; None for data that is no stream."""
    make = None
    if head[:2] == b"\x1f\x8b":
        make = lambda: zlib.decompressobj(31)
    elif head[:1] == b"\x78" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0:
        make = lambda: zlib.decompressobj(15)
    elif head[:3] == b"BZh":
        make = bz2.BZ2Decompressor
    if make is not None:
        try:
            make().decompress(head, 64)
        except (zlib.error, OSError, ValueError, EOFError):
            return None
    return make


def _inflate(make, blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Bounded blocks of what all members of a compressed stream hold, up to its end or its first fault."""
    one = make()
    try:
        for data in blocks:
            while True:
                out = one.decompress(data, PIECE)
                if out:
                    yield out
                if one.eof:  # another member may follow
                    data, one = one.unused_data.lstrip(b"\0"), make()
                    if not data:
                        break
                    continue
                data = getattr(one, "unconsumed_tail", b"")
                if not data and len(out) < PIECE:
                    break
    except (zlib.error, OSError, ValueError, EOFError):
        return


def _unpacked(data: bytes) -> tuple[Iterator[bytes], bool]:
    """Blocks of the innermost content of nested streams, and whether there was any stream."""
    blocks, head, packed, heads = iter([data]), data, False, set()
    while (make := _decompressor(head)) is not None and head[:OVERLAP] not in heads:
        heads.add(head[:OVERLAP])  # a stream that holds itself is no new one
        blocks, packed = _inflate(make, blocks), True
        head = next(blocks, b"")
        blocks = chain([head], blocks)
    return blocks, packed


def _pieces(blocks: Iterator[bytes]) -> Iterator[str]:
    """Overlapping texts of a long stream as long as it is UTF-8."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    kept = ""
    try:
        for block in blocks:
            kept += decoder.decode(block)
            if len(kept) > PIECE:
                yield kept
                kept = kept[-OVERLAP:]
        kept += decoder.decode(b"", True)
    except UnicodeDecodeError:
        pass
    if kept:
        yield kept


def _tokens(text: str) -> Iterator[np.ndarray | tuple[int, int]]:
    """Places of base64 tokens: (start, end) in one line, or all places of one wrapped over lines of equal length.

    The last line may be shorter; as it may also be a word of its own, wrapped tokens are tried with and without it.
    """
    for m in BASE64.finditer(text):
        yield m.start(), m.end()
    if "\n" not in text:
        return
    block: list[tuple[int, int]] = []

    def wrapped(last: tuple[int, int] | None) -> Iterator[np.ndarray]:
        width = block[0][1] - block[0][0] if block else 0
        for lines in ([*block], [*block, last] if last and last[1] - last[0] < width else []):
            if len(lines) > 1 and width >= 16:
                yield np.concatenate([np.arange(a, b) for a, b in lines])

    end = -2
    for m in LINE.finditer(text):
        span = m.span(1)
        follows = m.start() == end + 1
        if block and not (follows and span[1] - span[0] == block[0][1] - block[0][0]):
            yield from wrapped(span if follows else None)
            block = []
        block.append(span)
        end = m.end()
    yield from wrapped(None)


def _base64(layer: Layer) -> Iterator[Layer]:
    """Layers of what base64 tokens hold, one after the other."""
    for found in _tokens(layer.text):
        at = np.arange(*found) if isinstance(found, tuple) else found
        token = (layer.text[found[0] : found[1]] if isinstance(found, tuple) else "".join(layer.text[k] for k in found)).rstrip("=")
        if len(token) % 4 == 1 or "=" in token:
            continue
        try:
            data = base64.b64decode(token.replace("-", "+").replace("_", "/") + "=" * (-len(token) % 4))
        except (binascii.Error, ValueError):
            continue
        blocks, packed = _unpacked(data)
        if packed:  # a compressed character depends on the whole token
            low, high = layer.low[at].min(), layer.high[at].max()
            for text in _pieces(blocks):
                n = len(text)
                yield Layer(text, np.broadcast_to(low, n), np.broadcast_to(high, n), np.broadcast_to(True, n))
            continue
        text = _utf8(data)
        if text is None:
            continue
        n = np.array([len(c.encode("utf-8")) for c in text])
        last = np.cumsum(n)
        low = layer.low[at[(last - n) * 4 // 3]]
        high = layer.high[at[np.minimum(-(-last * 4 // 3), len(at)) - 1]]
        yield Layer(text, low, high, np.ones(len(text), bool))


def _unwrapped(layer: Layer) -> Iterator[Layer]:
    yield from _base64(layer)
    if (plain := _escapes(layer)) is not None:
        yield plain


def scan_deep(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), both in order."""
    if not text:
        return [], []
    base = sorted(scan(text))
    found, seen = set(base), set()
    # the worklist holds what is still to come of each open layer, so few layers are in memory at once
    work: list[Iterator[Layer]] = []
    if "%" in text or "\\" in text or BASE64.search(text):
        work.append(_unwrapped(Layer.whole(text)))
    while work:
        new = next(work[-1], None)
        if new is None:
            work.pop()
            continue
        if not new.text:
            continue
        mark = (int(new.low[0]), int(new.high[-1]), hashlib.blake2b(new.text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
        if mark in seen:
            continue
        seen.add(mark)
        found |= new.spans()
        work.append(_unwrapped(new))
    return base, sorted(found)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(df: DataFrame) -> DataFrame:
    """Per row: doc_id, base counts per kind, base and all spans as text."""
    ship_package(df.sparkSession)

    def make(texts: list) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base", "spans")}
        for text in texts:
            base, found = scan_deep(text)
            for k, kind in enumerate(KINDS):
                out[f"n_{kind}"].append(sum(s[1] == k for s in base))
            out["base"].append(written(base))
            out["spans"].append(written(found))
        return out

    return per_text(df, make, "n_assign long, n_access long, n_hex long, base string, spans string")


def redact(df: DataFrame, mark: str = "[secret]") -> DataFrame:
    """All columns, with every span of ``text`` (base and decoded) replaced by ``mark``; overlapping spans are one."""
    ship_package(df.sparkSession)
    schema = df.schema
    rest = [c for c in df.columns if c != "text"]

    def make(texts: list) -> dict[str, list]:
        return {"_wardscope_clean": [None if t is None else without_secrets(t, mark) for t in texts]}

    return per_text(df, make, "_wardscope_clean string", keep=rest).withColumnRenamed("_wardscope_clean", "text").select(*schema.names)


def without_secrets(text: str, mark: str) -> str:
    parts, at = [], 0
    for start, _, end in scan_deep(text)[1]:
        if end <= at:
            continue
        if start >= at:
            parts += [text[at:start], mark]
        at = end
    return "".join([*parts, text[at:]])
