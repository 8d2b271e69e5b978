"""Cross-tokenizer alignment by diagonal run skipping.

Each text is encoded by two tokenizers, A (byte-level BPE, given a leading space) and B
(sentencepiece BPE, which adds that space itself).  Both token sequences tile the same bytes, so
each is a rising array of end offsets.  Alignment walks the two arrays at a current index shift
``j - i``: slices of doubling length are compared at that shift, which jumps whole stretches of
one-to-one tokens; where a slice differs, halving finds the first differing place, the irregular
group there is resolved by moving on whichever side is behind, and the shift becomes the new one.

The counts of linked id pairs are summed over the corpus in two steps.  The texts a task has in
hand at a time are a chunk; a chunk writes its own pair dictionary and every text's links as
places in it.  Dictionaries are summed by pair in Spark, and each chunk gets back the sums of its
own pairs only, so nothing is broadcast and no group grows with the corpus.

Defined results: null and empty texts, and texts whose joined token bytes differ from space+text,
have no tokens (all counts 0, no groups).  Rows that repeat an id are aligned each by itself; a
null id is kept.  An empty table gives no rows.  Of other columns only those in ``keep`` come
along, in front of the results and under their own names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardscope.llm.common import arrow_types, cut_lineage, ship_package
from wardscope.llm.tokens import byte_letters, tokenizer_path

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
#: Texts and characters of a chunk; a longer text is a chunk of its own.
CHUNK_TEXTS, CHUNK_CHARS = 1000, 2_000_000
#: Signs, digits and blanks that regular expression engines may class differently, and runs too long for ``tiktoken``.
NOT_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\u00a1-\u00a9\u00ab-\u00b1\u00b4-\u00b8\u00bb\u00bf-\u012f\u0131-\u024f]")
LONG_RUN = 400
LONG_BLANK = re.compile(r"\s{%d}" % LONG_RUN)
#: The public pre-token pattern of byte-level BPE.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HEX_PIECE = re.compile(r"<0x([0-9A-Fa-f]{2})>")

Links = tuple[np.ndarray, np.ndarray]


def is_plain(text: str) -> bool:
    """Whether both engines surely agree on the pre-tokens of a text."""
    return not NOT_PLAIN.search(text) and max(map(len, text.split()), default=0) < LONG_RUN and not LONG_BLANK.search(text)


def align_ends(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray, Links]:
    """Groups and links of two rising lists of end offsets whose last entries are equal.

    Returns the exclusive A and B index ends of each group, and the linked (A index, B index)
    pairs: all pairs of tokens whose ranges overlap.
    """
    size = len(ends_a)
    runs: list[tuple[int, int, int]] = []  # first A index, first B index, one-to-one groups
    irregular: list[tuple[int, int]] = []  # exclusive ends of the group after each run
    local_a: list[int] = []
    local_b: list[int] = []
    i = j = 0
    while i < size:
        first_i, first_j, step = i, j, 1
        if ends_a[i] == ends_b[j]:  # probe at the shift j - i, one token first
            i += 1
            j += 1
            step = 2
            while i < size and ends_a[i:i + step] == ends_b[j:j + step]:
                i += step
                j += step
                step += step
        if i >= size:  # the last slices were cut off by the end
            runs.append((first_i, first_j, size - first_i))
            irregular.append((0, 0))
            break
        while step > 2:
            step >>= 1
            if ends_a[i:i + step] == ends_b[j:j + step]:
                i += step
                j += step
        if step > 1 and ends_a[i] == ends_b[j]:
            i += 1
            j += 1
        runs.append((first_i, first_j, i - first_i))
        end_a, end_b = ends_a[i], ends_b[j]
        local_a.append(i)
        local_b.append(j)
        while end_a != end_b:
            if end_a < end_b:
                i += 1
                end_a = ends_a[i]
            else:
                j += 1
                end_b = ends_b[j]
            local_a.append(i)
            local_b.append(j)
        i += 1
        j += 1
        irregular.append((i, j))
    if not runs:
        none = np.zeros(0, np.int64)
        return none, none, (none, none)
    first_a, first_b, length = np.array(runs, np.int64).T
    place = _within(length)
    one_a, one_b = np.repeat(first_a, length) + place, np.repeat(first_b, length) + place
    tail = np.array(irregular, np.int64)
    tail = tail[tail[:, 0] > 0]
    group_a, group_b = np.concatenate([one_a + 1, tail[:, 0]]), np.concatenate([one_b + 1, tail[:, 1]])
    order = np.argsort(group_a, kind="stable")
    links = np.concatenate([one_a, np.array(local_a, np.int64)]), np.concatenate([one_b, np.array(local_b, np.int64)])
    return group_a[order], group_b[order], links


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... in each of several runs laid end to end."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64) - np.repeat(ends - lengths, lengths)


class TokenizerPair:
    """Both tokenizers and the bytes of their tokens.

    Plain texts of A go through ``tiktoken`` with the ranks of the same file, which is faster and
    gives the same ids there; other texts, and files whose ids are no merge ranks, go through
    ``tokenizers``.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = {c: b for b, c in byte_letters().items()}
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, k in vocabulary.items():
            self.bytes_a[k] = bytes([letters[c] for c in entry]) if all(c in letters for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m.group(1), 16)]) if (m := HEX_PIECE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        n, m = len(self.bytes_a), len(self.bytes_b)
        numbers = [str(k).encode() for k in range(max(n, m))]
        # A inside its group, A at its end, B inside, B at its end
        self.written = [x + s for count, s in ((n, b","), (n, b"|"), (m, b","), (m, b";")) for x in numbers[:count]]
        self.ranked = self._ranked(path_a)

    def _ranked(self, path: str):
        """``tiktoken`` with the entries of A as ranks, or None where A's ids do not rise with its merges."""
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        model = made["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        ids = [model["vocab"].get(x + y) for x, y in merges]
        if made.get("pre_tokenizer", {}).get("type") != "ByteLevel" or made.get("normalizer") or ids != list(range(256, 256 + len(ids))):
            return None
        import tiktoken

        ranks = {self.bytes_a[k]: k for k in range(256 + len(ids))}
        return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids_a(self, text: str) -> list[int]:
        """A's ids of space+text."""
        return self._coded_a(text)[0]

    def _coded_a(self, text: str) -> tuple[list[int], bytes]:
        """A's ids of space+text, and their joined bytes."""
        if self.ranked and is_plain(text):
            a = self.ranked.encode_ordinary(" " + text)
            return a, self.ranked.decode_bytes(a)
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        return a, b"".join(map(self.bytes_a.__getitem__, a))

    def encode(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B; none for a text without tokens."""
        of_a, of_b = [], []
        for text in texts:
            a = b = []
            if text:
                (a, whole), b, raw = self._coded_a(text), self.b.encode(text), (" " + text).encode()
                if whole != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
                    a = b = []
            of_a.append(a)
            of_b.append(b)
        return of_a, of_b


_PAIRS: dict[tuple[str, str], TokenizerPair] = {}


def tokenizer_pair(path_a: str, path_b: str) -> TokenizerPair:
    """One pair per worker process, so that its cache serves later tasks."""
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = TokenizerPair(path_a, path_b)
    return _PAIRS[path_a, path_b]


class Chunk:
    """Alignment of several texts at once; offsets run on from text to text, so text ends are group ends."""

    def __init__(self, pair: TokenizerPair, texts: list[str | None]):
        coded_a, coded_b = pair.encode(texts)
        self.n_a, self.n_b = (np.array([len(x) for x in coded], np.int64) for coded in (coded_a, coded_b))
        a = np.fromiter(chain.from_iterable(coded_a), np.int64, int(self.n_a.sum()))
        b = np.fromiter(chain.from_iterable(coded_b), np.int64, int(self.n_b.sum()))
        group_a, group_b, links = align_ends(np.cumsum(pair.length_a[a]).tolist(), np.cumsum(pair.length_b[b]).tolist())
        text_of = np.repeat(np.arange(len(texts)), self.n_a)
        self.n_groups = np.bincount(text_of[group_a - 1], minlength=len(texts))
        self.n_links = np.bincount(text_of[links[0]], minlength=len(texts))
        self.written = self._written(pair, a, b, group_a, group_b)
        key = a[links[0]] << 32 | b[links[1]]
        self.pairs, place, self.counts = np.unique(key, return_inverse=True, return_counts=True)
        width = max(len(self.pairs), 1)
        cell, times = np.unique(text_of[links[0]] * width + place, return_counts=True)
        bounds = np.searchsorted(cell // width, np.arange(len(texts) + 1))
        places = cell % width
        press = zstandard.ZstdCompressor(level=1)
        self.links = [press.compress(_pack(places[s:e], times[s:e])) for s, e in zip(bounds[:-1], bounds[1:])]

    def _written(self, pair: TokenizerPair, a, b, group_a, group_b) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` for every text."""
        start_a, start_b = np.concatenate([[0], group_a[:-1]]), np.concatenate([[0], group_b[:-1]])
        if not len(group_a):
            return [b""] * len(self.n_a)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[group_a - 1] = True
        last_b[group_b - 1] = True
        n, m = len(pair.bytes_a), len(pair.bytes_b)
        merged = np.empty(len(a) + len(b), np.int64)
        merged[np.arange(len(a)) + np.repeat(start_b, group_a - start_a)] = a + n * last_a
        merged[np.arange(len(b)) + np.repeat(group_a, group_b - start_b)] = b + 2 * n + m * last_b
        codes = merged.tolist()
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        pick = pair.written.__getitem__
        return [b"".join(map(pick, codes[s:e]))[:-1] for s, e in zip([0, *ends], ends)]


def _pack(places: np.ndarray, times: np.ndarray) -> bytes:
    return np.concatenate([np.diff(places, prepend=0), times]).astype("<u4").tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u4").astype(np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


COUNTS = "n_a long, n_b long, n_groups long, n_links long"


def _aligned(df: DataFrame, keep: list[str], text: str, path_a: str, path_b: str, digest: bool) -> DataFrame:
    """A row per text and a row per chunk (``_pairs`` not null), written once."""
    written = "groups_sha256" if digest else "groups"
    own = f"{COUNTS}, {written} string, _chunk string, _links binary, _pairs array<long>, _counts array<long>"
    source = df.select(*[F.col(c).alias(f"_keep{k}") for k, c in enumerate(keep)], F.col(text).alias("_text"))
    schema = ", ".join([f"_keep{k} {f.dataType.simpleString()}" for k, f in enumerate(source.schema.fields[:-1])] + [own])
    kept = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, part, types = tokenizer_pair(path_a, path_b), TaskContext.get().partitionId(), arrow_types(own)
        number = 0
        for whole in batches:
            for batch in _slices(whole, kept):
                chunk = Chunk(pair, batch.column(kept).to_pylist())
                name, rows = f"{part}-{number}", batch.num_rows
                number += 1
                groups = [(hashlib.sha256(w).hexdigest() if w else "") if digest else w.decode() for w in chunk.written]
                made = {"n_a": chunk.n_a, "n_b": chunk.n_b, "n_groups": chunk.n_groups, "n_links": chunk.n_links, written: groups, "_chunk": [name] * rows, "_links": chunk.links}
                columns = [batch.column(k) for k in range(kept)]
                columns += [pa.array(made[c], type=types[c]) if c in made else pa.nulls(rows, types[c]) for c in types]
                names = batch.schema.names[:kept] + list(types)
                yield pa.RecordBatch.from_arrays(columns, names=names)
                last = {"_chunk": [name], "_pairs": [chunk.pairs], "_counts": [chunk.counts]}
                columns = [pa.nulls(1, batch.column(k).type) for k in range(kept)]
                columns += [pa.array(last[c], type=types[c]) if c in last else pa.nulls(1, types[c]) for c in types]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return cut_lineage(source.mapInArrow(run, schema))


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows within the bounds of a chunk."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for k, size in enumerate(sizes):
        if k > start and (held + size > CHUNK_CHARS or k - start >= CHUNK_TEXTS):
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += size
    if len(sizes) > start:
        yield batch.slice(start)


def _totals(rows: DataFrame) -> DataFrame:
    """One row per linked id pair: its count, and whether no other pair of its B id has more."""
    entry = F.explode(F.arrays_zip(F.col("_pairs").alias("pair"), F.col("_counts").alias("n"))).alias("e")
    pairs = rows.filter(F.col("_pairs").isNotNull()).select(entry).groupBy(F.col("e.pair").alias("pair")).agg(F.sum("e.n").alias("links"))
    pairs = cut_lineage(pairs)
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = pairs.groupBy(b.alias("id_b")).agg(F.max("links").alias("most"))
    joined = pairs.withColumn("id_b", b).join(most, "id_b")
    return joined.select("pair", F.shiftright("pair", 32).alias("id_a"), "id_b", "links", (F.col("links") == F.col("most")).alias("best"))


def pair_counts(df: DataFrame, text: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """The corpus-wide id table: id_a, id_b, links, and whether the pair is the best of its B id."""
    ship_package(df.sparkSession)
    rows = _aligned(df, [], text, path_a or tokenizer_path(BYTE_BPE), path_b or tokenizer_path(PIECE_BPE), True)
    return _totals(rows).drop("pair")


def align_tokenizers(
    df: DataFrame, keep: list[str] | None = None, text: str = "text", path_a: str | None = None, path_b: str | None = None, digest: bool = False
) -> DataFrame:
    """One row per row of ``df``: the kept columns, n_a, n_b, n_groups, n_links, the groups, n_best, count_sum.

    ``groups`` is the alignment itself (``a1,a2|b1;a3|b2,b3``, empty without tokens); with
    ``digest`` its SHA-256 in lowercase hex takes its place as ``groups_sha256``, so that
    the text does not travel.  ``n_best`` counts links whose pair has the highest corpus-wide count of its B id,
    ties included; ``count_sum`` sums the counts of the text's links.
    """
    ship_package(df.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    rows = _aligned(df, keep, text, path_a or tokenizer_path(BYTE_BPE), path_b or tokenizer_path(PIECE_BPE), digest)
    entry = F.posexplode(F.col("_pairs")).alias("place", "pair")
    places = rows.filter(F.col("_pairs").isNotNull()).select(F.col("_chunk").alias("_of"), entry)
    sums = places.join(_totals(rows).select("pair", "links", "best"), "pair").select("_of", "place", "links", "best")
    texts = rows.filter(F.col("_pairs").isNull()).drop("_pairs", "_counts")
    out = [f for f in texts.schema.fields if f.name not in ("_chunk", "_links")]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in out] + ["n_best long, count_sum long"])

    def finish(texts: pa.Table, sums: pa.Table) -> pa.Table:
        place = sums.column("place").to_numpy()
        links, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        links[place] = sums.column("links").to_numpy()
        best[place] = sums.column("best").to_numpy()
        n_best, count_sum = [], []
        for data in texts.column("_links"):
            where, times = _unpack(data.as_py())
            n_best.append(int(best[where] @ times))
            count_sum.append(int(links[where] @ times))
        done = texts.drop_columns(["_chunk", "_links"])
        return done.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    done = texts.groupBy("_chunk").cogroup(sums.groupBy("_of")).applyInArrow(finish, schema)
    return done.select(*[F.col(f"_keep{k}").alias(c) for k, c in enumerate(keep)], *done.columns[len(keep):])
