"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of all benchmark terms are counted over every whole document.
2. The benchmark's passages become TF-IDF rows of length one; a distributed randomised SVD (sketch,
   power steps and products over partitions of passages; orthogonalisation on the driver) gives a
   latent space to every ``RANK`` passages, with fewer dimensions than passages, so that terms
   which go together are told apart less; the driver's matrices are bounded.
3. Every whole document is cut into overlapping word windows at several scales, from the shortest
   passages to the longest.  What each term can add to a passage's share of a window bounds it, so
   windows below the threshold by that bound are dropped without loss; the others are projected.
   Passages are candidates by their cosine to the window, both as long as they are in the space,
   and by their share of the whole window, with what the space keeps of the passage made up for.
4. A candidate that has enough words in common is settled on the words themselves: the longest common subsequence of the passage
   and the text around the window, and, for paraphrases, the passage's answer.  Verbatim copies
   need no window: words are compared wherever the rarest word of a passage stands.

Passages are taken in blocks of ``ITEM_BLOCK``; documents are read once more per block, whatever
the number of its spaces.  Terms that no passage has count with the highest inverse frequency.
Null or wordless passages and documents match nothing; equal passages are each reported; a repeated document is reported for
each of its rows.  An answer is what follows ``answer:`` in a passage, else its last
``ANSWER_WORDS`` words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardscope.llm.common import cut_lineage, per_text, ship_package

WORD = re.compile(r"[^\W_]+")
#: Lower-case letters and digits; other signs are blanks.
ASCII = {c: chr(c).lower() if chr(c).isalnum() else " " for c in range(128)}
ANSWER = re.compile(r"\banswer\s*:", re.IGNORECASE)
ANSWER_WORDS = 6
ITEM_BLOCK = 1024
#: Passages that share a latent space, and its dimensions as a share of them.
RANK = 256
DIMENSIONS = 0.75
#: What a space keeps of a passage's length is taken to be this at least.
LEAST_KEPT = 0.25
STEP = 4
#: Window lengths in steps of ``STEP`` words; shorter and longer ones are added for passages that need them.
SCALES = (3, 6, 12)
COSINE = 0.4
#: Share of the passage's words found in order: enough by itself, or together with the answer.
ALONE, WITH_ANSWER, ANSWER_SHARE = 0.7, 0.5, 0.6
ROWS = 4096
#: Windows projected at once, fewer of the long ones.
SPAN = 256


def words_of(text: str | None) -> list[str]:
    if text and text.isascii():
        return text.translate(ASCII).split()
    return WORD.findall((text or "").lower())


def scales_of(lengths: list[int]) -> list[int]:
    """Window lengths, each up to twice the one before, down to the shortest passage and up to the longest."""
    scales = [k for k in (1, 2) if min(lengths) < 2 * k * STEP and min(lengths) < SCALES[0] * STEP] + list(SCALES)
    while 2 * scales[-1] * STEP <= max(lengths):
        scales.append(2 * scales[-1])
    return scales


# ---- longest common subsequence ----

def lcs_length(a: list, b: list) -> int:
    """By bit-parallel rows: one big-integer step per element of ``b``."""
    at: dict = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & at.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def lcs_span(a: list, b: list) -> tuple[int, int, int]:
    """(length, first, end) of a longest common subsequence in ``b``, the one that ends first and starts last for that end."""
    best = lcs_length(a, b)
    if not best:
        return 0, 0, 0
    low, high = 1, len(b)  # shortest prefix that still has it
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if lcs_length(a, b[:mid]) == best else (mid + 1, high)
    end, low, high = low, 0, low - 1  # shortest suffix of that prefix
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if lcs_length(a, b[mid:end]) == best else (low, mid - 1)
    return best, low, end


def answer_of(text: str) -> list[str]:
    cut = list(ANSWER.finditer(text))
    return words_of(text[cut[-1].end() :]) if cut and words_of(text[cut[-1].end() :]) else words_of(text)[-ANSWER_WORDS:]


# ---- distributed randomised SVD of the passages ----

def _product(rows: DataFrame, right: np.ndarray) -> np.ndarray:
    """A'(A right) over all passages: partial sums per partition and block of terms, added up by Spark."""
    n_terms, width = right.shape

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n_terms, width))
        for batch in batches:
            for ids, weights in zip(batch["ids"], batch["weights"]):
                ids, weights = np.asarray(ids, np.int64), np.asarray(weights, float)
                total[ids] += weights[:, None] * (weights @ right[ids])
        for k in range(0, n_terms, ROWS):
            yield pd.DataFrame({"block": [k // ROWS], "data": [total[k : k + ROWS].tobytes()]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(d) for d in group["data"])
        return pd.DataFrame({"block": [int(group["block"].iloc[0])], "data": [total.tobytes()]})

    parts = rows.mapInPandas(partial, "block int, data binary").groupBy("block").applyInPandas(add, "block int, data binary").collect()
    return np.concatenate([np.frombuffer(r.data).reshape(-1, width) for r in sorted(parts, key=lambda r: r.block)])


def latent_space(rows: DataFrame, n_rows: int, n_terms: int, rank: int = RANK, over: int = 16, power: int = 2, seed: int = 11) -> np.ndarray:
    """(terms, rank) right singular vectors of the TF-IDF rows (ids, weights)."""
    width = min(rank + over, n_terms)
    sketch = np.random.default_rng(seed).normal(size=(n_terms, width))
    for _ in range(power):
        sketch = np.linalg.qr(_product(rows, sketch))[0]
    small = sketch.T @ _product(rows, sketch)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    kept = np.argsort(-values)[: min(rank, n_rows)]
    kept = kept[values[kept] > 1e-9 * max(values.max(), 1e-300)]
    return (sketch @ vectors[:, kept]).astype(np.float32)


# ---- search and settlement ----

class Retriever:
    """The passages of one space: terms, their weights, the latent vectors, and the words to settle on.

    The passages' own terms come first and have a row of the space each; other terms only have a weight.
    """

    def __init__(self, items: list[tuple], terms: list[str], idf: np.ndarray, unknown: float, space: np.ndarray):
        self.names = [i for i, _ in items]
        self.words = [words_of(t) for _, t in items]
        self.answers = [answer_of(t) for _, t in items]
        self.place = {t: k for k, t in enumerate(terms)}
        self.idf = idf.astype(np.float32)
        self.unknown = float(unknown)
        self.own = len(space)
        self.scales = scales_of([len(words) for words in self.words])
        # the last row is for words that are not the passages'
        self.weighted = np.concatenate([self.idf[: self.own, None] * space, np.zeros((1, space.shape[1]))]).astype(np.float32)
        self.counts = [dict(Counter(words)) for words in self.words]
        # passages by their rarest word
        self.rarest: dict[int, list[tuple[int, int]]] = {}
        for item, words in enumerate(self.words):
            at = max(range(len(words)), key=lambda k: self.idf[self.place[words[k]]])
            self.rarest.setdefault(self.place[words[at]], []).append((item, at))
        self.is_rarest = np.zeros(len(terms) + 1, bool)  # the last one is for unknown words
        self.is_rarest[list(self.rarest)] = True
        vectors, lengths = [], []
        for words in self.words:
            counts = Counter(words)
            ids = np.array([self.place[w] for w in counts], np.int64)
            weights = np.array(list(counts.values())) * self.idf[ids]
            vectors.append(weights @ space[ids])
            lengths.append(np.linalg.norm(weights))
        self.items = np.array(vectors, np.float32).reshape(len(items), -1)
        inside = np.linalg.norm(self.items, axis=1)
        self.items /= np.maximum(inside, 1e-12)[:, None]
        # the part of a passage's length that the space keeps
        self.kept = np.maximum(inside / np.maximum(lengths, 1e-12), LEAST_KEPT).astype(np.float32)
        # what one occurrence of a term can add to the share of any passage
        most = np.concatenate([(space[k : k + ROWS] @ (self.items / self.kept[:, None]).T).max(axis=1, initial=0) for k in range(0, self.own, ROWS)])
        self.gain = np.append(self.idf[: self.own] * most, np.zeros(len(terms) - self.own + 1)).astype(np.float32)
        self.square = np.append(self.idf**2, self.unknown**2).astype(np.float32)

    def ids_of(self, words: list[str]) -> np.ndarray:
        return np.array(list(map(self.place.get, words, repeat(-1))), np.int64)

    def copies(self, words: list[str], ids: np.ndarray) -> list[tuple[int, int]]:
        """(passage, first word) of every verbatim copy."""
        out = []
        for k in np.flatnonzero(self.is_rarest[ids]).tolist():
            for item, at in self.rarest[int(ids[k])]:
                own = self.words[item]
                if k >= at and words[k - at : k - at + len(own)] == own:
                    out.append((item, k - at))
        return out

    def candidates(self, ids: np.ndarray, cosine: float = COSINE) -> list[tuple[int, int, int, float]]:
        """(passage, first word, end word, cosine) of the windows above the threshold."""
        n = len(ids)
        padded = np.append(ids, np.full(STEP * (1 + max(self.scales)), -1))
        starts = np.arange(0, n, STEP)
        latent = None
        sums = np.add.reduceat(np.stack([self.gain[ids], self.square[ids]]), starts, axis=1)
        both = np.concatenate([[[0.0], [0.0]], sums.cumsum(axis=1, dtype=np.float64)], axis=1)
        out = []
        blocks = len(starts)
        for scale in self.scales:
            scale = min(scale, blocks)
            span = max(1, SPAN * max(SCALES) // max(scale, max(SCALES)))
            sums = both[:, scale:] - both[:, : blocks + 1 - scale]
            # a repeated term makes the window's length greater than the sum of squares, so this bound holds
            rows = np.flatnonzero(sums[0] ** 2 >= cosine**2 * sums[1] * (1 - 1e-5))
            for at in range(0, len(rows), span):
                part = rows[at : at + span]
                if latent is None:
                    latent = self._latent(padded, blocks)
                vectors = (latent[part + scale] - latent[part]).astype(np.float32)
                product = vectors @ self.items.T
                share = product / (np.sqrt(sums[1][part])[:, None] * self.kept)
                close = product / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]
                near = np.flatnonzero(((share >= cosine) & (close >= cosine)).any(axis=1))
                if not len(near):
                    continue
                chosen = part[near]
                square = sums[1][chosen]
                exact = share[near] * np.sqrt(square / (square + self._repeats(padded[chosen[:, None] * STEP + np.arange(scale * STEP)])))[:, None]
                for k, item in zip(*(x.tolist() for x in np.nonzero((exact >= cosine) & (close[near] >= cosine)))):
                    first = int(chosen[k]) * STEP
                    out.append((item, first, min(n, first + scale * STEP), float(min(1.0, close[near[k]][item]))))
            if scale == blocks:
                break
        return out

    def _repeats(self, inside: np.ndarray) -> np.ndarray:
        """What repeated words, which count squared in a window's true length, add to the sum of its squares."""
        rows, width = inside.shape
        terms = len(self.square)
        flat = (np.sort(inside, axis=1) + 1 + np.arange(rows)[:, None] * (terms + 1)).ravel()
        starts = np.flatnonzero(np.diff(flat, prepend=-1))
        times = np.diff(starts, append=len(flat)).astype(float)
        ids = flat[starts] % (terms + 1) - 1
        return np.bincount(starts // width, np.where(ids >= 0, times * (times - 1) * self.square[ids], 0.0), rows)

    def _latent(self, padded: np.ndarray, steps: int) -> np.ndarray:
        """Sums of the latent vectors of all words before each step, and of all."""
        sums = np.zeros((steps + 1, self.weighted.shape[1]))
        for at in range(0, steps, ROWS):
            part = padded[at * STEP : min(at + ROWS, steps) * STEP]
            vectors = self.weighted[np.where(part < self.own, part, -1)]
            for k in range(STEP):
                sums[at + 1 : at + 1 + len(part) // STEP] += vectors[k::STEP]
        return sums.cumsum(axis=0, out=sums)

    def settle(self, words: list[str]) -> list[tuple]:
        """(passage name, first word, end word, share of its words in order, cosine), best window per place."""
        if not words:
            return []
        out, covered = [], {}
        ids = self.ids_of(words)
        for item, first in self.copies(words, ids):
            end = first + len(self.words[item])
            if not any(a < end and first < b for a, b in covered.get(item, [])):
                covered.setdefault(item, []).append((first, end))
                out.append((self.names[item], first, end, 1.0, 1.0))
        for item, first, end, close in sorted(self.candidates(ids), key=lambda c: (c[0], -c[3], c[1])):
            if any(a < end and first < b for a, b in covered.get(item, [])):
                continue
            own = self.words[item]
            a, b = max(0, first - len(own)), min(len(words), end + len(own))
            part = words[a:b]
            counts = self.counts[item]
            known = [w for w in part if w in counts]  # others are in no common subsequence
            if sum([min(n, counts[w]) for w, n in Counter(known).items()]) < WITH_ANSWER * len(own):
                continue
            share = lcs_length(own, known) / len(own)
            if share < WITH_ANSWER:
                continue
            if share < ALONE:
                answer = self.answers[item]
                if lcs_length(answer, part) < ANSWER_SHARE * len(answer):
                    continue
            _, low, high = lcs_span(own, part)
            if high - low > 2 * len(own):  # words strewn over a long stretch are no passage
                continue
            covered.setdefault(item, []).append((a + low, a + high))
            out.append((self.names[item], a + low, a + high, share, close))
        return out


# ---- Spark ----

def _frequencies(df: DataFrame, terms: list[str]) -> tuple[Counter, int]:
    """Documents that have each term, and all documents; tasks count before anything is shuffled."""
    known = frozenset(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        n = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                if text:
                    total.update(known.intersection(words_of(text)))
        total[""] = n
        yield pa.RecordBatch.from_pydict({"term": list(total), "n": list(total.values())})

    got = df.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = Counter({r.term: r.n for r in got})
    return counts, counts.pop("", 0)


def contaminated(df: DataFrame, benchmark: DataFrame, item_block: int = ITEM_BLOCK, rank: int = RANK, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (doc_id by default), item_id, first_word, end_word, share, cosine for every passage found in a document."""
    spark = df.sparkSession
    ship_package(spark)
    kind = dict(benchmark.dtypes)["item_id"]
    keep = keep or ["doc_id"]
    schema = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in keep) + f", item_id {kind}, first_word int, end_word int, share double, cosine double"
    n_items = benchmark.count()
    found = spark.createDataFrame([], schema)
    blocks = max(1, math.ceil(n_items / item_block))
    numbered = benchmark.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("_block"))
    for block in range(blocks):
        items = [(r.item_id, r.text) for r in numbered.filter((F.col("_block") == block) & F.col("text").isNotNull()).collect() if words_of(r.text)]
        if not items:
            continue
        items.sort(key=lambda i: (str(i[0]), i[1]))
        terms = sorted({w for _, t in items for w in words_of(t)})
        counts, n = _frequencies(df, terms)
        unknown = math.log(n + 1) + 1
        retrievers = []
        for at in range(0, len(items), rank):
            part = items[at : at + rank]
            own = {w for _, t in part for w in words_of(t)}
            ordered = sorted(own) + [t for t in terms if t not in own]
            idf = np.array([math.log((n + 1) / (counts[t] + 1)) + 1 for t in ordered])
            place = {t: k for k, t in enumerate(ordered)}
            rows = []
            for _, text in part:
                c = Counter(words_of(text))
                ids = [place[w] for w in c]
                weights = np.array(list(c.values())) * idf[ids]
                rows.append((ids, (weights / np.linalg.norm(weights)).tolist()))
            passages = spark.createDataFrame(rows, "ids array<int>, weights array<double>").repartition(max(1, len(rows) // 64))
            retrievers.append(Retriever(part, ordered, idf, unknown, latent_space(passages, len(rows), len(own), math.ceil(DIMENSIONS * len(rows)))))
        shared = spark.sparkContext.broadcast(retrievers)  # bounded by item_block and rank

        def make(texts: list, shared=shared) -> dict[str, list]:
            hits = [[h for one in shared.value for h in one.settle(words)] for words in map(words_of, texts)]
            return {"items": [[None if h[0] is None else str(h[0]) for h in one] for one in hits]} | {
                name: [[h[k] for h in one] for one in hits] for k, name in ((1, "first"), (2, "end"), (3, "share"), (4, "close"))
            }

        made = per_text(df, make, "items array<string>, first array<int>, end array<int>, share array<double>, close array<double>", keep=keep)
        hit = made.filter(F.size("items") > 0).select(*keep, F.explode(F.arrays_zip("items", "first", "end", "share", "close")).alias("h"))
        rows = cut_lineage(
            hit.select(*keep, F.col("h.items").cast(kind).alias("item_id"), F.col("h.first").alias("first_word"), F.col("h.end").alias("end_word"), F.col("h.share").alias("share"), F.col("h.close").alias("cosine"))
        )
        shared.destroy()  # workers keep what is broadcast until told otherwise
        found = found.unionByName(rows)
    return found
