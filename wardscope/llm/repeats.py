"""Exact repeats of long byte strings by a column-wise suffix structure over many documents.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts anywhere else, in
the same document or another.  Matches never cross documents.

1. Anchors.  Of the hashed 64-byte grams inside each window of ``LENGTH`` bytes the smallest is
   its anchor (the last one, if equal).  That is a rule on the window's content, so equal windows
   have equal anchors at the same place in them.  An anchor whose hash occurs once cannot belong
   to a repeat and is dropped.
2. Pieces.  Around every other anchor the bytes of all its windows are cut out; equal pieces are
   counted as one.  All pieces of an anchor meet in one task, in batches of bounded size.
3. Columns.  The pieces of a batch stand in the order of what follows their anchor, with the
   common prefix of neighbours.  Each round puts one symbol before every piece: the column of
   preceding symbols in the present order is the batch's Burrows-Wheeler transform of that
   place, a stable sort by it gives the next order, and common prefixes follow as one more than
   the least between two rows of equal symbol.  A window that has a common prefix of ``LENGTH``
   with a neighbour repeats.  Rows that cannot reach that length any more leave.
4. Window starts go back to their documents as ranges.

Pieces of an anchor that more than ``CROWD`` different ones share are cut into narrower pieces
that are keyed by the bytes all their windows have in common; the result is the same.  Runs of a
short period repeat themselves and are marked at once; only their first period takes part above.

Null and empty texts have nothing to remove.  Rows that repeat an id are documents of their own:
they are told apart by a key of id and text; equal rows have one key and count as often as they
occur, so all their windows repeat.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardscope.llm.common import cut_lineage, ship_package

LENGTH = 400
GRAM = 64
#: Bytes of a document hashed at a time; a place in them fits into 20 bits.
CHUNK = 1 << 19
PERIODS = 16
CROWD = 50_000
NARROW = 32
#: Different pieces that go through the rounds together, unless one anchor has more.
BATCH = 20_000


# ---- anchors ----

def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all 64-byte grams, by doubling."""
    with np.errstate(over="ignore"):
        h = data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
        h ^= h >> np.uint64(29)
        step = 1
        while step < GRAM:
            h = h[:-step] * np.uint64(0xBF58476D1CE4E5B9 + 2 * step) + h[step:]
            h ^= h >> np.uint64(31)
            step *= 2
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def _minima(values: np.ndarray, size: int) -> np.ndarray:
    step = 1
    while 2 * step <= size:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return np.minimum(values[: len(values) - (size - step)], values[size - step :]) if size > step else values


def periodic(data: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(first, last, period) of window starts that equal the window one short period later."""
    out = []
    n = len(data)
    for q in range(1, PERIODS + 1):
        if n < length + q:
            break
        probe = data[q :: length // 4][: -(-(n - q) // (length // 4))] == data[: n - q : length // 4]
        if not (probe[:-2] & probe[1:-1] & probe[2:]).any():
            continue
        equal = np.concatenate([[0], (data[q:] == data[:-q]).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(equal))
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a >= length and not any(x <= a and b - length <= y for x, y, _ in out):
                out.append((int(a), int(b - length), q))
    return out


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(anchor hashes, anchor places, first and last window starts) and ranges of starts known to repeat."""
    b = np.frombuffer(data, np.uint8)
    windows = len(b) - length + 1
    none = np.zeros(0, np.int64)
    if windows < 1:
        return none, none, none, none, []
    known, skip = [], None
    for first, last, q in periodic(b, length):
        known += [(first, last + q)]
        skip = np.zeros(windows, bool) if skip is None else skip
        skip[first + q + 1 : last + 1] = True  # each equals the one a period before, and the first ones stay
    parts = []
    for at in range(0, windows, CHUNK):
        count = min(CHUNK, windows - at)
        h = _gram_hashes(b[at : at + count + length - 1])
        place = np.arange(len(h), dtype=np.uint64)
        low = np.uint64((1 << 20) - 1)
        least = _minima((h & ~low) | (low - place), length - GRAM + 1)
        p = (low - (least & low)).astype(np.int64)
        s = np.arange(count)
        if skip is not None:
            s = s[~skip[at : at + count]]
            p = p[s]
        if not len(s):
            continue
        cut = np.flatnonzero((np.diff(p) != 0) | (np.diff(s) != 1)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(s)]]) - 1
        parts.append((h[p[first]].view(np.int64), p[first] + at, s[first] + at, s[last] + at))
    if not parts:
        return none, none, none, none, known
    return *(np.concatenate([x[k] for x in parts]) for k in range(4)), known


# ---- columns ----

def _least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low + 1 : high + 1]) for each pair low < high."""
    if not len(low):
        return np.zeros(0, values.dtype)
    index = np.empty(2 * len(low), np.int64)
    index[::2], index[1::2] = low + 1, high + 1
    return np.minimum.reduceat(np.append(values, values.dtype.type(0)), index)[::2]


def repeated_starts(pieces: list[tuple[int, bytes, int, int]], length: int = LENGTH) -> list[np.ndarray]:
    """For each piece (group, bytes, place of the anchor, number of windows) whether each window start repeats in its group.

    One round per column to the left of the anchor; rows are kept in the order of their bytes
    from that column on, within groups.
    """
    out = [np.zeros(w, bool) for _, _, _, w in pieces]
    if not pieces:
        return out
    order = sorted(range(len(pieces)), key=lambda i: (pieces[i][0], pieces[i][1][pieces[i][2] :]))
    rows = np.array(order, np.int64)
    prefix = np.zeros(len(order), np.int32)
    for k in range(1, len(order)):
        (g, x, a, _), (f, y, c, _) = pieces[order[k - 1]], pieces[order[k]]
        if g == f:
            prefix[k] = _common(x[a:], y[c:], length)
    place = np.array([p[2] for p in pieces])
    windows = np.array([p[3] for p in pieces])
    group = np.unique(np.array([p[0] for p in pieces]), return_inverse=True)[1]
    starts = np.cumsum([0] + [len(p[1]) for p in pieces])
    data = np.frombuffer(b"".join(p[1] for p in pieces), np.uint8)
    flat = np.cumsum(np.concatenate([[0], windows]))
    repeats = np.zeros(flat[-1], bool)
    t = 0
    while len(rows):
        s = place[rows] - t
        both = np.maximum(prefix, np.append(prefix[1:], 0))
        hit = (both >= length) & (s < windows[rows])
        repeats[flat[rows[hit]] + s[hit]] = True
        # rows whose first column is reached, or that can no longer have a common prefix of the length, leave
        stay = (s > 0) & (both + s >= length)
        if not stay.all():
            kept = np.flatnonzero(stay)
            if len(kept) < 2:
                break
            prefix = np.concatenate([[0], _least_between(prefix, kept[:-1], kept[1:])]).astype(np.int32)
            rows = rows[kept]
        t += 1
        column = data[starts[rows] + place[rows] - t].astype(np.int64)  # the transform of this place
        key = group[rows] * 256 + column
        turn = np.argsort(key, kind="stable")
        new = np.zeros(len(rows), np.int32)
        key = key[turn]
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        new[same] = np.minimum(_least_between(prefix, turn[same - 1], turn[same]) + 1, 2 * length)
        rows, prefix = rows[turn], new
    return [repeats[flat[k] : flat[k + 1]] for k in range(len(pieces))]


def _common(x: bytes, y: bytes, most: int) -> int:
    n = min(len(x), len(y), most)
    if x[:n] == y[:n]:
        return n
    differ = np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n)
    return int(differ.argmax())


def ranges(starts: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the runs of True."""
    if not starts.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], starts.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]


def removed(spans: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Byte runs [start, end) covered by the windows of the start ranges, merged where they touch."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]


# ---- Spark ----

def _batch(columns, types, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def anchor_rows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """key, h, p, s1, s2 for every anchor; rows without h are starts known to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "h", "p", "s1", "s2"]
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            keys, out = [], [[], [], [], []]
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                *made, known = anchors(data, length)
                keys += [key] * len(made[0])
                for o, m in zip(out, made):
                    o.append(m)
                if known:
                    yield _batch([[key] * len(known), [None] * len(known), [0] * len(known), [a for a, _ in known], [b for _, b in known]], types, names)
            yield _batch([keys, *(np.concatenate(o) if o else [] for o in out)], types, names)

    return docs.filter(F.length("data") >= length).select("key", "data").mapInArrow(run, "key string, h long, p long, s1 long, s2 long")


def piece_rows(docs: DataFrame, shared: DataFrame, length: int = LENGTH) -> DataFrame:
    """The bytes around every shared anchor: key, h, g, at (first window start), place of the anchor, windows, bytes."""
    asked = shared.groupBy("key").agg(F.collect_list(F.struct("h", "p", "s1", "s2", "crowded")).alias("asked"))
    texts = docs.select("key", "data").join(asked, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "h", "g", "at", "place", "windows", "bytes"]
        types = (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        for batch in batches:
            out, held = [], 0
            for key, data, wanted in zip(batch.column("key").to_pylist(), batch.column("data").to_pylist(), batch.column("asked").to_pylist()):
                for w in wanted:
                    h, p, s1, s2 = w["h"], w["p"], w["s1"], w["s2"]
                    for a, b in [(s1, s2)] if not w["crowded"] else _narrow(p, s1, s2):
                        # what all windows of a narrow piece share, wherever the piece begins, names its group
                        core = b"" if not w["crowded"] else _core(data, p, a, length)
                        out.append((key, h, core, a, p - a, b - a + 1, data[a : b + length]))
                        held += b - a + length
                if held > 16 << 20:
                    yield _batch(list(zip(*out)), types, names)
                    out, held = [], 0
            if out:
                yield _batch(list(zip(*out)), types, names)

    return texts.select("key", "data", "asked").mapInArrow(run, "key string, h long, g binary, at long, place int, windows int, bytes binary")


def _narrow(p: int, s1: int, s2: int) -> list[tuple[int, int]]:
    """Window starts cut at multiples of ``NARROW`` before the anchor."""
    out = []
    a = s1
    while a <= s2:
        block = (p - a) // NARROW
        b = min(s2, p - block * NARROW)
        out.append((a, b))
        a = b + 1
    return out


def _core(data: bytes, p: int, a: int, length: int) -> bytes:
    """Digest of the bytes that every window of the narrow block of ``a`` covers, with the block's number."""
    block = (p - a) // NARROW
    first, end = p - block * NARROW, p - block * NARROW - NARROW + 1 + length
    return hashlib.blake2b(data[first:end], digest_size=16, salt=int(block).to_bytes(8, "little")).digest()


def repeated_ranges(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD, batch_size: int = BATCH) -> DataFrame:
    """key and ranges of window starts (first, last) whose window also starts elsewhere."""
    found = cut_lineage(anchor_rows(docs, length))
    counts = found.filter("h is not null").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = found.join(counts.select("h", (F.col("n") > crowd).alias("crowded")), "h")
    digest = F.unhex(F.sha2("bytes", 256)).alias("digest")
    pieces = cut_lineage(piece_rows(docs, shared, length).select("*", digest))
    # equal pieces are one row from here on; Spark counts them before it shuffles
    distinct = pieces.groupBy("h", "g", "place", "windows", "bytes").agg(F.count(F.lit(1)).alias("n")).select("*", digest)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = distinct.repartition(parts, "h", "g").sortWithinPartitions("h", "g").select("h", "g", "place", "windows", "digest", "bytes", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "g", "place", "windows", "digest", "first", "last"]
        types = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32())
        held: list[tuple] = []

        def settle(rows: list[tuple]) -> pa.RecordBatch:
            ids: dict = {}
            got = repeated_starts([(ids.setdefault((r[0], r[1]), len(ids)), r[5], r[2], r[3]) for r in rows], length)
            out = []
            for r, starts in zip(rows, got):
                for a, b in [(0, r[3] - 1)] if r[6] > 1 else ranges(starts):
                    out.append((*r[:5], a, b))
            return _batch(list(zip(*out)) or [()] * 7, types, names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= batch_size and row[:2] != held[-1][:2]:
                    yield settle(held)
                    held = []
                held.append(row)
        yield settle(held)

    hits = together.mapInArrow(run, "h long, g binary, place int, windows int, digest binary, first int, last int")
    same = ["h", "g", "place", "windows", "digest"]
    back = pieces.select("key", "at", *same).join(hits, same).select("key", (F.col("at") + F.col("first")).alias("s1"), (F.col("at") + F.col("last")).alias("s2"))
    return back.unionByName(found.filter("h is null").select("key", "s1", "s2"))


def keyed(df: DataFrame) -> DataFrame:
    """doc_id, the text's bytes (null: empty), and a key of id and text that survives repeated ids."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex(F.xxhash64("text")))
    return df.select("doc_id", data.alias("data"), key.alias("key"))


def without_repeats(df: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) for every row."""
    ship_package(df.sparkSession)
    docs = keyed(df)
    spans = cut_lineage(repeated_ranges(docs, length)).groupBy("key").agg(F.collect_list(F.struct("s1", "s2")).alias("spans"))
    joined = docs.join(spans, "key", "left").select("doc_id", "data", "spans")
    kind = dict(df.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                runs = removed([(s["s1"], s["s2"]) for s in found or []], length)
                parts, at = [], 0
                for a, b in runs:
                    parts.append(data[at:a])
                    at = b
                kept = b"".join([*parts, data[at:]])
                out.append((len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out)) or [()] * 5
            arrays = [batch.column(0)] + [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
