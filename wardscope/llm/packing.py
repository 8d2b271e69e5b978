"""Best-fit packing of token pieces into sequences, from the histogram of their lengths.

1. Whole texts become pieces: ids plus an end id, cut only where longer than a sequence.
2. The histogram of piece lengths (at most ``capacity`` rows) goes to the driver.  Its
   configuration linear program - fewest sequences so that every length is covered - is
   solved by multiplicative weights; each step prices the best configuration by a knapsack
   over lengths.
3. The fractional solution is rounded down, and the pieces left are placed by best fit on
   counts, not on pieces.
4. Pieces of one length are interchangeable, so each takes its slot by its rank within the
   length; ranks are summed over salted groups, so that a length that a third of all pieces
   share is spread out.

Null and empty texts are one piece that holds the end id only.  Rows that repeat an id are
packed each by itself.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardscope.llm.common import cut_lineage, crc_of_ids, per_text, ship_package
from wardscope.llm.tokens import encoder, tokenizer_path

CAPACITY = 4096
SALTS = 64
#: Part of the best configuration's weight by which others taken with it may fall short.
NEAR_BEST = 0.02


# ---- the plan, on the histogram ----

def knapsack(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest value of pieces that fit into each room, and one more than the last piece's place in ``lengths`` (0: room is left)."""
    table = np.full(capacity + 1, 0.0)
    worth = np.full(capacity + 1, -1.0)
    worth[lengths] = values  # by length
    pick = np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        gain = worth[1 : room + 1] + table[room - 1 :: -1]
        k = int(np.argmax(gain))
        if gain[k] > table[room - 1]:
            table[room], pick[room] = gain[k], k + 1
        else:
            table[room] = table[room - 1]
    index = np.zeros(capacity + 1, np.int64)
    index[lengths] = np.arange(1, len(lengths) + 1)
    return table, index[pick]


def pieces_of(pick: np.ndarray, lengths: np.ndarray, room: int) -> list[int]:
    """The pieces behind a room of ``knapsack``, as indices of lengths."""
    chosen = []
    while room > 0:
        if pick[room]:
            chosen.append(int(pick[room]) - 1)
            room -= int(lengths[chosen[-1]])
        else:
            room -= 1
    return chosen


def price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[list[int], float]:
    """The configuration of most value, as indices of lengths, by knapsack dynamic programming over capacity."""
    table, pick = knapsack(values, lengths, capacity)
    return pieces_of(pick, lengths, capacity), float(table[capacity])


def solve_configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int, rate: float = 0.3) -> dict[tuple[int, ...], float]:
    """Fractional number of sequences by configuration (sorted indices into ``lengths``) that uses every length as often as it occurs.

    Multiplicative weights on the covering rows: a length that the configurations so far
    cover too often loses weight, one that is used up has none.  One pricing gives, for every length, the
    configuration of most weight that holds it; those near the best are taken, each length by one of them.  It ends
    when nothing is left: a round uses up a length or takes a part of what is left of the most frequent.
    """
    log_w = np.log(1.0 / capacity * lengths.astype(float))
    left = counts.astype(float)
    plan: dict[tuple[int, ...], float] = {}
    while left.any():
        weights = np.where(left > 0, np.exp(log_w - log_w[left > 0].max()), 0.0)
        table, pick = knapsack(weights, lengths, capacity)
        own = np.where(left > 0, weights + table[capacity - lengths], 0.0)
        near = np.flatnonzero(own >= (1 - NEAR_BEST) * table[capacity])
        held = np.zeros(len(lengths), bool)
        for k in near[np.argsort(-own[near], kind="stable")].tolist():
            if held[k] or left[k] <= 0:
                continue
            key = tuple(sorted([k, *pieces_of(pick, lengths, capacity - int(lengths[k]))]))
            hit, times = np.unique(key, return_counts=True)
            held[hit] = True
            # as wide a step as the scarcest length of the configuration allows, part of it at a time
            most = left[hit] / times
            step = min(most.min(), max(1.0, rate * most.max()))
            if step <= 0:
                continue
            left[hit] -= step * times
            left[left < 1e-6] = 0.0
            plan[key] = plan.get(key, 0.0) + step
            log_w[hit] -= rate * step * times / counts[hit]
    return plan


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: ``left[l]`` pieces of length l; returns (lengths, number of sequences).

    Open sequences are grouped by the room they have and what they hold, so that equal
    ones are handled at once.
    """
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    present = np.zeros(capacity + 1, np.int64)  # open sequences by room
    for size in np.flatnonzero(left)[::-1]:
        size, n = int(size), int(left[size])
        while n:
            fits = np.flatnonzero(present[size:])
            if len(fits):
                room = size + int(fits[0])
                held, m = rooms[room].pop()
            else:
                room, held, m = capacity, (), -(-n // (capacity // size))
                present[room] += m
            take = min(m, n)
            present[room] -= m
            if m > take and held:  # a new group has no rest
                rooms.setdefault(room, []).append((held, m - take))
                present[room] += m - take
            copies = 1 if held else min(capacity // size, n)
            if not held:
                take = n // copies
            rooms.setdefault(room - copies * size, []).append((held + (size,) * copies, take))
            present[room - copies * size] += take
            n -= take * copies
    return [g for groups in rooms.values() for g in groups]


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences) that hold every piece exactly once."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        left[size] += n
    out: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    lengths = np.flatnonzero(left)
    if len(lengths):
        found = solve_configurations(lengths, left[lengths].copy(), capacity)
        for key, times in sorted(found.items(), key=lambda c: (-c[1], c[0])):
            sizes = tuple(int(lengths[k]) for k in key)
            need = np.bincount(sizes, minlength=capacity + 1)
            hit = np.flatnonzero(need)
            times = min(int(times), int((left[hit] // need[hit]).min()))
            if times > 0:
                left -= times * need
                out.append((sizes, times))
        out += best_fit(left, capacity)
    return out


def slot_runs(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, copies per sequence, offset of the first copy)."""
    taken: dict[int, int] = {}
    runs, sequence = [], 0
    for sizes, times in plan:
        offset = 0
        for size in sorted(set(sizes), reverse=True):
            copies = sizes.count(size)
            first = taken.get(size, 0)
            taken[size] = first + copies * times
            runs.append((size, first, taken[size], sequence, copies, offset))
            offset += copies * size
        sequence += times
    return runs


# ---- Spark ----

def token_pieces(df: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every piece of every whole text."""
    ship_package(df.sparkSession)
    path = path or tokenizer_path()
    end = np.asarray([end_id], "<u4").tobytes()

    def make(texts: list) -> dict[str, list]:
        encode = encoder(path).encode
        out: dict[str, list] = {"lengths": [], "crcs": []}
        for text in texts:
            ids = encode(text) + end
            cuts = range(0, len(ids), 4 * capacity)
            out["lengths"].append([len(ids[k : k + 4 * capacity]) // 4 for k in cuts])
            out["crcs"].append([crc_of_ids(ids[k : k + 4 * capacity]) for k in cuts])
        return out

    made = per_text(df, make, "lengths array<long>, crcs array<long>")
    return made.select("doc_id", F.posexplode(F.arrays_zip("lengths", "crcs")).alias("piece", "p")).select(
        "doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.col("p.lengths").alias("length"), F.col("p.crcs").alias("ids_crc32")
    )


def pack(df: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    spark = df.sparkSession
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int")
    pieces = cut_lineage(token_pieces(df, path, capacity, end_id).withColumn("_salt", salt))
    counts = pieces.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity x SALTS rows
    histogram: dict[int, int] = {}
    before = []
    for r in sorted(counts, key=lambda r: (r.length, r._salt)):
        before.append((r.length, r._salt, histogram.get(r.length, 0)))
        histogram[r.length] = histogram.get(r.length, 0) + r.n
    runs = slot_runs(plan_sequences(histogram, capacity))
    first = spark.createDataFrame(before, "length long, _salt int, _before long")
    # a rank falls into one run of its length; runs are as many as the plan has, whatever the number of pieces
    by_length = {}
    for size, a, b, sequence, copies, offset in runs:
        by_length.setdefault(size, []).append((a, b, sequence, copies, offset))
    slots = spark.createDataFrame(
        [(size, [tuple(map(int, r)) for r in group]) for size, group in by_length.items()],
        "length long, _runs array<struct<a:long,b:long,s:long,c:long,o:long>>",
    )
    ranked = pieces.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    placed = (
        ranked.join(F.broadcast(first), ["length", "_salt"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
        .join(F.broadcast(slots), "length")
        .withColumn("_run", F.filter("_runs", lambda r: (r["a"] <= F.col("_rank")) & (F.col("_rank") < r["b"]))[0])
    )
    k = F.col("_rank") - F.col("_run.a")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_run.s") + F.floor(k / F.col("_run.c"))).cast("long").alias("sequence_id"),
        (F.col("_run.o") + (k % F.col("_run.c")) * F.col("length")).cast("long").alias("offset"),
    )
