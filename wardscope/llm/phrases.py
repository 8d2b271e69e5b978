"""Phrase collocations: an FM-index per shard over word ids, extended in both directions.

Texts are cut into pieces and words; words of one language in one task form shards of bounded size.

1. Every shard lists its words with their counts; the sums give each frequent word an id.  No phrase
   is more frequent than a word of it, so other words become breaks.
2. A shard gets the ids of its own frequent words back, indexes its sequence and enumerates the
   phrases of every length with their counts.
3. The counts are summed across shards.  A shard sends one entry per different phrase, in sorted and
   compressed blocks per bucket of phrase digests; the number of buckets follows the number of
   words, so a bucket has the same size at every scale, and a phrase that every text repeats is
   one entry per shard.

The index holds the Burrows-Wheeler transform of the sequence and of its reverse, sorted to the
depth asked for.  A phrase is a pair of intervals, of the places it starts at and of those it ends
at; extending it on one side narrows one interval by ranks in the transform and moves the other by
the number of smaller symbols.  All intervals of a depth are extended at once, so a shard costs a
few sorts.  Left and right extensions of a phrase are the phrases one word longer, whose summed
counts decide which phrases are mere parts of a longer one.

No group holds more than one shard, words and phrases meet by key, and nothing is broadcast by hint.

Defined results: a null text is empty, a null language is ``und``; repeated rows and ids count each
time; an empty table gives no rows.  Only the text and language columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardscope.llm.common import arrow_types, cut_lineage, ship_package

#: UTF-8 bytes of a shard (some million words), and what a task holds of all languages together.
SHARD_BYTES, HELD_BYTES = 6_000_000, 16_000_000
UNDETERMINED = "und"
#: Classes of bytes: 0 in a word, 1 blank, 2 between pieces; separators are ASCII, so UTF-8 needs no decoding.
CLASS = np.zeros(256, np.uint8)
CLASS[list(b" \t")] = 1
CLASS[list(b".,;:!?\n\x0b\x0c\r")] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words_of(data: bytes) -> tuple[pa.Array, np.ndarray]:
    """Different words of a buffer, and its sequence of word numbers from 1 with 0 between pieces."""
    raw = LOWER[np.frombuffer(data, np.uint8)]
    kind = CLASS[raw]
    inside = kind == 0
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return pa.array([], pa.string()), np.zeros(0, np.int32)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside].tobytes())])
    coded = words.dictionary_encode()
    numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32) + 1
    breaks = np.cumsum(kind == 2, dtype=np.int32)
    new_piece = np.flatnonzero(breaks[starts[1:]] != breaks[ends[:-1] - 1]) + 1
    return coded.dictionary.cast(pa.large_string()).cast(pa.string()), np.insert(numbers, new_piece, 0)


def without_rare(sequence: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Numbers replaced by ``new`` (0: a break), breaks at both ends, no two breaks in a row."""
    mapped = np.concatenate([[0], new[sequence], [0]])
    return mapped[~((mapped == 0) & np.concatenate([[False], mapped[:-1] == 0]))].astype(np.int32)


class Phrases:
    """Intervals of phrases of one length: [low, low + count) forward, [back, back + count) in the reverse."""

    def __init__(self, size: int, low: np.ndarray, back: np.ndarray, count: np.ndarray):
        self.size, self.low, self.back, self.count = size, low, back, count


class BidirectionalIndex:
    """FM-index of a sequence and of its reverse, both sorted by the first ``depth`` symbols."""

    def __init__(self, sequence: np.ndarray, depth: int):
        self.sequence = sequence = np.asarray(sequence, np.int64)
        self.symbols = int(sequence.max(initial=0)) + 1
        self.order, self.transform, self.ranks = self._side(sequence, depth)
        _, self.back_transform, self.back_ranks = self._side(sequence[::-1], depth)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=self.symbols))])

    def _side(self, sequence: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rank, reach = sequence, 1
        order = np.argsort(rank, kind="stable")
        while reach < depth:  # prefix doubling, as far as asked for
            after = np.concatenate([rank[reach:], np.zeros(min(reach, len(rank)), np.int64)])[: len(rank)]
            key = rank * (int(rank.max(initial=0)) + 1) + after
            order = np.argsort(key, kind="stable")
            new = np.empty_like(rank)
            new[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
            rank, reach = new, reach * 2
        transform = np.concatenate([[0], sequence[:-1]])[order] if len(sequence) else sequence
        return order, transform, np.sort(transform * (len(sequence) + 1) + np.arange(len(sequence)))

    def _rank(self, ranks: np.ndarray, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each row of a transform."""
        return np.searchsorted(ranks, symbol * (len(self.sequence) + 1) + row) - self.first[symbol]

    def single(self) -> Phrases:
        symbol = np.flatnonzero(np.diff(self.first))
        symbol = symbol[symbol > 0]
        low = self.first[symbol]
        return Phrases(1, low, low, self.first[symbol + 1] - low)

    def extend(self, phrases: Phrases, right: bool) -> Phrases:
        """All phrases one word longer on one side."""
        transform, ranks = (self.back_transform, self.back_ranks) if right else (self.transform, self.ranks)
        narrowed, moved = (phrases.back, phrases.low) if right else (phrases.low, phrases.back)
        owner = np.repeat(np.arange(len(narrowed)), phrases.count)
        row = np.arange(len(owner)) + np.repeat(narrowed - (np.cumsum(phrases.count) - phrases.count), phrases.count)
        cell, count = np.unique(owner * self.symbols + transform[row], return_counts=True)
        owner, symbol = cell // self.symbols, cell % self.symbols
        before = np.cumsum(count) - count
        smaller = before - before[np.searchsorted(owner, owner)]  # within the interval, breaks included
        owner, symbol, count, smaller = (x[symbol > 0] for x in (owner, symbol, count, smaller))
        narrow = self.first[symbol] + self._rank(ranks, symbol, narrowed[owner])
        move = moved[owner] + smaller
        order = np.argsort(move if right else narrow, kind="stable")
        low, back = (move, narrow) if right else (narrow, move)
        return Phrases(phrases.size + 1, low[order], back[order], count[order])

    def words(self, phrases: Phrases) -> np.ndarray:
        """A row of symbols per phrase."""
        return self.sequence[self.order[phrases.low][:, None] + np.arange(phrases.size)]


def _press_columns(columns: np.ndarray) -> bytes:
    """Rows of 32-bit numbers, their bytes by place: the upper ones of small numbers are equal and take little room."""
    planes = columns.astype("<u4").view(np.uint8).reshape(*columns.shape, 4).transpose(0, 2, 1)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _columns(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(n, 4, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4")[:, :, 0]


def _press(sequence: np.ndarray) -> bytes:
    return _press_columns(sequence[None, :])


def _sequence(data: bytes) -> np.ndarray:
    return _columns(data, 1)[0].astype(np.int32)


SHARD = "shard string, lang string, words array<string>, counts array<long>, sequence binary"


def _shards(df: DataFrame, text: str, lang: str) -> DataFrame:
    source = df.filter(F.length(text) > 0).select(F.coalesce(F.col(lang).cast("string"), F.lit(UNDETERMINED)).alias("lang"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, part, number = arrow_types(SHARD), TaskContext.get().partitionId(), 0
        held: dict[str, list[str]] = {}
        size: dict[str, int] = {}

        def shard(name: str) -> pa.RecordBatch:
            nonlocal number
            words, sequence = words_of("\n".join(held.pop(name)).encode())
            size.pop(name)
            counts = np.bincount(sequence, minlength=len(words) + 1)[1:]
            number += 1
            made = {"shard": [f"{part}-{number}"], "lang": [name], "counts": [counts], "sequence": [_press(sequence)]}
            lists = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
            return pa.RecordBatch.from_arrays([lists if c == "words" else pa.array(made[c], types[c]) for c in types], names=list(types))

        for batch in batches:
            for name, value, wide in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), pc.binary_length(batch.column(1)).to_pylist()):
                held.setdefault(name, []).append(value)
                size[name] = size.get(name, 0) + wide + 1
                if size[name] >= SHARD_BYTES:
                    yield shard(name)
                elif sum(size.values()) >= HELD_BYTES:
                    yield shard(max(size, key=size.get))
        for name in list(held):
            yield shard(name)

    return cut_lineage(source.mapInArrow(run, SHARD))


#: Entries of a bucket, about.
BUCKET = 3_000_000
BLOCKS = "size int, bucket long, entries binary"


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    mixed = np.zeros(len(keys), np.uint64)
    for column in keys.T:
        mixed = (mixed ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed % np.uint64(buckets)).astype(np.int64)


def _enumerated(longest: int, buckets: int):
    def make(own: pa.Table, known: pa.Table) -> pa.Table:
        """Index a shard over its frequent words and list its phrases, a block per length and bucket."""
        made = {"size": [], "bucket": [], "entries": []}
        for data in own.column("sequence"):
            sequence = _sequence(data.as_py())
            new = np.zeros(int(sequence.max(initial=0)) + 1, np.int32)
            # ranks of ids as symbols: phrases then come in the order of their ids
            order = np.argsort(known.column("id").to_numpy())
            ids = np.concatenate([[0], known.column("id").to_numpy()[order]])
            new[known.column("place").to_numpy()[order] + 1] = np.arange(1, len(ids))
            index = BidirectionalIndex(without_rare(sequence, new), longest)
            found = index.single()
            while found.size < longest and len(found.count):
                found = index.extend(found, right=found.size % 2 == 1)  # to the right, then to the left
                entries = np.column_stack([ids[index.words(found)], found.count])
                bucket = _bucket(entries[:, :-1], buckets)
                order = np.argsort(bucket, kind="stable")
                starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                for part in np.split(order, starts[1:]) if len(order) else []:
                    made["size"].append(found.size)
                    made["bucket"].append(int(bucket[part[0]]))
                    made["entries"].append(_press_entries(entries[part]))
        types = arrow_types(BLOCKS)
        return pa.table({c: pa.array(made[c], types[c]) for c in types})

    return make


def _press_entries(entries: np.ndarray) -> bytes:
    """Column by column, of the first one, which rises, the steps; ids are below 2^32, and a count of 2^32 or more in one shard is not possible."""
    columns = np.ascontiguousarray(entries.T.astype("<u4"))
    columns[0] = np.diff(columns[0], prepend=np.uint32(0))
    return _press_columns(columns)


def _entries(data: bytes, size: int) -> np.ndarray:
    """Columns of ids and the counts."""
    columns = _columns(data, size + 1)
    return np.concatenate([np.cumsum(columns[:1], axis=1, dtype=np.uint32), columns[1:]])


def _summed(least: int):
    def make(blocks: pa.Table) -> pa.Table:
        """Sums of one bucket's entries, as far as they are frequent."""
        size = blocks.column("size")[0].as_py()
        parts = [_entries(b.as_py(), size) for b in blocks.column("entries")]
        columns = np.concatenate(parts, axis=1).astype(np.int64)
        pairs = [columns[k] << 32 | (columns[k + 1] if k + 1 < size else 0) for k in range(0, size, 2)]
        order = np.lexsort(pairs[::-1])
        new = np.zeros(len(order), bool)
        new[:1] = True
        for pair in pairs:
            new[1:] |= np.diff(pair[order]) != 0
        starts = np.flatnonzero(new)
        n = np.add.reduceat(columns[size][order], starts)
        frequent = n >= least
        keys = columns[:size, order[starts[frequent]]].T
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * size, pa.int32()), pa.array(keys.ravel(), pa.int64()))
        return pa.table({"key": lists, "n": pa.array(n[frequent], pa.int64())})

    return make


def _with_ids(words: DataFrame) -> DataFrame:
    """Written rows with ids from 1 without gaps, about the smaller the more frequent, so that most ids in entries are small."""
    placed = cut_lineage(words.orderBy(F.desc("n"), "lang", "word").withColumn("id", F.monotonically_increasing_id()))
    part = F.shiftright("id", 33)
    sizes = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row per partition
    before, offsets = 1, []
    for number, n in sizes:
        offsets.append((number, before))
        before += n
    if before > 1 << 32:
        raise ValueError("more than 2^32 frequent words")
    starts = words.sparkSession.createDataFrame(offsets, "part long, start long")
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("id", F.col("start") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "start")


def phrase_counts(df: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (id, lang, word, n), frequent phrases of 1 to ``longest`` word ids (key, n), and words per language (lang, n)."""
    if longest < 2:
        raise ValueError("phrases have at least two words")
    ship_package(df.sparkSession)
    shards = _shards(df, text, lang)
    listed = shards.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("e"))
    counted = cut_lineage(listed.groupBy("lang", F.col("e.words").alias("word")).agg(F.sum("e.counts").alias("n")))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    words = cut_lineage(_with_ids(counted.filter(F.col("n") >= least)))

    own = shards.select(F.col("shard").alias("of"), "lang", F.posexplode("words").alias("place", "word"))
    known = own.join(words, ["lang", "word"]).select("of", "place", "id")
    positions = words.agg(F.sum("n")).first()[0] or 0
    buckets = 1 + positions // BUCKET
    blocks = shards.select("shard", "sequence").groupBy("shard").cogroup(known.groupBy("of")).applyInArrow(_enumerated(longest, buckets), BLOCKS)
    phrases = blocks.groupBy("size", "bucket").applyInArrow(_summed(least), "key array<long>, n long")
    return words, cut_lineage(words.select(F.array("id").alias("key"), "n").unionByName(phrases)), totals


def collocations(
    df: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4, top: int = 2000, absorbed: int = 80
) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score, all numbers long.

    ``a`` counts a phrase, ``l`` and ``r`` the two parts of its lowest-scoring cut, ``n`` all words of
    the language; score = floor(2,000,000 a / (l + r)).  A phrase that a longer one holds goes if the
    longer one has at least ``absorbed`` percent of its count; as the phrases between the two are at
    least as frequent as the longer one, comparing with phrases one word longer is enough.
    """
    words, every, totals = phrase_counts(df, text, lang, least, longest)
    found = every.filter(F.size("key") > 1).withColumnRenamed("n", "a")
    longer = found.filter(F.size("key") > 2)
    inner = F.explode(F.array(F.expr("slice(key, 1, size(key) - 1)"), F.expr("slice(key, 2, size(key) - 1)"))).alias("key")
    held = longer.select(inner, "a").groupBy("key").agg(F.max("a").alias("most"))
    found = found.join(held, "key", "left").filter(f"most is null or cast(most as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {int(absorbed)}").drop("most")

    cuts = found.withColumn("k", F.explode(F.expr("sequence(1, size(key) - 1)")))
    cuts = cuts.withColumn("first", F.expr("slice(key, 1, k)")).withColumn("rest", F.expr("slice(key, k + 1, size(key) - k)"))
    cuts = cuts.join(every.select(F.col("key").alias("first"), F.col("n").alias("l")), "first").join(every.select(F.col("key").alias("rest"), F.col("n").alias("r")), "rest")
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + r)")
    scored = cuts.withColumn("score", score).groupBy("key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    spelled = scored.select("key", "a", "cut", F.posexplode("key").alias("place", "id")).join(words.select("id", "lang", "word"), "id")
    spelled = spelled.groupBy("key", "a", "cut", "lang").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("words"))
    spelled = spelled.select("lang", F.concat_ws(" ", F.col("words.word")).alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    best = F.expr("row_number() over (partition by lang order by score desc, a desc, phrase)").cast("long")
    ranked = spelled.withColumn("rank", best).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: The contract of op13 as SQL over ``documents``.
ORACLE = f"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(regexp_split_to_array(translate(text, '{LETTERS.upper()}', '{LETTERS}'), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents where text is not null),
split as (select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') as words from pieces),
grams as (
  select lang, words[i:i + k - 1] as words, k
  from split, (select unnest([1, 2, 3, 4]) as k) as sizes, lateral (select unnest(range(1, len(words) - k + 2)) as i) as places),
counts as (select lang, words, k, count(*) as f from grams group by all),
totals as (select lang, sum(f)::bigint as n from counts where k = 1 group by lang),
candidates as (select lang, words, k, f as a from counts where k > 1 and f >= 30),
inner_parts as (
  select lang, words[s:s + size - 1] as words, max(a) as most
  from candidates, (select unnest([2, 3]) as size) as sizes, lateral (select unnest(range(1, k - size + 2)) as s) as starts
  where size < k group by all),
kept as (
  select c.lang, c.words, c.k, c.a from candidates c left join inner_parts p on p.lang = c.lang and p.words = c.words
  where p.most is null or 100 * p.most < 80 * c.a),
cuts as (
  select c.lang, c.words, c.a, cut, l.f as l, r.f as r, (2000000::hugeint * c.a) // (l.f::hugeint + r.f) as score
  from (select *, unnest(range(1, k)) as cut from kept) c
  join counts l on l.lang = c.lang and l.words = c.words[1:cut]
  join counts r on r.lang = c.lang and r.words = c.words[cut + 1:c.k]),
scored as (
  select *, row_number() over (partition by lang, words order by score, cut) as place from cuts),
ranked as (
  select lang, array_to_string(words, ' ') as phrase, a, l, r, score,
         row_number() over (partition by lang order by score desc, a desc, array_to_string(words, ' ')) as rank
  from scored where place = 1)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
from ranked join totals using (lang) where rank <= 2000
"""
