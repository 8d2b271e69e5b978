"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments.  Of two fingerprints that differ in at
most two bits, one segment differs in at most one; so both hold an equal variant of that
segment with one bit position wiped.  The index has these one-wildcard variants (64 rows a
distinct fingerprint), an equality join on them gives the candidates, and the whole
fingerprints verify them.

Equal fingerprints meet before the index, so copies cost one row.  A variant that more than
``CROWD`` fingerprints hold is not paired: its members are keyed again by the one-wildcard
variants of the other segment (any two with an equal key differ in at most two bits and are
linked to the smallest), and, where a whole segment is that common, by the two-wildcard
variants of the other one.  Both are exact and linear in the members.

Texts without words (null, empty, blanks only) have fingerprint zero and link like any other.
Fewer words than a shingle make one shingle.  Repeated ids stay separate rows with the same id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardscope.llm.common import cut_lineage, per_text, ship_package
from wardscope.operators.components import components

SEED = 42
SHINGLE = 3
SEGMENT = 32
#: Above so many distinct fingerprints a variant is keyed again instead of paired.
CROWD = 48


def fingerprint(text: str | None, words: int = SHINGLE, chunk: int = 65_536) -> int:
    """Signed 64-bit fingerprint; a bit is set where over half of the shingle hashes have it."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z only, and blank, \t to \r
    if not parts:
        return 0
    if len(parts) < words:
        shingles = iter([b" ".join(parts)])
        n = 1
    else:
        n = len(parts) - words + 1
        shingles = map(b" ".join, zip(*(parts[k:] for k in range(words))))
    ones = np.zeros(64, np.int64)
    hashes = (xxh64_intdigest(s, SEED) for s in shingles)
    for at in range(0, n, chunk):
        got = np.fromiter(hashes, "<u8", min(chunk, n - at))
        ones += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    value = np.packbits(2 * ones > n, bitorder="little").view("<i8")[0]
    return int(value)


def fingerprints(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (doc_id by default) and fp, the fingerprint of every whole text as a signed long."""
    ship_package(df.sparkSession)
    return per_text(df, lambda texts: {"fp": [fingerprint(t) for t in texts]}, "fp long", keep=keep)


def _segment(fp: Column, segment: int) -> Column:
    return F.shiftrightunsigned(fp, SEGMENT * segment).bitwiseAND(F.lit(2**SEGMENT - 1))


def _key(value: Column, segment: Column, bit: Column) -> Column:
    """32 bits of a segment, one of them wiped, with the segment and the bit, in one long."""
    one = F.expr("1L")
    wiped = value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", one, bit)))
    return F.call_function("shiftleft", segment * SEGMENT + bit, F.lit(SEGMENT)).bitwiseOR(wiped)


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b or a = smallest, that connect all distinct fingerprints at two or fewer bits.

    Their transitive closure equals that of all such pairs; within crowded variants only
    links to the smallest member are given.
    """
    bits = F.explode(F.sequence(F.lit(0), F.lit(SEGMENT - 1)))
    both = fps.select("fp", F.posexplode(F.array(_segment(F.col("fp"), 0), _segment(F.col("fp"), 1))).alias("seg", "value")).select("*", bits.alias("bit"))
    index = both.select("fp", "seg", "bit", _key(F.col("value"), F.col("seg").cast("long"), F.col("bit")).alias("key"))
    # rows that stand alone are most of the index; they go here, before anything is kept
    shared = index.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("n > 1")
    shared = cut_lineage(shared)
    few = shared.filter(F.col("n") <= CROWD)
    left, right = few.select("key", "bit", "seg", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    here = _segment(differ, 0)
    own = F.when(F.col("seg") == 0, here).otherwise(_segment(differ, 1))
    # a pair meets in one variant of a segment that differs in a bit, in all if it is equal: the first stands for them
    paired = (
        left.join(right, "key")
        .filter("a < b")
        .filter(F.bit_count(differ) <= 2)
        .filter((F.bit_count(own) == 1) | (F.col("bit") == 0))
        .select("a", "b")
    )
    crowd = shared.filter(F.col("n") > CROWD)
    other = F.when(F.col("seg") == 0, _segment(F.col("fp"), 1)).otherwise(_segment(F.col("fp"), 0))
    again = crowd.select("fp", "key", other.alias("other"), bits.alias("bit2"))
    near = _to_smallest(again, "key", "bit2", _key(F.col("other"), F.lit(0).cast("long"), F.col("bit2")))
    # a whole segment in common, and two bits of the other: only where that segment itself is crowded
    whole = F.when(F.col("seg") == 0, _segment(F.col("fp"), 0)).otherwise(_segment(F.col("fp"), 1))
    full = crowd.filter("bit = 0").select("fp", "seg", whole.alias("whole"), other.alias("other"))
    full = full.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("seg", "whole"))).filter("m > 1")
    small = full.filter(F.col("m") <= CROWD)
    x, y = small.select("seg", "whole", F.col("fp").alias("a")), small.select("seg", "whole", F.col("fp").alias("b"))
    within = x.join(y, ["seg", "whole"]).filter("a < b").filter(F.bit_count(differ) <= 2).select("a", "b")
    # bit 0 of the own segment is wiped in ``full``, so a pair that differs there is met in its own variant
    two = full.filter(F.col("m") > CROWD).select("*", bits.alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(SEGMENT - 1))).alias("j")).filter("i < j")
    one = F.expr("1L")
    mask = F.bitwise_not(F.call_function("shiftleft", one, F.col("i")).bitwiseOR(F.call_function("shiftleft", one, F.col("j"))))
    wide = _to_smallest(two.withColumn("ij", F.col("i") * SEGMENT + F.col("j")), "seg", "whole", F.col("other").bitwiseAND(mask), "ij")
    return paired.unionByName(near).unionByName(within).unionByName(wide)


def _to_smallest(df: DataFrame, *keys) -> DataFrame:
    """Links of the members of each group to its smallest; ``min`` combines before the shuffle."""
    columns = [F.col(k).alias(f"k{n}") if isinstance(k, str) else k.alias(f"k{n}") for n, k in enumerate(keys)]
    rows = df.select("fp", *columns)
    names = [c for c in rows.columns if c != "fp"]
    least = rows.groupBy(*names).agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    return rows.join(least, names).filter("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (doc_id among them), fp, root (names the group) and component_id for every row.

    component_id is the smallest document id of the group; a null id is never the smallest
    unless all are null.
    """
    docs = cut_lineage(fingerprints(df, keep))
    distinct = cut_lineage(docs.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(distinct.select("fp")))
    # fingerprints with a link only; each takes the smallest document of its group
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    final = named.join(least, "root").select("fp", "root", "component_id")
    return docs.join(final, "fp").select(*(keep or ["doc_id"]), "fp", "root", "component_id")
