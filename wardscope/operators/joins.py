"""Population-preserving joins, ledgers, key fallbacks and set comparisons.

A side is broadcast only when the optimizer or adaptive execution has measured it below
``autoBroadcastJoinThreshold``; where a side is exploded before the join, which the optimizer
cannot see, the operator measures the other side itself and names the join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardscope.functions import fixed_values as V
from wardscope.functions.scalars import parent_city
from wardscope.operators.dedupe import keep_first
from wardscope.session import cut_lineage

# names of a table sent to all tasks, in characters with 64 for each row
MOST_SENT = 8_000_000


def conform(population: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that never loses a population row."""
    return population.join(facts, keys, "left")


def outer_with_origin(left: DataFrame, right: DataFrame, keys: list[str], origin: str = "origin") -> DataFrame:
    """Full outer join telling which side each key came from."""
    a = left.withColumn("_in_left", F.lit(True))
    b = right.withColumn("_in_right", F.lit(True))
    side = (
        F.when(F.col("_in_left").isNotNull() & F.col("_in_right").isNotNull(), "both")
        .when(F.col("_in_left").isNotNull(), "left_only")
        .otherwise("right_only")
    )
    return a.join(b, keys, "full").withColumn(origin, side).drop("_in_left", "_in_right")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", check: str = "join_key") -> tuple[DataFrame, DataFrame]:
    """(joined rows, violations): keys that repeat on a side, which would multiply rows.

    Violations name the side; a caller that needs the guarantee refuses to go on
    unless there are none.  Both sides are counted before anything is shuffled.
    """
    from wardscope.operators import contract as C

    present = [reduce(lambda d, k: d.filter(F.col(k).isNotNull()), keys, side).select(*keys) for side in (left, right)]
    violations = C.unique(present[0], keys, f"{check}:left").unionByName(C.unique(present[1], keys, f"{check}:right"))
    return left.join(right, keys, how), violations


def keep_known(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_semi")


def drop_known(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_anti")


def apply_overrides(
    df: DataFrame,
    ledger: DataFrame,
    key: str,
    values: list[str],
    expected: dict[str, str] | None = None,
    marks: dict[str, Column] | None = None,
) -> DataFrame:
    """Replace ``values`` by the ledger's, only where the expected old values still hold.

    ``expected`` maps a column of ``df`` to the ledger column holding the value
    it must have; ``marks`` sets further columns on overridden rows.
    """
    expected, marks = expected or {}, marks or {}
    side = ledger.select(
        F.col(key),
        F.lit(True).alias("_hit"),
        *[F.col(v).alias(f"_new_{v}") for v in values],
        *[F.col(e).alias(f"_old_{c}") for c, e in expected.items()],
    )
    joined = df.join(side, key, "left")
    applies = F.coalesce(F.col("_hit"), F.lit(False))
    for c in expected:
        applies = applies & F.trim(F.col(c).cast("string")).eqNullSafe(F.trim(F.col(f"_old_{c}").cast("string")))
    out = []
    for c in df.columns:
        if c in values:
            out.append(F.when(applies, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        elif c in marks:
            out.append(F.when(applies, marks[c]).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def apply_exclusions(
    df: DataFrame, ledger: DataFrame, key: str, nulled: list[str], state_column: str, state: str = V.STATE_EXCLUDED
) -> DataFrame:
    """Excluded rows stay in the population, stripped of catalogue values."""
    joined = df.join(ledger.select(key, F.lit(True).alias("_out")).distinct(), key, "left")
    out = []
    for c in df.columns:
        if c in nulled:
            out.append(F.when(F.col("_out").isNull(), F.col(c)).alias(c))
        elif c == state_column:
            out.append(F.when(F.col("_out"), F.lit(state)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def resolve_key(
    df: DataFrame, known: DataFrame, direct: str, fallback: str, known_key: str, matched: str = "matched_key", how: str = "match_kind"
) -> DataFrame:
    """Direct key if known, else the fallback key if known, else none."""
    keys = known.select(F.col(known_key).alias("_k")).distinct()
    first = df.join(keys.withColumnRenamed("_k", "_k1"), F.col(direct) == F.col("_k1"), "left")
    both = first.join(
        keys.withColumnRenamed("_k", "_k2"), F.col("_k1").isNull() & (F.col(fallback) == F.col("_k2")), "left"
    )
    kind = F.when(F.col("_k1").isNotNull(), "direct").when(F.col("_k2").isNotNull(), "parent").otherwise("none")
    return both.select(*df.columns, F.coalesce("_k1", "_k2").alias(matched), kind.alias(how))


def boundary_keys(features: DataFrame, regions: DataFrame) -> DataFrame:
    """Boundary features mapped to region keys: own name, else the parent city."""
    own = features.withColumn("_own", F.concat_ws("|", "province", "name")).withColumn(
        "_parent", F.concat(F.col("province"), F.lit("|"), parent_city(F.col("name")))
    )
    return resolve_key(own, regions, "_own", "_parent", "region_key").drop("_own", "_parent")


def longest_contained(
    texts: DataFrame, names: DataFrame, text_id: str, text: str, name: str, scope: str | None = None
) -> DataFrame:
    """Longest name occurring inside each text (spaces ignored), ties by name.

    Each text lists its substrings of the lengths that names really have, and
    those are joined to the names by equality; equal texts are listed once.  Only true occurrences are ever
    paired, and the work follows text length instead of texts times names.
    The substrings are never the side that is collected: the optimizer takes them for
    as small as their texts, so names measured as small are broadcast by name, and
    all else is joined by sorting.
    """
    scoped = [scope] if scope else []
    keys = scoped + ["_text"]
    wanted = (
        names.select(*scoped, F.col(name).alias("_name"))
        .withColumn("_bare", F.regexp_replace("_name", r"\s+", ""))
        .filter("_bare <> ''")
        .groupBy(*scoped, "_bare")
        .agg(F.min("_name").alias("_name"))
    )
    wanted = cut_lineage(wanted)
    weight = wanted.agg(F.sum(F.length("_bare") + F.length("_name") + 64)).first()[0] or 0
    wanted = wanted.hint("broadcast" if weight <= MOST_SENT else "merge")
    # distinct name lengths: a handful, never more than the longest name has characters
    lengths = sorted(r[0] for r in wanted.select(F.length("_bare")).distinct().collect())
    if not lengths:
        return texts.withColumn("matched_name", F.lit(None).cast("string"))
    squeezed = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", "")
    source = texts.select(*scoped, squeezed.alias("_text")).filter(F.length("_text") >= lengths[0]).distinct()
    parts = F.flatten(
        F.transform(
            F.array(*[F.lit(w) for w in lengths]),
            lambda w: F.when(
                F.length("_text") >= w,
                F.transform(F.sequence(F.lit(1), F.length("_text") - w + 1), lambda i: F.substring(F.col("_text"), i, w)),
            ).otherwise(F.array().cast("array<string>")),
        )
    )
    found = source.select(*keys, F.explode(F.array_distinct(parts)).alias("_bare")).join(wanted, scoped + ["_bare"])
    best = keep_first(found, keys, [-F.length("_bare"), F.col("_name")]).select(*keys, F.col("_name").alias("matched_name"))
    return texts.withColumn("_text", squeezed).join(best.hint("merge"), keys, "left").select(*texts.columns, "matched_name")


def list_changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Added, removed and moved keys between two versions of a table."""
    a = before.select(key, F.col(value).alias("_before"), F.lit(True).alias("_a"))
    b = after.select(key, F.col(value).alias("_after"), F.lit(True).alias("_b"))
    kind = (
        F.when(F.col("_a").isNull(), "added")
        .when(F.col("_b").isNull(), "removed")
        .when(~F.col("_before").eqNullSafe(F.col("_after")), "moved")
    )
    return (
        a.join(b, key, "full")
        .select(F.col(key), kind.alias("change"), F.col("_before").alias("before"), F.col("_after").alias("after"))
        .filter("change is not null")
    )
