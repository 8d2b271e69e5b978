"""One row per key, and duplicate detection, without sending a hot key to one task.

The greatest ``struct(order, rest)`` combines on the map side: a key that owns
a third of the input leaves each map task as a single row.  A row_number window
would ship and sort every one of its rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order: list[str | Column], extreme) -> DataFrame:
    """Row whose (order, remaining columns) tuple is extreme; ties in ``order`` are thus settled too."""
    named = [c for c in order if isinstance(c, str)]
    rest = [c for c in df.columns if c not in keys and c not in named]
    lead = [F.col(c) if isinstance(c, str) else c.alias(f"_o{i}") for i, c in enumerate(order)]
    picked = df.groupBy(*keys).agg(extreme(F.struct(*lead, *rest)).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def keep_last(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The row with the greatest ``order`` tuple of each key."""
    return _pick(df, keys, order, F.max)


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The row with the smallest ``order`` tuple of each key."""
    return _pick(df, keys, order, F.min)


def key_counts(df: DataFrame, keys: list[str], name: str = "n_rows") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def flag_duplicates(df: DataFrame, keys: list[str], flag: str = "is_duplicate") -> DataFrame:
    """Mark every member of a key that occurs more than once (NULL keys are never duplicates).

    Only the repeated keys are joined back; adaptive skew handling splits the
    row side of that join, so a hot key does not end up in one task.
    """
    present = df
    for key in keys:
        present = present.filter(F.col(key).isNotNull())
    repeated = key_counts(present, keys, "_n").filter("_n > 1").select(*keys, F.lit(True).alias("_dup"))
    joined = df.join(repeated, keys, "left")
    return joined.select(*df.columns, F.coalesce("_dup", F.lit(False)).alias(flag))


def null_where_duplicate(
    df: DataFrame, key: str, nulled: list[str], state_column: str, state: str
) -> DataFrame:
    """Rows whose id is shared lose the listed values and get an explicit state."""
    flagged = flag_duplicates(df, [key], "_shared")
    columns = []
    for c in df.columns:
        value = F.col(c)
        if c in nulled:
            value = F.when(~F.col("_shared"), value)
        elif c == state_column:
            value = F.when(F.col("_shared"), F.lit(state)).otherwise(value)
        columns.append(value.alias(c))
    return flagged.select(*columns)
