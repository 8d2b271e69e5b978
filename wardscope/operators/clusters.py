"""K-means on standardised components with k chosen by Euclidean silhouette.

All starts of all k run together: one pass over the rows assigns each row under every run and sums
up the new centres of all runs, so the number of passes is that of the slowest run and not the sum
over runs.  Only centres travel to and from the driver; their number is set by the parameters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardscope.functions import fixed_values as V
from wardscope.session import cut_lineage

BLOCK = 512
#: First centres are drawn from at most so many rows (all rows take part in every pass).
SEED_ROWS = 10_000
#: Rows measured against all centres at a time.
ROWS_AT_ONCE = 2048


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns ``z_*`` with zero mean and unit population deviation (a constant column stays 0)."""
    row = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    out = df
    for c in columns:
        scale = row[f"s_{c}"] or 1.0
        out = out.withColumn(f"z_{c}", (F.col(c) - F.lit(row[f"m_{c}"])) / F.lit(scale))
    return out


def silhouette_per_row(df: DataFrame, columns: list[str], label: str, scope: str | None = None) -> DataFrame:
    """Euclidean silhouette of every row, however many there are; with ``scope`` among the rows of one scope.

    The measure compares each row with all rows.  Rows of a cluster are packed
    into blocks of about ``BLOCK``, each row meets each block once, and its sums
    per cluster are added up; nothing is collected or broadcast.
    """
    rows = cut_lineage(df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_scope", F.col(scope) if scope else F.lit(0)))
    n_blocks = max(1, -(-rows.count() // BLOCK))
    point = F.array(*[F.col(c).cast("double") for c in columns])
    block = F.pmod(F.xxhash64("_id"), F.lit(n_blocks)).cast("int")
    packed = rows.select("_scope", block.alias("_block"), F.col(label).alias("_other"), point.alias("_p"))
    packed = packed.groupBy("_scope", "_block", "_other").agg(F.collect_list("_p").alias("_points"))
    each = rows.select("_scope", "_id", F.col(label).alias("_own"), point.alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("_block"))

    def gap(p):
        squares = F.zip_with(F.col("_x"), p, lambda u, v: (u - v) * (u - v))
        return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda t, v: t + v))

    total = F.aggregate(F.transform("_points", gap), F.lit(0.0), lambda t, v: t + v)
    sums = each.join(packed, ["_scope", "_block"]).groupBy("_id", "_own", "_other").agg(F.sum(total).alias("_t"), F.sum(F.size("_points")).alias("_n"))
    same = F.col("_other") == F.col("_own")
    measured = sums.groupBy("_id").agg(
        F.max(F.when(same, F.col("_t") / F.greatest(F.col("_n") - 1, F.lit(1)))).alias("_in"),
        F.max(F.when(same, F.col("_n"))).alias("_size"),
        F.min(F.when(~same, F.col("_t") / F.col("_n"))).alias("_out"),
    )
    larger = F.greatest("_in", "_out")
    value = F.when((F.col("_size") > 1) & (larger > 0), (F.col("_out") - F.col("_in")) / larger).otherwise(0.0)
    return rows.join(measured, "_id").select(*df.columns, value.alias("silhouette"))


def silhouette(df: DataFrame, columns: list[str], label: str) -> float:
    return silhouette_per_row(df, columns, label).agg(F.avg("silhouette")).first()[0]


def _first_centres(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Each next centre is a row drawn in proportion to its squared distance from the centres so far."""
    chosen = [points[rng.integers(len(points))]]
    gap = ((points - chosen[0]) ** 2).sum(1)
    while len(chosen) < k:
        total = gap.sum()
        chosen.append(points[rng.choice(len(points), p=gap / total)] if total > 0 else points[rng.integers(len(points))])
        gap = np.minimum(gap, ((points - chosen[-1]) ** 2).sum(1))
    return np.array(chosen)


def _pass(rows: DataFrame, columns: list[str], runs: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Rows, coordinate sums and summed squared distances per cluster of every run, from one pass."""
    at_once, width = ROWS_AT_ONCE, len(columns)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {r: np.zeros((len(c), width + 2)) for r, c in runs.items()}
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            for part in (x[k:k + at_once] for k in range(0, len(x), at_once)):
                for run, centres in runs.items():
                    gaps = ((part[:, None, :] - centres[None]) ** 2).sum(2)
                    own = gaps.argmin(1)
                    facts = np.column_stack([np.ones(len(part)), gaps[np.arange(len(part)), own], part])
                    for column in range(width + 2):
                        totals[run][:, column] += np.bincount(own, facts[:, column], len(centres))
        flat = [(run, k, *row) for run, total in totals.items() for k, row in enumerate(total.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*flat)], names=names)

    names = ["run", "k", "n", "cost", *[f"s{j}" for j in range(width)]]
    schema = "run long, k long, n double, cost double, " + ", ".join(f"s{j} double" for j in range(width))
    added = rows.select(*columns).mapInArrow(sums, schema).groupBy("run", "k").agg(*[F.sum(c).alias(c) for c in names[2:]])
    found = {run: (np.zeros(len(c)), np.zeros_like(c), np.zeros(len(c))) for run, c in runs.items()}
    for r in added.collect():  # one row per centre
        found[r.run][0][r.k], found[r.run][2][r.k] = r.n, r.cost
        found[r.run][1][r.k] = [r[f"s{j}"] for j in range(width)]
    return {run: (n, s, float(cost.sum())) for run, (n, s, cost) in found.items()}


def fit_many(rows: DataFrame, columns: list[str], ks: list[int], seed: int = 42, restarts: int = 20, passes: int = 300) -> dict[int, tuple[np.ndarray, float]]:
    """Centres and cost of the best of ``restarts`` starts for every k, all run together until no centre moves."""
    drawn = rows.select(*columns).orderBy(F.xxhash64(*columns), *columns).limit(SEED_ROWS).collect()
    points = np.array([list(r) for r in drawn], float)
    keys = [(k, turn) for k in ks for turn in range(restarts)]
    runs = {run: _first_centres(points, k, np.random.default_rng(seed + 1000 * k + turn)) for run, (k, turn) in enumerate(keys)}
    settled: dict[int, float] = {}
    for turn in range(passes):
        moving = {run: c for run, c in runs.items() if run not in settled}
        for run, (n, total, cost) in _pass(rows, columns, moving).items():
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], runs[run])  # an empty cluster stays where it is
            if np.abs(new - runs[run]).max() <= 1e-9 or turn == passes - 1:
                settled[run] = cost
            runs[run] = new
        if len(settled) == len(runs):
            break
    best = {}
    for run, (k, _) in enumerate(keys):
        if k not in best or settled[run] < best[k][1]:
            best[k] = runs[run], settled[run]
    return best


def with_clusters(rows: DataFrame, columns: list[str], fitted: dict[int, tuple[np.ndarray, float]]) -> DataFrame:
    """The rows with ``clusters``, their cluster under every k in rising order of k."""
    centres = [fitted[k][0] for k in sorted(fitted)]

    def nearest(centre: np.ndarray):
        gaps = [sum(((F.col(c) - F.lit(float(v))) ** 2 for c, v in zip(columns, row)), F.lit(0.0)) for row in centre]
        return F.array_position(F.array(*gaps), F.array_min(F.array(*gaps))) - 1

    return rows.withColumn("clusters", F.array(*[nearest(c).cast("int") for c in centres]))


def choose_clusters(
    risk: DataFrame, columns: list[str], max_k: int = 8, seed: int = 42, restarts: int = 20
) -> tuple[DataFrame, DataFrame]:
    """(k evaluation, labelled rows); both empty but typed when there is too little data."""
    spark = risk.sparkSession
    no_eval = spark.createDataFrame([], "k int, silhouette double")
    data = risk.dropna(subset=columns)
    empty = data.limit(0).withColumn("cluster", F.lit(0))
    n = data.count()
    if n < 3:
        return no_eval, empty
    z = [f"z_{c}" for c in columns]
    scaled = cut_lineage(standardise(data, columns))
    top = min(max_k, n - 1, scaled.select(*z).distinct().count())
    if top < 2:
        return no_eval, empty
    ks = list(range(2, top + 1))
    few = scaled.coalesce(max(1, n // 10_000))  # few rows need few tasks
    labelled = cut_lineage(with_clusters(scaled, z, fit_many(few, z, ks, seed, restarts)))
    each = labelled.select(*z, F.posexplode("clusters").alias("_at", "cluster"))
    used = each.groupBy("_at").agg(F.countDistinct("cluster").alias("n"))
    value = silhouette_per_row(each, z, "cluster", "_at").groupBy("_at").agg(F.avg("silhouette").alias("silhouette"))
    found = [(ks[r["_at"]], r.silhouette) for r in value.join(used, "_at").filter("n > 1").orderBy("_at").collect()]  # one row per k
    if not found:
        return no_eval, empty
    evaluation = spark.createDataFrame(found, "k int, silhouette double")
    best = max(found, key=lambda item: (item[1], -item[0]))[0]
    return evaluation, labelled.withColumn("cluster", F.col("clusters")[ks.index(best)]).drop("clusters", *z)


def cluster_profile(labelled: DataFrame, columns: list[str], label: str = "cluster") -> DataFrame:
    return labelled.groupBy(label).agg(*[F.avg(c).alias(c) for c in columns], F.count(F.lit(1)).alias("n_regions"))


def cluster_labels(profile: DataFrame, label: str = "cluster") -> DataFrame:
    """The cluster with the highest mean risk is the vulnerable one, all others moderate."""
    top = profile.agg(F.max_by(F.col(label), F.struct(F.col("risk"), F.col(label).cast("string"))).alias("_top")).first()["_top"]
    name = F.when(F.col(label) == F.lit(top), V.CLUSTER_VULNERABLE).otherwise(V.CLUSTER_MODERATE)
    return profile.withColumn("cluster_label", name)


def profile_by_component(profile: DataFrame, columns: list[str], clusters: list, label: str = "cluster") -> DataFrame:
    """Component rows by cluster columns ``c<id>``."""
    rows = F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("v")) for c in columns])
    long = profile.select(F.col(label), F.inline(rows))
    wide = long.groupBy("component").pivot(label, clusters).agg(F.first("v"))
    return wide.select("component", *[F.col(f"`{c}`").alias(f"c{c}") for c in clusters])


def mean_difference(profile: DataFrame, columns: list[str], first, second, label: str = "cluster") -> DataFrame:
    """Difference of component means between two clusters."""
    wide = profile_by_component(profile, columns, [first, second], label)
    return wide.select("component", (F.col(f"`c{first}`") - F.col(f"`c{second}`")).alias("difference"))
