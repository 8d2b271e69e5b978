"""Global one-to-one assignment: most pairs first, then the highest total score.

The eligible edges are settled in four steps.  Interchangeable targets are cut
to as many as can matter.  Uncontested best choices are taken directly (nobody
else can use them, so this never costs optimality).  What is left is split into
connected components (in a number of steps that grows with the logarithm of the longest
chain), and each component is solved on its own with a sparse shortest-augmenting-path method
whose memory is linear in its edges.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardscope.operators.components import components
from wardscope.operators.dedupe import keep_first
from wardscope.session import cut_lineage

PAIR_SCHEMA = T.StructType(
    [
        T.StructField("entity_id", T.StringType()),
        T.StructField("catalog_id", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def solve_component(edges: list[tuple[str, str, float]]) -> list[tuple[str, str, float]]:
    """Exact assignment of one component given as (target, candidate, score) edges."""
    targets = sorted({t for t, _, _ in edges})
    columns = {c: j for j, c in enumerate(sorted({c for _, c, _ in edges}))}
    row_of = {t: i for i, t in enumerate(targets)}
    bonus = len(targets) + 1.0
    choices: list[list[tuple[int, float]]] = [[] for _ in targets]
    for t, c, s in edges:
        choices[row_of[t]].append((columns[c], -(bonus + s)))
    for i in range(len(targets)):
        choices[i].append((len(columns) + i, 0.0))  # staying unmatched
    price: dict[int, float] = {}
    gain = [0.0] * len(targets)
    owner: dict[int, int] = {}
    chosen = [-1] * len(targets)
    for start in range(len(targets)):
        distance: dict[int, float] = {}
        reached_from: dict[int, int] = {}
        settled: dict[int, float] = {}
        queue: list[tuple[float, int]] = []
        row, base = start, 0.0
        while True:
            for column, cost in choices[row]:
                if column in settled:
                    continue
                d = base + cost - gain[row] - price.get(column, 0.0)
                if d < distance.get(column, float("inf")):
                    distance[column] = d
                    reached_from[column] = row
                    heapq.heappush(queue, (d, column))
            while True:
                d, column = heapq.heappop(queue)
                if column not in settled and d == distance[column]:
                    break
            settled[column] = d
            if column not in owner:
                break
            row, base = owner[column], d
        gain[start] += d
        for seen, at in settled.items():
            if seen in owner:
                gain[owner[seen]] += d - at
                price[seen] = price.get(seen, 0.0) - (d - at)
        while True:
            row = reached_from[column]
            previous = chosen[row]
            owner[column], chosen[row] = row, column
            if row == start:
                break
            column = previous
    names = {j: c for c, j in columns.items()}
    scores = {(t, c): s for t, c, s in edges}
    return [(t, names[chosen[i]], scores[t, names[chosen[i]]]) for t, i in row_of.items() if chosen[i] in names]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Solves the components of edges that come sorted by component; one component is held at a time."""
    name, edges = None, []

    def table(rows: list[tuple[str, str, float]]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64()))], names=PAIR_SCHEMA.names)

    for batch in batches:
        solved = []
        for component, *edge in zip(*(c.to_pylist() for c in batch.columns)):
            if component != name:
                solved += solve_component(edges)
                name, edges = component, []
            edges.append(tuple(edge))
        yield table(solved)
    yield table(solve_component(edges))


def labelled(edges: DataFrame) -> DataFrame:
    """The edges with ``component``, the smallest target of their connected component."""
    # targets sort before candidates, so the root of a component is a target
    target, candidate = F.concat(F.lit("t"), F.col("entity_id")), F.concat(F.lit("u"), F.col("catalog_id"))
    roots = components(edges.select(target.alias("a"), candidate.alias("b")))
    named = edges.withColumn("_node", target).join(roots, F.col("_node") == roots.node, "left")
    return named.select(*edges.columns, F.substr(F.coalesce("root", "_node"), F.lit(2)).alias("component"))


def interchangeable_cut(pairs: DataFrame) -> DataFrame:
    """Drop targets that cannot change the optimum, however many copies there are.

    Targets with the very same candidates and scores are interchangeable: of
    such a group at most as many as it has candidates can be matched, so that
    many (smallest ids) stay.  Of the targets with a single candidate only the
    best per candidate can win it.  Both cuts are exact and combine map-side,
    which dissolves a candidate wanted by a third of all targets.
    """
    # a target has as many candidates as its ranking keeps, so the list per target is bounded
    shape = pairs.groupBy("entity_id").agg(
        F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("catalog_id", "score")))), 256).alias("_s"), F.count(F.lit(1)).alias("_d")
    )
    turn = F.row_number().over(Window.partitionBy("_s").orderBy("entity_id"))
    kept = shape.withColumn("_r", turn).filter("_r <= _d").select("entity_id", "_d")
    rows = pairs.join(kept, "entity_id")
    single = keep_first(rows.filter("_d = 1"), ["catalog_id"], [-F.col("score"), F.col("entity_id")])
    return rows.filter("_d > 1").unionByName(single.select(*rows.columns)).drop("_d")


def _uncontested(pairs: DataFrame) -> DataFrame:
    """Targets whose best candidate no other target can use."""
    best = keep_first(pairs, ["entity_id"], [-F.col("score"), F.col("catalog_id")])
    once = pairs.groupBy("catalog_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select("catalog_id")
    return best.join(once, "catalog_id", "left_semi").select("entity_id", "catalog_id", "score")


def assign(edges: DataFrame) -> DataFrame:
    """(entity_id, catalog_id, score) pairs of the optimal one-to-one assignment."""
    pairs = edges.select(
        F.col("entity_id").cast("string").alias("entity_id"), F.col("catalog_id").cast("string").alias("catalog_id"), F.col("score").cast("double").alias("score")
    )
    pairs = cut_lineage(interchangeable_cut(cut_lineage(pairs)))
    direct = cut_lineage(_uncontested(pairs))
    rest = pairs.join(direct.select("entity_id"), "entity_id", "left_anti")
    if rest.isEmpty():
        return direct
    # components are many and mostly small: a task walks through its own in order instead of taking a frame for each
    rows = labelled(rest).select("component", *PAIR_SCHEMA.names).repartition("component").sortWithinPartitions("component")
    return direct.unionByName(rows.mapInArrow(_solve, PAIR_SCHEMA))
