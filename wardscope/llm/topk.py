"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Components are integers, floor(256 x).  The vectors of a block are held as posting segments: all
components whose size falls into one quantised impact level, whatever their dimension.  For a
block of queries the segments are processed from the highest impact down, and each query keeps
a score and a slack for every vector: what quantisation and the segments still to come can
change at most.  A query leaves the index only on proof - fewer than a few vectors can still be
among its k best, or all segments are done - and the possible members are scored exactly in
integers.

Every pair of a vector block and a query block is one group of bounded size.  Vectors with equal
components tie, so only the ``k + 1`` smallest ids of each are kept (one may be the query's own),
each at most ``k`` times; Spark counts and limits them before it shuffles.

Rows with a null id, a null vector, or a null or non-finite component take no part; empty vectors
score 0 among themselves, and vectors are compared with those of as many components.  Rows that
repeat an id are queries of their own and take a place each in the results of other ids; no row
with the query's id is a candidate for it.  No usable row gives no result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardscope.llm.common import cut_lineage, ship_package

K = 5
EVERY = 50
LEVELS = 32
#: Lowest level of each pass over the segments, in descending impact.
PASSES = (16, 8, 4, 2, 0)
VECTOR_BLOCK = 8192
QUERY_BLOCK = 2048
#: A query may stop early once so few vectors can still be members.
FEW = 64


class ImpactIndex:
    """Posting segments of one block of integer vectors (n, d) by quantised impact."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        size = np.abs(values.astype(np.float64))
        self.width = max(1.0, math.ceil((size.max(initial=0) + 1) / LEVELS))
        level = np.floor(size / self.width)
        # a posting counts with the middle of its level
        impact = np.sign(values) * (level * self.width + (self.width - 1) / 2)
        self.passes = []
        above = LEVELS + 1
        for low in PASSES:
            here = (level >= low) & (level < above)
            self.passes.append((low, np.where(here, impact, 0.0), level >= low))
            above = low

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and exact scores of its k best; ``own`` ids are left out."""
        n = len(self.ids)
        found: list = [None] * len(queries)
        active = np.arange(len(queries))
        q = queries.astype(np.float64)
        score = np.zeros((len(queries), n))
        for step, (low, impact, done) in enumerate(self.passes):
            score += q @ impact.T
            size = np.abs(q)
            if low:
                slack = size @ np.where(done, (self.width - 1) / 2, low * self.width).T
            else:
                slack = np.broadcast_to(size.sum(axis=1, keepdims=True) * self.width / 2, score.shape)
            slack = slack * (1 + 1e-9) + np.abs(score) * 1e-12
            least = score - slack
            least[self.ids[None, :] == own[active][:, None]] = -np.inf
            bar = np.partition(least, n - k, axis=1)[:, n - k] if n > k else np.full(len(active), -np.inf)
            possible = (score + slack >= bar[:, None]) & (self.ids[None, :] != own[active][:, None])
            last = step == len(self.passes) - 1
            stop = np.full(len(active), True) if last else possible.sum(axis=1) <= FEW
            for at in np.flatnonzero(stop):
                rows = np.flatnonzero(possible[at])
                exact = self.values[rows] @ queries[active[at]]
                order = np.lexsort((self.ids[rows], -exact))[:k]
                found[active[at]] = (self.ids[rows][order], exact[order])
            keep = ~stop
            active, q, score = active[keep], q[keep], score[keep]
            if not len(active):
                break
        return found


def top_k(df: DataFrame, k: int = K, every: int = EVERY, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: queries are rows whose id is divisible by ``every``, against all rows."""
    ship_package(df.sparkSession)
    part = F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    usable = F.col(id_column).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")))
    rows = df.filter(usable).select(F.col(id_column).cast("long").alias("vec_id"), part.alias("v"))
    # rows of one id are told apart by a number that is written once
    queries = cut_lineage(rows.filter(F.col("vec_id") % every == 0).withColumn("q", F.monotonically_increasing_id()))
    order = Window.partitionBy("v").orderBy("vec_id")
    counted = rows.groupBy("v", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))
    few = counted.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1)
    vectors = cut_lineage(few.select(F.explode(F.array_repeat("vec_id", F.col("n"))).alias("vec_id"), "v"))
    n_v, n_q = (max(1, math.ceil(t.count() / b)) for t, b in ((vectors, vector_block), (queries, query_block)))
    # each block meets each block of the other side once
    left = vectors.select(F.size("v").alias("d"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_v)).alias("vb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))).alias("qb"), "vec_id", "v")
    right = queries.select(F.size("v").alias("d"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_v - 1).cast("long"))).alias("vb"), F.pmod(F.xxhash64("q"), F.lit(n_q)).alias("qb"), "vec_id", "v", "q")

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"q": [], "query_id": [], "vec_id": [], "score": []}
        if len(a) and len(b):
            width = int(a["d"].iloc[0])
            matrix = [np.array(t["v"].tolist(), np.int64).reshape(len(t), width) for t in (a, b)]
            index = ImpactIndex(a["vec_id"].to_numpy(np.int64), matrix[0])
            own, numbers = b["vec_id"].to_numpy(np.int64), b["q"].to_numpy(np.int64)
            for at in range(0, len(own), 256):
                for q, query_id, (ids, scores) in zip(numbers[at : at + 256], own[at : at + 256], index.search(matrix[1][at : at + 256], own[at : at + 256], k)):
                    out["q"] += [q] * len(ids)
                    out["query_id"] += [query_id] * len(ids)
                    out["vec_id"] += ids.tolist()
                    out["score"] += scores.tolist()
        return pd.DataFrame(out).astype("int64")

    keys = ["d", "vb", "qb"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "q long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = f"""
WITH rows AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CASE WHEN len(q.v) = len(c.v) THEN list_dot_product(q.v, c.v)::BIGINT END AS score
  FROM rows q JOIN rows c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= {K}"""
