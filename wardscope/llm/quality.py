"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed once and written.  Trees are fitted in numpy on a
bounded sample (``TRAIN_ROWS`` labelled rows that are not held out, by a hash of the id):
features are cut into at most 64 bins, and gradients and second derivatives are summed per
node, feature and bin.  All trees have the same depth and are flattened into arrays, so that
a batch of rows walks through all trees at once.

A null text counts as empty; an empty text has statistics (all zero) and so a score.  A document
with several labels takes their mean, rounded half up; null labels do not count.  Without any
usable label the score is 0.5.  Repeated rows get equal scores.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardscope.llm.common import cut_lineage, held_out, per_text, ship_package

TRAIN_ROWS = 20_000
BINS = 64
DEPTH = 4
TREES = 60
RATE = 0.15
FEATURES = (
    "log_bytes", "upper", "lower", "digit", "blank", "newline", "exclamation", "question", "stop", "comma", "bar", "other_sign",
    "beyond_ascii", "entropy", "log_words", "word_mean", "word_std", "word_max", "distinct_words", "top_word", "short_words",
    "distinct_pairs", "log_lines", "repeated_lines", "line_mean", "short_lines", "closed_lines", "capital_words",
)
_SIGNS = np.array([33 <= b < 127 and not chr(b).isalnum() and chr(b) not in "!?.,|" for b in range(256)])


def statistics(text: str | None) -> list[float]:
    """The features of one whole text, in the order of ``FEATURES``."""
    data = (text or "").encode("utf-8", "replace")
    n = len(data)
    if not n:
        return [0.0] * len(FEATURES)
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = c / n
    some = share[share > 0]
    words = data.lower().split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    w, k = max(1, len(words)), max(1, len(lines))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    kinds = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    closed = sum(line.rstrip()[-1:] in b".!?" for line in lines)
    return [
        np.log1p(n), share[65:91].sum(), share[97:123].sum(), share[48:58].sum(), share[32], share[10], share[33], share[63], share[46], share[44], share[124],
        share[_SIGNS].sum(), share[128:].sum(), -(some * np.log2(some)).sum(), np.log1p(len(words)), sizes.mean(), sizes.std(), sizes.max(),
        len(kinds) / w, max(kinds.values(), default=0) / w, (sizes <= 3).mean(), pairs / max(1, len(words) - 1), np.log1p(len(lines)),
        1 - len(set(lines)) / k, n / k, sum(len(line) < 30 for line in lines) / k, closed / k, sum(map(bytes.isupper, data.split())) / w,
    ]


# ---- trees ----

class Forest:
    """Trees of equal depth as arrays: inner nodes in level order, then leaves."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, base: float):
        self.feature, self.threshold, self.leaf, self.base = feature, threshold, leaf, base

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row; all trees step down one level at a time."""
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(x), self.base)
        depth = int(np.log2(inner + 1))
        rows, column = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        at = np.zeros((len(x), trees), np.int64)
        for _ in range(depth):
            right = x[rows, self.feature[column, at]] > self.threshold[column, at]
            at = 2 * at + 1 + right
        return self.base + self.leaf[column, at - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, smooth: float = 1.0, least: int = 5) -> Forest:
    """Boosted trees for 0/1 labels by histograms of logistic gradients."""
    n, m = x.shape
    rate_one = (y.sum() + 1) / (n + 2)
    base = float(np.log(rate_one / (1 - rate_one)))
    inner = 2**depth - 1
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)] if n else [np.zeros(0)] * m
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(m)], axis=1) if n else np.zeros((0, m), np.int64)
    features, thresholds, leaves = [], [], []
    margin = np.full(n, base)
    place = binned + np.arange(m) * bins
    for _ in range(trees if n and 0 < y.sum() < n else 0):
        q = 1 / (1 + np.exp(-margin))
        grad, hess = q - y, np.maximum(q * (1 - q), 1e-6)
        feature, threshold, cut = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins, np.int64)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            where = ((node - first)[:, None] * (m * bins) + place).ravel()
            size = width * m * bins
            g = np.bincount(where, np.repeat(grad, m), size).reshape(width, m, bins).cumsum(axis=2)
            h = np.bincount(where, np.repeat(hess, m), size).reshape(width, m, bins).cumsum(axis=2)
            k = np.bincount(where, minlength=size).reshape(width, m, bins).cumsum(axis=2)
            gt, ht, kt = g[:, :, -1:], h[:, :, -1:], k[:, :, -1:]
            gain = g**2 / (h + smooth) + (gt - g) ** 2 / (ht - h + smooth) - gt**2 / (ht + smooth)
            gain[(k < least) | (kt - k < least)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            for j in range(width):
                f, b = divmod(int(best[j]), bins)
                if gain[j, f, b] > 1e-9 and b < len(cuts[f]):
                    feature[first + j], threshold[first + j], cut[first + j] = f, cuts[f][b], b
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > cut[node])
        leaf_at = node - inner
        leaf = -rate * np.bincount(leaf_at, grad, inner + 1) / (np.bincount(leaf_at, hess, inner + 1) + smooth)
        margin += leaf[leaf_at]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    if not features:
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base if n else 0.0)
    return Forest(np.stack(features), np.stack(thresholds), np.stack(leaves), base)


# ---- Spark ----

def document_statistics(df: DataFrame) -> DataFrame:
    """doc_id and the statistics of every whole text."""
    ship_package(df.sparkSession)
    return per_text(df, lambda texts: {"x": [statistics(t) for t in texts]}, "x array<double>")


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Forest:
    """Trees from at most ``rows`` labelled documents that are not held out."""
    marks = labels.filter(F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.round(F.avg(label)).alias("y"))
    one = stats.join(marks, "doc_id").select("y", "x", "doc_id")
    got = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    x = np.array([r.x for r in got], float).reshape(-1, len(FEATURES))
    return fit_forest(x, np.array([r.y for r in got], float))


def score(stats: DataFrame, forest: Forest) -> DataFrame:
    """doc_id and score (0 to 1) for every row of statistics."""
    ship_package(stats.sparkSession)

    def run(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            s = forest.score(flat.reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    kind = dict(stats.dtypes)["doc_id"]
    return stats.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double")


def classify(df: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id and score for every document, from labels that are not held out."""
    stats = cut_lineage(document_statistics(df))
    return score(stats, fit(stats, labels, rows=rows))
