"""Language identification by a bidirectional gated recurrent network over bytes.

Written and trained in numpy: back-propagation through time over sampled windows, Adam, and a
softmax at every byte position from the states of both directions.  A document's
probabilities are the mean over all positions of its whole text, read in windows.

The network is fitted on a bounded sample (``TRAIN_DOCS`` documents per language, from rows
that are not held out and have a language and a text); every row is predicted.  Languages are
the values seen in training.  ``und`` with score 0 is the prediction for a text that is null or
has no letter, and for every text if there is nothing to learn from.  Repeated rows get equal
results; ties go to the first language in order.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardscope.llm.common import held_out, per_text, ship_package

HIDDEN = 8
WINDOW = 128
BATCH = 2048
#: Bounds of the training sample: documents per language, characters taken from each at a random place.
TRAIN_DOCS = 600
TRAIN_CHARS = 400
STEPS = 160
SALTS = 64
UNDETERMINED = "und"


# ---- network; arrays are (features, batch), so that every operation runs along memory ----

def new_parameters(n_classes: int, hidden: int = HIDDEN, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p["E" + d] = rng.normal(0, 0.3, (3 * hidden, 256))  # byte inputs and bias of the gates update, reset, new
        p["U" + d] = rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden))
        p["c" + d] = np.zeros((hidden, 1))
        p["W" + d] = rng.normal(0, 0.3, (n_classes, hidden))
    p["o"] = np.zeros((n_classes, 1))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _states(p: dict, d: str, x: np.ndarray, mask: np.ndarray | None, keep: bool = False):
    """States (T, H, B) of one direction; with ``keep`` also what the way back needs.

    A sigmoid is taken as (1 + tanh(v / 2)) / 2, so that one function serves all gates.
    """
    t_max, n = x.shape
    E, U, c = p["E" + d].copy(), p["U" + d].copy(), p["c" + d]
    h_n = U.shape[1]
    E[: 2 * h_n] *= 0.5
    U[: 2 * h_n] *= 0.5
    out = np.empty((t_max, h_n, n), np.float32)
    h = np.zeros((h_n, n), np.float32)
    gates, rec, diff = np.empty((3 * h_n, n), np.float32), np.empty((3 * h_n, n), np.float32), np.empty((h_n, n), np.float32)
    saved = []
    for t in range(t_max) if d == "f" else range(t_max - 1, -1, -1):
        np.take(E, x[t], axis=1, out=gates, mode="clip")
        np.matmul(U, h, out=rec)
        zr, new, rec_n = gates[: 2 * h_n], gates[2 * h_n :], rec[2 * h_n :]
        zr += rec[: 2 * h_n]
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        rec_n += c
        before = h
        if keep:
            saved.append((t, zr[:h_n].copy(), zr[h_n:].copy(), rec_n.copy(), before))
        rec_n *= zr[h_n:]
        new += rec_n
        np.tanh(new, out=new)
        if keep:
            saved[-1] += (new.copy(),)
        np.subtract(before, new, out=diff)
        diff *= zr[:h_n]
        h = out[t]
        np.add(diff, new, out=h)
        if mask is not None:
            h *= mask[t]
    return (out, saved) if keep else out


def _probabilities(p: dict, f: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(T, classes, B) softmax at every position."""
    logits = np.matmul(p["Wf"], f)
    logits += np.matmul(p["Wb"], b)
    logits += p["o"]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def loss_and_gradient(p: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over the positions in ``mask`` (T, B), and its gradient by back-propagation through time."""
    h_n = p["Uf"].shape[1]
    f, sf = _states(p, "f", x, mask, True)
    b, sb = _states(p, "b", x, mask, True)
    q = _probabilities(p, f, b)
    n = mask.sum()
    cols = np.arange(x.shape[1])
    loss = -float((np.log(q[:, y, cols] + 1e-9) * mask).sum() / n)
    dl = q.copy()
    dl[:, y, cols] -= 1
    dl *= mask[:, None, :] / n
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["o"][:, 0] = dl.sum(axis=(0, 2))
    for d, states, saved in (("f", f, sf), ("b", b, sb)):
        g["W" + d] = np.einsum("tcb,thb->ch", dl, states, optimize=True)
        carry = np.zeros_like(states[0])
        by_byte = np.zeros((256, 3 * h_n), np.float32)
        W, U = p["W" + d], p["U" + d]
        for t, z, r, rec_n, before, new in reversed(saved):
            dh = (W.T @ dl[t] + carry) * mask[t]
            dnew = dh * (1 - z) * (1 - new * new)
            da = np.concatenate([dh * (before - new) * z * (1 - z), dnew * rec_n * r * (1 - r), dnew])
            dr = da.copy()
            dr[2 * h_n :] *= r  # the recurrent part of the new state passes the reset gate
            g["U" + d] += dr @ before.T
            g["c" + d][:, 0] += dr[2 * h_n :].sum(axis=1)
            for k in range(3 * h_n):
                by_byte[:, k] += np.bincount(x[t], weights=da[k], minlength=256).astype(np.float32)
            carry = dh * z + U.T @ dr
        g["E" + d] = by_byte.T.copy()
    return loss, g


def _windows(texts: Iterable[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts cut into windows: (bytes (n, size), lengths, index of the text); padding is 0."""
    buffer, lengths, owner = bytearray(), [], []
    for k, data in enumerate(texts):
        n = len(data)
        if not n:
            continue
        buffer += data
        if n % size:
            buffer += bytes(size - n % size)
        w = -(-n // size)
        lengths += [size] * (w - 1) + [n - size * (w - 1)]
        owner += [k] * w
    return np.frombuffer(bytes(buffer), np.uint8).reshape(-1, size), np.array(lengths, np.int64), np.array(owner, np.int64)


def train(texts: list[str], labels: list[str], steps: int = STEPS, seed: int = 7, window: int = 64, batch: int = 256) -> tuple[list[str], dict] | None:
    """(languages, parameters) fitted to the sample; None if it is empty."""
    names = sorted(set(labels))
    cuts, lengths, owner = _windows([t.encode("utf-8", "replace") for t in texts], window)
    if not names or not len(cuts):
        return None
    y_all = np.array([names.index(v) for v in labels])[owner]
    rng = np.random.default_rng(seed)
    p = new_parameters(len(names), seed=seed)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    by_class = [np.flatnonzero(y_all == c) for c in range(len(names))]
    by_class = [c for c in by_class if len(c)]
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.choice(c, -(-batch // len(by_class))) for c in by_class])
        x = np.ascontiguousarray(cuts[rows].T)
        mask = (np.arange(window)[:, None] < lengths[rows]).astype(np.float32)
        _, g = loss_and_gradient(p, x, mask, y_all[rows])
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        rate = 0.03 * (1 - 0.9 * step / steps)
        for k in p:
            a = g[k] * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.99 * v[k] + 0.01 * a * a
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return names, p


def document_probabilities(p: dict, texts: list[bytes], window: int = WINDOW, batch: int = BATCH) -> np.ndarray:
    """(texts, classes): mean of the position probabilities over each whole text; zeros for an empty one."""
    n_classes = p["o"].shape[0]
    total = np.zeros((len(texts), n_classes))
    size = np.array([max(1, len(t)) for t in texts], float)
    group: list[int] = []
    held = 0

    def flush() -> None:
        cuts, lengths, owner = _windows([texts[k] for k in group], window)
        full = lengths == window
        for rows in (np.flatnonzero(full), np.flatnonzero(~full)):
            for at in range(0, len(rows), batch):
                part = rows[at : at + batch]
                x = np.ascontiguousarray(cuts[part].T)
                mask = None if full[part[0]] else (np.arange(window)[:, None] < lengths[part]).astype(np.float32)
                q = _probabilities(p, _states(p, "f", x, mask), _states(p, "b", x, mask))
                sums = q.sum(axis=0) if mask is None else np.einsum("tcb,tb->cb", q, mask)
                np.add.at(total, np.array(group)[owner[part]], sums.T)

    for k, text in enumerate(texts):
        if text:
            group.append(k)
            held += len(text)
        if held >= batch * window:
            flush()
            group, held = [], 0
    if group:
        flush()
    return total / size[:, None]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


# ---- Spark ----

def training_sample(df: DataFrame, per_language: int = TRAIN_DOCS, characters: int = TRAIN_CHARS) -> tuple[list[str], list[str]]:
    """A bounded sample of (text part, language) of the rows that may be learned from."""
    known = df.filter(~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0))
    at = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - characters, F.lit(1))).cast("int") + 1
    part = known.select("lang", "doc_id", F.xxhash64("doc_id").alias("_order"), F.substring(F.col("text"), at, F.lit(characters)).alias("part"))
    # first within salted groups of a language, so that a common one is no single task's work
    salted = part.withColumn("_salt", F.pmod(F.col("_order"), F.lit(SALTS)))
    for keys, most in ((("lang", "_salt"), -(-2 * per_language // SALTS)), (("lang",), per_language)):
        turn = F.row_number().over(Window.partitionBy(*keys).orderBy("_order", "doc_id", "part"))
        salted = salted.withColumn("_n", turn).filter(F.col("_n") <= most)
    rows = salted.orderBy("lang", "_n").collect()
    return [r.part for r in rows], [r.lang for r in rows]


def identify(df: DataFrame, per_language: int = TRAIN_DOCS, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """The kept columns (doc_id by default), lang_pred and score (their names after ``prefix``) for every row of ``df``."""
    spark = df.sparkSession
    ship_package(spark)
    fitted = train(*training_sample(df, per_language))

    def make(texts: list) -> dict[str, list]:
        plain = [has_letter(t) for t in texts]
        if fitted is None:
            return {f"{prefix}lang_pred": [UNDETERMINED] * len(texts), f"{prefix}score": [0.0] * len(texts)}
        names, p = fitted
        q = document_probabilities(p, [t.encode("utf-8", "replace") if ok else b"" for t, ok in zip(texts, plain)])
        best = q.argmax(axis=1)
        return {
            f"{prefix}lang_pred": [names[k] if ok else UNDETERMINED for k, ok in zip(best, plain)],
            f"{prefix}score": [float(min(1.0, q[i, k])) if ok else 0.0 for i, (k, ok) in enumerate(zip(best, plain))],
        }

    return per_text(df, make, f"{prefix}lang_pred string, {prefix}score double", keep=keep)
