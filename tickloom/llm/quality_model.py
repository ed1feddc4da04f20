"""Text quality by naive Bayes support vectors: log-count ratios scale n-gram indicators of a linear hinge-loss model."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.sampling import bounded
from tickloom.llm.text import BYTE_CODES, prefix_sums, span_hash, word_spans

BITS = 18
#: Bound of the sample that the linear model is fitted on (rows); the log-count ratios come from all learnable rows.
SAMPLE = 6000
#: Largest label table that is sent around.
SENT = 2_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 4
_CLASS[128:] = 1
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 8


def features(text: bytes | None, bits: int = BITS) -> np.ndarray:
    """Distinct n-gram numbers of a whole text: bytes (1 to 3) and word shapes (1 to 3).

    A word's shape says which kinds of characters it has and whether it equals the word before it.
    """
    text = text or b""
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int32)
    seen = np.zeros(1 << bits, bool)

    def add(code: np.ndarray, salt: int) -> None:
        seen[((code.astype(np.uint64) + np.uint64(salt << 40)) * _ODD >> np.uint64(64 - bits)).astype(np.int64)] = True

    b = raw.astype(np.uint32)
    add(b, 1)
    add(b[:-1] << 8 | b[1:], 2)
    add(b[:-2] << 16 | b[1:-1] << 8 | b[2:], 3)
    start, stop = word_spans(raw)
    if len(start):
        codes = span_hash(prefix_sums(BYTE_CODES[raw]), start, stop)
        kinds = np.bitwise_or.reduceat(np.append(_CLASS[raw], 0), np.stack([start, stop], axis=1).ravel())[::2]
        shape = kinds + 16 * np.concatenate(([False], codes[1:] == codes[:-1]))
        add(shape, 4)
        add(shape[:-1] * 32 + shape[1:], 5)
        add(shape[:-2] * 1024 + shape[1:-1] * 32 + shape[2:], 6)
    return np.flatnonzero(seen).astype(np.int32)


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, rounds: int = 30, seed: int = 5) -> np.ndarray:
    """Weights (the last one the bias) of a linear hinge-loss model over scaled indicators, by dual coordinate descent.

    Each row is the unit vector of its features' log-count ratios. One multiplier per row is moved to its optimum in
    ``[0, cost]`` in a seeded order, the weights follow; it ends when no multiplier moves.
    """
    w = np.zeros(len(ratio) + 1)
    x = [ratio[r] / max(1e-9, float(np.sqrt((ratio[r] ** 2).sum()))) for r in rows]
    a, rng = np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (float(w[rows[i]] @ x[i]) + w[-1]) - 1
            new = min(max(a[i] - g / 2, 0.0), cost[i])  # unit row plus unit bias: curvature 2
            if step := (new - a[i]) * y[i]:
                w[rows[i]] += step * x[i]
                w[-1] += step
                moved = max(moved, abs(step))
                a[i] = new
        if moved < 1e-4:
            break
    return w


def platt(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve from decision values to label 1, by Newton steps."""
    n1, n0 = int((y > 0).sum()), int((y <= 0).sum())
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, s = np.array([((p - t) * z).sum(), (p - t).sum()]), p * (1 - p)
        h = np.array([[(s * z * z).sum(), (s * z).sum()], [(s * z).sum(), s.sum()]]) + 1e-3 * np.eye(2)
        d = np.linalg.solve(h, g)
        a, b = a - float(d[0]), b - float(d[1])
        if np.abs(d).max() < 1e-6:
            break
    return a, b


def fit(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: float = 1.0) -> dict:
    """Model from bounded rows with labels 0 and 1; every fifth row is held back to calibrate the score."""
    y = np.where(y > 0, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        return {"w": np.zeros(len(ratio) + 1, np.float32), "a": 0.0, "b": 2.0 if len(y) and y[0] > 0 else -2.0}
    back = np.arange(len(rows)) % 5 == 4
    n1, n0 = max(1, int((y > 0).sum())), max(1, int((y < 0).sum()))
    cost = np.where(y > 0, c * len(y) / (2 * n1), c * len(y) / (2 * n0))
    some = [r for r, h in zip(rows, back, strict=True) if not h]
    w = dual_descent(some, y[~back], ratio, cost[~back])
    z = decide(rows, w, ratio)
    a, b = platt(z[back], y[back]) if len(set(y[back].tolist())) == 2 else platt(z, y)
    return {"w": w.astype(np.float32), "a": a, "b": b}


def decide(rows: list[np.ndarray], w: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    return np.array([float(w[r] @ ratio[r]) / max(1e-9, float(np.sqrt((ratio[r] ** 2).sum()))) + float(w[-1]) for r in rows])


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", bits: int = BITS, sample: int = SAMPLE) -> dict:
    """Fits the model on the labelled texts (``labels``: doc_id and ``label``, only what may be learnt from).

    The class log-count ratios are counted over all of them; the support vectors are fitted in one task over about
    ``sample`` of them. Only ratios and weights (one number per feature of the fixed space) come to the driver.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    known = F.broadcast(known) if known.count() <= SENT else known
    text = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(known, "doc_id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((2, 1 << bits), np.int64)
        rows = np.zeros(2, np.int64)
        for b in batches:
            for t, y in zip(b["text"], b["y"], strict=True):
                n[int(y > 0), features(t, bits)] += 1
                rows[int(y > 0)] += 1
        at = np.flatnonzero(n.any(axis=0))
        yield pd.DataFrame({"f": np.append(at, -1), "no": np.append(n[0, at], rows[0]), "yes": np.append(n[1, at], rows[1])})

    counts = text.select("text", "y").mapInPandas(count, "f int, no long, yes long").groupBy("f").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")).toPandas()  # at most 2**bits rows
    no, yes = np.zeros(1 << bits), np.zeros(1 << bits)
    at = counts["f"].to_numpy() >= 0
    no[counts["f"][at]], yes[counts["f"][at]] = counts["no"][at], counts["yes"][at]
    # features that no text has get no weight
    ratio = np.where(no + yes > 0, np.log((yes + 1) / (yes + 1).sum()) - np.log((no + 1) / (no + 1).sum()), 0).astype(np.float32)
    ratio = np.where(no + yes > 0, ratio - np.median(ratio[no + yes > 0]) if (no + yes).any() else 0, 0).astype(np.float32)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": (b["y"] > 0).astype("int32"), "f": [features(t, bits).tobytes() for t in b["text"]]})

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted({(bytes(f), int(y)) for b in batches for y, f in zip(b["y"], b["f"], strict=True)})
        rng = np.random.default_rng(3)
        rows = [rows[i] for i in rng.permutation(len(rows))]
        m = fit([np.frombuffer(f, np.int32) for f, _ in rows], np.array([y for _, y in rows]), ratio)
        yield pd.DataFrame({"model": [pickle.dumps(m)]})

    some = bounded(text, F.col("doc_id"), sample)
    model = some.select("text", "y").mapInPandas(featured, "y int, f binary").repartition(1).mapInPandas(fitted, "model binary").first()
    m = pickle.loads(model[0]) if model else fit([], np.zeros(0), ratio)
    return m | {"ratio": ratio, "bits": bits}


def score(text: Column, model: dict) -> Column:
    """Probability of label 1 for a whole text; a text without bytes gets what the bias says."""
    w, ratio, a, b, bits = model["w"], model["ratio"], model["a"], model["b"], model["bits"]

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        z = np.array([decide([features(t, bits)], w, ratio)[0] for t in texts])
        return pd.Series(1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))), dtype="float64")

    return scored(text.cast("binary"))
