"""Toxicity by non-negative positive-unlabelled learning over word and word-beginning features."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.sampling import bounded
from tickloom.llm.text import ALNUM, prefix_sums, runs, span_hash
from tickloom.session import cut_lineage

#: Feature space (bits), lengths of word beginnings in bytes, and the bounds of the training sample (rows).
BITS = 20
BEGINNINGS = (3, 4, 5, 6, 8)
POSITIVES = 3000
UNLABELLED = 6000


def features(text: bytes | None, bits: int = BITS) -> np.ndarray:
    """Distinct feature numbers of a whole text: each lower-cased word and its beginnings, hashed."""
    raw = np.frombuffer((text or b"").decode(errors="replace").lower().encode(), np.uint8)
    start, end = runs(ALNUM[raw])
    if not len(start):
        return np.zeros(0, np.int32)
    from tickloom.llm.text import BYTE_CODES

    sums = prefix_sums(BYTE_CODES[raw])
    size = end - start
    found = [span_hash(sums, start, end) ^ np.uint64(0x5851F42D4C957F2D)]
    for n in BEGINNINGS:
        long = start[size >= n]
        found.append(span_hash(sums, long, long + n))
    at = (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int32)
    return np.unique(at) if len(at) < 1 << 14 else np.flatnonzero(np.bincount(at, minlength=1 << bits)).astype(np.int32)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, bits: int = BITS, rounds: int = 200, rate: float = 0.1, decay: float = 1e-3, least: float = 4.2) -> dict:
    """A linear model under the non-negative risk ``prior * R_P+ + max(0, R_U- - prior * R_P-)`` with logistic loss.

    When the bracket turns negative its gradient is followed upwards, so the model cannot fit the unlabelled texts by
    calling all of them negative. Texts are the set of their features; features whose shares among the two kinds of
    texts differ by fewer than ``least`` standard errors are left out. Full-batch Adam, no randomness.
    """
    rows = positive + unlabelled
    if not positive or not unlabelled:
        return {"at": np.zeros(0, np.int64), "w": np.zeros(0, np.float32), "b": float(np.log(prior / (1 - prior)))}
    n, p = len(rows), len(positive)
    count = lambda some: np.bincount(np.concatenate(some), minlength=1 << bits)
    yes, no = count(positive), count(unlabelled)
    share = np.clip((yes + no) / n, 1e-9, 1 - 1e-9)
    apart = np.abs(yes / p - no / (n - p)) / np.sqrt(share * (1 - share) * (1 / p + 1 / (n - p)))
    kept = np.flatnonzero((apart >= least) & (yes + no >= 3))
    new = np.full(1 << bits, -1)
    new[kept] = np.arange(len(kept))
    col = new[np.concatenate(rows)]
    doc = np.repeat(np.arange(n), [len(r) for r in rows])[col >= 0]
    col, m = col[col >= 0], len(kept)
    w, b = np.zeros(m, np.float32), float(np.log(prior / (1 - prior)))
    m1, m2, c1, c2 = np.zeros(m + 1), np.zeros(m + 1), 0.9, 0.99
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, rounds + 1):
        z = np.bincount(doc, weights=w[col], minlength=n) + b
        # d loss(z)/dz for the two targets
        up, down = sigmoid(z) - 1, sigmoid(z)
        gap = np.logaddexp(0, z[p:]).mean() - prior * np.logaddexp(0, z[:p]).mean()
        g = np.empty(n)
        if gap >= 0:
            g[:p] = prior * (up[:p] - down[:p]) / p
            g[p:] = down[p:] / (n - p)
        else:
            g[:p] = prior * down[:p] / p
            g[p:] = -down[p:] / (n - p)
        grad = np.append(np.bincount(col, weights=g[doc], minlength=m) + decay * w, g.sum())
        m1, m2 = c1 * m1 + (1 - c1) * grad, c2 * m2 + (1 - c2) * grad**2
        step = rate * (m1 / (1 - c1**t)) / (np.sqrt(m2 / (1 - c2**t)) + 1e-9)
        w, b = (w - step[:-1]).astype(np.float32), b - float(step[-1])
    return {"at": kept, "w": w, "b": b}


def learn(docs: DataFrame, labels: DataFrame, prior: float | None = None, bits: int = BITS, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> dict:
    """Fits the model from confirmed toxic ids (``labels``: doc_id, toxic) and texts without regard to their label.

    ``labels`` must hold only what may be learnt from. The sample is bounded: about ``positives`` confirmed texts and
    ``unlabelled`` texts of ``docs``. ``prior``, the share of toxic texts among the unlabelled, is estimated from all
    ``labels`` where it is not given. Features are made where the texts are, the fit runs in one task over the bounded
    sample, and only its weights come to the driver.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if prior is None:
        prior = known.agg(F.avg("toxic")).first()[0]
    prior = min(0.9, max(0.005, prior or 0.05))
    yes = bounded(cut_lineage(known.where("toxic = 1").select("doc_id")), F.col("doc_id"), positives)
    text = docs.select("doc_id", "text")
    sample = text.join(F.broadcast(yes), "doc_id", "left_semi").select("text", F.lit(True).alias("p")).union(bounded(text, F.coalesce(F.col("doc_id").cast("string"), "text"), unlabelled, 11).select("text", F.lit(False)))

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"p": x["p"], "f": [features(t, bits).tobytes() for t in x["text"]]})

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted({(bool(p), bytes(f)) for x in batches for p, f in zip(x["p"], x["f"], strict=True)})  # copies count once
        pos, unl = ([np.frombuffer(f, np.int32) for p, f in rows if p is k] for k in (True, False))
        yield pd.DataFrame({"model": [pickle.dumps(fit(pos, unl, prior, bits))]})

    one = sample.select(F.col("text").cast("binary").alias("text"), "p").mapInPandas(featured, "p boolean, f binary").repartition(1).mapInPandas(fitted, "model binary")
    return pickle.loads(one.first()[0]) | {"bits": bits, "prior": prior}


def score(text: Column, model: dict) -> Column:
    """Probability that a whole text is toxic; a text without words gets what the bias alone says."""
    dense = np.zeros(1 << model["bits"], np.float32)
    dense[model["at"]] = model["w"]
    bias, bits = model["b"], model["bits"]

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        z = np.full(len(texts), bias)
        for i, t in enumerate(texts):
            f = features(t, bits)
            if len(f):
                z[i] += dense[f].sum(dtype=np.float64)
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return scored(text.cast("binary"))
