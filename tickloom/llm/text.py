"""Byte-level text helpers shared by the corpus operators; all of them work on one whole text at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = np.uint64
_SEED = 20_240_501
_RNG = np.random.default_rng(_SEED)
BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
BASE = int(_RNG.integers(2**62, 2**63, dtype=np.int64)) * 2 + 1
_UNBASE = pow(BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        n = max(n, 2 * len(_powers[0]), 1 << 16)
        for k, base in enumerate((BASE, _UNBASE)):
            p = np.full(n, U64(base % 2**64), U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits, so that low bits can be used alone."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Sums of a polynomial hash; ``span_hash`` reads the hash of any range from them."""
    up, _ = powers(len(codes) + 1)
    sums = np.empty(len(codes) + 1, U64)
    sums[0] = 0
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end): equal ranges have equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the words ``[^\\x20\\x09-\\x0D]+``."""
    return runs(~SPACE[raw])


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of a text, null counts none; Arrow-batched."""
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([0 if t is None else len(t.split()) for t in texts], dtype="int64")

    return count(text.cast("binary"))


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
