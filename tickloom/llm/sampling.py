"""Bounded, repeatable samples for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 1 << 40


def bounded(df: DataFrame, key: Column, most: int, seed: int = 7) -> DataFrame:
    """About ``most`` rows of a table (all, if it has no more), chosen by a hash of ``key``: reruns take the same rows.

    The number of rows taken never depends on how the table is partitioned; ``most`` bounds its mean.
    """
    n = df.count()
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(STEPS)) < int(STEPS * most / n))
