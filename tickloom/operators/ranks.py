"""Exact order statistics and sliding windows that never gather a whole key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.timebase import fdiv
from tickloom.operators.ordered import scan, sum_upto


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, index: dict[str, Column], step: float = 0.05) -> DataFrame:
    """Value at a 0-based rank per key. ``index`` maps names to rank expressions over ``n`` rows.

    Equal values are counted first; ranks then come from a chunked running count over values.
    """
    keys = list(keys)
    c = df.groupBy(*keys, value).agg(F.count("*").alias("_m"))
    total = c.groupBy(*keys).agg(F.sum("_m").alias("n"))
    s = scan(c, keys, [value], F.floor(F.col(value) / step), _cum=sum_upto("_m")).join(total, keys)
    return s.groupBy(*keys).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("_cum") > i, F.col(value))).alias(k) for k, i in index.items()])


def halo(df: DataFrame, index: str, chunk: int, before: int, after: int = 0) -> DataFrame:
    """Copy rows near a chunk edge into the neighbour: ``_c`` is the chunk, ``_own`` marks the originals."""
    i, c = F.col(index), fdiv(index, F.lit(chunk))
    copies = F.filter(
        F.array(c, F.when(F.pmod(i, F.lit(chunk)) >= chunk - before, c + 1), F.when(F.pmod(i, F.lit(chunk)) < after, c - 1)), lambda x: x.isNotNull()
    )
    return df.withColumn("_c", F.explode(copies)).withColumn("_own", F.col("_c") == c)
