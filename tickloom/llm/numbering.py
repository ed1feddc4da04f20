"""Consecutive numbers for the rows of a table in a given order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Equal rows are dealt to up to so many parts.
SPREAD = 1024


def numbered(df: DataFrame, order: list[str], name: str, path: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in ascending ``order`` (nulls first), by way of a table written to the new folder ``path``.

    Rows are dealt by ranges of the order, so equal keys of any frequency must not be long-lived ties: rows that agree
    in all of ``order`` are numbered among themselves in any way and are spread over several parts. Counts per part are
    summed in one row per part. The table is written once, so every later reader sees the same numbers.
    """
    spark = df.sparkSession
    keyed = df.withColumn("__tie", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SPREAD)))
    keys = [*order, "__tie"]
    keyed.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    parts = rows.groupBy("__part").agg(F.min(F.struct(*keys)).alias("least"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("least").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("__part", before.alias("__before"))
    at = F.row_number().over(W.partitionBy("__part").orderBy(*keys))
    # one row per shuffle partition
    return rows.join(F.broadcast(parts), "__part").select(*df.columns, (F.col("__before") + at - 1).alias(name))
