"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import cut_lineage


def _shape(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(u, v) links of comparable ids -> (node, root), where root is the smallest node of the component.

    Nodes without a link do not appear. Null ends are dropped, self links and repeated links do not matter.
    Every round is two joins over the links; their number grows with the logarithm of the longest path, and
    the links of a round are cut off from their history by a reliable checkpoint, so a lost executor costs one round.
    """
    e = links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut_lineage(e)
    seen = _shape(e)
    while True:
        # every node hangs its larger neighbours on the smallest one it knows
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # and itself with its smaller neighbours
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = small.where("v <> m").select("v", "m").union(low.select("u", "m")).toDF("u", "v").distinct()
        e = cut_lineage(e)
        now = _shape(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
