"""Mixing sources to target weights by capped water-filling and seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.text import word_count
from tickloom.session import cut_lineage

#: Slices of the sampling order, in which sizes are summed before documents are.
SLICES = 4096


def targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """(source, source_size, weight) -> the same with ``target``.

    All sizes together are shared by weight. A source stops at ``most`` times its own size and its excess is shared
    among the others by weight, until none is above: with the sources in the order of size per weight, those that stop
    are the first ones, so the level follows from running sums over one row per source. Weights must be positive;
    sources without words get 0.
    """
    w = W.orderBy(F.col("source_size") / F.col("weight"), "source")
    upto = w.rowsBetween(W.unboundedPreceding, -1)
    all_rows = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = sizes.select("*", (F.sum("source_size").over(all_rows) - most * F.coalesce(F.sum("source_size").over(upto), F.lit(0))).alias("left"), (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(upto), F.lit(0))).alias("open"))
    # the first source that does not reach its stop sets the level for all after it
    fits = most * F.col("source_size") * F.col("open") >= F.col("weight") * F.col("left")
    s = s.select("*", F.first(F.when(fits, F.struct("left", "open")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("level"))
    share = F.when(F.col("level").isNull(), (most * F.col("source_size")).cast("double")).otherwise((F.col("weight") * F.col("level.left")).cast("double") / F.col("level.open").cast("double"))
    return s.select("source", "source_size", "weight", F.when(F.col("source_size") > 0, share).otherwise(F.lit(0.0)).alias("target"))


def cycling_weights(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds ``weight``: the cycle dealt to the sources in code point order, null last."""
    n = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), F.pmod(n - 1, F.lit(len(cycle))).cast("int") + 1).cast("long"))


def seeded(key: Column, seed: int) -> Column:
    """A repeatable number below 2**60 for each key, the same in any engine with MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def plan(sized: DataFrame, weights: DataFrame | None, most: int) -> DataFrame:
    """(source, size, u) of every document -> one row per source: source_size, target, whole, border.

    ``whole`` is how often every document of the source is taken; those up to ``border``, a (u, size) in the seeded
    order, are taken once more. The border is the last document whose middle lies below the rest of the target. Sizes
    are summed by slices of the order first and document by document only within the slice of the border, so a source
    with any share of all rows is spread over the tasks.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sizes = cycling_weights(sizes) if weights is None else sizes.join(weights.withColumnRenamed("source", "w_source"), F.col("source").eqNullSafe(F.col("w_source"))).drop("w_source")
    t = targets(sizes, most)
    t = t.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    t = t.withColumn("rest", F.col("target") - (F.col("whole") * F.col("source_size")).cast("double"))
    t = cut_lineage(t)
    d = sized.withColumn("slice", F.floor(F.col("u") / ((1 << 60) // SLICES)))
    sums = d.groupBy("source", "slice").agg(F.sum("size").alias("part"))
    upto = F.sum("part").over(W.partitionBy("source").orderBy("slice"))
    named = t.select(F.col("source").alias("t_source"), "rest").where("rest > 0")
    # one slice before and one after the crossing are enough to hold the border
    near = sums.select("source", "slice", (upto - F.col("part")).alias("before"), upto.alias("after")).join(named, F.col("source").eqNullSafe(F.col("t_source")))
    near = near.where(F.col("before") <= F.col("rest")).withColumn("k", F.row_number().over(W.partitionBy("source").orderBy(F.col("slice").desc()))).where("k <= 2")
    near = near.select(F.col("source").alias("n_source"), F.col("slice").alias("n_slice"), "before", "rest")
    few = d.join(F.broadcast(near) if near.count() <= 1 << 16 else near, F.col("source").eqNullSafe(F.col("n_source")) & (F.col("slice") == F.col("n_slice")))
    run = F.sum("size").over(W.partitionBy("source", "slice").orderBy("u", "size").rowsBetween(W.unboundedPreceding, 0))
    few = few.withColumn("run", F.col("before") + run).where((2 * F.col("run") - F.col("size")).cast("double") <= 2 * F.col("rest"))
    border = few.groupBy(F.col("source").alias("b_source")).agg(F.max(F.struct("u", "size")).alias("border"))
    return cut_lineage(t.join(border, F.col("source").eqNullSafe(F.col("b_source")), "left").drop("b_source", "rest"))


def _taken(sized: DataFrame, p: DataFrame) -> DataFrame:
    """``sized`` with its source's plan and ``times``, the number of times the mix takes the document."""
    p = p.withColumnRenamed("source", "p_source")
    p = F.broadcast(p) if p.count() <= 1 << 16 else p  # one row per source
    more = F.col("border").isNotNull() & (F.struct("u", "size") <= F.col("border"))
    return sized.join(p, F.col("source").eqNullSafe(F.col("p_source"))).withColumn("times", F.col("whole") + F.when(more, 1).otherwise(0)).drop("p_source", "border")


def mix(docs: DataFrame, weights: DataFrame | None = None, most: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: (``id_col``, source, size in words, source_size, target, whole, times, taken words).

    A source's target divided by its size is the number of its repetitions: the whole part repeats every document, the
    rest repeats once more the documents that come first in a seeded order, so a source misses its target by half a
    document. Weights come as (source, weight); without them they are 1, 2, 3, repeating. Null and empty texts have
    size 0, a null source is a source, documents of equal id and size share their fate, repeated rows stay, other
    columns are ignored, an empty table gives an empty result.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    d = cut_lineage(d.withColumn("u", seeded(F.col("id"), seed)))
    t = _taken(d, plan(d, weights, most))
    return t.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "whole", "times", (F.col("times") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: DataFrame | None = None, most: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: every row as often as ``mix`` says, with its own columns only."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    d = docs.select(own, F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")).withColumn("u", seeded(F.col("id"), seed))
    p = plan(cut_lineage(d.select("source", "size", "u")), weights, most)
    return _taken(d, p).where("times > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("__k")).select("row.*")
