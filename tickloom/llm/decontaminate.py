"""Benchmark decontamination: containment search with size-partitioned MinHash sketches, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.session import cut_lineage

#: The largest sketch table (rows of two longs) that is sent to every executor; beyond it the search is a shuffle join.
SENT = 1_000_000


def word_list(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores; null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), "")


def shingles(words: Column, size: Column | int) -> Column:
    """All runs of ``size`` consecutive words as strings, repeats included; none if there are fewer words."""
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, size), " "))


def hashes(words: Column, size: int) -> Column:
    """64-bit hashes of the same shingles, made without building their strings."""
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, size)))


def item_shingles(benchmark: DataFrame, size: int = 5) -> DataFrame:
    """(item, width, gram, h, n): the distinct shingles of each item, their hash and number.

    An item with fewer words than a shingle is one shingle of its own width; an item without words has none. Items are
    numbered by ``item_id``; rows that repeat an id are one item with all their shingles.
    """
    words = benchmark.select("item_id", word_list(F.col("text")).alias("w")).where(F.size("w") > 0)
    cut = words.withColumn("width", F.least(F.size("w"), F.lit(size)))
    gram = cut.select("item_id", "width", F.explode(shingles(F.col("w"), F.col("width"))).alias("gram")).distinct()
    gram = gram.withColumn("h", F.xxhash64(F.split("gram", " ")))
    return gram.withColumn("n", F.count("*").over(W.partitionBy("item_id"))).select("item_id", "width", "gram", "h", "n")


def sketches(grams: DataFrame, least: float = 0.8) -> DataFrame:
    """(item_id, width, h): the MinHash sketch of each item, as large as the item's size class needs.

    Items are partitioned by size into classes that double. Of ``n`` shingles at most ``n - ceil(least * n)`` may be
    missing from a text that contains the item, so one more than that for the largest size of the class is kept: at
    least one of them is then in every such text, however long it is. The kept ones are those with the smallest
    hashes, which makes the sketch a bottom-k MinHash of the item.
    """
    largest = F.pow(2.0, F.ceil(F.log2(F.col("n").cast("double"))))
    keep = F.floor(largest * (1 - least) + 1e-9) + 1
    order = W.partitionBy("item_id").orderBy(F.xxhash64("h"), "h", "gram")
    return grams.withColumn("r", F.row_number().over(order)).where(F.col("r") <= keep).select("item_id", "width", "h").distinct()


def contained_items(docs: DataFrame, benchmark: DataFrame, size: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", sent: int = SENT) -> DataFrame:
    """(``id_col``, item_id, n_found, n_item, containment, tk: hash of the text) of every document that holds ``least`` of an item's shingles.

    Candidates come from the sketches and are verified by exact containment of the shingle strings in the whole text;
    no pair above the threshold is lost, whatever the lengths. Items shorter than a shingle are looked for as a whole.
    Null and empty texts and items give no pair; null ids are kept as ids; rows that repeat a document's id and text
    give one pair; further columns are ignored; empty tables give an empty result.
    """
    grams = item_shingles(benchmark.select("item_id", "text"), size)
    marks = sketches(grams, least)
    n = marks.count()
    widths = sorted(r[0] for r in grams.select("width").distinct().collect())  # at most ``size`` values
    few = F.broadcast if n <= sent else (lambda x: x)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keyed = texts.select("doc_id", F.xxhash64("text").alias("tk"), word_list(F.col("text")).alias("w"))

    def tagged(k: int) -> Column:
        return F.transform(hashes(F.col("w"), k), lambda h: F.struct(F.lit(k).alias("width"), h.alias("h")))

    every = F.flatten(F.array(*map(tagged, widths))) if len(widths) > 1 else None
    if not widths:
        seen = keyed.select("doc_id", "tk", F.lit(1).alias("width"), F.lit(0).cast("long").alias("h")).where("false")
    elif every is None:
        seen = keyed.select("doc_id", "tk", F.lit(widths[0]).alias("width"), F.explode(hashes(F.col("w"), widths[0])).alias("h"))
    else:
        seen = keyed.select("doc_id", "tk", F.explode(every).alias("x")).select("doc_id", "tk", "x.width", "x.h")
    pairs = seen.join(few(marks), ["width", "h"]).select("doc_id", "tk", "item_id").distinct()
    pairs = cut_lineage(pairs)
    # verify: the candidates' texts once more, their shingles as strings against those of the items
    asked = pairs.select(F.col("doc_id").alias("a_id"), F.col("tk").alias("a_tk")).distinct()
    asked = F.broadcast(asked) if asked.count() <= sent else asked
    again = texts.withColumn("tk", F.xxhash64("text")).join(asked, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("tk") == F.col("a_tk")), "left_semi")
    again = again.dropDuplicates(["doc_id", "tk"]).select("doc_id", "tk", word_list(F.col("text")).alias("w"))
    held = again.select("doc_id", "tk", F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *[shingles(F.col("w"), k) for k in widths]))).alias("gram"))
    whole = few(grams.select("item_id", "gram", "n")) if grams.count() <= sent else grams.select("item_id", "gram", "n")
    found = held.join(whole, "gram").groupBy("doc_id", "tk", "item_id").agg(F.count("*").alias("n_found"), F.max("n").alias("n_item"))
    # only what the sketches named, and once for rows that repeat an id and a text
    p = pairs.select(F.col("doc_id").alias("p_id"), F.col("tk").alias("p_tk"), F.col("item_id").alias("p_item"))
    found = found.join(p, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("tk") == F.col("p_tk")) & F.col("item_id").eqNullSafe(F.col("p_item")), "left_semi")
    share = F.col("n_found") / F.col("n_item")
    return found.where(share >= least).select(F.col("doc_id").alias(id_col), "item_id", "n_found", "n_item", share.alias("containment"), "tk")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; columns unchanged, repeated rows share their fate."""
    bad = contained_items(docs, benchmark, size, least, id_col, text_col).select(F.col(id_col).alias("__id"), F.col("tk").alias("__tk")).distinct()
    bad = cut_lineage(bad)
    bad = F.broadcast(bad) if bad.count() <= SENT else bad
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__tk")), "left_anti")
