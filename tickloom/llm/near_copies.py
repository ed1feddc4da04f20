"""Near duplicates by exact Jaccard similarity of word shingles: SimHash neighbours first, then a signature join over distinct texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.components import components
from tickloom.llm.repeats import Kept
from tickloom.llm.sampling import bounded
from tickloom.llm.settings import setting
from tickloom.llm.simhash import keep_first, near_pairs, row_hash
from tickloom.session import cut_lineage

#: Words of a shingle, and the least similarity as a fraction.
WIDTH = 5
SHARE = (4, 5)
#: Differing bits of two SimHash fingerprints that are compared first. It decides speed, never results.
RADIUS = 3
#: Texts that the order of shingles is learned from, and the most shingles that it holds. It decides speed, never results.
SAMPLE = 4000
COMMON = 30_000
#: Most keys that are sent to all tasks (8 bytes each); beyond it the texts are shuffled.
SENT = 500_000
#: Portions in which the signatures are looked at: the shuffle files of one are gone before the next.
PORTIONS = 2
#: Rounds in which every text is compared with the best leader of a signature only.
ROUNDS = 2
#: Bytes of an Arrow batch.
BATCH = "4m"
#: Spark deletes the shuffle files of an action when it ends; the driver's garbage collector would come too late for them.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingles_of(text: bytes | None, width: int = WIDTH) -> tuple[int, np.ndarray]:
    """(key of the lower-cased word sequence, distinct 64-bit shingle hashes in order).

    Words are what white space separates; a text with fewer words than a shingle is one shingle, a text without words
    (or null) has key 0 and no shingle.
    """
    from xxhash import xxh64_intdigest as xxh

    flat = " ".join((text or b"").decode("utf-8", "surrogateescape").lower().split()).encode("utf-8", "surrogateescape")
    if not flat:
        return 0, np.zeros(0, np.uint64)
    words = flat.split(b" ")
    key = int(np.uint64(xxh(flat, 11)).view(np.int64)) or 1
    n = len(words)
    if n < width:
        return key, np.array([xxh(flat, 12)], np.uint64)
    w = np.fromiter(map(xxh, words), np.uint64, n)
    m = n - width + 1
    h = w[:m].copy()
    for i in range(1, width):
        h = h * _P + w[i : m + i]
    h = (h ^ (h >> np.uint64(29))) * _Q
    return key, np.unique(h ^ (h >> np.uint64(32)))


def fingerprint_of(h: np.ndarray) -> int:
    """SimHash of distinct shingles: a bit is set if more than half of them have it."""
    bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h)).view(np.int64)[0])


def signatures_of(h: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hashes of neighbours in the order (count in the sample, hash) of a text's shingles, a start mark before the first.

    Let two sets of a and b shingles have d of them on one side only, at most (1 - s) / (1 + s) * (a + b) at similarity
    s. In the common order, d + 1 gaps lie between the first d + 2 shared shingles (the start mark is the first), and
    each of the d others breaks one gap at most, so one pair of neighbours is the same in both. The first text needs its
    shared and its own shingles for that, 2 * (1 - s) * a at most besides the first two.
    """
    n = len(h)
    if not n:
        return h
    seen = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        seen = np.where(common[at] == h, counts[at], 0)
    first = h[np.lexsort((h, seen))[: 2 * (SHARE[1] - SHARE[0]) * n // SHARE[1] + 1]]
    pairs = np.concatenate([np.zeros(1, np.uint64), first[:-1]]) * _P + first
    return (pairs ^ (pairs >> np.uint64(31))) * _Q


def common_shingles(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of the most frequent shingles of a bounded sample of texts."""

    @F.pandas_udf("array<long>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles_of(t)[1].view(np.int64) for t in texts], dtype=object)

    # chosen by the hash of the text, so copies come together and count once
    some = bounded(docs.select(F.col(text_col).cast("binary").alias("t")), F.col("t"), SAMPLE).distinct()
    top = some.select(F.explode(shingles("t")).alias("h")).groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).collect()
    h, n = np.array([r[0] for r in top], np.int64).view(np.uint64), np.array([r[1] for r in top], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _alike(n: Column, m: Column) -> Column:
    return F.least(n, m) * SHARE[1] >= F.greatest(n, m) * SHARE[0]


def _can_reach(i: Column, n: Column, j: Column, m: Column) -> Column:
    """Whether sets of n and m shingles that share the neighbours at i and j of their orders can be similar: what lies
    before them on the one side is shared with what lies before on the other, and likewise behind."""
    both = F.least(i, j) + F.least(n - i, m - j)
    return both * sum(SHARE) >= (n + m) * SHARE[0]


def similar(pairs: DataFrame, texts: DataFrame, repeated: bool, kept: Kept) -> DataFrame:
    """Those (u, v) whose shingle sets have the similarity; ``texts`` (tie, text) and ``pairs`` with the ties of both ends, ``repeated`` if a tie can occur twice."""

    @F.pandas_udf("array<long>")
    def shingles(t: pd.Series) -> pd.Series:
        return pd.Series([shingles_of(x)[1].view(np.int64) for x in t], dtype=object)

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both * SHARE[1] >= (len(x) + len(y) - both) * SHARE[0])
        return pd.Series(out, dtype=bool)

    pairs = cut_lineage(pairs)
    # a row holds the shingles of two texts, and both sides hold a batch several times over
    with setting(pairs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH):
        asked = cut_lineage(pairs.select(F.col("tu").alias("tie")).union(pairs.select("tv")).distinct())
        few = asked.count() <= SENT
        found = texts.join(F.broadcast(asked) if few else asked, "tie", "left_semi")
        found = found.dropDuplicates(["tie"]) if repeated else found
        sets = kept.keep(found.select("tie", shingles("text").alias("h")), "sets")
        both = pairs.join(sets.toDF("tu", "a"), "tu").join(sets.toDF("tv", "b"), "tv")
        links = cut_lineage(both.where(close("a", "b")).select("u", "v"))
        kept.drop("sets")
    return links


def print_links(reps: DataFrame, texts: DataFrame, repeated: bool, kept: Kept) -> DataFrame:
    """(u, v) links of similar texts whose SimHash fingerprints lie within a few bits, found by the vantage-point trees.

    Texts of one fingerprint are compared with the first of them, fingerprints along the spanning forest of their links.
    """
    first = reps.groupBy("fp").agg(F.min(F.struct("key", "tie", "n")).alias("f")).select("fp", F.col("f.key").alias("fk"), F.col("f.tie").alias("ft"), F.col("f.n").alias("fn"))
    first = cut_lineage(first)
    same = reps.join(first, "fp").where("key <> fk").select(F.col("key").alias("u"), F.col("fk").alias("v"), F.col("tie").alias("tu"), F.col("ft").alias("tv"), F.col("n").alias("a"), F.col("fn").alias("b"))
    near = near_pairs(first.select("fp"), RADIUS).toDF("fu", "fv")
    near = near.join(first.toDF("fu", "u", "tu", "a"), "fu").join(first.toDF("fv", "v", "tv", "b"), "fv").select("u", "v", "tu", "tv", "a", "b")
    return similar(same.union(near).where(_alike(F.col("a"), F.col("b"))).drop("a", "b"), texts, repeated, kept)


def near_links(reps: DataFrame, texts: DataFrame, kept: Kept, repeated: bool = True) -> DataFrame:
    """(u, v) links that connect all keys of similar texts; ``reps`` (key, n, signs, fp, tie) has one row per distinct text
    and is the table "reps" of ``kept``, which this deletes.

    Two similar texts share a signature. After the links that fingerprints show, in each round every text that shares a
    signature with another group is compared with one leader: of the leaders of its signatures, the one it shares most
    with. A signature's leader is its text with most companions, which in a group of near copies is the one closest to
    all of them; so such a group is linked without its pairs. At last all pairs of a signature that are still in
    different groups are compared, if they can be similar. No pair that can be similar is left out.
    """
    links = print_links(reps, texts, repeated, kept)
    groups = components(links).toDF("key", "g")
    # the other side has all signatures
    groups = F.broadcast(groups) if groups.count() <= SENT else groups
    signs = reps.join(groups, "key", "left").select("key", F.coalesce("g", "key").alias("g"), "n", F.posexplode("signs").alias("i", "token"))
    same = W.partitionBy("token")
    for k in range(PORTIONS):
        some = signs.where(F.pmod("token", F.lit(PORTIONS)) == k).withColumns({"lo": F.min("g").over(same), "hi": F.max("g").over(same), "c": F.count("*").over(same)})
        kept.keep(some.where("lo <> hi").drop("lo", "hi", "g"), f"shared/part={k}")
    shared = kept.spark.read.parquet(f"{kept.folder}/shared").drop("part")
    ties = cut_lineage(reps.select("key", "tie"))
    kept.drop("reps")
    rows = kept.keep(shared.drop("c").join(shared.groupBy("key").agg(F.sum(F.col("c") - 1).alias("w")), "key"), "rows")
    kept.drop("shared")
    named = lambda p: p.join(ties.toDF("u", "tu"), "u").join(ties.toDF("v", "tv"), "v")
    tested = None
    for k in range(ROUNDS + 1):
        if rows.isEmpty():
            break
        placed = rows.join(components(links).toDF("key", "g"), "key", "left").withColumn("g", F.coalesce("g", "key"))
        split = placed.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("token")
        rows = kept.keep(placed.join(split, "token", "left_semi"), f"rows{k}")
        kept.drop(f"rows{k - 1}" if k else "rows")
        new = lambda p: p if tested is None else p.join(tested, ["u", "v"], "left_anti")  # noqa: E731, B023
        pair = [F.least("key", "lk").alias("u"), F.greatest("key", "lk").alias("v")]
        if k == ROUNDS:
            other = rows.select("token", F.col("key").alias("lk"), F.col("n").alias("ln"), F.col("i").alias("li"), F.col("g").alias("lg"))
            rest = rows.join(other, "token").where((F.col("g") < F.col("lg")) & _alike(F.col("n"), F.col("ln")) & _can_reach(F.col("i"), F.col("n"), F.col("li"), F.col("ln")))
            links = links.union(similar(named(new(rest.select(*pair).distinct())), texts, repeated, kept))
            break
        lead = rows.groupBy("token").agg(F.max(F.struct("w", "key", "n", "i", "g")).alias("l")).select("token", F.col("l.key").alias("lk"), F.col("l.n").alias("ln"), F.col("l.i").alias("li"), F.col("l.g").alias("lg"))
        stars = rows.join(lead, "token").where((F.col("g") != F.col("lg")) & _alike(F.col("n"), F.col("ln")) & _can_reach(F.col("i"), F.col("n"), F.col("li"), F.col("ln")))
        stars = new(stars.groupBy("key", "lk").agg(F.count("*").alias("c")).select("key", "c", "lk", *pair))
        stars = cut_lineage(stars.groupBy("key").agg(F.max(F.struct("c", "u", "v")).alias("s")).select("s.u", "s.v").distinct())
        found = similar(named(stars), texts, repeated, kept)
        tested = stars if tested is None else cut_lineage(tested.union(stars))
        links = cut_lineage(links.union(found))
        rows = rows.drop("g")
    return links


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the smallest id (null ids last).

    Texts link if the Jaccard similarity of their distinct 5-word shingles is 0.8 or more; groups are what can be
    reached. Texts of one lower-cased word sequence are one text; null texts and those without words are copies of each
    other. Of repeated rows one stays, ties of ids are settled by a hash of the row, columns come out unchanged
    whatever their names, texts of any length are read whole, an empty table has an empty result.
    """
    common, counts = common_shingles(docs, text_col)

    @F.pandas_udf("key long, n int, signs array<long>, fp long")
    def marks(texts: pd.Series) -> pd.DataFrame:
        out = [(k, len(h), signatures_of(h, common, counts).view(np.int64), fingerprint_of(h)) for k, h in map(shingles_of, texts)]
        return pd.DataFrame(out, columns=["key", "n", "signs", "fp"]).astype({"key": "int64", "n": "int32", "fp": "int64"})

    hashed = row_hash(docs)
    kept = Kept(docs)
    with setting(docs.sparkSession, CLEAN, "true"):
        s = kept.keep(docs.select(F.col(id_col).alias("id"), hashed.alias("tie"), marks(F.col(text_col).cast("binary")).alias("s")).select("id", "tie", "s.*"), "marks")
        rows = cut_lineage(s.select("id", "tie", "key"))
        some = lambda c: F.any_value(c).alias(c)
        reps = kept.keep(s.where("key <> 0").groupBy("key").agg(F.min("tie").alias("tie"), some("n"), some("signs"), some("fp")), "reps")
        kept.drop("marks")
        repeated = not rows.groupBy("tie").count().where("count > 1").isEmpty()
        roots = components(near_links(reps, docs.select(hashed.alias("tie"), F.col(text_col).cast("binary").alias("text")), kept, repeated))
        groups = cut_lineage(rows.join(roots.withColumnRenamed("node", "key"), "key", "left").select("id", "tie", F.coalesce("root", "key").alias("g")))
        kept.drop("")
    return keep_first(docs, groups, id_col)
