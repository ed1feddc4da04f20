"""Near duplicates by SimHash fingerprints, linked exactly through sharded vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.components import components
from tickloom.session import cut_lineage

SHARD = 8192
LEAF = 192
VISITORS = 1 << 17
#: Most dropped rows that are sent to all tasks (16 bytes each); beyond it the documents are shuffled.
SENT = 500_000


def fingerprint_of(text: bytes | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of a text: a bit is set if more than half of the shingles' XXH64 have it set.

    ``A-Z`` are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; a text with fewer words than a shingle is one
    shingle, a text without words (or null) has fingerprint 0.
    """
    from xxhash import xxh64_intdigest as xxh

    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    flat = b" ".join(words)
    if n < shingle:
        hashes, m = np.array([xxh(flat, 42)], np.uint64), 1
    else:
        size = np.fromiter(map(len, words), np.int64, n)
        end = np.cumsum(size + 1) - 1
        m = n - shingle + 1
        hashes = np.fromiter((xxh(flat[a:b], 42) for a, b in zip((end - size)[:m].tolist(), end[shingle - 1 :].tolist(), strict=True)), np.uint64, m)
    ones = np.zeros(64, np.int64)
    for at in range(0, m, 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * ones > m, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """SimHash of a text column as a signed 64-bit number."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, shingle) for t in texts], dtype="int64")

    return prints(text.cast("binary"))


def hex16(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


class Tree:
    """A vantage-point tree over 64-bit fingerprints; leaves are numbered from left to right.

    Inner nodes hold a vantage point and a radius: what lies within goes left, the rest right. A query of radius r
    enters a side only if the triangle inequality lets a match lie there.
    """

    def __init__(self, points: np.ndarray, depth: int, least: int = 2) -> None:
        self.nodes: list[tuple[int, int, int, int]] = []  # vantage, radius, left, right; a leaf has left < 0
        self.leaves = 0
        self._grow(points, depth, least)

    def _grow(self, points: np.ndarray, depth: int, least: int) -> int:
        me = len(self.nodes)
        self.nodes.append((0, 0, -1, self.leaves))
        if depth and len(points) >= 2 * least:
            best = None
            for k in range(0, len(points), max(1, len(points) // 8)):
                d = np.bitwise_count(points ^ points[k])
                radius = int(np.median(d))
                near = int((d <= radius).sum())
                both = int(((d > radius - 3) & (d <= radius + 3)).sum())
                if 0 < near < len(points) and (best is None or both + abs(2 * near - len(points)) < best[0]):
                    best = (both + abs(2 * near - len(points)), points[k], radius, d <= radius)
            if best:
                _, vantage, radius, left = best
                a = self._grow(points[left], depth - 1, least)
                b = self._grow(points[~left], depth - 1, least)
                self.nodes[me] = (int(vantage), radius, a, b)
                return me
        self.leaves += 1
        return me

    def walk(self, points: np.ndarray, radius: int, home: bool) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, indexes of the points that belong there (home) or whose matches may lie there)."""
        todo = [(0, np.arange(len(points)))]
        while todo:
            k, idx = todo.pop()
            vantage, mu, left, right = self.nodes[k]
            if not len(idx):
                continue
            if left < 0:
                yield right, idx
                continue
            d = np.bitwise_count(points[idx] ^ np.uint64(vantage)).astype(np.int16)
            r = 0 if home else radius
            todo.append((left, idx[d <= mu + r]))
            todo.append((right, idx[d > mu - r]))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component, for links a-b between n nodes."""
    root = np.arange(n)
    while len(a):
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, hi, lo)
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = root[a], root[b]
        keep = a != b
        a, b = a[keep], b[keep]
    return root


def links_within(home: np.ndarray, visit: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between home points and home or visiting points, as pairs of fingerprints.

    Links are found leaf by leaf and folded into roots as they come, so a dense group costs memory for its points only.
    """
    home = np.unique(home)
    points = np.unique(np.concatenate([home, visit]))
    ids = np.searchsorted(points, home)
    n, root = len(points), np.arange(len(points))
    seen: list[np.ndarray] = []
    held = 0

    def fold() -> None:
        nonlocal root, seen, held
        if seen:
            ab = np.concatenate(seen, axis=1)
            top = forest(n, root[ab[0]], root[ab[1]])
            root, seen, held = top[root], [], 0

    depth = max(0, int(np.ceil(np.log2(max(1, len(home)) / LEAF))))
    tree = Tree(home[:: max(1, len(home) // 4096)], depth)
    inside = dict(tree.walk(home, radius, home=True))
    for leaf, query in tree.walk(points, radius, home=False):
        if leaf not in inside:
            continue
        own = ids[inside[leaf]]
        for at in range(0, len(query), step := max(1, (1 << 21) // len(own))):
            q = query[at : at + step]
            a, b = np.nonzero(np.bitwise_count(points[own][:, None] ^ points[q][None, :]) <= radius)
            a, b = own[a], q[b]
            keep = a != b
            seen.append(np.stack([a[keep], b[keep]]))
            held += int(keep.sum())
            if held > 1 << 20:
                fold()
    fold()
    linked = np.flatnonzero(root != np.arange(n))
    return points[linked], points[root[linked]]


def near_pairs(prints: DataFrame, radius: int = 3, shard: int = SHARD, sample: int = 4096) -> DataFrame:
    """Distinct fingerprints (column ``fp``) -> (u, v) links that connect all fingerprints within ``radius`` bits.

    A vantage-point tree over a bounded sample cuts the space into shards of about ``shard`` fingerprints. Each
    fingerprint lives in one shard and visits the later shards that the triangle bounds cannot rule out; within a shard
    a local tree finds the exact pairs. Of the pairs in a shard a spanning forest is returned: no link between two
    fingerprints is lost as a connection, and a dense group yields as many rows as it has members, not all its pairs.
    Shards with many residents or visitors are split into blocks, so no task holds an unbounded group.
    """
    n = prints.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n) / shard))))
    top = prints.orderBy(F.xxhash64(F.lit(1), "fp"), "fp").limit(sample).collect() if depth else []
    tree = Tree(np.array([r[0] for r in top], np.int64).view(np.uint64), depth)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy(np.int64).copy().view(np.uint64)
            at = np.zeros(len(fp), np.int64)
            for leaf, idx in tree.walk(fp, radius, home=True):
                at[idx] = leaf
                yield pd.DataFrame({"shard": leaf, "home": True, "fp": fp[idx].view(np.int64)})
            for leaf, idx in tree.walk(fp, radius, home=False):
                idx = idx[at[idx] < leaf]
                if len(idx):
                    yield pd.DataFrame({"shard": leaf, "home": False, "fp": fp[idx].view(np.int64)})

    def within(g: pd.DataFrame) -> pd.DataFrame:
        fp = g["fp"].to_numpy(np.int64).copy().view(np.uint64)
        own = g["own"].to_numpy(bool)
        u, v = links_within(fp[own], fp[~own], radius)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    routed = prints.select("fp").mapInPandas(route, "shard long, home boolean, fp long")
    if depth == 0:
        return routed.select("shard", F.col("home").alias("own"), "fp").groupBy("shard").applyInPandas(within, "u long, v long")
    # a shard is a grid of cells: a block of its residents against a block of all that came there
    routed = cut_lineage(routed)
    size = routed.groupBy("shard").agg(F.ceil(F.count_if("home") / (2 * shard)).alias("hs"), F.ceil(F.count("*") / VISITORS).alias("qs"))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)) - 1)
    mine = lambda n, seed: F.array(F.pmod(F.xxhash64(F.lit(seed), "fp"), F.greatest(n, F.lit(1))))
    r = routed.join(size, "shard")
    own = r.where("home").select("shard", "fp", F.lit(True).alias("own"), F.explode(mine(F.col("hs"), 5)).alias("i"), every(F.col("qs")).alias("js"))
    query = r.select("shard", "fp", F.lit(False).alias("own"), F.explode(every(F.col("hs"))).alias("i"), mine(F.col("qs"), 6).alias("js"))
    cells = own.union(query).select("shard", "i", F.explode("js").alias("j"), "own", "fp")
    return cells.groupBy("shard", "i", "j").applyInPandas(within, "u long, v long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) of every document, kept once without the texts because it is read more than once."""
    return cut_lineage(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle).alias("fp")))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row per document: (``id_col``, ``fp`` signed SimHash, ``component_id``).

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the smallest id that can be reached,
    the own one included. Copies share a fingerprint and are never expanded into pairs. Null and empty texts have
    fingerprint 0 and are linked like any other; a null id is carried along (a component of null ids only has a null
    component); repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """
    ids = fingerprints(docs, id_col, text_col, shingle)
    return ids.join(component_table(ids, radius), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the smallest id (null ids last).

    Of several rows with this id in the group one stays: that with the smallest row hash. Texts are read as in
    ``simhash_groups``. Columns come out unchanged, whatever their names.
    """
    print_of = fingerprint(F.col(text_col), shingle)
    ids = cut_lineage(docs.select(F.col(id_col).alias("id"), print_of.alias("fp"), row_hash(docs).alias("tie")))
    return keep_first(docs, ids.join(component_table(ids.select("id", "fp"), radius), "fp").select("id", "tie", "g"), id_col)


def row_hash(docs: DataFrame) -> Column:
    """Hash of all columns of a row."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    """``docs`` with one row of each group ``g`` of ``groups`` (id, tie, g): the smallest id, then the smallest ``row_hash``."""
    hashed = row_hash(docs)
    groups = cut_lineage(groups)
    keep = groups.groupBy("g").agg(F.min(F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("kid"), F.col("tie").alias("ktie"))).alias("k")).select("k.kid", "k.ktie")
    pairs = groups.select(F.col("id").alias("kid"), F.col("tie").alias("ktie"))
    # rows of one id and hash are in one group, so what is not kept is dropped; fewer rows are dropped than kept mostly
    away = cut_lineage(pairs.join(keep.select(F.col("kid").alias("k2"), F.col("ktie").alias("t2")), F.col("kid").eqNullSafe(F.col("k2")) & (F.col("ktie") == F.col("t2")), "left_anti").distinct())
    twice = pairs.groupBy("kid", "ktie").count().where("count > 1").select("kid", "ktie")
    away = F.broadcast(away) if away.count() <= SENT else away
    found = docs.join(away, F.col(id_col).eqNullSafe(F.col("kid")) & (hashed == F.col("ktie")), "left_anti")
    if twice.isEmpty():
        return found
    many = found.join(twice, F.col(id_col).eqNullSafe(F.col("kid")) & (hashed == F.col("ktie")), "left_semi")
    rest = found.join(twice, F.col(id_col).eqNullSafe(F.col("kid")) & (hashed == F.col("ktie")), "left_anti")
    return rest.union(many.withColumn("__tie", hashed).dropDuplicates([id_col, "__tie"]).drop("__tie"))


def component_table(ids: DataFrame, radius: int = 3) -> DataFrame:
    """(id, fp) -> (fp, g, component_id), one row per distinct fingerprint; ``g`` numbers the groups."""
    prints = ids.groupBy("fp").agg(F.min("id").alias("id"))
    links = components(near_pairs(prints, radius))
    rooted = prints.join(links.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return rooted.join(least, "root").select("fp", F.col("root").alias("g"), "component_id")
