"""Merkle manifest of a dataset: levels of parent-linked node rows, and a recursive query that climbs from every leaf."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.numbering import numbered
from tickloom.llm.settings import setting

#: Children of a node.
ARITY = 3
#: Most trees (groups) whose table is sent to all tasks, at some 100 bytes each.
SENT = 1 << 16
NODE = "tree long, level int, pos long, n long, digest binary, before binary, after binary, p_tree long, p_level int, p_pos long"


def field(x: Column) -> Column:
    """A value as the leaf digests it: ``-`` if null, else its UTF-8 byte count, a colon and its text."""
    s = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    """The digest of a row (32 bytes)."""
    return F.unhex(F.sha2(F.concat(*map(field, values)).cast("binary"), 256))


def text_of(digests: Column) -> Column:
    """Digests, laid end to end, as lower-case hex text."""
    return F.lower(F.hex(digests))


def joined(*digests: Column) -> Column:
    """The digest of digests, which enter as hex text."""
    return F.unhex(F.sha2(text_of(F.concat(*digests)).cast("binary"), 256))


@dataclass
class Manifest:
    """``leaves`` and ``nodes`` under one folder: one row per leaf, one per inner node below the root.

    A node is (tree, level, pos): tree 0 lies over the groups' subroots, tree k over the leaves of the k-th group.
    Its row holds its digest, those of the others of its run to the left and to the right, and its parent. A group's
    subroot is a node of tree 0 only. ``trees`` has one row per group with its subroot.
    """

    spark: SparkSession
    path: str
    root: bytes | None
    groups: int

    @property
    def leaves(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/leaves")

    @property
    def nodes(self) -> DataFrame:
        return self.spark.read.schema(NODE).parquet(f"{self.path}/nodes")

    @property
    def trees(self) -> DataFrame:
        if self.groups < 2:
            return self.leaves.select("tree").distinct().withColumn("subroot", F.lit(self.root).cast("binary"))
        return self.nodes.where("tree = 0 and level = 0").select((F.col("pos") + 1).alias("tree"), F.col("digest").alias("subroot"))


def _heights(most: int) -> int:
    """Levels above the lowest one of a tree with so many leaves."""
    k = 0
    while most > 1:
        k, most = k + 1, -(-most // ARITY)
    return k


def _ceil(n: Column) -> Column:
    return F.floor((n + (ARITY - 1)) / ARITY)


def _level(rows: DataFrame, level: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """(tree, pos, n, digest) of a level with more than one node per tree -> node rows with their run's others and parent."""
    kid = F.struct("pos", "digest", *carried)
    runs = rows.groupBy("tree", "n", F.floor(F.col("pos") / ARITY).alias("run")).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
    digests = F.transform("kids", lambda k: k["digest"])
    cat = lambda part: F.aggregate(part, F.lit(b""), lambda a, d: F.concat(a, d))
    at = runs.select("tree", "n", "run", digests.alias("all"), F.posexplode("kids").alias("i", "kid"))
    # the only node of a group's next level is its subroot, known by its place in tree 0
    top = (F.col("tree") > 0) & (F.col("n") <= ARITY)
    return at.select(
        "tree", F.lit(level).alias("level"), "kid.pos", "n", "kid.digest", cat(F.slice("all", 1, F.col("i"))).alias("before"), cat(F.slice("all", F.col("i") + 2, ARITY)).alias("after"),
        F.when(top, 0).otherwise(F.col("tree")).cast("long").alias("p_tree"), F.when(top, 0).otherwise(level + 1).cast("int").alias("p_level"),
        F.when(top, F.col("tree") - 1).otherwise(F.col("run")).cast("long").alias("p_pos"), *[f"kid.{c}" for c in carried],
    )


def _alone(rows: DataFrame, level: int) -> DataFrame:
    """Roots of trees as node rows."""
    none = F.lit(b"")
    return rows.select("tree", F.lit(level).alias("level"), "pos", "n", "digest", none.alias("before"), none.alias("after"), *[F.lit(None).cast(t).alias(c) for c, t in (("p_tree", "long"), ("p_level", "int"), ("p_pos", "long"))])


def _grow(spark: SparkSession, level0: str, folder: str, largest: int) -> None:
    """Writes all levels over a stored one; the parent's digest is read off each run's first node."""
    path = level0
    for level in range(1, _heights(largest) + 1):
        first = spark.read.parquet(path).where((F.col("pos") % ARITY == 0) & (F.col("n") > 1))
        up = first.select("tree", F.col("pos").alias("run"), _ceil(F.col("n")).cast("long").alias("n"), joined("digest", "after").alias("digest"))
        up = up.select("tree", F.floor(F.col("run") / ARITY).cast("long").alias("pos"), "n", "digest")
        path = f"{folder}/height={level}"
        grown = _level(up.where("n > 1"), level)
        # a root has no siblings; it is kept without a parent
        alone = _alone(up.where("n = 1"), level)
        grown.unionByName(alone).write.parquet(path)


def manifest(docs: DataFrame, path: str, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "source", id_col: str = "doc_id", found: dict[str, Column] | None = None) -> Manifest:
    """Builds and stores the manifest of ``docs`` under the new folder ``path``.

    Every row is a leaf: the digest of ``fields``. Leaves of one group (null first, then by code point) ascend by id
    (null first), then by digest; runs of three become their parent until one is left, the group's subroot (a lone leaf
    itself), and the subroots become the root in the same way. ``found`` gives other values for some fields, as another
    copy of the rows has them; the leaf's digest with these values is stored as ``claim``. Repeated rows are leaves of
    their own; null and empty values differ; other columns are ignored; an empty table has an empty manifest, root None.

    Rows are numbered by a range partitioning and counts per part, so no group meets in one task; a level costs one
    exchange of digests, and its rows are a third of the level below.
    """
    spark = docs.sparkSession
    values = [F.col(f"`{f}`") for f in fields]
    others = [(found or {}).get(f, v) for f, v in zip(fields, values, strict=True)]
    g = F.col(f"`{group_col}`").cast("string")
    # null sorts below every text
    key = F.coalesce(F.concat(F.lit("="), g), F.lit("")).alias("key")
    rows = numbered(docs.select(key, F.col(f"`{id_col}`").alias("id"), leaf_of(*values).alias("digest"), leaf_of(*others).alias("claim")), ["key", "id", "digest"], "g", f"{path}/rows")
    groups = numbered(rows.groupBy("key").agg(F.min("g").alias("first"), F.count("*").alias("n")), ["key"], "tree", f"{path}/groups")
    groups = groups.withColumn("tree", F.col("tree") + 1)
    trees, largest = groups.agg(F.count("*"), F.max("n")).first()
    groups = F.broadcast(groups) if trees <= SENT else groups
    leaves = rows.join(groups, "key").select("tree", (F.col("g") - F.col("first")).alias("pos"), "n", "digest", "claim", "id", "g")
    many = _level(leaves.where("n > 1"), 0, ("claim", "id", "g"))
    # a lone leaf is its group's subroot
    none, lone = F.lit(b""), leaves.where("n = 1")
    lone = lone.select("tree", F.lit(0).alias("level"), "pos", "n", "digest", none.alias("before"), none.alias("after"), F.lit(0).cast("long").alias("p_tree"), F.lit(0).alias("p_level"), (F.col("tree") - 1).alias("p_pos"), "claim", "id", "g")
    many.unionByName(lone).write.parquet(f"{path}/leaves")
    inner, root = [], None
    if trees:
        tops = spark.read.parquet(f"{path}/leaves").where("n = 1").select("tree", "digest")
        if largest > 1:
            _grow(spark, f"{path}/leaves", f"{path}/grown", largest)
            inner.append(spark.read.schema(NODE).parquet(*[f"{path}/grown/height={k}" for k in range(1, _heights(largest) + 1)]))
            tops = tops.union(inner[0].where("n = 1").select("tree", "digest"))
        tops = tops.select(F.lit(0).cast("long").alias("tree"), (F.col("tree") - 1).alias("pos"), F.lit(trees).cast("long").alias("n"), "digest")
        if trees > 1:
            _level(tops, 0).write.parquet(f"{path}/top/height=0")
            _grow(spark, f"{path}/top/height=0", f"{path}/top", trees)
            inner.append(spark.read.schema(NODE).parquet(*[f"{path}/top/height={k}" for k in range(_heights(trees) + 1)]))
        root = bytes((inner[-1].where("n = 1") if trees > 1 else tops).first()["digest"])
    # what a climb joins: every inner node that has a parent
    nodes = reduce(DataFrame.union, inner, spark.createDataFrame([], NODE))
    nodes.where("p_tree is not null").write.parquet(f"{path}/nodes")
    return Manifest(spark, path, root, trees)


def climb(m: Manifest) -> DataFrame:
    """One row per leaf: (g, id, leaf, tree, folded, proof), written under the manifest's folder and read again.

    A recursive query starts at the leaves with their claimed digests; each step joins the rows that have arrived at a
    node with that node's row, folds their digest with the run's others and goes on to the parent, until nothing has
    one. ``proof`` digests the siblings met on the way, from the leaf up and from left to right; ``folded`` is the root
    that the claim leads to.
    """
    spark, path = m.spark, f"{m.path}/climbed"
    start = m.leaves.select("g", F.lit(0).alias("step"), F.when(F.col("n") > 1, joined("before", "claim", "after")).otherwise(F.col("claim")).alias("digest"), F.concat("before", "after").alias("siblings"), "p_tree", "p_level", "p_pos", "id", F.col("digest").alias("leaf"), F.col("tree").alias("of"))
    sql = """
with recursive climb(g, step, digest, siblings, tree, level, pos, id, leaf, of) as (
    select * from {start}
    union all
    select c.g, c.step + 1, unhex(sha2(lower(hex(concat(n.before, c.digest, n.after))), 256)), concat(n.before, n.after), n.p_tree, n.p_level, n.p_pos, nullif(c.id, c.id), cast(null as binary), cast(null as bigint)
    from climb c join {nodes} n on c.tree = n.tree and c.level = n.level and c.pos = n.pos
)
select g, max(id) as id, max(leaf) as leaf, max(of) as tree, max_by(digest, step) as folded,
    sha2(array_join(transform(sort_array(collect_list(struct(step, siblings))), x -> lower(hex(x.siblings))), ''), 256) as proof
from climb group by g"""
    # recursive queries stop at a million rows by default; a climb makes one per leaf and level
    with setting(spark, "spark.sql.cteRecursionRowLimit", "-1"):
        spark.sql(sql, start=start, nodes=m.nodes).write.parquet(path)
    return spark.read.parquet(path)


def check(m: Manifest) -> DataFrame:
    """One row per leaf: (id, leaf, subroot, root, proof, folded, verified), digests as hex text; ``verified`` if the climb ends at the root."""
    trees = m.trees if m.groups > SENT else F.broadcast(m.trees)
    found = climb(m).join(trees, "tree")
    root = F.lit(m.root).cast("binary")
    return found.select("id", text_of(F.col("leaf")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), text_of(root).alias("root"), "proof", text_of(F.col("folded")).alias("folded"), (F.col("folded") == root).alias("verified"))
