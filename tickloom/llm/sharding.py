"""Sharding by fixed virtual slots and a versioned slot-to-shard map that is edited when loads change."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.numbering import numbered
from tickloom.session import cut_lineage

SLOTS = 4096
#: Equal rows that share a slot; of more, each has its own.
ALIKE = 8
OVERHEAD = 16


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text plus a fixed overhead per record; null has no bytes."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def slot_of(doc_id: Column, text: Column, slots: int = SLOTS, copy: Column | None = None) -> Column:
    """The record's slot, for ever: a hash of its id and text, so that no id, source or copy group fills one slot.

    ``copy`` numbers rows that repeat both; the first of them has the slot of a single one.
    """
    own = F.xxhash64(F.lit(29), doc_id, text)
    return F.pmod(own if copy is None else F.when(copy == 0, own).otherwise(F.xxhash64(F.lit(31), own, copy)), F.lit(slots))


def numbered_copies(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """``docs`` with ``__copy``: 0, 1, ... among the rows that repeat both id and text more than ``ALIKE`` times, else 0.

    Only such rows are numbered, by ranges and counts per part, so that a third of all rows may be one row; without any,
    this costs a count of 16-byte keys.
    """
    keyed = docs.withColumns({"__id": F.xxhash64(F.col(id_col)), "__text": F.xxhash64(F.lit(5), F.col(text_col))})
    many = cut_lineage(keyed.groupBy("__id", "__text").count().where(F.col("count") > ALIKE).select("__id", "__text"))
    if many.isEmpty():
        return docs.withColumn("__copy", F.lit(0).cast("long"))
    again = numbered(keyed.join(many, ["__id", "__text"], "left_semi"), ["__id", "__text"], "__n", path)
    first = again.groupBy("__id", "__text").agg(F.min("__n").alias("__first"))
    again = again.join(first, ["__id", "__text"]).withColumn("__copy", F.col("__n") - F.col("__first"))
    once = keyed.join(many, ["__id", "__text"], "left_anti").withColumn("__copy", F.lit(0).cast("long"))
    columns = [*(f"`{c}`" for c in docs.columns), "__copy"]
    return once.select(columns).union(again.select(columns))


def loads(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(vslot, size) of the records -> (vslot, n, bytes) of every slot, empty ones included."""
    spark = records.sparkSession
    found = records.groupBy("vslot").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return spark.range(slots).withColumnRenamed("id", "vslot").join(found, "vslot", "left").select("vslot", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def assign(rows: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """First map: slots in descending order of bytes, each to the shard with the fewest bytes so far."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot, size in sorted(rows, key=lambda r: (-r[1], r[0])):
        load, s = heapq.heappop(heap)
        out[slot] = s
        heapq.heappush(heap, (load + size, s))
    return out


def rebalance(old: dict[int, int], rows: list[tuple[int, int]], shards: int, slack: float = 0.01) -> dict[int, int]:
    """Edits a map for new loads or more shards, moving few bytes: from shards above the mean to the lightest one.

    Slots of shards that no longer exist move first; then each overfull shard gives its largest slot that fits into
    the room of the lightest shard, until all lie within ``slack`` of the mean or no move helps.
    """
    size = dict(rows)
    out = dict(old)
    load = [0] * shards
    for slot, s in out.items():
        if s < shards:
            load[s] += size.get(slot, 0)
    for slot in sorted((k for k, s in out.items() if s >= shards), key=lambda k: (-size.get(k, 0), k)):
        out[slot] = s = min(range(shards), key=lambda i: (load[i], i))
        load[s] += size.get(slot, 0)
    mean = sum(load) / shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, s in out.items():
        held[s].append((size.get(slot, 0), slot))
    while True:
        full, low = max(range(shards), key=lambda i: (load[i], -i)), min(range(shards), key=lambda i: (load[i], i))
        if load[full] <= mean * (1 + slack) and load[low] >= mean * (1 - slack):
            return out
        fits = [x for x in held[full] if 0 < x[0] < load[full] - load[low]]
        if not fits:
            return out
        # the move that brings the two closest together
        best = min(fits, key=lambda x: (abs(load[full] - load[low] - 2 * x[0]), x[1]))
        held[full].remove(best)
        held[low].append(best)
        load[full] -= best[0]
        load[low] += best[0]
        out[best[1]] = low


class SlotMap:
    """Versions of a slot-to-shard map in a shared folder: one Parquet table per version, never overwritten."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def write(self, version: int, shards: int, loads: DataFrame, old: dict[int, int] | None = None) -> DataFrame:
        """Makes a version from the loads of all slots (a fixed number of rows) and stores it."""
        rows = [(r["vslot"], r["n"], r["bytes"]) for r in loads.collect()]
        sizes = [(s, b) for s, _, b in rows]
        to = rebalance(old, sizes, shards) if old else assign(sizes, shards)
        upto = dict.fromkeys(range(shards), 0)
        out = []
        for s, n, b in sorted(rows):
            out.append((version, shards, s, to[s], upto[to[s]], n, b))
            upto[to[s]] += n
        self.spark.createDataFrame(out, "version int, shards int, vslot long, shard int, first_row long, n long, bytes long").coalesce(1).write.parquet(f"{self.path}/version={version:06d}")
        return self.read(version)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={version:06d}").drop("version")

    def shards_of(self, version: int) -> dict[int, int]:
        return {r[0]: r[1] for r in self.read(version).select("vslot", "shard").collect()}


def shard(docs: DataFrame, path: str, shards: int = 40, slots: int = SLOTS, version: int = 1, old: dict[int, int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``size``, ``vslot``, ``shard`` and ``slot``, the place within the shard (0, 1, ...).

    Records are hashed into ``slots`` fixed virtual slots; the bytes of each slot decide which shard holds it, by a map
    stored under ``path`` as ``version`` (edited from ``old`` where given). Null ids and texts hash like values, rows
    that repeat both id and text are spread over the slots by their number among themselves, an empty table has an
    empty result. Columns of ``docs`` with the added names are replaced.
    """
    added = ("size", "vslot", "shard", "slot")
    d = numbered_copies(docs.drop(*added), id_col, text_col, f"{path}/copies")
    d = d.withColumn("size", size_of(F.col(text_col))).withColumn("vslot", slot_of(F.col(id_col), F.col(text_col), slots, F.col("__copy"))).drop("__copy")
    m = SlotMap(docs.sparkSession, path).write(version, shards, loads(d.select("vslot", "size"), slots), old).select("vslot", "shard", "first_row")
    at = F.row_number().over(W.partitionBy("vslot").orderBy(id_col, F.xxhash64(text_col)))
    return d.join(F.broadcast(m), "vslot").withColumn("slot", F.col("first_row") + at - 1).drop("first_row")
