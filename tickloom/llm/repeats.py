"""Shared parts of the repeated-passage operators: sampled positions, repeated keys, and the cutting of texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import BYTE_CODES, mix, powers, prefix_sums, span_hash, word_spans
from tickloom.session import shared_folder

U64 = np.uint64
#: Windows that are looked at together; a longer text is cut into blocks of so many, overlapping by a window.
BLOCK = 1 << 20
#: Largest table of row keys (8 bytes a row) that is sent to every executor to spare the texts a shuffle.
SENT = 2_000_000
_LOW = U64((1 << 22) - 1)
#: Bytes of an Arrow batch.
BATCH = 8 << 20


def small_batches(spark) -> None:
    """Texts go to Python in Arrow batches of a few megabytes, since both sides hold a batch several times over."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = str(spark.conf.get(name, "64m")).lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(size[-1:], 0)
    size = int(size.rstrip("kmg")) << unit
    if size <= 0 or size > BATCH:
        spark.conf.set(name, str(BATCH))


class Kept:
    """Tables written once to the shared folder, column by column, and deleted when they have served."""

    def __init__(self, like: DataFrame) -> None:
        self.spark = like.sparkSession
        small_batches(self.spark)
        self.folder = f"{shared_folder(self.spark)}/tickloom-repeats-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def drop(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def row_key(doc_id: Column, text: Column) -> Column:
    """A row's key; rows that repeat both id and text share it, and with it their spans."""
    return F.xxhash64(F.lit(3), doc_id, text)


def byte_codes(text: bytes) -> np.ndarray:
    return BYTE_CODES[np.frombuffer(text, np.uint8)]


def word_codes(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    start, end = word_spans(raw)
    return span_hash(prefix_sums(BYTE_CODES[raw]), start, end) if len(start) else np.zeros(0, U64)


def grams(sums: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` codes."""
    n = len(sums) - k
    return mix((sums[k:] - sums[:-k]) * powers(n)[1][:n])


def _owners(g: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest, then leftmost, of ``width`` consecutive hashes, for each start."""
    low, span = (g & ~_LOW) | np.arange(len(g), dtype=U64), 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    return (low & _LOW).astype(np.int64)


def anchors(codes: np.ndarray, window: int, k: int, first: int = 0, stop: int | None = None) -> Iterator[tuple]:
    """Samples the ``k``-grams of a sequence so that each window of ``window`` codes owns one of its own ``k``-grams.

    A window owns its ``k``-gram with the smallest hash, the leftmost of equal ones, so equal windows own equal grams at
    the same place, wherever they stand. Yields for each block (position, gram hash, first window, number of windows,
    sums, base): consecutive windows that own the same gram are one row.
    """
    stop = len(codes) - window + 1 if stop is None else stop
    for at in range(first, stop, BLOCK):
        n = min(BLOCK, stop - at)
        sums = prefix_sums(codes[at : at + n + window - 1])
        g = grams(sums, k)
        own = _owners(g, window - k + 1)
        cut = np.flatnonzero(own[1:] != own[:-1]) + 1
        lo = np.concatenate(([0], cut))
        count = np.diff(np.concatenate((lo, [n])))
        yield own[lo], g[own[lo]], lo, count, sums, at


def joined_anchors(codes: np.ndarray, size: np.ndarray, count: np.ndarray, window: int, k: int) -> tuple:
    """``anchors`` of many short sequences laid end to end: the first ``count`` windows of each, which has ``size`` codes.

    Returns (sequence, gram hash, first window within the sequence, number of windows, content hash).
    """
    sums = prefix_sums(codes)
    g = grams(sums, k)
    off = np.cumsum(size) - size
    m = len(codes) - window + 1
    which = np.repeat(np.arange(len(size)), size)[:m]
    valid = np.arange(m) - off[which] < count[which]
    own = _owners(g, window - k + 1)
    cut = np.flatnonzero((own[1:] != own[:-1]) | (which[1:] != which[:-1]) | (valid[1:] != valid[:-1])) + 1
    lo = np.concatenate(([0], cut))
    n = np.diff(np.concatenate((lo, [m])))
    keep = valid[lo]
    lo, n = lo[keep], n[keep]
    return which[lo], g[own[lo]], lo - off[which[lo]], n, span_hash(sums, lo, lo + n - 1 + window)


def repeated(kept: Kept, name: str, df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows whose ``key`` (a long) occurs at least twice.

    One range shuffle on (key, order) and a sort: a row is repeated if a neighbour has its key, and a key with any share
    of all rows spreads over as many partitions as it fills. What the ends of two partitions must tell each other is
    at most four rows of each partition.
    """
    cols = df.columns

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, before, first, sure = None, None, None, {}

        def judged(x: pd.DataFrame, twice: np.ndarray) -> pd.DataFrame:
            kind = np.where(twice, 1, np.where(x[key].to_numpy() == first, 0, -1)).astype(np.int8)
            return x.assign(kind=kind)[kind >= 0]

        for b in batches:
            if not len(b):
                continue
            x = b[cols] if held is None else pd.concat([held, b[cols]], ignore_index=True)
            k = x[key].to_numpy()
            first = k[0] if first is None else first
            same = k[1:] == k[:-1]
            twice = np.concatenate(([before is not None and before == k[0]], same))[:-1] | same
            sure[first] = sure.get(first, False) or bool(twice[k[:-1] == first].any())
            if len(k) > 1:
                yield judged(x.iloc[:-1], twice)
                before = k[-2]
            held = x.iloc[-1:].reset_index(drop=True)
        if held is not None:
            last = held[key].iloc[0]
            twice = before is not None and before == last
            marks = [k for k, ok in sure.items() if ok and k != last]
            # the last row is unsure unless a neighbour has its key; keys at either end say if they are repeated there
            yield held.assign(kind=np.int8(1 if twice else 0))
            out = pd.concat([held] * (len(marks) + int(twice)), ignore_index=True) if marks or twice else held.iloc[:0]
            out[key] = marks + [last] * int(twice)
            yield out.assign(kind=np.int8(2))

    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", kind byte"
    t = kept.keep(df.repartitionByRange(key, *order).sortWithinPartitions(key).mapInPandas(mark, schema), name)
    edge = t.where("kind <> 1").groupBy(key).agg(F.sum(F.when(F.col("kind") == 2, 2).otherwise(1)).alias("s")).where("s >= 2").select(F.col(key).alias("__k"))
    unsure = t.where("kind = 0").join(edge, F.col(key) == F.col("__k"), "left_semi")
    return t.where("kind = 1").union(unsure).drop("kind")


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``n`` positions lie in any of the ranges."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


def with_lists(docs: DataFrame, lists: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Documents (rk, ...) that have rows in ``lists`` (rk, ...), with those as arrays ``f_<column>``; and the others.

    If the keys of those documents are few enough to be sent around, only their texts are shuffled; else all are.
    """
    found = lists.groupBy("rk").agg(*listed(columns))
    ids = lists.select(F.col("rk").alias("k_rk")).distinct()
    if ids.count() <= SENT:
        ids = F.broadcast(ids)
    have = docs.join(ids, F.col("rk") == F.col("k_rk"), "left_semi").join(found, "rk")
    return have, docs.join(ids, F.col("rk") == F.col("k_rk"), "left_anti")


def listed(columns: list[str]) -> list[Column]:
    """Arrays of the columns of a group, all in the same order of its rows."""
    return [F.collect_list(F.coalesce(F.col(c).cast("long"), F.lit(0))).alias(f"f_{c}") for c in columns]


class Rows:
    """Arrays gathered from many documents, made into one frame when they are many."""

    def __init__(self, *columns: str, most: int = 1 << 17) -> None:
        self.columns, self.most, self.rows, self.size = columns, most, [], 0

    def add(self, n: int, *values: np.ndarray | int) -> bool:
        """Takes ``n`` rows; true if it is time to ``take`` them."""
        if n:
            self.rows.append([v if isinstance(v, np.ndarray) else np.full(n, v) for v in values])
            self.size += n
        return self.size >= self.most

    def take(self) -> pd.DataFrame:
        out = pd.DataFrame({c: np.concatenate([r[i] for r in self.rows]) if self.rows else np.zeros(0, np.int64) for i, c in enumerate(self.columns)})
        self.rows, self.size = [], 0
        return out


def cut(docs: DataFrame, spans: DataFrame, render: Callable[[bytes, np.ndarray, np.ndarray], tuple], schema: str) -> DataFrame:
    """Applies ``render(text, starts, ends)`` to every document (rk, id, text) with its spans (rk, start, stop)."""
    have, none = with_lists(docs, spans, ["start", "stop"])

    none_found, names = np.zeros(0, np.int64), [c.split()[0] for c in f"id long, {schema}".split(", ")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans_of = zip(b["f_start"], b["f_stop"], strict=True) if "f_start" in b else ((none_found, none_found) for _ in range(len(b)))
            out = [(i, *render(t or b"", *s)) for i, t, s in zip(b["id"], b["text"], spans_of, strict=True)]
            yield pd.DataFrame(out, columns=names).astype({"id": "Int64"})

    put = lambda df: df.mapInPandas(each, f"id long, {schema}")
    return put(have.select("id", "text", "f_start", "f_stop")).union(put(none.select("id", "text")))
