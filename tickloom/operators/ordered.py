"""Ordered scans that survive a hot key.

A plain ``Window.partitionBy(key)`` puts every row of a key in one task. Here each key is cut into
chunks of its order column; the window runs inside (key, chunk), one summary row per chunk is
carried across chunks, and the carry is joined back. Only chunk summaries ever meet per key.
Keys and the chunk column must not be null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tickloom.functions.timebase import TPS, col, fdiv
from tickloom.session import cut_lineage

TIME_CHUNK = 600 * TPS
INDEX_CHUNK = 4096


@dataclass(frozen=True)
class Step:
    how: str
    expr: Column


def prev(x) -> Step:
    """Value in the row before."""
    return Step("prev", col(x))


def following(x) -> Step:
    """Value in the row after."""
    return Step("next", col(x))


def sum_before(x) -> Step:
    return Step("sum_before", col(x))


def sum_upto(x) -> Step:
    return Step("sum_upto", col(x))


def max_before(x) -> Step:
    return Step("max_before", col(x))


def max_upto(x) -> Step:
    return Step("max_upto", col(x))


def last_upto(x) -> Step:
    """Last non-null value up to this row."""
    return Step("last_upto", col(x))


def last_before(x) -> Step:
    return Step("last_before", col(x))


def first_from(x) -> Step:
    """First non-null value from this row on."""
    return Step("first_from", col(x))


def first_after(x) -> Step:
    return Step("first_after", col(x))


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk=TIME_CHUNK, **steps: Step) -> DataFrame:
    """Add one column per step, ordered by ``order`` inside ``keys``.

    ``chunk`` is a width for the first order column or a ready chunk expression that never falls
    while the order rises.
    """
    keys = list(keys)
    cut = fdiv(order[0], F.lit(chunk)) if isinstance(chunk, int) else chunk
    # an earlier join or grouping on the keys would satisfy the windows below with all chunks of a key in one task
    df = df.withColumn("_c", cut).repartition(*keys, "_c")
    inside = W.partitionBy(*keys, "_c").orderBy(*order)
    up, before = inside.rowsBetween(W.unboundedPreceding, 0), inside.rowsBetween(W.unboundedPreceding, -1)
    down, after = inside.rowsBetween(0, W.unboundedFollowing), inside.rowsBetween(1, W.unboundedFollowing)
    across = W.partitionBy(*keys).orderBy("_c")
    earlier, later = across.rowsBetween(W.unboundedPreceding, -1), across.rowsBetween(1, W.unboundedFollowing)
    place = F.struct(*order)
    local, summary, carry, final = {}, {}, {}, {}
    for name, step in steps.items():
        x, box = step.expr, F.struct(step.expr.alias("v"))
        here, s, k = f"_l_{name}", f"_s_{name}", f"_k_{name}"
        mine, got = F.col(here), F.col(k)
        if step.how in ("prev", "next"):
            back = step.how == "prev"
            local[here] = (F.lag if back else F.lead)(box).over(inside)
            summary[s] = (F.max_by if back else F.min_by)(box, place)
            carry[k] = (F.lag if back else F.lead)(s).over(across)
            final[name] = F.coalesce(mine, got)["v"]
        elif step.how.startswith("sum"):
            local[here] = F.sum(x).over(up if step.how == "sum_upto" else before)
            summary[s] = F.sum(x)
            carry[k] = F.sum(s).over(earlier)
            final[name] = F.when(mine.isNull(), F.coalesce(got, F.lit(0))).otherwise(mine + F.coalesce(got, F.lit(0)))
        elif step.how.startswith("max"):
            local[here] = F.max(x).over(up if step.how == "max_upto" else before)
            summary[s] = F.max(x)
            carry[k] = F.max(s).over(earlier)
            final[name] = F.greatest(mine, got)
        elif step.how.startswith("last"):
            local[here] = F.last(x, ignorenulls=True).over(up if step.how == "last_upto" else before)
            summary[s] = F.max_by(x, F.when(x.isNotNull(), place))
            carry[k] = F.last(s, ignorenulls=True).over(earlier)
            final[name] = F.coalesce(mine, got)
        else:
            local[here] = F.first(x, ignorenulls=True).over(down if step.how == "first_from" else after)
            summary[s] = F.min_by(x, F.when(x.isNotNull(), place))
            carry[k] = F.first(s, ignorenulls=True).over(later)
            final[name] = F.coalesce(mine, got)
    kept = [c for c in df.columns if c not in final and c != "_c"]
    carried = df.groupBy(*keys, "_c").agg(*[v.alias(n) for n, v in summary.items()]).select(*keys, "_c", *[v.alias(n) for n, v in carry.items()])
    # most keys have one chunk and nothing to carry: the left join gives the same nulls, and those rows need not travel
    carried = carried.filter(F.coalesce(*[F.when(F.col(n).isNotNull(), True) for n in carry], F.lit(False)))
    rows = df.select("*", *[v.alias(n) for n, v in local.items()])
    # rows lie as a merge join needs them; a broadcast would bring every key's summary to the driver where sizes are estimated low
    return rows.join(carried.hint("merge"), [*keys, "_c"], "left").select(*kept, *[v.alias(n) for n, v in final.items()])


def islands(df: DataFrame, keys, order, starts: Column, name: str = "island", chunk=TIME_CHUNK) -> DataFrame:
    """Number runs of rows; ``starts`` is true on the first row of a run."""
    return scan(df, keys, order, chunk, **{name: sum_upto(F.when(starts, 1).otherwise(0).cast("long"))})


#: Stands for null in columns of whole numbers on their way to pandas, which would make them floating point.
NONE = -(1 << 63)


def each_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[pd.DataFrame, list[tuple[int, int]]], pd.DataFrame], schema) -> DataFrame:
    """``fn(rows, groups)`` over whole groups of ``keys`` sorted by ``order``, many small ones in a call.

    ``groups`` are the (first, end) row numbers of each. A call for every group costs some ten milliseconds, however
    small it is; here a task's rows pass batch by batch, and only a group left open at the end of one waits for the next.
    """
    keys = list(keys)
    names = df.columns

    def firsts(pdf: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(pdf), bool)
        new[0] = True
        for k in keys:
            v = pdf[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    def call(parts: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(parts, ignore_index=True)
        at = firsts(pdf).tolist()
        return fn(pdf[names], list(zip(at, [*at[1:], len(pdf)], strict=True)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for pdf in batches:
            if not len(pdf):
                continue
            last = int(firsts(pdf)[-1])
            goes_on = held and all(held[-1][k].iloc[-1] == pdf[k].iloc[0] for k in keys)
            if last == 0 and goes_on:
                held.append(pdf)
                continue
            if held or last:
                yield call([*held, pdf.iloc[:last]])
            held = [pdf.iloc[last:]]
        if held:
            yield call(held)

    # after a join on the keys the repartition costs nothing, but also binds nothing: a join turned into a broadcast while
    # it runs would deal the rows anew. The window holds Spark to whole groups, in the order it sorts by.
    whole = df.repartition(*keys).withColumn("_row", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return whole.sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def orbit(df: DataFrame, keys: Sequence[str], pos: str = "pos", nxt: str = "nxt", chunk: int = 8192) -> DataFrame:
    """Positions visited by the walk ``pos -> nxt`` from the least position of each key.

    Left-to-right greedy rules become such a walk once every row knows where the next choice would
    be if the walk came by. Chunks of positions are folded to the pairs (gate, gate of a later chunk), where gates are
    the positions entered from another chunk; the walk over the gates gives one entry per chunk, from which each chunk
    is walked on its own. Gates of one key that fit a chunk are walked in one task, more of them by pointer doubling,
    so no task ever sees more than a chunk. ``nxt`` must be a larger position that exists, or null at the end.
    """
    keys = list(keys)
    base = cut_lineage(df.select(*keys, F.col(pos).cast("long").alias("_p"), F.col(nxt).cast("long").alias("_n")))
    chunked = base.withColumn("_c", fdiv("_p", F.lit(chunk)))
    firsts = base.groupBy(*keys).agg(F.min("_p").alias("_p"))
    gates = _fold(chunked, firsts, keys, chunk)
    most = gates.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    entries = _visit(gates.withColumn("_c", F.lit(0).cast("long")), firsts, keys) if most <= chunk else _doubled(gates, firsts, keys)
    return _visit(chunked, entries, keys).select(*keys, F.col("_p").alias(pos))


def _fold(chunked: DataFrame, firsts: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    """(_p, _n) of every gate: where a walk that enters a chunk at ``_p`` enters a later chunk."""
    crossed = chunked.filter(fdiv("_n", F.lit(chunk)) > F.col("_c")).select(*keys, F.col("_n").alias("_p")).union(firsts.select(*keys, "_p")).distinct()
    marked = chunked.join(crossed.withColumn("_g", F.lit(True)), [*keys, "_p"], "left")
    marked = marked.withColumns({"_g": F.coalesce("_g", F.lit(False)), "_n": F.coalesce("_n", F.lit(NONE))})

    def fold(pdf: pd.DataFrame, groups: list[tuple[int, int]]) -> pd.DataFrame:
        p, n = pdf["_p"].tolist(), pdf["_n"].tolist()
        for a, b in groups:
            # where the walk from each position leaves the chunk, last position first
            leaves = {}
            for r in range(b - 1, a - 1, -1):
                leaves[p[r]] = n[r] = leaves.get(n[r], n[r])
        return pdf.assign(_n=np.array(n, dtype=np.int64)).loc[pdf["_g"], [*keys, "_p", "_n"]]

    schema = T.StructType([*[chunked.schema[k] for k in keys], T.StructField("_p", T.LongType()), T.StructField("_n", T.LongType())])
    return cut_lineage(each_group(marked, [*keys, "_c"], ["_p"], fold, schema).withColumn("_n", F.nullif("_n", F.lit(NONE))))


def _visit(chunked: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """Positions visited inside each (key, chunk) from its entries."""
    reached = T.StructType([*[chunked.schema[k] for k in keys], T.StructField("_p", T.LongType())])

    def step(pdf: pd.DataFrame, groups: list[tuple[int, int]]) -> pd.DataFrame:
        p, n, entered = pdf["_p"].tolist(), pdf["_n"].tolist(), pdf["_e"].tolist()
        seen = np.zeros(len(pdf), bool)
        for a, b in groups:
            at = {p[r]: r for r in range(a, b)}
            for r in range(a, b):
                if entered[r]:
                    while r is not None and not seen[r]:
                        seen[r] = True
                        r = at.get(n[r])
        return pdf.loc[seen, [*keys, "_p"]]

    joined = chunked.join(entries.withColumn("_e", F.lit(True)), [*keys, "_p"], "left")
    joined = joined.withColumns({"_e": F.coalesce("_e", F.lit(False)), "_n": F.coalesce("_n", F.lit(NONE))})
    return each_group(joined, [*keys, "_c"], ["_p"], step, reached)


def _doubled(gates: DataFrame, firsts: DataFrame, keys: list[str]) -> DataFrame:
    """Gates reached from the first ones: each round reaches twice as far, so a walk of n gates takes log2(n) rounds of two joins."""
    reach, jump = firsts.select(*keys, "_p"), gates.filter("_n is not null")
    while True:
        reach = cut_lineage(reach.union(reach.join(jump, [*keys, "_p"]).select(*keys, F.col("_n").alias("_p"))).distinct())
        jump = cut_lineage(jump.join(jump.select(*keys, F.col("_p").alias("_n"), F.col("_n").alias("_m")), [*keys, "_n"]).select(*keys, "_p", F.col("_m").alias("_n")))
        if jump.isEmpty():
            return reach
