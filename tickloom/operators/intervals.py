"""Half-open range algebra over (start, end) LONG columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tickloom.functions.timebase import TPS, col, fdiv
from tickloom.session import cut_lineage
from tickloom.operators.ordered import TIME_CHUNK, following, islands, last_upto, max_before, scan

LEVELS = (10 * TPS, 600 * TPS, 36_000 * TPS)
#: Class bounds of disjoint ranges: one of them lies in 65 buckets at most, and all of a key in no more than its length has.
DISJOINT = tuple(64 * w for w in LEVELS)


def item_at(points: DataFrame, spans: DataFrame, keys: Sequence[str], t: str = "t", start: str = "start", end: str = "end", name: str = "span", outer: bool = True, chunk=TIME_CHUNK) -> DataFrame:
    """Attach to each point the span that covers it; spans of one key must not overlap.

    One union and one ordered scan, no range join.
    """
    keys = list(keys)
    body = F.struct(*[F.col(c) for c in spans.columns])
    point = F.struct(*[F.col(c) for c in points.columns])
    a = points.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_k"), point.alias("_pt"), F.lit(None).cast(spans.select(body.alias("s")).schema["s"].dataType).alias("_sp"))
    b = spans.select(*keys, F.col(start).alias("_t"), F.lit(0).alias("_k"), F.lit(None).cast(points.select(point.alias("p")).schema["p"].dataType).alias("_pt"), body.alias("_sp"))
    hit = scan(a.unionByName(b), keys, ["_t", "_k"], chunk, _hit=last_upto("_sp")).filter("_k = 1")
    covered = F.when(F.col("_hit")[end] > F.col("_t"), F.col("_hit"))
    out = hit.select("_pt.*", covered.alias(name))
    return out if outer else out.filter(F.col(name).isNotNull())


def _class(start: Column, end: Column, levels: Sequence[int]) -> Column:
    """Number of the width class of a range."""
    last = len(levels) - 1
    mine = F.lit(last)
    for i in range(last - 1, -1, -1):
        mine = F.when(end - start <= F.lit(levels[i]), F.lit(i)).otherwise(mine)
    return mine


def classes_of(df: DataFrame, start: str = "start", end: str = "end", levels: Sequence[int] = LEVELS) -> list[int]:
    """The width classes that ``df`` has: one pass over its two columns, so for stored tables only."""
    return sorted(r[0] for r in df.select(_class(F.col(start), F.col(end), levels).alias("c")).distinct().collect())


def _bucketed(df: DataFrame, start: Column, end: Column, levels: Sequence[int], own: str, other: str, first: str, partners: Sequence[int] | None, bounds: Sequence[int] | None = None) -> DataFrame:
    """One row per width class of a partner and bucket the range touches at the wider class of the two."""
    # a side without rows has no class; any will do
    others = list(range(len(levels)) if partners is None else partners) or [0]
    df = df.withColumn(own, _class(start, end, bounds or levels)).withColumn(other, F.explode(F.array(*[F.lit(i) for i in others])))
    width = F.element_at(F.array(*[F.lit(w) for w in levels]), F.greatest(own, other) + 1)
    stop = F.greatest(end - 1, start)
    return df.withColumn(first, fdiv(start, width)).withColumn("_b", F.explode(F.sequence(F.col(first), fdiv(stop, width))))


def overlap_join(a: DataFrame, b: DataFrame, keys: Sequence[str], a_range: tuple[str, str] = ("start", "end"), b_range: tuple[str, str] = ("b_start", "b_end"), levels: Sequence[int] = LEVELS, a_classes: Sequence[int] | None = None, b_classes: Sequence[int] | None = None, b_bounds: Sequence[int] | None = None) -> DataFrame:
    """All pairs whose ranges overlap, with ``lo``/``hi`` the common part.

    Equi join on (keys, width class of a, width class of b, bucket): for each class a partner may
    have, a range is bucketed at the wider of the two, so two short ranges only meet in a short
    bucket, however many long ones there are. A pair is kept in its first common bucket and so
    appears once; a very long range costs few rows. Column names of the sides must differ apart
    from ``keys``. ``a_classes`` and ``b_classes`` name the width classes that a side has (``classes_of``); the
    other side is then not copied for classes that nobody has. ``b_bounds`` are the largest widths of the classes of b
    where they are not ``levels``: wider ones put a range of b in more buckets and save the copies of a for its class.
    """
    keys = list(keys)
    left = _bucketed(a, F.col(a_range[0]), F.col(a_range[1]), levels, "_ao", "_bo", "_af", b_classes)
    right = _bucketed(b, F.col(b_range[0]), F.col(b_range[1]), levels, "_bo", "_ao", "_bf", a_classes, b_bounds)
    joined = left.join(right, [*keys, "_ao", "_bo", "_b"]).filter(
        (F.col("_b") == F.greatest("_af", "_bf"))
        & (F.col(a_range[0]) < F.col(b_range[1]))
        & (F.col(b_range[0]) < F.col(a_range[1]))
    )
    rest = [c for c in a.columns if c not in keys] + [c for c in b.columns if c not in keys]
    return joined.select(*keys, *rest, F.greatest(a_range[0], b_range[0]).alias("lo"), F.least(a_range[1], b_range[1]).alias("hi"))


def gaps(spans: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Empty time from 0 up to each next range; nothing after the last one."""
    s = scan(spans.select(*keys, start, end), keys, [start, end], _cov=max_before(end))
    covered = F.greatest(F.coalesce("_cov", F.lit(0)), F.lit(0))
    return s.filter(F.col(start) > covered).select(*keys, covered.alias("gap_start"), F.col(start).alias("gap_end"))


def merge_ranges(ranges: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", slack=0, chunk=TIME_CHUNK) -> DataFrame:
    """Union of ranges that overlap, touch, or lie at most ``slack`` apart."""
    s = scan(ranges.select(*keys, start, end), keys, [start, end], chunk, _cov=max_before(end))
    fresh = F.col("_cov").isNull() | (F.col(start) > F.col("_cov") + col(slack))
    # of equal ranges only the first can start a run, and it has the least cover: it comes first again
    s = islands(s, keys, [start, end, "_cov"], fresh, chunk=chunk)
    return s.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def range_union(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    cols = [*keys, "start", "end"]
    return merge_ranges(a.select(cols).unionByName(b.select(cols)), keys)


def range_intersect(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Common time of two range sets; each side is merged first."""
    left = cut_lineage(merge_ranges(a, keys))
    right = cut_lineage(merge_ranges(b, keys)).withColumnsRenamed({"start": "b_start", "end": "b_end"})
    return overlap_join(left, right, keys, a_classes=classes_of(left), b_classes=classes_of(right, "b_start", "b_end")).select(*keys, F.col("lo").alias("start"), F.col("hi").alias("end"))


def subtract(a: DataFrame, b: DataFrame, keys: Sequence[str], ident: Sequence[str], merged: bool = False, a_classes: Sequence[int] | None = None) -> DataFrame:
    """Pieces of each ``a`` row outside the ``b`` ranges, as ``lo``/``hi``.

    ``ident`` names the columns that identify an ``a`` row; ``merged`` says that ``b`` is disjoint and stored already.
    """
    ident = [*keys, *[c for c in ident if c not in keys]]
    cut = (b if merged else cut_lineage(merge_ranges(b, keys))).select(*keys, "start", "end").withColumnsRenamed({"start": "b_start", "end": "b_end"})
    a = a.filter(F.col("end") > F.col("start"))
    holes = overlap_join(a, cut, keys, a_classes=a_classes, b_classes=classes_of(cut, "b_start", "b_end", DISJOINT), b_bounds=DISJOINT).drop("b_start", "b_end")
    walls = holes.unionByName(a.withColumns({"lo": F.col("end"), "hi": F.col("end")}))
    # the walls of one row are few beside the rows: summaries of their chunks would weigh as much as they do
    s = walls.withColumn("_p", F.lag("hi").over(W.partitionBy(*ident).orderBy("lo", "hi")))
    return s.withColumn("_q", F.coalesce("_p", "start")).filter("lo > _q").withColumns({"hi": F.col("lo"), "lo": F.col("_q")}).drop("_p", "_q")


def range_except(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    left = cut_lineage(merge_ranges(a, keys))
    return subtract(left, b, keys, ["start"], a_classes=classes_of(left)).select(*keys, F.col("lo").alias("start"), F.col("hi").alias("end"))


def edit_points(clips: DataFrame, keys: Sequence[str] = ("sequence_id",)) -> DataFrame:
    """Distinct clip boundaries."""
    return clips.select(*keys, F.explode(F.array(F.col("start"), F.col("start") + F.col("duration"))).alias("t")).distinct()


def timeline_check(clips: DataFrame, captions: DataFrame) -> DataFrame:
    """Overlaps with the next item and non-positive durations, one row per violation."""
    rows = clips.select(F.lit("clip").alias("kind"), "track_id", F.col("clip_id").alias("item"), "start", "duration").unionByName(
        captions.select(F.lit("caption").alias("kind"), "track_id", F.col("caption_id").alias("item"), "start", "duration")
    )
    s = scan(rows, ["kind", "track_id"], ["start", "item"], nxt=following("start"))
    found = F.array_compact(
        F.array(F.when(F.col("duration") <= 0, F.lit("empty")), F.when(F.col("start") + F.col("duration") > F.col("nxt"), F.lit("overlap")))
    )
    return s.select("kind", "track_id", "item", "start", F.explode(found).alias("problem"))
