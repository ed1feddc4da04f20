"""Operators over caption and cue tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tickloom.functions.timebase import col, snap_nearest
from tickloom.operators.ordered import INDEX_CHUNK, NONE, each_group, following, scan, sum_before
from tickloom.session import cut_lineage

MS = 254_016_000


#: Cues that one task walks at a time.
CUES = 8192


def _walk_cues(start: list[int], end: list[int], at: tuple[int, int] | None) -> tuple[list[int], list[bool], tuple[int, int] | None]:
    """The left-to-right rule over sorted cues after a last kept cue ``at`` (start, end): starts, which are kept, the last kept one.

    A cue that starts behind the last one's start stays, and will cut that one off; one that does not begins where the
    last one ends, if it lasts longer, else it is dropped.
    """
    start, kept, last = list(start), [], at
    for i, (a, b) in enumerate(zip(start, end, strict=True)):
        if last is None or a > last[0]:
            last = (a, b)
        elif b > last[1]:
            start[i] = last[1]
            last = (last[1], b)
        else:
            kept.append(False)
            continue
        kept.append(True)
    return start, kept, last


def normalize_cues(cues: DataFrame, key: str = "track_id", ft=None, chunk: int = CUES) -> tuple[DataFrame, DataFrame]:
    """Cues sorted and without overlaps; second result: the cues dropped on the way.

    The rule needs the last kept cue only, and forgets it at the first cue that starts behind it. So cues are cut into
    chunks by their number in the track; every chunk is walked from a guess of what came before, and again only where
    the chunk before it turns out to end otherwise. Usually the second round finds nothing left to do; a run of
    overlaps over many chunks takes a round for each of them that it decides.
    """
    if ft is not None:
        cues = cues.withColumns({"start": snap_nearest("start", ft), "end": F.greatest(snap_nearest("end", ft), snap_nearest("start", ft) + col(ft))})
    cols = cues.columns
    order = ["start", "end", "cue_id"]
    s = scan(cues.filter("end > start"), [key], order, _i=sum_before(F.lit(1).cast("long")))
    s = cut_lineage(s.withColumn("_k", F.call_function("div", "_i", F.lit(chunk))))
    kind = s.schema[key].dataType.simpleString()
    state = f"{key} {kind}, _k long, s long, e long, xs long, xe long"
    none = F.lit(None).cast("long")
    known = lambda entries: entries.select(key, "_k", *[F.coalesce(c, F.lit(NONE)).alias(c) for c in ("s", "e")])

    def chunks_from(entries: DataFrame) -> DataFrame:
        """Exit of the chunks that ``entries`` names, from the entry given there."""

        def walk(pdf: pd.DataFrame, groups: list[tuple[int, int]]) -> pd.DataFrame:
            start, end, s0, e0 = (pdf[c].tolist() for c in ("start", "end", "s", "e"))
            last = [_walk_cues(start[a:b], end[a:b], None if s0[a] == NONE else (s0[a], e0[a]))[2] or (NONE, NONE) for a, b in groups]
            return pdf.iloc[[a for a, _ in groups]][[key, "_k", "s", "e"]].assign(xs=[x for x, _ in last], xe=[x for _, x in last])

        j = s.select(key, "_k", "_i", "start", "end").join(known(entries), [key, "_k"])
        out = each_group(j, [key, "_k"], ["_i"], walk, state)
        return cut_lineage(out.withColumns({c: F.nullif(c, F.lit(NONE)) for c in ("s", "e", "xs", "xe")}))

    done = chunks_from(s.select(key, "_k").distinct().select(key, "_k", none.alias("s"), none.alias("e")))
    while True:
        # what the chunk before leaves; the first chunk of a track has nothing before it
        before = done.select(key, (F.col("_k") + 1).alias("_k"), F.col("xs").alias("s1"), F.col("xe").alias("e1"))
        moved = cut_lineage(done.join(before, [key, "_k"]).filter(~(F.col("s").eqNullSafe(F.col("s1")) & F.col("e").eqNullSafe(F.col("e1")))).select(key, "_k", F.col("s1").alias("s"), F.col("e1").alias("e")))
        if moved.isEmpty():
            break
        done = cut_lineage(done.join(moved, [key, "_k"], "left_anti").unionByName(chunks_from(moved)))
    schema = s.select(*cols, "_i", F.lit(True).alias("kept")).schema

    def apply(pdf: pd.DataFrame, groups: list[tuple[int, int]]) -> pd.DataFrame:
        start, end, s0, e0 = (pdf[c].tolist() for c in ("start", "end", "_s0", "_e0"))
        walked = [_walk_cues(start[a:b], end[a:b], None if s0[a] == NONE else (s0[a], e0[a])) for a, b in groups]
        return pdf.assign(start=[x for w in walked for x in w[0]], kept=[x for w in walked for x in w[1]])[[*cols, "_i", "kept"]]

    ruled = each_group(s.join(known(done).withColumnsRenamed({"s": "_s0", "e": "_e0"}), [key, "_k"]), [key, "_k"], ["_i"], apply, schema)
    ruled = cut_lineage(ruled)
    # a kept cue is cut off by the next one, in whichever chunk that is
    good = scan(ruled.filter("kept"), [key], ["_i"], INDEX_CHUNK, _cut=following("start"))
    good = good.withColumn("end", F.least("end", F.coalesce("_cut", "end"))).select(cols)
    return good, ruled.filter(~F.col("kept")).select(key, "cue_id")


def merge_captions(captions: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Consecutive captions of one group ``(caption_id, group_id)`` become one; others are refused.

    A group is a user's selection of neighbouring captions, so its joined text is one value.
    """
    c = scan(captions, ["track_id"], ["start", "caption_id"], pos=sum_before(F.lit(1).cast("long")))
    c = c.join(groups, "caption_id", "left")
    picked = c.filter("group_id is not null")
    agg = picked.groupBy("group_id").agg(
        F.min("pos").alias("p0"), F.max("pos").alias("p1"), F.count("*").alias("n"), F.min("track_id").alias("t0"), F.max("track_id").alias("track_id"),
        F.min_by("caption_id", "pos").alias("caption_id"), F.min("start").alias("start"), F.max_by(F.col("start") + F.col("duration"), "pos").alias("end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("pos", F.trim("text").alias("t"))))), lambda x: x["t"]), "\n").alias("text"),
    )
    fine = (F.col("p1") - F.col("p0") + 1 == F.col("n")) & (F.col("t0") == F.col("track_id")) & (F.col("n") >= 2)
    merged = agg.filter(fine).select("track_id", "caption_id", "start", (F.col("end") - F.col("start")).alias("duration"), "text")
    refused = agg.filter(~fine).select("group_id")
    cols = ["track_id", "caption_id", "start", "duration", "text"]
    # captions of no group stay out of the join by group: they would all meet in one task
    kept = picked.join(agg.filter(fine).select("group_id"), "group_id", "left_anti")
    return c.filter("group_id is null").select(cols).unionByName(kept.select(cols)).unionByName(merged), refused


def clock(t, sep: str):
    """``HH:MM:SS<sep>mmm`` rounded to the nearest millisecond."""
    from tickloom.functions.timebase import idiv

    ms = idiv(F.greatest(col(t), F.lit(0)) + MS // 2, F.lit(MS))
    h = idiv(ms, F.lit(3_600_000))
    part = lambda n, m: idiv(ms, F.lit(n)) % m
    hh = F.when(h >= 100, h.cast("string")).otherwise(F.lpad(h.cast("string"), 2, "0"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(hh, F.lit(":"), two(part(60_000, 60)), F.lit(":"), two(part(1000, 60)), F.lit(sep), F.lpad((ms % 1000).cast("string"), 3, "0"))
