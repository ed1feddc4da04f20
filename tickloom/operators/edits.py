"""Set-based timeline edits: an edit list applied to many sequences in one job.

Clips carry ``sequence_id, track_id, clip_id, start, duration, source_in, speed, reverse,
frame_hold``. Pieces cut off a clip get ids hashed from the clip and the cut, so a rerun gives the
same ids; ``origin`` keeps the id of the clip they came from.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from tickloom.functions.timebase import TPS, fdiv, frame_at, idiv, scaled, snap_nearest, source_out
from tickloom.operators.intervals import classes_of, gaps, item_at, merge_ranges, overlap_join, range_except, subtract
from tickloom.operators.ordered import (
    INDEX_CHUNK, following, islands, last_upto, max_before, prev, scan, sum_upto,
)
from tickloom.session import cut_lineage, shared_folder

SEQ = ["sequence_id"]
TRACK = ["sequence_id", "track_id"]


def with_end(df: DataFrame) -> DataFrame:
    return df.withColumn("end", F.col("start") + F.col("duration"))


def trim_to(df: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Cut each clip to its own ``[lo, hi)``; media time follows the cut."""
    lo_, hi_ = F.col(lo), F.col(hi)
    speed = F.abs("speed")
    src = lambda t: F.round(t.cast("double") * speed, 0).cast("long")
    head = F.when(F.col("reverse"), src(F.col("duration")) - src(hi_ - F.col("start"))).when(F.col("frame_hold").isNull(), src(lo_ - F.col("start"))).otherwise(0)
    whole = lo_ == F.col("start")
    df = df.withColumn("origin", F.col("clip_id")).withColumn("source_in", F.col("source_in") + head)
    if "link" in df.columns:
        df = df.withColumn("link", F.when(whole, F.col("link")).otherwise(F.xxhash64("link", lo)))
    df = df.withColumn("clip_id", F.when(whole, F.col("clip_id")).otherwise(F.xxhash64("clip_id", lo)))
    return df.withColumns({"start": lo_, "duration": hi_ - lo_}).drop(lo, hi, "end")


def razor(clips: DataFrame, cuts: DataFrame, keys=TRACK, tracks: DataFrame | None = None) -> DataFrame:
    """Split every clip that strictly contains a cut ``(keys, t)``; clips on locked ``tracks`` stay."""
    clips, fixed = by_lock(clips, tracks)
    c = with_end(clips)
    points = cuts.select(*keys, F.col("t").alias("b_start"), (F.col("t") + 1).alias("b_end")).distinct()
    hits = overlap_join(c, points, keys, b_classes=[0]).filter("b_start > start").withColumnsRenamed({"b_start": "_t"}).drop("b_end", "lo", "hi")
    walls = hits.unionByName(c.withColumn("_t", F.col("end")))
    s = walls.withColumn("_p", F.lag("_t").over(W.partitionBy(*keys, "clip_id").orderBy("_t")))
    out = trim_to(s.withColumns({"lo": F.coalesce("_p", "start"), "hi": F.col("_t")}).drop("_p", "_t"))
    return out if fixed is None else out.unionByName(fixed, allowMissingColumns=True)


def lift(clips: DataFrame, ranges: DataFrame, keys=SEQ, tracks: DataFrame | None = None, merged: bool = False) -> DataFrame:
    """Remove ``ranges(keys, start, end)`` and leave gaps; clips on locked ``tracks`` stay. ``merged`` ranges are disjoint."""
    clips, fixed = by_lock(clips, tracks)
    out = trim_to(subtract(with_end(clips), ranges, keys, ["clip_id"], merged))
    return out if fixed is None else out.unionByName(fixed, allowMissingColumns=True)


def removed_before(rows: DataFrame, ranges: DataFrame, keys, t: str) -> DataFrame:
    """Add ``_rm``: how much of the disjoint ``ranges`` lies before ``t`` (part of one around ``t`` included)."""
    keys = list(keys)
    body = F.struct(*[F.col(c) for c in rows.columns])
    empty = F.lit(None).cast(rows.select(body.alias("b")).schema["b"].dataType)
    long = F.lit(None).cast("long")
    a = rows.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_k"), body.alias("_b"), F.lit(0).cast("long").alias("_len"), long.alias("_s"))
    ends = ranges.select(*keys, F.col("end").alias("_t"), F.lit(0).alias("_k"), empty.alias("_b"), (F.col("end") - F.col("start")).alias("_len"), long.alias("_s"))
    starts = ranges.select(*keys, F.col("start").alias("_t"), F.lit(0).alias("_k"), empty.alias("_b"), F.lit(0).cast("long").alias("_len"), F.col("start").alias("_s"))
    mark = F.when(F.col("_k") == 0, F.struct(F.col("_s").isNotNull().alias("open"), F.col("_s").alias("s")))
    # at one instant a range end comes before the next range start
    u = a.unionByName(ends).unionByName(starts).withColumn("_o", F.col("_k") * 2 + F.when(F.col("_s").isNotNull(), 1).otherwise(0))
    s = scan(u, keys, ["_t", "_o"], _sum=sum_upto("_len"), _m=last_upto(mark)).filter("_k = 1")
    part = F.when(F.col("_m.open"), F.col("_t") - F.col("_m.s")).otherwise(0)
    return s.select("_b.*", (F.col("_sum") + part).alias("_rm"))


def shift_by(rows: DataFrame, moves: DataFrame, keys, t: str = "start") -> DataFrame:
    """Move every row by the sum of ``moves(keys, at, delta)`` at or before its ``t``."""
    keys = list(keys)
    # columns stay apart: those that nobody reads later do not travel
    a = rows.select("*", F.col(t).alias("_t"), F.lit(1).alias("_k"), F.lit(0).cast("long").alias("_d"))
    m = moves.select(*keys, F.col("at").alias("_t"), F.lit(0).alias("_k"), F.col("delta").alias("_d"))
    s = scan(a.unionByName(m, allowMissingColumns=True), keys, ["_t", "_k"], _sum=sum_upto("_d")).filter("_k = 1")
    return s.withColumn(t, F.col("_t") + F.col("_sum")).select(rows.columns)


def close_up(rows: DataFrame, ranges: DataFrame, keys=SEQ) -> DataFrame:
    """Shift rows left by the disjoint ranges that end at or before their start."""
    return shift_by(rows, ranges.select(*keys, F.col("end").alias("at"), (F.col("start") - F.col("end")).alias("delta")), keys)


def by_lock(clips: DataFrame, tracks: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Clips an edit may touch, and those on tracks that ``tracks(track_id, locked)`` calls locked."""
    if tracks is None:
        return clips, None
    locked = tracks.filter("locked").select("track_id").distinct()
    return clips.join(locked, "track_id", "left_anti"), clips.join(locked, "track_id", "left_semi").withColumn("origin", F.col("clip_id"))


def ripple_delete_ranges(clips: DataFrame, ranges: DataFrame, keys=SEQ, tracks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Remove ranges and close them: one pass over merged ranges. Second result: time removed per sequence.

    With ``tracks`` the clips of locked tracks stay as they are.
    """
    clips, fixed = by_lock(clips, tracks)
    cut = cut_lineage(merge_ranges(ranges.filter("end > start"), keys))
    total = cut.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("removed"))
    moved = close_up(lift(clips, cut, keys, merged=True), cut, keys)
    return moved if fixed is None else moved.unionByName(fixed, allowMissingColumns=True), total


def caption_extract(captions: DataFrame, ranges: DataFrame, keys=SEQ) -> DataFrame:
    """Captions under an extract: inside ones go, straddling ones are joined over the cut."""
    cut = cut_lineage(merge_ranges(ranges.filter("end > start"), keys))
    c = removed_before(with_end(captions), cut, keys, "start").withColumnRenamed("_rm", "_a")
    c = removed_before(c, cut, keys, "end").withColumns({"start": F.col("start") - F.col("_a"), "end": F.col("end") - F.col("_rm")})
    return c.withColumn("duration", F.col("end") - F.col("start")).filter("duration > 0").drop("_a", "_rm", "end")


def caption_insert(captions: DataFrame, inserts: DataFrame, keys=SEQ) -> DataFrame:
    """Captions under an insert ``(keys, at, delta)``: split at the point, later ones shifted."""
    points = inserts.select(*keys, F.col("at").alias("b_start"), (F.col("at") + 1).alias("b_end")).distinct()
    c = with_end(captions)
    hits = overlap_join(c, points, keys, b_classes=[0]).filter("b_start > start").withColumn("_t", F.col("b_start")).drop("b_start", "b_end", "lo", "hi")
    s = scan(hits.unionByName(c.withColumn("_t", F.col("end"))), [*keys, "caption_id"], ["_t"], _p=prev("_t"))
    first = F.col("_p").isNull()
    s = s.withColumns({"origin": F.col("caption_id"), "caption_id": F.when(first, F.col("caption_id")).otherwise(F.xxhash64("caption_id", "_p")), "start": F.coalesce("_p", "start")})
    return shift_by(s.withColumn("duration", F.col("_t") - F.col("start")).drop("_p", "_t", "end"), inserts, keys)


def insert(clips: DataFrame, placements: DataFrame, tracks: DataFrame) -> DataFrame:
    """Open gaps for ``placements`` (clips with ``edit_id``) on target and sync-locked tracks, then place.

    Times are before any insert; several inserts of one sequence are applied together.
    """
    at = placements.groupBy(*SEQ, "edit_id").agg(F.min("start").alias("at"), F.max(F.col("start") + F.col("duration")).alias("_e")).withColumn("delta", F.col("_e") - F.col("at"))
    targets = placements.select(*TRACK, "edit_id").distinct().withColumn("_hit", F.lit(True))
    moved = at.join(tracks.filter("not locked").select(*TRACK, "sync_lock"), SEQ).join(targets, [*TRACK, "edit_id"], "left").filter("sync_lock or _hit").select(*TRACK, "at", "delta")
    moved = cut_lineage(moved)
    cut = cut_lineage(razor(clips, moved.withColumnRenamed("at", "t")))
    body = shift_by(cut, moved, TRACK)
    # a placement moves with every earlier insert of its track, not with its own
    own = placements.join(at.select(*SEQ, "edit_id", "at"), [*SEQ, "edit_id"]).withColumns({"origin": F.col("clip_id"), "_off": F.col("start") - F.col("at"), "_key": F.col("at") - 1})
    own = shift_by(own, moved, TRACK, "_key").withColumn("start", F.col("_key") + 1 + F.col("_off"))
    return body.unionByName(own.select(*body.columns))


def overwrite(clips: DataFrame, placements: DataFrame) -> DataFrame:
    """Placements replace what is under them; of two placements the one with the higher ``ord`` wins."""
    spans = with_end(placements).select(*TRACK, "start", "end")
    below = lift(clips, spans, TRACK)
    p = with_end(placements)
    later = p.select(*TRACK, F.col("ord").alias("_o"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    holes = overlap_join(p.select(*TRACK, "clip_id", "ord", "start", "end"), later, TRACK).filter("_o > ord").select(*TRACK, "clip_id", F.col("lo").alias("start"), F.col("hi").alias("end"))
    top = trim_to(subtract(p, holes, [*TRACK, "clip_id"], ["clip_id"]))
    return below.unionByName(top.select(*below.columns))


def ripple_delete_items(clips: DataFrame, ids: DataFrame, tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete clips and close what that frees on their tracks.

    Sequences where a sync-locked track has material in the way, or where nothing can close, are
    left alone and reported.
    """
    t = tracks.select(*TRACK, "locked", "sync_lock")
    c = with_end(clips).join(ids.select("clip_id").distinct().withColumn("_del", F.lit(True)), "clip_id", "left").join(t, TRACK)
    gone = F.coalesce("_del", F.lit(False))
    c = c.withColumn("_aff", F.max(gone).over(W.partitionBy(*TRACK)))
    # six steps read the marked clips: they are worked out once and written, smaller than one shuffle of them
    c = _written(c)
    open_ = c.filter("_aff and not locked")
    spans = cut_lineage(range_except(open_.filter(gone).select(*SEQ, "start", "end"), open_.filter(~gone).select(*SEQ, "start", "end"), SEQ))
    away = overlap_join(spans, c.filter("not _aff and not locked and sync_lock").select(*SEQ, F.col("start").alias("b_start"), F.col("end").alias("b_end")), SEQ, a_classes=classes_of(spans)).select(*SEQ).distinct()
    stuck = c.filter("_aff").select(*SEQ).distinct().join(spans.select(*SEQ).distinct(), SEQ, "left_anti")
    conflicts = cut_lineage(away.withColumn("reason", F.lit("sync lock")).unionByName(stuck.withColumn("reason", F.lit("nothing closes"))))
    refused = conflicts.select(*SEQ).distinct()
    ok = c.join(refused, SEQ, "left_anti").filter(~(gone & ~F.col("locked")))
    movable = F.col("_aff") | F.col("sync_lock")
    moving = close_up(ok.filter(~F.col("locked") & movable).select(clips.columns), spans, SEQ)
    still = ok.filter(F.col("locked") | ~movable).select(clips.columns)
    return moving.unionByName(still).unionByName(c.join(refused, SEQ, "left_semi").select(clips.columns)), conflicts


def close_gaps(clips: DataFrame, captions: DataFrame, markers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Close time that no track or caption covers; markers inside a gap go."""
    cover = with_end(clips).select(*SEQ, "start", "end").unionByName(with_end(captions).select(*SEQ, "start", "end"))
    holes = gaps(cover, SEQ).withColumnsRenamed({"gap_start": "start", "gap_end": "end"})
    spans = holes.select(*SEQ, F.col("start").alias("g0"), F.col("end").alias("g1"))
    kept = item_at(markers.withColumn("_t", F.col("start")), spans, SEQ, "_t", "g0", "g1", "_g").filter("_g is null").drop("_g", "_t")
    return close_up(clips, holes), close_up(captions, holes), close_up(kept, holes)


def simplify_sequences(clips: DataFrame, tracks: DataFrame, keep: str | None = None, remove_disabled: bool = True, move_down: bool = True, close: bool = True, transitions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Drop disabled clips or a kind, orphan links, move video down, close gaps; with a report.

    Clips of one track never overlap, so once the tracks below are settled all clips of a track
    choose their destination independently: one overlap join per track position.
    """
    c = clips.join(tracks.select("track_id", "pos", "locked"), "track_id")
    stay = F.lit(True)
    if keep:
        stay = stay & (F.col("kind") == keep)
    left = c.filter(stay & (F.col("enabled") | F.lit(not remove_disabled)))
    if "link" in clips.columns:
        n = left.filter("link is not null").groupBy(*SEQ, "link").agg(F.count("*").alias("_n"))
        left = left.join(n, [*SEQ, "link"], "left").withColumn("link", F.when(F.col("_n") >= 2, F.col("link"))).drop("_n")
    removed = c.groupBy(*SEQ).agg(F.count("*").alias("_n0")).join(left.groupBy(*SEQ).agg(F.count("*").alias("_n1")), SEQ, "left")
    left = left.withColumn("_from", F.col("pos"))
    if move_down:
        fixed = transitions.select(F.explode(F.array("from_clip", "to_clip")).alias("clip_id")).distinct() if transitions is not None else None
        left = cut_lineage(left)
        top = left.filter("kind = 'video'").agg(F.max("pos")).first()[0] or 0
        free = tracks.filter("kind = 'video' and not locked").groupBy(*SEQ).agg(F.collect_set("pos").alias("_free"))
        for p in range(1, top + 1):
            mine = with_end(left.filter((F.col("kind") == "video") & (F.col("pos") == p))).select(*SEQ, "clip_id", "start", "end")
            if fixed is not None:
                mine = mine.join(fixed, "clip_id", "left_anti")
            low = with_end(left.filter((F.col("kind") == "video") & (F.col("pos") < p))).select(*SEQ, F.col("pos").alias("_d"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
            taken = overlap_join(mine, low, SEQ).groupBy(*SEQ, "clip_id").agg(F.collect_set("_d").alias("_taken"))
            options = F.array_except(F.filter("_free", lambda d: d < p), F.coalesce("_taken", F.array().cast("array<int>")))
            dest = mine.join(taken, [*SEQ, "clip_id"], "left").join(free, SEQ).select("clip_id", F.array_min(options).alias("_to")).filter("_to is not null")
            left = cut_lineage(left.join(dest, "clip_id", "left").withColumn("pos", F.coalesce("_to", "pos")).drop("_to"))
    moved = left.groupBy(*SEQ).agg(F.count_if(F.col("pos") != F.col("_from")).alias("moved_clips"))
    gone = gaps(with_end(left), SEQ).withColumnsRenamed({"gap_start": "start", "gap_end": "end"}) if close else None
    out = left.drop("_from", "locked", "track_id").join(tracks.select(*SEQ, "kind", "pos", "track_id"), [*SEQ, "kind", "pos"])
    report = removed.select(*SEQ, (F.col("_n0") - F.coalesce("_n1", F.lit(0))).alias("removed_clips")).join(moved, SEQ, "left")
    if close:
        out = close_up(out, gone)
        report = report.join(gone.groupBy(*SEQ).agg(F.sum(F.col("end") - F.col("start")).alias("closed_gaps")), SEQ, "left")
    before = tracks.groupBy(*SEQ).agg(F.count("*").alias("_t0"))
    after = out.select(*TRACK).distinct().groupBy(*SEQ).agg(F.count("*").alias("_t1"))
    report = report.join(before, SEQ).join(after, SEQ, "left").withColumn("removed_tracks", F.col("_t0") - F.greatest(F.coalesce("_t1", F.lit(0)), F.lit(1)))
    return out, report.drop("_t0", "_t1").na.fill(0)


def _neighbours(clips: DataFrame) -> DataFrame:
    c = with_end(clips)
    return scan(c, TRACK, ["start", "clip_id"], _pe=prev("end"), _ns=following("start"))


FAR = 2**61 - 1


def bulk_trim(clips: DataFrame, media: DataFrame, deltas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edge deltas ``(clip_id, edge 'in'|'out', delta)`` clamped by neighbours, media and one frame (``ft``).

    Second result: per delta what was applied. An out and an in delta that meet at one cut, or two
    deltas on one clip, are reported as refused and not applied.
    """
    n = _neighbours(clips).join(media.select("item_id", F.col("duration").alias("_media")), "item_id", "left")
    d = deltas.join(n, "clip_id")
    at = F.when(F.col("edge") == "in", F.col("start")).otherwise(F.col("end"))
    d = d.withColumn("_at", at)
    cuts = d.groupBy(*TRACK, "_at").agg(F.count("*").alias("_same"))
    twice = d.groupBy("clip_id").agg(F.count("*").alias("_mine"))
    d = d.join(cuts, [*TRACK, "_at"]).join(twice, "clip_id")
    speed = F.greatest(F.abs("speed"), F.lit(1e-9))
    ext = lambda m: F.floor(m.cast("double") / speed).cast("long")
    head = F.when(F.col("reverse"), F.col("_media") - source_out()).otherwise(F.col("source_in"))
    lo_in = F.greatest(-(F.col("start") - F.coalesce("_pe", F.lit(0))), -F.coalesce(ext(head), F.lit(FAR)))
    room = F.when(F.col("reverse"), F.col("source_in")).otherwise(F.col("_media") - source_out())
    lo_in = F.when(F.col("frame_hold").isNotNull(), F.lit(-FAR)).otherwise(lo_in)
    d_in = F.least(F.greatest("delta", lo_in), F.col("duration") - F.col("ft"))
    lo_out = -(F.col("duration") - F.col("ft"))
    hi_out = F.least(F.coalesce("_ns", F.lit(FAR)) - F.col("end"), F.coalesce(ext(room), F.lit(FAR)))
    d_out = F.least(F.greatest("delta", lo_out), F.greatest(hi_out, lo_out))
    ok = (F.col("_same") == 1) & (F.col("_mine") == 1)
    applied = d.select("clip_id", "edge", "delta", F.when(ok, F.when(F.col("edge") == "in", d_in).otherwise(d_out)).otherwise(0).alias("applied"), (~ok).alias("refused"))
    one = applied.filter("not refused").select("clip_id", "edge", F.col("applied").alias("_d"))
    c = clips.join(one, "clip_id", "left").withColumn("_d", F.coalesce("_d", F.lit(0)))
    is_in = F.coalesce(F.col("edge") == "in", F.lit(False))
    src = F.round(F.col("_d").cast("double") * F.abs("speed"), 0).cast("long")
    moved = F.when(is_in & ~F.col("reverse") & F.col("frame_hold").isNull(), F.col("source_in") + src).when(~is_in & F.col("reverse"), F.col("source_in") - src).otherwise(F.col("source_in"))
    c = c.withColumn("source_in", moved).withColumns({"start": F.when(is_in, F.col("start") + F.col("_d")).otherwise(F.col("start")), "duration": F.col("duration") + F.when(is_in, -F.col("_d")).otherwise(F.col("_d"))})
    return c.drop("edge", "_d"), applied


def bulk_slip(clips: DataFrame, media: DataFrame, deltas: DataFrame) -> DataFrame:
    """Source shifts ``(clip_id, delta)`` clamped to the media."""
    c = clips.join(deltas, "clip_id", "left").join(media.select("item_id", F.col("duration").alias("_media")), "item_id", "left")
    top = F.greatest(F.coalesce(F.col("_media") - scaled("duration", "speed"), F.lit(FAR)), F.lit(0))
    slid = F.least(F.greatest(F.col("source_in") + F.col("delta"), F.lit(0)), top)
    return c.withColumn("source_in", F.when(F.col("delta").isNotNull(), slid).otherwise(F.col("source_in"))).drop("delta", "_media")


def bulk_roll(clips: DataFrame, media: DataFrame, cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Move cuts ``(clip_id of the left clip, delta)``; cuts that share a clip or touch nothing are refused."""
    c = with_end(clips).join(media.select("item_id", F.col("duration").alias("_media")), "item_id", "left")
    right = F.struct("clip_id", "start", "duration", "source_in", "speed", "reverse", "_media")
    c = scan(c, TRACK, ["start", "clip_id"], _r=following(right))
    j = cuts.join(c, "clip_id").filter(F.col("_r.start") == F.col("end"))
    both = j.select(F.explode(F.array("clip_id", F.col("_r.clip_id"))).alias("x")).groupBy("x").agg(F.count("*").alias("_n")).filter("_n > 1").select("x")
    j = j.join(both.withColumnRenamed("x", "clip_id"), "clip_id", "left_anti").join(both.withColumnRenamed("x", "_rid"), F.col("_r.clip_id") == F.col("_rid"), "left_anti")
    ext = lambda m, s: F.floor(m.cast("double") / F.abs(s)).cast("long")
    rout = F.col("_r.source_in") + scaled(F.col("_r.duration"), F.col("_r.speed"))
    head = F.when(F.col("_r.reverse"), F.col("_r._media") - rout).otherwise(F.col("_r.source_in"))
    d = F.least(F.greatest("delta", -(F.col("duration") - F.col("ft"))), F.col("_r.duration") - F.col("ft"))
    d = F.least(d, F.coalesce(ext(F.col("_media") - source_out(), F.col("speed")), F.lit(FAR)))
    d = F.greatest(d, -F.coalesce(ext(head, F.col("_r.speed")), F.lit(FAR)))
    done = j.select("clip_id", F.col("_r.clip_id").alias("right_id"), "delta", d.alias("applied"))
    c0 = clips.join(done.select("clip_id", F.col("applied").alias("_l")), "clip_id", "left").join(done.select(F.col("right_id").alias("clip_id"), F.col("applied").alias("_r")), "clip_id", "left")
    r = F.coalesce("_r", F.lit(0))
    return c0.withColumns({
        "duration": F.col("duration") + F.coalesce("_l", F.lit(0)) - r, "start": F.col("start") + r,
        "source_in": F.col("source_in") + F.round(r.cast("double") * F.abs("speed"), 0).cast("long"),
    }).drop("_l", "_r"), done


def bulk_speed(clips: DataFrame, speeds: DataFrame, ripple: bool = False) -> DataFrame:
    """New ``(clip_id, new_speed, new_reverse)``; durations rescale to at least one frame (``ft``).

    Without ripple a clip stops at the next one; with it later material on the track moves.
    """
    c = _neighbours(clips).join(speeds, "clip_id", "left")
    set_ = F.col("new_speed") > 0
    used = source_out() - F.col("source_in")
    dur = F.greatest(F.round(used.cast("double") / F.col("new_speed"), 0).cast("long"), F.col("ft"))
    if not ripple:
        dur = F.least(dur, F.coalesce("_ns", F.lit(FAR)) - F.col("start"))
    c = c.withColumns({"_new": F.when(set_, dur).otherwise(F.col("duration"))})
    moves = c.filter(set_).select(*TRACK, F.col("end").alias("at"), (F.col("_new") - F.col("duration")).alias("delta"))
    c = c.withColumns({"duration": F.col("_new"), "speed": F.when(set_, F.col("new_speed")).otherwise(F.col("speed")), "reverse": F.when(set_, F.col("new_reverse")).otherwise(F.col("reverse"))})
    c = c.select(clips.columns)
    return shift_by(c, moves, TRACK) if ripple else c


def subsequence(clips: DataFrame, ranges: DataFrame) -> DataFrame:
    """Clips cut to ``(sequence_id, range_id, b_start, b_end)`` and moved so that the range starts at 0."""
    j = overlap_join(with_end(clips), ranges, SEQ).drop("b_end")
    return trim_to(j).withColumn("start", F.col("start") - F.col("b_start")).drop("b_start")


def _through(df: DataFrame):
    p = F.col("_p")
    out = lambda s, d, v: s + scaled(d, v)
    gap = F.when(p["reverse"], out(F.col("source_in"), F.col("duration"), F.col("speed")) - p["source_in"]).otherwise(F.col("source_in") - out(p["source_in"], p["duration"], p["speed"]))
    same = (p["end"] == F.col("start")) & (p["item_id"] == F.col("item_id")) & (p["speed"] == F.col("speed")) & (p["reverse"] == F.col("reverse"))
    if "angle" in df.columns:
        same = same & p["angle"].eqNullSafe(F.col("angle"))
    hold = F.col("frame_hold")
    cont = F.when(p["frame_hold"].isNotNull() | hold.isNotNull(), p["frame_hold"].eqNullSafe(hold)).otherwise(F.abs(gap) <= 2)
    return F.coalesce(same & cont, F.lit(False))


def _before(clips: DataFrame) -> list[str]:
    return ["clip_id", "end", "item_id", "speed", "reverse", "frame_hold", "source_in", "duration"] + (["angle"] if "angle" in clips.columns else [])


def _with_prev(clips: DataFrame) -> DataFrame:
    return scan(with_end(clips), TRACK, ["start", "clip_id"], _p=prev(F.struct(*_before(clips))))


def through_edits(clips: DataFrame) -> DataFrame:
    """Cuts whose two sides continue the same source."""
    c = _with_prev(clips)
    return c.filter(_through(c)).select(*TRACK, F.col("_p.clip_id").alias("left_id"), F.col("clip_id").alias("right_id"), F.col("start").alias("t"))


def join_through_edits(clips: DataFrame, transitions: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Runs of through edits folded into their first clip; transitions inside a run go, others are re-pointed."""
    c = _with_prev(clips)
    c = islands(c.withColumn("_new", ~_through(c)), TRACK, ["start", "clip_id"], F.col("_new"))
    first = lambda x: F.min_by(x, F.struct("start", "clip_id"))
    rest = [x for x in clips.columns if x not in (*TRACK, "start", "duration", "source_in", "clip_id")]
    folded = c.groupBy(*TRACK, "island").agg(
        first("clip_id").alias("clip_id"), F.min("start").alias("start"), F.sum("duration").alias("duration"),
        F.when(first("reverse"), F.max_by("source_in", F.struct("start", "clip_id"))).otherwise(first("source_in")).alias("source_in"), *[first(x).alias(x) for x in rest],
    )
    if transitions is None:
        return folded.drop("island"), None
    who = c.select(F.col("clip_id").alias("_c"), *TRACK, "island").join(folded.select(*TRACK, "island", "clip_id"), [*TRACK, "island"]).select("_c", F.col("clip_id").alias("_to"))
    tr = transitions.join(who.withColumnsRenamed({"_c": "from_clip", "_to": "_f"}), "from_clip", "left").join(who.withColumnsRenamed({"_c": "to_clip", "_to": "_t"}), "to_clip", "left")
    inside = F.col("_f").isNotNull() & (F.col("_f") == F.col("_t"))
    lost = (F.col("from_clip").isNotNull() & F.col("_f").isNull()) | (F.col("to_clip").isNotNull() & F.col("_t").isNull()) | (F.col("from_clip").isNull() & F.col("to_clip").isNull())
    tr = tr.filter(~F.coalesce(inside, F.lit(False)) & ~lost).withColumns({"from_clip": F.col("_f"), "to_clip": F.col("_t")}).select(transitions.columns)
    return folded.drop("island"), tr


#: Ticks of the chunks that segments are worked out in.
SWEEP_CHUNK = 60 * TPS


def _sweep(clips: DataFrame, what: list[str], unit) -> DataFrame:
    """Segments between neighbouring boundaries of each sequence that show something.

    ``clips`` has a row per clip with its boundaries ``a`` and ``b`` on the grid, in ticks, and ``live`` if it shows; ``unit``
    is a column of the sequence that comes along. A clip goes to every chunk of time that it touches, so a chunk knows by
    itself what shows at each of its boundaries, and clips travel once. Only a segment that leaves its chunk waits for
    the first boundary of a later one. The hash covers, bottom-up or not, what each layer shows at the segment's start.
    """
    live = F.col("live") & (F.col("a") < F.col("b"))
    plain = (F.col("speed") == 1.0) & ~F.col("reverse")
    x = F.struct("a", "b", live.alias("live"), plain.alias("plain"), "pos", "clip_id", F.xxhash64(*what).alias("h"), "source_in", "start", F.round(F.abs("speed") * 65536, 0).cast("long").alias("fixed"))
    chunk = F.lit(SWEEP_CHUNK)
    c = clips.select(*SEQ, unit.alias("unit"), F.explode(F.sequence(fdiv("a", chunk), fdiv("b", chunk))).alias("_c"), x.alias("x"))
    c = c.groupBy(*SEQ, "_c").agg(F.max("unit").alias("unit"), F.collect_list("x").alias("xs"))
    every = F.array_sort(F.array_distinct(F.concat(F.transform("xs", lambda x: x["a"]), F.transform("xs", lambda x: x["b"]))))
    c = c.withColumn("ts", F.filter(every, lambda t: fdiv(t, chunk) == F.col("_c")))
    c = c.select(*SEQ, "_c", "unit", "xs", F.explode(F.transform("ts", lambda t, i: F.struct(t.alias("t"), F.get("ts", i + 1).alias("t1"), (i == 0).alias("first")))).alias("e")).select(*SEQ, "_c", "unit", "xs", "e.*")
    c = c.withColumn("on", F.filter("xs", lambda x: x["live"] & (x["a"] <= F.col("t")) & (F.col("t") < x["b"])))
    big = lambda v: v.cast("decimal(19,0)")
    at = lambda x: F.struct(x["h"], big(x["source_in"]) * F.lit(65536).cast("decimal(6,0)") + big(F.col("t") - x["start"]) * x["fixed"].cast("decimal(18,0)"))
    names = F.array_join(F.transform(F.array_sort(F.transform("on", lambda x: F.struct(x["pos"], x["clip_id"]))), lambda l: l["clip_id"].cast("string")), ",")
    c = c.select(*SEQ, "_c", "unit", "t", "t1", "first", F.size("on").alias("layers"), F.forall("on", lambda x: x["plain"]).alias("plain"), names.alias("clips"), F.xxhash64(F.array_sort(F.transform("on", at))).alias("shown"))
    s = _written(c.filter("layers > 0 or first"))
    firsts = s.filter("first").select(*SEQ, "_c", "t")
    later = firsts.withColumn("_next", F.lead("t").over(W.partitionBy(*SEQ).orderBy("_c"))).filter("_next is not null").select(*SEQ, "_c", "_next")
    left = s.filter("t1 is null and layers > 0").join(later, [*SEQ, "_c"]).withColumn("t1", F.col("_next")).drop("_next")
    s = s.filter("t1 is not null and layers > 0").unionByName(left)
    return s.select(*SEQ, "unit", "t", "t1", "layers", "plain", "clips", F.xxhash64(F.col("t1") - F.col("t"), "layers", "shown").alias("hash"))


def _written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, column by column: less than a checkpoint of its rows."""
    path = f"{shared_folder(df.sparkSession)}/tickloom-{uuid.uuid4().hex}/segments"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def render_segments(clips: DataFrame, tracks: DataFrame, budget_ms: float = 20.0, cost_ms: float = 8.0) -> DataFrame:
    """Timeline cut at every visible boundary (frame ceiling); layers bottom-up, content hash, cost class.

    The hash covers what is shown relative to the segment start, so equal content elsewhere gets
    the same hash. ``ft`` is the same for all clips of a sequence.
    """
    t = tracks.filter("kind = 'video' and enabled").select("track_id", "pos")
    up = lambda x: -frame_at(-F.col(x), "ft") * F.col("ft")
    c = with_end(clips.join(t, "track_id")).withColumns({"a": up("start"), "b": up("end"), "live": F.col("enabled")})
    g = _sweep(c, ["pos", "item_id", "speed", "reverse", "frame_hold"], F.col("ft")).withColumnRenamed("unit", "ft")
    need = F.when(F.col("layers") * cost_ms > budget_ms, "render").when((F.col("layers") == 1) & F.col("plain"), "none").otherwise("realtime")
    return g.select(*SEQ, idiv("t", "ft").alias("first_frame"), idiv(F.col("t1") - F.col("t"), F.col("ft")).alias("frames"), "layers", "clips", need.alias("need"), "hash")


def audio_segments(clips: DataFrame, tracks: DataFrame, ticks_per_sample: int) -> DataFrame:
    """The same on sample boundaries for audio, honouring mute and solo."""
    a = tracks.filter("kind = 'audio'")
    solo = a.groupBy(*SEQ).agg(F.max("solo").alias("_any"))
    heard = a.join(solo, SEQ).withColumn("_on", ~F.col("muted") & (~F.col("_any") | F.col("solo"))).select("track_id", "pos", "_on")
    k = F.lit(ticks_per_sample)
    up = lambda x: -frame_at(-F.col(x), k) * k
    c = with_end(clips.join(heard, "track_id")).withColumns({"a": up("start"), "b": up("end"), "live": F.col("enabled") & F.col("_on")})
    g = _sweep(c, ["pos", "item_id", "speed", "reverse"], k)
    return g.select(*SEQ, idiv("t", k).alias("first_sample"), idiv(F.col("t1") - F.col("t"), k).alias("samples"), "layers", "hash")


#: Clips of a track up to which plain windows over the track are used.
SHORT = 1 << 20


def multicam_record(clips: DataFrame, cuts: DataFrame, ends: DataFrame) -> DataFrame:
    """Switch presses ``(sequence_id, item_id, press, time, angle)`` applied to multicam clips until ``ends(sequence_id, item_id, end_time)``.

    Of two presses at one time the later wins; equal-angle neighbours are healed. Windows over the track heal where no
    track is longer than ``SHORT``, after one shuffle; longer ones are scanned in chunks.
    """
    key = ["sequence_id", "item_id"]
    p = _written(cuts.groupBy(*key, "time").agg(F.max_by("angle", "press").alias("angle")).join(ends, key).filter("time < end_time"))
    last = p.groupBy(*key, "end_time").agg(F.min("time").alias("t0"))
    marks = p.select(*key, F.col("time").alias("t")).unionByName(last.select(*key, F.col("end_time").alias("t")))
    pieces = razor(clips, marks, key)
    spans = scan(p, key, ["time"], _nx=following("time")).select(*key, F.col("time").alias("p0"), F.coalesce("_nx", "end_time").alias("p1"), F.col("angle").alias("pa"))
    # pieces may heal from the first press up to the end, which is a span of its own
    shut = last.select(*key, F.col("end_time").alias("p0"), (F.col("end_time") + 1).alias("p1"), F.lit(None).cast(spans.schema["pa"].dataType).alias("pa"))
    hit = item_at(pieces.withColumn("_t", F.col("start")), spans.unionByName(shut), key, "_t", "p0", "p1", "_s")
    cut = hit.withColumns({"angle": F.coalesce(F.col("_s.pa"), F.col("angle")), "_on": F.col("_s").isNotNull()}).drop("_s", "_t")
    cut = _written(cut)
    longest = cut.groupBy(*TRACK).count().agg(F.max("count")).first()[0] or 0
    within = W.partitionBy(*TRACK).orderBy("start", "clip_id")
    if longest <= SHORT:
        c = with_end(cut).withColumn("_p", F.lag(F.struct(*_before(cut))).over(within))
    else:
        c = _with_prev(cut)
    p_ = F.col("_p")
    heal = F.coalesce(
        (p_["end"] == F.col("start")) & (p_["item_id"] == F.col("item_id")) & p_["angle"].eqNullSafe(F.col("angle")) & (p_["speed"] == F.col("speed")) & ~p_["reverse"] & ~F.col("reverse")
        & p_["frame_hold"].isNull() & F.col("frame_hold").isNull() & (p_["source_in"] + scaled(p_["duration"], p_["speed"]) == F.col("source_in")) & F.col("_on"), F.lit(False))
    if longest <= SHORT:
        c = c.withColumn("_h", heal).withColumn("island", F.sum(F.when(F.col("_h"), 0).otherwise(1)).over(within.rowsBetween(W.unboundedPreceding, 0)))
    else:
        c = islands(c.withColumn("_h", heal), TRACK, ["start", "clip_id"], ~F.col("_h"))
    first = lambda x: F.min_by(x, F.struct("start", "clip_id"))
    rest = [x for x in clips.columns if x not in (*TRACK, "start", "duration", "clip_id")]
    return c.groupBy(*TRACK, "island").agg(first("clip_id").alias("clip_id"), F.min("start").alias("start"), F.sum("duration").alias("duration"), *[first(x).alias(x) for x in rest]).drop("island")
