"""Frame grids, timecode logs, sync and ducking pairs over timeline tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.functions.timebase import (
    TPS, col, fields_to_frames, frame_at, idiv, lit, snap, snap_nearest, source_time, timecode, timecode_base, uses_drop,
)
from tickloom.operators.intervals import overlap_join
from tickloom.operators.ordered import INDEX_CHUNK, max_before, scan

BLOCK = 65_536


def frame_grid(clips: DataFrame, ft="ft") -> DataFrame:
    """Every sequence frame of every clip with its media time; long clips are opened in blocks."""
    ft = col(ft)
    first, stop = frame_at(F.col("start") + ft - 1, ft), frame_at(F.col("start") + F.col("duration") + ft - 1, ft)
    c = clips.withColumns({"_f0": first, "_f1": stop, "_ft": ft}).filter("_f1 > _f0")
    c = c.withColumn("_b", F.explode(F.sequence(F.col("_f0"), F.col("_f1") - 1, F.lit(BLOCK))))
    c = c.withColumn("frame", F.explode(F.sequence(F.col("_b"), F.least(F.col("_b") + BLOCK, F.col("_f1")) - 1)))
    c = c.withColumn("t", F.col("frame") * F.col("_ft"))
    return c.select("clip_id", "frame", "t", source_time("t").alias("media_t"))


def conform_to_frames(events: DataFrame, key: str, ft) -> DataFrame:
    """Frame index, snapped and nearest tick, offset, and how many events share the frame."""
    e = events.withColumns({"frame": frame_at("t", ft), "snapped": snap("t", ft), "nearest": snap_nearest("t", ft)}).withColumn("off", F.col("t") - F.col("snapped"))
    n = e.groupBy(key, "frame").agg(F.count("*").alias("in_frame"))
    return e.join(n, [key, "frame"])


def timecode_audit(rows: DataFrame, num: int, den: int, drop: bool) -> DataFrame:
    """Parse logged timecodes ``(reel, seq, tc)``; frame count, its label, and flags per row."""
    base = timecode_base(F.lit(num), F.lit(den))
    df = uses_drop(F.lit(num), F.lit(den), drop)
    body = F.trim("tc")
    bare = body.rlike(r"^[0-9]+$")
    split = F.split(body, "[:;.,]")
    digits = F.length(body)
    half = idiv(digits + 1, F.lit(2)).cast("int")
    padded = F.lpad(body, half * 2, F.lit("0"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(half, F.lit(1))), lambda i: padded.substr((i - 1) * 2 + 1, F.lit(2)))
    parts = F.when(bare, pairs).otherwise(F.transform(split, lambda p: F.when(p == "", "0").otherwise(p)))
    nums = F.transform(parts, lambda p: p.try_cast("long"))
    good = (F.size(nums) <= 4) & F.forall(nums, lambda x: x.isNotNull())
    r = rows.withColumn("_p", F.when(good, F.concat(F.slice(F.array(*[F.lit(0).cast("long")] * 4), F.lit(1), 4 - F.size(nums)), nums)))
    h, m, s, f = (F.col("_p")[i] for i in range(4))
    small = df & (m < 60) & (s < 60) & (f < base)
    r = r.withColumn("frames", F.when(F.col("_p").isNotNull(), fields_to_frames(h, m, s, f, base, small)))
    r = r.withColumn("label", timecode("frames", base, df))
    two = F.transform("_p", lambda x: F.lpad(x.cast("string"), 2, "0"))
    pad = F.when(df, F.array_join(two, ";")).otherwise(F.array_join(two, ":"))
    r = r.withColumn("invalid", F.col("_p").isNull() | (pad != F.col("label")))
    r = scan(r, ["reel"], ["seq"], INDEX_CHUNK, _hi=max_before("frames"))
    dup = rows.join(r.select("reel", "seq", "frames"), ["reel", "seq"]).groupBy("reel", "frames").agg(F.count("*").alias("_n"))
    r = r.join(dup, ["reel", "frames"], "left")
    return r.select("reel", "seq", "tc", "frames", "label", "invalid", F.coalesce(F.col("frames") < F.col("_hi"), F.lit(False)).alias("out_of_order"), F.coalesce(F.col("_n") > 1, F.lit(False)).alias("duplicate"))


def source_timecode_rebase(clips: DataFrame, keyframes: DataFrame, media: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Media-relative times from absolute ones."""
    tc = media.select("item_id", F.coalesce("start_timecode", F.lit(0)).alias("_tc"))
    shift = lambda df, cols: df.join(tc, "item_id", "left").withColumns({c: F.col(c) - F.coalesce("_tc", F.lit(0)) for c in cols}).drop("_tc")
    return shift(clips, ["source_in", "frame_hold"]), shift(keyframes, ["time"])


def sync_placements(clips: DataFrame, method: str, ft, markers: DataFrame | None = None, marker_name: str | None = None, offset: int = 0, snapped: bool = True) -> DataFrame:
    """Starts on a common timeline from 0 for each sync group.

    ``clips(group_id, clip_id, reference, range_start, in_point, out_point, timecode)``; ``markers(clip_id, start, name)``.
    """
    if method == "marker":
        m = markers if marker_name is None else markers.filter(F.lower("name") == marker_name.lower())
        clips = clips.join(m.groupBy("clip_id").agg(F.min("start").alias("_m")), "clip_id")
    hour = 3600 * TPS
    anchor = {
        "in": F.col("in_point"), "out": F.col("out_point"), "timecode": -F.col("timecode"), "timecode_no_hours": -F.pmod(F.col("timecode"), F.lit(hour)),
    }.get(method) if method != "marker" else F.col("_m")
    c = clips.withColumn("anchor", anchor - F.when(F.col("reference"), 0).otherwise(offset)).withColumn("_raw", F.col("range_start") - F.col("anchor"))
    low = c.groupBy("group_id").agg(F.min("_raw").alias("_min"))
    rel = F.col("_raw") - F.col("_min")
    return c.join(low, "group_id").select("group_id", "clip_id", "anchor", (snap_nearest(rel, ft) if snapped else rel).alias("start"))


def duck_triggers(clips: DataFrame) -> DataFrame:
    """Clips that make each ducking clip duck: ``sound``, ``against ARRAY``, ``against_untyped``, ``mute``."""
    c = clips.withColumn("end", F.col("start") + F.col("duration"))
    target = c.filter("against is not null").select("sequence_id", F.col("clip_id").alias("target"), "against", "against_untyped", "start", "end")
    other = c.filter("enabled").select("sequence_id", F.col("clip_id").alias("trigger"), "sound", "mute", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    j = overlap_join(target, other, ["sequence_id"]).filter("target != trigger")
    ok = F.when(F.col("sound").isNull(), F.col("against_untyped")).otherwise(~F.col("mute") & F.array_contains("against", F.col("sound")))
    return j.filter(ok).select("sequence_id", "target", "trigger")
