"""Batch operators over per-session logs; the streaming module has their live twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tickloom.functions.timebase import idiv
from tickloom.operators.ordered import first_after, first_from, islands, last_upto, orbit, prev, scan, sum_upto

HOUR_US = 3_600_000_000


def log_runs(log: DataFrame) -> DataFrame:
    """Consecutive equal entries of a session ``(session_id, ts_us, seq, level, source, message)`` collapsed."""
    order = ["ts_us", "seq"]
    what = F.struct("level", "source", "message")
    s = scan(log, ["session_id"], order, HOUR_US, _p=prev(what))
    s = islands(s, ["session_id"], order, F.col("_p").isNull() | (F.col("_p") != what), "run", HOUR_US)
    return s.groupBy("session_id", "run").agg(F.max("level").alias("level"), F.max("source").alias("source"), F.max("message").alias("message"), F.count("*").alias("count"), F.max("ts_us").alias("last_us"))


def import_report(warnings: DataFrame) -> DataFrame:
    return warnings.groupBy("level", "message").agg(F.count("*").alias("count"))


def drop_meter(refreshes: DataFrame, step: int = 1) -> DataFrame:
    """Shown and dropped frames per session ``(session_id, ts_us, seq, frame, exact)``."""
    order = ["ts_us", "seq"]
    s = scan(refreshes, ["session_id"], order, HOUR_US, _f=prev("frame"))
    s = islands(s, ["session_id"], order, F.col("_f").isNull() | (F.col("_f") != F.col("frame")), "run", HOUR_US)
    moved = F.when(F.col("_f") != F.col("frame"), idiv(F.col("frame") - F.col("_f"), F.lit(step)))
    r = s.withColumn("_m", moved).groupBy("session_id", "run").agg(F.max("exact").alias("seen"), F.max("_m").alias("m"))
    skipped = F.when((F.col("m") > 1) & (F.col("m") < 1000), F.col("m") - 1).otherwise(0)
    return r.groupBy("session_id").agg(F.count_if("seen").alias("shown"), (F.count_if(~F.col("seen")) + F.sum(skipped)).alias("dropped"))


def changes_debounced(edits: DataFrame, quiet_us: int, longest_us: int) -> DataFrame:
    """One snapshot per burst of edits ``(project_id, ts_us, seq)``: after ``quiet_us`` without one, at the latest ``longest_us`` after the first."""
    key, order = ["project_id"], ["ts_us", "seq"]
    e = scan(edits, key, order, HOUR_US, _pt=prev("ts_us"), i=sum_upto(F.lit(1).cast("long")))
    e = scan(e, key, order, HOUR_US, _gap=first_after(F.when(F.col("ts_us") >= F.col("_pt") + quiet_us, F.col("i"))))
    none = F.lit(None).cast("long")
    probe = e.select(*key, (F.col("ts_us") + longest_us).alias("t"), F.lit(0).alias("k"), "i", none.alias("at"))
    stops = e.select(*key, F.col("ts_us").alias("t"), F.lit(1).alias("k"), "i", F.col("i").alias("at"))
    late = scan(probe.unionByName(stops), key, ["t", "k", "i"], HOUR_US, _late=first_from("at")).filter("k = 0").select(*key, "i", "_late")
    e = e.join(late, [*key, "i"]).withColumn("nxt", F.least("_gap", F.when(F.col("_late") > F.col("i"), F.col("_late"))))
    heads = orbit(e, key, "i", "nxt").withColumn("_h", F.lit(True))
    s = scan(e.join(heads, [*key, "i"], "left"), key, ["i"], 4096, burst=last_upto(F.when(F.col("_h"), F.col("i"))))
    g = s.groupBy(*key, "burst").agg(F.count("*").alias("edits"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    return g.select(*key, "edits", "first_us", F.least(F.col("last_us") + quiet_us, F.col("first_us") + longest_us).alias("saved_us"))


def multicam_cut_list(presses: DataFrame, gap_us: int) -> DataFrame:
    """Cut list per pass ``(sequence_id, ts_us, press, time, angle)``; a later press at one time wins."""
    order = ["ts_us", "press"]
    s = scan(presses, ["sequence_id"], order, HOUR_US, _p=prev("ts_us"))
    s = islands(s, ["sequence_id"], order, F.col("_p").isNull() | (F.col("ts_us") - F.col("_p") >= gap_us), "pass_no", HOUR_US)
    return s.groupBy("sequence_id", "pass_no", "time").agg(F.max_by("angle", "press").alias("angle"))


def levels(blocks: DataFrame, interval_us: int) -> DataFrame:
    """Peak per track and channel per interval."""
    return blocks.groupBy("track_id", "ch", (idiv("ts_us", F.lit(interval_us)) * interval_us).alias("start_us")).agg(F.max(F.abs("x")).alias("peak"))
