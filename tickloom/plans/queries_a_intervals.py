"""Interval core: scans over clip tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import intervals as iv
from tickloom.plans import fixtures as fx
from tickloom.plans.registry import query
from tickloom.plans.sqltables import using

ONES = """, a AS (SELECT sequence_id, start, "end" FROM spans WHERE kind = 'audio'), b AS (SELECT sequence_id, start, "end" FROM spans WHERE kind = 'video'),"""


def sql_merge(src: str, out: str, key: str) -> str:
    return f"""{out}_m AS (SELECT *, max("end") OVER (PARTITION BY {key} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cov FROM {src}),
 {out}_i AS (SELECT *, sum(CASE WHEN cov IS NULL OR start > cov THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY start, "end", cov NULLS FIRST ROWS UNBOUNDED PRECEDING) AS isl FROM {out}_m),
 {out} AS (SELECT {key}, min(start) AS start, max("end") AS "end" FROM {out}_i GROUP BY {key}, isl)"""


def sides(spark, d):
    s = fx.spans(spark, d)
    cols = ["sequence_id", "start", "end"]
    return s.filter("kind = 'audio'").select(cols), s.filter("kind = 'video'").select(cols)


@query("track_gaps", using("spans", """, g AS (SELECT *, coalesce(max("end") OVER (PARTITION BY track_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cov FROM spans)
SELECT track_id, cov AS gap_start, start AS gap_end FROM g WHERE start > cov"""))
def track_gaps(spark, d):
    return iv.gaps(fx.spans(spark, d), ["track_id"])


@query("sequence_gaps", using("spans", """, g AS (SELECT *, coalesce(max("end") OVER (PARTITION BY sequence_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cov FROM spans)
SELECT sequence_id, cov AS gap_start, start AS gap_end FROM g WHERE start > cov"""))
def sequence_gaps(spark, d):
    return iv.gaps(fx.spans(spark, d), ["sequence_id"])


@query("merge_ranges", using("spans", ", " + sql_merge("spans", "m", "sequence_id") + ' SELECT sequence_id, start, "end" FROM m'))
def merge_ranges(spark, d):
    return iv.merge_ranges(fx.spans(spark, d), ["sequence_id"])


@query("range_union", using("spans", ONES + "ab AS (SELECT * FROM a UNION ALL SELECT * FROM b), " + sql_merge("ab", "m", "sequence_id") + " SELECT * FROM m"))
def range_union(spark, d):
    return iv.range_union(*sides(spark, d), ["sequence_id"])


@query("range_intersect", using("spans", ONES + sql_merge("a", "am", "sequence_id") + ", " + sql_merge("b", "bm", "sequence_id") + """
SELECT am.sequence_id, greatest(am.start, bm.start) AS start, least(am."end", bm."end") AS "end" FROM am JOIN bm ON am.sequence_id = bm.sequence_id AND am.start < bm."end" AND bm.start < am."end" """))
def range_intersect(spark, d):
    return iv.range_intersect(*sides(spark, d), ["sequence_id"])


@query("range_except", using("spans", ONES + sql_merge("a", "am", "sequence_id") + ", " + sql_merge("b", "bm", "sequence_id") + """,
w AS (SELECT am.sequence_id, am.start AS s0, greatest(am.start, bm.start) AS lo, least(am."end", bm."end") AS hi FROM am JOIN bm ON am.sequence_id = bm.sequence_id AND am.start < bm."end" AND bm.start < am."end"
 UNION ALL SELECT sequence_id, start, "end", "end" FROM am),
p AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY sequence_id, s0 ORDER BY lo, hi), s0) AS q FROM w)
SELECT sequence_id, q AS start, lo AS "end" FROM p WHERE lo > q"""))
def range_except(spark, d):
    return iv.range_except(*sides(spark, d), ["sequence_id"])


@query("overlap_join", using("spans", """SELECT a.sequence_id, a.clip_id, b.clip_id AS other_id, greatest(a.start, b.start) AS lo, least(a."end", b."end") AS hi
FROM spans a JOIN spans b ON a.sequence_id = b.sequence_id AND a.start < b."end" AND b.start < a."end" WHERE a.kind = 'audio' AND b.kind = 'video'"""))
def overlap_join(spark, d):
    s = fx.spans(spark, d)
    a = s.filter("kind = 'audio'").select("sequence_id", "clip_id", "start", "end")
    b = s.filter("kind = 'video'").select("sequence_id", F.col("clip_id").alias("other_id"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return iv.overlap_join(a, b, ["sequence_id"]).select("sequence_id", "clip_id", "other_id", "lo", "hi")


@query("item_at", using("spans", """, pts AS (SELECT track_id, clip_id AS point_id, start + 5 * ft AS t FROM (SELECT track_id, clip_id, start + duration AS start, ft FROM spans))
SELECT p.track_id, p.point_id, p.t, s.clip_id AS covering FROM pts p LEFT JOIN spans s ON p.track_id = s.track_id AND s.start <= p.t AND p.t < s."end" """))
def item_at(spark, d):
    s = fx.spans(spark, d)
    pts = s.select("track_id", F.col("clip_id").alias("point_id"), (F.col("end") + 5 * F.col("ft")).alias("t"))
    return iv.item_at(pts, s.select("track_id", "clip_id", "start", "end"), ["track_id"]).select("track_id", "point_id", "t", F.col("span.clip_id").alias("covering"))


@query("edit_points", using("spans", """SELECT DISTINCT sequence_id, t FROM (SELECT sequence_id, start AS t FROM spans UNION ALL SELECT sequence_id, "end" FROM spans)"""))
def edit_points(spark, d):
    return iv.edit_points(fx.clips(spark, d))


@query("timeline_check", using("clips captions", """, rows AS (SELECT 'clip' AS kind, track_id, clip_id AS item, start, duration - CASE WHEN clip_id % 9 = 0 THEN duration ELSE -2 * ft * (clip_id % 3) END AS duration FROM clips
 UNION ALL SELECT 'caption', track_id, caption_id, CASE WHEN caption_id % 5 = 4 THEN start - 127008000000 ELSE start END, duration FROM captions),
n AS (SELECT *, lead(start) OVER (PARTITION BY kind, track_id ORDER BY start, item) AS nxt FROM rows)
SELECT kind, track_id, item, start, 'empty' AS problem FROM n WHERE duration <= 0 UNION ALL SELECT kind, track_id, item, start, 'overlap' FROM n WHERE start + duration > nxt"""))
def timeline_check(spark, d):
    c = fx.clips(spark, d)
    c = c.withColumn("duration", F.when(F.col("clip_id") % 9 == 0, 0).otherwise(F.col("duration") + 2 * F.col("ft") * (F.col("clip_id") % 3)))
    cap = fx.captions(spark, d)
    cap = cap.withColumn("start", F.when(F.col("caption_id") % 5 == 4, F.col("start") - 500 * fx.MS).otherwise(F.col("start")))
    return iv.timeline_check(c, cap)
