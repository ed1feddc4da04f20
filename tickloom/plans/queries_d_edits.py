"""Bulk timeline edit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import edits as ed
from tickloom.plans import fixtures as fx
from tickloom.plans.queries_a_intervals import sql_merge
from tickloom.plans.registry import query
from tickloom.plans.sqltables import r0, using

OUT = ["sequence_id", "track_id", "origin", "start", "duration", "source_in"]
BASE = ["sequence_id", "track_id", "clip_id", "item_id", "start", "duration", "source_in", "speed", "reverse", "frame_hold", "ft"]


def pick(df, cols=OUT):
    return df.select(cols)


# source in of the piece [lo, hi) of a clip
PIECE = f"CASE WHEN reverse THEN source_in + {r0('duration * speed')} - {r0('(hi - start) * speed')} ELSE source_in + {r0('(lo - start) * speed')} END"
RNG = """rg AS (SELECT sequence_id, start + 3 * ft AS start, start + 3 * ft + 20 * ft AS "end" FROM spans WHERE rn % 3 = 1), """ + sql_merge("rg", "mr", "sequence_id")


def ranges(spark, d):
    c = fx.clips(spark, d).filter("rn % 3 = 1")
    return c.select("sequence_id", (F.col("start") + 3 * F.col("ft")).alias("start"), (F.col("start") + 23 * F.col("ft")).alias("end"))


CUTP = """ct AS (SELECT DISTINCT sequence_id, start + 7 * ft AS t FROM spans WHERE rn % 2 = 0)"""


@query("razor", using("spans", f""", {CUTP}, w AS (SELECT s.*, t FROM spans s JOIN ct ON s.sequence_id = ct.sequence_id AND s.start < t AND t < s."end" UNION ALL SELECT *, "end" AS t FROM spans),
p AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY clip_id ORDER BY t), start) AS lo, t AS hi FROM w)
SELECT sequence_id, track_id, clip_id AS origin, lo AS start, hi - lo AS duration, {PIECE} AS source_in FROM p"""))
def razor(spark, d):
    c = fx.clips(spark, d)
    cuts = c.filter("rn % 2 = 0").select("sequence_id", (F.col("start") + 7 * F.col("ft")).alias("t"))
    return pick(ed.razor(c, cuts, ["sequence_id"]))


LIFTED = f"""hl AS (SELECT s.*, greatest(s.start, m.start) AS h0, least(s."end", m."end") AS h1 FROM spans s JOIN mr m ON s.sequence_id = m.sequence_id AND s.start < m."end" AND m.start < s."end" UNION ALL SELECT *, "end", "end" FROM spans),
hp AS (SELECT *, coalesce(lag(h1) OVER (PARTITION BY clip_id ORDER BY h0, h1), start) AS lo, h0 AS hi FROM hl), lf AS (SELECT *, {PIECE} AS src FROM hp WHERE hi > lo)"""


@query("lift", using("spans", f", {RNG}, {LIFTED} SELECT sequence_id, track_id, clip_id AS origin, lo AS start, hi - lo AS duration, src AS source_in FROM lf"))
def lift(spark, d):
    return pick(ed.lift(fx.clips(spark, d), ranges(spark, d)))


@query("ripple_delete_ranges", using("spans", f""", {RNG}, {LIFTED} SELECT sequence_id, track_id, clip_id AS origin, CAST(lo - coalesce((SELECT sum(m."end" - m.start) FROM mr m WHERE m.sequence_id = lf.sequence_id AND m."end" <= lo), 0) AS BIGINT) AS start, hi - lo AS duration, src AS source_in FROM lf"""))
def ripple_delete_ranges(spark, d):
    return pick(ed.ripple_delete_ranges(fx.clips(spark, d).select(BASE), ranges(spark, d))[0])


LOCKED = "(track_id % 3 = 0)"


def locks(spark, d):
    return fx.clips(spark, d).select("track_id", F.expr(LOCKED).alias("locked")).distinct()


@query("ripple_delete_locked", using("spans", f""", {RNG}, {LIFTED} SELECT sequence_id, track_id, clip_id AS origin, CAST(lo - coalesce((SELECT sum(m."end" - m.start) FROM mr m WHERE m.sequence_id = lf.sequence_id AND m."end" <= lo), 0) AS BIGINT) AS start, hi - lo AS duration, src AS source_in FROM lf WHERE NOT {LOCKED}
UNION ALL SELECT sequence_id, track_id, clip_id, start, duration, source_in FROM spans WHERE {LOCKED}"""))
def ripple_delete_locked(spark, d):
    """As above, but the clips of locked tracks stay."""
    return pick(ed.ripple_delete_ranges(fx.clips(spark, d).select(BASE), ranges(spark, d), tracks=locks(spark, d))[0])


@query("ripple_delete_removed", using("spans", f""", {RNG}, {LIFTED} SELECT sequence_id, CAST(sum("end" - start) AS BIGINT) AS removed FROM mr GROUP BY 1"""))
def ripple_delete_removed(spark, d):
    """Time that the same edit removes from each sequence."""
    return ed.ripple_delete_ranges(fx.clips(spark, d), ranges(spark, d))[1]


@query("lift_locked", using("spans", f""", {RNG}, {LIFTED} SELECT sequence_id, track_id, clip_id AS origin, lo AS start, hi - lo AS duration, src AS source_in FROM lf WHERE NOT {LOCKED}
UNION ALL SELECT sequence_id, track_id, clip_id, start, duration, source_in FROM spans WHERE {LOCKED}"""))
def lift_locked(spark, d):
    return pick(ed.lift(fx.clips(spark, d), ranges(spark, d), tracks=locks(spark, d)))


CAPR = """cr AS (SELECT track_id, caption_id, start - 254016000 * 300::BIGINT AS start, start + CAST(254016000 AS BIGINT) * 900 AS "end" FROM captions WHERE caption_id % 4 = 1), """ + sql_merge("cr", "cm", "track_id")


@query("caption_ripple", using("captions", f""", {CAPR}, e AS (SELECT *, start + duration AS "end" FROM captions),
x AS (SELECT e.*, coalesce((SELECT sum(least(greatest(e.start - m.start, 0), m."end" - m.start)) FROM cm m WHERE m.track_id = e.track_id), 0) AS a, coalesce((SELECT sum(least(greatest(e."end" - m.start, 0), m."end" - m.start)) FROM cm m WHERE m.track_id = e.track_id), 0) AS b FROM e)
SELECT track_id, caption_id, CAST(start - a AS BIGINT) AS start, CAST("end" - b - start + a AS BIGINT) AS duration FROM x WHERE "end" - b > start - a"""))
def caption_ripple(spark, d):
    c = fx.captions(spark, d)
    r = c.filter("caption_id % 4 = 1").select("track_id", (F.col("start") - 300 * fx.MS).alias("start"), (F.col("start") + 900 * fx.MS).alias("end"))
    return ed.caption_extract(c, r, ["track_id"]).select("track_id", "caption_id", "start", "duration")


@query("caption_insert", using("captions", """, ins AS (SELECT track_id, start + 254016000 * 700::BIGINT AS pt, 254016000 * 1500::BIGINT AS delta FROM captions WHERE caption_id % 5 = 2), e AS (SELECT *, start + duration AS "end" FROM captions),
w AS (SELECT e.*, pt AS t FROM e JOIN ins USING (track_id) WHERE e.start < pt AND pt < e."end" UNION ALL SELECT *, "end" FROM e), p AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY caption_id ORDER BY t), start) AS lo FROM w)
SELECT track_id, caption_id AS origin, CAST(lo + coalesce((SELECT sum(delta) FROM ins i WHERE i.track_id = p.track_id AND i.pt <= lo), 0) AS BIGINT) AS start, t - lo AS duration FROM p"""))
def caption_insert(spark, d):
    c = fx.captions(spark, d)
    ins = c.filter("caption_id % 5 = 2").select("track_id", (F.col("start") + 700 * fx.MS).alias("at"), F.lit(1500 * fx.MS).alias("delta"))
    return ed.caption_insert(c, ins, ["track_id"]).select("track_id", "origin", "start", "duration")


def tracks(spark, d):
    return fx.clips(spark, d).select("sequence_id", "track_id", "kind").distinct().withColumns({
        "pos": F.when(F.col("track_id") % 4 == 2, 1).otherwise(0), "locked": F.col("track_id") % 7 == 3, "sync_lock": F.col("track_id") % 4 != 0, "enabled": F.col("track_id") % 11 != 5,
        "muted": F.col("track_id") % 9 == 4, "solo": F.col("track_id") % 13 == 6,
    })


TRK = "tk AS (SELECT DISTINCT sequence_id, track_id, kind, CASE WHEN track_id % 4 = 2 THEN 1 ELSE 0 END AS pos, track_id % 7 = 3 AS locked, track_id % 4 <> 0 AS sync_lock, track_id % 11 <> 5 AS enabled, track_id % 9 = 4 AS muted, track_id % 13 = 6 AS solo FROM clips)"
PLC = """pl AS (SELECT *, clip_id AS edit_id FROM (SELECT sequence_id, track_id, clip_id, ft, start + 2 * ft AS start, 10 * ft AS duration, source_in, speed, reverse FROM clips WHERE rn % 4 = 2 AND track_id % 7 <> 3))"""


def placements(spark, d):
    c = fx.clips(spark, d).filter("rn % 4 = 2 and track_id % 7 != 3")
    return c.select("sequence_id", "track_id", "clip_id", "item_id", (F.col("start") + 2 * F.col("ft")).alias("start"), (10 * F.col("ft")).alias("duration"), "source_in", "speed", "reverse", "frame_hold", "ft", F.col("clip_id").alias("edit_id"), F.col("rn").alias("ord"))


@query("insert", using("spans", f""", {TRK}, {PLC}, mv AS (SELECT k.track_id, p.start AS pt, p.duration AS delta, p.edit_id FROM pl p JOIN tk k ON k.sequence_id = p.sequence_id AND NOT k.locked AND (k.sync_lock OR k.track_id = p.track_id)),
w AS (SELECT s.*, pt AS t FROM spans s JOIN (SELECT DISTINCT track_id, pt FROM mv) m ON m.track_id = s.track_id WHERE s.start < pt AND pt < s."end" UNION ALL SELECT *, "end" FROM spans), p AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY clip_id ORDER BY t), start) AS lo, t AS hi FROM w)
SELECT sequence_id, track_id, clip_id AS origin, CAST(lo + coalesce((SELECT sum(delta) FROM mv WHERE mv.track_id = p.track_id AND pt <= lo), 0) AS BIGINT) AS start, hi - lo AS duration, {PIECE} AS source_in FROM p
UNION ALL SELECT sequence_id, track_id, clip_id, CAST(start + coalesce((SELECT sum(delta) FROM mv WHERE mv.track_id = pl.track_id AND pt < pl.start), 0) AS BIGINT), duration, source_in FROM pl"""))
def insert(spark, d):
    return pick(ed.insert(fx.clips(spark, d).select(BASE), placements(spark, d), tracks(spark, d)))


@query("overwrite", using("spans", f""", po AS (SELECT sequence_id, track_id, clip_id, rn AS ord, start + 2 * ft AS start, 30 * ft AS duration, start + 32 * ft AS "end", source_in, speed, reverse FROM clips WHERE rn % 4 >= 2 AND track_id % 7 <> 3), {sql_merge('po', 'mo', 'track_id')},
hl AS (SELECT s.sequence_id, s.track_id, s.clip_id, s.start, s.duration, s.source_in, s.speed, s.reverse, greatest(s.start, m.start) AS h0, least(s."end", m."end") AS h1 FROM spans s JOIN mo m ON s.track_id = m.track_id AND s.start < m."end" AND m.start < s."end" UNION ALL SELECT sequence_id, track_id, clip_id, start, duration, source_in, speed, reverse, "end", "end" FROM spans),
hp AS (SELECT *, coalesce(lag(h1) OVER (PARTITION BY clip_id ORDER BY h0, h1), start) AS lo, h0 AS hi FROM hl),
ph0 AS (SELECT a.clip_id, greatest(a.start, b.start) AS start, least(a."end", b."end") AS "end" FROM po a JOIN po b ON a.track_id = b.track_id AND b.ord > a.ord AND a.start < b."end" AND b.start < a."end"), {sql_merge('ph0', 'pm', 'clip_id')},
ql AS (SELECT po.*, pm.start AS h0, pm."end" AS h1 FROM po JOIN pm USING (clip_id) UNION ALL SELECT *, "end", "end" FROM po), qp AS (SELECT *, coalesce(lag(h1) OVER (PARTITION BY clip_id ORDER BY h0, h1), start) AS lo, h0 AS hi FROM ql)
SELECT sequence_id, track_id, clip_id AS origin, lo AS start, hi - lo AS duration, {PIECE} AS source_in FROM hp WHERE hi > lo UNION ALL SELECT sequence_id, track_id, clip_id, lo, hi - lo, {PIECE} FROM qp WHERE hi > lo"""))
def overwrite(spark, d):
    c = fx.clips(spark, d)
    p = c.filter("rn % 4 >= 2 and track_id % 7 != 3").withColumn("ord", F.col("rn")).withColumns({"start": F.col("start") + 2 * F.col("ft"), "duration": 30 * F.col("ft")})
    return pick(ed.overwrite(c.select(BASE), p.select(*BASE, "ord")))


DELS = f""", {TRK}, c AS (SELECT s.*, locked, sync_lock, rn % 4 = 1 AS del FROM spans s JOIN tk USING (track_id)), af AS (SELECT DISTINCT track_id FROM c WHERE del), c2 AS (SELECT *, track_id IN (SELECT track_id FROM af) AS aff FROM c),
dd AS (SELECT sequence_id, start, "end" FROM c2 WHERE aff AND NOT locked AND del), kk AS (SELECT sequence_id, start, "end" FROM c2 WHERE aff AND NOT locked AND NOT del), {sql_merge('dd', 'dm', 'sequence_id')}, {sql_merge('kk', 'km', 'sequence_id')},
hw AS (SELECT d.sequence_id, d.start AS s0, greatest(d.start, k.start) AS h0, least(d."end", k."end") AS h1 FROM dm d JOIN km k ON d.sequence_id = k.sequence_id AND d.start < k."end" AND k.start < d."end" UNION ALL SELECT sequence_id, start, "end", "end" FROM dm),
hv AS (SELECT *, coalesce(lag(h1) OVER (PARTITION BY sequence_id, s0 ORDER BY h0, h1), s0) AS lo FROM hw), sp AS (SELECT sequence_id, lo AS start, h0 AS "end" FROM hv WHERE h0 > lo),
bad AS (SELECT DISTINCT sp.sequence_id, 'sync lock' AS reason FROM sp JOIN c2 ON c2.sequence_id = sp.sequence_id AND NOT aff AND NOT locked AND sync_lock AND c2.start < sp."end" AND sp.start < c2."end"
 UNION ALL SELECT DISTINCT sequence_id, 'nothing closes' FROM c2 WHERE del AND sequence_id NOT IN (SELECT sequence_id FROM sp))"""


def deleted(spark, d):
    c = fx.clips(spark, d)
    return ed.ripple_delete_items(c.select(*BASE), c.filter("rn % 4 = 1").select("clip_id"), tracks(spark, d))


@query("ripple_delete_items", using("spans", DELS + """ SELECT sequence_id, track_id, clip_id, start, duration FROM c2 WHERE sequence_id IN (SELECT sequence_id FROM bad)
UNION ALL SELECT sequence_id, track_id, clip_id, CAST(start - CASE WHEN NOT locked AND (aff OR sync_lock) THEN coalesce((SELECT sum(sp."end" - sp.start) FROM sp WHERE sp.sequence_id = c2.sequence_id AND sp."end" <= c2.start), 0) ELSE 0 END AS BIGINT), duration
FROM c2 WHERE sequence_id NOT IN (SELECT sequence_id FROM bad) AND NOT (del AND NOT locked)"""))
def ripple_delete_items(spark, d):
    return deleted(spark, d)[0].select("sequence_id", "track_id", "clip_id", "start", "duration")


@query("ripple_delete_conflicts", using("spans", DELS + " SELECT * FROM bad"))
def ripple_delete_conflicts(spark, d):
    return deleted(spark, d)[1]


GAPS = """mk AS (SELECT sequence_id, clip_id AS marker_id, start + CASE WHEN rn % 2 = 0 THEN duration + ft ELSE 0 END AS start FROM clips WHERE rn % 3 = 0),
g0 AS (SELECT *, coalesce(max("end") OVER (PARTITION BY sequence_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cov FROM spans), gp AS (SELECT sequence_id, cov AS start, start AS "end" FROM g0 WHERE start > cov)"""


def closed(spark, d):
    c = fx.clips(spark, d)
    mk = c.filter("rn % 3 = 0").select("sequence_id", F.col("clip_id").alias("marker_id"), (F.col("start") + F.when(F.col("rn") % 2 == 0, F.col("duration") + F.col("ft")).otherwise(0)).alias("start"))
    none = c.limit(0).select("sequence_id", F.col("clip_id").alias("caption_id"), "start", "duration")
    return ed.close_gaps(c, none, mk)


@query("close_gaps", using("spans", f""", {GAPS} SELECT clip_id, CAST(start - coalesce((SELECT sum(gp."end" - gp.start) FROM gp WHERE gp.sequence_id = s.sequence_id AND gp."end" <= s.start), 0) AS BIGINT) AS start, duration FROM spans s"""))
def close_gaps(spark, d):
    return closed(spark, d)[0].select("clip_id", "start", "duration")


@query("close_gaps_markers", using("spans", f""", {GAPS} SELECT marker_id, CAST(start - coalesce((SELECT sum(gp."end" - gp.start) FROM gp WHERE gp.sequence_id = s.sequence_id AND gp."end" <= s.start), 0) AS BIGINT) AS start FROM mk s
WHERE NOT EXISTS (SELECT 1 FROM gp WHERE gp.sequence_id = s.sequence_id AND gp.start <= s.start AND s.start < gp."end")"""))
def close_gaps_markers(spark, d):
    return closed(spark, d)[2].select("marker_id", "start")


# three video tracks for moving clips down: 0 fixed, then 1, then 2
def stacked(spark, d):
    c = fx.clips(spark, d)
    p = (F.col("track_id") % 4).cast("int")
    c = c.withColumns({"kind": F.lit("video"), "link": F.when(F.col("rn") % 5 < 2, F.col("sequence_id"))})
    t = c.select("sequence_id", "track_id", "kind").distinct().withColumns({"pos": (F.col("track_id") % 4).cast("int"), "locked": F.lit(False)})
    return c, t


STK = """st AS (SELECT *, CAST(track_id % 4 AS INT) AS pos FROM spans WHERE enabled), tr AS (SELECT DISTINCT sequence_id, track_id % 4 AS pos FROM clips),
s1 AS (SELECT * REPLACE (CASE WHEN pos = 1 AND EXISTS (SELECT 1 FROM tr WHERE tr.sequence_id = a.sequence_id AND tr.pos = 0) AND NOT EXISTS (SELECT 1 FROM st b WHERE b.sequence_id = a.sequence_id AND b.pos = 0 AND a.start < b."end" AND b.start < a."end") THEN 0 ELSE pos END AS pos), pos AS p0 FROM st a),
s2 AS (SELECT * REPLACE (CASE WHEN pos = 2 AND EXISTS (SELECT 1 FROM tr WHERE tr.sequence_id = a.sequence_id AND tr.pos = 0) AND NOT EXISTS (SELECT 1 FROM s1 b WHERE b.sequence_id = a.sequence_id AND b.pos = 0 AND a.start < b."end" AND b.start < a."end") THEN 0
  WHEN pos = 2 AND EXISTS (SELECT 1 FROM tr WHERE tr.sequence_id = a.sequence_id AND tr.pos = 1) AND NOT EXISTS (SELECT 1 FROM s1 b WHERE b.sequence_id = a.sequence_id AND b.pos = 1 AND a.start < b."end" AND b.start < a."end") THEN 1 ELSE pos END AS pos) FROM s1 a),
g0 AS (SELECT *, coalesce(max("end") OVER (PARTITION BY sequence_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cov FROM s2), gp AS (SELECT sequence_id, cov AS start, start AS "end" FROM g0 WHERE start > cov)"""


@query("simplify_sequences", using("spans", f""", {STK} SELECT clip_id, pos, CAST(start - coalesce((SELECT sum(gp."end" - gp.start) FROM gp WHERE gp.sequence_id = s.sequence_id AND gp."end" <= s.start), 0) AS BIGINT) AS start,
 CASE WHEN rn % 5 < 2 AND (SELECT count(*) FROM st x WHERE x.sequence_id = s.sequence_id AND x.rn % 5 < 2) >= 2 THEN sequence_id END AS link FROM s2 s"""))
def simplify_sequences(spark, d):
    return ed.simplify_sequences(*stacked(spark, d))[0].select("clip_id", "pos", "start", "link")


@query("simplify_report", using("spans", f""", {STK}, n0 AS (SELECT sequence_id, count(*) AS n, count(DISTINCT track_id) AS t FROM spans GROUP BY 1), n1 AS (SELECT sequence_id, count(*) AS n, count(*) FILTER (pos <> p0) AS m, count(DISTINCT pos) AS t FROM s2 GROUP BY 1), gs AS (SELECT sequence_id, sum("end" - start) AS g FROM gp GROUP BY 1)
SELECT n0.sequence_id, n0.n - coalesce(n1.n, 0) AS removed_clips, coalesce(m, 0) AS moved_clips, CAST(coalesce(g, 0) AS BIGINT) AS closed_gaps, n0.t - greatest(coalesce(n1.t, 0), 1) AS removed_tracks FROM n0 LEFT JOIN n1 USING (sequence_id) LEFT JOIN gs USING (sequence_id)"""))
def simplify_report(spark, d):
    return ed.simplify_sequences(*stacked(spark, d))[1]


NB = """nb AS (SELECT s.*, m.duration AS md, lag(s."end") OVER w AS pe, lead(s.start) OVER w AS ns FROM spans s LEFT JOIN media m USING (item_id) WINDOW w AS (PARTITION BY track_id ORDER BY start, clip_id))"""
FAR = ed.FAR


def deltas(spark, d):
    c = fx.clips(spark, d).filter("rn % 5 < 3")
    return c.select("clip_id", F.when(F.col("rn") % 2 == 0, "in").otherwise("out").alias("edge"), ((F.col("clip_id") % 41 - 20) * F.col("ft")).alias("delta"))


@query("bulk_trim", using("spans media", f""", {NB}, dl AS (SELECT *, CASE WHEN rn % 2 = 0 THEN 'in' ELSE 'out' END AS edge, (clip_id % 41 - 20) * ft AS delta FROM nb WHERE rn % 5 < 3),
d2 AS (SELECT *, count(*) OVER (PARTITION BY track_id, CASE WHEN edge = 'in' THEN start ELSE "end" END) AS same, source_in + {r0('duration * speed')} AS so FROM dl),
d3 AS (SELECT *, CAST(floor((CASE WHEN reverse THEN md - so ELSE source_in END) / speed) AS BIGINT) AS hd, CAST(floor((CASE WHEN reverse THEN source_in ELSE md - so END) / speed) AS BIGINT) AS rm FROM d2),
ap AS (SELECT clip_id, edge, CASE WHEN same > 1 THEN 0 WHEN edge = 'in' THEN least(greatest(delta, greatest(-(start - coalesce(pe, 0)), -hd)), duration - ft)
 ELSE least(greatest(delta, -(duration - ft)), greatest(least(coalesce(ns, {FAR}) - "end", rm), -(duration - ft))) END AS a FROM d3), j AS (SELECT nb.*, edge, coalesce(a, 0) AS a FROM nb LEFT JOIN ap USING (clip_id))
SELECT clip_id, start + CASE WHEN edge = 'in' THEN a ELSE 0 END AS start, duration + CASE WHEN edge = 'in' THEN -a ELSE a END AS duration,
 CASE WHEN edge = 'in' AND NOT reverse THEN source_in + {r0('a * speed')} WHEN edge = 'out' AND reverse THEN source_in - {r0('a * speed')} ELSE source_in END AS source_in FROM j"""))
def bulk_trim(spark, d):
    return ed.bulk_trim(fx.clips(spark, d), fx.media(spark, d), deltas(spark, d))[0].select("clip_id", "start", "duration", "source_in")


@query("bulk_slip", using("clips media", f"""SELECT clip_id, CASE WHEN rn % 3 <> 0 THEN c.source_in ELSE least(greatest(c.source_in + (clip_id % 301 - 150) * ft, 0), greatest(m.duration - {r0('c.duration * speed')}, 0)) END AS source_in FROM clips c JOIN media m USING (item_id)"""))
def bulk_slip(spark, d):
    c = fx.clips(spark, d)
    return ed.bulk_slip(c, fx.media(spark, d), c.filter("rn % 3 = 0").select("clip_id", ((F.col("clip_id") % 301 - 150) * F.col("ft")).alias("delta"))).select("clip_id", "source_in")


@query("bulk_roll", using("spans media", f""", p0 AS (SELECT s.*, m.duration AS md, lead(clip_id) OVER w AS rid FROM spans s JOIN media m USING (item_id) WINDOW w AS (PARTITION BY track_id ORDER BY start, clip_id)),
q AS (SELECT l.*, (l.clip_id % 31 - 15) * l.ft AS delta, r.duration AS rd, r.source_in AS rs, r.speed AS rv, r.reverse AS rr, r.md AS rm, r.source_in + {r0('r.duration * r.speed')} AS ro FROM p0 l JOIN p0 r ON r.clip_id = l.rid AND r.start = l."end" WHERE l.rn % 3 <> 0),
sh AS (SELECT x FROM (SELECT clip_id AS x FROM q UNION ALL SELECT rid FROM q) GROUP BY x HAVING count(*) > 1),
a0 AS (SELECT *, least(greatest(delta, -(duration - ft)), rd - ft) AS d0 FROM q WHERE clip_id NOT IN (SELECT x FROM sh) AND rid NOT IN (SELECT x FROM sh)),
a1 AS (SELECT *, greatest(least(d0, CAST(floor((md - source_in - {r0('duration * speed')}) / speed) AS BIGINT)), -CAST(floor((CASE WHEN rr THEN rm - ro ELSE rs END) / rv) AS BIGINT)) AS a FROM a0)
SELECT c.clip_id, c.start + coalesce(r.a, 0) AS start, c.duration + coalesce(l.a, 0) - coalesce(r.a, 0) AS duration, c.source_in + {r0('coalesce(r.a, 0) * c.speed')} AS source_in FROM clips c LEFT JOIN a1 l ON l.clip_id = c.clip_id LEFT JOIN a1 r ON r.rid = c.clip_id"""))
def bulk_roll(spark, d):
    c = fx.clips(spark, d)
    return ed.bulk_roll(c, fx.media(spark, d), c.filter("rn % 3 != 0").select("clip_id", ((F.col("clip_id") % 31 - 15) * F.col("ft")).alias("delta")))[0].select("clip_id", "start", "duration", "source_in")


SPD = f"""nb AS (SELECT *, lead(start) OVER (PARTITION BY track_id ORDER BY start, clip_id) AS ns, CASE WHEN rn % 3 = 0 THEN CASE WHEN rn % 2 = 0 THEN 0.5::DOUBLE ELSE 4.0::DOUBLE END END AS nv FROM spans),
q AS (SELECT *, greatest({r0("(source_in + " + r0('duration * speed') + " - source_in) / nv")}, ft) AS nd FROM nb)"""


def speeds(c):
    return c.filter("rn % 3 = 0").select("clip_id", F.when(F.col("rn") % 2 == 0, 0.5).otherwise(4.0).alias("new_speed"), F.lit(True).alias("new_reverse"))


@query("bulk_speed", using("spans", f""", {SPD} SELECT clip_id, start, CASE WHEN nv IS NULL THEN duration ELSE least(nd, coalesce(ns, {FAR}) - start) END AS duration, coalesce(nv, speed) AS speed, nv IS NOT NULL OR reverse AS reverse FROM q"""))
def bulk_speed(spark, d):
    c = fx.clips(spark, d)
    return ed.bulk_speed(c, speeds(c)).select("clip_id", "start", "duration", "speed", "reverse")


@query("bulk_speed_ripple", using("spans", f""", {SPD} SELECT clip_id, CAST(start + coalesce((SELECT sum(x.nd - x.duration) FROM q x WHERE x.track_id = q.track_id AND x.nv IS NOT NULL AND x."end" <= q.start), 0) AS BIGINT) AS start, CASE WHEN nv IS NULL THEN duration ELSE nd END AS duration FROM q"""))
def bulk_speed_ripple(spark, d):
    c = fx.clips(spark, d)
    return ed.bulk_speed(c, speeds(c), True).select("clip_id", "start", "duration")


@query("subsequence", using("spans", f""", r AS (SELECT sequence_id, clip_id AS range_id, start + 2 * ft AS b0, start + 42 * ft AS b1 FROM spans WHERE rn = 2),
p AS (SELECT s.*, range_id, b0, greatest(s.start, b0) AS lo, least(s."end", b1) AS hi FROM spans s JOIN r ON r.sequence_id = s.sequence_id AND s.start < b1 AND b0 < s."end")
SELECT range_id, clip_id AS origin, lo - b0 AS start, hi - lo AS duration, {PIECE} AS source_in FROM p"""))
def subsequence(spark, d):
    c = fx.clips(spark, d)
    r = c.filter("rn = 2").select("sequence_id", F.col("clip_id").alias("range_id"), (F.col("start") + 2 * F.col("ft")).alias("b_start"), (F.col("start") + 42 * F.col("ft")).alias("b_end"))
    return ed.subsequence(c, r).select("range_id", "origin", "start", "duration", "source_in")


THR = f"""pv AS (SELECT *, start + duration AS e, lag(clip_id) OVER w AS pid, lag(start + duration) OVER w AS pe, lag(item_id) OVER w AS pi, lag(speed) OVER w AS ps, lag(reverse) OVER w AS pr, lag(source_in) OVER w AS psi, lag(source_in + {r0('duration * speed')}) OVER w AS pso FROM through WINDOW w AS (PARTITION BY track_id ORDER BY start, clip_id)),
tf AS (SELECT *, coalesce(pe = start AND pi = item_id AND ps = speed AND pr = reverse AND abs(CASE WHEN pr THEN source_in + {r0('duration * speed')} - psi ELSE source_in - pso END) <= 2, false) AS thr FROM pv)"""


@query("through_edits", using("through", f", {THR} SELECT sequence_id, track_id, pid AS left_id, clip_id AS right_id, start AS t FROM tf WHERE thr"))
def through_edits(spark, d):
    return ed.through_edits(fx.through(spark, d))


@query("join_through_edits", using("through", f""", {THR}, i AS (SELECT *, sum(CASE WHEN thr THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY start, clip_id) AS isl FROM tf)
SELECT arg_min(clip_id, start) AS clip_id, min(start) AS start, CAST(sum(duration) AS BIGINT) AS duration, CASE WHEN min(CAST(reverse AS INT)) = 1 THEN arg_max(source_in, start) ELSE arg_min(source_in, start) END AS source_in FROM i GROUP BY track_id, isl"""))
def join_through_edits(spark, d):
    return ed.join_through_edits(fx.through(spark, d))[0].select("clip_id", "start", "duration", "source_in")


def trans(spark, d):
    c = ed.through_edits(fx.through(spark, d))
    inside = c.select("track_id", F.col("right_id").alias("transition_id"), F.col("t").alias("start"), F.col("left_id").alias("from_clip"), F.col("right_id").alias("to_clip"))
    fade = c.select("track_id", (-F.col("right_id")).alias("transition_id"), F.col("t").alias("start"), F.col("right_id").alias("from_clip"), F.lit(None).cast("long").alias("to_clip"))
    return inside.unionByName(fade)


@query("join_through_transitions", using("through", f""", {THR}, i AS (SELECT *, sum(CASE WHEN thr THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY start, clip_id) AS isl FROM tf), w AS (SELECT clip_id, first_value(clip_id) OVER (PARTITION BY track_id, isl ORDER BY start, clip_id) AS f FROM i)
SELECT -clip_id AS transition_id, f AS from_clip FROM tf JOIN w USING (clip_id) WHERE thr"""))
def join_through_transitions(spark, d):
    return ed.join_through_edits(fx.through(spark, d), trans(spark, d))[1].select("transition_id", "from_clip")


def vtracks(spark, d):
    return tracks(spark, d).withColumn("kind", F.lit("video"))


def classes(segments, first):
    """Segments with the first segment of equal content in place of the hash itself."""
    at = F.col("sequence_id") * 1_000_000_000 + F.col(first)
    same = segments.groupBy("hash").agg(F.min(at).alias("same_as"))
    return segments.join(same, "hash").drop("hash")


#: What a layer shows, laid end to end bottom-up: equal texts, equal content.
SHOWN = "string_agg(concat(pos, ':', item_id, ':', speed, ':', reverse, ':', source_in + CAST((t - start) * speed AS BIGINT)), ',' ORDER BY pos, item_id, speed, reverse, source_in + CAST((t - start) * speed AS BIGINT))"


@query("render_segments", using("spans", f""", {TRK}, v AS (SELECT s.*, pos FROM spans s JOIN tk USING (track_id) WHERE tk.enabled), m AS (SELECT DISTINCT sequence_id, ft, t FROM (SELECT sequence_id, ft, start AS t FROM v UNION ALL SELECT sequence_id, ft, "end" FROM v)),
n AS (SELECT *, lead(t) OVER (PARTITION BY sequence_id ORDER BY t) AS t1 FROM m), l AS (SELECT n.sequence_id, n.ft, n.t, n.t1, v.pos, v.clip_id, v.item_id, v.source_in, v.start, v.speed, v.reverse FROM n JOIN v ON v.sequence_id = n.sequence_id AND v.enabled AND v.start <= n.t AND n.t < v."end" WHERE t1 IS NOT NULL),
g AS (SELECT sequence_id, t // ft AS first_frame, (t1 - t) // ft AS frames, CAST(count(*) AS INT) AS layers, string_agg(CAST(clip_id AS VARCHAR), ',' ORDER BY pos, clip_id) AS clips, CASE WHEN count(*) * 8 > 20 THEN 'render' WHEN count(*) = 1 AND min(speed) = 1 AND NOT bool_or(reverse) THEN 'none' ELSE 'realtime' END AS need, concat(t1 - t, '=', {SHOWN}) AS content FROM l GROUP BY sequence_id, ft, t, t1)
SELECT * EXCLUDE (content), min(sequence_id * 1000000000 + first_frame) OVER (PARTITION BY content) AS same_as FROM g"""))
def render_segments(spark, d):
    return classes(ed.render_segments(fx.clips(spark, d).drop("kind"), vtracks(spark, d)), "first_frame")


@query("audio_segments", using("spans", f""", {TRK}, sl AS (SELECT sequence_id, bool_or(solo) AS a FROM tk WHERE kind = 'audio' GROUP BY 1), v AS (SELECT s.*, pos, NOT muted AND (NOT a OR solo) AS live FROM spans s JOIN tk USING (track_id) JOIN sl ON sl.sequence_id = s.sequence_id WHERE tk.kind = 'audio'),
k AS (SELECT sequence_id, -((-start - ((-start % 5292000) + 5292000) % 5292000) // 5292000) AS a, -((-"end" - ((-"end" % 5292000) + 5292000) % 5292000) // 5292000) AS b FROM v), m AS (SELECT DISTINCT sequence_id, t FROM (SELECT sequence_id, a AS t FROM k UNION ALL SELECT sequence_id, b FROM k)),
n AS (SELECT sequence_id, t AS s0, lead(t) OVER (PARTITION BY sequence_id ORDER BY t) AS s1, t * 5292000 AS t FROM m),
g AS (SELECT n.sequence_id, n.s0 AS first_sample, s1 - s0 AS samples, CAST(count(*) AS INT) AS layers, concat(s1 - s0, '=', {SHOWN}) AS content FROM n JOIN v ON v.sequence_id = n.sequence_id AND v.enabled AND live AND v.start <= n.t AND n.t < v."end" WHERE s1 IS NOT NULL GROUP BY 1, 2, s0, s1)
SELECT * EXCLUDE (content), min(sequence_id * 1000000000 + first_sample) OVER (PARTITION BY content) AS same_as FROM g"""))
def audio_segments(spark, d):
    return classes(ed.audio_segments(fx.clips(spark, d).drop("kind"), tracks(spark, d), 5_292_000), "first_sample")


def multicam(spark, d):
    c = fx.clips(spark, d).filter("kind = 'video'").withColumns({"item_id": F.col("sequence_id") % 3, "angle": F.lit(9).cast("long"), "reverse": F.lit(False), "source_in": F.col("start"), "speed": F.lit(1.0)})
    p = fx.clips(spark, d).filter("kind = 'audio'").select("sequence_id", (F.col("sequence_id") % 3).alias("item_id"), F.col("clip_id").alias("press"), (F.col("start") + 4 * F.col("ft")).alias("time"), (F.col("rn") % 2).alias("angle"))
    e = p.groupBy("sequence_id", "item_id").agg((F.max("time") + 1_000_000).alias("end_time"))
    return ed.multicam_record(c.select(*BASE, "angle"), p, e)


@query("multicam_record", using("spans", f""", c AS (SELECT sequence_id, track_id, clip_id, start, "end" FROM spans WHERE kind = 'video'), pr AS (SELECT sequence_id, start + 4 * ft AS time, arg_max(rn % 2, clip_id) AS angle FROM spans WHERE kind = 'audio' GROUP BY 1, 2),
en AS (SELECT sequence_id, max(time) + 1000000 AS e, min(time) AS t0 FROM pr GROUP BY 1), ps AS (SELECT *, coalesce(lead(time) OVER (PARTITION BY sequence_id ORDER BY time), e) AS nx FROM pr JOIN en USING (sequence_id)), mk AS (SELECT sequence_id, time AS t FROM pr UNION SELECT sequence_id, e FROM en),
w AS (SELECT c.*, t FROM c JOIN mk USING (sequence_id) WHERE c.start < t AND t < c."end" UNION ALL SELECT *, "end" FROM c), p AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY clip_id ORDER BY t), start) AS lo FROM w),
a AS (SELECT p.sequence_id, p.track_id, p.clip_id, p.lo, p.t AS hi, coalesce(ps.angle, 9) AS angle FROM p LEFT JOIN ps ON ps.sequence_id = p.sequence_id AND ps.time <= p.lo AND p.lo < ps.nx),
h AS (SELECT a.*, coalesce(lag(hi) OVER q = lo AND lag(angle) OVER q = angle AND lo BETWEEN en.t0 AND en.e, false) AS heal FROM a LEFT JOIN en USING (sequence_id) WINDOW q AS (PARTITION BY track_id ORDER BY lo)),
i AS (SELECT *, sum(CASE WHEN heal THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY lo) AS isl FROM h)
SELECT sequence_id, track_id, min(lo) AS start, CAST(sum(hi - lo) AS BIGINT) AS duration, min(angle) AS angle FROM i GROUP BY sequence_id, track_id, isl"""))
def multicam_record(spark, d):
    return multicam(spark, d).select("sequence_id", "track_id", "start", "duration", "angle")
