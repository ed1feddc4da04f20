"""Sample tables: levels, loudness, envelopes, keyframes, mixing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tickloom.operators import audio as au
from tickloom.plans import fixtures as fx
from tickloom.plans.queries_a_intervals import sql_merge
from tickloom.plans.registry import query
from tickloom.plans.sqltables import using

RATE = 8000
REP = 40


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("waveform_peaks", using("samples", "SELECT stream_id, ch, n // 100 AS bucket, least(min(x), 0) AS lo, greatest(max(x), 0) AS hi FROM samples GROUP BY 1, 2, 3"))
def waveform_peaks(spark, d):
    return au.waveform_peaks(fx.samples(spark, d), 100)


ENV = """pw AS (SELECT stream_id, n, x * x AS p FROM samples), le AS (SELECT stream_id, max(n) + 1 AS len FROM samples GROUP BY 1), pf AS (SELECT stream_id, n, sum(p) OVER (PARTITION BY stream_id ORDER BY n) AS c FROM pw),
kk AS (SELECT stream_id, len, unnest(range((len + 79) // 80)) AS k FROM le), kb AS (SELECT *, greatest(k * 80 - 200, 0) AS a, least(k * 80 + 200, len) AS b FROM kk),
env AS (SELECT kb.stream_id, k, greatest(10 * log10((hi.c - coalesce(lo.c, 0)) / (b - a)), -120) AS db FROM kb JOIN pf hi ON hi.stream_id = kb.stream_id AND hi.n = b - 1 LEFT JOIN pf lo ON lo.stream_id = kb.stream_id AND lo.n = a - 1)"""


@query("rms_envelope", using("samples", f", {ENV} SELECT stream_id, k, round(db, 6) AS db FROM env"))
def rms_envelope(spark, d):
    return rounded(au.rms_envelope(fx.samples(spark, d), 80, 400), "db")


LEV = """lv AS (SELECT stream_id, n // 16 AS k, 10 * log10(avg(x * x) + 1e-12::DOUBLE) AS db FROM samples GROUP BY 1, 2),
rk AS (SELECT stream_id, db, row_number() OVER (PARTITION BY stream_id ORDER BY db) - 1 AS i, count(*) OVER (PARTITION BY stream_id) AS c FROM lv WHERE db > -100),
th AS (SELECT stream_id, greatest(lo + 0.3 * (hi - lo), lo + 6) AS thr FROM (SELECT stream_id, max(db) FILTER (i = CAST(floor((c - 1) * 0.1::DOUBLE) AS BIGINT)) AS lo, max(db) FILTER (i = CAST(floor((c - 1) * 0.95::DOUBLE) AS BIGINT)) AS hi FROM rk GROUP BY 1))"""


@query("speech_threshold", using("samples", f", {LEV} SELECT stream_id, round(thr, 6) AS thr FROM th"))
def speech_threshold(spark, d):
    return rounded(au.speech_threshold(au.frame_levels(fx.samples(spark, d), 16)), "thr")


TICKS = 254_016_000_000 // RATE * 16


def speech_words(spark, d):
    w = fx.words(spark, d)
    return w.select(F.col("sequence_id").alias("stream_id"), "idx", (F.col("start") / 20).cast("long").alias("start"), (F.col("end") / 20).cast("long").alias("end"))


def loud_frames(spark, d):
    # the raw levels vary little, so the frame index adds quiet stretches
    f = au.frame_levels(fx.samples(spark, d), 16)
    return f.withColumn("db", F.col("db") - F.when(F.col("k") % 12 < 7, 30).otherwise(0))


@query("tighten_words", using("samples words", f""", {LEV.replace('AS db FROM samples GROUP BY 1, 2)', '- CASE WHEN (n // 16) % 12 < 7 THEN 30 ELSE 0 END AS db FROM samples GROUP BY 1, 2)').replace('GROUP BY 1, 2)', 'GROUP BY stream_id, n // 16)', 1)},
ln AS (SELECT stream_id, max(k) + 1 AS len FROM lv GROUP BY 1), w AS (SELECT sequence_id AS stream_id, idx, CAST(floor(start / 20.0::DOUBLE) AS BIGINT) AS start, CAST(floor("end" / 20.0::DOUBLE) AS BIGINT) AS "end" FROM words),
w2 AS (SELECT w.*, start // {TICKS} AS a, least(("end" + {TICKS - 1}) // {TICKS}, len) AS b FROM w JOIN ln USING (stream_id)), vo AS (SELECT lv.stream_id, k FROM lv JOIN th USING (stream_id) WHERE db >= thr),
w3 AS (SELECT w2.*, (SELECT min(k) FROM vo WHERE vo.stream_id = w2.stream_id AND k >= a) AS f, (SELECT max(k) FROM vo WHERE vo.stream_id = w2.stream_id AND k < b) AS l FROM w2),
w4 AS (SELECT *, least(f, b - 6) AS s, greatest(l + 1, least(f, b - 6) + 6) AS e FROM w3), w5 AS (SELECT *, b > a + 6 AND f IS NOT NULL AND f < e AS ok FROM w4)
SELECT stream_id, idx, CASE WHEN ok AND s > a THEN s * {TICKS} ELSE start END AS start, CASE WHEN ok AND e < b THEN greatest(e * {TICKS}, CASE WHEN s > a THEN s * {TICKS} ELSE start END) ELSE "end" END AS "end" FROM w5"""))
def tighten_words(spark, d):
    f = loud_frames(spark, d)
    return au.tighten_words(speech_words(spark, d), f, au.speech_threshold(f), TICKS)


@query("k_weighted_energy")
def k_weighted_energy(spark, d):
    return rounded(au.k_weighted_energy(fx.samples(spark, d, REP), RATE), "e", digits=9)


# plain block energies with a slow level change, so that the gates have something to cut
def blocks(spark, d):
    s = fx.samples(spark, d)
    b = s.groupBy("stream_id", F.floor(F.col("n") / 16).cast("long").alias("block")).agg(F.sum(F.col("x") * F.col("x")).alias("e"))
    return b.select("stream_id", "block", (F.col("e") * F.pow(F.lit(10.0), -(F.col("block") % 90) / 15.0)).alias("e"), F.lit(16).alias("m"))


SER = """bl AS (SELECT stream_id, n // 16 AS block, sum(x * x) * pow(10.0::DOUBLE, -((n // 16) % 90) / 15.0::DOUBLE) AS e FROM samples GROUP BY stream_id, n // 16),
en AS (SELECT stream_id, block, sum(e) OVER (PARTITION BY stream_id ORDER BY block RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) / 64 AS em, sum(e) OVER (PARTITION BY stream_id ORDER BY block RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) / 480 AS es FROM bl),
se AS (SELECT *, -0.691::DOUBLE + 10 * log10(em) AS momentary, -0.691::DOUBLE + 10 * log10(es) AS short_term FROM en)"""


@query("loudness_series", using("samples", f", {SER} SELECT stream_id, block, round(momentary, 6) AS momentary, round(short_term, 6) AS short_term FROM se"))
def loudness_series(spark, d):
    return rounded(au.loudness_series(blocks(spark, d)), "momentary", "short_term").drop("em", "es")


@query("loudness_maxima", using("samples", f", {SER} SELECT stream_id, round(max(momentary) FILTER (block >= 3), 6) AS max_momentary, round(max(short_term) FILTER (block >= 29), 6) AS max_short_term FROM se GROUP BY 1"))
def loudness_maxima(spark, d):
    return rounded(au.loudness_maxima(au.loudness_series(blocks(spark, d))), "max_momentary", "max_short_term")


def gated(level, energy, first, gate):
    return f"""bn AS (SELECT stream_id, CAST(least(greatest(floor(({level} + 70) / 0.01::DOUBLE), 0), 8999) AS INT) AS bin, sum({energy}) AS e, count(*) AS m FROM se WHERE block >= {first} AND {level} >= -70 GROUP BY 1, 2),
tr AS (SELECT stream_id, -0.691::DOUBLE + 10 * log10(sum(e) / sum(m)) - {gate} AS thr FROM bn GROUP BY 1), kp AS (SELECT bn.*, thr FROM bn JOIN tr USING (stream_id) WHERE bin >= CASE WHEN thr < -70 THEN 0 ELSE floor((thr + 70) / 0.01::DOUBLE) END)"""


@query("integrated_loudness", using("samples", f", {SER}, {gated('momentary', 'em', 3, 10)} SELECT stream_id, round(-0.691::DOUBLE + 10 * log10(sum(e) / sum(m)), 6) AS integrated, round(max(thr), 6) AS thr FROM kp GROUP BY 1"))
def integrated_loudness(spark, d):
    return rounded(au.integrated_loudness(au.loudness_series(blocks(spark, d))), "integrated", "thr")


@query("loudness_range", using("samples", f""", {SER}, {gated('short_term', 'es', 29, 20)}, cu AS (SELECT *, sum(m) OVER (PARTITION BY stream_id ORDER BY bin) AS cum, sum(m) OVER (PARTITION BY stream_id) AS n FROM kp)
SELECT stream_id, round((min(bin) FILTER (cum > least(round(0.95 * (n - 1)), n - 1)) - min(bin) FILTER (cum > least(round(0.10 * (n - 1)), n - 1))) * 0.01::DOUBLE, 6) AS lra FROM cu GROUP BY 1"""))
def loudness_range(spark, d):
    return rounded(au.loudness_range(au.loudness_series(blocks(spark, d))), "lra")


BANK = au.true_peak_bank(RATE)
TAPS = ", ".join("abs(" + " + ".join(f"coalesce(lag(x, {j}) OVER q, 0) * ({BANK[p, j]!r})" for j in range(BANK.shape[1])) + ")" for p in range(BANK.shape[0])).replace("np.float64", "")


@query("peak_levels", using("samples", f""", fi AS (SELECT stream_id, ch, abs(x) AS a, greatest({TAPS}, abs(x)) AS t FROM samples WINDOW q AS (PARTITION BY stream_id ORDER BY n))
SELECT stream_id, ch, round(max(a), 6) AS sp, round(max(t), 6) AS tp, round(20 * log10(max(a)), 5) AS sp_db, round(20 * log10(max(t)), 5) AS tp_db FROM fi GROUP BY 1, 2"""))
def peak_levels(spark, d):
    return rounded(rounded(au.peak_levels(fx.samples(spark, d), RATE, 512), "sp", "tp"), "sp_db", "tp_db", digits=5)


@query("loudness_gains", using("samples", f""", {SER}, {gated('momentary', 'em', 3, 10)}, i AS (SELECT stream_id, -0.691::DOUBLE + 10 * log10(sum(e) / sum(m)) AS l FROM kp GROUP BY 1), p AS (SELECT stream_id, 20 * log10(max(abs(x))) AS tp FROM samples GROUP BY 1)
SELECT stream_id, CASE WHEN stream_id % 4 <> 3 THEN round(least(-16 - stream_id - l, -1 - tp), 6) END AS gain_db, CASE WHEN stream_id % 4 = 3 THEN 'no audio type' END AS skipped FROM i JOIN p USING (stream_id)"""))
def loudness_gains(spark, d):
    s = fx.samples(spark, d)
    summary = au.integrated_loudness(au.loudness_series(blocks(spark, d))).join(s.groupBy("stream_id").agg((F.lit(20.0) * F.log10(F.max(F.abs("x")))).alias("tp_db")), "stream_id")
    targets = s.select("stream_id").distinct().filter("stream_id % 4 != 3").withColumn("target", -16.0 - F.col("stream_id"))
    return rounded(au.loudness_gains(summary, targets, -1.0), "gain_db")


ACT = f"""{ENV.replace('+ 79) // 80', '+ 7) // 8').replace('k * 80 - 200', 'k * 8 - 16').replace('k * 80 + 200', 'k * 8 + 16')}, ac AS (SELECT stream_id, k AS start, k + 1 AS "end" FROM env WHERE db > -17.5), am AS (SELECT *, lag("end") OVER (PARTITION BY stream_id ORDER BY start) AS pe FROM ac),
ai AS (SELECT *, sum(CASE WHEN pe IS NULL OR start - pe > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY start) AS g FROM am), rgn AS (SELECT stream_id, min(start) AS start, max("end") AS "end" FROM ai GROUP BY stream_id, g HAVING max("end") - min(start) >= 3)"""


def regions(spark, d):
    env = au.rms_envelope(fx.samples(spark, d), 8, 32)
    return au.activity_regions(env, -17.5, 0.01, 0.03, 0.02)


@query("activity_regions", using("samples", f", {ACT} SELECT * FROM rgn"))
def activity_regions(spark, d):
    return regions(spark, d)


HOPT = 2_540_160_000
FADE = 4_064_256_000


@query("duck_keyframes", using("samples", f""", {ACT}, cl AS (SELECT stream_id AS clip_id, {2 * HOPT} AS c0, {HOPT} * (max(n) // 8 - 1) AS c1, -3.0::DOUBLE AS base FROM samples GROUP BY 1), dr AS (SELECT r.stream_id AS clip_id, start * {HOPT} AS start, "end" * {HOPT} AS "end", c0, c1 FROM rgn r JOIN cl ON cl.clip_id = r.stream_id WHERE "end" * {HOPT} > c0 AND start * {HOPT} < c1),
dm AS (SELECT *, lag("end") OVER (PARTITION BY clip_id ORDER BY start) AS pe FROM dr), di AS (SELECT *, sum(CASE WHEN pe IS NULL OR start > pe + {2 * FADE} THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY start) AS g FROM dm), dg AS (SELECT clip_id, min(start) AS a, max("end") AS b, min(c0) AS c0, min(c1) AS c1 FROM di GROUP BY clip_id, g),
pt AS (SELECT clip_id, 0 AS o, greatest(a - {FADE}, c0) AS t, CASE WHEN a - {FADE} >= c0 THEN -3.0 ELSE -3.0 - 12.0 * least(greatest((c0 - a + {FADE}) / {FADE}.0::DOUBLE, 0), 1) END AS v, c0, c1 FROM dg
 UNION ALL SELECT clip_id, 1, greatest(a, c0), -15.0, c0, c1 FROM dg UNION ALL SELECT clip_id, 2, least(b, c1), -15.0, c0, c1 FROM dg
 UNION ALL SELECT clip_id, 3, least(b + {FADE}, c1), CASE WHEN b + {FADE} <= c1 THEN -3.0 ELSE -15.0 + 12.0 * least(greatest((c1 - b) / {FADE}.0::DOUBLE, 0), 1) END, c0, c1 FROM dg WHERE b < c1)
SELECT clip_id, t, round(arg_max(v, o), 6) AS v FROM pt WHERE t BETWEEN c0 AND c1 GROUP BY 1, 2"""))
def duck_keyframes(spark, d):
    r = regions(spark, d).select(F.col("stream_id").alias("clip_id"), (F.col("start") * HOPT).alias("start"), (F.col("end") * HOPT).alias("end"))
    c = fx.samples(spark, d).groupBy(F.col("stream_id").alias("clip_id")).agg((HOPT * (F.floor(F.max("n") / 8) - 1)).cast("long").alias("c1")).withColumns({"c0": F.lit(2 * HOPT).cast("long"), "base": F.lit(-3.0)})
    return rounded(au.duck_keyframes(r, c, 12.0, 0.016), "v")


KF = """k AS (SELECT owner_id, time, value, interp, lead(time) OVER w AS t1, lead(value) OVER w AS v1, lead(interp) OVER w AS i1 FROM keyframes WINDOW w AS (PARTITION BY owner_id ORDER BY time)),
pb AS (SELECT owner_id, time + off AS t FROM (SELECT DISTINCT owner_id, time FROM keyframes), (SELECT unnest([0, 777000000000, -3333000000000]) AS off))"""


def probes(spark, d):
    return fx.keyframes(spark, d).select("owner_id", F.explode(F.array(*[F.col("time") + F.lit(o).cast("long") for o in (0, 777_000_000_000, -3_333_000_000_000)])).alias("t"))




@query("keyframe_values", using("keyframes", f""", {KF}, j AS (SELECT pb.owner_id, pb.t, k.*EXCLUDE(owner_id), (SELECT arg_min(value, time) FROM keyframes f WHERE f.owner_id = pb.owner_id) AS v0 FROM pb ASOF LEFT JOIN k ON k.owner_id = pb.owner_id AND k.time <= pb.t),
u AS (SELECT *, CASE WHEN time < t AND t1 IS NOT NULL AND interp <> 'hold' THEN (t - time) / (t1 - time)::DOUBLE END AS u, interp = 'bezier' AS oe, i1 = 'bezier' OR interp = 'bezier' AS ie FROM j),
b(owner_id, t, i, lo, hi, u, x1, y1, x2, y2) AS (SELECT owner_id, t, 0, 0.0::DOUBLE, 1.0::DOUBLE, u, CASE WHEN oe THEN 0.3333 ELSE 1.0::DOUBLE / 3 END, CASE WHEN oe THEN 0 ELSE 1.0::DOUBLE / 3 END, CASE WHEN ie THEN 1 - 0.3333 ELSE 2.0::DOUBLE / 3 END, CASE WHEN ie THEN 1 ELSE 2.0::DOUBLE / 3 END FROM u WHERE u IS NOT NULL AND (oe OR ie)
 UNION ALL SELECT owner_id, t, i + 1, CASE WHEN below THEN mid ELSE lo END, CASE WHEN below THEN hi ELSE mid END, u, x1, y1, x2, y2 FROM (SELECT *, (lo + hi) / 2 AS mid, 3 * (1 - (lo + hi) / 2) * (1 - (lo + hi) / 2) * (lo + hi) / 2 * x1 + 3 * (1 - (lo + hi) / 2) * (lo + hi) / 2 * (lo + hi) / 2 * x2 + pow((lo + hi) / 2, 3) < u AS below FROM b WHERE i < 48)),
e AS (SELECT owner_id, t, 3 * (1 - s) * (1 - s) * s * y1 + 3 * (1 - s) * s * s * y2 + s * s * s AS e FROM (SELECT *, (lo + hi) / 2 AS s FROM b WHERE i = 48))
SELECT u.owner_id, u.t, round(CASE WHEN time IS NULL THEN v0 WHEN u IS NULL THEN value ELSE value + (v1 - value) * coalesce(e.e, u) END, 6) AS value FROM u LEFT JOIN (SELECT DISTINCT * FROM e) e ON e.owner_id = u.owner_id AND e.t = u.t""").replace("WITH ", "WITH RECURSIVE ", 1))
def keyframe_values(spark, d):
    return rounded(au.keyframe_values(fx.keyframes(spark, d), probes(spark, d)), "value")


def recorded(spark, d):
    p = fx.points(spark, d)
    return p.select(F.col("user_id").alias("owner_id"), F.col("event_id").alias("seq"), F.col("t"), F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(F.col("event_id") % 3).alias("v"))


@query("thin_keyframes")
def thin_keyframes(spark, d):
    return rounded(au.thin_keyframes(recorded(spark, d), 8.0, 400_000 * 254_016_000), "v")


HOLD = """r AS (SELECT user_id AS owner_id, event_id AS seq, t // 60000000000000 AS t, CAST(event_id % 3 AS DOUBLE) AS v FROM points), m AS (SELECT *, max(t) OVER (PARTITION BY owner_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi FROM r),
p AS (SELECT owner_id, t, arg_max(v, seq) AS v FROM m WHERE hi IS NULL OR t >= hi GROUP BY 1, 2), l AS (SELECT *, lag(v) OVER (PARTITION BY owner_id ORDER BY t) AS pv, count(*) OVER (PARTITION BY owner_id) AS n FROM p)"""


@query("thin_keyframes_hold", using("points", f", {HOLD} SELECT owner_id, t, v FROM l WHERE n <= 2 OR pv IS NULL OR abs(v - pv) > 1.5"))
def thin_keyframes_hold(spark, d):
    p = fx.points(spark, d).select(F.col("user_id").alias("owner_id"), F.col("event_id").alias("seq"), F.floor(F.col("t") / 60_000_000_000_000).cast("long").alias("t"), (F.col("event_id") % 3).cast("double").alias("v"))
    return au.thin_keyframes(p, 1.5, hold=True)


def surround(spark, d):
    s = fx.samples(spark, d)
    return s.withColumn("ch", F.explode(F.array(*[F.lit(i) for i in range(6)]))).withColumn("x", F.col("x") * (F.col("ch") + 1))


@query("channel_matrix", using("samples", """SELECT stream_id, n, 0 AS ch, round(x + sqrt(0.5::DOUBLE) * 3 * x + sqrt(0.5::DOUBLE) * 5 * x + sqrt(0.5::DOUBLE) * 4 * x, 6) AS x FROM samples
UNION ALL SELECT stream_id, n, 1, round(2 * x + sqrt(0.5::DOUBLE) * 3 * x + sqrt(0.5::DOUBLE) * 6 * x + sqrt(0.5::DOUBLE) * 4 * x, 6) FROM samples"""))
def channel_matrix(spark, d):
    return rounded(au.channel_matrix(surround(spark, d), "5.1", "stereo", "frontRearLfe"), "x")


def placed(spark, d):
    c = fx.clips(spark, d).filter("kind = 'audio'")
    f = lambda x: (F.col(x) / F.col("ft")).cast("long")
    return c.select("sequence_id", "track_id", "clip_id", (F.col("item_id") % 10).alias("stream_id"), (f("start") * 4).alias("start"), (f("duration") * 4).alias("duration"), (f("source_in") * 4).alias("source_in"), "speed", "reverse", "enabled", (-(F.col("rn") % 5)).cast("double").alias("gain_db"))


def desk(spark, d):
    t = fx.clips(spark, d).filter("kind = 'audio'").select("sequence_id", "track_id").distinct()
    return t.withColumns({"muted": F.col("track_id") % 9 == 4, "solo": F.col("track_id") % 13 == 6, "volume_db": -(F.col("track_id") % 7).cast("double"), "pan": ((F.col("track_id") % 5) - 2) / 2.0})


MIX = """ck AS (SELECT sequence_id, track_id, clip_id, item_id % 10 AS stream_id, start // ft * 4 AS start, duration // ft * 4 AS duration, source_in // ft * 4 AS source_in, CAST(speed AS BIGINT) AS sp, reverse, -(rn % 5) - track_id % 7 AS db, ((track_id % 5) - 2) / 2.0::DOUBLE AS pan FROM clips WHERE kind = 'audio' AND enabled),
tk AS (SELECT DISTINCT sequence_id, track_id, track_id % 9 = 4 AS muted, track_id % 13 = 6 AS solo FROM clips WHERE kind = 'audio'), t2 AS (SELECT *, bool_or(solo) OVER (PARTITION BY sequence_id) AS any_solo FROM tk),
kx AS (SELECT ck.*, unnest(range(duration)) AS k FROM ck WHERE track_id IN (SELECT track_id FROM t2 WHERE NOT muted AND (NOT any_solo OR solo))), sx AS (SELECT kx.*, s.x FROM kx JOIN samples s ON s.stream_id = kx.stream_id AND s.n = CASE WHEN reverse THEN source_in + duration * sp - 1 - k * sp ELSE source_in + k * sp END)"""


@query("mix_timeline", using("clips samples", f""", {MIX} SELECT sequence_id, n, ch, round(sum(y), 6) AS x FROM (SELECT sequence_id, start + k AS n, 0 AS ch, x * pow(10.0::DOUBLE, db / 20.0::DOUBLE) * cos((pan + 1) * pi() / 4) AS y FROM sx
UNION ALL SELECT sequence_id, start + k, 1, x * pow(10.0::DOUBLE, db / 20.0::DOUBLE) * sin((pan + 1) * pi() / 4) FROM sx) GROUP BY 1, 2, 3"""))
def mix_timeline(spark, d):
    return rounded(au.mix_timeline(placed(spark, d), fx.samples(spark, d), desk(spark, d)), "x")


def smooth(x):
    """Three-sample mean with one sample of latency."""
    return np.convolve(x, np.ones(3) / 3)[: len(x)]


@query("register_audio_stage", using("samples", "SELECT stream_id, ch, n, round((coalesce(lag(x) OVER w, 0) + x + coalesce(lead(x) OVER w, 0)) / 3, 6) AS x FROM samples WINDOW w AS (PARTITION BY stream_id ORDER BY n)"))
def register_audio_stage(spark, d):
    return rounded(au.audio_stage(fx.samples(spark, d), smooth, latency=1, run_in=2, chunk=500), "x")
