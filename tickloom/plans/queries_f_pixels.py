"""Pixel table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import color as cl
from tickloom.operators import pixels as px
from tickloom.plans import fixtures as fx
from tickloom.plans.registry import query
from tickloom.plans.sqltables import using

Y = "(0.2126::DOUBLE * r + (1 - 0.2126::DOUBLE - 0.0722::DOUBLE) * g + 0.0722::DOUBLE * b)"
YC = f"""yc AS (SELECT *, {Y} AS yy FROM pixels), ch AS (SELECT *, (b - yy) / (2 * (1 - 0.0722::DOUBLE)) AS cb, (r - yy) / (2 * (1 - 0.2126::DOUBLE)) AS cr FROM yc)"""


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


# values stretched past 0..1, off the rounding edges
def wide(spark, d):
    return fx.pixels(spark, d).withColumns({c: F.col(c) * 1.2 - 0.1013 for c in "rgb"})


WIDE = using("pixels", "").replace("pixels AS (", "raw AS (", 1).rstrip() + """, pixels AS (SELECT frame_id, x, y, r * 1.2::DOUBLE - 0.1013::DOUBLE AS r, g * 1.2::DOUBLE - 0.1013::DOUBLE AS g, b * 1.2::DOUBLE - 0.1013::DOUBLE AS b, a FROM raw)"""


@query("rgb_histogram", WIDE + f""", v AS (SELECT frame_id, 'R' AS ch, r AS v FROM pixels UNION ALL SELECT frame_id, 'G', g FROM pixels UNION ALL SELECT frame_id, 'B', b FROM pixels UNION ALL SELECT frame_id, 'Y', {Y} FROM pixels),
w AS (SELECT frame_id, ch, CASE WHEN v < 0 THEN -1 WHEN v > 1 + 1e-6::DOUBLE THEN 256 ELSE least(round(v * 255), 255) END AS bin FROM v)
SELECT frame_id, ch, CAST(bin AS INT) AS bin, count(*) AS n FROM (SELECT * FROM w UNION ALL SELECT frame_id, ch, CASE WHEN bin < 0 THEN 0 ELSE 255 END FROM w WHERE bin NOT BETWEEN 0 AND 255) GROUP BY 1, 2, 3""")
def rgb_histogram(spark, d):
    return px.rgb_histogram(wide(spark, d), clamp=True)


def cells(sel, rows=64):
    return f"""v AS ({sel}) SELECT frame_id, trace, CAST(x AS INT) AS col, CAST(least(round(v * {rows - 1}), {rows - 1}) AS INT) AS "row", count(*) AS n FROM v WHERE v BETWEEN 0 AND 1 GROUP BY 1, 2, 3, 4"""


@query("waveform_scope", WIDE + f", {YC}, " + cells("""SELECT frame_id, 'Y' AS trace, x, yy AS v FROM ch UNION ALL SELECT frame_id, 'C', x, yy + sqrt(cb * cb + cr * cr) FROM ch UNION ALL SELECT frame_id, 'C', x, yy - sqrt(cb * cb + cr * cr) FROM ch WHERE sqrt(cb * cb + cr * cr) > 1e-6"""))
def waveform_scope(spark, d):
    return px.waveform_scope(wide(spark, d), "yc", 64)


@query("parade_scope", WIDE + f", {YC}, " + cells("SELECT frame_id, 'Y' AS trace, x, yy AS v FROM ch UNION ALL SELECT frame_id, 'Cb', x, cb + 0.5 FROM ch UNION ALL SELECT frame_id, 'Cr', x, cr + 0.5 FROM ch"))
def parade_scope(spark, d):
    return px.parade_scope(wide(spark, d), "yuv", 64)


VEC = f""", {YC}, vp AS (SELECT frame_id, cb, cr, (cb / 0.6::DOUBLE * 0.5 + 0.5) * 63 AS fx, (0.5 - cr / 0.6::DOUBLE * 0.5) * 63 AS fy FROM ch), vc AS (SELECT frame_id, CAST(round(fx) AS INT) AS cx, CAST(round(fy) AS INT) AS cy, count(*) AS n FROM vp WHERE fx BETWEEN 0 AND 63 AND fy BETWEEN 0 AND 63 GROUP BY 1, 2, 3)"""


@query("vectorscope_yuv", WIDE + VEC + " SELECT * FROM vc")
def vectorscope_yuv(spark, d):
    return px.vectorscope_yuv(wide(spark, d), 64)[0]


@query("vectorscope_yuv_mean", WIDE + VEC + " SELECT frame_id, count(*) AS samples, round(avg(cb), 6) AS cb, round(avg(cr), 6) AS cr FROM vp WHERE fx BETWEEN 0 AND 63 AND fy BETWEEN 0 AND 63 GROUP BY 1")
def vectorscope_yuv_mean(spark, d):
    return rounded(px.vectorscope_yuv(wide(spark, d), 64)[1], "cb", "cr")


HLS = f""", k AS (SELECT frame_id, least(greatest(r, 0), 1) AS r, least(greatest(g, 0), 1) AS g, least(greatest(b, 0), 1) AS b FROM pixels), m AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM k), s AS (SELECT *, hi - lo AS dd, (hi + lo) / 2 AS l FROM m),
h AS (SELECT frame_id, CASE WHEN dd < 1e-7 THEN 0 ELSE (CASE WHEN hi = r THEN (g - b) / dd + CASE WHEN g < b THEN 6 ELSE 0 END WHEN hi = g THEN (b - r) / dd + 2 ELSE (r - g) / dd + 4 END) / 6 END AS hue, CASE WHEN dd < 1e-7 THEN 0 WHEN l > 0.5 THEN dd / (2 - hi - lo) ELSE dd / (hi + lo) END AS sat FROM s),
q AS (SELECT frame_id, radians({px.red_angle('709')!r}::DOUBLE + round(hue * 3600) / 10) AS a, least(greatest(sat, 0), 1) * 0.5 AS rad FROM h), z AS (SELECT frame_id, (rad * cos(a) / 0.6::DOUBLE * 0.5 + 0.5) * 63 AS fx, (0.5 - rad * sin(a) / 0.6::DOUBLE * 0.5) * 63 AS fy FROM q)
SELECT frame_id, CAST(round(fx) AS INT) AS cx, CAST(round(fy) AS INT) AS cy, count(*) AS n FROM z WHERE fx BETWEEN 0 AND 63 AND fy BETWEEN 0 AND 63 GROUP BY 1, 2, 3"""


@query("vectorscope_hls", WIDE + HLS)
def vectorscope_hls(spark, d):
    return px.vectorscope_hls(wide(spark, d), 64)[0]


def lv(n, c):
    return ", ".join(f"round({f}({c}) * 100, 2) AS {n}_{m}" for m, f in (("min", "min"), ("max", "max"), ("mean", "avg")))


@query("channel_stats", WIDE + f""", {YC} SELECT frame_id, {lv('r', 'r')}, {lv('g', 'g')}, {lv('b', 'b')}, {lv('y', 'yy')}, round(avg(cb) * 100, 2) AS cb, round(avg(cr) * 100, 2) AS cr,
 round(CASE WHEN atan2(avg(cr), avg(cb)) < 0 THEN degrees(atan2(avg(cr), avg(cb))) + 360 ELSE degrees(atan2(avg(cr), avg(cb))) END, 2) AS hue, round(sqrt(avg(cb) * avg(cb) + avg(cr) * avg(cr)) / 0.5 * 100, 2) AS saturation FROM ch GROUP BY 1""")
def channel_stats(spark, d):
    return px.channel_stats(wide(spark, d))


@query("scope_trace_columns", WIDE + f", {YC}, ce AS (" + "WITH " + cells("SELECT frame_id, 'Y' AS trace, x, yy AS v FROM ch") + """) SELECT frame_id, trace, ((col + 1) * 5 - 1)::BIGINT // 16 AS bucket, round(min("row" / 63.0::DOUBLE * 100), 2) AS min, round(max("row" / 63.0::DOUBLE * 100), 2) AS max, round(sum("row" / 63.0::DOUBLE * 100 * n) / sum(n), 2) AS mean FROM ce GROUP BY 1, 2, 3""")
def scope_trace_columns(spark, d):
    return px.scope_trace_columns(px.waveform_scope(wide(spark, d), "luma", 64), 16, 64, 5)


@query("scope_coarse", WIDE + VEC + " SELECT frame_id, cx::BIGINT * 10 // 64 AS cx, cy::BIGINT * 10 // 64 AS cy, CAST(sum(n) AS BIGINT) AS n FROM vc GROUP BY 1, 2, 3")
def scope_coarse(spark, d):
    return px.scope_coarse(px.vectorscope_yuv(wide(spark, d), 64)[0], 64, 10)


@query("vectorscope_peaks", WIDE + VEC + """, r AS (SELECT *, n / sum(n) OVER (PARTITION BY frame_id) AS share FROM vc), k AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY n DESC, cy * 64 + cx) AS rank FROM r WHERE share >= 0.02::DOUBLE)
SELECT frame_id, CAST(rank AS INT) AS rank, cx, cy, round((cx / 63.0::DOUBLE - 0.5) * 1.2::DOUBLE * 100, 2) AS cb, round((0.5 - cy / 63.0::DOUBLE) * 1.2::DOUBLE * 100, 2) AS cr, round(sqrt(pow((cx / 63.0::DOUBLE - 0.5) * 1.2::DOUBLE, 2) + pow((0.5 - cy / 63.0::DOUBLE) * 1.2::DOUBLE, 2)) / 0.5 * 100, 2) AS magnitude, round(share, 4) AS share FROM k WHERE rank <= 4""")
def vectorscope_peaks(spark, d):
    return px.vectorscope_peaks(px.vectorscope_yuv(wide(spark, d), 64)[0], 64, 4, 0.02)


@query("image_diff", using("pixels", """, p AS (SELECT frame_id, round(r * 255) AS r, round(g * 255) AS g, round(b * 255) AS b, (frame_id + x + y) % 17 AS k FROM pixels),
d AS (SELECT frame_id, CASE WHEN k = 3 THEN abs(round(least(greatest(r / 255 + 0.02::DOUBLE, 0), 1) * 255) - r) ELSE 0 END AS a1, CASE WHEN k = 5 THEN abs(round(g / 255 * 0.5::DOUBLE * 255) - g) ELSE 0 END AS a2 FROM p),
m AS (SELECT frame_id, greatest(a1, a2) AS m, a1 + a2 AS s, a1 * a1 + a2 * a2 AS q FROM d), o AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY m) AS i, count(*) OVER (PARTITION BY frame_id) AS n FROM m)
SELECT frame_id, CAST(max(m) AS INT) AS max_abs, round(sum(s) / (max(n) * 4), 6) AS mean_abs, round(CASE WHEN sum(q) = 0 THEN 'inf'::DOUBLE ELSE 10 * log10(65025.0::DOUBLE / (sum(q) / (max(n) * 4))) END, 4) AS psnr, CAST(min(m) FILTER (i * 100 >= n * 99) AS INT) AS p99, count(*) FILTER (m > 0) AS differing,
 max(m) <= 12 AND min(m) FILTER (i * 100 >= n * 99) <= 2 AND (sum(q) = 0 OR 10 * log10(65025.0::DOUBLE / (sum(q) / (max(n) * 4))) >= 45) AS ok FROM o GROUP BY 1"""))
def image_diff(spark, d):
    a = fx.pixels(spark, d)
    k = (F.col("frame_id") + F.col("x") + F.col("y")) % 17
    b = a.withColumns({"r": F.when(k == 3, F.col("r") + 0.02).otherwise(F.col("r")), "g": F.when(k == 5, F.col("g") * 0.5).otherwise(F.col("g"))})
    return rounded(rounded(px.image_diff(a, b), "mean_abs"), "psnr", digits=4)


def smooth(e0, e1):
    t = f"least(greatest((l - {e0}) / ({e1} - {e0}), 0), 1)"
    return f"({t} * {t} * (3 - 2 * {t}))"


def band(b):
    return f"round(sum(w{b}) / count(*), 5) AS {b}_w, round(sum(w{b} * l) / greatest(sum(w{b}), 1e-9), 5) AS {b}_l, round(sum(w{b} * cw * la) / greatest(sum(w{b} * cw), 1e-9), 5) AS {b}_a, round(sum(w{b} * cw * lb) / greatest(sum(w{b} * cw), 1e-9), 5) AS {b}_b"


TONE = using("pixels", f""", c AS (SELECT frame_id, cbrt(0.41222147::DOUBLE * r + 0.53633255::DOUBLE * g + 0.051445995::DOUBLE * b) AS l1, cbrt(0.2119035::DOUBLE * r + 0.6806995::DOUBLE * g + 0.10739696::DOUBLE * b) AS m1, cbrt(0.08830246::DOUBLE * r + 0.28171885::DOUBLE * g + 0.6299787::DOUBLE * b) AS s1 FROM pixels),
o AS (SELECT frame_id, 0.21045426::DOUBLE * l1 + 0.7936178::DOUBLE * m1 - 0.004072047::DOUBLE * s1 AS l, 1.9779985::DOUBLE * l1 - 2.4285922::DOUBLE * m1 + 0.4505937::DOUBLE * s1 AS la, 0.025904037::DOUBLE * l1 + 0.78277177::DOUBLE * m1 - 0.80867577::DOUBLE * s1 AS lb FROM c),
k AS (SELECT *, sqrt(la * la + lb * lb) AS c, degrees(atan2(lb, la)) AS hue, {smooth(0.55, 0.15)} AS ws, {smooth(0.45, 0.85)} AS wh FROM o),
t AS (SELECT *, greatest(1 - ws - wh, 0) AS wm, CASE WHEN c BETWEEN 0.02 AND 0.2 AND l BETWEEN 0.25 AND 0.92 THEN least(greatest(1 - CASE WHEN hue < 20 THEN 20 - hue WHEN hue > 75 THEN hue - 75 ELSE 0 END / 10, 0), 1) ELSE 0 END AS sk FROM k), u AS (SELECT *, 1 - 0.8 * sk AS cw FROM t),
st AS (SELECT frame_id, {band('s')}, {band('m')}, {band('h')}, round(sum(cw * c) / greatest(sum(cw), 1e-9), 5) AS chroma, round(sum(sk * la) / greatest(sum(sk), 1e-9), 5) AS skin_a, round(sum(sk * lb) / greatest(sum(sk), 1e-9), 5) AS skin_b, round(sum(sk) / count(*), 5) AS skin_w FROM u GROUP BY 1)""")


def tones(spark, d):
    t = px.tonal_stats(fx.pixels(spark, d))
    return rounded(t, *[c for c in t.columns if c != "frame_id"], digits=5)


@query("tonal_stats", TONE + " SELECT * FROM st")
def tonal_stats(spark, d):
    return tones(spark, d)


def res(b):
    w = f"least(greatest(least(a.{b}_w, r.{b}_w) * 3, 0), 1)"
    return f"pow(a.{b}_l - r.{b}_l, 2) * {w} + pow((a.{b}_a - r.{b}_a) * 2, 2) * {w} + pow((a.{b}_b - r.{b}_b) * 2, 2) * {w}"


@query("tonal_distance", TONE + f" SELECT a.frame_id, r.frame_id AS ref_id, round(sqrt({res('s')} + {res('m')} + {res('h')} + pow((a.chroma - r.chroma) * 2, 2)), 5) AS distance FROM st a JOIN st r ON r.frame_id = a.frame_id // 2")
def tonal_distance(spark, d):
    t = tones(spark, d)
    pairs = t.select("frame_id", F.floor(F.col("frame_id") / 2).cast("long").alias("ref_id"))
    ref = t.withColumnRenamed("frame_id", "ref_id").join(pairs, "ref_id")
    return rounded(px.tonal_distance(t, ref), "distance", digits=5)


@query("frame_signatures", using("pixels", """, v AS (SELECT frame_id, x, y, CAST(round(r * 255) AS BIGINT) AS r, CAST(round(g * 255) AS BIGINT) AS g, CAST(round(b * 255) AS BIGINT) AS b FROM pixels),
g AS (SELECT frame_id, round(avg(0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b) / 255, 6) AS v, (y * 18 // 9) * 32 + x * 32 // 16 AS i FROM v GROUP BY frame_id, i),
h AS (SELECT frame_id, i, count(*) / 144.0::DOUBLE AS v FROM (SELECT frame_id, r * 16 // 256 AS i FROM v UNION ALL SELECT frame_id, 16 + g * 16 // 256 FROM v UNION ALL SELECT frame_id, 32 + b * 16 // 256 FROM v) GROUP BY 1, 2)
SELECT frame_id, 'grid' AS part, CAST(i AS INT) AS i, v FROM g WHERE v > 0 UNION ALL SELECT frame_id, 'hist', CAST(i AS INT), round(v, 6) FROM h"""))
def frame_signatures(spark, d):
    s = px.frame_signatures(fx.pixels(spark, d), 16, 9)
    rows = lambda c: s.select("frame_id", F.lit(c).alias("part"), F.posexplode(c).alias("i", "v"))
    return rounded(rows("grid").unionByName(rows("hist")), "v").filter("v > 0")


def shot_pixels(spark, d):
    """The part frames re-coloured so that a new look starts every 23 frames."""
    p = fx.pixels(spark, d)
    s, k = F.floor(F.col("frame_id") / 23).cast("long"), F.col("frame_id") % 23
    v = lambda c: ((s * 97 + F.col("x") * (7 + s % 5) + F.col("y") * 13 + c * 17 * (s % 3) + k) % (90 + s % 7 * 25)) / 255.0
    return p.select("frame_id", "x", "y", v(0).alias("r"), v(1).alias("g"), v(2).alias("b"), "a")


def shot_signatures(spark, d):
    s = px.frame_signatures(shot_pixels(spark, d), 16, 9)
    return s.withColumns({"clip_id": F.floor(F.col("frame_id") / 300).cast("long"), "frame": F.col("frame_id") % 300})


SHOT = """, sh AS (SELECT frame_id, x, y, frame_id // 23 AS s, frame_id % 23 AS k FROM pixels), v AS (SELECT frame_id, x, y, round(((s * 97 + x * (7 + s % 5) + y * 13 + k) % (90 + s % 7 * 25)) / 255.0::DOUBLE * 255)::BIGINT AS r,
 round(((s * 97 + x * (7 + s % 5) + y * 13 + 17 * (s % 3) + k) % (90 + s % 7 * 25)) / 255.0::DOUBLE * 255)::BIGINT AS g, round(((s * 97 + x * (7 + s % 5) + y * 13 + 34 * (s % 3) + k) % (90 + s % 7 * 25)) / 255.0::DOUBLE * 255)::BIGINT AS b FROM sh),
gr AS (SELECT frame_id, x, y, (0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b) / 255 AS v FROM v), hi AS (SELECT frame_id, i, count(*) / 144.0::DOUBLE AS v FROM (SELECT frame_id, r * 16 // 256 AS i FROM v UNION ALL SELECT frame_id, 16 + g * 16 // 256 FROM v UNION ALL SELECT frame_id, 32 + b * 16 // 256 FROM v) GROUP BY 1, 2),
dg AS (SELECT a.frame_id, sum(abs(a.v - b.v)) / 576 AS g FROM gr a JOIN gr b ON b.frame_id = a.frame_id - 1 AND a.x = b.x AND a.y = b.y GROUP BY 1),
ha AS (SELECT frame_id, i, v FROM hi UNION ALL SELECT frame_id + 1, i, -v FROM hi), dh AS (SELECT frame_id, sum(a) / 6 AS h FROM (SELECT frame_id, i, abs(sum(v)) AS a FROM ha GROUP BY 1, 2) GROUP BY 1),
df AS (SELECT frame_id // 300 AS clip_id, frame_id % 300 AS frame, CASE WHEN frame_id % 300 > 0 THEN least(0.5 * h + 0.5 * least(2 * g, 1), 1) END AS d FROM (SELECT DISTINCT frame_id FROM pixels) LEFT JOIN dg USING (frame_id) LEFT JOIN dh USING (frame_id)),
ar AS (SELECT clip_id, frame, d, lag(d) OVER w AS p, lead(d) OVER w AS n, list_sort(list_concat(list(d) FILTER (d IS NOT NULL) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), list(d) FILTER (d IS NOT NULL) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))) AS nb FROM df WINDOW w AS (PARTITION BY clip_id ORDER BY frame)),
cd AS (SELECT clip_id, frame FROM ar WHERE d >= 0.45 - 0.33 * 0.6 AND d >= 2.5 * coalesce(nb[len(nb) // 2 + 1], 0) + 0.05 AND coalesce(n, -1) <= d AND coalesce(p, -1) <= d AND frame >= 6),
cu AS (SELECT clip_id, min(frame) AS frame FROM cd GROUP BY 1 UNION ALL SELECT cu.clip_id, (SELECT min(cd.frame) FROM cd WHERE cd.clip_id = cu.clip_id AND cd.frame >= cu.frame + 6) FROM cu WHERE cu.frame IS NOT NULL)"""


def rec(sql):
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("frame_differences", using("pixels", SHOT.split("\nar AS")[0].rstrip(",") + " SELECT clip_id, frame, round(d, 6) AS d FROM df"))
def frame_differences(spark, d):
    return rounded(px.frame_differences(shot_signatures(spark, d)), "d")


@query("scene_cuts", rec(using("pixels", SHOT + " SELECT clip_id, frame FROM cu WHERE frame IS NOT NULL")))
def scene_cuts(spark, d):
    return px.scene_cuts(shot_signatures(spark, d), 60.0, 6)


@query("shots", rec(using("pixels", SHOT + """, mk AS (SELECT clip_id, frame FROM cu WHERE frame IS NOT NULL UNION ALL SELECT DISTINCT clip_id, 0 FROM df), nn AS (SELECT clip_id, max(frame) + 1 AS frames FROM df GROUP BY 1), q AS (SELECT mk.*, coalesce(lead(frame) OVER (PARTITION BY clip_id ORDER BY frame), frames) AS e FROM mk JOIN nn USING (clip_id))
SELECT clip_id, frame AS first, e - frame AS frames, 1000 + frame * 10160640000 AS start, 1000 + e * 10160640000 AS "end" FROM q WHERE e > frame""")))
def shots(spark, d):
    s = shot_signatures(spark, d)
    clips = s.groupBy("clip_id").agg((F.max("frame") + 1).alias("frames")).withColumns({"media_start": F.lit(1000).cast("long"), "ft": F.lit(10_160_640_000)})
    return px.shots(px.scene_cuts(s, 60.0, 6), clips)[0]


def codes(spark, d):
    p = fx.pixels(spark, d)
    return p.select((F.col("frame_id") % 20).alias("item_id"), "frame_id", "x", "y", F.round(F.col("r") * 876 + 64).cast("int").alias("py"), F.round(F.col("g") * 600 + 212).cast("int").alias("pcb"), F.round(F.col("b") * 600 + 212).cast("int").alias("pcr"))


SPACES = [("709", "srgb", "bt709", 203.0), ("2020", "pq", "bt2020", 1000.0), ("2020", "hlg", "bt2020", 1000.0), ("709", "slog3", "sgamut3cine", 1500.0), ("601", "srgb", "bt709", 203.0)]


def interpret(spark, d):
    i = fx.table(spark, d, "part").select((F.col("p_partkey") % 20).alias("item_id")).distinct()
    at = lambda n: F.element_at(F.array(*[F.lit(s[n]) for s in SPACES]), (F.col("item_id") % 5 + 1).cast("int"))
    return i.select("item_id", F.lit(10).alias("bits"), (F.col("item_id") % 2 == 0).alias("full_range"), at(0).alias("matrix"), at(1).alias("curve"), at(2).alias("gamut"), at(3).alias("peak_nits"))


def enc(v):
    return f"(CASE WHEN {v} <= 0.0031308 THEN {v} * 12.92 ELSE 1.055 * pow({v}, 1 / 2.4::DOUBLE) - 0.055 END)"


def dec(v):
    return f"(CASE WHEN {v} <= 0.04045 THEN {v} / 12.92 ELSE pow(({v} + 0.055) / 1.055, 2.4::DOUBLE) END)"


def num(x):
    return f"({float(x)!r}::DOUBLE)"


def pq_dec(e):
    m1, m2, c1, c2, c3 = map(num, cl.PQ)
    p = f"pow(greatest({e}, 0), 1 / {m2})"
    return f"pow(greatest({p} - {c1}, 0) / ({c2} - {c3} * {p}), 1 / {m1})"


def pq_enc(v):
    m1, m2, c1, c2, c3 = map(num, cl.PQ)
    p = f"pow(greatest({v}, 0), {m1})"
    return f"pow(({c1} + {c2} * {p}) / (1 + {c3} * {p}), {m2})"


def unit(v):
    return f"least(greatest({v}, 0), 1)"


def curve(v):
    hlg = f"CASE WHEN {unit(v)} <= 0.5 THEN {unit(v)} * {unit(v)} / 3 ELSE (exp(({unit(v)} - 0.55991073::DOUBLE) / 0.17883277::DOUBLE) + 0.28466892::DOUBLE) / 12 END"
    code = f"(CASE WHEN fullr THEN {v} ELSE (64 + 876 * {v}) / 1023 END)"
    slog = f"CASE WHEN {code} >= 171.2102946929::DOUBLE / 1023 THEN pow(10.0::DOUBLE, ({code} * 1023 - 420) / 261.5::DOUBLE) * 0.19::DOUBLE - 0.01::DOUBLE ELSE ({code} * 1023 - 95) * 0.01125::DOUBLE / (171.2102946929::DOUBLE - 95) END"
    return f"CASE WHEN sp IN (0, 4) THEN {dec(unit(v))} WHEN sp = 1 THEN {pq_dec(unit(v))} * {num(10_000 / cl.WHITE_NITS)} WHEN sp = 2 THEN {hlg} ELSE {slog} END"


def mix(row):
    per = lambda g: " + ".join(f"{num(cl.gamut_matrix(g, 'bt709')[row][j])} * l{c} * oo" for j, c in enumerate("rgb"))
    return f"CASE WHEN sp IN (1, 2) THEN {per('bt2020')} WHEN sp = 3 THEN {per('sgamut3cine')} ELSE l{'rgb'[row]} * oo END"


LUM = " + ".join(f"{num(w)} * l{c}" for w, c in zip(cl.to_xyz("bt2020")[1], "rgb"))
NORMAL = f""", cd AS (SELECT frame_id % 20 AS item_id, frame_id, x, y, round(r * 876 + 64) AS py, round(g * 600 + 212) AS pcb, round(b * 600 + 212) AS pcr FROM pixels),
sp AS (SELECT *, item_id % 5 AS sp, item_id % 2 = 0 AS fullr, CASE item_id % 5 WHEN 1 THEN 1000.0::DOUBLE WHEN 2 THEN 1000.0::DOUBLE WHEN 3 THEN 1500.0::DOUBLE ELSE 203.0::DOUBLE END AS peak, CASE item_id % 5 WHEN 4 THEN 0.299::DOUBLE WHEN 1 THEN 0.2627::DOUBLE WHEN 2 THEN 0.2627::DOUBLE ELSE 0.2126::DOUBLE END AS kr, CASE item_id % 5 WHEN 4 THEN 0.114::DOUBLE WHEN 1 THEN 0.0593::DOUBLE WHEN 2 THEN 0.0593::DOUBLE ELSE 0.0722::DOUBLE END AS kb FROM cd),
yc AS (SELECT *, CASE WHEN fullr THEN py / 1023 ELSE (py - 64) / 876 END AS yy, CASE WHEN fullr THEN (pcb - 512) / 1023 ELSE (pcb - 512) / 896 END AS cb, CASE WHEN fullr THEN (pcr - 512) / 1023 ELSE (pcr - 512) / 896 END AS cr FROM sp),
rb AS (SELECT *, yy + 2 * (1 - kr) * cr AS vr, yy + 2 * (1 - kb) * cb AS vb FROM yc), vv AS (SELECT *, (yy - kr * vr - kb * vb) / (1 - kr - kb) AS vg FROM rb),
ln AS (SELECT *, {curve('vr')} AS lr, {curve('vg')} AS lg, {curve('vb')} AS lb FROM vv), ot AS (SELECT *, CASE WHEN sp = 2 THEN pow(greatest({LUM}, 0), 0.2::DOUBLE) * {num(1000 / cl.WHITE_NITS)} ELSE 1.0::DOUBLE END AS oo FROM ln),
mx AS (SELECT *, {mix(0)} AS mr, {mix(1)} AS mg, {mix(2)} AS mb FROM ot), nt AS (SELECT *, greatest(mr, mg, mb) * 203 AS nits FROM mx),
tp AS (SELECT *, {pq_enc(unit('peak / 10000'))} AS top FROM nt), ee AS (SELECT *, least({pq_enc(unit('nits / 10000'))} / top, 1) AS e1, {pq_enc('0.0203::DOUBLE')} / top AS ml FROM tp), kn AS (SELECT *, 1.5 * ml - 0.5 AS ks, (e1 - (1.5 * ml - 0.5)) / (1 - (1.5 * ml - 0.5)) AS t FROM ee),
tm AS (SELECT *, CASE WHEN nits > 1e-6 AND peak > 203 THEN {pq_dec('(CASE WHEN e1 < ks THEN e1 ELSE (2 * t * t * t - 3 * t * t + 1) * ks + (t * t * t - 2 * t * t + t) * (1 - ks) + (-2 * t * t * t + 3 * t * t) * ml END * top)')} * 10000 / nits ELSE 1 END AS k FROM kn)
SELECT item_id, frame_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, round({enc(unit('mr * k'))}, 5) AS r, round({enc(unit('mg * k'))}, 5) AS g, round({enc(unit('mb * k'))}, 5) AS b FROM tm"""


@query("normalise_footage", using("pixels", NORMAL))
def normalise_footage(spark, d):
    return rounded(px.normalise_footage(codes(spark, d), interpret(spark, d)), "r", "g", "b", digits=5)


def lattice(spark, d):
    n = fx.table(spark, d, "part").select((F.col("p_partkey") % 729).alias("i")).distinct()
    g = n.select((F.col("i") % 9).cast("int").alias("ri"), (F.floor(F.col("i") / 9) % 9).cast("int").alias("gi"), F.floor(F.col("i") / 81).cast("int").alias("bi"))
    return g.withColumns({"lr": (F.col("ri") * F.col("ri") + F.col("gi")) / 72.0, "lg": (F.col("gi") * 8 - F.col("bi")) / 64.0, "lb": F.col("bi") * F.col("ri") / 64.0})


@query("apply_lut3d", using("pixels", """, la AS (SELECT p_partkey % 729 % 9 AS ri, (p_partkey % 729) // 9 % 9 AS gi, (p_partkey % 729) // 81 AS bi FROM part GROUP BY p_partkey % 729), lt AS (SELECT ri, gi, bi, (ri * ri + gi) / 72.0::DOUBLE AS lr, (gi * 8 - bi) / 64.0::DOUBLE AS lg, bi * ri / 64.0::DOUBLE AS lb FROM la),
q AS (SELECT frame_id, x, y, a, least(floor(r * 8), 7)::BIGINT AS r0, least(floor(g * 8), 7)::BIGINT AS g0, least(floor(b * 8), 7)::BIGINT AS b0, r * 8 AS rr, g * 8 AS gg, b * 8 AS bb FROM pixels), f AS (SELECT *, rr - r0 AS fr, gg - g0 AS fg, bb - b0 AS fb FROM q),
c AS (SELECT frame_id, x, y, a, r0 AS ri, g0 AS gi, b0 AS bi, 1 - greatest(fr, fg, fb) AS w FROM f UNION ALL SELECT frame_id, x, y, a, r0 + 1, g0 + 1, b0 + 1, least(fr, fg, fb) FROM f
 UNION ALL SELECT frame_id, x, y, a, r0 + CASE WHEN fr >= fg AND fr >= fb THEN 1 ELSE 0 END, g0 + CASE WHEN fg > fr AND fg >= fb THEN 1 ELSE 0 END, b0 + CASE WHEN fb > fr AND fb > fg THEN 1 ELSE 0 END, greatest(fr, fg, fb) - (fr + fg + fb - greatest(fr, fg, fb) - least(fr, fg, fb)) FROM f
 UNION ALL SELECT frame_id, x, y, a, r0 + CASE WHEN fr < fg AND fr < fb THEN 0 WHEN (fr < fg AND fr = fb) OR (fr = fg AND fr < fb) THEN 1 WHEN fr <= fg AND fr <= fb AND NOT (fr = fg AND fr = fb) THEN 0 ELSE 1 END,
   g0 + CASE WHEN fg < fr AND fg < fb THEN 0 WHEN fg < fr AND fg = fb THEN 1 WHEN fg = fr AND fg < fb THEN 0 ELSE CASE WHEN fg <= fr AND fg < fb THEN 0 ELSE 1 END END, b0 + CASE WHEN fb > fr OR fb > fg THEN 1 ELSE 0 END, (fr + fg + fb - greatest(fr, fg, fb) - least(fr, fg, fb)) - least(fr, fg, fb) FROM f)
SELECT frame_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, round(sum(w * lr), 6) AS r, round(sum(w * lg), 6) AS g, round(sum(w * lb), 6) AS b, a FROM c JOIN lt USING (ri, gi, bi) WHERE w <> 0 GROUP BY frame_id, x, y, a"""))
def apply_lut3d(spark, d):
    return rounded(px.apply_lut3d(fx.pixels(spark, d), lattice(spark, d), 9), "r", "g", "b")


def stack(spark, d):
    p = fx.pixels(spark, d)
    z = p.select("frame_id", "x", "y", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("z"), "r", "g", "b")
    al = F.when(F.col("z") == 0, 1.0).otherwise(((F.col("frame_id") + F.col("x") * F.col("z")) % 8) / 8.0)
    mode = F.when((F.col("z") == 2) & (F.col("frame_id") % 3 == 0), "multiply").when((F.col("z") == 1) & (F.col("frame_id") % 3 == 1), "screen").otherwise("normal")
    lin = {c: F.col(c) * F.col(c) * F.lit(0.5 + 0.1) * al / (F.col("z") + 1) for c in "rgb"}
    return z.select("frame_id", "x", "y", "z", *[v.alias(c) for c, v in lin.items()], al.alias("a"), F.when(F.col("z") == 2, 0.75).otherwise(1.0).alias("opacity"), mode.alias("mode"))


def layer(k, prevt, out):
    s = [f"s{c}{k}" for c in "rgba"]
    d = list("rgba")
    e = lambda v, a: enc(f"least(greatest(CASE WHEN {a} > 0 THEN {v} / {a} ELSE 0 END, 0), 1)")
    cols = []
    for i, c in enumerate("rgb"):
        b, t = e(d[i], "a"), e(s[i], s[3])
        mix = lambda x: f"(1 - a) * {s[i]} + a * {s[3]} * {dec(x)} + (1 - {s[3]}) * {d[i]}"
        cols.append(f"CASE WHEN {s[3]} <= 0 THEN {c} WHEN m{k} = 'multiply' THEN {mix(f'({b} * {t})')} WHEN m{k} = 'screen' THEN {mix(f'({b} + {t} - {b} * {t})')} ELSE {s[i]} + {d[i]} * (1 - {s[3]}) END AS {c}")
    return f"{out} AS (SELECT * REPLACE ({', '.join(cols)}, {s[3]} + a * (1 - {s[3]}) AS a) FROM {prevt})"


PICK = ", ".join(f"{c} * {c} * 0.6::DOUBLE * a{k} / {k + 1} * {op} AS s{c}{k}" for k, op in ((1, 1), (2, 0.75)) for c in "rgb")


@query("composite_layers", using("pixels", f""", z AS (SELECT *, ((frame_id + x) % 8) / 8.0::DOUBLE AS a1, ((frame_id + x * 2) % 8) / 8.0::DOUBLE AS a2 FROM pixels),
l0 AS (SELECT frame_id, x, y, r * r * 0.6::DOUBLE AS r, g * g * 0.6::DOUBLE AS g, b * b * 0.6::DOUBLE AS b, 1.0::DOUBLE AS a, {PICK}, a1 AS sa1, a2 * 0.75 AS sa2, CASE WHEN frame_id % 3 = 1 THEN 'screen' ELSE 'normal' END AS m1, CASE WHEN frame_id % 3 = 0 THEN 'multiply' ELSE 'normal' END AS m2 FROM z),
{layer(1, 'l0', 'l1')}, {layer(2, 'l1', 'l2')} SELECT frame_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b, round(a, 6) AS a FROM l2"""))
def composite_layers(spark, d):
    return rounded(px.composite_layers(stack(spark, d)), "r", "g", "b", "a")
