"""Signal structure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import signal as sg
from tickloom.plans import fixtures as fx
from tickloom.plans.queries_e_audio import REP, RATE, rounded
from tickloom.plans.registry import query
from tickloom.plans.sqltables import using

SHIFT = 37
COPY = 1_000_000_000


def doubled(spark, d):
    """Every stream and a copy that starts later, at half level and turned over."""
    s = fx.samples(spark, d)
    late = s.filter(F.col("n") >= SHIFT).select((F.col("stream_id") + COPY).alias("stream_id"), "ch", (F.col("n") - SHIFT).alias("n"), (F.col("x") * -0.5).alias("x"))
    return s.unionByName(late)


@query("audio_offsets", using("samples", f"SELECT DISTINCT stream_id AS pair_id, {SHIFT}::BIGINT AS lag, true AS inverted, true AS reliable FROM samples"))
def audio_offsets(spark, d):
    s = doubled(spark, d)
    pairs = fx.samples(spark, d).select(F.col("stream_id").alias("pair_id"), F.col("stream_id").alias("a"), (F.col("stream_id") + COPY).alias("b")).distinct()
    return sg.audio_offsets(pairs, s, RATE).select("pair_id", "lag", "inverted", "reliable")


@query("onset_envelope")
def onset_envelope(spark, d):
    return rounded(sg.onset_envelope(fx.samples(spark, d, REP), RATE), "v")


PULSE = """ev AS (SELECT stream_id, n // 16 AS k, sqrt(sum(x * x)) + CASE WHEN (n // 16) % 13 = 0 THEN 2 ELSE 0 END AS v FROM samples GROUP BY stream_id, n // 16)"""


def pulses(spark, d):
    s = fx.samples(spark, d).groupBy("stream_id", F.floor(F.col("n") / 16).cast("long").alias("k")).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("v"))
    return s.withColumn("v", F.col("v") + F.when(F.col("k") % 13 == 0, 2.0).otherwise(0.0))


@query("tempo", using("samples", f""", {PULSE}, st AS (SELECT stream_id, avg(v) AS m, count(*) AS len FROM ev GROUP BY 1), e AS (SELECT stream_id, k, v - m AS x, len FROM ev JOIN st USING (stream_id)), lg AS (SELECT unnest(range(5, 26)) AS lag UNION ALL SELECT 0),
ac AS (SELECT a.stream_id, lag, sum(a.x * b.x) / (max(a.len) - lag) AS r FROM e a JOIN lg ON true JOIN e b ON b.stream_id = a.stream_id AND b.k = a.k + lag GROUP BY 1, 2), w AS (SELECT *, r * exp(-0.5 * pow(log2(1200.0::DOUBLE / lag / 120), 2)) AS w FROM ac WHERE lag BETWEEN 6 AND 24),
b AS (SELECT stream_id, arg_max(lag, w) AS lag FROM w GROUP BY 1), j AS (SELECT b.stream_id, b.lag, x.r AS ra, y.r AS rb, z.r AS rc FROM b JOIN ac x ON x.stream_id = b.stream_id AND x.lag = b.lag - 1 JOIN ac y ON y.stream_id = b.stream_id AND y.lag = b.lag JOIN ac z ON z.stream_id = b.stream_id AND z.lag = b.lag + 1),
p AS (SELECT stream_id, lag + CASE WHEN ra - 2 * rb + rc < 0 THEN least(greatest(0.5 * (ra - rc) / (ra - 2 * rb + rc), -0.5), 0.5) ELSE 0 END AS period FROM j) SELECT stream_id, round(period, 6) AS period, round(1200 / period, 5) AS bpm FROM p"""))
def tempo(spark, d):
    return rounded(rounded(sg.tempo(pulses(spark, d), 20.0, 64), "period"), "bpm", digits=5)


@query("beats")
def beats(spark, d):
    env = pulses(spark, d)
    return sg.beats(env, sg.tempo(env, 20.0), 128)


def features(spark, d):
    v = fx.vectors(spark, d)
    return v.select("stream_id", F.col("rank").alias("i"), F.transform(F.slice("embedding", 1, 12), lambda x: F.abs(x).cast("double")).alias("chroma"), F.transform(F.slice("embedding", 13, 12), lambda x: x.cast("double")).alias("cepstra"))


FEAT = """fe AS (SELECT stream_id, rank AS i, [abs(x)::DOUBLE for x in embedding[1:12]] AS c, [x::DOUBLE for x in embedding[13:24]] AS q FROM vectors),
si AS (SELECT a.stream_id, a.i, b.i AS j, 0.6 * list_cosine_similarity(a.c, b.c) + 0.4 * (1 + list_cosine_similarity(a.q, b.q)) / 2 AS s FROM fe a JOIN fe b USING (stream_id))"""


@query("beat_similarity", using("vectors", f", {FEAT} SELECT stream_id, i, j, round(s, 6) AS s FROM si WHERE j = i + 2 OR j = i + 5"))
def beat_similarity(spark, d):
    f = features(spark, d)
    pairs = f.select("stream_id", "i", F.explode(F.array(F.col("i") + 2, F.col("i") + 5)).alias("j"))
    return rounded(sg.beat_similarity(f, pairs), "s")


@query("best_jumps", using("vectors", f""", {FEAT}, jc AS (SELECT a.stream_id, a.i, a.j, avg(b.s) AS score FROM si a JOIN (SELECT unnest([0, 1, 2, 3, -1, -2, -3, -4]) AS k) o ON true JOIN si b ON b.stream_id = a.stream_id AND b.i = a.i + k AND b.j = a.j + k WHERE abs(a.i - a.j) >= 4 GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY round(score, 9) DESC, i, j) AS rank FROM jc) SELECT stream_id, i, j, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10"""))
def best_jumps(spark, d):
    return rounded(sg.best_jumps(features(spark, d), 10, 32, 4), "score")


@query("beat_features")
def beat_features(spark, d):
    s = fx.samples(spark, d, REP)
    marks = s.filter("n % 4000 = 100").select("stream_id", F.col("n").alias("start"))
    f = sg.beat_features(s, marks, RATE)
    return f.select("stream_id", "i", "start", F.round(F.col("chroma")[0], 6).alias("chroma0"), F.round(F.col("cepstra")[0], 6).alias("cepstrum0"))


#: Mel energies by an explicit DFT of every windowed frame: ``me`` (stream_id, f, band, v).
MEL = """ln AS (SELECT stream_id, max(n) + 1 AS l FROM samples GROUP BY 1), xs AS (SELECT stream_id, n + r * l AS n, x, l * {times} AS len FROM samples JOIN ln USING (stream_id), range({times}) t(r)),
ix AS (SELECT stream_id, f, k, f * 160 - 200 + k AS i, len FROM (SELECT DISTINCT stream_id, len FROM xs), LATERAL (SELECT unnest(range(len // 160)) AS f), range(400) t(k)),
fm AS (SELECT ix.stream_id, f, k, x * (0.5 - 0.5 * cos(2 * pi() * k / 400)) AS x FROM ix JOIN xs ON xs.stream_id = ix.stream_id AND xs.n = CASE WHEN i < 0 THEN -i WHEN i >= ix.len THEN 2 * (ix.len - 1) - i ELSE i END),
cs AS (SELECT k, b, cos(2 * pi() * (k * b % 400) / 400) AS c, sin(2 * pi() * (k * b % 400) / 400) AS s FROM range(400) t(k), range(201) u(b)),
sp AS (SELECT stream_id, f, b, pow(sum(x * c), 2) + pow(sum(x * s), 2) AS p FROM fm JOIN cs USING (k) GROUP BY 1, 2, 3),
mp AS (SELECT j, CASE WHEN m >= 15 THEN 1000 * exp(ln(6.4::DOUBLE) / 27 * (m - 15)) ELSE m * 200 / 3 END AS e FROM (SELECT j, j * (15 + ln(8::DOUBLE) / (ln(6.4::DOUBLE) / 27)) / ({bands} + 1) AS m FROM range({bands} + 2) t(j))),
fl AS (SELECT lo.j AS band, b, greatest(least((b * 40 - lo.e) / (mi.e - lo.e), (hi.e - b * 40) / (hi.e - mi.e)), 0) * 2 / (hi.e - lo.e) AS w FROM mp lo JOIN mp mi ON mi.j = lo.j + 1 JOIN mp hi ON hi.j = lo.j + 2, range(201) t(b)),
me AS (SELECT stream_id, f, band, sum(p * w) AS v FROM sp JOIN fl USING (b) WHERE w > 0 GROUP BY 1, 2, 3)"""


@query("mel_features", using("samples", f""", {MEL.format(times=5, bands=40)}, lg AS (SELECT *, log10(greatest(v, 1e-10)) AS g FROM me), tp AS (SELECT stream_id, max(g) AS top FROM lg GROUP BY 1)
SELECT stream_id, f AS frame, CAST(band AS INT) AS band, round((greatest(g, top - 8) + 4) / 4, 6) AS mel FROM lg JOIN tp USING (stream_id)"""))
def mel_features(spark, d):
    m = sg.mel_features(fx.samples(spark, d, 5), 40)
    return m.select("stream_id", "frame", F.posexplode("mel").alias("band", "mel")).withColumn("mel", F.round("mel", 6))


@query("voice_vectors")
def voice_vectors(spark, d):
    s = fx.samples(spark, d, 5)
    c = s.groupBy("stream_id", F.floor(F.col("n") / 4000).cast("long").alias("c")).agg((F.min("n") * 10).alias("start"), (F.max("n") * 10).alias("end"))
    v = sg.voice_vectors(s, c, 1600)
    return v.select("stream_id", "c", "weight", F.round(F.col("vector")[0], 6).alias("v0"), F.round(F.col("vector")[37], 6).alias("v37"))
