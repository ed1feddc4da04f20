"""Chunked signal work against plain numpy; streams in several batches against one."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import color as cl
from tickloom.operators import audio as au
from tickloom.operators import pixels as px
from tickloom.operators import signal as sg
from tickloom.operators import transcripts as tr
from tickloom.streaming import live


def samples(spark, x, stream=0):
    return spark.createDataFrame([(stream, 0, i, float(v)) for i, v in enumerate(x)], "stream_id long, ch int, n long, x double")


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(0).normal(size=20_000)


def test_k_weighting_chunks_equal_the_whole(spark, noise):
    rate, y = 8000, noise
    for b0, b1, b2, a1, a2 in au.k_weighting(rate):
        out, s1, s2 = [], 0.0, 0.0
        for v in y:
            o = b0 * v + s1
            s1, s2 = b1 * v - a1 * o + s2, b2 * v - a2 * o
            out.append(o)
        y = out
    want = (np.array(y) ** 2).reshape(-1, 800).sum(axis=1)
    got = au.k_weighted_energy(samples(spark, noise), rate, chunk_blocks=3).orderBy("block").toPandas()["e"]
    assert np.allclose(got, want, rtol=1e-9)


def test_loudness_of_a_full_scale_tone(spark):
    t = np.arange(48_000 * 4) / 48_000
    e = au.k_weighted_energy(samples(spark, np.sin(2 * math.pi * 997 * t)), 48_000)
    i = au.integrated_loudness(au.loudness_series(e)).first()["integrated"]
    assert abs(i + 3.01) < 0.02


def test_true_peak_chunks_equal_the_whole(spark, noise):
    bank = au.true_peak_bank(48_000)
    want = max(max(np.abs(np.convolve(noise, c)[: len(noise)]).max() for c in bank), np.abs(noise).max())
    assert abs(au.peak_levels(samples(spark, noise), 48_000, 777).first()["tp"] - want) < 1e-12


def test_audio_stage_is_invisible_at_chunk_edges(spark, noise):
    f = lambda x: np.convolve(x, np.ones(5) / 5)[: len(x)]
    got = au.audio_stage(samples(spark, noise[:3000]), f, latency=2, run_in=4, chunk=512).orderBy("n").toPandas()["x"]
    assert np.allclose(got, np.convolve(noise[:3000], np.ones(5) / 5)[2:3002])


def test_mel_chunks_equal_the_whole(spark, noise):
    x = noise[:8000]
    wide = np.pad(x, 200, mode="reflect")
    win = 0.5 - 0.5 * np.cos(2 * math.pi * np.arange(400) / 400)
    want = [sg.mel_filters(20) @ np.abs(np.fft.rfft(wide[f * 160 : f * 160 + 400] * win)) ** 2 for f in range(50)]
    got = np.array(sg.mel_energies(samples(spark, x), 20, chunk_frames=7).orderBy("frame").toPandas()["mel"].tolist())
    assert np.allclose(got, want)


def brute_beats(env, period):
    lo, hi = max(int(period * 0.5 + 0.5), 1), int(period * 2 + 0.5)
    score, back = [0.0] * len(env), [None] * len(env)
    for t in range(len(env)):
        best, arg = 0.0, None
        for p in range(max(t - hi, 0), t - lo + 1):
            v = score[p] - 100 * math.log((t - p) / period) ** 2
            if arg is None or v > best:
                best, arg = v, p
        score[t] = env[t] + max(best, 0.0) if arg is not None else env[t]
        back[t] = arg if arg is not None and best > 0 else None
    tail = range(max(len(env) - math.ceil(period) - 1, 0), len(env))
    t = max(tail, key=lambda i: (score[i], -i))
    out = [t]
    while back[t] is not None:
        t = back[t]
        out.append(t)
    return out[::-1]


@pytest.mark.parametrize("chunk", [64, 1 << 19])
def test_beats_equal_brute_force(spark, chunk):
    rnd = random.Random(7)
    env = [rnd.random() + (3 if i % 11 == 2 else 0) for i in range(300)]
    e = spark.createDataFrame([(0, i, v) for i, v in enumerate(env)], "stream_id long, k long, v double")
    p = spark.createDataFrame([(0, 11.2)], "stream_id long, period double")
    assert [r["k"] for r in sg.beats(e, p, chunk).orderBy("k").collect()] == brute_beats(env, 11.2)


def test_offset_and_polarity(spark, noise):
    s = samples(spark, noise[:6000], 1).unionByName(samples(spark, -noise[500:5500], 2))
    r = sg.audio_offsets(spark.createDataFrame([(0, 1, 2)], "pair_id long, a long, b long"), s, 16_000).first()
    assert r["lag"] == 500 and r["inverted"] and r["reliable"] and abs(r["lag_fine"] - 500) < 0.01


@pytest.mark.parametrize("bound", [40, 50_000])
def test_thinning_equals_plain_recursion(spark, bound):
    rnd = random.Random(8)
    t = sorted(rnd.sample(range(10_000), 300))
    v = [math.sin(x / 400) * 10 + rnd.random() for x in t]
    keep = au._rdp(np.array(t, dtype=float), np.array(v), 1.5)
    df = spark.createDataFrame([(0, i, a, b) for i, (a, b) in enumerate(zip(t, v))], "owner_id long, seq long, t long, v double")
    got = sorted(r["t"] for r in au.thin_keyframes(df, 1.5, bound=bound).collect())
    assert got == [a for a, k in zip(t, keep) if k]


def test_word_errors(spark):
    assert tr.edit_distance("kitten", "sitting") == 3 and tr.edit_distance([], [1, 2]) == 2 and tr.edit_distance([1], []) == 1
    df = spark.createDataFrame([(0, "The quick, brown fox jumps - over!", "the quick fox jumps over"), (1, "", ""), (2, "", "x")], "doc_id long, reference string, hypothesis string")
    got = {r["doc_id"]: r["wer"] for r in tr.word_error_rate(df).collect()}
    assert got == {0: 1 / 6, 1: 0.0, 2: 1.0}


def test_cuts_of_known_shots(spark):
    looks = np.random.default_rng(3).random((5, 624))
    data, f = [], 0
    for s, n in enumerate([20, 15, 25, 12, 10]):
        for i in range(n):
            v = looks[s] + i * 1e-4
            h = v[576:] / v[576:].sum() * 3
            data.append((0, f, (v[:576] * (s % 2)).tolist(), np.roll(h, 7 * s).tolist()))
            f += 1
    df = spark.createDataFrame(data, "clip_id long, frame long, grid array<double>, hist array<double>")
    got = [r["frame"] for r in px.scene_cuts(df).orderBy("frame").collect()]
    assert got == [20, 35, 60, 72]


def test_reference_white_of_pq_and_hlg(spark):
    row = spark.range(1).select((cl.pq_decode(cl.pq_encode(F.lit(0.0203))) * 10_000).alias("nits"), cl.pq_encode(F.lit(0.0203)).alias("code"), (F.pow(cl.hlg_decode(F.lit(0.75)), F.lit(1.2)) * 1000).alias("hlg")).first()
    assert abs(row["nits"] - 203) < 1e-3 and abs(row["code"] - 0.58) < 2e-3 and abs(row["hlg"] - 203) < 2


def test_stream_in_many_batches(spark, tmp_path):
    rnd = random.Random(9)
    log = [(s, t * 1000 + s, t, "info", "a", rnd.choice("xxy")) for s in range(3) for t in range(200)]
    df = spark.createDataFrame(log, "session_id long, ts_us long, seq long, level string, source string, message string")
    for k in range(4):
        df.filter(F.floor(F.col("seq") / 50) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = live.latest(live.run_available(live.stream_log_runs(s), spark), ["session_id", "run"], ["_batch", "count"])
    from tickloom.operators.sessions import log_runs

    cols = ["session_id", "run", "message", "count", "last_us"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, log_runs(df).select(cols).collect()))
