"""Operators over sample tables ``(stream_id, ch, n, x)``, envelopes and keyframes."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, gcd, pi, sqrt, tan

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tickloom.functions.timebase import TPS, col, fdiv, gain, idiv
from tickloom.operators.intervals import merge_ranges
from tickloom.operators.ordered import TIME_CHUNK, each_group, first_from, last_before, last_upto, max_before, orbit, prev, scan, sum_before
from tickloom.operators.ranks import halo, nearest_rank
from tickloom.session import cut_lineage

SIG = ["stream_id", "ch"]
FLOOR_DB = -120.0
# Floor, width and number of the loudness bins.
LUFS_MIN, LUFS_STEP, LUFS_BINS = -70.0, 0.01, 9000


def _neg_inf() -> Column:
    return F.lit(float("-inf"))


def decibel(power: Column, floor: float | None = None) -> Column:
    d = F.lit(10.0) * F.log10(power)
    return F.coalesce(d, _neg_inf()) if floor is None else F.greatest(F.coalesce(d, F.lit(floor)), F.lit(floor))


def lufs(energy: Column) -> Column:
    return F.when(energy > 0, F.lit(-0.691) + F.lit(10.0) * F.log10(energy)).otherwise(_neg_inf())


def waveform_peaks(samples: DataFrame, bucket: int) -> DataFrame:
    """Min and max per bucket and channel; both start at 0."""
    return samples.groupBy(*SIG, idiv("n", F.lit(max(bucket, 1))).alias("bucket")).agg(F.least(F.min("x"), F.lit(0.0)).alias("lo"), F.greatest(F.max("x"), F.lit(0.0)).alias("hi"))


def rms_envelope(samples: DataFrame, hop: int, window: int) -> DataFrame:
    """RMS dBFS per hop over a centred window clipped at the stream's edges, power averaged over channels."""
    half = max(window // 2, 1)
    unit = gcd(hop, half)
    cells = samples.groupBy("stream_id", idiv("n", F.lit(unit)).alias("u")).agg(F.sum(F.col("x") * F.col("x")).alias("p"), F.count("*").alias("m"))
    # cell u counts for every hop k whose window [k*hop - half, k*hop + half) holds it
    per, h = hop // unit, half // unit
    lo, hi = -fdiv(-(F.col("u") - h + 1), F.lit(per)), fdiv(F.col("u") + h, F.lit(per))
    spread = cells.filter(hi >= F.greatest(lo, F.lit(0))).select("stream_id", "p", "m", "u", F.explode(F.sequence(F.greatest(lo, F.lit(0)), hi)).alias("k"))
    e = spread.groupBy("stream_id", "k").agg(F.sum("p").alias("p"), F.sum("m").alias("m"), F.max((fdiv("u", F.lit(per)) == F.col("k"))).alias("own"))
    return e.filter("own").select("stream_id", "k", F.when(F.col("p") / F.col("m") <= 1e-12, FLOOR_DB).otherwise(decibel(F.col("p") / F.col("m"), FLOOR_DB)).alias("db"))


def frame_levels(samples: DataFrame, frame: int) -> DataFrame:
    return samples.groupBy("stream_id", idiv("n", F.lit(frame)).alias("k")).agg((F.lit(10.0) * F.log10(F.avg(F.col("x") * F.col("x")) + 1e-12)).alias("db"))


def speech_threshold(frames: DataFrame) -> DataFrame:
    """Speech/silence threshold per stream: floor + 30 % towards speech, at least 6 dB above the floor."""
    rank = lambda p: F.floor((F.col("n") - 1).cast("double") * p)
    q = nearest_rank(frames.filter("db > -100"), ["stream_id"], "db", {"lo": rank(0.10), "hi": rank(0.95)})
    thr = F.greatest(F.col("lo") + 0.3 * (F.col("hi") - F.col("lo")), F.col("lo") + 6.0)
    return frames.select("stream_id").distinct().join(q.select("stream_id", thr.alias("thr")), "stream_id", "left").na.fill(-60.0, ["thr"])


def tighten_words(words: DataFrame, frames: DataFrame, thresholds: DataFrame, frame_ticks: int, least: int = 6) -> DataFrame:
    """Word bounds moved inward past unvoiced frames: two as-of lookups per word, no word-by-frame join."""
    f = frames.join(thresholds, "stream_id")
    length = frames.groupBy("stream_id").agg((F.max("k") + 1).alias("_len"))
    w = words.join(length, "stream_id").withColumns({
        "a": F.greatest(idiv("start", F.lit(frame_ticks)), F.lit(0)), "b": F.least(F.greatest(idiv(F.col("end") + frame_ticks - 1, F.lit(frame_ticks)), F.lit(0)), F.col("_len")),
    })
    none = F.lit(None).cast("long")
    voiced = f.filter("db >= thr").select("stream_id", F.col("k").alias("p"), F.lit(1).alias("o"), none.alias("idx"), F.lit(None).cast("string").alias("end_"), F.col("k").alias("v"))
    probe = lambda c, tag, o: w.select("stream_id", F.col(c).alias("p"), F.lit(o).alias("o"), "idx", F.lit(tag).alias("end_"), none.alias("v"))
    u = voiced.unionByName(probe("a", "a", 0)).unionByName(probe("b", "b", 0))
    s = scan(u, ["stream_id"], ["p", "o"], 60_000, nx=first_from("v"), pv=last_before("v")).filter("end_ is not null")
    s = s.groupBy("stream_id", "idx").agg(F.max(F.when(F.col("end_") == "a", F.col("nx"))).alias("f"), F.max(F.when(F.col("end_") == "b", F.col("pv"))).alias("l"))
    w = w.join(s, ["stream_id", "idx"])
    cut = F.least(F.col("f"), F.col("b") - least)
    end = F.greatest(F.col("l") + 1, cut + least)
    ok = (F.col("b") > F.col("a") + least) & F.col("f").isNotNull() & (F.col("f") < end)
    start = F.when(ok & (cut > F.col("a")), cut * frame_ticks).otherwise(F.col("start"))
    stop = F.when(ok & (end < F.col("b")), F.greatest(end * frame_ticks, start)).otherwise(F.col("end"))
    return w.select("stream_id", "idx", start.alias("start"), stop.alias("end"))


# ---- loudness ---------------------------------------------------------------------------------

def k_weighting(rate: float) -> list[tuple[float, float, float, float, float]]:
    """The two K-weighting sections (b0 b1 b2 a1 a2) at any sample rate."""
    # Analog prototypes of the shelf and of the high-pass (frequency, gain dB, Q, exponent).
    shelf_f, shelf_db, shelf_q, shelf_e = 1681.974450955533, 3.999843853973347, 0.7071752369554196, 0.4996667741545416
    high_f, high_q = 38.13547087602444, 0.5003270373238773
    k, vh = tan(pi * shelf_f / rate), 10 ** (shelf_db / 20)
    vb, a0 = vh**shelf_e, 1 + k / shelf_q + k * k
    first = ((vh + vb * k / shelf_q + k * k) / a0, 2 * (k * k - vh) / a0, (vh - vb * k / shelf_q + k * k) / a0, 2 * (k * k - 1) / a0, (1 - k / shelf_q + k * k) / a0)
    k = tan(pi * high_f / rate)
    a0 = 1 + k / high_q + k * k
    return [first, (1.0, -2.0, 1.0, 2 * (k * k - 1) / a0, (1 - k / high_q + k * k) / a0)]


def k_response(rate: int, length: int) -> np.ndarray:
    """Impulse response of the K-weighting; after one second it is below 1e-12."""
    y = np.zeros(length)
    y[0] = 1.0
    for b0, b1, b2, a1, a2 in k_weighting(rate):
        x, y, s1, s2 = y.tolist(), np.zeros(length), 0.0, 0.0
        for i, v in enumerate(x):
            out = b0 * v + s1
            s1, s2 = b1 * v - a1 * out + s2, b2 * v - a2 * out
            y[i] = out
    return y


# Channel weights for 5.0, 5.1 and 7.1; all other layouts weigh 1.
WEIGHTS = {5: [1.0, 1.0, 1.0, 1.41, 1.41], 6: [1.0, 1.0, 1.0, 0.0, 1.41, 1.41], 8: [1.0, 1.0, 1.0, 0.0, 1.41, 1.41, 1.41, 1.41]}


def by_chunk(samples: DataFrame, fn: Callable[[np.ndarray, int, int, int], dict], schema: str, chunk: int, run_in: int, after: int = 0) -> DataFrame:
    """Run ``fn(x, first, n0, own)`` over chunks of each channel.

    Long streams are many groups: a chunk carries its ``own`` samples from ``n0``, ``first``
    samples of run-in before them and up to ``after`` samples behind them.
    """
    copies = idiv(F.col("n") + run_in, F.lit(chunk))
    least = idiv(F.greatest(F.col("n") - after, F.lit(0)), F.lit(chunk))
    wide = samples.select(*SIG, "n", "x", F.explode(F.sequence(least, copies)).alias("_c"))
    names = [c.split()[0] for c in schema.split(", ")]

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        c, n = int(pdf["_c"].iloc[0]), pdf["n"].to_numpy()
        lo = int(n[0])
        if n[-1] < c * chunk:  # run-in of a chunk behind the end of the channel
            return pd.DataFrame(columns=["stream_id", "ch", *names])
        x = np.zeros(int(n[-1]) - lo + 1)
        x[n - lo] = pdf["x"].to_numpy()
        own = min(chunk, int(n[-1]) + 1 - c * chunk)
        out = pd.DataFrame(fn(x, c * chunk - lo, c * chunk, own))
        out.insert(0, "stream_id", pdf["stream_id"].iloc[0])
        out.insert(1, "ch", pdf["ch"].iloc[0])
        return out

    return wide.repartition(*SIG, "_c").groupBy(*SIG, "_c").applyInPandas(apply, f"stream_id long, ch int, {schema}")


def fft_filter(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    size = 1 << (len(x) + len(h) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)[: len(x)]


def k_weighted_energy(samples: DataFrame, rate: int, channels: int = 1, chunk_blocks: int = 100) -> DataFrame:
    """Weighted energy per complete 100 ms block: ``(stream_id, block, e, m)``."""
    sub = round(rate * 0.1)
    h = k_response(rate, rate)
    weights = WEIGHTS.get(channels, [1.0] * channels)

    def energy(x, first, n0, own):
        y = fft_filter(x, h)[first:]
        whole = len(y) // sub
        return {"block": n0 // sub + np.arange(whole), "e": (y[: whole * sub].reshape(whole, sub) ** 2).sum(axis=1)}

    e = by_chunk(samples, energy, "block long, e double", sub * chunk_blocks, rate)
    w = F.element_at(F.array(*[F.lit(v) for v in weights]), F.col("ch") + 1)
    return e.groupBy("stream_id", "block").agg(F.sum(F.col("e") * w).alias("e"), F.lit(sub).alias("m"))


def loudness_series(blocks: DataFrame, chunk: int = 6000) -> DataFrame:
    """Momentary (4 blocks) and short-term (30 blocks) loudness every block; missing blocks are silence."""
    b = halo(blocks, "block", chunk, 29)
    w = W.partitionBy("stream_id", "_c").orderBy("block")
    em = F.sum("e").over(w.rangeBetween(-3, 0)) / (4 * F.col("m"))
    es = F.sum("e").over(w.rangeBetween(-29, 0)) / (30 * F.col("m"))
    s = b.withColumns({"em": em, "es": es}).filter("_own")
    return s.select("stream_id", "block", "em", "es", lufs(F.col("em")).alias("momentary"), lufs(F.col("es")).alias("short_term"))


def loudness_maxima(series: DataFrame) -> DataFrame:
    return series.groupBy("stream_id").agg(
        F.coalesce(F.max(F.when(F.col("block") >= 3, F.col("momentary"))), _neg_inf()).alias("max_momentary"),
        F.coalesce(F.max(F.when(F.col("block") >= 29, F.col("short_term"))), _neg_inf()).alias("max_short_term"),
    )


def _bin(l: Column) -> Column:
    return F.least(F.greatest(F.floor((l - LUFS_MIN) / LUFS_STEP), F.lit(0)), F.lit(LUFS_BINS - 1)).cast("int")


def _gated(series: DataFrame, energy: str, level: str, first: int, gate: float) -> tuple[DataFrame, DataFrame]:
    bins = series.filter((F.col("block") >= first) & (F.col(level) >= LUFS_MIN)).groupBy("stream_id", _bin(F.col(level)).alias("bin")).agg(F.sum(energy).alias("e"), F.count("*").alias("m"))
    thr = bins.groupBy("stream_id").agg(lufs(F.sum("e") / F.sum("m")).alias("_l")).withColumn("thr", F.col("_l") + gate)
    cut = thr.withColumn("_from", F.when(F.col("thr") < LUFS_MIN, F.lit(0)).otherwise(_bin(F.col("thr"))))
    return bins.join(cut, "stream_id").filter("bin >= _from"), thr


def integrated_loudness(series: DataFrame) -> DataFrame:
    """Gated loudness and the relative threshold; −inf where nothing passes."""
    kept, thr = _gated(series, "em", "momentary", 3, -10.0)
    i = kept.groupBy("stream_id").agg(lufs(F.sum("e") / F.sum("m")).alias("integrated"))
    out = series.select("stream_id").distinct().join(i, "stream_id", "left").join(thr.select("stream_id", "thr"), "stream_id", "left")
    return out.select("stream_id", F.coalesce("integrated", _neg_inf()).alias("integrated"), F.coalesce("thr", _neg_inf()).alias("thr"))


def loudness_range(series: DataFrame) -> DataFrame:
    """p95 - p10 of gated short-term values over 0.01 LU bins (at most 9 000 rows per stream)."""
    kept, _ = _gated(series, "es", "short_term", 29, -20.0)
    w = W.partitionBy("stream_id").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    c = kept.select("stream_id", "bin", F.sum("m").over(w).alias("cum"), F.sum("m").over(W.partitionBy("stream_id")).alias("n"))
    at = lambda p: F.min(F.when(F.col("cum") > F.least(F.round(p * (F.col("n") - 1)), F.col("n") - 1), F.col("bin")))
    r = c.groupBy("stream_id").agg(((at(0.95) - at(0.10)) * LUFS_STEP).alias("lra"))
    return series.select("stream_id").distinct().join(r, "stream_id", "left").na.fill(0.0, ["lra"])


def true_peak_bank(rate: float, taps: int = 16) -> np.ndarray:
    """Polyphase interpolator ``[phase, tap]``: Kaiser-windowed sinc, each phase with unit gain."""
    factor = 4 if rate < 88_200 else 2 if rate < 176_400 else 1
    m = np.arange(factor * taps)
    centre = (factor * taps - 1) / 2
    win = np.i0(8.0 * np.sqrt(np.maximum(1 - ((m - centre) / (centre + 1)) ** 2, 0))) / np.i0(8.0)
    proto = (np.sinc((m - centre) / factor) * win).reshape(taps, factor).T
    return proto / proto.sum(axis=1, keepdims=True)


def peak_levels(samples: DataFrame, rate: int, chunk: int = 1 << 16) -> DataFrame:
    """Sample peak and oversampled true peak per channel, linear and in dB."""
    bank = true_peak_bank(rate)

    def peak(x, first, n0, own):
        tp = max(np.abs(np.convolve(x, c)[first : len(x)]).max() for c in bank)
        sp = np.abs(x[first:]).max()
        return {"sp": [sp], "tp": [max(tp, sp)]}

    p = by_chunk(samples, peak, "sp double, tp double", chunk, bank.shape[1] - 1).groupBy(*SIG).agg(F.max("sp").alias("sp"), F.max("tp").alias("tp"))
    return p.select(*SIG, "sp", "tp", decibel(F.col("sp") * F.col("sp")).alias("sp_db"), decibel(F.col("tp") * F.col("tp")).alias("tp_db"))


def loudness_gains(summary: DataFrame, targets: DataFrame, max_true_peak: float | None = None) -> DataFrame:
    """Gain to each clip's target; silent or untyped clips are reported as skipped."""
    j = summary.join(targets, "stream_id", "left")
    fine = F.col("integrated").isNotNull() & (F.col("integrated") > float("-inf"))
    g = F.least(F.greatest("target", F.lit(-60.0)), F.lit(0.0)) - F.col("integrated")
    if max_true_peak is not None:
        g = F.when(F.col("tp_db") > float("-inf"), F.least(g, F.lit(max_true_peak) - F.col("tp_db"))).otherwise(g)
    return j.select("stream_id", F.when(fine & F.col("target").isNotNull(), g).alias("gain_db"), F.when(F.col("target").isNull(), "no audio type").when(~fine, "silent").alias("skipped"))


# ---- envelopes and keyframes ------------------------------------------------------------------

def sensitivity_threshold(s: float) -> float:
    return -20.0 - 4.0 * min(max(s, 0.0), 10.0)


def activity_regions(env: DataFrame, thr: float, hop_s: float = 0.01, min_on: float = 0.1, bridge: float = 0.3) -> DataFrame:
    """Regions above a threshold, short gaps bridged first, then short regions dropped (hop indices)."""
    on = env.filter(F.col("db") > thr).select("stream_id", F.col("k").alias("start"), (F.col("k") + 1).alias("end"))
    slack = max(ceil((bridge - 1e-9) / hop_s) - 1, 0)
    r = merge_ranges(on, ["stream_id"], slack=slack, chunk=60_000)
    return r.filter((F.col("end") - F.col("start")) * hop_s >= min_on - 1e-9)


def duck_keyframes(regions: DataFrame, clips: DataFrame, reduce_db: float, fade_s: float) -> DataFrame:
    """Volume ramps under ``regions(clip_id, start, end)`` for ``clips(clip_id, c0, c1, base)``; all in ticks."""
    fade = max(round(fade_s * TPS), TPS // 1000)
    r = regions.join(clips, "clip_id").filter("end > start and end > c0 and start < c1").select("clip_id", "start", "end")
    g = merge_ranges(r, ["clip_id"], slack=2 * fade).join(clips, "clip_id")
    low = F.col("base") - abs(reduce_db)
    part = lambda t, from_: F.least(F.greatest((t - from_).cast("double") / fade, F.lit(0.0)), F.lit(1.0))
    a, b, c0, c1 = (F.col(c) for c in ("start", "end", "c0", "c1"))
    pt = lambda o, t, v, ok=F.lit(True): F.when(ok, F.struct(F.lit(o).alias("o"), t.alias("t"), v.alias("v")))
    pts = F.array(
        pt(0, F.greatest(a - fade, c0), F.when(a - fade >= c0, F.col("base")).otherwise(F.col("base") + (low - F.col("base")) * part(c0, a - fade))),
        pt(1, F.greatest(a, c0), low), pt(2, F.least(b, c1), low),
        pt(3, F.least(b + fade, c1), F.when(b + fade <= c1, F.col("base")).otherwise(low + (F.col("base") - low) * part(c1, b)), b < c1),
    )
    k = g.select("clip_id", F.explode(F.array_compact(pts)).alias("p"), "c0", "c1").filter("p.t between c0 and c1")
    return k.groupBy("clip_id", F.col("p.t").alias("t")).agg(F.max_by("p.v", F.col("p.o")).alias("v"))


def _bezier_ease(x1: Column, y1: Column, x2: Column, y2: Column, u: Column) -> Column:
    cubic = lambda s, p1, p2: 3 * (1 - s) * (1 - s) * s * p1 + 3 * (1 - s) * s * s * p2 + s * s * s
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    box = F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), u.alias("u"))

    def halve(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2
        left = cubic(mid, box["x1"], box["x2"]) < box["u"]
        return F.struct(F.when(left, mid).otherwise(acc["lo"]).alias("lo"), F.when(left, acc["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(48)), start, halve, lambda acc: cubic((acc["lo"] + acc["hi"]) / 2, box["y1"], box["y2"]))


def keyframe_values(keyframes: DataFrame, times: DataFrame, keys=("owner_id",), chunk=TIME_CHUNK) -> DataFrame:
    """Value at ``times(keys, t)``: clamped outside, exact on a key, hold, linear or eased between.

    ``value`` may be a number or an array; arrays of unequal length hold.
    """
    keys = list(keys)
    vector = dict(keyframes.dtypes)["value"].startswith("array")
    kf = F.struct("time", "value", "interp", "in_influence", "out_influence")
    none = F.lit(None).cast(keyframes.select(kf.alias("k")).schema["k"].dataType)
    body = F.struct(*times.columns)
    empty = F.lit(None).cast(times.select(body.alias("b")).schema["b"].dataType)
    a = keyframes.select(*keys, F.col("time").alias("_t"), F.lit(0).alias("_o"), kf.alias("_k"), empty.alias("_b"))
    b = times.select(*keys, F.col("t").alias("_t"), F.lit(1).alias("_o"), none.alias("_k"), body.alias("_b"))
    s = scan(a.unionByName(b), keys, ["_t", "_o"], chunk, _p=last_upto("_k"), _n=first_from("_k")).filter("_o = 1")
    p, n = F.col("_p"), F.col("_n")
    u = (F.col("_t") - p["time"]).cast("double") / (n["time"] - p["time"]).cast("double")
    out_e = p["interp"].isin("bezier", "autoBezier", "continuousBezier", "easeOut")
    in_e = n["interp"].isin("bezier", "autoBezier", "continuousBezier", "easeIn") | p["interp"].isin("bezier", "continuousBezier")
    lim = lambda c: F.least(F.greatest(c, F.lit(0.01)), F.lit(1.0))
    third = F.lit(1.0) / 3
    e = F.when(~out_e & ~in_e, u).otherwise(_bezier_ease(
        F.when(out_e, lim(p["out_influence"])).otherwise(third), F.when(out_e, 0.0).otherwise(third),
        F.when(in_e, 1 - lim(n["in_influence"])).otherwise(2 * third), F.when(in_e, 1.0).otherwise(2 * third), u))
    s = s.withColumn("_e", F.when(p.isNotNull() & n.isNotNull() & (p["time"] < F.col("_t")) & (p["interp"] != "hold"), e))
    if vector:
        mixed = F.when(F.size(p["value"]) == F.size(n["value"]), F.zip_with(p["value"], n["value"], lambda x, y: x + (y - x) * F.col("_e"))).otherwise(p["value"])
    else:
        mixed = p["value"] + (n["value"] - p["value"]) * F.col("_e")
    v = F.when(p.isNull(), n["value"]).when(n.isNull() | F.col("_e").isNull(), p["value"]).otherwise(mixed)
    return s.select("_b.*", v.alias("value"))


def _rdp(t: np.ndarray, v: np.ndarray, tol: float) -> np.ndarray:
    keep = np.zeros(len(t), bool)
    keep[[0, -1]] = True
    stack = [(0, len(t) - 1)]
    while stack:
        a, b = stack.pop()
        if b <= a + 1:
            continue
        d = np.abs(v[a + 1 : b] - (v[a] + (v[b] - v[a]) * ((t[a + 1 : b] - t[a]) / (t[b] - t[a]))))
        i = int(d.argmax())
        if d[i] > tol:
            keep[a + 1 + i] = True
            stack += [(a, a + 1 + i), (a + 1 + i, b)]
    return keep


def thin_keyframes(points: DataFrame, tol: float, min_gap: int = 0, hold: bool = False, bound: int = 50_000) -> DataFrame:
    """Recorded points ``(owner_id, seq, t, v)`` thinned within a tolerance.

    Lanes longer than ``bound`` points are first split level by level with distributed maxima;
    only stretches below the bound are finished inside one group.
    """
    key = ["owner_id"]
    p = scan(points, key, ["seq"], 8192, _hi=max_before("t")).filter("_hi is null or t >= _hi").drop("_hi")
    p = p.groupBy(*key, "t").agg(F.max_by("v", "seq").alias("v"))
    if hold:
        s = scan(p, key, ["t"], _pv=prev("v"))
        size = p.groupBy(*key).agg(F.count("*").alias("_n"))
        change = F.col("_pv").isNull() | (F.abs(F.col("v") - F.col("_pv")) > max(tol, 1e-9)) | (F.col("_n") <= 2)
        return s.join(size, key).filter(change).select(*key, "t", "v")
    ends = p.groupBy(*key).agg(F.min("t").alias("a"), F.max("t").alias("b"), F.min_by("v", "t").alias("va"), F.max_by("v", "t").alias("vb"))
    rows = cut_lineage(p.join(ends, key))
    seg = [*key, "a", "b", "va", "vb"]
    small = None
    while True:
        size = rows.groupBy(*seg).agg(F.count("*").alias("_n"))
        big = rows.join(size.filter(F.col("_n") > bound), seg)
        part = rows.join(size.filter(F.col("_n") <= bound), seg, "left_semi")
        small = part if small is None else small.unionByName(part)
        if big.isEmpty():
            break
        line = F.col("va") + (F.col("vb") - F.col("va")) * ((F.col("t") - F.col("a")).cast("double") / (F.col("b") - F.col("a")))
        far = big.filter("t > a and t < b").groupBy(*seg).agg(F.max(F.struct(F.abs(F.col("v") - line).alias("d"), (-F.col("t")).alias("t"), F.col("v").alias("v"))).alias("w")).filter(F.col("w.d") > tol)
        j = big.join(far.select(*seg, (-F.col("w.t")).alias("c"), F.col("w.v").alias("vc")), seg)
        left = j.filter("t <= c").withColumns({"b": F.col("c"), "vb": F.col("vc")}).select(rows.columns)
        right = j.filter("t >= c").withColumns({"a": F.col("c"), "va": F.col("vc")}).select(rows.columns)
        straight = big.join(far.select(*seg), seg, "left_anti").filter("t = a or t = b").select(rows.columns)
        small = small.unionByName(straight)
        rows = cut_lineage(left.unionByName(right))

    def finish(pdf: pd.DataFrame, groups: list[tuple[int, int]]) -> pd.DataFrame:
        t, v, keep = pdf["t"].to_numpy(dtype=float), pdf["v"].to_numpy(), np.ones(len(pdf), bool)
        for a, b in groups:
            if b - a > 2:
                keep[a:b] = _rdp(t[a:b], v[a:b], tol)
        return pdf.loc[keep, [*key, "t", "v"]]

    # stretches of a lane share their ends only
    kept = each_group(small, [*key, "a"], ["t"], finish, p.schema).distinct()
    if min_gap <= 0:
        return kept
    # spacing is a left-to-right walk to the first point far enough away; the last point always stays
    probe = kept.select(*key, (F.col("t") + min_gap).alias("x"), F.lit(0).alias("o"), F.col("t").alias("me"), F.lit(None).cast("long").alias("at"))
    stops = kept.select(*key, F.col("t").alias("x"), F.lit(1).alias("o"), F.lit(None).cast("long").alias("me"), F.col("t").alias("at"))
    nx = scan(probe.unionByName(stops), key, ["x", "o"], nxt=first_from("at")).filter("o = 0").select(*key, F.col("me").alias("t"), "nxt")
    taken = orbit(nx, key, "t", "nxt", chunk=max(TIME_CHUNK, 1024 * min_gap))
    final = kept.groupBy(*key).agg(F.max("t").alias("t"))
    return kept.join(taken.union(final.select(taken.columns)).distinct(), [*key, "t"], "left_semi")


# ---- sample transforms ------------------------------------------------------------------------

# Fixed values below: mixdown gains of the channel layouts.
def channel_map(source: str, to: str, mixdown: str = "frontRear") -> dict[int, list[tuple[int, float]]]:
    """Input channel -> (output channel, gain). 5.1 order: L R C LFE Ls Rs."""
    k = 1 / sqrt(2)
    rear, low = "Rear" in mixdown, "Lfe" in mixdown
    if source == to:
        return {i: [(i, 1.0)] for i in range({"mono": 1, "stereo": 2, "5.1": 6}[source])}
    return {
        ("mono", "stereo"): {0: [(0, 1.0), (1, 1.0)]},
        ("mono", "5.1"): {0: [(2, 1.0)]},
        ("stereo", "mono"): {0: [(0, k)], 1: [(0, k)]},
        ("stereo", "5.1"): {0: [(0, 1.0)], 1: [(1, 1.0)]},
        ("5.1", "mono"): {0: [(0, k)], 1: [(0, k)], 2: [(0, 1.0)], 4: [(0, 0.5)], 5: [(0, 0.5)]},
        ("5.1", "stereo"): {0: [(0, 1.0)], 1: [(1, 1.0)], 2: [(0, k), (1, k)], 3: [(0, k), (1, k)] if low else [], 4: [(0, k)] if rear else [], 5: [(1, k)] if rear else []},
    }[(source, to)]


def channel_matrix(samples: DataFrame, source: str, to: str, mixdown: str = "frontRear") -> DataFrame:
    """Up- and downmix by a constant coefficient list; silent outputs are written as zeros."""
    m = channel_map(source, to, mixdown)
    outs = range({"mono": 1, "stereo": 2, "5.1": 6}[to])
    cell = lambda o, g: F.struct(F.lit(o).alias("out"), F.lit(g).alias("g"))
    rows = F.lit(None)
    for c, to_ in m.items():
        gains = dict(to_)
        rows = F.when(F.col("ch") == c, F.array(*[cell(o, gains.get(o, 0.0)) for o in outs])).otherwise(rows)
    s = samples.withColumn("_m", F.explode(rows))
    return s.groupBy("stream_id", "n", F.col("_m.out").alias("ch")).agg(F.sum(F.col("_m.g") * F.col("x")).alias("x"))


#: Instants that one task of a mix sums.
MIXED = 1 << 20
#: A stretch of the timeline that one task of a mix keeps together.
STRETCH = 1 << 16
#: Chunks of samples (33 MB of them) that a mix sends to all tasks; more are dealt out.
AROUND = 1024


def _packed(samples: DataFrame, chunk: int) -> DataFrame:
    """``(stream_id, _c, _n0, _xs, _ns)``: the samples of a chunk in one row; ``_ns`` are their numbers, null where none is missing."""
    s = samples.select("stream_id", "n", "x", fdiv("n", F.lit(chunk)).alias("_c")).repartition("stream_id", "_c")
    s = s.groupBy("stream_id", "_c", "n").agg(F.sum("x").alias("x")).groupBy("stream_id", "_c").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("_s"))
    whole = F.element_at("_s", -1)["n"] - F.col("_s")[0]["n"] + 1 == F.size("_s")
    return s.select("stream_id", "_c", F.col("_s")[0]["n"].alias("_n0"), F.col("_s.x").alias("_xs"), F.when(~whole, F.col("_s.n")).alias("_ns"))


def mix_timeline(clips: DataFrame, samples: DataFrame, tracks: DataFrame, keyframes: DataFrame | None = None, chunk: int = 4096) -> DataFrame:
    """Mono clip samples placed on the timeline with gains, constant-power pan, mute and solo; stereo sum.

    Clips are in samples: ``sequence_id, track_id, clip_id, stream_id, start, duration, source_in,
    speed, reverse, gain_db``. ``keyframes(owner_id = clip_id, time in clip samples)`` hold dB.

    Clips are dealt out by stretches of their sequence while they are still one row each, and meet the packed samples
    there: what they open into is summed where it lies, and only clips travel (with more than ``AROUND`` chunks of
    samples also what the clips take of them; with keyframes every sample).
    """
    solo = tracks.groupBy("sequence_id").agg(F.max("solo").alias("_any"))
    t = tracks.join(solo, "sequence_id").filter(~F.col("muted") & (~F.col("_any") | F.col("solo"))).select("track_id", "volume_db", "pan")
    c = clips.filter("enabled and speed > 0 and duration > 0")
    total = c.agg(F.sum("duration")).first()[0] or 0
    tasks = max(c.sparkSession.sparkContext.defaultParallelism, -(-total // MIXED))
    c = c.join(t, "track_id").withColumn("_level", F.coalesce("gain_db", F.lit(0.0)) + F.col("volume_db"))
    c = c.withColumn("_b", F.explode(F.sequence(fdiv("start", F.lit(STRETCH)), fdiv(F.col("start") + F.col("duration") - 1, F.lit(STRETCH)))))
    c = c.select("sequence_id", "_b", "clip_id", "stream_id", "start", "duration", "source_in", F.col("speed").cast("double").alias("speed"), "reverse", "_level", "pan").repartition(tasks, "sequence_id", "_b")
    # output sample k takes the source sample floor(k * speed), counted from the other end in reverse
    used = F.ceil(F.col("duration") * F.col("speed")).cast("long")
    source = lambda k: F.floor(k * F.col("speed")).cast("long")
    c = c.withColumns({
        "_k0": F.greatest(F.col("_b") * STRETCH - F.col("start"), F.lit(0)), "_k1": F.least((F.col("_b") + 1) * STRETCH - F.col("start"), F.col("duration")) - 1,
        "_last": F.col("source_in") + used - 1, "_angle": (F.col("pan") + 1) * (pi / 4),
    })
    place = lambda k: F.when(F.col("reverse"), F.col("_last") - source(k)).otherwise(F.col("source_in") + source(k))
    ends = [fdiv(place(F.col(k)), F.lit(chunk)) for k in ("_k0", "_k1")]
    c = c.withColumns({"_gain": gain(F.col("_level")), "_cos": F.cos("_angle"), "_sin": F.sin("_angle"), "_c": F.explode(F.sequence(F.least(*ends), F.greatest(*ends)))})
    packed = cut_lineage(_packed(samples, chunk))
    j = c.join(F.broadcast(packed) if packed.count() <= AROUND else packed, ["stream_id", "_c"])
    # the outputs that take from this chunk, and one more at either end against rounding
    r0 = F.when(F.col("reverse"), F.col("_last") + 1 - (F.col("_c") + 1) * chunk).otherwise(F.col("_c") * chunk - F.col("source_in"))
    first = F.greatest("_k0", F.floor(r0 / F.col("speed")).cast("long") - 1)
    last = F.least("_k1", F.ceil((r0 + chunk) / F.col("speed")).cast("long") + 1)
    j = j.withColumns({"_first": first, "_stop": last}).filter("_first <= _stop").withColumn("k", F.explode(F.sequence("_first", "_stop"))).withColumn("_p", place(F.col("k")))
    at = F.when(F.col("_ns").isNull(), F.col("_p") - F.col("_n0")).otherwise(F.array_position("_ns", F.col("_p")) - 1)
    j = j.filter(fdiv("_p", F.lit(chunk)) == F.col("_c")).withColumn("_at", at.cast("int")).filter((F.col("_at") >= 0) & (F.col("_at") < F.size("_xs")))
    j = j.select("sequence_id", "_b", "clip_id", "k", (F.col("start") + F.col("k")).alias("n"), F.get("_xs", "_at").alias("x"), "_level", "_gain", "_cos", "_sin")
    loud = F.col("_gain")
    if keyframes is not None:
        j = keyframe_values(keyframes, j.withColumns({"owner_id": F.col("clip_id"), "t": F.col("k")}), chunk=1 << 16)
        loud = gain(F.col("_level") + F.coalesce("value", F.lit(0.0)))
    y = F.col("x") * loud
    # both channels of an instant are summed in one row and told apart afterwards
    out = j.groupBy("sequence_id", "_b", "n").agg(F.sum(y * F.col("_cos")).alias("_l"), F.sum(y * F.col("_sin")).alias("_r"))
    return out.select("sequence_id", "n", F.posexplode(F.array("_l", "_r")).alias("ch", "x"))


def audio_stage(samples: DataFrame, fn: Callable[[np.ndarray], np.ndarray], latency: int = 0, run_in: int = 0, chunk: int = 1 << 16) -> DataFrame:
    """A user's block function over every channel, its declared latency compensated.

    Blocks get ``run_in`` samples before and ``latency`` samples after their own part.
    """

    def run(x, first, n0, own):
        y = np.asarray(fn(np.concatenate([x, np.zeros(latency)])))
        return {"n": n0 + np.arange(own), "x": y[first + latency : first + latency + own]}

    return by_chunk(samples, run, "n long, x double", chunk, run_in, latency)
