"""Operators over pixel tables ``(frame_id, x, y, r, g, b, a)``: scopes, statistics, shots, colour."""

from __future__ import annotations

from functools import reduce
from math import atan2, degrees, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tickloom.functions import color as cl
from tickloom.functions.timebase import col, fdiv, idiv
from tickloom.operators.ordered import INDEX_CHUNK, first_from, following, orbit, prev, scan
from tickloom.operators.ranks import halo

EXTENT = 0.6


def _round(c: Column) -> Column:
    return F.round(c, 0).cast("int")


def _spread(pixels: DataFrame, traces: dict[str, list[Column]], clamp: bool) -> DataFrame:
    vals = [F.struct(F.lit(n).alias("trace"), v.alias("v")) for n, vs in traces.items() for v in vs]
    p = pixels.withColumn("_t", F.explode(F.array(*vals))).filter("_t.v is not null")
    v = F.col("_t.v")
    return p.withColumns({"trace": F.col("_t.trace"), "v": cl.clamp(v) if clamp else v})


def _rgb(clamp: bool) -> list[Column]:
    return [cl.clamp(c) if clamp else F.col(c) for c in "rgb"]


def rgb_histogram(pixels: DataFrame, matrix: str = "709", clamp: bool = False) -> DataFrame:
    """256-bin counts per frame and channel; bin -1 / 256 hold what lies below / above (also put in
    the end bins when clamped)."""
    y, _, _ = cl.ycbcr("r", "g", "b", matrix)
    codes = []
    for k, v in enumerate((F.col("r"), F.col("g"), F.col("b"), y)):
        b = F.when(v.between(0.0, 1 + 1e-6), F.least(_round(v * 255), F.lit(255))).when(v < 0, -1).when(v > 1, 256)
        b = F.when(~F.isnan(v), b)
        codes.append(b + k * 300)
        if clamp:
            codes.append(F.when(b == -1, F.lit(k * 300)).when(b == 256, F.lit(k * 300 + 255)))
    # one integer per count keeps the hash table narrow; names come back after the aggregation
    n = pixels.select("frame_id", F.explode(F.array_compact(F.array(*codes))).alias("code")).groupBy("frame_id", "code").agg(F.count("*").alias("n"))
    k = idiv(F.col("code") + 1, F.lit(300)).cast("int")
    return n.select("frame_id", F.element_at(F.array(*[F.lit(c) for c in "RGBY"]), k + 1).alias("ch"), (F.col("code") - k * 300).cast("int").alias("bin"), "n")


def _cells(pixels: DataFrame, traces: dict, rows: int, lo: float, hi: float, clamp: bool) -> DataFrame:
    p = _spread(pixels, traces, clamp)
    t = (F.col("v") - lo) / (hi - lo)
    return p.filter(t.between(0.0, 1.0)).groupBy("frame_id", "trace", F.col("x").alias("col"), F.least(_round(t * (rows - 1)), F.lit(rows - 1)).alias("row")).agg(F.count("*").alias("n"))


def waveform_scope(pixels: DataFrame, kind: str = "luma", rows: int = 256, lo: float = 0.0, hi: float = 1.0, matrix: str = "709", clamp: bool = False) -> DataFrame:
    """Counts per column and level: ``rgb``, ``luma``, ``yc`` (Y and Y±C) or ``yc_no_chroma``."""
    r, g, b = _rgb(clamp)
    y, cb, cr = cl.ycbcr(r, g, b, matrix)
    c = F.sqrt(cb * cb + cr * cr)
    some = c > 1e-6
    traces = {
        "rgb": {"R": [r], "G": [g], "B": [b]}, "luma": {"Y": [y]}, "yc_no_chroma": {"Y": [y]},
        "yc": {"Y": [y], "C": [y + c, F.when(some, y - c)]},
    }[kind]
    return _cells(pixels, traces, rows, lo, hi, clamp)


def parade_scope(pixels: DataFrame, kind: str = "rgb", rows: int = 256, lo: float = 0.0, hi: float = 1.0, matrix: str = "709", clamp: bool = False) -> DataFrame:
    r, g, b = _rgb(clamp)
    y, cb, cr = cl.ycbcr(r, g, b, matrix)
    traces = {"rgb": {"R": [r], "G": [g], "B": [b]}, "rgb_white": {"R": [r], "G": [g], "B": [b], "Y": [y]}, "yuv": {"Y": [y], "Cb": [cb + 0.5], "Cr": [cr + 0.5]}}[kind]
    return _cells(pixels, traces, rows, lo, hi, clamp)


def _plot(points: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    n = size - 1
    fx, fy = (F.col("cb") / EXTENT * 0.5 + 0.5) * n, (0.5 - F.col("cr") / EXTENT * 0.5) * n
    inside = points.filter(fx.between(0, n) & fy.between(0, n))
    cells = inside.groupBy("frame_id", _round(fx).alias("cx"), _round(fy).alias("cy")).agg(F.count("*").alias("n"))
    return cells, inside.groupBy("frame_id").agg(F.count("*").alias("samples"), F.avg("cb").alias("cb"), F.avg("cr").alias("cr"))


def vectorscope_yuv(pixels: DataFrame, size: int = 256, matrix: str = "709", clamp: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cells, plotted samples and mean chroma per frame)."""
    _, cb, cr = cl.ycbcr(*_rgb(clamp), matrix)
    return _plot(pixels.select("frame_id", cb.alias("cb"), cr.alias("cr")), size)


def red_angle(matrix: str) -> float:
    kr, kb = cl.MATRICES[matrix]
    return degrees(atan2((1 - kr) / (2 * (1 - kr)), -kr / (2 * (1 - kb)))) % 360


def vectorscope_hls(pixels: DataFrame, size: int = 256, matrix: str = "709") -> tuple[DataFrame, DataFrame]:
    """Hue in steps of 0.1° from the red angle, saturation as radius (1 = 0.5)."""
    h, s, _ = cl.hsl(*_rgb(True))
    a = F.radians(F.lit(red_angle(matrix)) + F.round(h * 3600, 0) / 10)
    rad = cl.clamp(s) * 0.5
    return _plot(pixels.select("frame_id", (rad * F.cos(a)).alias("cb"), (rad * F.sin(a)).alias("cr")), size)


def channel_stats(pixels: DataFrame, matrix: str = "709") -> DataFrame:
    """min / max / mean of R G B Y in percent, mean chroma, hue angle and saturation."""
    y, cb, cr = cl.ycbcr("r", "g", "b", matrix)
    p = pixels.withColumns({"yy": y, "cb": cb, "cr": cr})
    aggs = [f(c).alias(f"{n}_{m}") for n, c in (("r", "r"), ("g", "g"), ("b", "b"), ("y", "yy")) for m, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    s = p.groupBy("frame_id").agg(*aggs, F.avg("cb").alias("cb"), F.avg("cr").alias("cr"))
    two = lambda c: F.round(c, 2)
    angle = F.degrees(F.atan2("cr", "cb"))
    return s.select(
        "frame_id", *[two(F.col(f"{n}_{m}") * 100).alias(f"{n}_{m}") for n in "rgby" for m in ("min", "max", "mean")], two(F.col("cb") * 100).alias("cb"), two(F.col("cr") * 100).alias("cr"),
        two(F.when(angle < 0, angle + 360).otherwise(angle)).alias("hue"), two(F.sqrt(F.col("cb") * F.col("cb") + F.col("cr") * F.col("cr")) / 0.5 * 100).alias("saturation"),
    )


def scope_trace_columns(cells: DataFrame, cols: int, rows: int, buckets: int, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Waveform cells reduced to column buckets with min, max and weighted mean level in percent."""
    buckets = min(max(buckets, 1), max(cols, 1))
    b = idiv((F.col("col") + 1) * buckets - 1, F.lit(cols))
    level = (lo + (hi - lo) * F.col("row") / (rows - 1)) * 100
    return cells.withColumns({"bucket": b, "level": level}).groupBy("frame_id", "trace", "bucket").agg(
        F.round(F.min("level"), 2).alias("min"), F.round(F.max("level"), 2).alias("max"), F.round(F.sum(F.col("level") * F.col("n")) / F.sum("n"), 2).alias("mean")
    )


def scope_coarse(cells: DataFrame, size_in: int, size: int) -> DataFrame:
    size = min(max(size, 1), size_in)
    at = lambda c: idiv(F.col(c) * size, F.lit(size_in))
    return cells.groupBy("frame_id", at("cx").alias("cx"), at("cy").alias("cy")).agg(F.sum("n").alias("n"))


def vectorscope_peaks(cells: DataFrame, size: int, n: int = 5, share: float = 0.0) -> DataFrame:
    """The ``n`` densest cells per frame with at least ``share`` of the samples; ties by cell index."""
    total = cells.groupBy("frame_id").agg(F.sum("n").alias("_all"))
    part = F.col("n") / F.col("_all")
    kept = cells.join(total, "frame_id").filter(part >= share).withColumn("_k", F.struct((-F.col("n")).alias("n"), (F.col("cy") * size + F.col("cx")).alias("i")))
    # first the best of each slice, then of the frame: the window never sees a whole hot frame
    slices = W.partitionBy("frame_id", F.pmod(F.col("cx"), F.lit(16))).orderBy("_k")
    best = kept.withColumn("_r", F.row_number().over(slices)).filter(F.col("_r") <= n).drop("_r")
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("frame_id").orderBy("_k"))).filter(F.col("rank") <= n)
    m = size - 1
    cb, cr = (F.col("cx") / m - 0.5) * 2 * EXTENT, (0.5 - F.col("cy") / m) * 2 * EXTENT
    return ranked.select("frame_id", "rank", "cx", "cy", F.round(cb * 100, 2).alias("cb"), F.round(cr * 100, 2).alias("cr"), F.round(F.sqrt(cb * cb + cr * cr) / 0.5 * 100, 2).alias("magnitude"), F.round(part, 4).alias("share"))


def image_diff(a: DataFrame, b: DataFrame, min_psnr: float = 45.0, max_abs: int = 12, p99: int = 2) -> DataFrame:
    """8-bit comparison per frame: max, mean, PSNR, p99 of the per-pixel maximum, differing pixels, verdict."""
    byte = lambda c: _round(cl.clamp(c) * 255)
    side = lambda df, n: df.select("frame_id", "x", "y", F.lit(n).alias("_s"), *[byte(c).alias(c) for c in "rgba"])
    # both sides are stacked and meet by grouping: a join would trust estimates that miss how far rows were exploded
    of = lambda n, c: F.max(F.when(F.col("_s") == n, F.col(c))).alias(f"{n}{c}")
    j = side(a, "p").unionByName(side(b, "q")).groupBy("frame_id", "x", "y").agg(*[of(n, c) for n in "pq" for c in "rgba"], F.min("_s").alias("_lo"), F.max("_s").alias("_hi")).filter("_lo < _hi")
    d = [F.abs(F.col(f"p{c}") - F.col(f"q{c}")) for c in "rgba"]
    j = j.select("frame_id", F.greatest(*d).alias("m"), sum(d).alias("s"), sum(x * x for x in d).alias("q"))
    # at most 256 rows per frame from here on
    h = j.groupBy("frame_id", "m").agg(F.count("*").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    w = W.partitionBy("frame_id").orderBy("m")
    h = h.withColumns({"cum": F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)), "all": F.sum("n").over(W.partitionBy("frame_id"))})
    g = h.groupBy("frame_id").agg(
        F.max("m").alias("max_abs"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.max("all").alias("n"), F.sum(F.when(F.col("m") > 0, F.col("n")).otherwise(0)).alias("differing"),
        F.min(F.when(F.col("cum") * 100 >= F.col("all") * 99, F.col("m"))).alias("p99"),
    )
    psnr = F.when(F.col("q") == 0, float("inf")).otherwise(10 * F.log10(255.0 * 255.0 / (F.col("q") / (F.col("n") * 4))))
    ok = (psnr >= min_psnr) & (F.col("max_abs") <= max_abs) & (F.col("p99") <= p99)
    return g.select("frame_id", "max_abs", (F.col("s") / (F.col("n") * 4)).alias("mean_abs"), psnr.alias("psnr"), "p99", "differing", ok.alias("ok"))


def tonal_stats(pixels: DataFrame, skin_protect: bool = True) -> DataFrame:
    """Oklab means per tonal band (s, m, h), mean chroma and skin colour per frame; linear premultiplied input."""
    p = pixels.filter("a > 0.001")
    L, A, B = cl.oklab(*[F.col(c) / F.col("a") for c in "rgb"])
    p = p.select("frame_id", L.alias("l"), A.alias("la"), B.alias("lb"))
    # fixed values: edges of the tonal bands, hue range, chroma and lightness of skin
    smooth = lambda e0, e1: (lambda t: t * t * (3 - 2 * t))(cl.clamp((F.col("l") - e0) / (e1 - e0)))
    s, h = smooth(0.55, 0.15), smooth(0.45, 0.85)
    c = F.sqrt(F.col("la") * F.col("la") + F.col("lb") * F.col("lb"))
    hue = F.degrees(F.atan2("lb", "la"))
    off = F.when(hue < 20, 20 - hue).when(hue > 75, hue - 75).otherwise(0.0)
    skin = F.when(c.between(0.02, 0.2) & F.col("l").between(0.25, 0.92), cl.clamp(1 - off / 10)).otherwise(0.0)
    p = p.withColumns({"ws": s, "wh": h, "c": c, "sk": skin})
    p = p.withColumns({"wm": F.greatest(1 - F.col("ws") - F.col("wh"), F.lit(0.0)), "cw": 1 - 0.8 * F.col("sk") if skin_protect else F.lit(1.0)})
    safe = lambda x: F.greatest(x, F.lit(1e-9))
    aggs = []
    for b in "smh":
        w, wc = F.col(f"w{b}"), F.col(f"w{b}") * F.col("cw")
        aggs += [
            F.sum(w).alias(f"{b}_w"), (F.sum(w * F.col("l")) / safe(F.sum(w))).alias(f"{b}_l"),
            (F.sum(wc * F.col("la")) / safe(F.sum(wc))).alias(f"{b}_a"), (F.sum(wc * F.col("lb")) / safe(F.sum(wc))).alias(f"{b}_b"),
        ]
    aggs += [(F.sum(F.col("cw") * F.col("c")) / safe(F.sum("cw"))).alias("chroma"), (F.sum(F.col("sk") * F.col("la")) / safe(F.sum("sk"))).alias("skin_a"), (F.sum(F.col("sk") * F.col("lb")) / safe(F.sum("sk"))).alias("skin_b"), F.sum("sk").alias("skin_w")]
    size = pixels.groupBy("frame_id").agg(F.count("*").alias("_n"))
    out = p.groupBy("frame_id").agg(*aggs).join(size, "frame_id")
    return out.withColumns({c: F.col(c) / F.col("_n") for c in ("s_w", "m_w", "h_w", "skin_w")}).drop("_n")


def tonal_distance(cur: DataFrame, ref: DataFrame) -> DataFrame:
    """Root of the squared residuals between two frames' statistics; ``ref`` has ``ref_id`` and the current ``frame_id``."""
    r = ref.select("frame_id", "ref_id", *[F.col(c).alias(f"r_{c}") for c in ref.columns if c not in ("frame_id", "ref_id")])
    j = cur.join(r, "frame_id")
    sq = lambda x: x * x
    terms = []
    for b in "smh":
        w = cl.clamp(F.least(F.col(f"{b}_w"), F.col(f"r_{b}_w")) * 3)
        terms += [sq(F.col(f"{b}_l") - F.col(f"r_{b}_l")) * w, sq((F.col(f"{b}_a") - F.col(f"r_{b}_a")) * 2) * w, sq((F.col(f"{b}_b") - F.col(f"r_{b}_b")) * 2) * w]
    terms.append(sq((F.col("chroma") - F.col("r_chroma")) * 2))
    return j.select("frame_id", "ref_id", F.sqrt(sum(terms)).alias("distance"))


# ---- shots ------------------------------------------------------------------------------------

# Cells of the luma grid and bins of a channel's histogram.
GRID_W, GRID_H, BINS = 32, 18, 16


def frame_signatures(pixels: DataFrame, w: int, h: int, stride: tuple[int, int] = (1, 1)) -> DataFrame:
    """32 x 18 luma grid and three 16-bin histograms per frame, over every pixel unless a ``stride`` is asked for."""
    sx, sy = stride
    p = pixels.filter((F.col("x") % sx == 0) & (F.col("y") % sy == 0))
    v8 = {c: _round(cl.clamp(c) * 255) for c in "rgb"}
    luma = 0.2126 * v8["r"] + 0.7152 * v8["g"] + 0.0722 * v8["b"]
    cell = idiv(F.col("y") * GRID_H, F.lit(h)) * GRID_W + idiv(F.col("x") * GRID_W, F.lit(w))
    # one pass: cells are numbered from 0, bins after them
    codes = [cell.cast("int"), *[idiv(v8[c] * BINS, F.lit(256)).cast("int") + GRID_W * GRID_H + k * BINS for k, c in enumerate("rgb")]]
    q = p.select("frame_id", luma.alias("_y"), F.explode(F.array(*codes)).alias("i")).groupBy("frame_id", "i").agg(F.avg("_y").alias("y"), F.count("*").alias("n"))
    v = F.when(F.col("i") < GRID_W * GRID_H, F.col("y") / 255).otherwise(F.col("n").cast("double"))
    n = F.sum(F.when(F.col("i") < GRID_W * GRID_H, F.col("n")))
    j = q.groupBy("frame_id").agg(n.alias("_n"), F.collect_list(F.struct("i", v.alias("v"))).alias("_v"))
    full = F.pandas_udf(_dense(GRID_W * GRID_H + 3 * BINS), T.ArrayType(T.DoubleType()))(F.col("_v")["i"], F.col("_v")["v"])
    j = j.select("frame_id", "_n", full.alias("_v"))
    return j.select("frame_id", F.slice("_v", 1, GRID_W * GRID_H).alias("grid"), F.transform(F.slice("_v", GRID_W * GRID_H + 1, 3 * BINS), lambda v: v / F.col("_n")).alias("hist"))


def _dense(size: int):
    def fill(index: pd.Series, value: pd.Series) -> pd.Series:
        out = []
        for i, v in zip(index, value):
            row = np.zeros(size)
            row[i] = v
            out.append(row)
        return pd.Series(out)

    return fill


def signature_distance(grid_a, hist_a, grid_b, hist_b) -> Column:
    l1 = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return cl.clamp(0.5 * l1(hist_a, hist_b) / 6 + 0.5 * F.least(2 * l1(grid_a, grid_b) / (GRID_W * GRID_H), F.lit(1.0)))


def frame_differences(signatures: DataFrame) -> DataFrame:
    """Difference of every frame ``(clip_id, frame)`` to the one before; null for the first."""
    s = scan(signatures, ["clip_id"], ["frame"], INDEX_CHUNK, _p=prev(F.struct("grid", "hist")))
    return s.select("clip_id", "frame", F.when(F.col("_p").isNotNull(), signature_distance(F.col("grid"), F.col("hist"), F.col("_p.grid"), F.col("_p.hist"))).alias("d"))


def cut_threshold(sensitivity: float) -> float:
    return 0.45 - 0.33 * min(max(sensitivity, 0.0), 100.0) / 100.0


def cuts_from_differences(diffs: DataFrame, sensitivity: float = 50.0, min_shot: int = 6) -> DataFrame:
    """Shot starts: above the threshold and the local median, a local maximum, shots of at least ``min_shot`` (>= 2)."""
    if min_shot < 2:
        raise ValueError("min_shot must be at least 2")
    b = halo(diffs, "frame", INDEX_CHUNK, 5, 5)
    w = W.partitionBy("clip_id", "_c").orderBy("frame")
    around = F.array_sort(F.concat(F.collect_list("d").over(w.rangeBetween(-5, -1)), F.collect_list("d").over(w.rangeBetween(1, 5))))
    b = b.withColumns({"_a": around, "_p": F.lag("d").over(w), "_n": F.lead("d").over(w)}).filter("_own and d is not null")
    med = F.when(F.size("_a") > 0, F.element_at("_a", idiv(F.size("_a"), F.lit(2)).cast("int") + 1)).otherwise(0.0)
    c = b.filter((F.col("d") >= cut_threshold(sensitivity)) & (F.col("d") >= 2.5 * med + 0.05) & (F.coalesce("_n", F.lit(-1.0)) <= F.col("d")) & (F.coalesce("_p", F.lit(-1.0)) <= F.col("d")) & (F.col("frame") >= min_shot))
    c = c.select("clip_id", F.col("frame"))
    none = F.lit(None).cast("long")
    probe = c.select("clip_id", (F.col("frame") + min_shot).alias("p"), F.lit(0).alias("o"), F.col("frame").alias("me"), none.alias("at"))
    stops = c.select("clip_id", F.col("frame").alias("p"), F.lit(1).alias("o"), none.alias("me"), F.col("frame").alias("at"))
    nx = scan(probe.unionByName(stops), ["clip_id"], ["p", "o"], 65_536, nxt=first_from("at")).filter("o = 0").select("clip_id", F.col("me").alias("frame"), "nxt")
    return orbit(nx, ["clip_id"], "frame", "nxt", chunk=65_536)


def scene_cuts(signatures: DataFrame, sensitivity: float = 50.0, min_shot: int = 6) -> DataFrame:
    return cuts_from_differences(frame_differences(signatures), sensitivity, min_shot)


def shots(cuts: DataFrame, clips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shot table and marker rows; ``clips(clip_id, frames, media_start, ft)``."""
    marks = cuts.select("clip_id", "frame").union(clips.select("clip_id", F.lit(0).cast("long")))
    s = scan(marks, ["clip_id"], ["frame"], 65_536, nx=following("frame")).join(clips, "clip_id")
    end = F.coalesce("nx", "frames")
    s = s.filter(end > F.col("frame"))
    at = lambda f: F.col("media_start") + f * F.col("ft")
    table = s.select("clip_id", F.col("frame").alias("first"), (end - F.col("frame")).alias("frames"), at(F.col("frame")).alias("start"), at(end).alias("end"))
    return table, s.filter("frame > 0").select("clip_id", at(F.col("frame")).alias("t"), F.lit("Scene").alias("name"))


# ---- colour -----------------------------------------------------------------------------------

#: Most colours (codes of an item) that are sent to all tasks; 72 bytes each.
COLOURS = 1 << 18


def normalise_footage(pixels: DataFrame, media_color: DataFrame, dst_peak: float = 203.0) -> DataFrame:
    """Mixed code values ``(y, cb, cr)`` per item brought to display RGB.

    ``media_color(item_id, bits, full_range, matrix, curve, gamut, peak_nits)``: curve is srgb,
    linear, pq, hlg, slog3, vlog or logc3. Everything is a column expression over an equi join.
    A colour costs some twenty powers: where about ``COLOURS`` or fewer occur, each is worked out once and looked up by
    the pixels, otherwise every pixel is worked out.
    """
    code = ["item_id", "py", "pcb", "pcr"]
    if pixels.agg(F.approx_count_distinct(F.xxhash64(*code))).first()[0] > COLOURS:
        return _displayed(pixels, media_color, dst_peak).select("item_id", "frame_id", "x", "y", "r", "g", "b")
    seen = _displayed(pixels.select(code).distinct(), media_color, dst_peak).withColumnsRenamed({c: f"_{c}" for c in code})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in code])
    return pixels.select(*code, "frame_id", "x", "y").join(F.broadcast(seen), same).select("item_id", "frame_id", "x", "y", "r", "g", "b")


def _displayed(pixels: DataFrame, media_color: DataFrame, dst_peak: float) -> DataFrame:
    """``pixels`` with display ``r``, ``g`` and ``b``."""
    p = pixels.join(media_color, "item_id")
    scale = F.pow(F.lit(2.0), F.col("bits") - 8)
    top = F.pow(F.lit(2.0), F.col("bits")) - 1
    y = F.when(F.col("full_range"), F.col("py") / top).otherwise((F.col("py") - 16 * scale) / (219 * scale))
    c = lambda n: F.when(F.col("full_range"), (F.col(n) - F.pow(F.lit(2.0), F.col("bits") - 1)) / top).otherwise((F.col(n) - 128 * scale) / (224 * scale))
    pick = lambda key, table: reduce(lambda acc, kv: F.when(F.col(key) == kv[0], kv[1]).otherwise(acc), table.items(), F.lit(None))
    pack = lambda t: F.struct(t[0].alias("r"), t[1].alias("g"), t[2].alias("b"))
    p = p.withColumns({"_y": y, "_cb": c("pcb"), "_cr": c("pcr")})
    p = p.withColumn("_v", pick("matrix", {m: pack(cl.rgb_from_ycbcr(F.col("_y"), F.col("_cb"), F.col("_cr"), m)) for m in cl.MATRICES}))
    sdr = lambda v: cl.srgb_decode(cl.clamp(v))
    code = lambda v: F.when(F.col("full_range"), v).otherwise((64 + 876 * v) / 1023)
    curves = {"srgb": sdr, "linear": lambda v: v, "pq": lambda v: cl.pq_decode(cl.clamp(v)) * (10_000 / cl.WHITE_NITS), "hlg": lambda v: cl.hlg_decode(cl.clamp(v))}
    curves |= {n: (lambda v, f=f: f(code(v))) for n, (f, _) in cl.LOGS.items()}
    p = p.withColumn("_l", pick("curve", {n: pack([f(F.col(f"_v.{k}")) for k in "rgb"]) for n, f in curves.items()}))
    lum = cl.to_xyz("bt2020")[1]
    yd = F.greatest(sum(float(lum[i]) * F.col(f"_l.{k}") for i, k in enumerate("rgb")), F.lit(0.0))
    ootf = F.when(F.col("curve") == "hlg", F.pow(yd, F.lit(0.2)) * (1000 / cl.WHITE_NITS)).otherwise(1.0)
    p = p.withColumn("_o", ootf)
    p = p.withColumn("_m", pick("gamut", {g: pack(cl.apply_matrix(cl.gamut_matrix(g, "bt709"), [F.col(f"_l.{k}") * F.col("_o") for k in "rgb"])) for g in cl.GAMUTS}))
    m = F.greatest("_m.r", "_m.g", "_m.b")
    p = p.withColumn("_k", F.when(m > 0, cl.tone_ratio(m * cl.WHITE_NITS, F.col("peak_nits"), dst_peak)).otherwise(1.0))
    out = {k: cl.srgb_encode(cl.clamp(F.col(f"_m.{k}") * F.col("_k"))) for k in "rgb"}
    return p.select(*pixels.columns, *[v.alias(k) for k, v in out.items()])


#: Most points of a lattice that is sent to all tasks as one array (24 bytes each).
LATTICE_SENT = 129**3


def lattice_array(lattice: DataFrame, size: int) -> np.ndarray:
    """``lattice(ri, gi, bi, lr, lg, lb)`` as one array indexed by (ri, gi, bi); missing points are zero."""
    got = np.zeros((size**3, 3))
    rows = lattice.where(F.greatest("ri", "gi", "bi") < size).select(((F.col("ri") * size + F.col("gi")) * size + F.col("bi")).cast("int").alias("k"), "lr", "lg", "lb").toPandas()
    got[rows["k"].to_numpy()] = rows[["lr", "lg", "lb"]].to_numpy()
    return got.reshape(size, size, size, 3)


def tetrahedral(rgb: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Colours (n, 3) through a lattice: from the darkest to the brightest corner of a cell along the descending fractions."""
    size = len(table)
    pos = np.clip(rgb, 0.0, 1.0) * (size - 1)
    cell = np.minimum(np.floor(pos), size - 2).astype(np.int64)
    part = pos - cell
    # r before g before b on ties
    order = np.argsort(-part, axis=1, kind="stable")
    f = np.take_along_axis(part, order, axis=1)
    weights = [1 - f[:, 0], f[:, 0] - f[:, 1], f[:, 1] - f[:, 2], f[:, 2]]
    out, corner, rows = np.zeros_like(pos), cell.copy(), np.arange(len(pos))
    for n in range(4):
        if n:
            corner[rows, order[:, n - 1]] += 1
        out += weights[n][:, None] * table[corner[:, 0], corner[:, 1], corner[:, 2]]
    return out


def apply_lut3d(pixels: DataFrame, lattice: DataFrame, size: int) -> DataFrame:
    """Tetrahedral 3-D LUT; ``lattice(ri, gi, bi, lr, lg, lb)`` has ``size``³ rows.

    The lattice is one array in every task and is read by index, pixel by pixel where they lie: nothing is shuffled or
    joined, whatever colours occur. Lattices above ``LATTICE_SENT`` points take ``apply_large_lut3d``. Pixels with a
    null channel come out null.
    """
    if size**3 > LATTICE_SENT:
        return apply_large_lut3d(pixels, lattice, size)
    table = pixels.sparkSession.sparkContext.broadcast(lattice_array(lattice, size))
    schema = T.StructType([*[pixels.schema[c] for c in ("frame_id", "x", "y")], *[T.StructField(c, T.DoubleType()) for c in "rgb"], pixels.schema["a"]])

    def look_up(batches):
        for b in batches:
            rgb = np.stack([b.column(f"c{c}").to_numpy(zero_copy_only=False).astype(float) for c in "rgb"], axis=1)
            null = np.isnan(rgb).any(axis=1)
            out = tetrahedral(np.where(null[:, None], 0.0, rgb), table.value)
            done = [pa.array(out[:, i], mask=null) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *done, b.column(6)], ["frame_id", "x", "y", "r", "g", "b", "a"])

    return pixels.select("frame_id", "x", "y", *[F.col(c).cast("double").alias(f"c{c}") for c in "rgb"], "a").mapInArrow(look_up, schema)


def apply_large_lut3d(pixels: DataFrame, lattice: DataFrame, size: int) -> DataFrame:
    """The same for lattices too large to send: distinct colours meet their cell's four corners by an equi join."""
    colours = pixels.select("r", "g", "b").distinct()
    pos = {c: cl.clamp(c) * (size - 1) for c in "rgb"}
    cell = {c: F.least(F.floor(v), F.lit(size - 2)).cast("int") for c, v in pos.items()}
    q = colours.withColumns({f"{c}0": v for c, v in cell.items()}).withColumns({f"f{c}": pos[c] - F.col(f"{c}0") for c in "rgb"})
    # corners from the darkest to the brightest along the descending fractions (r before g before b on ties)
    order = F.array_sort(F.array(*[F.struct((-F.col(f"f{c}")).alias("k"), F.lit(i).alias("i")) for i, c in enumerate("rgb")]))
    q = q.withColumn("_o", order)
    f = [-F.col("_o")[i]["k"] for i in range(3)]
    step = lambda n, i: sum(F.when(F.col("_o")[j]["i"] == i, 1).otherwise(0) for j in range(n)) if n else F.lit(0)
    weights = [1 - f[0], f[0] - f[1], f[1] - f[2], f[2]]
    corners = F.array(*[F.struct((F.col("r0") + step(n, 0)).alias("ri"), (F.col("g0") + step(n, 1)).alias("gi"), (F.col("b0") + step(n, 2)).alias("bi"), weights[n].alias("w")) for n in range(4)])
    e = q.select("r", "g", "b", F.explode(corners).alias("c")).select("r", "g", "b", "c.*").join(lattice, ["ri", "gi", "bi"])
    done = e.groupBy("r", "g", "b").agg(*[F.sum(F.col("w") * F.col(f"l{c}")).alias(f"o{c}") for c in "rgb"])
    return pixels.join(done, ["r", "g", "b"]).select("frame_id", "x", "y", F.col("or").alias("r"), F.col("og").alias("g"), F.col("ob").alias("b"), "a")


def _separable(mode: str, b: Column, s: Column) -> Column:
    one, zero = F.lit(1.0), F.lit(0.0)
    screen = lambda b, s: b + s - b * s
    burn = lambda b, s: F.when(b >= 1, one).when(s <= 0, zero).otherwise(1 - F.least((1 - b) / s, one))
    dodge = lambda b, s: F.when(b <= 0, zero).when(s >= 1, one).otherwise(F.least(b / (1 - s), one))
    hard = lambda b, s: F.when(s <= 0.5, b * 2 * s).otherwise(screen(b, 2 * s - 1))
    vivid = lambda b, s: F.when(s <= 0.5, burn(b, 2 * s)).otherwise(dodge(b, 2 * s - 1))
    if mode == "softLight":
        d = F.when(b <= 0.25, ((16 * b - 12) * b + 4) * b).otherwise(F.sqrt(b))
        return F.when(s <= 0.5, b - (1 - 2 * s) * b * (1 - b)).otherwise(b + (2 * s - 1) * (d - b))
    return {
        "darken": lambda: F.least(b, s), "multiply": lambda: b * s, "colorBurn": lambda: burn(b, s), "linearBurn": lambda: F.greatest(b + s - 1, zero),
        "lighten": lambda: F.greatest(b, s), "screen": lambda: screen(b, s), "colorDodge": lambda: dodge(b, s), "linearDodge": lambda: F.least(b + s, one),
        "overlay": lambda: hard(s, b), "hardLight": lambda: hard(b, s), "vividLight": lambda: vivid(b, s), "linearLight": lambda: cl.clamp(b + 2 * s - 1),
        "pinLight": lambda: F.when(s <= 0.5, F.least(b, 2 * s)).otherwise(F.greatest(b, 2 * s - 1)), "hardMix": lambda: F.when(vivid(b, s) >= 0.5, one).otherwise(zero),
        "difference": lambda: F.abs(b - s), "exclusion": lambda: b + s - 2 * b * s, "subtract": lambda: F.greatest(b - s, zero), "divide": lambda: F.when(s <= 0, one).otherwise(F.least(b / s, one)),
    }[mode]()


# Names of the blend modes that work channel by channel, as published; luma weights 0.3, 0.59, 0.11 below.
SEPARABLE = [
    "darken", "multiply", "colorBurn", "linearBurn", "lighten", "screen", "colorDodge", "linearDodge", "overlay", "softLight", "hardLight",
    "vividLight", "linearLight", "pinLight", "hardMix", "difference", "exclusion", "subtract", "divide",
]


def _lum(c):
    return 0.3 * c[0] + 0.59 * c[1] + 0.11 * c[2]


def _with_lum(c, l):
    d = l - _lum(c)
    c = [x + d for x in c]
    n, x, l2 = F.least(*c), F.greatest(*c), _lum(c)
    low = [F.when(n < 0, l2 + (v - l2) * l2 / F.greatest(l2 - n, F.lit(1e-6))).otherwise(v) for v in c]
    return [F.when(x > 1, l2 + (v - l2) * (1 - l2) / F.greatest(x - l2, F.lit(1e-6))).otherwise(v) for v in low]


def _sat(c):
    return F.greatest(*c) - F.least(*c)


def _with_sat(c, s):
    mx, mn = F.greatest(*c), F.least(*c)
    return [F.when(mx - mn <= 1e-6, F.lit(0.0)).otherwise((v - mn) * s / (mx - mn)) for v in c]


def _blend(mode: str, b: list[Column], s: list[Column]) -> list[Column]:
    if mode in SEPARABLE:
        return [_separable(mode, x, y) for x, y in zip(b, s)]
    if mode in ("darkerColor", "lighterColor"):
        own = _lum(s) < _lum(b) if mode == "darkerColor" else _lum(s) > _lum(b)
        return [F.when(own, y).otherwise(x) for x, y in zip(b, s)]
    return {"hue": lambda: _with_lum(_with_sat(s, _sat(b)), _lum(b)), "saturation": lambda: _with_lum(_with_sat(b, _sat(s)), _lum(b)), "color": lambda: _with_lum(s, _lum(b)), "luminosity": lambda: _with_lum(b, _lum(s))}[mode]()


MODES = (*SEPARABLE, "darkerColor", "lighterColor", "hue", "saturation", "color", "luminosity")


def _once(value: Column, fn) -> Column:
    """``fn(value)`` with the value worked out once, however often it occurs."""
    return F.transform(F.array(value), fn)[0]


def composite_layers(layers: DataFrame, modes: list[str] | None = None) -> DataFrame:
    """Premultiplied linear layers ``(frame_id, x, y, z, r, g, b, a, opacity, mode)`` over one another.

    The modes that occur are looked up (at most as many as there are) unless ``modes`` lists those
    besides normal, so that only their expressions are compiled. An unknown mode is an error. One shuffle gathers the layers of
    a pixel; an opaque normal layer hides what is below it in the fold.
    """
    if modes is None:
        modes = [r[0] for r in layers.select("mode").distinct().limit(len(MODES) + 2).collect() if r[0] != "normal"]
    if odd := [m for m in modes if m not in MODES]:
        raise ValueError(f"unknown blend modes: {odd}")
    names = sorted(modes)
    known = F.col("mode").isin("normal", *names)
    p = layers.filter("a > 0 and opacity > 0").withColumn("mode", F.when(known, F.col("mode")).otherwise(F.raise_error(F.concat(F.lit("unknown blend mode: "), F.coalesce("mode", F.lit("null"))))))
    stack = F.array_sort(F.collect_list(F.struct("z", *[(F.col(c) * F.col("opacity")).alias(c) for c in "rgba"], "mode")))

    def over(d, s):
        bare = lambda q: F.struct(*[cl.clamp(F.when(q["a"] > 0, q[c] / q["a"]).otherwise(F.lit(0.0))).alias(c) for c in "rgb"])
        enc = lambda q: _once(bare(q), lambda v: F.struct(*[cl.srgb_encode(v[c]).alias(c) for c in "rgb"]))
        alpha = (s["a"] + d["a"] * (1 - s["a"])).alias("a")
        plain = F.struct(*[(s[c] + d[c] * (1 - s["a"])).alias(c) for c in "rgb"], alpha)

        def blended(m):
            def mix(both):
                b, t = ([both[q][c] for c in "rgb"] for q in ("b", "t"))
                seen = F.struct(*[cl.clamp(v).alias(c) for v, c in zip(_blend(m, b, t), "rgb")])
                return _once(seen, lambda v: F.struct(*[((1 - d["a"]) * s[c] + d["a"] * s["a"] * cl.srgb_decode(v[c]) + (1 - s["a"]) * d[c]).alias(c) for c in "rgb"], alpha))

            return _once(F.struct(enc(d).alias("b"), enc(s).alias("t")), mix)

        # one choice a layer, and its values are bound: written out they would be worked out again wherever they occur
        mixed = plain
        for m in names:
            mixed = F.when(s["mode"] == m, blended(m)).otherwise(mixed)
        return mixed

    zero = F.struct(*[F.lit(0.0).alias(c) for c in "rgba"])
    g = p.groupBy("frame_id", "x", "y").agg(stack.alias("_s"))
    return g.select("frame_id", "x", "y", F.aggregate("_s", zero, over).alias("p")).select("frame_id", "x", "y", "p.*")
