"""Colour formulas as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

from tickloom.functions.timebase import col, lit

# Luma weights (red, blue) per matrix and chromaticities per gamut (R, G, B; white D65).
MATRICES = {"601": (0.299, 0.114), "709": (0.2126, 0.0722), "2020": (0.2627, 0.0593)}
D65 = (0.3127, 0.3290)
GAMUTS = {
    "bt709": ((0.64, 0.33), (0.30, 0.60), (0.15, 0.06)),
    "bt2020": ((0.708, 0.292), (0.170, 0.797), (0.131, 0.046)),
    "p3d65": ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060)),
    "sgamut3cine": ((0.766, 0.275), (0.225, 0.800), (0.089, -0.087)),
    "vgamut": ((0.730, 0.280), (0.165, 0.840), (0.100, -0.030)),
}
WHITE_NITS = 203.0


def ycbcr(r, g, b, matrix: str = "709") -> tuple[Column, Column, Column]:
    kr, kb = MATRICES[matrix]
    r, g, b = map(col, (r, g, b))
    y = kr * r + (1 - kr - kb) * g + kb * b
    return y, (b - y) / (2 * (1 - kb)), (r - y) / (2 * (1 - kr))


def rgb_from_ycbcr(y: Column, cb: Column, cr: Column, matrix: str) -> tuple[Column, Column, Column]:
    kr, kb = MATRICES[matrix]
    r, b = y + 2 * (1 - kr) * cr, y + 2 * (1 - kb) * cb
    return r, (y - kr * r - kb * b) / (1 - kr - kb), b


def clamp(c, lo=0.0, hi=1.0) -> Column:
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))


def srgb_decode(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def srgb_encode(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


# ST 2084 constants m1, m2, c1, c2, c3.
PQ = (2610 / 16384, 2523 / 32, 3424 / 4096, 2413 / 128, 2392 / 128)


def pq_decode(e: Column) -> Column:
    m1, m2, c1, c2, c3 = PQ
    p = F.pow(F.greatest(e, F.lit(0.0)), F.lit(1 / m2))
    return F.pow(F.greatest(p - c1, F.lit(0.0)) / (c2 - c3 * p), F.lit(1 / m1))


def pq_encode(v: Column) -> Column:
    m1, m2, c1, c2, c3 = PQ
    p = F.pow(F.greatest(v, F.lit(0.0)), F.lit(m1))
    return F.pow((c1 + c2 * p) / (1 + c3 * p), F.lit(m2))


def hlg_decode(v: Column) -> Column:
    a, b, c = 0.17883277, 0.28466892, 0.55991073
    return F.when(v <= 0.5, v * v / 3).otherwise((F.exp((v - c) / a) + b) / 12)


def slog3_decode(y: Column) -> Column:
    return F.when(y >= 171.2102946929 / 1023, F.pow(F.lit(10.0), (y * 1023 - 420) / 261.5) * 0.19 - 0.01).otherwise((y * 1023 - 95) * 0.01125 / (171.2102946929 - 95))


def vlog_decode(y: Column) -> Column:
    return F.when(y < 0.181, (y - 0.125) / 5.6).otherwise(F.pow(F.lit(10.0), (y - 0.598206) / 0.241514) - 0.00873)


def logc3_decode(y: Column) -> Column:
    a, b, c, d, e, f, cut = 5.555556, 0.052272, 0.247190, 0.385537, 5.367655, 0.092809, 0.010591
    return F.when(y > e * cut + f, (F.pow(F.lit(10.0), (y - d) / c) - b) / a).otherwise((y - f) / e)


LOGS = {"slog3": (slog3_decode, "sgamut3cine"), "vlog": (vlog_decode, "vgamut"), "logc3": (logc3_decode, "bt709")}


def to_xyz(gamut: str) -> np.ndarray:
    cols = np.array([[x / y, 1.0, (1 - x - y) / y] for x, y in GAMUTS[gamut]]).T
    white = np.array([D65[0] / D65[1], 1.0, (1 - D65[0] - D65[1]) / D65[1]])
    return cols * np.linalg.solve(cols, white)


def gamut_matrix(src: str, dst: str) -> np.ndarray:
    return np.eye(3) if src == dst else np.linalg.solve(to_xyz(dst), to_xyz(src))


def apply_matrix(m: np.ndarray, rgb) -> tuple[Column, Column, Column]:
    return tuple(sum(float(m[i][j]) * rgb[j] for j in range(3)) for i in range(3))


def tone_ratio(nits: Column, src_peak: Column, dst_peak: float) -> Column:
    """BT.2390 curve as a ratio to its input."""
    pq = lambda n: pq_encode(clamp(n / 10_000))
    top = pq(src_peak)
    e1 = F.least(pq(nits) / top, F.lit(1.0))
    m = pq(F.lit(dst_peak)) / top
    ks = 1.5 * m - 0.5
    t = (e1 - ks) / (1 - ks)
    knee = (2 * t * t * t - 3 * t * t + 1) * ks + (t * t * t - 2 * t * t + t) * (1 - ks) + (-2 * t * t * t + 3 * t * t) * m
    out = pq_decode(F.when(e1 < ks, e1).otherwise(knee) * top) * 10_000
    return F.when((src_peak > dst_peak) & (nits > 1e-6), out / nits).otherwise(1.0)


def hsl(r, g, b) -> tuple[Column, Column, Column]:
    r, g, b = map(col, (r, g, b))
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d, l = hi - lo, (hi + lo) / 2
    flat = d < 1e-7
    s = F.when(flat, 0.0).when(l > 0.5, d / (2 - hi - lo)).otherwise(d / (hi + lo))
    h = F.when(hi == r, (g - b) / d + F.when(g < b, 6.0).otherwise(0.0)).when(hi == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    return F.when(flat, 0.0).otherwise(h / 6), s, l


def oklab(r, g, b) -> tuple[Column, Column, Column]:
    """Linear RGB to Oklab."""
    r, g, b = (F.greatest(col(c), F.lit(0.0)) for c in (r, g, b))
    # The published Oklab matrices.
    l = F.cbrt(0.41222147 * r + 0.53633255 * g + 0.051445995 * b)
    m = F.cbrt(0.2119035 * r + 0.6806995 * g + 0.10739696 * b)
    s = F.cbrt(0.08830246 * r + 0.28171885 * g + 0.6299787 * b)
    return 0.21045426 * l + 0.7936178 * m - 0.004072047 * s, 1.9779985 * l - 2.4285922 * m + 0.4505937 * s, 0.025904037 * l + 0.78277177 * m - 0.80867577 * s
