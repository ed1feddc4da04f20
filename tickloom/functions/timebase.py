"""Exact tick time as LONG column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Ticks per second and the standard frame rates (numerator, denominator).
TPS = 254_016_000_000
RATES = [
    (24000, 1001), (24, 1), (25, 1), (30000, 1001), (30, 1), (48, 1),
    (50, 1), (60000, 1001), (60, 1), (120000, 1001), (120, 1),
]


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else lit(x)


def idiv(a, b) -> Column:
    """Truncating LONG division."""
    return F.call_function("div", col(a), col(b))


def fdiv(a, b) -> Column:
    """Floor division; truncation is wrong for negative times."""
    a, b = col(a), col(b)
    return idiv(a - F.pmod(a, b), b)


def seconds(s: float) -> int:
    return round(s * TPS)


def frame_ticks(num, den) -> Column:
    """Ticks per frame; a non-positive rate counts as 24000/1001."""
    num, den = col(num), col(den)
    bad = (num <= 0) | (den <= 0)
    n = F.when(bad, F.lit(24000)).otherwise(num).cast("long")
    d = F.when(bad, F.lit(1001)).otherwise(den).cast("long")
    return idiv(F.lit(TPS) * d, n)


def frame_at(t, ft) -> Column:
    """Index of the frame holding ``t`` for an exact frame length ``ft``."""
    return fdiv(t, ft)


def snap(t, ft) -> Column:
    t = col(t)
    return t - F.pmod(t, col(ft))


def snap_up(t, ft) -> Column:
    t = col(t)
    return t + F.pmod(-t, col(ft))


def snap_nearest(t, ft) -> Column:
    """Nearest frame start; the earlier one on a tie."""
    t, ft = col(t), col(ft)
    off = F.pmod(t, ft)
    return F.when(off <= ft - off, t - off).otherwise(t - off + ft)


def frame_at_any(t, num, den) -> Column:
    """Frame index for rates whose frame is no whole number of ticks (128-bit product as DECIMAL)."""
    wide = lambda c: col(c).cast("decimal(19,0)")
    prod = (wide(t) * wide(num)).cast("decimal(38,0)")
    unit = (F.lit(TPS).cast("decimal(19,0)") * wide(den)).cast("decimal(38,0)")
    rem = F.pmod(prod, unit)
    return ((prod - rem) / unit).cast("long")


def round_half_away(x) -> Column:
    """Half away from zero, as LONG."""
    return F.round(col(x).cast("double"), 0).cast("long")


def scaled(d, speed) -> Column:
    """Media ticks covered by ``d`` timeline ticks."""
    return round_half_away(col(d).cast("double") * F.abs(col(speed)))


def source_out(source_in="source_in", duration="duration", speed="speed") -> Column:
    return col(source_in) + scaled(duration, speed)


def moving_source_time(t, start="start", duration="duration", source_in="source_in", speed="speed", reverse="reverse") -> Column:
    fwd = scaled(col(t) - col(start), speed)
    return F.when(col(reverse), col(source_in) + scaled(duration, speed) - fwd - 1).otherwise(col(source_in) + fwd)


def source_time(t, hold="frame_hold", **names) -> Column:
    return F.coalesce(col(hold), moving_source_time(t, **names))


def timecode_base(num, den) -> Column:
    num, den = col(num), col(den)
    return F.greatest(idiv(num + den - 1, den), F.lit(1))


def uses_drop(num, den, drop) -> Column:
    return lit(drop) & (col(den) == 1001) & (timecode_base(num, den) % 30 == 0)


def fields_to_frames(h, m, s, f, base, drop) -> Column:
    """SMPTE fields to a frame count; ``drop`` is a boolean column."""
    h, m, s, f, base = map(col, (h, m, s, f, base))
    minutes = h * 60 + m
    skipped = idiv(base, F.lit(15)) * (minutes - idiv(minutes, F.lit(10)))
    return (h * 3600 + m * 60 + s) * base + f - F.when(lit(drop), skipped).otherwise(0)


def timecode(frame, base, drop) -> Column:
    """Label of a frame count: ``HH:MM:SS:FF``, or with semicolons when drop-frame."""
    frame, base, drop = col(frame), col(base), lit(drop)
    n = F.abs(frame)
    dropped = idiv(base, F.lit(15))
    per_min = base * 60 - dropped
    per_ten = per_min * 10 + dropped
    rest = n % per_ten
    extra = dropped * 9 * idiv(n, per_ten) + F.when(rest > dropped, dropped * idiv(rest - dropped, per_min)).otherwise(0)
    n = n + F.when(drop, extra).otherwise(0)
    sep = F.when(drop, F.lit(";")).otherwise(F.lit(":"))
    pad = lambda c, w=2: F.when(F.length(c.cast("string")) >= w, c.cast("string")).otherwise(F.lpad(c.cast("string"), w, "0"))
    ff = n % base
    return F.concat(
        F.when(frame < 0, "-").otherwise(""),
        pad(idiv(n, base * 3600)), sep, pad(idiv(n, base * 60) % 60), sep, pad(idiv(n, base) % 60), sep,
        F.when(base >= 100, pad(ff, 3)).otherwise(pad(ff)),
    )


def db(power) -> Column:
    """10·log10, null for zero."""
    return F.lit(10.0) * F.log10(power)


def gain(decibel) -> Column:
    return F.pow(F.lit(10.0), col(decibel) / 20.0)
