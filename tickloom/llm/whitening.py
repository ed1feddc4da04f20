"""Whitening of embeddings: exact covariances from sums of squares of dimensions and of pair sums (polarisation)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An entry c becomes floor(SCALE * c) + SHIFT; beyond LARGEST it counts as LARGEST.
SCALE, SHIFT, LARGEST = 1024, 100_000, 2.0**42
#: Digits of an exact sum on its way through a shuffle.
LIMB = 32
HALF = 23


def integers(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x) of the rows whose vector is whole: not null, and no entry null, NaN or infinite."""
    v = F.col(f"`{vec_col}`")
    whole = v.isNotNull() & F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    held = lambda c: F.greatest(F.least(c.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))
    return df.where(whole).select(F.col(f"`{id_col}`").alias("id"), F.transform(v, lambda c: F.floor(held(c) * SCALE).cast("long") + SHIFT).alias("x"))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def _digits(total: int) -> list[int]:
    """``total`` in base 2**LIMB, lowest first; only the last digit can be negative."""
    out = []
    while not -(1 << 62) < total < 1 << 62:
        out.append(total & ((1 << LIMB) - 1))
        total >>= LIMB
    return [*out, total]


def _exact_sums(df: DataFrame, d: int, part) -> dict[int, int]:
    """Exact totals of what ``part`` (matrix -> {key: int}) gives for the rows of each task; keys are of a fixed number."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, int] = {}
        for b in batches:
            for at in range(0, len(b), 1 << 14):
                for k, v in part(_matrix(b.slice(at, 1 << 14), d)).items():
                    totals[k] = totals.get(k, 0) + v
        rows = [(k, i, x) for k, v in totals.items() for i, x in enumerate(_digits(v))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64()))], ["k", "digit", "part"])

    sums = df.select("x").mapInArrow(fold, "k int, digit int, part long").groupBy("k", "digit").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s"))
    out: dict[int, int] = {}
    for k, digit, s in sums.collect():
        out[k] = out.get(k, 0) + (int(s) << (LIMB * digit))
    return out


def _column_sums(x: np.ndarray) -> dict[int, int]:
    high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
    return {k: (int(h) << 32) + int(v) for k, (h, v) in enumerate(zip(high, low, strict=True))}


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: 64-bit numbers where they are wide enough, else Python's."""
    if n * max(int(np.abs(x).max(initial=0)), max(map(abs, sums), default=0) // n + 1) < 1 << 61:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _squares(v: np.ndarray) -> list[int]:
    """Exact sums of squares of the columns, at most 2**14 rows."""
    if v.dtype != object and (not v.size or max(int(v.max()), -int(v.min())) < 1 << (2 * HALF)):
        high, low = v >> HALF, v & ((1 << HALF) - 1)
        hh, hl, ll = (np.einsum("ij,ij->j", a, b).tolist() for a, b in ((high, high), (high, low), (low, low)))
        return [(a << (2 * HALF)) + (b << (HALF + 1)) + c for a, b, c in zip(hh, hl, ll, strict=True)]
    v = v.astype(object)
    return list((v * v).sum(0))


@dataclass(frozen=True)
class Whitener:
    """n vectors of ``d`` entries with column ``sums``; ``components`` (rows, unit length) by falling ``values``; ``trace`` of the covariance."""

    n: int
    d: int
    sums: list[int]
    covariance: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float

    def whiten(self, z: np.ndarray) -> np.ndarray:
        """Centred rows (n times) -> their projections over the root of the component's variance; NaN where it has none."""
        with np.errstate(divide="ignore", invalid="ignore"):
            flat = np.where(self.values > 0, np.sqrt(self.values), np.nan)
            return (z / self.n).astype(float) @ self.components.T / flat


def covariance(squares: dict[int, int], n: int, d: int) -> np.ndarray:
    """Cov(a, b) = (Var(a + b) - Var(a) - Var(b)) / 2 of integers, rounded once."""
    v = np.empty((d, d))
    for a in range(d):
        v[a, a] = squares[a * d + a] / n**3
        for b in range(a + 1, d):
            v[a, b] = v[b, a] = (squares[a * d + b] - squares[a * d + a] - squares[b * d + b]) / (2 * n**3)
    return v


def fit(x: DataFrame, n: int, d: int, most: int) -> Whitener:
    """The whitener of all vectors of ``x`` (id, x): one pass for the column sums, one for the squares of every column and of every sum of two."""
    s = _exact_sums(x, d, _column_sums)
    sums = [s[k] for k in range(d)]

    def part(m: np.ndarray) -> dict[int, int]:
        z, out = centred(m, n, sums), {}
        for a in range(d):
            out[a * d + a] = _squares(z[:, a : a + 1])[0]
            out |= {a * d + a + 1 + i: q for i, q in enumerate(_squares(z[:, a : a + 1] + z[:, a + 1 :]))}
        return out

    v = covariance(_exact_sums(x, d, part), n, d)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u.T[::-1][:most]
    u = u * np.sign(u[np.arange(len(u)), np.abs(u).argmax(1)])[:, None]
    trace = float(np.trace(v))
    # rounding leaves components without variance near zero, on either side of it
    return Whitener(n, d, sums, v, u, np.where(e > d * np.finfo(float).eps * max(float(e.max(initial=0)), 0), e, 0.0), trace)


def identity_error(x: DataFrame, w: Whitener) -> float | None:
    """Largest absolute entry of the whitened rows' covariance less the identity, over the components with variance."""
    has = np.flatnonzero(w.values > 0)
    if not len(has):
        return None

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(has), len(has) + 1))
        for b in batches:
            y = w.whiten(centred(_matrix(b, w.d), w.n, w.sums))[:, has]
            total += y.T @ np.column_stack([y, np.ones(len(y))])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["k", "part"])

    t = np.zeros((len(has), len(has) + 1))
    for k, s in x.select("x").mapInArrow(fold, "k int, part double").groupBy("k").agg(F.sum("part")).collect():
        t.flat[k] = s
    mean = t[:, -1] / w.n
    return float(np.abs(t[:, :-1] / w.n - np.outer(mean, mean) - np.eye(len(has))).max())


SCHEMA = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whitened(df: DataFrame, most: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per whole vector and component 1 to ``most``: (``id_col``, component, n, deviation, whitened, explained, identity_error).

    Entries become integers (``integers``), all sums over the vectors are exact, every covariance is over all of them,
    divisor n. Components are unit eigenvectors of the covariance by falling eigenvalue. ``deviation`` is the sum of
    (n * x - sum)^2 over the dimensions (null beyond 38 digits), ``whitened`` the projection of x - sum / n over the root
    of the eigenvalue, ``explained`` the eigenvalue's share of the trace; both are null where there is no variance.

    Vectors that are null or hold null, NaN or infinite entries are left out, and so are those whose length is not the
    most frequent one (of two, the larger). Null ids and repeated rows stay, other columns are ignored; a table without
    whole vectors gives no row. Only sums of a fixed number reach the driver.
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    x = integers(df, id_col, vec_col)
    lengths = x.groupBy(F.size("x").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], f"`{id_col}` {kind}, {SCHEMA}")
    d, n = lengths
    x = x.where(F.size("x") == d)
    w = fit(x, n, d, min(most, d))
    error, m = identity_error(x, w), len(w.values)
    explained = [float(e) / w.trace if w.trace > 0 else None for e in w.values]
    types = [pa.int32(), pa.int64(), pa.decimal128(38, 0), pa.float64(), pa.float64(), pa.float64()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = centred(_matrix(b, d), n, w.sums)
            k = len(z)
            y = w.whiten(z).ravel()
            if z.dtype != object and d * max(int(z.max(initial=0)), -int(z.min(initial=0))) ** 2 < 1 << 63:
                dev = pa.array((z * z).sum(1)).cast(pa.decimal128(19, 0)).cast(types[2])
            else:
                z = z.astype(object)
                dev = pa.array([str(s) if s < 10**38 else None for s in (z * z).sum(1)], pa.string()).cast(types[2])
            again = np.repeat(np.arange(k), m)
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(again)), pa.array(np.tile(np.arange(1, m + 1), k), types[0]), pa.array(np.full(k * m, n), types[1]), dev.take(pa.array(again)),
                pa.array(y, mask=np.isnan(y)), pa.array(explained * k, types[4]), pa.array([error] * (k * m), types[5]),
            ], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(rows, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)
