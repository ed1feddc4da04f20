"""Whitening against exact integers and numpy's own eigenvectors."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import whitening
from tickloom.llm.queries import QUERIES


def brute(vectors, most):
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(d)]
    z = [[n * c - t for c, t in zip(r, s)] for r in x]
    v = np.array([[float(Fraction(sum(r[a] * r[b] for r in z), n**3)) for b in range(d)] for a in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    y = np.array([[float(Fraction(c, n)) for c in r] for r in z]) @ u / np.sqrt(e)
    return n, [sum(c * c for c in r) for r in z], y, e / np.trace(v), v


def compare(rows, vectors, ids, most):
    n, dev, y, share, _ = brute(vectors, most)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == len(got) == n * min(most, len(vectors[0]))
    for k in range(min(most, len(vectors[0]))):
        w = np.array([got[i, k + 1]["whitened"] for i in ids])
        sign = np.sign(w @ y[:, k])
        assert np.allclose(w * sign, y[:, k], rtol=1e-7, atol=1e-9)
        for i, want in zip(ids, dev):
            r = got[i, k + 1]
            assert r["n"] == n and r["deviation"] == want and abs(r["explained"] / share[k] - 1) < 1e-9 and r["identity_error"] < 1e-9


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string, k int, digit int").repartition(3)


def test_against_exact_integers(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(120, 6)) @ rng.normal(size=(6, 6))).astype(np.float32).tolist()
    rows = [(k, v, "clash", 1, 2) for k, v in enumerate(vectors)]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (904, [1.0, 2.0]), (905, [])]
    out = whitening.whitened(frame(spark, rows + [(*b, None, None, None) for b in bad]), most=4)
    assert out.columns[:2] == ["vec_id", "component"]
    compare(out.collect(), vectors, range(120), 4)


def test_values_beyond_64_bits(spark):
    vectors = [[1e9 * k, -3e8 * k * k, 5.0 * (k % 3)] for k in range(1, 9)]
    rows = whitening.whitened(frame(spark, [(k, v, None, None, None) for k, v in enumerate(vectors)]), most=3).collect()
    exact = [np.array(v, np.float32).tolist() for v in vectors]
    n, dev, *_ = brute(exact, 3)
    assert {r["vec_id"]: int(r["deviation"]) for r in rows} == dict(enumerate(dev))


def test_without_variance_and_without_rows(spark):
    rows = whitening.whitened(frame(spark, [(1, [1.0, 2.0], None, None, None), (1, [1.0, 2.0], None, None, None), (None, [1.0, 2.0], None, None, None)])).collect()
    assert len(rows) == 6 and all(r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in rows)
    line = whitening.whitened(frame(spark, [(k, [float(k), 2.0 * k], None, None, None) for k in range(5)])).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line) and line[0]["identity_error"] < 1e-9
    empty = whitening.whitened(frame(spark, [(1, None, None, None, None)]))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@pytest.mark.parametrize("big", [1 << 20, 1 << 50, 1 << 70])
def test_sums_of_squares_are_exact(big):
    v = np.array([[big, -big + 1], [3, -7], [-big, big - 5]], object if big > 1 << 60 else np.int64)
    assert whitening._squares(v) == [sum(int(r[k]) ** 2 for r in v.tolist()) for k in (0, 1)]
    assert sum(x << (32 * i) for i, x in enumerate(whitening._digits(-(big**3)))) == -(big**3)


def test_registered_query_on_the_whole_table(spark):
    d = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()
    rows = QUERIES["op13_polarised_whitening"][0](spark, d)
    assert dict(rows.dtypes)["deviation"] == "bigint"
    compare(rows.collect(), [r["embedding"] for r in table], [r["vec_id"] for r in table], 8)


def test_one_pass_covariance_equals_centred_products(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-1000, 1000, (50, 4))
    n, s = 50, x.sum(0)
    z = n * x - s
    squares = {a * 4 + b: int(((z[:, a] + (z[:, b] if a != b else 0)) ** 2).sum()) for a in range(4) for b in range(a, 4)}
    assert np.allclose(whitening.covariance(squares, n, 4), (z.T @ z) / n**3, rtol=1e-14)
