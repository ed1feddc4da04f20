"""Ordered scans, walks and interval algebra on skewed, empty and random input."""

import random

import pytest
from pyspark.sql import Window as W, functions as F

from tickloom.functions import timebase as tb
from tickloom.operators import edits as ed
from tickloom.operators import intervals as iv
from tickloom.operators import ordered as od


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds most rows; some values are null."""
    rnd = random.Random(1)
    data = [(0 if i % 4 else i % 7, rnd.randrange(5000), i, rnd.choice([None, rnd.randrange(9)])) for i in range(2000)]
    return spark.createDataFrame(data, "k long, t long, i long, v long")


def test_scan_equals_plain_windows(spark, hot):
    w = W.partitionBy("k").orderBy("t", "i")
    up, be, fo, af = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(0, W.unboundedFollowing), w.rowsBetween(1, W.unboundedFollowing)
    got = od.scan(hot, ["k"], ["t", "i"], 100, a=od.prev("v"), b=od.following("v"), c=od.sum_before("v"), d=od.sum_upto("v"), e=od.max_before("v"), f=od.max_upto("v"), g=od.last_upto("v"), h=od.last_before("v"), j=od.first_from("v"), l=od.first_after("v"))
    z = lambda c: F.coalesce(c, F.lit(0))
    want = hot.select("*", F.lag("v").over(w), F.lead("v").over(w), z(F.sum("v").over(be)), z(F.sum("v").over(up)), F.max("v").over(be), F.max("v").over(up), F.last("v", True).over(up), F.last("v", True).over(be), F.first("v", True).over(fo), F.first("v", True).over(af))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


@pytest.mark.parametrize("chunk", [4, 16, 10_000])  # gates by doubling, gates in one task, one chunk
def test_orbit_is_the_walk(spark, chunk):
    rnd = random.Random(2)
    data, want = [], set()
    for k in range(3):
        n = 400
        nxt = {p: (p + rnd.randrange(1, 30) if p + 30 < n else None) for p in range(n)}
        data += [(k, p, q) for p, q in nxt.items()]
        p = 0
        while p is not None:
            want.add((k, p))
            p = nxt[p]
    got = od.orbit(spark.createDataFrame(data, "k long, pos long, nxt long"), ["k"], chunk=chunk)
    assert set(rows(got.select("k", "pos"))) == want


def test_overlap_join_with_very_long_and_short_ranges(spark):
    rnd = random.Random(3)
    mk = lambda n, w: [(1, i, s, s + rnd.randrange(1, w)) for i, s in enumerate(rnd.randrange(3000) for _ in range(n))]
    a, b = mk(80, 60) + [(1, 999, 0, 4000)], mk(80, 700) + [(1, 998, 0, 4000)]
    da, db = spark.createDataFrame(a, "k long, ia long, start long, end long"), spark.createDataFrame(b, "k long, ib long, b_start long, b_end long")
    got = iv.overlap_join(da, db, ["k"], levels=(10, 100, 500)).select("ia", "ib")
    want = sorted((x[1], y[1]) for x in a for y in b if x[2] < y[3] and y[2] < x[3])
    assert rows(got) == want


def test_empty_tables(spark):
    e = spark.createDataFrame([], "k long, start long, end long")
    assert iv.merge_ranges(e, ["k"]).count() == 0
    assert iv.gaps(e, ["k"]).count() == 0
    assert iv.range_except(e, e, ["k"]).count() == 0


def test_set_algebra_against_points(spark):
    rnd = random.Random(4)
    mk = lambda: [(0, s, s + rnd.randrange(1, 20)) for s in (rnd.randrange(300) for _ in range(30))]
    a, b = mk(), mk()
    da, db = (spark.createDataFrame(x, "k long, start long, end long") for x in (a, b))
    pts = lambda rs: {t for _, s, e in rs for t in range(s, e)}
    assert pts(rows(iv.range_except(da, db, ["k"]))) == pts(a) - pts(b)
    assert pts(rows(iv.range_intersect(da, db, ["k"]))) == pts(a) & pts(b)
    assert pts(rows(iv.range_union(da, db, ["k"]))) == pts(a) | pts(b)


def clips(spark, n=40):
    rnd, t, out = random.Random(5), 0, []
    for i in range(n):
        t += rnd.choice([0, 0, 3, 7])
        d = rnd.randrange(2, 30)
        out.append((0, 0, i, t, d, rnd.randrange(9), rnd.choice([1.0, 2.0]), rnd.random() < 0.3, None))
        t += d
    return spark.createDataFrame(out, "sequence_id long, track_id long, clip_id long, start long, duration long, source_in long, speed double, reverse boolean, frame_hold long")


def no_overlap(df):
    r = sorted((x["start"], x["start"] + x["duration"]) for x in df.collect())
    assert all(a[1] <= b[0] for a, b in zip(r, r[1:])) and all(e > s for s, e in r)


def test_edits_keep_tracks_sound(spark):
    c = clips(spark)
    cuts = spark.createDataFrame([(0, t) for t in (5, 50, 51, 200)], "sequence_id long, t long")
    r = spark.createDataFrame([(0, 10, 40), (0, 35, 60), (0, 100, 130)], "sequence_id long, start long, end long")
    for out in (ed.razor(c, cuts, ["sequence_id"]), ed.lift(c, r), ed.ripple_delete_ranges(c, r)[0]):
        no_overlap(out)


def test_insert_then_ripple_delete_is_identity(spark):
    c = clips(spark)
    tracks = spark.createDataFrame([(0, 0, False, True)], "sequence_id long, track_id long, locked boolean, sync_lock boolean")
    p = spark.createDataFrame([(0, 0, 777, 45, 25, 0, 1.0, False, None, 1)], "sequence_id long, track_id long, clip_id long, start long, duration long, source_in long, speed double, reverse boolean, frame_hold long, edit_id long")
    there = ed.insert(c, p, tracks)
    no_overlap(there)
    back = ed.ripple_delete_ranges(there, spark.createDataFrame([(0, 45, 70)], "sequence_id long, start long, end long"))[0]
    span = lambda df: rows(iv.merge_ranges(ed.with_end(df), ["track_id"]))
    assert span(back) == span(c)
    whole, _ = ed.join_through_edits(back.withColumn("item_id", F.lit(1)).drop("origin"))
    assert whole.agg(F.sum("duration")).first()[0] == c.agg(F.sum("duration")).first()[0]


@pytest.mark.parametrize("num,den", tb.RATES)
def test_frame_and_tick_round_trip(spark, num, den):
    f = spark.range(-500, 500).select(F.col("id"), tb.frame_ticks(F.lit(num), F.lit(den)).alias("ft"))
    bad = f.filter((tb.frame_at(F.col("id") * F.col("ft"), "ft") != F.col("id")) | (tb.frame_at(F.col("id") * F.col("ft") + F.col("ft") - 1, "ft") != F.col("id")) | (tb.frame_at_any(F.col("id") * F.col("ft"), F.lit(num), F.lit(den)) != F.col("id")))
    assert bad.count() == 0


def test_dropped_labels_never_appear(spark):
    f = spark.range(0, 120_000).select(tb.timecode("id", F.lit(30).cast("long"), True).alias("tc"))
    assert f.filter(r"tc rlike ';[0-9][1-9];00;0[01]$'").count() == 0
    assert f.distinct().count() == 120_000
