"""Work that grows with the input and no faster: groups, rounds and shuffles of the findings of round 3."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions.timebase import TPS
from tickloom.operators import audio as au
from tickloom.operators import captions as cp
from tickloom.operators import edits as ed
from tickloom.operators import sessions as ss
from tickloom.operators import signal as sg
from tickloom.operators import transcripts as tr
from tickloom.operators.ordered import each_group, orbit
from tickloom.sources import interchange as ic


@pytest.fixture
def no_call_per_group(monkeypatch):
    def refuse(*_):
        raise AssertionError("a call for every group")

    monkeypatch.setattr("pyspark.sql.pandas.group_ops.PandasGroupedOpsMixin.applyInPandas", refuse)


def test_best_jumps_take_few_blocks_on_long_streams(spark):
    """F12"""
    rnd = np.random.default_rng(5)
    v = rnd.normal(size=(700, 24))
    v[400:500] = v[100:200]
    v[:, :12] = np.abs(v[:, :12])
    rows = [(s, i, x[:12].tolist(), x[12:].tolist()) for s, n in ((0, 700), (1, 3)) for i, x in enumerate(v[:n])]
    f = spark.createDataFrame(rows, "stream_id long, i long, chroma array<double>, cepstra array<double>")
    s = sg._similarity(v, v)
    total, n = np.zeros((700, 700)), np.zeros((700, 700))
    for d in range(-4, 4):
        a, b = slice(max(-d, 0), min(700 - d, 700)), slice(max(d, 0), min(700 + d, 700))
        total[a, a] += s[b, b]
        n[a, a] += 1
    score = np.round(total / n, 9)
    best = sorted((-score[i, j], i, j) for i in range(700) for j in range(700) if abs(i - j) >= 2)[:30]
    got = [r for r in sg.best_jumps(f, 30, 8, 2).collect() if r["stream_id"] == 0]
    assert [(r["i"], r["j"]) for r in sorted(got, key=lambda r: r["rank"])] == [(i, j) for _, i, j in best]
    # 6 000 rows in tiles of 32 are not 188 x 188 groups
    long = spark.range(6000).select(F.lit(0).cast("long").alias("stream_id"), F.col("id").alias("i"), F.array(F.lit(1.0)).alias("chroma"), F.array(F.lit(1.0)).alias("cepstra"))
    assert sg._jump_blocks(long, 32).select("ti", "tj").distinct().count() <= 100


def test_groups_share_calls_and_stay_whole(spark):
    """batches of rows end inside groups, calls never do."""
    rows = [(k, c, i) for k in range(300) for c in range(2) for i in range(1 + (k * 7 + c) % 40)] + [(1000, 0, i) for i in range(25_000)]
    df = spark.createDataFrame(rows, "k long, c long, i long").repartition(7)

    def fn(pdf, groups):
        return pd.DataFrame([(int(pdf["k"][a]), int(pdf["c"][a]), b - a, pdf["i"][a:b].tolist() == list(range(b - a)), len(groups)) for a, b in groups], columns=["k", "c", "n", "whole", "calls"])

    got = each_group(df, ["k", "c"], ["i"], fn, "k long, c long, n long, whole boolean, calls long").collect()
    want = {}
    for k, c, _ in rows:
        want[k, c] = want.get((k, c), 0) + 1
    assert {(r["k"], r["c"]): r["n"] for r in got} == want and len(got) == len(want) and all(r["whole"] for r in got)
    assert max(r["calls"] for r in got) > 20


def test_walks_keep_large_positions(spark):
    """a missing next position once made all of a chunk's positions floating point; they lost their last digits."""
    at = [2**60 + 254_016 * (2 * i + 1) + i for i in range(50)]
    df = spark.createDataFrame([(k, a, b) for k in range(3) for a, b in zip(at, [*at[2:], None, None])], "k long, pos long, nxt long")
    for chunk in (10_000_000, 1 << 61):
        assert sorted(r["pos"] for r in orbit(df, ["k"], chunk=chunk).filter("k = 1").collect()) == at[::2]


def test_caption_blocks_share_calls(spark, no_call_per_group):
    """F24"""
    w = spark.createDataFrame([(s, i, i * TPS, i * TPS + TPS // 2, "word", "a") for s in range(50) for i in range(3)], "sequence_id long, idx long, start long, end long, text string, speaker string")
    got = tr.caption_blocks(w, TPS // 25, break_pause=10 * TPS).collect()
    assert [(r["first"], r["last"], r["text"]) for r in got] == [(0, 2, "word word word")] * 50


def test_debounced_changes_share_calls(spark, no_call_per_group):
    """F35"""
    e = spark.createDataFrame([(p, t, t) for p in range(50) for t in (0, 5, 30)], "project_id long, ts_us long, seq long")
    got = sorted(tuple(r) for r in ss.changes_debounced(e, 10, 60).collect())
    assert got == sorted(x for p in range(50) for x in ((p, 2, 0, 15), (p, 1, 30, 40)))


def test_thinning_shares_calls(spark, no_call_per_group):
    """F39"""
    p = spark.createDataFrame([(o, t, t, float(t == 2)) for o in range(50) for t in range(5)], "owner_id long, seq long, t long, v double")
    got = sorted((r["owner_id"], r["t"]) for r in au.thin_keyframes(p, 0.5, 2).collect())
    assert got == [(o, t) for o in range(50) for t in (0, 2, 4)]


def test_cues_share_calls(spark, no_call_per_group):
    """F40"""
    c = spark.createDataFrame([(t, i, s, e) for t in range(50) for i, (s, e) in enumerate([(0, 10), (5, 8), (5, 12), (20, 30)])], "track_id long, cue_id long, start long, end long")
    good, dropped = cp.normalize_cues(c, chunk=2)
    assert sorted(map(tuple, good.filter("track_id = 7").collect())) == [(7, 0, 0, 5), (7, 1, 5, 8), (7, 2, 8, 12), (7, 3, 20, 30)] and dropped.count() == 0


def test_beats_of_long_streams_take_few_rounds(spark, monkeypatch):
    """F37"""
    calls = []
    whole = sg.cut_lineage
    monkeypatch.setattr(sg, "cut_lineage", lambda df: calls.append(1) or whole(df))
    env = spark.range(1000).select(F.lit(0).cast("long").alias("stream_id"), F.col("id").alias("k"), F.when(F.col("id") % 13 == 0, 3.0).otherwise(0.5).alias("v"))
    period = spark.createDataFrame([(0, 13.0)], "stream_id long, period double")
    few = sorted(r["k"] for r in sg.beats(env, period, 32).collect())
    assert len(calls) <= 8
    assert few == sorted(r["k"] for r in sg.beats(env, period).collect()) and set(np.diff(few)) == {13}


def test_edl_lines_are_matched_once(spark):
    """the fields of an event come from one match of the line, with or without text before its length."""
    text = ["TITLE: t", "FCM: NON-DROP FRAME", "", "001  AX V C 00:00:00:00 00:00:01:00 01:00:00:00 01:00:01:00", "* FROM CLIP NAME: one", "002  R2  AA/V  D    024 x 00:00:02:00 00:00:03:00 01:00:01:00 01:00:02:00 ", "junk", "* 003 AX V C 00:00:00:00 00:00:01:00 01:00:00:00 01:00:01:00"]
    lines = spark.createDataFrame([("p", i, x) for i, x in enumerate(text)], "path string, pos long, line string")
    events, warnings = ic.scan_edl(lines, 25, 1)
    got = sorted(tuple(r) for r in events.select("event", "num", "reel", "channel", "transition", "length", "src_in", "rec_out", "from_clip").collect())
    assert got == [(1, "001", "AX", "V", "cut", 0, 0, 90025, "one"), (2, "002", "R2", "A1", "dissolve", 24, 50, 90050, None), (2, "002", "R2", "A2", "dissolve", 24, 50, 90050, None), (2, "002", "R2", "V", "dissolve", 24, 50, 90050, None)]
    assert [r["message"] for r in warnings.collect()] == ["unrecognised line ignored: junk"]
    text = events._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract(trim(line" not in text


def test_segments_across_chunks_equal_plain_code_and_move_clips_once(spark):
    """what shows at a boundary is known inside its chunk of time; only segments that leave it wait for a later one."""
    rnd, ft, clips = random.Random(30), TPS // 25, []
    for k in range(120):
        seq, track = k % 3, k % 4
        start, length = rnd.randrange(9000) * ft + rnd.randrange(2), rnd.choice([1, 40, 400, 6000]) * ft
        clips.append((seq, seq * 4 + track, k, k % 2, start, length, k % 5 * ft, float(1 + k % 2), k % 7 == 0, k % 6 != 0, None, ft))
    c = spark.createDataFrame(clips, "sequence_id long, track_id long, clip_id long, item_id long, start long, duration long, source_in long, speed double, reverse boolean, enabled boolean, frame_hold long, ft long")
    tracks = spark.createDataFrame([(t, "video", t % 4, t != 5) for t in range(12)], "track_id long, kind string, pos long, enabled boolean")
    want, shown = [], {}
    for seq in range(3):
        own = [(-(-r[4] // ft) * ft, -(-(r[4] + r[5]) // ft) * ft, *r) for r in clips if r[0] == seq and r[1] != 5]
        at = sorted({t for r in own for t in r[:2]})
        for t, t1 in zip(at, at[1:]):
            on = sorted((r for r in own if r[11] and r[0] <= t < r[1]), key=lambda r: (r[3] % 4, r[4]))
            if on:
                need = "render" if len(on) > 2 else "none" if len(on) == 1 and on[0][9] == 1 and not on[0][10] else "realtime"
                want.append((seq, t // ft, (t1 - t) // ft, len(on), ",".join(str(r[4]) for r in on), need))
                shown[want[-1][:2]] = (t1 - t, tuple(sorted((r[3] % 4, r[5], r[9], r[10], r[8] + (t - r[6]) * r[9]) for r in on)))
    out = ed.render_segments(c, tracks)
    got = out.collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted(want)
    hashes = {(r["sequence_id"], r["first_frame"]): r["hash"] for r in got}
    assert len(set(hashes.values())) == len(set(shown.values())) == len({(hashes[k], v) for k, v in shown.items()})
    assert ed.render_segments(c, tracks)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 4
