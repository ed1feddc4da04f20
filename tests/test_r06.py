"""Findings of round 4: whole groups whatever the plan, and work that grows with the input."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tickloom.functions.timebase import TPS
from tickloom.operators import audio as au
from tickloom.operators import edits as ed
from tickloom.operators import pixels as px
from tickloom.operators.intervals import subtract
from tickloom.operators.ordered import each_group
from tickloom.plans import fixtures as fx
from tickloom.plans.registry import load
from tickloom.session import setting


D = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def joins_turn_late(spark):
    """Joins are planned as merge joins and turn into broadcasts while they run, as on larger tables."""
    with (
        setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"),
        setting(spark, "spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB"),
        setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"),
    ):
        yield


def test_groups_stay_whole_after_a_join_on_their_keys(spark, joins_turn_late):
    """a chunk that lay in several tasks was walked in pieces, each from the start."""
    rows = spark.range(0, 20_000, 1, 4).select((F.col("id") % 50).alias("k"), "id")
    marks = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))

    def count(pdf, groups):
        assert list(pdf.columns) == ["k", "id", "w"] and all(pdf["id"].iloc[a:b].is_monotonic_increasing for a, b in groups)
        return pdf.iloc[[a for a, _ in groups]][["k"]].assign(n=[b - a for a, b in groups])

    got = each_group(rows.join(marks, "k", "left"), ["k"], ["id"], count, "k long, n long").collect()
    assert sorted(map(tuple, got)) == [(k, 400) for k in range(50)]


def test_word_errors_of_documents_without_words_and_of_one_id(spark, tmp_path):
    """rows of one id count together, a document without words has no row, a null text has no words."""
    text = "one two-three four, five six seven eight nine ten eleven twelve - thirteen"
    rows = [(0, text), (1, "---"), (2, ""), (3, None), (4, text), (4, "a " * 25), (4, "#"), (None, text)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name, n in (("word_error_rate", 3), ("pooled_word_error_rate", 1)):
        query, sql = load()[name]
        got = query(spark, str(tmp_path)).collect()
        assert len(got) == n and {tuple(r) for r in got} == set(con.execute(sql).fetchall())


def mixed(clips, samples, tracks):
    """Plain code for the mix."""
    out = {}
    for seq, track, _, stream, start, duration, source_in, speed, back, db in clips:
        volume, pan = tracks[track]
        used = math.ceil(duration * speed)
        for k in range(duration):
            r = math.floor(k * speed)
            p = source_in + (used - 1 - r if back else r)
            if (stream, p) in samples:
                y, angle = samples[stream, p] * 10 ** ((db + volume) / 20), (pan + 1) * math.pi / 4
                left, right = out.get((seq, start + k), (0, 0))
                out[seq, start + k] = left + y * math.cos(angle), right + y * math.sin(angle)
    return {(s, n, ch): round(x, 9) for (s, n), both in out.items() for ch, x in enumerate(both)}


@pytest.mark.parametrize("around", [1024, 0])
def test_only_clips_of_a_mix_travel(spark, monkeypatch, around):
    """samples are opened and summed in the stretch their clips were dealt to; holes, speeds and long clips included."""
    monkeypatch.setattr(au, "STRETCH", 64, raising=False)
    monkeypatch.setattr(au, "AROUND", around, raising=False)
    rnd = random.Random(1)
    samples = {(s, n): rnd.uniform(-1, 1) for s in (0, 1) for n in range(600) if s == 0 or n % 7}
    tracks = {t: (-rnd.random() * 6, rnd.uniform(-1, 1)) for t in range(4)}
    clips = [(t // 2, t, 10 * t + i, rnd.randrange(2), 90 * i + rnd.randrange(9), rnd.choice([1, 40, 200]), rnd.randrange(120), rnd.choice([0.3, 1.0, 1.7, 2.0]), rnd.random() < 0.5, -rnd.random()) for t in range(4) for i in range(6)]
    c = spark.createDataFrame(clips, "sequence_id long, track_id long, clip_id long, stream_id long, start long, duration long, source_in long, speed double, reverse boolean, gain_db double").withColumn("enabled", F.lit(True))
    s = spark.createDataFrame([(k, n, x) for (k, n), x in samples.items()], "stream_id long, n long, x double")
    t = spark.createDataFrame([(k // 2, k, False, False, *v) for k, v in tracks.items()], "sequence_id long, track_id long, muted boolean, solo boolean, volume_db double, pan double")
    df = au.mix_timeline(c, s, t, chunk=50)
    assert {(r["sequence_id"], r["n"], r["ch"]): round(r["x"], 9) for r in df.collect()} == mixed(clips, samples, tracks)
    if around:
        p = plan(df)
        assert "Exchange" not in p[p.index("HashAggregate") : p.index("Generate ")]


def test_clips_are_shuffled_once(spark, joins_turn_late):
    """Numbers within an order and times on its tracks come from one shuffle by the order."""
    p = plan(fx.clips.__wrapped__(spark, D))
    assert p.count("Exchange hashpartitioning") == 1


def test_cuts_move_clips_twice(spark, joins_turn_late):
    """One copy of a clip for ranges of some seconds and of some tens, and one on its way to its own walls."""
    rnd, s = random.Random(8), TPS
    clips = [(q, k, k * 30 * s, k * 30 * s + rnd.choice([2, 25, 30, 900]) * s) for q in (0, 1) for k in range(40)]
    cuts = [(q, at * s, (at + n) * s) for q in (0, 1) for at, n in zip(range(0, 2000, 50), [1, 20, 49, 3] * 10)]
    a = spark.createDataFrame(clips, "sequence_id long, clip_id long, start long, end long")
    b = spark.createDataFrame(cuts, "sequence_id long, start long, end long")
    df = subtract(a, b, ["sequence_id"], ["clip_id"], merged=True)
    want = []
    for q, k, lo, hi in clips:
        for _, x, y in sorted(c for c in cuts if c[0] == q and c[1] < hi and lo < c[2]):
            want += [(q, k, lo, x)] if x > lo else []
            lo = y
        want += [(q, k, lo, hi)] if hi > lo else []
    assert sorted(tuple(r) for r in df.select("sequence_id", "clip_id", "lo", "hi").collect()) == sorted(want)
    p = plan(df)
    assert p.count("Exchange hashpartitioning") == 3 and "[0,1]" not in p


def test_marked_clips_are_worked_out_once(spark, joins_turn_late):
    """six steps read which clips go and which tracks that touches; none of them joins them again."""
    c = spark.createDataFrame([(0, t, 10 * t + k, k * 10, 10, 0, 1.0) for t in (0, 1) for k in range(3)], "sequence_id long, track_id long, clip_id long, start long, duration long, source_in long, speed double")
    tracks = spark.createDataFrame([(0, 0, False, True), (0, 1, False, False)], "sequence_id long, track_id long, locked boolean, sync_lock boolean")
    moved, conflicts = ed.ripple_delete_items(c, spark.range(1, 2).select(F.col("id").alias("clip_id")), tracks)
    assert sorted((r["clip_id"], r["start"]) for r in moved.collect()) == [(0, 0), (2, 10), (10, 0), (11, 10), (12, 20)] and conflicts.count() == 0
    assert "Range (" not in plan(moved)


def test_pieces_of_a_multicam_track_are_healed_after_one_shuffle(spark, joins_turn_late, monkeypatch):
    """short tracks by windows, long ones by scans, with the same results."""
    multicam, sql = load()["multicam_record"]
    short = multicam(spark, D)
    assert plan(short).count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(ed, "SHORT", 0)
    long = sorted(map(tuple, multicam(spark, D).collect()))
    assert sorted(map(tuple, short.collect())) == long and len(long) > 1000


def test_a_colour_of_footage_is_worked_out_once(spark, monkeypatch):
    """pixels look their colour up; codes may be null, and many colours are worked out where they are."""
    codes = spark.range(4000).select((F.col("id") % 5).alias("item_id"), F.col("id").alias("frame_id"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.when(F.col("id") % 50 < 49, (F.col("id") % 50 * 18 + 64).cast("int")).alias("py"), F.lit(500).alias("pcb"), F.lit(520).alias("pcr"))
    media = spark.createDataFrame([(0, 10, True, "709", "srgb", "bt709", 203.0), (1, 10, False, "2020", "pq", "bt2020", 1000.0), (2, 10, True, "2020", "hlg", "bt2020", 1000.0), (3, 10, False, "709", "slog3", "sgamut3cine", 1500.0)], "item_id long, bits int, full_range boolean, matrix string, curve string, gamut string, peak_nits double")
    rows = lambda: px.normalise_footage(codes, media)
    few = rows()
    got = sorted(few.collect(), key=lambda r: r["frame_id"])
    # powers are below the grouping of equal colours
    p = plan(few)
    assert len(got) == 3200 and "POWER" in p.upper() and p.upper().rindex("POWER") > p.index("<=>" if "<=>" in p else "BroadcastHashJoin") and "keys=[item_id" in p
    monkeypatch.setattr(px, "COLOURS", 0)
    assert sorted(rows().collect(), key=lambda r: r["frame_id"]) == got


def test_a_blended_layer_takes_nine_powers(spark):
    """both colours are encoded once and the blend decoded once, three channels each."""
    rows = [(0, 0, 0, 0, 0.2, 0.4, 0.6, 1.0, 1.0, "normal"), (0, 0, 0, 1, 0.5, 0.25, 0.125, 0.5, 1.0, "screen")]
    layers = spark.createDataFrame(rows, "frame_id long, x int, y int, z int, r double, g double, b double, a double, opacity double, mode string")
    df = px.composite_layers(layers, ["screen"])
    enc, dec = lambda v: 1.055 * v ** (1 / 2.4) - 0.055, lambda v: ((v + 0.055) / 1.055) ** 2.4
    want = [0.5 * d + 0.5 * dec(enc(d) + enc(s / 0.5) - enc(d) * enc(s / 0.5)) for d, s in ((0.2, 0.5), (0.4, 0.25), (0.6, 0.125))]
    assert list(df.first()[3:]) == pytest.approx([*want, 1.0], abs=1e-9)
    assert df._jdf.queryExecution().optimizedPlan().toString().upper().count("POWER") == 9
