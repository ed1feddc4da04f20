"""Results beyond sizes that once were caps, and plans that spread a hot key."""

import time

from pyspark.sql import functions as F

from tickloom.functions.timebase import TPS
from tickloom.operators import intervals as iv
from tickloom.operators import nesting as ns
from tickloom.operators import pixels as px
from tickloom.operators import transcripts as tr
from tickloom.operators.ordered import prev, scan
from tickloom.sources import media as md


def test_overlap_join_is_linear_in_one_key(spark):
    n = 64_000
    a = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * (TPS // 2)).cast("long").alias("start"), (F.col("id") * (TPS // 2) + TPS // 4).cast("long").alias("end"))
    b = a.select("k", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    took = []
    for levels in (iv.LEVELS[:1], iv.LEVELS):
        t = time.time()
        assert iv.overlap_join(a, b, ["k"], levels=levels).count() == n
        took.append(time.time() - t)
    assert took[1] < 4 * took[0] + 2  # three classes, not all pairs of the widest bucket


def test_overlap_join_meets_every_pair_of_classes(spark):
    spans = [(0, 3 * TPS), (5 * TPS, 400 * TPS), (100 * TPS, 40_000 * TPS), (300 * TPS, 301 * TPS), (39_999 * TPS, 50_000 * TPS), (7 * TPS, 7 * TPS + 1)]
    a = spark.createDataFrame([(1, s, e) for s, e in spans], "k long, start long, end long")
    b = a.select("k", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    got = sorted((r["start"], r["b_start"]) for r in iv.overlap_join(a, b, ["k"]).collect())
    assert got == sorted((x[0], y[0]) for x in spans for y in spans if x[0] < y[1] and y[0] < x[1])


def test_chunks_are_dealt_out_after_a_join_on_the_key(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    other = spark.range(3).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    plan = scan(df.join(other.hint("merge"), "k"), ["k"], ["id"], 64, p=prev("id"))._jdf.queryExecution().executedPlan().toString()
    assert any("hashpartitioning" in x and "k#" in x and "_c#" in x for x in plan.split("\n"))


def test_nests_deeper_than_sixteen_and_loops(spark):
    rows = [(s, s * 10, "video", 1000 + s, 1, s + 1 if s < 21 else None, 0, 100, 0, 1.0, False, None) for s in range(22)]
    rows += [(50, 500, "video", 2000, 1, 51, 0, 10, 0, 1.0, False, None), (51, 510, "video", 2001, 1, 50, 0, 10, 0, 1.0, False, None)]
    c = spark.createDataFrame(rows, "sequence_id long, track_id long, kind string, clip_id long, item_id long, nested_id long, start long, duration long, source_in long, speed double, reverse boolean, frame_hold long")
    done, rejected = ns.flatten_nests(c)
    assert sorted(r["sequence_id"] for r in done.collect()) == list(range(22))
    assert sorted(r["clip_id"] for r in rejected.collect()) == [2000, 2001]


def test_image_numbers_far_apart_and_very_long(spark):
    names = ["/a/f1.png", "/a/f2.png", "/a/f5000000.png", "/a/x" + "1" * 25 + ".png"]
    got = md.scan_image_sequences(spark.createDataFrame([(n,) for n in names], "path string")).collect()
    assert sum(r["present"] for r in got) == 4


def test_captions_wider_than_a_chunk_lose_no_word(spark):
    n = 3000
    w = spark.range(n).select(F.lit(1).cast("long").alias("sequence_id"), F.lit(1).cast("long").alias("item_id"), "id", F.lit("x").alias("text"), (F.col("id") * (TPS // 100)).cast("long").alias("start"), ((F.col("id") + 1) * (TPS // 100)).cast("long").alias("end"), F.lit("a").alias("speaker"))
    w = w.withColumnRenamed("id", "idx")
    sizes = []
    for chunk in (64, 4096):
        got = tr.caption_blocks(w, TPS // 25, max_chars=300, lines=2, max_duration=1000 * TPS, chunk=chunk).orderBy("first").collect()
        assert got[0]["first"] == 0 and got[-1]["last"] == n - 1 and all(b["first"] == a["last"] + 1 for a, b in zip(got, got[1:]))
        sizes.append([(r["first"], r["last"]) for r in got])
    assert sizes[0] == sizes[1] and len(sizes[0]) > 5


def test_blend_modes_default_to_those_that_occur(spark):
    rows = [(0, 0, 0, 0, 0.5, 0.5, 0.5, 1.0, 1.0, "normal"), (0, 0, 0, 1, 0.5, 0.5, 0.5, 1.0, 1.0, "multiply"), (0, 1, 0, 0, 0.5, 0.5, 0.5, 1.0, 1.0, "normal"), (0, 1, 0, 1, 0.2, 0.2, 0.2, 1.0, 1.0, "normal")]
    df = spark.createDataFrame(rows, "frame_id long, x int, y int, z int, r double, g double, b double, a double, opacity double, mode string")
    got = {r["x"]: r["r"] for r in px.composite_layers(df).collect()}
    assert abs(got[0] - 0.254) < 0.002 and abs(got[1] - 0.2) < 1e-9
    for modes in (None, []):
        bad = df.withColumn("mode", F.lit("glow"))
        try:
            px.composite_layers(bad, modes).collect()
        except Exception as e:  # of the driver or of a task
            assert "unknown blend mode" in str(e)
        else:
            raise AssertionError("unknown mode accepted")


def test_a_long_run_of_overlapping_cues_in_many_chunks(spark):
    import random

    from tickloom.operators import captions as cp

    rng = random.Random(8)
    rows = [(1, k, s, s + rng.choice([1, 3, 40, 900]), "t") for k, s in enumerate(sorted(rng.randrange(0, 600) for _ in range(900)))] + [(1, 1000, 0, 700, "t"), (1, 1001, 0, 900, "t"), (2, 1, 5, 5, "t"), (2, 2, 5, 9, "t")]
    df = spark.createDataFrame(rows, "track_id long, cue_id long, start long, end long, text string")
    want, gone = [], []
    for track in (1, 2):
        last = None
        for _, i, a, b, _ in sorted((r for r in rows if r[0] == track and r[3] > r[2]), key=lambda r: (r[2], r[3], r[1])):
            if last is not None and a < last[2]:
                if a > last[1]:
                    last[2] = a
                else:
                    a = last[2]
                    if b <= a:
                        gone.append((track, i))
                        continue
            last = [i, a, b]
            want.append((track, last))
    for chunk in (16, 8192):
        good, dropped = cp.normalize_cues(df, chunk=chunk)
        assert sorted((r.track_id, r.cue_id, r.start, r.end) for r in good.collect()) == sorted((t, *c) for t, c in want)
        assert sorted(map(tuple, dropped.collect())) == sorted(gone)


def test_one_colour_through_a_lattice_is_not_shuffled(spark):
    from tickloom.operators import pixels as px

    p = spark.range(500).select(F.col("id").alias("frame_id"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0.3).alias("r"), F.lit(0.7).alias("g"), F.when(F.col("id") > 0, 0.7).alias("b"), F.lit(1.0).alias("a"))
    at = spark.range(125).select(F.floor(F.col("id") / 25).cast("int").alias("ri"), (F.floor(F.col("id") / 5) % 5).cast("int").alias("gi"), (F.col("id") % 5).cast("int").alias("bi"))
    lattice = at.select("*", (F.col("ri") * F.col("gi") / 16.0).alias("lr"), (F.col("bi") / 4.0).alias("lg"), (F.col("ri") * F.col("ri") / 16.0).alias("lb"))
    out = px.apply_lut3d(p, lattice, 5)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    near = lambda rows: {(round(r.r, 9), round(r.g, 9), round(r.b, 9)) for r in rows}
    assert near(out.where("frame_id > 0").collect()) == near(px.apply_large_lut3d(p.where("frame_id > 0"), lattice, 5).collect())
    assert out.where("r is null").count() == 1
