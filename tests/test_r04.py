"""What travels in shuffles and where files are made: faults that only larger tables show."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions.timebase import TPS
from tickloom.operators import captions as cp
from tickloom.operators import intervals as iv
from tickloom.operators import nesting as ns
from tickloom.operators.ordered import max_before, prev, scan, sum_before
from tickloom.plans import queries_h_live as qh
from tickloom.sources import documents as dc
from tickloom.sources import media as md


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranges_are_copied_for_classes_that_exist(spark):
    """A side of short ranges makes no copies of the other for long ones."""
    rnd = random.Random(4)
    rows = [(i % 3, i, s := rnd.randrange(2000) * TPS, s + rnd.choice([1, 5, 5, 900]) * TPS) for i in range(300)]
    a = spark.createDataFrame(rows, "k long, i long, start long, end long")
    b = a.filter(F.col("end") - F.col("start") <= 5 * TPS).select("k", F.col("i").alias("j"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    assert iv.classes_of(b, "b_start", "b_end") == [0] and iv.classes_of(a) == [0, 2] and iv.classes_of(a.limit(0)) == []
    few = iv.overlap_join(a, b, ["k"], a_classes=iv.classes_of(a), b_classes=[0])
    assert sorted(few.collect()) == sorted(iv.overlap_join(a, b, ["k"]).collect())
    want = {(x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and y[3] - y[2] <= 5 * TPS and x[2] < y[3] and y[2] < x[3]}
    assert sorted(map(tuple, few.select("i", "j").collect())) == sorted(want)
    wide = iv.overlap_join(a, b, ["k"], a_classes=[], b_classes=[])
    assert "array(0)" in plan(wide) or "[0]" in plan(wide)


def test_keys_of_one_chunk_carry_nothing(spark):
    """What a scan carries across chunks is shuffled only where there is something."""
    rows = [(k, t * 10, t) for k in range(40) for t in range(5 if k else 500)]
    df = spark.createDataFrame(rows, "k long, t long, v long")
    s = scan(df, ["k"], ["t"], 100, p=prev("v"), n=sum_before("v"), m=max_before("v"))
    p = plan(s)
    assert "isnotnull(_k_p" in p and "isnotnull(_k_n" in p and "isnotnull(_k_m" in p
    for r in s.collect():
        v = r["v"]
        assert (r["p"], r["n"], r["m"]) == ((v - 1, v * (v - 1) // 2, v - 1) if v else (None, 0, None))


def test_captions_of_no_group_stay_out_of_the_join(spark):
    """their null group would bring them all to one task."""
    c = spark.createDataFrame([(1, i, i * 10, 5, f"t{i}") for i in range(50)], "track_id long, caption_id long, start long, duration long, text string")
    g = spark.createDataFrame([(3, 1), (4, 1), (8, 2), (10, 2)], "caption_id long, group_id long")
    left, refused = cp.merge_captions(c, g)
    anti = [x for x in left._jdf.queryExecution().optimizedPlan().toString().split("Join LeftAnti")[1:]]
    assert anti and all("isnotnull(group_id" in x.split("Join Left")[0] for x in anti)
    got = {r["caption_id"]: r["text"] for r in left.collect()}
    assert len(got) == 49 and got[3] == "t3\nt4" and got[8] == "t8" and [r[0] for r in refused.collect()] == [2]


def test_offsets_of_fragments_are_sent_to_the_clips(spark):
    """ten fragments would make ten tasks of all clips."""
    items = spark.range(40).select((F.col("id") % 4).alias("fragment_id"), F.col("id").alias("item_id"))
    clips = spark.range(100).select((F.col("id") % 4).alias("fragment_id"), F.col("id").alias("clip_id"), (F.col("id") % 40).alias("item_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = ns.merge_projects(items, clips)[1]
        p = plan(moved)
        assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p and "Exchange hashpartitioning" not in p
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    base = {0: 0, 1: 97, 2: 97 + 98, 3: 97 + 98 + 99}
    assert all(r["clip_id"] - base[r["fragment_id"]] in range(100) for r in moved.collect())


def test_small_files_are_written_listed_and_read_in_the_tasks(spark, tmp_path):
    """a folder for every file, and a listing of all of them by the driver, took minutes for 20 000."""
    rows = [(k, p, f"doc {k} line {p}") for k in range(300) for p in range(3)]
    out = str(tmp_path / "docs")
    lines = spark.createDataFrame(rows, "k long, pos long, line string")
    dc.write_documents(lines, "k", out)
    (tmp_path / "docs" / "_SUCCESS").write_text("")
    (tmp_path / "docs" / ".hidden").mkdir()
    (tmp_path / "docs" / ".hidden" / "k=9.txt").write_text("no")
    folders = [f for f in (tmp_path / "docs").iterdir() if f.name.startswith("part-")]
    assert 1 < len(folders) <= 64
    listed = dc.list_files(spark, out, "*.txt")
    assert listed.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert {(r["path"], r["size"]) for r in listed.collect()} == {(f"file:{f}", f.stat().st_size) for x in folders for f in x.iterdir()}
    got = dc.document_lines(spark, out).filter("line != ''").select(F.regexp_extract("path", r"k=(\d+)[^/]*$", 1).cast("long"), "line")
    assert sorted(map(tuple, got.collect())) == sorted((k, s) for k, _, s in rows)
    # written again, nothing of the old stays
    dc.write_documents(lines.filter("k < 5"), "k", out)
    assert dc.document_lines(spark, out).filter("line != ''").count() == 15
    prints = md.scan_media_files(spark, out)
    assert prints.select("fingerprint").distinct().count() == prints.count() >= 5
    assert sorted(map(tuple, md.scan_media_files(spark, f"{tmp_path}/do*/part-*").collect())) == sorted(map(tuple, prints.collect()))
    one = prints.first()["path"]
    assert [tuple(r) for r in md.scan_media_files(spark, one).collect()] == [tuple(r) for r in prints.filter(F.col("path") == one).collect()]


def test_signatures_are_made_once(spark, monkeypatch):
    """every batch of the stream worked out the signatures of all frames."""
    seen = []

    def arriving(spark, d, name, build, *rest):
        seen.append(plan(build()))
        raise KeyError(name)

    monkeypatch.setattr(qh, "arriving", arriving)
    with pytest.raises(KeyError):
        qh.stream_scene_cuts(spark, "/root/testdata/sf0.001")
    assert "FileScan parquet" in seen[0] and "Python" not in seen[0] and "Exchange" not in seen[0]
