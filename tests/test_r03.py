"""Ties, plans and sizes that the small tables of the other tests do not reach."""

import numpy as np
import oracle
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import catalog as ct
from tickloom.operators import intervals as iv
from tickloom.operators import pixels as px
from tickloom.plans import fixtures as fx
from tickloom.plans import queries_e_audio as qe
from tickloom.plans import queries_f_pixels as qf
from tickloom.plans import queries_i_sources as qi
from tickloom.plans.queries_a_intervals import sql_merge
from tickloom.plans.queries_i_sources import scan_image_sequences
from tickloom.plans.registry import load
from tickloom.streaming.live import Peaks

D = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_pixels_are_not_sent_around(spark):
    """A frame's pixels are 144 times what Spark takes them for."""
    assert "Broadcast" not in plan(qf.image_diff(spark, D))
    assert "Broadcast" not in plan(px.frame_signatures(fx.pixels(spark, D), 16, 9))
    assert "Broadcast" not in plan(qf.frame_differences(spark, D))


def test_more_frames_make_more_tasks(spark, monkeypatch):
    """F23, F25, F26"""
    monkeypatch.setattr(fx, "FRAMES", 10, raising=False)
    assert fx.pixels(spark, D).rdd.getNumPartitions() == 20


def test_image_diff_keeps_only_pixels_of_both_sides(spark):
    rows = [(1, x, 0, 0.5, 0.5, 0.5, 1.0) for x in range(3)]
    a = spark.createDataFrame(rows, "frame_id long, x int, y int, r double, g double, b double, a double")
    got = px.image_diff(a, a.filter("x < 2").withColumn("r", F.lit(1.0))).first()
    assert (got["max_abs"], got["differing"], got["mean_abs"]) == (127, 2, 127 / 4)


def test_equal_ranges_start_one_run(spark):
    """The first of equal ranges starts the run, in Spark and in the SQL."""
    con = oracle.connect(D)
    con.execute('CREATE TABLE r AS SELECT k, i * 10 AS start, i * 10 + 5 AS "end" FROM range(400) a(k), range(30) b(i), range(7)')
    # rows of one range may come in any order; this order puts covered ones first
    con.execute('CREATE TABLE s AS SELECT *, max("end") OVER (PARTITION BY k ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cov FROM r')
    got = con.execute("WITH " + sql_merge("r", "m", "k").replace('(SELECT *, max("end")', '(SELECT * FROM (SELECT *, max("end")', 1).replace("AS cov FROM r)", "AS cov FROM r) ORDER BY cov DESC NULLS LAST)", 1) + ' SELECT count(*), max("end" - start) FROM m').fetchone()
    assert got == (12_000, 5)
    r = spark.createDataFrame(con.execute("SELECT * FROM r").fetchall(), "k long, start long, end long")
    m = iv.merge_ranges(r, ["k"], chunk=100)
    assert m.count() == 12_000 and m.filter("end - start != 5").isEmpty()


@pytest.mark.parametrize("size, text", [(262_144 * 41, "10.2 MB"), (262_144 * 43, "10.8 MB"), (512 * 3, "2 KB"), (512 * 5, "2 KB"), (1 << 30, "1.00 GB"), (10_433_331, "9.9 MB"), (1023, "1023 B")])
def test_file_sizes_halfway_take_the_even_digit(spark, size, text):
    """as the reference's and DuckDB's texts do."""
    assert spark.range(1).select(ct.file_size_text(F.lit(size)).alias("t")).first()["t"] == text


def test_image_numbers_of_seven_digits(spark, tmp_path):
    """wide numbers stay whole, and a frame far from the first begins a sequence."""
    con = oracle.connect(D)
    con.execute(f"COPY (SELECT * REPLACE (p_partkey * 7001 AS p_partkey, 'B' AS p_brand) FROM part) TO '{tmp_path}/part.parquet'")
    con.execute(f"CREATE OR REPLACE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    ok, n, got, want, _, _ = oracle.compare(spark, con, str(tmp_path), scan_image_sequences, load()["scan_image_sequences"][1])
    assert ok and n, (list((got - want).items())[:3], list((want - got).items())[:3])


def test_a_project_is_several_documents(spark, monkeypatch, tmp_path):
    """a document is one row, so a project's sequences are spread over several."""
    monkeypatch.setattr(qi, "IN_PROJECT", 5, raising=False)
    monkeypatch.setattr(qi, "folder", lambda spark, name: f"{tmp_path}/{name}")
    ok, n, *_ = oracle.compare(spark, oracle.connect(D), D, *load()["scan_projects"])
    assert ok and n and len(list((tmp_path / "projects").glob("*.json"))) > 100


def test_channels_are_told_apart_after_the_shuffle(spark):
    """the shuffle of a mix carries one row per instant, not one per channel."""
    p = plan(qe.mix_timeline(spark, D))
    assert "posexplode" in p and p.index("posexplode") < p.index("HashAggregate")


class Handle:
    """State of one key that counts how often it is reached."""

    def __init__(self):
        self.calls, self.value = [], None

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None

    def registerTimer(self, ms):
        self.calls.append(ms)

    def getCurrentWatermarkInMs(self):
        return self.mark


def test_peaks_reach_their_state_once_a_batch(spark):
    """not once per interval."""
    h, p = Handle(), Peaks(1000)
    p.init(h)
    h.mark = 0
    feed = pd.DataFrame({"ts_us": np.arange(100) * 500, "x": np.arange(100) * -1.0})
    assert sum(len(r) for r in p.handleInputRows((1, 0), iter([feed]), h)) == 0
    assert h.calls == ["get", "update", 1]
    h.calls, h.mark = [], 49
    rows = pd.concat(list(p.handleExpiredTimer((1, 0), h, None)))
    assert rows["start_us"].tolist() == [k * 1000 for k in range(49)] and rows["peak"].tolist() == [2.0 * k + 1 for k in range(49)]
    assert h.calls == ["get", "update", 50]
    h.mark = 50
    assert pd.concat(list(p.handleExpiredTimer((1, 0), h, None)))["peak"].tolist() == [99.0] and h.value is None
