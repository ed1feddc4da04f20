"""Source queries over whole tables."""

import json

import oracle
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tickloom.plans.registry import load

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["scan_captions_warnings", "scan_captions_vtt", "scan_otio_nested", "read_media_source"])
def test_whole_table(spark, name):
    fn, sql = load()[name]
    ok, n, got, want, _, _ = oracle.compare(spark, oracle.connect(D), D, fn, sql)
    assert ok and n, (list((got - want).items())[:3], list((want - got).items())[:3])


def test_nested_stacks_collections_and_warnings(spark):
    from tickloom.functions.timebase import TPS
    from tickloom.sources import interchange as ic

    rng = lambda a, n: {"start_time": {"rate": 25.0, "value": a}, "duration": {"rate": 25.0, "value": n}}
    clip = lambda n: {"OTIO_SCHEMA": "Clip.2", "name": f"c{n}", "source_range": rng(1, n)}
    track = lambda *kids, **more: {"OTIO_SCHEMA": "Track.1", "children": list(kids), **more}
    stack = lambda *kids, **more: {"OTIO_SCHEMA": "Stack.1", "name": "s", "children": list(kids), **more}
    deep = stack(track(clip(3)))
    for _ in range(4):
        deep = stack(track(clip(2), deep), track(clip(1), kind="Audio"))
    doc = {"OTIO_SCHEMA": "SerializableCollection.1", "children": [{"OTIO_SCHEMA": "Timeline.1", "name": "t", "tracks": stack(track(deep, clip(7), {"OTIO_SCHEMA": "Odd.1"}), clip(5))}, track(clip(4), stack(source_range=rng(2, 9)), clip(6))]}
    got = ic.scan_otio_tree(spark.createDataFrame([("a", json.dumps(doc)), ("b", "no json"), ("c", None)], "path string, value string"))
    f = TPS // 25
    items = {(r.seq, r.track, r.pos): (r.type, r.start // f, r.duration // f, r.child) for r in got["items"].collect()}
    assert items["0", 0, 0] == ("nest", 0, 11, "0/0.0") and items["0", 0, 1] == ("clip", 11, 7, None)
    assert items["0/0.0", 0, 1] == ("nest", 2, 9, "0/0.0/0.1") and items["0/0.0/0.1/0.1/0.1/0.1", 0, 0] == ("clip", 0, 3, None)
    assert items["1", 0, 1] == ("nest", 4, 9, "1/0.1") and items["1", 0, 2] == ("clip", 13, 6, None)
    assert sorted((r.path, r.seq, r.message) for r in got["warnings"].collect()) == [
        ("a", "0", "OTIO Clip directly in a stack is not supported"), ("a", "0", "OTIO Odd items are not supported and were skipped"), ("b", "", "not a JSON document"), ("c", "", "not a JSON document"),
    ]
    assert {r.seq: r.parent for r in got["sequences"].collect()}["0/0.0/0.1"] == "0/0.0"


def test_planned_ranges_follow_the_filters(tmp_path):
    from pyspark.sql.datasource import GreaterThanOrEqual, In, LessThan
    from tickloom.sources.ranges import RangeReader

    pq.write_table(pa.table({"item_id": [1, 2, 3, None], "lo": [0, 5, 100, 0], "hi": [40, 8, 300, 9]}), tmp_path / "r.parquet")
    r = RangeReader(None, {"ranges": str(tmp_path / "r.parquet"), "chunk": "64"}, None, "stream_id", "n")
    assert [p.ranges for p in r.partitions()] == [[(1, 0, 40), (2, 5, 8), (3, 100, 121)], [(3, 121, 185)], [(3, 185, 249)], [(3, 249, 300)]]
    rest = list(r.pushFilters([GreaterThanOrEqual(("n",), 20), LessThan(("n",), 130), In(("stream_id",), (1, 3)), LessThan(("x",), 1.0)]))
    assert [f.attribute for f in rest] == [("x",)] and [p.ranges for p in r.partitions()] == [[(1, 20, 40), (3, 100, 130)]]


@pytest.mark.parametrize("name", ["write_edl_cuts", "write_edl_sources", "write_edl_warnings"])
def test_cut_lists(spark, name):
    fn, sql = load()[name]
    ok, _, got, want, _, _ = oracle.compare(spark, oracle.connect(D), D, fn, sql)
    assert ok, (list((got - want).items())[:3], list((want - got).items())[:3])


def test_reels_of_several_files_are_reported(spark):
    from tickloom.sources import interchange as ic

    clips = spark.createDataFrame([(1, k, k, "video", f"c{k}", k * 1000, 1000, 0, 1.0) for k in range(4)], "track_id long, clip_id long, item_id long, kind string, name string, start long, duration long, source_in long, speed double")
    media = spark.createDataFrame([(0, "/m/interview_1.mov", 0), (1, "/m/interview_2.mov", 0), (2, "/m/other.mov", 0)], "item_id long, path string, start_timecode long")
    lines, warnings = ic.write_edl_cuts(clips, media, 25, 1, source_files=True)
    assert sorted(r.message for r in warnings.collect()) == [f"reel INTERVIE stands for 2 files: /m/interview_{k}.mov" for k in (1, 2)]
    assert sum("* SOURCE FILE: /m/interview_" in r.line for r in lines.collect()) == 2
