"""Registered queries against DuckDB at the smallest scale; ``python tests/oracle.py`` runs all of them."""

import oracle
import pytest

from tickloom.plans.registry import load

D = "/root/testdata/sf0.001"
NAMES = [
    "track_gaps", "merge_ranges", "range_except", "overlap_join", "item_at", "paragraphs", "phrase_search", "find_pauses", "find_fillers", "caption_blocks", "normalize_cues",
    "catalog_find", "search_bins", "relink_candidates", "item_closure", "nest_cycles", "razor", "ripple_delete_ranges", "bulk_trim", "join_through_edits", "multicam_record",
    "rms_envelope", "integrated_loudness", "peak_levels", "keyframe_values", "vectorscope_peaks", "scene_cuts", "best_jumps", "audio_offsets", "log_runs", "stream_log_runs", "changes_debounced", "scan_ale",
]


@pytest.fixture(scope="module")
def con():
    return oracle.connect(D)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    fn, sql = load()[name]
    ok, n, got, want, _, _ = oracle.compare(spark, con, D, fn, sql)
    assert ok, (list((got - want).items())[:3], list((want - got).items())[:3])


def test_every_query_is_registered_with_a_callable():
    reg = load()
    assert len(reg) > 140 and all(callable(f) for f, _ in reg.values())
