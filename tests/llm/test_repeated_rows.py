"""Sharding and mixing where many rows repeat both id and text."""

from tickloom.llm import sharding


def test_repeated_rows_are_spread_over_the_shards(spark, tmp_path):
    rows = [(k, f"text {k} " * (k % 7 + 1)) for k in range(3000)] + [(None, "the same copied text, again and again")] * 1500
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    s = sharding.shard(df, str(tmp_path / "m"), shards=40).select("doc_id", "text", "size", "shard", "slot").collect()
    assert sorted((str(r.doc_id), r.text) for r in s) == sorted((str(i), t) for i, t in rows)
    load, places = [0] * 40, [[] for _ in range(40)]
    for r in s:
        load[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places)
    mean = sum(load) / 40
    assert max(load) - mean <= max(0.01 * mean, max(r.size for r in s)) and mean - min(load) <= max(0.01 * mean, max(r.size for r in s))
