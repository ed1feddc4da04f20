"""The near-duplicate stage against all pairs by brute force."""

import random
from pathlib import Path

import numpy as np
from test_corpus import prose

import corpus_pipeline
from tickloom.llm import near_copies


def brute_kept(rows):
    texts = [tuple((t or "").lower().split()) for _, t in rows]
    sets = [{w[i : i + 5] for i in range(max(1, len(w) - 4))} if w else {()} for w in texts]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), 1 << 60), i)
    return sorted(least.values())


def rows():
    rng, out = random.Random(3), [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "a b c d e f g h"), (7, "a b c d e f g h i")]
    for k in range(12):
        base = prose(f"base{k}", 150 if k else 400).split()
        for _ in range(10 if k else 60):
            copy = list(base)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(len(copy))] = f"x{rng.random()}"
            out.append((len(out), " ".join(copy)))
    shared = prose("shared", 40)  # a passage of many texts that are not alike
    return out + [(len(out) + k, f"{shared} {prose(f'own{k}', 60)}") for k in range(60)]


def test_stage_equals_all_pairs(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = sorted(r[0] for r in corpus_pipeline.drop_copies(spark, df, "").select("doc_id").collect())
    assert got == brute_kept(data)


def test_repeated_rows_and_null_ids_leave_one(spark):
    t = prose(1, 100)
    df = spark.createDataFrame([(None, t), (None, t), (8, t + " end"), (8, t + " end"), (9, prose(2, 50))], "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.drop_copies(spark, df, "").collect())) == [(8, t + " end"), (9, prose(2, 50))]


def test_stage_leaves_no_tables_and_moves_no_documents(spark):
    """Signatures (8 bytes each) must not stay in the shared folder, and documents are compared with the few dropped ones where they lie."""
    from tickloom.session import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    data = [(k, prose(k // 2, 20_000) + " x" * (k % 2)) for k in range(40)]
    df, before = spark.createDataFrame(data, "doc_id long, text string").repartition(3), size()
    out = corpus_pipeline.drop_copies(spark, df, "")
    assert size() - before < 40 * 8000 * 8 / 2
    assert out.count() == 20 and sorted(r[0] for r in out.select("doc_id").collect()) == list(range(0, 40, 2))
    assert "SortMergeJoin" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "BroadcastHashJoin" in plan


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(9)
    common = np.sort(rng.integers(0, 1 << 62, 30).astype(np.uint64))
    counts = rng.integers(3, 50, 30)
    for _ in range(3000):
        both = int(rng.integers(1, 60))
        own = [int(rng.integers(0, max(both // 4, 0) + 1)) for _ in range(2)]
        if 5 * both < 4 * (both + sum(own)):
            continue
        shared = rng.integers(0, 1 << 62, both).astype(np.uint64)
        shared[: min(both, 10)] = common[rng.integers(0, 30, min(both, 10))]
        a, b = (np.unique(np.concatenate([shared, rng.integers(0, 1 << 62, k).astype(np.uint64)])) for k in own)
        inter = len(np.intersect1d(a, b))
        if 5 * inter >= 4 * (len(a) + len(b) - inter):
            assert np.intersect1d(near_copies.signatures_of(a, common, counts), near_copies.signatures_of(b, common, counts)).size
