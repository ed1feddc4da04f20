"""The Merkle manifest against a plain Python tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tickloom.llm import merkle
from tickloom.llm.numbering import numbered


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """(root, [siblings of each leaf from the bottom up])."""
    proofs, place, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, p in enumerate(place):
            run = range(p // 3 * 3, min(p // 3 * 3 + 3, len(level)))
            proofs[k].append(([level[i] for i in run if i < p], [level[i] for i in run if i > p]))
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
        place = [p // 3 for p in place]
    return level[0], proofs


def brute(rows):
    """rows of (doc_id, source, lang, n_chars, text) -> sorted result rows."""
    def leaf(r, text):
        return h(*map(field, (*r[:4], text)))

    groups = {}
    for r in rows:
        odd = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        changed = r[4].replace("\n", "") if odd and r[4] is not None else r[4]
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), leaf(r, changed), r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = [(sorted(groups[s]), tree([x[2] for x in sorted(groups[s])])) for s in names]
    root, tops = tree([sub for _, (sub, _) in subs])
    out = []
    for (leaves, (sub, proofs)), top in zip(subs, tops, strict=True):
        for x, proof in zip(leaves, proofs, strict=True):
            claim = x[3]
            for before, after in proof + top:
                claim = h(*before, claim, *after)
            siblings = "".join("".join(b + a) for b, a in proof + top)
            out.append((str(x[4]), x[2], sub, root, h(siblings), claim, claim == root))
    return sorted(out)


def check(spark, tmp_path, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    if extra:
        df = df.select("*", *[F.lit("x").alias(c) for c in ("g", "tree", "pos", "digest", "claim", "key", "id", "leaf")])
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    m = merkle.manifest(df, str(tmp_path / "m"), found={"text": F.when(odd, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})
    got = merkle.check(m).collect()
    return m, sorted((str(r["id"]), r["leaf"], r["subroot"], r["root"], r["proof"], r["folded"], r["verified"]) for r in got)


def test_equals_a_plain_tree(spark, tmp_path):
    rows = [(k, f"s{k % 3}" if k % 5 else "hot", "en", k, f"line {k}\nnext é\n") for k in range(90)]
    rows += [(None, None, None, None, None), (None, "hot", "en", 1, ""), (200, "", "en", None, "no break"), (201, "one", "en", 2, "a\nb"), (202, "ü", None, 3, "long " * 50_000)]
    rows += [(7, "hot", "en", 1, "same\n")] * 7 + [(8, "s1", "de", 1, "tie a\n"), (8, "s1", "de", 1, "tie b\n")]
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    m, got = check(spark, tmp_path, rows, extra=True)
    assert got == brute(rows) and {True, False} == {r[-1] for r in got}
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == limit
    # node rows: every inner node but the root links to a parent that is there, or to the root
    nodes = m.nodes.collect()
    places = {(r["tree"], r["level"], r["pos"]) for r in nodes}
    up = {(r["p_tree"], r["p_level"], r["p_pos"]) for r in nodes} | {(r["p_tree"], r["p_level"], r["p_pos"]) for r in m.leaves.collect()}
    assert len(up - places) == 1 and places <= up | places


@pytest.mark.parametrize("rows", [[(1, "a", "en", 1, "x\ny")], [(k, "a", "en", 1, "x") for k in range(4)], [(k, f"s{k}", "en", 1, "x") for k in range(4)], [(None, None, None, None, None)] * 5])
def test_single_trees_and_lone_leaves(spark, tmp_path, rows):
    assert check(spark, tmp_path, rows)[1] == brute(rows)


def test_empty_table(spark, tmp_path):
    m, got = check(spark, tmp_path, [])
    assert got == [] and m.root is None


def test_numbers_are_consecutive_with_many_equal_rows(spark, tmp_path):
    df = spark.createDataFrame([(None if k % 3 == 0 else k % 7, "a") for k in range(3000)], "k long, v string").repartition(5)
    rows = sorted((r["n"], -1 if r["k"] is None else r["k"]) for r in numbered(df, ["k"], "n", str(tmp_path / "n")).collect())
    assert [r[0] for r in rows] == list(range(3000)) and [r[1] for r in rows] == sorted(r[1] for r in rows)
