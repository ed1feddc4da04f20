"""Corpus operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tickloom.llm import decontaminate, mixing, quality_model, quality_rules, secrets, sharding, simhash, substring_dedup, suffix_dedup, toxicity
from tickloom.llm.components import components
from tickloom.llm.text import held_out, word_count

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp string, rk string, id string, h string, u string, shard string, k string, found string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega año für".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(n))


def rows():
    passage, leak = prose("passage", 60), prose("leak", 30)
    out = [(1, prose(1, 300)), (2, prose(1, 300)), (3, prose(3, 250) + " " + passage + " tail"), (4, passage + "\n" + prose(4, 80)), (5, None), (6, ""), (7, " \t\n "), (None, prose(8, 90)), (None, None)]
    near = prose(9, 400).split()
    out += [(10, " ".join(near)), (11, " ".join(near[:200] + ["changed"] + near[201:])), (12, prose(12, 40) + " " + leak.upper() + ". " + prose(13, 40)), (13, "one"), (14, "one two"), (14, "one two"), (15, "a\x0bb\x0cc  d")]
    out += [(16, prose(16, 9000)), (17, "same " * 300), (18, prose(17, 200) + " " + leak + " " + prose(3, 250)), (19, "ñ" * 500), (20, "tie"), (21, "tie")]
    return [(i, t, "en", None if (i or 0) % 5 == 4 else f"s{(i or 0) % 3}", 0, -1, "x", "y", "z", "h", "u", "sh", "k", "f") for i, t in out], leak


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows()[0], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def test_word_count(docs):
    got = bag(docs.select("text", word_count(F.col("text"))))
    assert got == Counter((r[1], len((r[1] or "").encode().split())) for r in rows()[0])


def test_components_find_smallest_nodes(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(80)] + [(5, 5), (None, 3)] + [(2000, 2000 + i) for i in range(1, 90)]
    root = {}

    def top(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in links:
        if a is not None:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    got = dict(components(spark.createDataFrame(links, "u long, v long")).collect())
    want = {n: top(n) for n in root if any(n in p and p[0] != p[1] for p in links if p[0] is not None)}
    assert {**{n: n for n in want}, **got} == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- sharding


def test_shards_are_even_and_slots_gapless(spark, docs, none, tmp_path):
    s = sharding.shard(docs, str(tmp_path / "map"), shards=3, slots=64)
    got = s.select("doc_id", "text", "size", "vslot", "shard", "slot").collect()
    assert Counter((r[0], r[1], r[2]) for r in got) == Counter((r[0], r[1], len((r[1] or "").encode()) + 16) for r in rows()[0])
    places, shard_of = defaultdict(list), {}
    for r in got:
        places[r.shard].append(r.slot)
        assert shard_of.setdefault(r.vslot, r.shard) == r.shard and 0 <= r.vslot < 64
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert bag(s.select("doc_id", "slot", "shard")) == bag(sharding.shard(docs, str(tmp_path / "again"), shards=3, slots=64).select("doc_id", "slot", "shard"))
    assert sharding.shard(none, str(tmp_path / "none"), shards=3, slots=8).count() == 0


def test_map_versions_move_few_slots(spark, tmp_path):
    rng = random.Random(2)
    load = [(i, rng.randrange(1, 1000)) for i in range(512)]
    old = sharding.assign(load, 8)
    total = sum(b for _, b in load)
    per = Counter()
    for s, b in load:
        per[old[s]] += b
    assert max(per.values()) < 1.01 * total / 8
    new = sharding.rebalance(old, load, 9)
    per = Counter()
    for s, b in load:
        per[new[s]] += b
    assert len(per) == 9 and max(per.values()) < 1.03 * total / 9
    assert sum(b for s, b in load if new[s] != old[s]) < 1.2 * total / 9
    assert set(sharding.rebalance(old, load, 7).values()) == set(range(7))
    m = sharding.SlotMap(spark, str(tmp_path / "m"))
    df = spark.createDataFrame([(s, 1, b) for s, b in load], "vslot long, n long, bytes long")
    m.write(1, 8, df)
    m.write(2, 9, df, m.shards_of(1))
    assert m.shards_of(1) == old and m.shards_of(2) == new


# --- mixing


def filled(sizes, weights, most):
    """Water-filling as a loop: share, stop, share the excess again."""
    total, target, open_ = sum(sizes.values()), {}, set(sizes)
    left = total
    while open_:
        wt = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / wt > most * sizes[s]}
        if not over:
            return target | {s: left * weights[s] / wt for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= most * sizes[s]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 10, 1000, 50_000]) for i in range(12)}
    weights = {s: rng.randint(1, 40) for s in sizes}
    df = spark.createDataFrame([(s, sizes[s], weights[s]) for s in sizes], "source string, source_size long, weight long")
    want = filled(sizes, weights, 3)
    for r in mixing.targets(df).collect():
        assert r.target == pytest.approx(want[r.source], rel=1e-12)


def test_mix_meets_targets(spark, docs, none):
    got = mixing.mix(docs).collect()
    sizes, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in got:
        assert r["size"] >= 0 and r.taken == r.times * r["size"] and r.taken <= 3 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r["size"])
    order = sorted(sizes, key=lambda s: (s is None, s))
    want = filled(sizes, {s: 1 + i % 3 for i, s in enumerate(order)}, 3)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= largest[s]
    assert bag(mixing.mix(docs)) == Counter(tuple(r) for r in got)
    times = Counter()
    for r in got:
        times[r.doc_id, r["size"]] += r.times
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    n = Counter((r.doc_id, len((r.text or "").encode().split())) for r in out.collect())
    assert n == Counter({k: v for k, v in times.items() if v})
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


# --- near duplicates


def brute_print(text, shingle):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] if len(w) >= shingle else [b" ".join(w)] if w else []
    hs = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(prints, radius):
    """{fingerprint: smallest fingerprint reachable}"""
    left, root = set(prints), {}
    for p in sorted(prints):
        if p in left:
            left.discard(p)
            todo, root[p] = [p], p
            while todo:
                x = todo.pop()
                for y in [y for y in left if (x ^ y).bit_count() <= radius]:
                    left.discard(y)
                    root[y] = p
                    todo.append(y)
    return root


def test_simhash_groups(spark, docs, none):
    want_print = {(r[0], r[1]): brute_print(r[1], 3) for r in rows()[0]}
    root = brute_groups(set(want_print.values()), 3)
    least = {}
    for (i, _), p in want_print.items():
        if i is not None:
            least[root[p]] = min(least.get(root[p], i), i)
    got = bag(simhash.simhash_groups(docs).select("doc_id", simhash.hex16(F.col("fp")), "component_id"))
    assert got == Counter((r[0], f"{want_print[r[0], r[1]]:016x}", least.get(root[want_print[r[0], r[1]]])) for r in rows()[0])
    assert simhash.simhash_groups(none).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(v) for v in {root[p]: least.get(root[p]) for p in want_print.values()}.values())
    assert simhash.drop_near_duplicates(none).count() == 0


@pytest.mark.parametrize("shard", [8192, 64])
def test_shards_of_the_tree_lose_no_link(spark, shard):
    rng = random.Random(shard)
    prints = set()
    for _ in range(150):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            prints.add(p)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                p ^= 1 << b
    dense = rng.getrandbits(64)
    prints |= {dense ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(20)}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    links = simhash.near_pairs(df, 3, shard=shard, sample=300)
    n = links.count()
    root = dict(components(links).collect())
    want = {}
    for p, r in brute_groups(prints, 3).items():
        want.setdefault(r, set()).add(signed(p))
    got = defaultdict(set)
    for p in prints:
        got[root.get(signed(p), signed(p))].add(signed(p))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert n < 20 * len(prints)


# --- decontamination


def test_containment_equals_brute_force(spark, docs, none):
    leak = rows()[1]
    items = [(1, leak), (2, "One two"), (3, None), (4, ""), (5, prose(99, 30)), (6, " ".join(leak.split()[:20]) + " " + prose(98, 4)), (7, prose(3, 250)), (None, prose(8, 90))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, w string")
    split = lambda t: [w for w in __import__("regex").split(r"[^\p{L}\p{N}_]+", (t or "").lower()) if w]
    want = set()
    for i, t in items:
        w = split(t)
        n = min(5, len(w))
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for d in {(r[0], r[1]) for r in rows()[0]}:
            x = split(d[1])
            found = len(grams & {tuple(x[k : k + n]) for k in range(len(x) - n + 1)})
            if grams and found / len(grams) >= 0.8:
                want.add((d[0], i, found, len(grams)))
    cols = ["doc_id", "item_id", "n_found", "n_item"]
    for sent in (1_000_000, 0):
        assert bag(decontaminate.contained_items(docs, bench, sent=sent).select(cols)) == Counter(want)
    bad = {w[0] for w in want}
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter((r[0], r[1]) for r in rows()[0] if r[0] not in bad or r[1] is None)
    assert decontaminate.contained_items(none, bench).count() == 0
    assert decontaminate.contained_items(docs, bench.where("false")).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.where("false")).count() == docs.count()


# --- repeated passages


def brute_cut(units, window):
    seen = Counter()
    for u in units:
        for p in range(len(u) - window + 1):
            seen[u[p : p + window]] += 1
    out = []
    for u in units:
        gone = [False] * len(u)
        for p in range(len(u) - window + 1):
            if seen[u[p : p + window]] > 1:
                gone[p : p + window] = [True] * window
        out.append(gone)
    return out


def test_repeated_bytes_equal_brute_force(spark, docs, none):
    texts = [(r[1] or "").encode() for r in rows()[0]]
    want = Counter()
    for r, t, gone in zip(rows()[0], texts, brute_cut(texts, 200), strict=True):
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want[r[0], len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()] += 1
    got = suffix_dedup.strip_repeats(docs).select("id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert bag(got) == want
    assert suffix_dedup.strip_repeats(none).count() == 0


def test_repeated_words_equal_brute_force(spark, docs, none):
    texts = [tuple((r[1] or "").encode().split()) for r in rows()[0]]
    want = Counter()
    for r, t, gone in zip(rows()[0], texts, brute_cut(texts, 35), strict=True):
        want[r[0], len(t), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(t, gone, strict=True) if not g)).hexdigest()] += 1
    got = substring_dedup.strip_passages(docs).select("id", "n_words", "n_removed", F.sha2("kept", 256))
    assert bag(got) == want
    assert substring_dedup.strip_passages(none).count() == 0


def test_short_windows_and_blocks(spark, monkeypatch):
    rng = random.Random(1)
    base = ["".join(rng.choice("ab") for _ in range(400)) for _ in range(5)]
    texts = [(i, rng.choice(base)[rng.randrange(200) :] + "".join(rng.choice("abc") for _ in range(60)) + rng.choice(base)[: rng.randrange(300)]) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    raw = [t.encode() for _, t in texts]
    for lengths in ((8, 20, 24), (5, 9, 30)):
        want = {i: sum(g) for (i, _), g in zip(texts, brute_cut(raw, lengths[-1]), strict=True)}
        assert dict(suffix_dedup.strip_repeats(df, lengths).select("id", "n_removed").collect()) == want
    spaced = df.select("doc_id", F.regexp_replace("text", "(..)", "$1 ").alias("text"))
    words = [tuple(r.text.encode().split()) for r in spaced.orderBy("doc_id").collect()]
    want = {i: sum(g) for (i, _), g in zip(texts, brute_cut(words, 12), strict=True)}
    assert dict(substring_dedup.strip_passages(spaced, 12, 4).select("id", "n_removed").collect()) == want


# --- quality rules


def test_rule_counts_equal_brute_force(spark, docs, none):
    want = Counter()
    for r in rows()[0]:
        t = r[1] or ""
        w = t.encode().split()
        lines = [x for x in t.encode().split(b"\n") if x.split()]
        n = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = set()
        for k in range(len(w) - 4):
            if n[tuple(w[k : k + 5])] > 1:
                hit |= set(range(k, k + 5))
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        want[r[0], len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed] += 1
    got = quality_rules.apply_rules(docs)
    assert bag(got.drop("kept")) == want
    assert all(not (r.base_failed and r.kept) for r in got.collect())
    assert quality_rules.apply_rules(none).count() == 0


def test_order_never_changes_the_verdict(spark, docs):
    names = list(quality_rules.RULES)
    a = bag(quality_rules.apply_rules(docs, order=names))
    assert a == bag(quality_rules.apply_rules(docs, order=names[::-1])) == bag(quality_rules.apply_rules(docs))
    order = quality_rules.cascade_order(docs)
    assert [r[1] / r[2] for r in order] == sorted((r[1] / r[2] for r in order), reverse=True)


# --- models


def judged(spark, n=900):
    """Texts with planted cues: junk has symbols, toxic texts have words of a made-up stem."""
    rng = random.Random(7)
    out = []
    for i in range(n):
        t = prose(f"m{i}", rng.randint(20, 200)).split()
        junk, toxic = rng.random() < 0.2, rng.random() < 0.15
        if junk:
            t = [w + "###" for w in t]
        if toxic:
            for _ in range(2 + len(t) // 50):
                t[rng.randrange(len(t))] = "zwick" + rng.choice(["el", "ung", "ster", "o"])
        out.append((i, " ".join(t), int(not junk), int(toxic)))
    out += [(n, None, 1, 0), (n + 1, "", 0, 1), (n + 2, "x", None, None), (None, "y", 1, 1), (1, out[1][1], out[1][2], out[1][3])]
    df = spark.createDataFrame(out, "doc_id long, text string, quality int, toxic int")
    return df.select("doc_id", "text", F.lit("x").alias("f"), F.lit(1).alias("y")), df.select("doc_id", "quality", "toxic").where("doc_id % 10 < 6 or doc_id is null")


def test_models_on_held_out_texts(spark, none):
    docs, labels = judged(spark)
    seen = labels.where(~held_out(F.col("doc_id")))
    truth = judged(spark)[1].where("doc_id < 900")
    for col, score in (("quality", quality_model.score(F.col("text"), quality_model.learn(docs, seen))), ("toxic", toxicity.score(F.col("text"), toxicity.learn(docs, seen)))):
        r = docs.select("doc_id", score.alias("s")).join(truth, "doc_id").where(held_out(F.col("doc_id"))).collect()
        right = sum((x.s >= 0.5) == (x[col] == 1) for x in r)
        assert len(r) > 60 and right / len(r) > 0.95, (col, right, len(r))
        every = docs.select("doc_id", score.alias("s")).collect()
        assert len(every) == docs.count() and all(0 <= x.s <= 1 for x in every)
    empty = labels.where("false")
    for m, learn in ((quality_model, quality_model.learn), (toxicity, toxicity.learn)):
        model = learn(none.select("doc_id", "text"), empty)
        assert docs.select(m.score(F.col("text"), model).alias("s")).where("s between 0 and 1").count() == docs.count()


def test_non_negative_risk_beats_calling_unlabelled_negative():
    rng = np.random.default_rng(1)
    make = lambda toxic: np.unique(np.concatenate([rng.integers(100, 900, 30), rng.choice(20, 3) if toxic else []]).astype(np.int32))
    pos = [make(True) for _ in range(120)]
    unl = [make(rng.random() < 0.3) for _ in range(800)]
    m = toxicity.fit(pos, unl, 0.3, bits=10)
    w = np.zeros(1 << 10)
    w[m["at"]] = m["w"]
    found = [float(w[f].sum() + m["b"]) > 0 for f in (make(True) for _ in range(200))]
    clean = [float(w[f].sum() + m["b"]) > 0 for f in (make(False) for _ in range(200))]
    assert sum(found) > 180 and sum(clean) < 20


def test_dual_descent_separates_and_bounds_multipliers():
    ratio = np.array([2.0, -2.0, 0.1, -0.1, 0.0])
    rows_ = [np.array([0, 2]), np.array([1, 2]), np.array([0, 3]), np.array([1, 3])] * 10
    y = np.array([1.0, -1.0, 1.0, -1.0] * 10)
    w = quality_model.dual_descent(rows_, y, ratio, np.ones(40))
    assert np.all(np.sign(quality_model.decide(rows_, w, ratio)) == y)


def test_secret_forest(spark, docs, none):
    rng = random.Random(5)
    token = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    out = []
    for i in range(300):
        kind = i % 4
        v = [token(40, "0123456789abcdef"), f"AKIA{token(16, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789')}", f"{token(5, 'abcdef')}.{i}@mail.example.com", f"4{token(15, '0123456789')}"][kind]
        out.append((i, f"{prose(i, 20)} {['token=', 'key: ', '', ''][kind]}{v} {prose(i + 1, 20)}", "src/a.py", kind < 2))
    df = spark.createDataFrame(out, "doc_id long, text string, source string, label boolean")
    found = secrets.findings(df)
    lab = found.join(df.select(F.col("doc_id").alias("id"), "label"), "id")
    forest = secrets.learn(lab.where("id < 200"), F.col("id"), trees=12)
    r = secrets.judge(lab.where("id >= 200"), forest).collect()
    assert len(r) == 100 and all((x.score >= 0.5) == x.label for x in r)
    for x in r:
        assert out[x.id][1].encode()[x.start : x.start + x.length].decode() == x.value
    assert secrets.findings(none).count() == 0
    assert secrets.judge(secrets.findings(docs), forest).where("score is null").count() == 0
    assert len(secrets.learn(lab.where("false"), F.col("id"))) == 1


def test_crc_matches_zlib(spark):
    assert spark.range(50).where(held_out(F.col("id"))).count() == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50))
