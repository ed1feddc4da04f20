"""Simple-8b files: exact round trips, and ids equal to those of whole texts."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm import simple8b, token_files
from tickloom.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def whole():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("n", [0, 1, 59, 60, 4095, 4096, 4097, 20_000])
@pytest.mark.parametrize("most", [1, 2, 1 << 15, 1 << 16, 1 << 30, 1 << 60, 1 << 64])
def test_packing_round_trip(n, most):
    rng = random.Random(n + most)
    ids = np.array([rng.randrange(most) if rng.random() < 0.3 else rng.randrange(min(most, 40)) for _ in range(n)], np.uint64)
    words, first, escapes, first_escape = simple8b.pack(ids)
    assert np.array_equal(simple8b.unpack(words, first, escapes, n), ids)
    assert first[-1] == len(words) and first_escape[-1] == len(escapes) == int((ids >> np.uint64(60) > 0).sum())
    # every word takes as many ids as fit: none is longer than the greedy loop's
    at, count = 0, 0
    while at < n:
        end = min((at // 4096 + 1) * 4096, n)
        fits = [c for c, b in simple8b.LANES[2:] if max(int(x) for x in ids[at : min(at + c, end)]) < 1 << b]
        at = min(at + max(fits, default=1), end)
        count += 1
    assert count == len(words)


def test_files_read_any_range_and_notice_damage(tmp_path):
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 9000, 40)
    ids = rng.integers(0, 50_000, counts.sum()).astype(np.uint64)
    ids[5] = 1 << 63
    out = io.BytesIO()
    out.close, w = lambda: None, token_files.Writer(out)
    for k in range(0, 40, 7):
        a, b = counts[:k].sum(), counts[: k + 7].sum()
        w.add([None if i == 3 else i for i in range(k, min(k + 7, 40))], counts[k : k + 7], ids[a:b])
    w.close()
    data = out.getvalue()
    r = token_files.Reader(io.BytesIO(data), len(data))
    assert r.counts.tolist() == counts.tolist() and r.docs == [None if i == 3 else i for i in range(40)]
    for a, b in ((0, len(ids)), (0, 0), (1, 2), (4095, 4097), (len(ids) - 1, len(ids)), (70_000, 90_001)):
        assert np.array_equal(r.read(a, b), ids[a:b])
    assert zlib.crc32(data[: -token_files.TRAILER.size]) == r.crc
    for bad in (data[:-1], data[:100], b"x" + data[1:]):
        with pytest.raises(ValueError):
            token_files.Reader(io.BytesIO(bad), len(bad))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab Z9é.,;:!?'\"-\n\t\r\x0b\x1c\x1f\x85\xa0　​漢🙂s t"), max_size=40))
def test_pieces_give_the_ids_of_whole_texts(text):
    cache = test_pieces_give_the_ids_of_whole_texts.cache
    counts, ids = cache.encode([text, "", text])
    want = cache.tokenizer.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want + want and counts.tolist() == [len(want), 0, len(want)]


test_pieces_give_the_ids_of_whole_texts.cache = token_files.PieceCache(PATH)


def test_learning_a_piece_copies_no_other(monkeypatch):
    """The arrays of the pieces double when full, and pieces beyond the limit leave room for later ones."""
    cache, words = token_files.PieceCache(PATH), [f"w{k}q" for k in range(3000)]
    grown = []
    for w in words:
        pool = cache.pool
        _, ids = cache.encode([w])
        grown += [1] if cache.pool is not pool else []
        assert ids.tolist() == cache.tokenizer.encode(w, add_special_tokens=False).ids
    assert len(grown) < 20
    monkeypatch.setattr(token_files, "REMEMBERED", 3000)
    for text in ("new words here", "others come now", words[7] + " new"):
        assert cache.encode([text])[1].tolist() == cache.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(cache.places) == 3000


def brute(rows):
    t, out, start = whole(), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_registered_query_on_the_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op12_simple8b_tokens"][0](spark, d).collect()))
    assert got == brute(rows)


def test_nulls_ties_long_texts_and_clashing_columns(spark, tmp_path, monkeypatch):
    rows = [(5, "five <|endoftext|> it's"), (-3, "minus"), (9, None), (7, ""), (8, "word. " * 60_000), (11, "x" * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).select("*", *[F.lit(1).alias(c) for c in ("id", "h", "tie", "t", "start", "file")])
    files = token_files.write(df, str(tmp_path / "a"), token_files.bpe(PATH), 2)
    assert sorted(map(tuple, token_files.read(files, str(tmp_path / "a"), part=1000).collect()), key=lambda r: r[1]) == brute(rows)
    again = spark.createDataFrame([(None, "a")] * 3 + [(None, "b c")] + [(4, "same")] * 50, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, token_files.token_files(again, str(tmp_path / "b"), PATH).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None] * 4 + [4] * 50 and got[-1][1] + got[-1][2] == sum(r[2] for r in got)
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in brute([(0, "a")] * 3 + [(0, "b c")] + [(4, "same")] * 50))
    none = token_files.token_files(again.where("false"), str(tmp_path / "c"), PATH)
    assert none.collect() == [] and none.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_files_split_and_hold_the_format(spark, tmp_path):
    docs = spark.range(300).selectExpr("id as doc_id", "repeat(concat('some text ', id, ' '), 20) as text")
    folder = str(tmp_path / "f")
    files = token_files.write(docs, folder, token_files.bpe(PATH), 2).orderBy("start").collect()
    assert sum(f["n_docs"] for f in files) == 300 and [f["start"] for f in files] == np.cumsum([0, *[f["n_ids"] for f in files]])[:-1].tolist()
    for f in files:
        data = (tmp_path / "f" / f["file"]).read_bytes()
        r = token_files.Reader(io.BytesIO(data), len(data))
        assert r.n == f["n_ids"] and r.docs == sorted(r.docs) and r.read(r.n - 1, r.n)[0] == 2
