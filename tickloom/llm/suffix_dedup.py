"""Removal of repeated byte strings by prefix doubling over sampled positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.repeats import Kept, Rows, anchors, byte_codes, covered, cut, joined_anchors, listed, repeated, row_key, with_lists
from tickloom.llm.text import mix, prefix_sums, span_hash

U64 = np.uint64
#: Lengths at which positions are named. At the last one, the threshold, every position left has a name of its own.
LENGTHS = (50, 180, 200)
#: Pieces of texts that are named together.
PORTION = 1024


def _join(a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
    """One name for a pair of names."""
    return mix(np.asarray(a).astype(np.int64).view(U64) * U64(0x9E3779B97F4A7C15) + b.view(U64)).view(np.int64)


def repeated_spans(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """(rk, text as binary) -> (rk, start, stop): ranges whose union is all bytes in repeated strings of ``lengths[-1]``.

    Prefix doubling names the strings at ever greater lengths and drops a position as soon as its name is unique. Naming
    every byte's position would shuffle each byte as a row many times, so a name is given to a sampled position of each
    window (see ``anchors``): windows of the threshold that are equal own equal grams at equal places, so a window is
    repeated only if the gram it owns is. In round 1 grams of ``lengths[0]`` bytes are sorted and unique ones dropped.
    Windows that own one gram make a class by their whole content: a class that occurs twice is repeated in all its
    windows; a class that is alone with its gram is done; what is left, one representative of each class of a gram with
    several, is named again at the next length within the same gram, and at last at the threshold, where each window
    is its own class. Equal names stand for equal ranks: only their equality is used. Names are 64-bit hashes; two
    windows are taken for equal if both the gram and the content agree.
    """
    window, k1, k2 = lengths[-1], lengths[0], lengths[1]
    kept = Kept(docs)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = Rows("h", "c", "lo", "n", "rk")
        for b in batches:
            for rk, text in zip(b["rk"], b["text"], strict=True):
                if text is not None and len(text) >= window:
                    for own, h, lo, n, sums, at in anchors(byte_codes(text), window, k1):
                        if rows.add(len(own), h.view(np.int64), span_hash(sums, lo, lo + n - 1 + window).view(np.int64), lo + at, n, rk):
                            yield rows.take()
        yield rows.take()

    named = kept.keep(docs.mapInPandas(first, "h long, c long, lo int, n int, rk long"), "named")
    twice = repeated(kept, "grams", named, "h", ["rk", "lo"])
    kept.drop("named")
    # classes: the content of all windows that own a gram
    known = kept.keep(twice.groupBy("h", "c").agg(F.count("*").alias("times"), F.min(F.struct("rk", "lo", "n")).alias("at")), "classes")
    several = known.groupBy("h").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select(F.col("h").alias("s_h"))
    # a class that occurs twice: every occurrence is repeated
    sure = repeated(kept, "sure", twice.withColumn("hc", F.xxhash64("h", "c")).select("hc", "rk", "lo", "n"), "hc", ["rk", "lo"]).select("rk", F.col("lo").alias("start"), (F.col("lo") + F.col("n") - 1 + window).alias("stop"))
    kept.drop("grams")
    open_ = known.join(several, F.col("h") == F.col("s_h"), "left_semi").select("h", "at.rk", "at.lo", "at.n", (F.col("times") > 1).alias("many"))
    have, _ = with_lists(docs, open_, ["h", "lo", "n", "many"])

    def sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, pieces = Rows("rk", "h", "lo", "n", "many"), []
        for b in batches:
            for rk, text, h, lo, n, many in zip(b["rk"], b["text"], b["f_h"], b["f_lo"], b["f_n"], b["f_many"], strict=True):
                pieces += [text[p:q] for p, q in zip(lo.tolist(), (lo + n - 1 + window).tolist(), strict=True)]
                rows.add(len(h), rk, h, lo, n, many)
                if len(pieces) > 8192:
                    yield rows.take().assign(piece=pieces)
                    pieces = []
        yield rows.take().assign(piece=pieces)

    piece = kept.keep(have.select("rk", "text", "f_h", "f_lo", "f_n", "f_many").mapInPandas(sliced, "rk long, h long, lo int, n int, many long, piece binary"), "pieces")

    def parts(b: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
        """A batch of pieces in portions: the rows, the codes of their pieces end to end, and the pieces' sizes."""
        for i in range(0, len(b), PORTION):
            x = b.iloc[i : i + PORTION]
            yield x, byte_codes(b"".join(x["piece"])), np.fromiter(map(len, x["piece"]), np.int64, len(x))

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x, codes, size in parts(b):
                which, h, at, n, c = joined_anchors(codes, size, x["n"].to_numpy(), window, k2)
                up = x["h"].to_numpy()[which]
                yield pd.DataFrame({"h": _join(up, h), "c": _join(up, c), "rk": x["rk"].to_numpy()[which], "base": x["lo"].to_numpy()[which], "at": at, "n": n, "many": x["many"].to_numpy()[which]})

    again = kept.keep(piece.mapInPandas(second, "h long, c long, rk long, base int, at int, n int, many long"), "again")
    sure2 = repeated(kept, "sure2", again.withColumn("hc", F.xxhash64("h", "c")).select("hc", "rk", "base", "at", "n", "many"), "hc", ["rk", "base", "at"]).where("many = 0")
    sure2 = sure2.select("rk", (F.col("base") + F.col("at")).alias("start"), (F.col("base") + F.col("at") + F.col("n") - 1 + window).alias("stop"))
    known2 = again.groupBy("h", "c").agg(F.count("*").alias("times"), F.max("many").alias("many"), F.min(F.struct("rk", "base", "at", "n")).alias("p"))
    several2 = known2.groupBy("h").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select(F.col("h").alias("s_h"))
    open2 = known2.join(several2, F.col("h") == F.col("s_h"), "left_semi").select("h", "p.rk", "p.base", "p.at", "p.n", F.when(F.col("times") > 1, 1).otherwise(F.col("many")).alias("many2"))
    lists = open2.withColumnRenamed("many2", "many").groupBy(F.col("rk").alias("l_rk"), F.col("base").alias("l_base")).agg(*listed(["h", "at", "n", "many"]))
    left = piece.join(lists, (F.col("rk") == F.col("l_rk")) & (F.col("lo") == F.col("l_base"))).dropDuplicates(["rk", "lo"]).select("rk", "lo", "piece", "f_h", "f_at", "f_n", "f_many")

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x, codes, size in parts(b):
                sums, each = prefix_sums(codes), x["f_h"].map(len).to_numpy()
                h, at, n, many = (np.concatenate(x[c].to_list()) for c in ("f_h", "f_at", "f_n", "f_many"))
                which = np.repeat(np.repeat(np.arange(len(x)), each), n)
                p = np.repeat(at, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                q = (np.cumsum(size) - size)[which] + p
                yield pd.DataFrame({"w": _join(np.repeat(h, n), span_hash(sums, q, q + window)), "rk": x["rk"].to_numpy()[which], "p": p + x["lo"].to_numpy()[which], "many": np.repeat(many, n)})

    windows = kept.keep(left.mapInPandas(last, "w long, rk long, p int, many long"), "windows")
    sure3 = repeated(kept, "sure3", windows, "w", ["rk", "p"]).where("many = 0").select("rk", F.col("p").alias("start"), (F.col("p") + window).alias("stop"))
    return sure.union(sure2).union(sure3)


def strip_repeats(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kept, n_bytes, n_removed, n_spans): every text without the bytes that a repeated string covers.

    A string of ``lengths[-1]`` bytes is repeated if it also starts anywhere else, in the same text or another. ``kept``
    holds the remaining bytes concatenated, ``n_spans`` counts the maximal removed runs. Null and empty texts have no
    bytes; texts shorter than the threshold stay whole; rows that repeat another lose everything they share; null ids
    are carried; other columns are ignored; texts of any length are read in blocks of a million windows.
    """
    d = docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("rk"), F.col(text_col).cast("binary").alias("text"))
    spans = repeated_spans(d.select("rk", "text"), lengths)

    def render(text: bytes, start: np.ndarray, stop: np.ndarray) -> tuple:
        gone = covered(len(text), start, stop)
        raw = np.frombuffer(text, np.uint8)
        runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and bool(gone[0])))
        return raw[~gone].tobytes(), len(raw), int(gone.sum()), runs

    return cut(d, spans, render, "kept binary, n_bytes long, n_removed long, n_spans long")


