"""Removal of repeated word passages by compaction of a de Bruijn graph of word k-mers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.repeats import Kept, Rows, anchors, covered, cut, repeated, row_key, with_lists, word_codes
from tickloom.llm.text import span_hash

#: Words of a passage, and of the k-mers that are the edges of the graph.
PASSAGE = 35
KMER = 12


def repeated_passages(docs: DataFrame, window: int = PASSAGE, k: int = KMER) -> DataFrame:
    """(rk, text as binary) -> (rk, start, stop): ranges of words whose union is all words in repeated windows.

    Edges of the graph are k-mers of words; of all k-mers those are taken that some window of ``window`` words owns (see
    ``anchors``), so that two equal windows own the same edge. Edges that occur once are dropped. The string from one
    edge of a text to the next is the link between them. A link is compact if every occurrence of its first edge goes
    on with it and every occurrence of its second edge is preceded by it: then all texts with one of the edges hold
    the whole nonbranching path. Paths are read off in the source coordinates of each text; windows within a path are
    repeated because its edges are. Windows that cross a branch or a path's end are compared by their words; as paths
    are the same wherever their edges occur, the equals of such a window cross a branch too, so nothing is missed.
    """
    kept = Kept(docs)

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = Rows("h", "rk", "p", "left", "right")
        for b in batches:
            for rk, text in zip(b["rk"], b["text"], strict=True):
                codes = word_codes(text) if text is not None else []
                if len(codes) < window:
                    continue
                for own, h, _, _, sums, at in anchors(codes, window, k):
                    # a gram that owns two runs of windows is one edge
                    new = np.concatenate(([True], own[1:] != own[:-1]))
                    own, h = own[new], h[new]
                    link = span_hash(sums, own[:-1], own[1:] + k).view(np.int64)
                    if rows.add(len(h), h.view(np.int64), rk, own + at, np.concatenate(([0], link)), np.concatenate((link, [0]))):
                        yield rows.take()
        yield rows.take()

    all_edges = kept.keep(docs.mapInPandas(edges, "h long, rk long, p int, left long, right long"), "edges")
    twice = repeated(kept, "twice", all_edges, "h", ["rk", "p"])
    kept.drop("edges")
    # an edge goes straight on to a side if all its occurrences do so with one link (0: the text ends there)
    side = lambda c: (F.min(c) == F.max(c)) & (F.min(c) != 0)
    straight = twice.groupBy("h").agg(side("left").alias("in_one"), side("right").alias("out_one")).where("in_one or out_one")
    # a written table, so that a skewed side of the join can be split at run time
    straight = kept.keep(straight, "straight")
    flagged = twice.select("h", "rk", "p").join(straight, "h", "left").select("rk", F.col("p").cast("long").alias("p"), (F.when(F.col("in_one"), 1).otherwise(0) + F.when(F.col("out_one"), 2).otherwise(0)).cast("long").alias("flag"))
    have, _ = with_lists(docs, flagged, ["p", "flag"])

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = Rows("w", "rk", "p", "n")
        for b in batches:
            for rk, text, at_p, at_flag in zip(b["rk"], b["text"], b["f_p"], b["f_flag"], strict=True):
                codes = word_codes(text)
                p, first = np.unique(at_p, return_index=True)
                flag = at_flag[first]
                edge = np.zeros(len(codes), bool)
                edge[p] = True
                every = np.unique(np.concatenate([own + at for own, _, _, _, _, at in anchors(codes, window, k)]))
                # neighbours in the graph: repeated edges with no other edge of the text between them
                rank = np.searchsorted(every, p)
                compact = (rank[1:] == rank[:-1] + 1) & ((flag[:-1] & 2) > 0) & ((flag[1:] & 1) > 0)
                head = np.flatnonzero(np.concatenate(([True], ~compact)))
                tail = np.concatenate((head[1:], [len(p)])) - 1
                start, stop = p[head], p[tail] + k
                long = stop - start >= window
                start, stop = start[long], stop[long]
                full = rows.add(len(start), 0, rk, start, stop - start)
                # windows that own a repeated edge and lie in no path
                inside = covered(len(codes), start, stop - window + 1)
                for own, _, lo, n, sums, at in anchors(codes, window, k):
                    ok = edge[own + at]
                    lo, n = lo[ok], n[ok]
                    w = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    w = w[~inside[w + at]]
                    full = rows.add(len(w), span_hash(sums, w, w + window).view(np.int64), rk, w + at, 0)
                if full:
                    yield rows.take()
        yield rows.take()

    # rows that repeat another have its key: their windows are counted for each
    found = kept.keep(have.select("rk", "text", "f_p", "f_flag").mapInPandas(paths, "w long, rk long, p int, n int"), "found")
    kept.drop("twice")
    whole = found.where("n > 0").select("rk", F.col("p").alias("start"), (F.col("p") + F.col("n")).alias("stop"))
    crossing = repeated(kept, "crossing", found.where("n = 0").select("w", "rk", "p"), "w", ["rk", "p"])
    return whole.union(crossing.select("rk", F.col("p").alias("start"), (F.col("p") + window).alias("stop")))


def strip_passages(docs: DataFrame, window: int = PASSAGE, k: int = KMER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kept, n_words, n_removed): every text without the words that a repeated window covers.

    A window is ``window`` consecutive words ``[^\\x20\\x09-\\x0D]+`` of a text, repeated if its words also start
    anywhere else, in the same text or another. ``kept`` holds the remaining words, joined by one space. Null and empty
    texts have no words; shorter texts stay whole; rows that repeat another lose every window; null ids are carried;
    other columns are ignored.
    """
    d = docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("rk"), F.col(text_col).cast("binary").alias("text"))
    spans = repeated_passages(d.select("rk", "text"), window, k)

    def render(text: bytes, start: np.ndarray, stop: np.ndarray) -> tuple:
        words = text.split()
        gone = covered(len(words), start, stop)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g) if gone.any() else b" ".join(words)
        return kept, len(words), int(gone.sum())

    return cut(d, spans, render, "kept binary, n_words long, n_removed long")
