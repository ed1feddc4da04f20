"""Operators over word tables ``(sequence_id, idx, text, start, end, speaker)``.

``idx`` counts the words of a sequence from 0 without holes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tickloom.functions.text import normal, normal_str, tokens
from tickloom.functions.timebase import TPS, col, fdiv, idiv, round_half_away, scaled, snap, snap_nearest, snap_up
from tickloom.operators.intervals import merge_ranges, overlap_join
from tickloom.session import cut_lineage
from tickloom.operators.ordered import (
    INDEX_CHUNK, each_group, first_after, first_from, following, islands, last_upto, max_upto, orbit, prev, scan, sum_before, sum_upto,
)

KEY = ["sequence_id"]
# The default filler words.
FILLERS = ["um", "uh", "umm", "uhm", "erm", "er", "ah", "hmm", "mm", "mhm"]


def paragraphs(words: DataFrame, gap: int) -> DataFrame:
    """Runs of words split where the speaker changes or a pause is at least ``gap``."""
    w = scan(words, KEY, ["idx"], INDEX_CHUNK, pe=prev("end"), ps=prev("speaker"))
    fresh = F.col("pe").isNull() | ~F.col("speaker").eqNullSafe(F.col("ps")) | (F.col("start") - F.col("pe") >= gap)
    w = islands(w, KEY, ["idx"], fresh, chunk=INDEX_CHUNK)
    return w.groupBy(*KEY, "island").agg(
        F.min("idx").alias("first"), F.max("idx").alias("last"), F.min_by("start", "idx").alias("start"), F.max_by("end", "idx").alias("end"), F.max("speaker").alias("speaker")
    ).drop("island")


def _hits(words: DataFrame, phrases: Sequence[tuple[str, list[str]]], prefix: bool) -> DataFrame:
    """Positions where a phrase starts: each matching word votes for the start it would belong to."""
    votes = []
    for name, toks in phrases:
        for k, tok in enumerate(toks):
            same = F.col("_w").startswith(tok) if prefix and k + 1 == len(toks) else F.col("_w") == tok
            votes.append(F.when(same, F.struct(F.lit(name).alias("phrase"), F.lit(k).alias("k"), F.lit(len(toks)).alias("n"))))
    w = words.select(*KEY, "idx", normal("text").alias("_w")).select(*KEY, "idx", F.explode(F.array_compact(F.array(*votes))).alias("v"))
    at = w.groupBy(*KEY, F.col("v.phrase").alias("phrase"), F.col("v.n").alias("n"), (F.col("idx") - F.col("v.k")).alias("first")).agg(F.count("*").alias("_m"))
    return at.filter("_m = n").drop("_m")


def phrase_search(words: DataFrame, queries: Sequence[str]) -> DataFrame:
    """Hits of each query; its last word may be a prefix."""
    phrases = [(q, [t for t in map(normal_str, q.split()) if t]) for q in queries]
    hits = _hits(words, [p for p in phrases if p[1]], True)
    return hits.select(*KEY, F.col("phrase").alias("query"), "first", (F.col("first") + F.col("n") - 1).alias("last"))


def word_ranges(words: DataFrame, picks: DataFrame, ft) -> DataFrame:
    """Range of words a..b snapped outward to frames."""
    p = picks.select(*KEY, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = words.select(*KEY, F.col("idx").alias("a"), F.col("start").alias("_s"))
    last = words.select(*KEY, F.col("idx").alias("b"), F.col("end").alias("_e"))
    j = p.join(first, [*KEY, "a"]).join(last, [*KEY, "b"])
    s, e = snap("_s", ft), snap("_e", ft)
    e = F.when((e < F.col("_e")) | (e <= s), e + col(ft)).otherwise(e)
    return j.select(*KEY, "a", "b", s.alias("start"), e.alias("end"))


def find_pauses(words: DataFrame, least: int, keep: int, ft) -> DataFrame:
    """Silences to remove, keeping ``keep`` next to both words, snapped inward."""
    w = scan(words.select(*KEY, "idx", "start", "end"), KEY, ["idx"], INDEX_CHUNK, nx=following("start"))
    gap = F.col("nx") - F.col("end")
    out = w.filter((gap >= least) & (gap > 0)).select(*KEY, snap_up(F.col("end") + keep, ft).alias("start"), snap(F.col("nx") - keep, ft).alias("end"))
    return out.filter("end > start")


def find_fillers(words: DataFrame, ft, fillers: Sequence[str] = FILLERS) -> DataFrame:
    """Filler words and phrases, longest first and never overlapping, with their removal ranges."""
    phrases = [t for t in ([x for x in map(normal_str, f.split()) if x] for f in fillers) if t]
    best = _hits(words, [(" ".join(t), t) for t in phrases], False).groupBy(*KEY, "first").agg(F.max("n").alias("n"))
    best = cut_lineage(best)
    if max(map(len, phrases)) > 1:
        probe = best.select(*KEY, (F.col("first") + F.col("n")).alias("p"), F.lit(0).alias("k"), F.col("first").alias("me"), F.lit(None).cast("long").alias("at"))
        stops = best.select(*KEY, F.col("first").alias("p"), F.lit(1).alias("k"), F.lit(None).cast("long").alias("me"), F.col("first").alias("at"))
        seen = scan(probe.unionByName(stops), KEY, ["p", "k"], INDEX_CHUNK, nxt=first_from("at")).filter("k = 0")
        taken = orbit(seen.select(*KEY, F.col("me").alias("first"), "nxt"), KEY, "first", "nxt")
        best = best.join(taken, [*KEY, "first"], "left_semi")
    best = best.withColumn("last", F.col("first") + F.col("n") - 1)
    # a hit needs its own first and last word and the word on either side: one equi join
    asked = best.select(*KEY, "first", "last", F.posexplode(F.array(F.col("first") - 1, F.col("first"), F.col("last"), F.col("last") + 1)).alias("_k", "idx"))
    got = asked.join(words.select(*KEY, "idx", "start", "end"), [*KEY, "idx"])
    at = lambda k, c: F.max(F.when(F.col("_k") == k, F.col(c)))
    j = got.groupBy(*KEY, "first", "last").agg(at(0, "end").alias("pe"), at(1, "start").alias("_s"), at(2, "end").alias("_e"), at(3, "start").alias("ns"))
    s, e = snap_nearest("_s", ft), snap_nearest("_e", ft)
    s = F.when(F.col("pe") > s, snap("pe", ft) + col(ft)).otherwise(s)
    e = F.when(e > F.col("ns"), snap("ns", ft)).otherwise(e)
    return j.select(*KEY, "first", "last", s.alias("start"), e.alias("end")).filter("end > start")


def removable_time(words: DataFrame, least: int, keep: int, ft, fillers: Sequence[str] = FILLERS) -> DataFrame:
    """Pauses and fillers of each recording, merged, and what is left of it."""
    cut = cut_lineage(find_pauses(words, least, keep, ft).unionByName(find_fillers(words, ft, fillers).select(*KEY, "start", "end")))
    merged = merge_ranges(cut, KEY).groupBy(*KEY).agg(F.count("*").alias("ranges"), F.sum(F.col("end") - F.col("start")).alias("removed"))
    whole = words.groupBy(*KEY).agg(F.max("end").alias("length"))
    got = whole.join(merged, KEY, "left").na.fill(0, ["ranges", "removed"])
    return got.withColumn("left_over", F.col("length") - F.col("removed"))


def normalize_transcript(words: DataFrame, speakers: DataFrame | None = None, key: str = "item_id") -> DataFrame:
    """Well-formed words: trimmed, sorted, cut at the next start, every speaker labelled.

    ``speaker`` is an index; ``speakers(item_id, speaker, name)`` holds the labels known so far.
    """
    w = words.filter(F.trim("text") != "").withColumns(
        {"text": F.trim("text"), "end": F.greatest("start", "end"), "confidence": F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0))}
    )
    order = ["start", "end", "idx"]
    w = scan(w, [key], order, nx=following("start"), pos=sum_before(F.lit(1).cast("long")))
    w = w.withColumns({"end": F.least("end", F.coalesce("nx", "end")), "idx": F.col("pos")}).drop("nx", "pos")
    label = F.when(F.col("speaker").isNotNull(), F.concat(F.lit("Speaker "), F.col("speaker") + 1))
    if speakers is None:
        return w.withColumn("speaker_name", label)
    return w.join(speakers.withColumnRenamed("name", "_n"), [key, "speaker"], "left").withColumn("speaker_name", F.coalesce("_n", label)).drop("_n")


def transcript_check(words: DataFrame, key: str = "item_id") -> DataFrame:
    """Violations of what ``normalize_transcript`` establishes."""
    w = scan(words, [key], ["idx"], INDEX_CHUNK, pe=prev("end"))
    bad = F.array_compact(F.array(F.when(F.col("end") < F.col("start"), F.lit("ends before start")), F.when(F.col("pe") > F.col("start"), F.lit("overlaps previous"))))
    return w.select(key, "idx", F.explode(bad).alias("problem"))


def caption_blocks(words: DataFrame, ft: int, max_chars: int = 42, lines: int = 2, min_duration: int = TPS, max_duration: int = 7 * TPS, gap_frames: int = 0, break_pause: int = TPS, chunk: int = INDEX_CHUNK) -> DataFrame:
    """Words laid out as captions.

    Where a block that begins at a word would end depends on a bounded look-ahead only, so every
    chunk of words (with that much of the chunks behind it) is solved on its own; the blocks really
    taken are the walk from the first word.
    """
    max_chars, lines = max(max_chars, 1), max(lines, 1)
    room = max_chars * lines
    ahead = room // 2 + lines + 2
    w = words.select(*KEY, "idx", "start", "end", "text", "speaker")
    home = idiv("idx", F.lit(chunk))
    spread = w.select("*", F.explode(F.sequence(F.greatest(fdiv(F.col("idx") - ahead, F.lit(chunk)), F.lit(0)), home)).alias("_c"))

    def solve(pdf: pd.DataFrame, groups: list[tuple[int, int]]) -> pd.DataFrame:
        size = pdf["text"].str.len().tolist()
        stop = pdf["text"].str.endswith((".", "?", "!")).tolist()
        s, e = pdf["start"].to_numpy(), pdf["end"].to_numpy()
        who = pdf["speaker"].fillna("\0").to_numpy()
        idx, home = pdf["idx"].tolist(), pdf["_c"].tolist()
        hard = np.ones(len(idx), bool)
        hard[1:] = (who[1:] != who[:-1]) | (s[1:] - e[:-1] >= break_pause)
        s, e, hard = s.tolist(), e.tolist(), hard.tolist()
        own, out = [], []
        for first, total in groups:
            for a in range(first, total):
                if idx[a] >= (home[a] + 1) * chunk:
                    break
                cur, used, row = size[a], size[a], 1
                i = a + 1
                while i < total:
                    fits = cur + 1 + size[i] <= max_chars
                    if hard[i] or not (fits or row < lines) or e[i] - s[a] > max_duration or (stop[i - 1] and (used + row - 1) * 2 >= room):
                        break
                    if fits:
                        cur, used = cur + 1 + size[i], used + 1 + size[i]
                    else:
                        cur, row, used = size[i], row + 1, used + size[i]
                    i += 1
                own.append(a)
                out.append(idx[i] if i < total else None)
        return pdf.iloc[own][KEY].assign(pos=pdf["idx"].to_numpy()[own], nxt=pd.array(out, dtype="Int64"))

    kinds = dict(words.dtypes)
    jumps = each_group(spread, [*KEY, "_c"], ["idx"], solve, ", ".join([*(f"{k} {kinds[k]}" for k in KEY), "pos long", "nxt long"]))
    heads = orbit(jumps, KEY).select(*KEY, F.col("pos").alias("idx"), F.lit(True).alias("_h"))
    tagged = scan(w.join(heads, [*KEY, "idx"], "left"), KEY, ["idx"], chunk, block=last_upto(F.when(F.col("_h"), F.col("idx"))))
    ordered = F.array_sort(F.collect_list(F.struct("idx", "text")))
    fold = F.aggregate(
        ordered,
        F.struct(F.lit("").alias("t"), F.lit(0).alias("n")),
        lambda acc, x: F.when(acc["n"] == 0, F.struct(x["text"].alias("t"), F.length(x["text"]).alias("n")))
        .when(acc["n"] + 1 + F.length(x["text"]) <= max_chars, F.struct(F.concat(acc["t"], F.lit(" "), x["text"]).alias("t"), (acc["n"] + 1 + F.length(x["text"])).alias("n")))
        .otherwise(F.struct(F.concat(acc["t"], F.lit("\n"), x["text"]).alias("t"), F.length(x["text"]).alias("n"))),
    )
    b = tagged.groupBy(*KEY, "block").agg(
        F.max("idx").alias("last"), F.min("start").alias("_s"), F.max_by("end", "idx").alias("_e"), F.max("speaker").alias("speaker"), fold["t"].alias("text")
    )
    b = cut_lineage(b)
    fd, gap = F.lit(ft), F.lit(ft * max(gap_frames, 0))
    b = b.withColumns({"_s": snap("_s", fd), "_e": F.greatest(snap_up("_e", fd), snap("_s", fd) + fd)})
    # a start pushed by its predecessors: start_i = max over j <= i of start_j + (i - j) * (frame + gap)
    b = scan(b, KEY, ["block"], chunk, _i=sum_before(F.lit(1).cast("long")), _nx=following("_s"))
    b = scan(b, KEY, ["block"], chunk, _m=max_upto(F.col("_s") - F.col("_i") * (fd + gap)))
    start = F.col("_m") + F.col("_i") * (fd + gap)
    end = F.when(start > F.col("_s"), F.greatest("_e", start + fd)).otherwise(F.col("_e"))
    end = F.when(end - start < min_duration, snap_up(start + min_duration, fd)).otherwise(end)
    end = F.when(F.col("_nx").isNotNull(), F.greatest(F.least(end, F.col("_nx") - gap), start + fd)).otherwise(end)
    return b.select(*KEY, F.col("block").alias("first"), "last", start.alias("start"), end.alias("end"), "text", "speaker")


def voice_chunks(words: DataFrame, gap: int = TPS // 4, longest: int = 4 * TPS, shortest: int = TPS * 7 // 10) -> DataFrame:
    """Word runs for speaker analysis: split at pauses and by length, short runs joined backwards."""
    base = words.select(*KEY, "idx", "start", "end")
    w = scan(base, KEY, ["idx"], INDEX_CHUNK, pe=prev("end"))
    w = scan(w, KEY, ["idx"], INDEX_CHUNK, _pause=first_after(F.when(F.col("start") - F.col("pe") >= gap, F.col("idx"))))
    none = F.lit(None).cast("long")
    probe = base.select(*KEY, (F.col("start") + longest).alias("t"), F.lit(1).alias("k"), "idx", none.alias("at"))
    ends = base.select(*KEY, F.col("end").alias("t"), F.lit(0).alias("k"), "idx", F.col("idx").alias("at"))
    far = scan(probe.unionByName(ends), KEY, ["t", "k", "idx"], _far=first_from("at")).filter("k = 1")
    # a word longer than the limit still stands alone
    far = far.select(*KEY, "idx", F.when(F.col("_far") > F.col("idx"), F.col("_far")).when(F.col("_far").isNotNull(), F.col("idx") + 1).alias("_far"))
    top = base.groupBy(*KEY).agg(F.max("idx").alias("_top"))
    w = w.join(far, [*KEY, "idx"]).join(top, KEY).withColumn("nxt", F.least("_pause", "_far"))
    w = w.withColumn("nxt", F.when(F.col("nxt") <= F.col("_top"), F.col("nxt")))
    heads = orbit(w, KEY, "idx", "nxt").withColumn("_h", F.lit(1))
    tagged = scan(base.join(heads, [*KEY, "idx"], "left"), KEY, ["idx"], INDEX_CHUNK, c=last_upto(F.when(F.col("_h") == 1, F.col("idx"))))
    c = tagged.groupBy(*KEY, "c").agg(F.max("idx").alias("last"), F.min("start").alias("start"), F.max_by("end", "idx").alias("end"))
    c = scan(c, KEY, ["c"], INDEX_CHUNK, g=sum_upto(F.when(F.col("end") - F.col("start") >= shortest, 1).otherwise(0).cast("long")), n=sum_before(F.lit(1).cast("long")))
    # a short first run forms its own group 0 and then joins the second
    c = c.groupBy(*KEY, "g").agg(F.min("c").alias("first"), F.max("last").alias("last"), F.min("start").alias("start"), F.max("end").alias("end"))
    low = c.groupBy(*KEY).agg(F.min_by(F.struct("g", F.col("last").alias("l"), (F.col("end") - F.col("start")).alias("d")), "g").alias("z"))
    c = c.join(low, KEY).withColumn("g", F.when((F.col("g") == F.col("z.g")) & (F.col("z.d") < shortest), F.col("g") + 1).otherwise(F.col("g")))
    return c.groupBy(*KEY, "g").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("g")


def sequence_transcript(clips: DataFrame, words: DataFrame) -> DataFrame:
    """Words heard on the timeline through audio clips.

    ``clips`` needs ``track_pos`` (0 = top audio track); words are keyed by ``item_id``.
    """
    live = clips.filter((F.col("kind") == "audio") & F.col("enabled") & ~F.col("reverse") & F.col("frame_hold").isNull() & (F.col("speed") > 0))
    live = live.join(words.select("item_id").distinct(), "item_id", "left_semi").select(
        "item_id", "sequence_id", "track_pos", "clip_id", F.col("start").alias("c0"), (F.col("start") + F.col("duration")).alias("c1"), "source_in", "speed",
        F.col("source_in").alias("m0"), (F.col("source_in") + scaled("duration", "speed")).alias("m1"),
    )
    w = words.select("item_id", "idx", "text", "speaker", F.col("start").alias("w0"), F.greatest("start", "end").alias("w1"))
    j = overlap_join(live, w, ["item_id"], ("m0", "m1"), ("w0", "w1"))
    there = lambda t: F.col("c0") + round_half_away((F.col(t) - F.col("source_in")).cast("double") / F.col("speed"))
    j = j.withColumns({"a": there("w0"), "b": there("w1")}).withColumn("mid", F.col("a") + idiv(F.col("b") - F.col("a"), F.lit(2)))
    j = j.filter("mid >= c0 and mid < c1").drop("lo", "hi")
    point = j.select("sequence_id", "clip_id", "idx", "track_pos", "mid", (F.col("mid") + 1).alias("mid1"))
    above = live.select("sequence_id", F.col("track_pos").alias("_tp"), "c0", "c1")
    taken = overlap_join(point, above, ["sequence_id"], ("mid", "mid1"), ("c0", "c1")).filter("_tp < track_pos").select("clip_id", "idx")
    j = j.join(taken, ["clip_id", "idx"], "left_anti")
    start = F.greatest("a", "c0")
    return j.select("sequence_id", "clip_id", "item_id", "idx", "track_pos", "text", "speaker", start.alias("start"), F.greatest(F.least("b", "c1"), start).alias("end"))


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance over items with one big integer per step."""
    if not a:
        return len(b)
    peq: dict = {}
    for i, x in enumerate(a):
        peq[x] = peq.get(x, 0) | (1 << i)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    pv, mv, score = full, 0, len(a)
    for y in b:
        eq = peq.get(y, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        score += 1 if ph & top else (-1 if mh & top else 0)
        ph = ((ph << 1) | 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return score


def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(list(x), list(y)) for x, y in zip(a, b)])


def word_error_rate(pairs: DataFrame) -> DataFrame:
    """``(doc_id, reference, hypothesis)`` -> errors, reference words and rate per document; a null text has no words."""
    words_of = lambda text: tokens(F.coalesce(F.col(text), F.lit("")))
    t = pairs.select("doc_id", words_of("reference").alias("r"), words_of("hypothesis").alias("h"))
    t = t.select("doc_id", F.size("r").cast("long").alias("words"), F.size("h").alias("_h"), F.pandas_udf(_distance, T.LongType())("r", "h").alias("errors"))
    rate = F.when(F.col("words") > 0, F.col("errors") / F.col("words")).when(F.col("_h") == 0, 0.0).otherwise(1.0)
    return t.select("doc_id", "words", "errors", rate.alias("wer"))


def pooled_error_rate(per_doc: DataFrame) -> DataFrame:
    return per_doc.agg(F.sum("words").alias("words"), F.sum("errors").alias("errors"), (F.sum("errors") / F.sum("words")).alias("wer"))
