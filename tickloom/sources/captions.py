"""SubRip and WebVTT documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.timebase import TPS, idiv
from tickloom.operators.captions import clock
from tickloom.operators.ordered import following, last_upto, max_upto, scan, sum_before, sum_upto
from tickloom.sources.documents import LINES

# Fixed value: the clock pattern, [hours:]minutes:seconds with an optional fraction.
CLOCK = r"(?:(\d{1,9}):)?(\d{1,9}):(\d{1,9})(?:[.,](\d{0,9}))?"
TIMING = rf"^\s*{CLOCK}\s*-->\s*{CLOCK}(?:\s.*)?$"


def _ticks(line: Column, first: int) -> Column:
    part = lambda i: F.coalesce(F.regexp_extract(line, TIMING, first + i).try_cast("long"), F.lit(0))
    frac = F.rpad(F.regexp_extract(line, TIMING, first + 3), 9, "0").cast("long")
    whole = ((part(0) * 60 + part(1)) * 60 + part(2)) * TPS
    ok = (part(1) < 60) & (part(2) < 60) & (part(0) <= 9999)
    return F.when(ok, whole + idiv(F.coalesce(frac, F.lit(0)) * (TPS // 1_000_000), F.lit(1000)))


def _timed(lines: DataFrame) -> DataFrame:
    l = F.col("line")
    hit = l.rlike(TIMING)
    t = lines.withColumns({"_a": F.when(hit, _ticks(l, 1)), "_b": F.when(hit, _ticks(l, 5))})
    return t.withColumn("_t", F.col("_a").isNotNull() & F.col("_b").isNotNull())


def scan_srt(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cues, warnings) of SubRip lines; indexes, hours and blank lines may be missing."""
    l = F.col("line")
    index = F.trim(l).rlike(r"^\d{1,10}$")
    t = scan(_timed(lines), ["path"], ["pos"], LINES, _nt=following("_t"), cue=sum_upto(F.when(F.col("_t"), 1).otherwise(0).cast("long")))
    stop = (F.trim(l) == "") | (index & F.coalesce("_nt", F.lit(False)))
    t = scan(t, ["path"], ["pos"], LINES, _stop=max_upto(F.when(stop, F.col("pos"))), _head=max_upto(F.when(F.col("_t"), F.col("pos")))).filter("cue > 0")
    dead = F.coalesce(F.col("_stop") > F.col("_head"), F.lit(False))
    cues = t.groupBy("path", "cue").agg(
        F.max("_a").alias("start"), F.max("_b").alias("end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_t") & ~dead, F.struct("pos", F.rtrim("line").alias("s"))))), lambda x: x["s"]), "\n").alias("text"),
    )
    stray = t.filter(dead & ~F.col("_t") & (F.trim(l) != "") & ~index).select("path", F.concat(F.lit("line "), F.col("pos") + 1, F.lit(': ignored stray text "'), F.trim("line"), F.lit('"')).alias("message"))
    return _split(cues, stray, ",")


def _split(cues: DataFrame, stray: DataFrame, sep: str) -> tuple[DataFrame, DataFrame]:
    bad = cues.filter("end <= start").select("path", F.concat(F.lit("cue at "), clock("start", sep), F.lit(" has end before start; skipped")).alias("message"))
    return cues.filter("end > start"), stray.unionByName(bad)


VOICE = r"(?s)^\s*<v(?:\.[^ \t>]*)?(?:[ \t]+([^>]*))?>(.*)$"


def scan_vtt(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cues, warnings) of WebVTT lines; a leading voice tag becomes the speaker."""
    l = F.col("line")
    blank = F.trim(l) == ""
    t = scan(_timed(lines), ["path"], ["pos"], LINES, block=sum_upto(F.when(blank, 1).otherwise(0).cast("long")), _sig=last_upto(F.when((F.col("pos") == 0) & l.rlike(r"^WEBVTT([ \t]|$)"), F.lit(True))))
    t = t.filter(~blank & ~((F.col("block") == 0) & F.coalesce("_sig", F.lit(False))))
    # a block is one cue, so its lines meet in one row
    b = t.groupBy("path", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "line", "_t", "_a", "_b"))).alias("ls"))
    first = F.trim(F.col("ls")[0]["line"])
    arrow = F.col("ls")[0]["line"].contains("-->")
    skip = ~arrow & first.rlike(r"^(NOTE([ \t]|$)|STYLE$|REGION$)")
    b = b.filter(~skip).withColumn("h", F.get("ls", F.when(arrow, 0).otherwise(1)))
    fine = F.coalesce(F.col("h._t"), F.lit(False))
    why = F.when(F.col("h").isNull(), F.concat(F.lit('ignored block "'), first, F.lit('"'))).otherwise(F.concat(F.lit('bad timing line "'), F.trim("h.line"), F.lit('"')))
    stray = b.filter(~fine).select("path", why.alias("message"))
    raw = F.array_join(F.transform(F.filter("ls", lambda x: x["pos"] > F.col("h.pos")), lambda x: F.rtrim(x["line"])), "\n")
    c = b.filter(fine).select("path", F.col("block").alias("cue"), F.col("h._a").alias("start"), F.col("h._b").alias("end"), raw.alias("raw"))
    body = F.regexp_extract("raw", VOICE, 2)
    tagged = F.col("raw").rlike(VOICE)
    closed = F.regexp_replace(body, r"</v>\s*$", "")
    many = closed.contains("</v>") | closed.contains("<v ") | closed.contains("<v.")
    name = F.trim(F.regexp_extract("raw", VOICE, 1))
    one = tagged & ~many
    c = c.select("path", "cue", "start", "end", F.when(one, closed).otherwise(F.col("raw")).alias("text"), F.when(one & (name != ""), name).alias("speaker"))
    return _split(c, stray, ".")


def write_captions(captions: DataFrame, key: str = "track_id", fmt: str = "srt", offset: int = 0) -> DataFrame:
    """Document lines ``(key, pos, line)``, one row per cue, renumbered from 1, times less ``offset``."""
    c = captions.filter(F.col("start") + F.col("duration") > offset)
    c = scan(c, [key], ["start", "caption_id"], pos=sum_before(F.lit(1).cast("long")))
    sep = "," if fmt == "srt" else "."
    times = F.concat(clock(F.greatest(F.col("start") - offset, F.lit(0)), sep), F.lit(" --> "), clock(F.col("start") + F.col("duration") - offset, sep))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), "\n")
    if fmt == "srt":
        return c.select(key, "pos", F.concat((F.col("pos") + 1).cast("string"), F.lit("\n"), times, F.lit("\n"), kept, F.lit("\n")).alias("line"))
    who = F.when(F.coalesce("speaker", F.lit("")) != "", F.concat(F.lit("<v "), "speaker", F.lit(">"))).otherwise("") if "speaker" in captions.columns else F.lit("")
    head = F.when(F.col("pos") == 0, "WEBVTT\n\n").otherwise("")
    return c.select(key, "pos", F.concat(head, times, F.lit("\n"), F.replace(F.concat(who, kept), F.lit("-->"), F.lit("--&gt;")), F.lit("\n")).alias("line"))
