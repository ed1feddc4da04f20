"""Sources and sinks: round trips of derived tables through documents."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tickloom.plans import fixtures as fx
from tickloom.plans.queries_c_catalog import sql_tc
from tickloom.plans.registry import query
from tickloom.plans.sqltables import MS, using
from tickloom.session import cut_lineage, setting, shared_folder
from tickloom.sources import captions as sc
from tickloom.sources import documents as dc
from tickloom.sources import interchange as ic
from tickloom.sources import media as md
from tickloom.sources.ranges import media_source


def folder(spark, name):
    return f"{shared_folder(spark)}/tickloom-{uuid.uuid4().hex}/{name}"


def as_lines(rows, key):
    """Written document rows as the lines a reader would see."""
    r = rows.select(F.col(key).cast("string").alias("path"), "pos", F.posexplode(F.split("line", "\n")).alias("k", "line"))
    return r.select("path", (F.col("pos") * 1000 + F.col("k") + 1000).cast("long").alias("pos"), "line")


@query("scan_captions_srt", using("captions", "SELECT track_id, start, start + duration AS \"end\", text FROM captions"))
def scan_captions_srt(spark, d):
    """Written as SRT files, one per track and task, and read back."""
    out = folder(spark, "srt")
    dc.write_documents(sc.write_captions(fx.captions(spark, d)), "track_id", out)
    cues, _ = sc.scan_srt(dc.document_lines(spark, out))
    return cues.select(F.regexp_extract("path", r"track_id=(\d+)[^/]*$", 1).cast("long").alias("track_id"), "start", "end", "text")


def spoken(spark, d):
    return fx.captions(spark, d).withColumn("speaker", F.when(F.col("caption_id") % 2 == 0, F.concat(F.lit("Voice "), F.col("caption_id") % 3)))


CLOCK_I = "lpad(CAST(i // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(i // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(i % 60 AS VARCHAR), 2, '0')"


@query("scan_captions_warnings", using("captions", f""", k AS (SELECT *, caption_id % 1000000 AS i FROM captions)
SELECT CAST(track_id AS VARCHAR) AS path, 'line ' || (7 + i * 5) || ': ignored stray text "stray ' || caption_id || '"' AS message FROM k
UNION ALL SELECT CAST(track_id AS VARCHAR), 'cue at ' || {CLOCK_I} || ',500 has end before start; skipped' FROM k WHERE caption_id % 3 = 0"""))
def scan_captions_warnings(spark, d):
    """Each cue is followed by a blank line and stray text; every third ends before it starts."""
    c = fx.captions(spark, d).withColumn("i", F.col("caption_id") % 1_000_000)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    at = lambda s: F.concat(two(F.call_function("div", s, F.lit(3600))), F.lit(":"), two(F.call_function("div", s, F.lit(60)) % 60), F.lit(":"), two(s % 60))
    t = F.concat(at(F.col("i")), F.lit(",500 --> "), at(F.col("i") + F.when(F.col("caption_id") % 3 == 0, 0).otherwise(1)), F.lit(",200"))
    ls = F.array(F.lit("7"), t, F.lit("text"), F.lit(""), F.lit(""), F.concat(F.lit("stray "), F.col("caption_id")))
    lines = c.select(F.col("track_id").cast("string").alias("path"), "i", F.posexplode(ls).alias("k", "line"))
    lines = lines.select("path", (F.col("i") * 5 + F.col("k") + 1).alias("pos"), "line").filter("line != '7' or pos = 1")
    return sc.scan_srt(lines)[1]


@query("scan_captions_vtt", using("captions", f"SELECT CAST(track_id AS VARCHAR) AS track_id, greatest(start - {MS * 5000}, 0) AS start, start + duration - {MS * 5000} AS \"end\", text, CASE WHEN caption_id % 2 = 0 THEN 'Voice ' || (caption_id % 3) END AS speaker FROM captions WHERE start + duration > {MS * 5000}"))
def scan_captions_vtt(spark, d):
    """Over all captions: the writer's offset drops what ends before it and clamps what it cuts."""
    cues, _ = sc.scan_vtt(as_lines(sc.write_captions(spoken(spark, d), fmt="vtt", offset=5000 * MS), "track_id"))
    return cues.select(F.col("path").alias("track_id"), "start", "end", "text", "speaker")


NDF = "SELECT c.track_id, c.clip_id, c.kind, c.name, c.start, c.duration, c.source_in, c.speed, m.start_timecode FROM clips c LEFT JOIN media m USING (item_id)"
F25 = 10_160_640_000


def on25(spark, d):
    return fx.clips(spark, d).withColumns({c: F.call_function("div", F.col(c), F.col("ft")) * F25 for c in ("start", "duration", "source_in")})


@query("scan_edl", using("clips media", f""", e AS (SELECT CAST(track_id AS VARCHAR) AS path, start // ft AS r0, (start + duration) // ft AS r1, source_in // ft + coalesce(start_timecode // {F25}, 0) AS s0, source_in // ft + CAST(duration // ft * speed AS BIGINT) + coalesce(start_timecode // {F25}, 0) AS s1, c.name,
 CASE WHEN kind = 'video' THEN 'V' ELSE 'A1' END AS channel, row_number() OVER (PARTITION BY track_id ORDER BY start, clip_id) AS event FROM clips c LEFT JOIN (SELECT item_id, start_timecode FROM media) m USING (item_id))
SELECT path, event, channel, s0 AS src_in, s1 AS src_out, r0 AS rec_in, r1 AS rec_out, name AS from_clip, 'cut' AS transition, false AS drop_frame FROM e"""))
def scan_edl(spark, d):
    lines, _ = ic.write_edl_cuts(on25(spark, d), fx.media(spark, d), 25, 1)
    ev, _ = ic.scan_edl(as_lines(lines, "track_id"), 25, 1)
    return ev.select("path", "event", "channel", "src_in", "src_out", "rec_in", "rec_out", "from_clip", "transition", "drop_frame")


@query("scan_ale", using("items media", f"""SELECT CAST(project_id AS VARCHAR) AS path, name, CASE WHEN i.item_id % 3 = 0 THEN 'A1A2' ELSE 'VA1A2' END AS tracks, CAST(start_timecode // {F25} * {F25} AS BIGINT) AS start, CAST((start_timecode + duration) // {F25} * {F25} AS BIGINT) AS "end", m.path AS file, m_type AS scene FROM items i JOIN media m USING (item_id)"""))
def scan_ale(spark, d):
    m = fx.media(spark, d).withColumns({"has_video": F.col("item_id") % 3 != 0, "channels": F.lit(2)})
    lines = ic.write_ale(fx.items(spark, d), m, 25, 1, ("type",))
    r = ic.scan_ale(as_lines(lines, "project_id"))
    a = F.col("attributes")
    return r.select("path", a["Name"].alias("name"), a["Tracks"].alias("tracks"), "start", "end", a["Source File"].alias("file"), a["type"].alias("scene"))


@query("scan_otio", using("spans", f"""SELECT CAST(track_id AS VARCHAR) AS path, name, 'file:///m/' || item_id || '.mov' AS url, start // ft * {F25} AS start, duration // ft * {F25} AS duration, source_in // ft * {F25} AS source_in FROM spans"""))
def scan_otio(spark, d):
    """Clips and the gaps before them as OTIO documents, one per track."""
    from tickloom.operators.ordered import prev, scan

    c = fx.spans(spark, d)
    c = scan(c, ["track_id"], ["start", "clip_id"], _e=prev("end"))
    rt = lambda v: F.struct(F.lit(25.0).alias("rate"), F.call_function("div", v, F.col("ft")).cast("double").alias("value"))
    rng = lambda a, n: F.struct(rt(a).alias("start_time"), rt(n).alias("duration"))
    zero = F.lit(0).cast("long")
    gap = F.struct(F.lit("Gap.1").alias("OTIO_SCHEMA"), F.lit("").alias("name"), rng(zero, F.col("start") - F.coalesce("_e", zero)).alias("source_range"), F.struct(F.lit(None).cast("string").alias("target_url")).alias("media_reference"))
    clip = F.struct(F.lit("Clip.2").alias("OTIO_SCHEMA"), "name", rng(F.col("source_in"), F.col("duration")).alias("source_range"), F.struct(F.concat(F.lit("file:///m/"), F.col("item_id"), F.lit(".mov")).alias("target_url")).alias("media_reference"))
    kids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", F.array(gap, clip).alias("k")))), lambda x: x["k"]))
    doc = c.groupBy("track_id").agg(F.to_json(F.struct(F.lit("Timeline.1").alias("OTIO_SCHEMA"), F.struct(F.array(F.struct(F.lit("Track.1").alias("OTIO_SCHEMA"), F.lit("Video").alias("kind"), kids.alias("children"))).alias("children")).alias("tracks"))).alias("value"))
    r = ic.scan_otio(doc.select(F.col("track_id").cast("string").alias("path"), "value"))
    return r.select("path", "name", "url", "start", "duration", "source_in")


def nested_documents(spark, d):
    """One document per sequence: its first track, which ends in a stack with the second one, which ends in a stack with the third.

    The stacks of even sequences have a source range of 50 frames from frame 10.
    """
    from tickloom.operators.ordered import prev, scan

    c = scan(fx.spans(spark, d), ["track_id"], ["start", "clip_id"], _e=prev("end"))
    rt = lambda v: F.struct(F.lit(25.0).alias("rate"), F.call_function("div", v, F.col("ft")).cast("double").alias("value"))
    rng = lambda a, n: F.struct(rt(a).alias("start_time"), rt(n).alias("duration"))
    zero = F.lit(0).cast("long")
    gap = F.to_json(F.struct(F.lit("Gap.1").alias("OTIO_SCHEMA"), rng(zero, F.col("start") - F.coalesce("_e", zero)).alias("source_range")))
    clip = F.to_json(F.struct(F.lit("Clip.2").alias("OTIO_SCHEMA"), "name", rng(F.col("source_in"), F.col("duration")).alias("source_range")))
    kids = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("start", F.concat_ws(",", gap, clip).alias("k")))), lambda x: x["k"]))
    t = c.groupBy("sequence_id", "track_id").agg(kids.alias("k"))
    t = t.groupBy("sequence_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("track_id", "k"))), lambda x: x["k"]).alias("t"))
    range_ = F.when(F.col("sequence_id") % 2 == 0, '"source_range":{"start_time":{"rate":25.0,"value":10.0},"duration":{"rate":25.0,"value":50.0}},').otherwise("")
    stack = lambda inner: F.concat(F.lit('{"OTIO_SCHEMA":"Stack.1","name":"nest",'), range_, F.lit('"children":[{"OTIO_SCHEMA":"Track.1","kind":"Video","children":['), inner, F.lit("]}]}"))
    last = lambda i, more: F.when(F.size("t") > i + 1, F.concat(F.get("t", F.lit(i)), F.lit(","), stack(more))).otherwise(F.get("t", F.lit(i)))
    top = last(0, last(1, F.get("t", F.lit(2))))
    doc = F.concat(F.lit('{"OTIO_SCHEMA":"Timeline.1","name":"t","tracks":{"OTIO_SCHEMA":"Stack.1","children":[{"OTIO_SCHEMA":"Track.1","kind":"Video","children":['), top, F.lit("]}]}}"))
    return t.select(F.col("sequence_id").cast("string").alias("path"), doc.alias("value"))


@query("scan_otio_nested", using("spans", f""", r AS (SELECT *, dense_rank() OVER (PARTITION BY sequence_id ORDER BY track_id) AS lv FROM spans), n AS (SELECT sequence_id, lv, count(*) AS n, max("end" // ft * {F25}) AS e FROM r GROUP BY 1, 2),
w AS (SELECT a.sequence_id, a.n AS n1, a.e AS e1, b.n AS n2, b.e AS e2, c.e AS e3 FROM n a LEFT JOIN n b ON b.sequence_id = a.sequence_id AND b.lv = 2 LEFT JOIN n c ON c.sequence_id = a.sequence_id AND c.lv = 3 WHERE a.lv = 1),
p AS (SELECT *, '0' AS q1, '0/0.' || (2 * n1) AS q2, '0/0.' || (2 * n1) || '/0.' || (2 * n2) AS q3, CASE WHEN sequence_id % 2 = 0 THEN 50 * {F25} ELSE e3 END AS d3, CASE WHEN sequence_id % 2 = 0 THEN 50 * {F25} ELSE e2 + coalesce(e3, 0) END AS d2, CASE WHEN sequence_id % 2 = 0 THEN 10 * {F25} ELSE 0 END AS s FROM w)
SELECT CAST(sequence_id AS VARCHAR) AS path, CASE lv WHEN 1 THEN q1 WHEN 2 THEN q2 ELSE q3 END AS seq, 'clip' AS type, name, start // ft * {F25} AS start, duration // ft * {F25} AS duration, source_in // ft * {F25} AS source_in FROM r JOIN p USING (sequence_id)
UNION ALL SELECT CAST(sequence_id AS VARCHAR), q1, 'nest', 'nest', e1, d2, s FROM p WHERE n2 IS NOT NULL UNION ALL SELECT CAST(sequence_id AS VARCHAR), q2, 'nest', 'nest', e2, d3, s FROM p WHERE e3 IS NOT NULL"""))
def scan_otio_nested(spark, d):
    return ic.scan_otio_tree(nested_documents(spark, d))["items"].select("path", "seq", "type", "name", "start", "duration", "source_in")


#: Sequences that a document of a project holds: a document is one row.
IN_PROJECT = 2000


@query("scan_projects", using("clips", "SELECT sequence_id % 10 AS project_id, sequence_id, track_id, clip_id, item_id, name, start, duration, source_in, speed, reverse, enabled FROM clips WHERE sequence_id % 10 <> 9"))
def scan_projects(spark, d):
    """Ten projects, one of a newer version, written as JSON documents of at most ``IN_PROJECT`` sequences and read back."""
    c = fx.clips(spark, d).withColumn("project_id", F.col("sequence_id") % 10)
    clip = F.struct(F.col("clip_id").alias("id"), F.col("item_id").alias("item"), "name", "start", "duration", "source_in", "speed", "reverse", "enabled")
    t = c.groupBy("project_id", "sequence_id", "track_id", "kind").agg(F.collect_list(clip).alias("clips"))
    s = t.groupBy("project_id", "sequence_id").agg(F.collect_list(F.struct(F.col("track_id").alias("id"), "kind", "clips")).alias("tracks"))
    part = F.call_function("div", F.col("sequence_id"), F.lit(10 * IN_PROJECT)).alias("part")
    p = s.groupBy("project_id", part).agg(F.collect_list(F.struct(F.col("sequence_id").alias("id"), F.lit("sequence").alias("kind"), "tracks")).alias("items"))
    out = folder(spark, "projects")
    p.select(F.when(F.col("project_id") == 9, 2).otherwise(1).alias("version"), F.col("project_id").alias("id"), "items").write.option("maxRecordsPerFile", 1).json(out)
    return ic.scan_projects(spark, out)["clips"].drop("kind")


@query("scan_image_sequences", using("items", """, n AS (SELECT p_brand, p_partkey % 7 AS pre, p_partkey AS n FROM part WHERE p_partkey % 5 <> 3), s AS (SELECT *, (n - min(n) OVER (PARTITION BY p_brand, pre)) // 1000001 AS part FROM n), g AS (SELECT p_brand, pre, part, n, n - lag(n) OVER (PARTITION BY p_brand, pre, part ORDER BY n) - 1 AS h FROM s)
SELECT '/shots/' || p_brand || '/' AS dir, 'take' || chr(97 + CAST(pre AS INT)) || '_' AS prefix, '.png' AS suffix, 6 AS width, min(n) AS first, max(n) AS last, count(*) AS present, CAST(coalesce(sum(h), 0) AS BIGINT) AS missing FROM g GROUP BY p_brand, pre, part"""))
def scan_image_sequences(spark, d):
    p = fx.table(spark, d, "part").filter("p_partkey % 5 != 3")
    name = F.concat(F.lit("/shots/"), "p_brand", F.lit("/take"), F.char((F.col("p_partkey") % 7 + 97).cast("long")), F.lit("_"), F.format_string("%06d", F.col("p_partkey")), F.lit(".png"))
    return md.scan_image_sequences(p.select(name.alias("path")))


@query("scan_media_files", "SELECT count(*) AS files, count(*) AS prints FROM part")
def scan_media_files(spark, d):
    """Files of distinct content on disk: every one is listed and no two prints are equal."""
    out = folder(spark, "files")
    p = fx.table(spark, d, "part")
    text = F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))
    dc.write_documents(p.select("p_partkey", F.lit(0).alias("pos"), text.alias("line")), "p_partkey", out)
    f = md.scan_media_files(spark, out, "*.txt")
    return f.agg(F.count("*").alias("files"), F.count_distinct("fingerprint").alias("prints"))


@query("load_transcripts", using("words", """, k AS (SELECT item_id, idx, text, start, greatest(start, "end" + CASE WHEN idx % 4 = 0 THEN 76204800000 ELSE 0 END) AS e, CASE WHEN speaker = 'user' THEN 0 ELSE 1 END AS sp FROM words)
SELECT item_id, row_number() OVER q - 1 AS idx, text, start, least(e, coalesce(lead(start) OVER q, e)) AS "end", sp AS speaker, 'Speaker ' || (sp + 1) AS speaker_name FROM k WINDOW q AS (PARTITION BY item_id ORDER BY start, e, idx)"""))
def load_transcripts(spark, d):
    w = fx.words(spark, d)
    word = F.struct("text", "start", (F.col("end") + F.when(F.col("idx") % 4 == 0, 300 * MS).otherwise(0)).alias("end"), F.when(F.col("speaker") == "user", 0).otherwise(1).alias("speaker"))
    docs = w.groupBy("item_id").agg(F.to_json(F.collect_list(word)).alias("value"))
    return md.load_transcripts(docs).drop("confidence")


def loud_blocks():
    """A stand-in recogniser: one word per 100 samples, named after its sign."""

    def hear(x: np.ndarray, rate: int):
        n = len(x) // 100
        s = x[: n * 100].reshape(n, 100).sum(axis=1)
        return [("up" if v > 0 else "down", i * 100 / rate, (i + 1) * 100 / rate, 1.0) for i, v in enumerate(s)]

    return hear


@query("transcribe", using("samples", "SELECT stream_id, CASE WHEN sum(x) > 0 THEN 'up' ELSE 'down' END AS text, round(n // 100 / 10.0::DOUBLE, 6) AS start_s, round((n // 100 + 1) / 10.0::DOUBLE, 6) AS end_s FROM samples GROUP BY stream_id, n // 100 HAVING count(*) = 100"))
def transcribe(spark, d):
    w = md.transcribe(fx.samples(spark, d), loud_blocks, rate=1000, chunk_seconds=1)
    return w.select("stream_id", "text", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


def ramp(item, lo, hi):
    for a in range(lo, hi, 64):
        n = np.arange(a, min(a + 64, hi))
        yield pd.DataFrame({"stream_id": item, "ch": 0, "n": n, "x": (n % 7) / 7.0})


@query("read_media", "SELECT p_partkey AS stream_id, count(*) AS rows, round(sum(n % 7 / 7.0::DOUBLE), 6) AS total FROM (SELECT p_partkey, unnest(range(p_size, p_size + 100 + p_size)) AS n FROM part) GROUP BY 1")
def read_media(spark, d):
    req = fx.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_size").cast("long").alias("lo"), (F.col("p_size") * 2 + 100).cast("long").alias("hi"))
    s = md.read_media(req, ramp, "stream_id long, ch int, n long, x double")
    return s.groupBy("stream_id").agg(F.count("*").alias("rows"), F.round(F.sum("x"), 6).alias("total"))


@query("read_media_source", "SELECT p_partkey AS stream_id, count(*) AS rows, round(sum(n % 7 / 7.0::DOUBLE), 6) AS total FROM (SELECT p_partkey, unnest(range(p_size, p_size + 100 + p_size)) AS n FROM part) WHERE n >= 40 AND n < 120 GROUP BY 1")
def read_media_source(spark, d):
    """The ranges of the part table through the data source, with bounds on the position that it reads no further than."""
    req = fx.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("item_id"), F.col("p_size").cast("long").alias("lo"), (F.col("p_size") * 2 + 100).cast("long").alias("hi"))
    path = folder(spark, "ranges")
    req.write.parquet(path)
    spark.dataSource.register(media_source("tick_ramp", ramp, "stream_id long, ch int, n long, x double"))
    # pushing filters into Python sources is off by default
    with setting(spark, "spark.sql.python.filterPushdown.enabled", "true"):
        s = spark.read.format("tick_ramp").option("ranges", path).load().where("n >= 40 and n < 120")
        return cut_lineage(s.groupBy("stream_id").agg(F.count("*").alias("rows"), F.round(F.sum("x"), 6).alias("total")))


def sql_clock(t: str, sep: str) -> str:
    ms = f"(({t} + {MS // 2}) // {MS})"
    two = lambda x: f"lpad(CAST({x} AS VARCHAR), 2, '0')"
    return f"{two(f'{ms} // 3600000')} || ':' || {two(f'{ms} // 60000 % 60')} || ':' || {two(f'{ms} // 1000 % 60')} || '{sep}' || lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0')"


@query("write_captions", using("captions", f"""SELECT track_id, row_number() OVER w - 1 AS pos, (row_number() OVER w) || chr(10) || {sql_clock('start', ',')} || ' --> ' || {sql_clock('(start + duration)', ',')} || chr(10) || text || chr(10) AS line FROM captions WINDOW w AS (PARTITION BY track_id ORDER BY start, caption_id)"""))
def write_captions(spark, d):
    return sc.write_captions(fx.captions(spark, d))


@query("write_ale", using("items media", f"""SELECT project_id, i.item_id AS pos, name || chr(9) || CASE WHEN i.item_id % 3 = 0 THEN '' ELSE 'V' END || 'A1A2' || chr(9) || {sql_tc(f'(start_timecode // {F25})', 25)} || chr(9) || {sql_tc(f'((start_timecode + duration) // {F25})', 25)} || chr(9) || chr(9) || path || chr(9) || m_type AS line FROM items i JOIN media m USING (item_id)
UNION ALL SELECT DISTINCT project_id, -1::BIGINT, 'Heading' || chr(10) || 'FIELD_DELIM' || chr(9) || 'TABS' || chr(10) || 'VIDEO_FORMAT' || chr(9) || '1080' || chr(10) || 'AUDIO_FORMAT' || chr(9) || '48khz' || chr(10) || 'FPS' || chr(9) || '25' || chr(10) || chr(10) || 'Column' || chr(10) || 'Name' || chr(9) || 'Tracks' || chr(9) || 'Start' || chr(9) || 'End' || chr(9) || 'Tape' || chr(9) || 'Source File' || chr(9) || 'type' || chr(10) || chr(10) || 'Data' FROM items"""))
def write_ale(spark, d):
    m = fx.media(spark, d).withColumns({"has_video": F.col("item_id") % 3 != 0, "channels": F.lit(2)})
    return ic.write_ale(fx.items(spark, d), m, 25, 1, ("type",))


@query("write_edl_cuts", using("clips media", f"""SELECT track_id, pos, CASE WHEN pos = 0 THEN 'TITLE: track ' || track_id || chr(10) || 'FCM: NON-DROP FRAME' || chr(10) || chr(10) ELSE '' END || lpad(CAST(pos + 1 AS VARCHAR), greatest(3, length(CAST(pos + 1 AS VARCHAR)))::INT, '0') || '  ' || rpad(left(upper(regexp_replace(regexp_replace(regexp_extract(coalesce(path, 'AX'), '[^/]*$'), '\\.[^.]*$', ''), '[^A-Za-z0-9_]', '', 'g')), 8), 8, ' ')
 || ' ' || CASE WHEN kind = 'video' THEN 'V    ' ELSE 'A    ' END || ' C        ' || {sql_tc('s0', 25)} || ' ' || {sql_tc('s1', 25)} || ' ' || {sql_tc('r0', 25)} || ' ' || {sql_tc('r1', 25)} || chr(10) || '* FROM CLIP NAME: ' || name AS line
FROM (SELECT c.track_id, c.kind, c.name, m.path, row_number() OVER (PARTITION BY track_id ORDER BY start, clip_id) - 1 AS pos, start // ft AS r0, (start + c.duration) // ft AS r1, source_in // ft + coalesce(start_timecode // {F25}, 0) AS s0, source_in // ft + CAST(c.duration // ft * speed AS BIGINT) + coalesce(start_timecode // {F25}, 0) AS s1 FROM clips c LEFT JOIN media m USING (item_id))"""))
def write_edl_cuts(spark, d):
    return ic.write_edl_cuts(on25(spark, d), fx.media(spark, d), 25, 1)[0]


@query("write_edl_sources", using("clips media", "SELECT CAST(track_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY track_id ORDER BY start, clip_id) AS event, m.path AS source_file FROM clips c LEFT JOIN media m USING (item_id)"))
def write_edl_sources(spark, d):
    """The full path of every event, written as a note and read back."""
    lines, _ = ic.write_edl_cuts(on25(spark, d), fx.media(spark, d), 25, 1, source_files=True)
    return ic.scan_edl(as_lines(lines, "track_id"), 25, 1)[0].select("path", "event", "source_file")


@query("write_edl_warnings", using("clips media", """, f AS (SELECT DISTINCT track_id, coalesce(path, 'AX') AS file, left(upper(regexp_replace(regexp_replace(regexp_extract(coalesce(path, 'AX'), '[^/]*$'), '\\.[^.]*$', ''), '[^A-Za-z0-9_]', '', 'g')), 8) AS reel FROM clips c LEFT JOIN media m USING (item_id))
SELECT track_id, 'reel ' || reel || ' stands for ' || count(*) OVER w || ' files: ' || file AS message FROM f WINDOW w AS (PARTITION BY track_id, reel) QUALIFY count(*) OVER w > 1"""))
def write_edl_warnings(spark, d):
    """Each file of a track whose cut reel stands for others too."""
    return ic.write_edl_cuts(on25(spark, d), fx.media(spark, d), 25, 1)[1]
