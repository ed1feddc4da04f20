"""Catalogue, relinking, nesting and timeline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.timebase import TPS, timecode
from tickloom.operators import catalog as ct
from tickloom.operators import nesting as ns
from tickloom.operators import timeline as tl
from tickloom.plans import fixtures as fx
from tickloom.plans.registry import query
from tickloom.plans.sqltables import fdiv, r0, snap, using

FT25 = 10_160_640_000
NESTED = 10_000_000_000
SUB = 5_000_000_000


def sql_tc(frame: str, base: int, drop: bool = False) -> str:
    sep = ";" if drop else ":"
    n = frame
    if drop:
        d = base // 15
        pm = base * 60 - d
        pt = pm * 10 + d
        n = f"({frame} + {d * 9} * ({frame} // {pt}) + CASE WHEN {frame} % {pt} > {d} THEN {d} * (({frame} % {pt} - {d}) // {pm}) ELSE 0 END)"
    p = lambda x: f"lpad(CAST({x} AS VARCHAR), greatest(2, length(CAST({x} AS VARCHAR)))::INT, '0')"
    return f"({p(f'({n} // {base*3600})')} || '{sep}' || {p(f'({n} // {base*60} % 60)')} || '{sep}' || {p(f'({n} // {base} % 60)')} || '{sep}' || {p(f'({n} % {base})')})"


def catalog(spark, d):
    j = fx.items(spark, d).join(fx.media(spark, d), "item_id")
    return j.select(
        "item_id", "name", "label", "kind", F.lit("Movie").alias("media type"), F.lit("25 fps").alias("frame rate"),
        timecode(F.floor(F.col("duration") / FT25).cast("long"), F.lit(25), False).alias("media duration"), F.col("path").alias("file path"), "metadata", "size",
    )


CAT = f", cat AS (SELECT i.item_id, name, label, kind, 'Movie' AS mt, '25 fps' AS fr, {sql_tc('(duration // 10160640000)', 25)} AS dur, path, m_type, m_size FROM items i JOIN media m USING (item_id))"
ALLCOLS = ["name", "label", "mt", "fr", "dur", "path", "m_type", "m_size"]


def anyc(text, neg=False):
    s = " OR ".join(f"contains(lower({c}), '{text}')" for c in ALLCOLS)
    return f"NOT ({s})" if neg else f"({s})"


FIND = [("Name", "contains", "RING"), ("All", "contains", "econ"), ("", "doesNotContain", "brand#2"), ("type", "beginsWith", "E"), ("Label", "endsWith", ""), ("Scene", "doesNotContain", "x")]


@query("catalog_find", using("items media", CAT + f" SELECT item_id FROM cat WHERE kind <> 'graphic' AND contains(lower(name), 'ring') AND {anyc('econ')} AND {anyc('brand#2', True)} AND starts_with(lower(m_type), 'e')"))
def catalog_find(spark, d):
    return ct.catalog_find(catalog(spark, d), FIND)


@query("catalog_find_any", using("items media", CAT + " SELECT item_id FROM cat WHERE kind <> 'graphic' AND (label = 'Brand#7' OR ends_with(name, 'bolt') OR m_size = '12')"))
def catalog_find_any(spark, d):
    return ct.catalog_find(catalog(spark, d), [("Label", "matches", "Brand#7"), ("Name", "endsWith", "bolt"), ("SIZE", "matches", "12")], False, True)


BINS = [
    (1, "Name", "contains", "widget", True, False), (1, "All", "doesNotContain", "brand#1", True, False),
    (2, "type", "matches", "economy", False, False), (2, "Label", "beginsWith", "Brand#2", False, True),
    (3, "All", "doesNotContain", "ring", True, False), (4, "Name", "doesNotContain", "red", False, False), (4, "Name", "contains", "red w", False, False), (5, "Name", "contains", "", True, False),
]


@query("search_bins", using("items media", CAT + f""", c AS (SELECT * FROM cat WHERE kind <> 'graphic') SELECT CAST(1 AS BIGINT) AS bin_id, item_id FROM c WHERE contains(lower(name), 'widget') AND {anyc('brand#1', True)}
UNION ALL SELECT 2, item_id FROM c WHERE lower(m_type) = 'economy' OR starts_with(label, 'Brand#2') UNION ALL SELECT 3, item_id FROM c WHERE {anyc('ring', True)}
UNION ALL SELECT 4, item_id FROM c WHERE NOT contains(lower(name), 'red') OR contains(lower(name), 'red w')"""))
def search_bins(spark, d):
    bins = spark.createDataFrame(BINS, "bin_id long, column string, op string, text string, match_all boolean, case_sensitive boolean")
    return ct.search_bins(catalog(spark, d), bins)


@query("timeline_find", using("clips markers items", """, c AS (SELECT c.*, CASE WHEN c.rn % 4 = 0 THEN i.name ELSE c.name END AS shown FROM clips c LEFT JOIN items i USING (item_id))
SELECT sequence_id AS owner_id, 'clip' AS what, clip_id AS id, start AS t FROM c WHERE contains(shown, '7') OR ends_with(shown, 'bolt')
UNION ALL SELECT owner_id, 'marker', marker_id, start FROM markers WHERE contains(comment, '7')"""))
def timeline_find(spark, d):
    c = fx.clips(spark, d).withColumn("name", F.when(F.col("rn") % 4 == 0, "").otherwise(F.col("name")))
    return ct.timeline_find(c, fx.items(spark, d), fx.markers(spark, d), [("", "contains", "7"), ("", "endsWith", "BOLT")], False)


@query("item_usage", using("clips", "SELECT item_id, count(*) FILTER (kind = 'video') AS v, count(*) FILTER (kind = 'audio') AS a FROM clips GROUP BY 1"))
def item_usage(spark, d):
    return ct.item_usage(fx.clips(spark, d))


STC = "(start_timecode // 10160640000)"
DF = "(duration // 10160640000)"


@query("catalog_columns", using("items media clips", f""", u AS (SELECT item_id, count(*) FILTER (kind = 'video') AS v, count(*) FILTER (kind = 'audio') AS a FROM clips GROUP BY 1)
SELECT i.item_id, i.name, label, {sql_tc(STC, 25)} AS media_start, {sql_tc(f'({STC} + {DF} - 1)', 25)} AS media_end, {sql_tc(DF, 25)} AS media_duration,
 {sql_tc(f'({STC} + 10)', 25)} AS in_point, {sql_tc(f'({STC} + least(31, {DF}) - 1)', 25)} AS out_point, {sql_tc(f'(least(31, {DF}) - 10)', 25)} AS in_out_duration, '' AS subclip_start, '' AS subclip_end,
 CASE WHEN coalesce(v, 0) > 0 THEN CAST(v AS VARCHAR) ELSE '' END AS video_usage, CASE WHEN coalesce(a, 0) > 0 THEN CAST(a AS VARCHAR) ELSE '' END AS audio_usage,
 CASE WHEN offline THEN 'Offline' ELSE 'Online' END AS status, CASE WHEN proxy_path IS NULL THEN 'None' ELSE 'Attached' END AS proxy, path AS file_path,
 CASE WHEN size >= 1048576 THEN printf('%.1f MB', size / 1048576.0::DOUBLE) ELSE printf('%.0f KB', size / 1024.0::DOUBLE) END AS file_size, m_type AS "type"
FROM items i JOIN media m USING (item_id) LEFT JOIN u ON u.item_id = i.item_id"""))
def catalog_columns(spark, d):
    m = fx.media(spark, d).withColumns({"mark_in": F.lit(10 * FT25), "mark_out": F.lit(30 * FT25)})
    return ct.catalog_columns(fx.items(spark, d), m, fx.clips(spark, d), 25, 1, ["type"])


@query("catalog_sort", using("items media", "SELECT i.item_id, i.name, size FROM items i JOIN media USING (item_id)"))
def catalog_sort(spark, d):
    j = fx.items(spark, d).join(fx.media(spark, d), "item_id").select("item_id", "name", "size")
    return ct.catalog_sort(j, "size", True)


@query("frame_grid", using("clips", f"""SELECT clip_id, frame, frame * ft AS t, CASE WHEN reverse THEN source_in + {r0('duration * speed')} - {r0('(frame * ft - start) * speed')} - 1 ELSE source_in + {r0('(frame * ft - start) * speed')} END AS media_t
FROM (SELECT *, unnest(range(start // ft, (start + duration) // ft)) AS frame FROM clips)"""))
def frame_grid(spark, d):
    return tl.frame_grid(fx.clips(spark, d))


@query("reverse_match", using("clips media", f""", mo AS (SELECT item_id, item_id AS moment_id, (item_id % 60) * {FT25} AS src FROM media), j AS (SELECT *, {r0('duration * speed')} AS total FROM clips JOIN mo USING (item_id)),
k AS (SELECT *, CASE WHEN reverse THEN source_in + total - 1 - src ELSE src - source_in END AS rel FROM j)
SELECT moment_id, clip_id, start + CAST(floor(rel / speed) AS BIGINT) AS t FROM k WHERE rel >= 0 AND rel < total AND start + CAST(floor(rel / speed) AS BIGINT) < start + duration"""))
def reverse_match(spark, d):
    mo = fx.media(spark, d).select("item_id", F.col("item_id").alias("moment_id"), ((F.col("item_id") % 60) * FT25).alias("src"))
    return ct.reverse_match(fx.clips(spark, d), mo)


@query("conform_to_frames", using("points", f""", p AS (SELECT event_id, user_id, t, {fdiv('t', str(fx.WORD_RATE))} AS frame FROM points)
SELECT event_id, user_id, frame, t, frame * {fx.WORD_RATE} AS snapped, CASE WHEN t - frame * {fx.WORD_RATE} <= (frame + 1) * {fx.WORD_RATE} - t THEN frame * {fx.WORD_RATE} ELSE (frame + 1) * {fx.WORD_RATE} END AS nearest,
 t - frame * {fx.WORD_RATE} AS off, count(*) OVER (PARTITION BY user_id, frame) AS in_frame FROM p"""))
def conform_to_frames(spark, d):
    return tl.conform_to_frames(fx.points(spark, d).select("event_id", "user_id", "t"), "user_id", F.lit(fx.WORD_RATE))


LOGTC = """lg AS (SELECT user_id AS reel, event_id AS seq, event_id % 24 AS h, (event_id * 7) % 60 AS m, CASE WHEN event_id % 5 = 0 THEN 0 ELSE (event_id * 11) % 60 END AS s, (event_id * 13) % 32 AS f FROM events),
lt AS (SELECT reel, seq, CASE seq % 4 WHEN 2 THEN m * 10000 + s * 100 + f ELSE h * 1000000 + m * 10000 + s * 100 + f END AS packed, h, m, s, f, CASE seq % 4 WHEN 0 THEN h || ':' || m || ':' || s || ':' || f WHEN 1 THEN h || ';' || m || ';' || s || ';' || f WHEN 2 THEN CAST(m * 10000 + s * 100 + f AS VARCHAR) ELSE m || '.' || s || '.' || f END AS tc FROM lg)"""


@query("timecode_audit", using("points", f""", {LOGTC}, q AS (SELECT reel, seq, tc, CASE WHEN seq % 4 < 2 THEN h ELSE 0 END AS h, m, s, f FROM lt),
k AS (SELECT *, (h * 3600 + m * 60 + s) * 30 + f - CASE WHEN f < 30 THEN 2 * (h * 60 + m - (h * 60 + m) // 10) ELSE 0 END AS frames FROM q),
l AS (SELECT *, {sql_tc('frames', 30, True)} AS label, max(frames) OVER (PARTITION BY reel ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi, count(*) OVER (PARTITION BY reel, frames) AS n FROM k)
SELECT reel, seq, tc, frames, label, lpad(CAST(h AS VARCHAR), 2, '0') || ';' || lpad(CAST(m AS VARCHAR), 2, '0') || ';' || lpad(CAST(s AS VARCHAR), 2, '0') || ';' || lpad(CAST(f AS VARCHAR), 2, '0') <> label AS invalid, coalesce(frames < hi, false) AS out_of_order, n > 1 AS duplicate FROM l"""))
def timecode_audit(spark, d):
    e = F.col("event_id")
    h, m, s, f = e % 24, (e * 7) % 60, F.when(e % 5 == 0, 0).otherwise((e * 11) % 60), (e * 13) % 32
    join = lambda sep, *p: F.concat_ws(sep, *[x.cast("string") for x in p])
    tc = F.when(e % 4 == 0, join(":", h, m, s, f)).when(e % 4 == 1, join(";", h, m, s, f)).when(e % 4 == 2, (m * 10000 + s * 100 + f).cast("string")).otherwise(join(".", m, s, f))
    rows = fx.table(spark, d, "events").select(F.col("user_id").alias("reel"), e.alias("seq"), tc.alias("tc"))
    return tl.timecode_audit(rows, 30000, 1001, True)


@query("source_timecode_rebase", using("clips media", "SELECT clip_id, c.item_id, source_in - coalesce(start_timecode, 0) AS source_in, CASE WHEN rn % 6 = 0 THEN source_in + 7 - coalesce(start_timecode, 0) END AS frame_hold FROM clips c LEFT JOIN media m USING (item_id)"))
def source_timecode_rebase(spark, d):
    c = fx.clips(spark, d).withColumn("frame_hold", F.when(F.col("rn") % 6 == 0, F.col("source_in") + 7))
    k = fx.keyframes(spark, d).withColumn("item_id", F.col("owner_id"))
    return tl.source_timecode_rebase(c, k, fx.media(spark, d))[0].select("clip_id", "item_id", "source_in", "frame_hold")


@query("offline_scan", using("media files", """, s AS (SELECT item_id, CASE WHEN offline THEN 'offline' WHEN path NOT IN (SELECT path FROM files) THEN 'missing' WHEN proxy_path IS NOT NULL AND proxy_path NOT IN (SELECT path FROM files) THEN 'proxyMissing' END AS status FROM media) SELECT * FROM s WHERE status IS NOT NULL"""))
def offline_scan(spark, d):
    return ct.offline_scan(fx.media(spark, d), fx.files(spark, d))


def gone(spark, d):
    m, f = fx.media(spark, d), fx.files(spark, d)
    return m.join(ct.offline_scan(m, f).filter("status = 'missing'"), "item_id", "left_semi")


GONE = """, gone AS (SELECT * FROM media WHERE NOT offline AND path NOT IN (SELECT path FROM files))"""


@query("relink_candidates", using("media files", GONE + """, fn AS (SELECT *, lower(regexp_extract(path, '[^/]*$')) AS nm FROM files), mn AS (SELECT *, lower(regexp_extract(path, '[^/]*$')) AS nm FROM gone),
j AS (SELECT m.item_id, f.path, CASE WHEN f.size = m.size AND f.fingerprint = m.fingerprint THEN 15 ELSE 6 END AS score FROM mn m JOIN fn f USING (nm)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, path) AS k FROM j) SELECT item_id, path, score FROM r WHERE k = 1"""))
def relink_candidates(spark, d):
    return ct.relink_candidates(gone(spark, d), fx.files(spark, d), FT25)


@query("folder_remap", using("media files", GONE + """, g AS (SELECT * FROM gone WHERE item_id % 3 = 0) SELECT item_id, '/new' || substr(path, 5) AS new_path FROM g WHERE '/new' || substr(path, 5) IN (SELECT path FROM files)"""))
def folder_remap(spark, d):
    m = gone(spark, d)
    pairs = fx.media(spark, d).filter("item_id % 30 = 0").select(F.col("path").alias("old"), F.regexp_replace("path", "^/vol", "/new").alias("new"))
    return ct.folder_remap(pairs, m, fx.files(spark, d))


# items of the nesting queries: sequences are NESTED + id, subclips SUB + part
def nested_clips(spark, d):
    s = F.col("sequence_id")
    inner = F.when((F.col("rn") % 5 == 0) & (s > 0), NESTED + F.floor(s / 2).cast("long"))
    item = F.coalesce(inner, F.when(F.col("rn") % 5 == 1, SUB + F.col("item_id")).otherwise(F.col("item_id")))
    return fx.clips(spark, d).withColumns({"nested_id": F.floor(s / 2).cast("long"), "item_id": item}).withColumn("nested_id", F.when((F.col("rn") % 5 == 0) & (s > 0), F.col("nested_id")))


NCLIPS = f"""nc AS (SELECT * REPLACE (CASE WHEN rn % 5 = 0 AND sequence_id > 0 THEN {NESTED} + sequence_id // 2 WHEN rn % 5 = 1 THEN {SUB} + item_id ELSE item_id END AS item_id), CASE WHEN rn % 5 = 0 AND sequence_id > 0 THEN sequence_id // 2 END AS nested_id FROM clips)"""
EDGES = f"""{NCLIPS}, ed AS (SELECT DISTINCT {NESTED} + sequence_id AS src, item_id AS dst FROM nc UNION SELECT {SUB} + p_partkey, p_partkey FROM part)"""


def edges(spark, d):
    c = nested_clips(spark, d).select((NESTED + F.col("sequence_id")).alias("src"), F.col("item_id").alias("dst"))
    return c.union(fx.table(spark, d, "part").select(SUB + F.col("p_partkey"), "p_partkey"))


def nests(spark, d):
    return nested_clips(spark, d).filter("nested_id is not null").select(F.col("sequence_id").alias("src"), F.col("nested_id").alias("dst")).distinct()


def rec(sql):
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("item_closure", rec(using("clips", f""", {EDGES}, re AS (SELECT {NESTED} + o_orderkey AS root, {NESTED} + o_orderkey AS item FROM orders WHERE o_orderkey % 50 = 0 UNION SELECT root, dst FROM re JOIN ed ON item = src) SELECT * FROM re""")))
def item_closure(spark, d):
    roots = fx.table(spark, d, "orders").filter("o_orderkey % 50 = 0").select((NESTED + F.col("o_orderkey")).alias("root"))
    return ns.item_closure(edges(spark, d), roots)


def loops(spark, d):
    n = nests(spark, d)
    return n.union(fx.table(spark, d, "orders").filter("o_orderkey % 97 = 1").select(F.floor(F.col("o_orderkey") / 4).cast("long"), "o_orderkey"))


@query("nest_cycles", rec(using("clips", f""", {NCLIPS}, ed AS (SELECT DISTINCT sequence_id AS src, nested_id AS dst FROM nc WHERE nested_id IS NOT NULL UNION SELECT o_orderkey // 4, o_orderkey FROM orders WHERE o_orderkey % 97 = 1),
re AS (SELECT src AS root, dst AS item FROM ed UNION SELECT root, dst FROM re JOIN ed ON item = src WHERE item <> root) SELECT DISTINCT root AS sequence_id FROM re WHERE root = item""")))
def nest_cycles(spark, d):
    return ns.nest_cycles(loops(spark, d))


FLATC = ["sequence_id", "track_id", "kind", "item_id", "start", "duration", "source_in", "speed", "reverse"]


@query("flatten_nests", rec(using("clips", f""", {NCLIPS}, fl AS (SELECT sequence_id, track_id, kind, item_id, nested_id, start, duration, source_in, speed, reverse FROM nc
 UNION ALL SELECT o.sequence_id, o.track_id, o.kind, i.item_id, i.nested_id, o.start + greatest(i.start, o.source_in) - o.source_in, least(i.start + i.duration, o.source_in + o.duration) - greatest(i.start, o.source_in),
  i.source_in + {r0('greatest(o.source_in - i.start, 0) * i.speed')}, i.speed, i.reverse FROM fl o JOIN nc i ON o.nested_id = i.sequence_id AND o.kind = i.kind AND i.start < o.source_in + o.duration AND i.start + i.duration > o.source_in WHERE o.speed = 1 AND NOT o.reverse)
SELECT {', '.join(FLATC)} FROM fl WHERE nested_id IS NULL""")))
def flatten_nests(spark, d):
    return ns.flatten_nests(nested_clips(spark, d))[0].select(FLATC)


def parents(spark, d):
    return fx.table(spark, d, "part").select((SUB + F.col("p_partkey")).alias("item_id"), F.col("p_partkey").alias("parent_id"))


def seq_roots(spark, d):
    return fx.table(spark, d, "orders").filter("o_orderkey % 50 = 3").select(F.col("o_orderkey").alias("root"))


REACH = f"""{NCLIPS}, re AS (SELECT o_orderkey AS root, o_orderkey AS item FROM orders WHERE o_orderkey % 50 = 3 UNION SELECT root, nested_id FROM re JOIN nc ON item = sequence_id WHERE nested_id IS NOT NULL)"""


@query("used_ranges", rec(using("clips", f""", {REACH}, c AS (SELECT CASE WHEN item_id >= {SUB} THEN item_id - {SUB} ELSE item_id END AS item_id,
 CASE WHEN reverse THEN source_in + {r0('duration * speed')} - 1 ELSE source_in END AS a,
 CASE WHEN reverse THEN source_in + {r0('duration * speed')} - {r0('(duration - 1) * speed')} - 1 ELSE source_in + {r0('(duration - 1) * speed')} END AS b FROM nc WHERE nested_id IS NULL AND sequence_id IN (SELECT item FROM re))
SELECT item_id, min(least(a, b)) AS lo, max(greatest(a, b)) + 1 AS hi FROM c GROUP BY 1""")))
def used_ranges(spark, d):
    # sequences and items share one id space inside the operator
    c = nested_clips(spark, d).withColumns({"sequence_id": NESTED + F.col("sequence_id")})
    n = nests(spark, d).select((NESTED + F.col("src")).alias("src"), (NESTED + F.col("dst")).alias("dst"))
    return ns.used_ranges(c, parents(spark, d), n, seq_roots(spark, d).select((NESTED + F.col("root")).alias("root")))


@query("audio_needs", rec(using("clips media", f""", {REACH}, c AS (SELECT root, CASE WHEN item_id >= {SUB} THEN item_id - {SUB} ELSE item_id END AS item_id, source_in AS lo, source_in + {r0('duration * speed')} AS hi FROM nc JOIN re ON item = sequence_id WHERE nested_id IS NULL AND kind = 'audio')
SELECT root, item_id, min(greatest(lo - {FT25}, 0)) AS start, max(least(hi + {FT25}, m.duration)) AS "end" FROM c JOIN media m USING (item_id) GROUP BY 1, 2""")))
def audio_needs(spark, d):
    return ns.audio_needs(nested_clips(spark, d), parents(spark, d), fx.media(spark, d), nests(spark, d), seq_roots(spark, d), handles=FT25)


@query("nest_overhang", using("clips", f""", {NCLIPS}, du AS (SELECT sequence_id AS nested_id, max(start + duration) // 3 AS contents FROM nc GROUP BY 1), j AS (SELECT *, source_in + {r0('duration * speed')} - contents AS past FROM nc JOIN du USING (nested_id)),
k AS (SELECT *, greatest(least({r0('past / speed')}, duration), 0) AS n FROM j WHERE past > 0)
SELECT clip_id, CASE WHEN source_in >= contents OR reverse THEN start ELSE start + duration - n END AS start, CASE WHEN source_in >= contents OR NOT reverse THEN start + duration ELSE start + n END AS "end" FROM k WHERE source_in >= contents OR n > 0"""))
def nest_overhang(spark, d):
    c = nested_clips(spark, d)
    du = c.groupBy(F.col("sequence_id").alias("nested_id")).agg(F.call_function("div", F.max(F.col("start") + F.col("duration")), F.lit(3)).alias("contents"))
    return ns.nest_overhang(c, du)


@query("remove_unused", using("clips", f""", {NCLIPS}, nn AS (SELECT * FROM nc WHERE item_id % 3 <> 1), u AS (SELECT item_id FROM nn UNION SELECT item_id - {SUB} FROM nn WHERE item_id >= {SUB} AND item_id < {NESTED})
SELECT p_partkey AS item_id FROM part WHERE p_partkey NOT IN (SELECT item_id FROM u) UNION ALL SELECT {SUB} + p_partkey FROM part WHERE {SUB} + p_partkey NOT IN (SELECT item_id FROM u)"""))
def remove_unused(spark, d):
    p = fx.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(True).alias("removable"))
    return ns.remove_unused(p.unionByName(parents(spark, d).withColumn("removable", F.lit(True))), nested_clips(spark, d).filter("item_id % 3 <> 1"))


@query("project_subset", rec(using("clips", f""", {EDGES}, re AS (SELECT {NESTED} + o_orderkey AS root, {NESTED} + o_orderkey AS item FROM orders WHERE o_orderkey % 500 = 0 UNION SELECT root, dst FROM re JOIN ed ON item = src)
SELECT clip_id, item_id, sequence_id FROM nc WHERE {NESTED} + sequence_id IN (SELECT item FROM re)""")))
def project_subset(spark, d):
    roots = fx.table(spark, d, "orders").filter("o_orderkey % 500 = 0").select((NESTED + F.col("o_orderkey")).alias("root"))
    c = nested_clips(spark, d).withColumn("owner", NESTED + F.col("sequence_id"))
    return ns.project_subset({"clips": (c, "owner")}, edges(spark, d), roots)["clips"].select("clip_id", "item_id", "sequence_id")


@query("merge_projects", using("clips", """, fr AS (SELECT fragment_id, max(top) AS top FROM (SELECT p_partkey % 10 AS fragment_id, max(p_partkey) + 1 AS top FROM part GROUP BY 1 UNION ALL SELECT sequence_id % 10, max(greatest(clip_id, item_id)) + 1 FROM clips GROUP BY 1) GROUP BY 1),
b AS (SELECT fragment_id, CAST(coalesce(sum(top) OVER (ORDER BY fragment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM fr)
SELECT sequence_id, clip_id + base AS clip_id, item_id + base AS item_id FROM clips JOIN b ON fragment_id = sequence_id % 10"""))
def merge_projects(spark, d):
    it = fx.table(spark, d, "part").select((F.col("p_partkey") % 10).alias("fragment_id"), F.col("p_partkey").alias("item_id"))
    c = fx.clips(spark, d).select((F.col("sequence_id") % 10).alias("fragment_id"), "sequence_id", "clip_id", "item_id")
    return ns.merge_projects(it, c)[1].select("sequence_id", "clip_id", "item_id")


@query("same_source_clips", using("clips", "SELECT clip_id, item_id FROM clips WHERE item_id IN (SELECT item_id FROM clips WHERE clip_id % 5000 = 1)"))
def same_source_clips(spark, d):
    c = fx.clips(spark, d)
    return ct.same_source_clips(c, c.filter("clip_id % 5000 = 1").select("clip_id")).select("clip_id", "item_id")


DUP = """, md AS (SELECT p_partkey AS item_id, p_name AS nm, p_type AS ty, p_partkey % 13 = 0 AS off FROM part), rm AS (SELECT item_id, min(item_id) OVER (PARTITION BY nm, ty, off) AS kept_id FROM md)"""


def dedupe(spark, d):
    p = fx.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("path"), F.col("p_type").alias("interpret"), (F.col("p_partkey") % 13 == 0).alias("offline"))
    e = fx.table(spark, d, "events").select((F.col("event_id") % 1500).alias("owner_id"), F.col("event_id").alias("marker_id"), (F.col("event_id") % 7).alias("start"), F.col("event_type").alias("name"))
    return ct.dedupe_media(p, fx.clips(spark, d), e, ["path", "interpret", "offline"])


@query("dedupe_media_clips", using("clips", DUP + " SELECT clip_id, coalesce(kept_id, c.item_id) AS item_id FROM clips c LEFT JOIN rm USING (item_id)"))
def dedupe_media_clips(spark, d):
    return dedupe(spark, d)[1].select("clip_id", "item_id")


@query("dedupe_media_markers", using("clips", DUP + """, mk AS (SELECT event_id % 1500 AS owner, event_id AS marker_id, event_id % 7 AS start, event_type AS name FROM events), k AS (SELECT mk.*, coalesce(kept_id, owner) AS owner_id FROM mk LEFT JOIN rm ON item_id = owner),
r AS (SELECT *, row_number() OVER (PARTITION BY owner_id, start, name ORDER BY owner, marker_id) AS i FROM k WHERE owner <> owner_id)
SELECT owner_id, marker_id, start, name FROM k WHERE owner = owner_id UNION ALL SELECT owner_id, marker_id, start, name FROM r WHERE i = 1 AND NOT EXISTS (SELECT 1 FROM k WHERE k.owner = k.owner_id AND k.owner_id = r.owner_id AND k.start = r.start AND k.name = r.name)"""))
def dedupe_media_markers(spark, d):
    return dedupe(spark, d)[2]


@query("storage_estimate", using("clips media", f""", r AS (SELECT item_id, min(source_in) AS lo, max(source_in + {r0('duration * speed')}) AS hi FROM clips GROUP BY 1), s AS (SELECT item_id, (hi - lo) / 254016000000.0::DOUBLE AS secs, CASE WHEN item_id % 6 = 5 THEN NULL ELSE 1920 END AS w FROM r)
SELECT item_id, preset, CAST(floor(CASE WHEN w IS NULL THEN 192000.0::DOUBLE * secs ELSE mbps * 1e6::DOUBLE / 8.0::DOUBLE * secs + 192000.0::DOUBLE * secs END) AS BIGINT) AS bytes FROM s,
 (SELECT 'prores half' AS preset, 147.0::DOUBLE * (2073600.0::DOUBLE * 0.5 * 0.5) / 2073600.0::DOUBLE * 25.0::DOUBLE / 29.97::DOUBLE AS mbps UNION ALL SELECT 'h264', greatest(2073600.0::DOUBLE / 200.0, 800.0) / 1000.0::DOUBLE)"""))
def storage_estimate(spark, d):
    c = ns.media_span(fx.clips(spark, d)).groupBy("item_id").agg(F.min("source_in").alias("lo"), F.max(F.col("source_in") + F.round(F.col("duration") * F.col("speed"), 0).cast("long")).alias("hi"))
    m = fx.media(spark, d).select("item_id", F.when(F.col("item_id") % 6 != 5, 1920).alias("width"), F.when(F.col("item_id") % 6 != 5, 1080).alias("height"), F.lit(25).alias("num"), F.lit(1).alias("den"), F.lit(48000).alias("sample_rate"))
    return ct.storage_estimate(m, c, [{"name": "prores half", "scale": 0.5, "mbps_1080p30": 147.0}, {"name": "h264"}])


SYNC = f"""sy AS (SELECT sequence_id AS group_id, clip_id, rn = 1 AS reference, 0 AS range_start, source_in AS in_point, source_in + duration AS out_point, start * 50 AS timecode, ft FROM clips)"""


def sync_clips(spark, d):
    return fx.clips(spark, d).select(F.col("sequence_id").alias("group_id"), "clip_id", (F.col("rn") == 1).alias("reference"), F.lit(0).cast("long").alias("range_start"), F.col("source_in").alias("in_point"), (F.col("source_in") + F.col("duration")).alias("out_point"), (F.col("start") * 50).alias("timecode"), "ft")


@query("sync_placements", using("clips", f""", {SYNC}, a AS (SELECT *, CASE WHEN reference THEN out_point ELSE out_point - 1000 END AS anchor FROM sy), b AS (SELECT *, -anchor - min(-anchor) OVER (PARTITION BY group_id) AS r FROM a)
SELECT group_id, clip_id, anchor, CASE WHEN r - {snap('r', 'ft')} <= {snap('r', 'ft')} + ft - r THEN {snap('r', 'ft')} ELSE {snap('r', 'ft')} + ft END AS start FROM b"""))
def sync_placements(spark, d):
    return tl.sync_placements(sync_clips(spark, d), "out", F.col("ft"), offset=1000)


@query("sync_placements_timecode", using("clips", f""", {SYNC}, a AS (SELECT *, -(timecode % {3600*TPS}) AS anchor FROM sy) SELECT group_id, clip_id, anchor, -anchor - min(-anchor) OVER (PARTITION BY group_id) AS start FROM a"""))
def sync_placements_timecode(spark, d):
    return tl.sync_placements(sync_clips(spark, d), "timecode_no_hours", F.col("ft"), snapped=False)


@query("sync_placements_marker", using("clips", f""", {SYNC}, mk AS (SELECT clip_id, min(start // 3) AS anchor FROM clips WHERE rn % 3 <> 0 GROUP BY 1), a AS (SELECT sy.group_id, clip_id, anchor FROM sy JOIN mk USING (clip_id)) SELECT group_id, clip_id, anchor, -anchor - min(-anchor) OVER (PARTITION BY group_id) AS start FROM a"""))
def sync_placements_marker(spark, d):
    mk = fx.clips(spark, d).filter("rn % 3 != 0").select("clip_id", F.call_function("div", F.col("start"), F.lit(3)).alias("start"), F.lit("Clap").alias("name"))
    return tl.sync_placements(sync_clips(spark, d), "marker", F.col("ft"), markers=mk, marker_name="clap", snapped=False)


@query("duck_triggers", using("spans", """, s AS (SELECT *, CASE rn % 4 WHEN 0 THEN 'music' WHEN 1 THEN 'dialogue' WHEN 2 THEN 'sfx' END AS sound FROM spans WHERE kind = 'audio')
SELECT a.sequence_id, a.clip_id AS target, b.clip_id AS "trigger" FROM s a JOIN s b ON a.sequence_id = b.sequence_id AND a.clip_id <> b.clip_id AND a.start < b."end" AND b.start < a."end"
WHERE a.sound = 'music' AND b.enabled AND ((b.sound IS NULL AND a.clip_id % 2 = 0) OR (b.sound = 'dialogue' AND b.clip_id % 7 <> 0))"""))
def duck_triggers(spark, d):
    m = F.col("rn") % 4
    c = fx.clips(spark, d).filter("kind = 'audio'").withColumns({
        "sound": F.when(m == 0, "music").when(m == 1, "dialogue").when(m == 2, "sfx"), "mute": F.col("clip_id") % 7 == 0,
        "against": F.when(m == 0, F.array(F.lit("dialogue"))), "against_untyped": F.col("clip_id") % 2 == 0,
    })
    return tl.duck_triggers(c)
