"""Media catalogue: find, search bins, list columns, usage, relinking, duplicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tickloom.functions.timebase import TPS, col, fdiv, frame_at, idiv, source_time, timecode, timecode_base
from tickloom.operators.intervals import overlap_join

# The built-in find columns.
FIND_COLUMNS = ["name", "label", "media type", "frame rate", "media duration", "video info", "audio info", "file path"]
SALT = 64


def _test(op: str, hay: Column, text: str, case: bool) -> Column:
    hay, text = (hay, text) if case else (F.lower(hay), text.lower())
    hay = F.coalesce(hay, F.lit(""))
    return {
        "contains": hay.contains(text), "matches": hay == text, "beginsWith": hay.startswith(text),
        "endsWith": hay.endswith(text), "doesNotContain": ~hay.contains(text),
    }[op]


def _cell_test(op: str, text: str, case: bool):
    return lambda v: _test(op, v, text, case)


def _key_is(name: str):
    return lambda e: F.lower(e["key"]) == name


def find_predicate(columns: dict[str, Column], metadata: Column | None, rows: Sequence[tuple[str, str, str]], match_all: bool = True, case: bool = False) -> Column:
    """Condition for a query of (column, op, text) rows; empty rows are ignored, no rows match nothing."""
    tests = []
    for column, op, text in rows:
        if not text:
            continue
        name = column.lower()
        if name in ("", "all"):
            parts = [_test(op, c, text, case) for c in columns.values()]
            every = op == "doesNotContain"
            if metadata is not None:
                hof = F.forall if every else F.exists
                parts.append(hof(F.map_values(metadata), _cell_test(op, text, case)))
            tests.append(reduce(and_ if every else or_, parts))
        elif name in columns:
            tests.append(_test(op, columns[name], text, case))
        else:
            value = F.lit("")
            if metadata is not None:
                hit = F.filter(F.map_entries(metadata), _key_is(name))
                value = F.when(F.size(hit) > 0, hit[0]["value"]).otherwise("")
            tests.append(_test(op, value, text, case))
    return reduce(and_ if match_all else or_, tests) if tests else F.lit(False)


def catalog_find(catalog: DataFrame, rows: Sequence[tuple[str, str, str]], match_all: bool = True, case: bool = False) -> DataFrame:
    """Ids of matching items; graphics never match. ``catalog`` has text columns and ``metadata``."""
    columns = {c: F.col(f"`{c}`") for c in FIND_COLUMNS if c in catalog.columns}
    return catalog.filter((F.col("kind") != "graphic") & find_predicate(columns, F.col("metadata"), rows, match_all, case)).select("item_id")


def search_bins(catalog: DataFrame, bins: DataFrame) -> DataFrame:
    """Membership of saved queries ``(bin_id, column, op, text, match_all, case_sensitive)``.

    Cells and query rows meet in an equi join on the column name, salted by item so that neither a
    popular column nor "all" makes one hot task. Negative rows are solved as "no cell contains".
    """
    rows = bins.filter("text != ''").withColumns({"column": F.when(F.col("column") == "", "all").otherwise(F.lower("column")), "rid": F.xxhash64("bin_id", "column", "op", "text")}).distinct()
    need = rows.groupBy("bin_id").agg(F.sum(F.when(F.col("op") == "doesNotContain", 1).otherwise(0)).alias("neg"), F.count("*").alias("n"), F.max("match_all").alias("match_all"))
    items = catalog.filter("kind != 'graphic'").withColumn("salt", F.pmod(F.xxhash64("item_id"), F.lit(SALT)))
    own = [F.struct(F.lit(c).alias("c"), F.coalesce(F.col(f"`{c}`"), F.lit("")).alias("v")) for c in FIND_COLUMNS if c in catalog.columns]
    meta = F.transform(F.map_entries("metadata"), lambda e: F.struct(F.lower(e["key"]).alias("c"), e["value"].alias("v")))
    cells = items.select("item_id", "salt", F.explode(F.concat(F.array(*own), meta)).alias("e")).select("item_id", "salt", F.explode(F.array(F.col("e.c"), F.lit("all"))).alias("column"), "e.v")
    salted = rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    v = F.when(F.col("case_sensitive"), F.col("v")).otherwise(F.lower("v"))
    t = F.when(F.col("case_sensitive"), F.col("text")).otherwise(F.lower("text"))
    hit = (
        F.when(F.col("op").isin("contains", "doesNotContain"), v.contains(t)).when(F.col("op") == "matches", v == t)
        .when(F.col("op") == "beginsWith", v.startswith(t)).otherwise(v.endswith(t))
    )
    hits = cells.join(salted, ["column", "salt"]).filter(hit).groupBy("bin_id", "item_id").agg(
        F.count_distinct(F.when(F.col("op") != "doesNotContain", F.col("rid"))).alias("pos"), F.count_distinct(F.when(F.col("op") == "doesNotContain", F.col("rid"))).alias("bad")
    )
    # bins an item can enter without a single hit
    is_open = F.when(F.col("match_all"), F.col("neg") == F.col("n")).otherwise(F.col("neg") > 0)
    free = need.filter(is_open).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    untouched = items.select("item_id", "salt").join(free.select("bin_id", "salt"), "salt").drop("salt").join(hits, ["bin_id", "item_id"], "left_anti")
    met = hits.join(need, "bin_id").filter(
        F.when(F.col("match_all"), (F.col("pos") == F.col("n") - F.col("neg")) & (F.col("bad") == 0)).otherwise((F.col("pos") > 0) | (F.col("bad") < F.col("neg")))
    )
    return met.select("bin_id", "item_id").unionByName(untouched.select("bin_id", "item_id"))


def timeline_find(clips: DataFrame, items: DataFrame, markers: DataFrame, rows, match_all: bool = True, case: bool = False, within: str = "all") -> DataFrame:
    """Clips by name (or the item's) and markers by name or comment, in time order."""
    live = [r for r in rows if r[2]]
    test = lambda c: find_predicate({"name": c}, None, [("name", op, text) for _, op, text in live], match_all, case)
    parts = []
    if within != "markers":
        c = clips.join(items.select("item_id", F.col("name").alias("_item")), "item_id", "left")
        shown = F.when(F.coalesce("name", F.lit("")) == "", F.col("_item")).otherwise(F.col("name"))
        parts.append(c.filter(test(shown)).select(F.col("sequence_id").alias("owner_id"), F.lit("clip").alias("what"), F.col("clip_id").alias("id"), F.col("start").alias("t")))
    if within != "clips":
        m = markers.filter(test(F.col("name")) | ((F.coalesce("comment", F.lit("")) != "") & test(F.col("comment"))))
        parts.append(m.select("owner_id", F.lit("marker").alias("what"), F.col("marker_id").alias("id"), F.col("start").alias("t")))
    return reduce(DataFrame.unionByName, parts).orderBy("t", "what", "id")


def item_usage(clips: DataFrame) -> DataFrame:
    return clips.groupBy("item_id").agg(F.count_if(F.col("kind") == "video").alias("v"), F.count_if(F.col("kind") == "audio").alias("a"))


def file_size_text(b) -> Column:
    """Bytes in the largest unit that they fill; a value halfway between two texts takes the even digit."""
    b = col(b).cast("long")

    def scaled(n: int, digits: int, unit: str) -> Column:
        k = 10**digits
        whole, rest = idiv(b, F.lit(n)), b % n
        part, left = idiv(rest * k, F.lit(n)), (rest * k) % n
        steps = whole * k + part
        steps = steps + F.when((left * 2 > n) | ((left * 2 == n) & (steps % 2 == 1)), 1).otherwise(0)
        text = idiv(steps, F.lit(k)).cast("string")
        return F.concat(text, F.lit("."), F.lpad((steps % k).cast("string"), digits, "0"), F.lit(unit)) if digits else F.concat(text, F.lit(unit))

    return F.when(b >= 1 << 30, scaled(1 << 30, 2, " GB")).when(b >= 1 << 20, scaled(1 << 20, 1, " MB")).when(b >= 1 << 10, scaled(1 << 10, 0, " KB")).otherwise(F.concat(b.cast("string"), F.lit(" B")))


def catalog_columns(items: DataFrame, media: DataFrame, clips: DataFrame, num: int, den: int, metadata: Sequence[str] = ()) -> DataFrame:
    """List view: times as timecode at the item rate, in/out points, usage, status, sizes, metadata.

    ``media`` may hold ``mark_in``/``mark_out`` (inclusive) and ``range_start``/``range_duration`` of subclips.
    """
    ft = idiv(F.lit(TPS * den), F.lit(num))
    have = set(media.columns)
    opt = lambda c, t="long": F.col(c) if c in have else F.lit(None).cast(t)
    j = items.join(media, "item_id", "left").join(item_usage(clips), "item_id", "left")
    offset = F.coalesce(opt("range_start"), F.lit(0))
    dur = F.coalesce(opt("range_duration"), F.col("duration"))
    first = F.coalesce("start_timecode", F.lit(0)) + offset
    mi = F.coalesce(opt("mark_in"), F.lit(0))
    mo = F.least(F.coalesce(opt("mark_out") + ft, dur), F.greatest(dur, ft))
    base = timecode_base(F.lit(num), F.lit(den))
    tc = lambda t: F.when(t.isNotNull(), timecode(frame_at(t, ft), base, False)).otherwise("")
    out = {
        "media_start": tc(first), "media_end": tc(F.when(dur > 0, first + dur - ft).otherwise(first)), "media_duration": tc(dur),
        "in_point": tc(first + mi), "out_point": tc(first + mo - ft), "in_out_duration": tc(mo - mi),
        "subclip_start": tc(F.coalesce("start_timecode", F.lit(0)) + opt("range_start")), "subclip_end": tc(F.coalesce("start_timecode", F.lit(0)) + opt("range_start") + opt("range_duration") - ft),
        "video_usage": F.when(F.coalesce("v", F.lit(0)) > 0, F.col("v").cast("string")).otherwise(""),
        "audio_usage": F.when(F.coalesce("a", F.lit(0)) > 0, F.col("a").cast("string")).otherwise(""),
        "status": F.when(F.col("offline"), "Offline").when(F.col("path").isNotNull(), "Online").otherwise(""),
        "proxy": F.when(F.col("proxy_path").isNotNull(), "Attached").when(F.col("path").isNotNull(), "None").otherwise(""),
        "file_path": F.coalesce("path", F.lit("")), "file_size": F.when(F.col("size").isNotNull(), file_size_text("size")).otherwise(""),
    }
    meta = {m: F.coalesce(F.col("metadata")[m], F.lit("")) for m in metadata}
    return j.select("item_id", "name", "label", *[c.alias(n) for n, c in {**out, **meta}.items()])


def catalog_sort(catalog: DataFrame, column: str, desc: bool = False) -> DataFrame:
    """Order by a number or lower-case text, then name, then id; a range-partitioned sort."""
    key = F.lower(column) if dict(catalog.dtypes)[column] == "string" else F.col(column)
    turn = (lambda c: c.desc()) if desc else (lambda c: c.asc())
    return catalog.orderBy(turn(key), turn(F.lower("name")), F.col("item_id").asc())


def same_source_clips(clips: DataFrame, selected: DataFrame) -> DataFrame:
    return clips.join(clips.join(selected, "clip_id", "left_semi").select("item_id").distinct(), "item_id", "left_semi")


def reverse_match(clips: DataFrame, moments: DataFrame) -> DataFrame:
    """Timeline positions that show a media time; ``moments(item_id, moment_id, src)``."""
    c = clips.filter("frame_hold is null and speed > 0").withColumns({"m0": F.col("source_in"), "m1": F.col("source_in") + F.round(F.col("duration") * F.col("speed"), 0).cast("long")})
    m = moments.withColumns({"s0": F.col("src"), "s1": F.col("src") + 1})
    j = overlap_join(c, m, ["item_id"], ("m0", "m1"), ("s0", "s1"))
    rel = F.when(F.col("reverse"), F.col("m1") - 1 - F.col("src")).otherwise(F.col("src") - F.col("m0"))
    t = F.col("start") + F.floor(rel.cast("double") / F.col("speed")).cast("long")
    moving = j.withColumn("t", t).filter("t < start + duration").select("moment_id", "clip_id", "t")
    held = clips.filter("frame_hold is not null").join(moments, (clips.item_id == moments.item_id) & (clips.frame_hold == moments.src)).select("moment_id", "clip_id", F.col("start").alias("t"))
    return moving.unionByName(held)


def offline_scan(media: DataFrame, files: DataFrame) -> DataFrame:
    """Items made offline, without their file, or only without their proxy."""
    paths = files.select("path").distinct()
    m = media.join(paths.withColumn("_f", F.lit(True)), "path", "left").join(paths.select(F.col("path").alias("proxy_path"), F.lit(True).alias("_p")), "proxy_path", "left")
    status = F.when(F.col("offline"), "offline").when(F.col("_f").isNull(), "missing").when(F.col("proxy_path").isNotNull() & F.col("_p").isNull(), "proxyMissing")
    return m.select("item_id", status.alias("status")).filter("status is not null")


def file_name(path) -> Column:
    return F.element_at(F.split(F.regexp_replace(col(path), r"\\", "/"), "/"), -1)


def stem(name) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def relink_candidates(missing: DataFrame, files: DataFrame, ft: int, clip_id: bool = True, duration: bool = False, media_start: bool = False, exact: bool = True) -> DataFrame:
    """Best file for each missing item, by score 8/4/2/1 (identity, name, extension, all checks) and path.

    Files of one name can be many on both sides, so no name-by-name pairs are formed: files are
    folded to the least path per (name, property) first, and every tier is an equi join against
    such a folded table. ``files`` may carry probed ``duration`` and ``start_timecode``.
    """
    keyed = lambda df, path: df.withColumns({"_name": F.lower(file_name(path))}).withColumn("_stem", stem(F.col("_name")))
    m = keyed(missing, "path").select("item_id", "_name", "_stem", "size", "fingerprint", *[c for c in ("duration", "start_timecode") if duration or media_start])
    f = keyed(files, "path")
    tiers = []
    for key, ext in [("_name", True)] + ([] if exact else [("_stem", False)]):
        marks = 4 + (2 if ext else 0)
        ident = f.groupBy(key, "size", "fingerprint").agg(F.min_by(F.struct("path", *[c for c in ("duration", "start_timecode") if duration or media_start]), "path").alias("c"))
        same = m.join(ident, [key, "size", "fingerprint"])
        fine = F.lit(ext or not exact)
        if duration:
            fine = fine & ~((F.col("duration") > 0) & (F.abs(F.col("c.duration") - F.col("duration")) > ft))
        if media_start:
            fine = fine & F.col("c.start_timecode").eqNullSafe(F.col("start_timecode"))
        tiers.append(same.select("item_id", F.col("c.path").alias("path"), (F.lit(8 + marks) + F.when(fine, 1).otherwise(0)).alias("score")))
        other = f.groupBy(key).agg(F.min("path").alias("path"))
        tiers.append(m.join(other, key).select("item_id", "path", F.lit(marks + (0 if clip_id or duration or media_start else 1)).alias("score")))
        if not clip_id and (duration or media_start):
            cut = [fdiv("duration", F.lit(ft)).alias("_d")] if duration else []
            near = f.select(key, "path", *cut, *(["start_timecode"] if media_start else []), *([F.col("duration").alias("_fd")] if duration else []))
            on = [key] + (["_d"] if duration else []) + (["start_timecode"] if media_start else [])
            low = near.groupBy(*on, *(["_fd"] if duration else [])).agg(F.min("path").alias("path"))
            probe = m.withColumn("_d", F.explode(F.array(*[fdiv("duration", F.lit(ft)) + i for i in (-1, 0, 1)]))) if duration else m
            j = probe.join(low, on)
            if duration:
                j = j.filter(F.abs(F.col("_fd") - F.col("duration")) <= ft)
            tiers.append(j.select("item_id", "path", F.lit(marks + 1).alias("score")))
    ranked = reduce(DataFrame.unionByName, tiers).groupBy("item_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "path")).alias("b"))
    return ranked.select("item_id", F.col("b.path").alias("path"), (-F.col("b.s")).alias("score"))


def folder_remap(pairs: DataFrame, missing: DataFrame, files: DataFrame) -> DataFrame:
    """New paths for missing items from the folder moves that known (old, new) pairs imply."""
    parts = lambda c: F.split(F.regexp_replace(c, r"\\", "/"), "/")
    p = pairs.select(parts("old").alias("o"), parts("new").alias("n"))
    same = F.zip_with(F.reverse("o"), F.reverse("n"), lambda a, b: a.eqNullSafe(b))
    k = F.array_position(same, False)
    k = F.when(k == 0, F.size(same)).otherwise(k - 1).cast("int")
    p = p.withColumn("k", k).filter("k > 0")
    head = lambda c: F.array_join(F.slice(c, 1, F.greatest(F.size(c) - F.col("k"), F.lit(0))), "/")
    votes = p.select(head("o").alias("prefix"), head("n").alias("to")).filter("prefix != to").groupBy("prefix", "to").agg(F.count("*").alias("votes"))
    best = votes.groupBy("prefix").agg(F.min_by(F.struct("to", "votes"), F.struct((-F.col("votes")).alias("v"), "to")).alias("m"))
    pp = parts("path")
    opened = missing.select("item_id", "path", F.explode(F.sequence(F.lit(1), F.size(pp) - 1)).alias("i")).select(
        "item_id", F.array_join(F.slice(pp, 1, F.col("i")), "/").alias("prefix"), F.array_join(F.slice(pp, F.col("i") + 1, F.size(pp)), "/").alias("rest")
    )
    tried = opened.join(best, "prefix").select("item_id", F.concat("m.to", F.lit("/"), "rest").alias("new_path"), F.col("m.votes").alias("votes"), F.length("prefix").alias("deep"))
    found = tried.join(files.select(F.col("path").alias("new_path")).distinct(), "new_path", "left_semi")
    return found.groupBy("item_id").agg(F.min_by("new_path", F.struct((-F.col("votes")).alias("v"), (-F.col("deep")).alias("d"), "new_path")).alias("new_path"))


def dedupe_media(media: DataFrame, clips: DataFrame, markers: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(item -> kept item, clips remapped, markers of duplicates carried over once)."""
    kept = media.groupBy(*key).agg(F.min("item_id").alias("kept_id"))
    on = reduce(and_, [media[k].eqNullSafe(kept[k]) for k in key])
    remap = media.join(kept, on).select("item_id", "kept_id")
    moved = clips.join(remap, "item_id", "left").withColumn("item_id", F.coalesce("kept_id", "item_id")).drop("kept_id")
    mk = markers.join(remap, markers.owner_id == remap.item_id, "left").withColumn("_dup", F.coalesce(F.col("kept_id") != F.col("owner_id"), F.lit(False)))
    to = F.coalesce("kept_id", "owner_id")
    own = mk.filter("not _dup").select(to.alias("owner_id"), "marker_id", "start", "name")
    extra = mk.filter("_dup").groupBy(to.alias("owner_id"), "start", "name").agg(F.min_by("marker_id", F.struct("item_id", "marker_id")).alias("marker_id"))
    extra = extra.join(own.select("owner_id", "start", "name").distinct(), ["owner_id", "start", "name"], "left_anti")
    return remap, moved, own.unionByName(extra.select("owner_id", "marker_id", "start", "name"))


def storage_estimate(media: DataFrame, ranges: DataFrame, presets: Sequence[dict]) -> DataFrame:
    """Bytes per item and preset; presets are a short literal list, one row each per item.

    A preset has ``name``, ``scale`` and, for the rate-per-pixel family, ``mbps_1080p30``.
    """
    rows = F.array(*[F.struct(F.lit(p["name"]).alias("name"), F.lit(float(p.get("scale", 1.0))).alias("scale"), F.lit(p.get("mbps_1080p30")).cast("double").alias("mbps")) for p in presets])
    j = media.join(ranges, "item_id").withColumn("p", F.explode(rows))
    secs = F.greatest((F.col("hi") - F.col("lo")).cast("double") / float(TPS), F.lit(0.0))
    audio = F.coalesce(F.col("sample_rate"), F.lit(0)).cast("double") * 4.0 * secs
    px = (F.col("width") * F.col("height")).cast("double") * F.col("p.scale") * F.col("p.scale")
    fps = F.col("num").cast("double") / F.col("den")
    mbps = F.when(F.col("p.mbps").isNotNull(), F.col("p.mbps") * px / (1920.0 * 1080.0) * fps / 29.97).otherwise(F.greatest(px / 200.0, F.lit(800.0)) / 1000.0)
    total = F.when(F.col("width").isNull(), audio).otherwise(mbps * 1e6 / 8.0 * secs + audio)
    return j.select("item_id", F.col("p.name").alias("preset"), F.floor(total).cast("long").alias("bytes"))
