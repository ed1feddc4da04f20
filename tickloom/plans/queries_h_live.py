"""Session logs in batch and as streams over the event table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom.operators import audio as au
from tickloom.operators import pixels as px
from tickloom.operators import sessions as ss
from tickloom.operators.ordered import scan, sum_upto
from tickloom.plans import fixtures as fx
from tickloom.plans.queries_e_audio import SER, blocks, gated, rounded
from tickloom.plans.queries_f_pixels import SHOT, rec, shot_signatures
from tickloom.plans.registry import query
from tickloom.plans.sqltables import using
from tickloom.session import shared_folder, stored
from tickloom.streaming import live

RUNS = """lr AS (SELECT *, lag(level || source || message) OVER (PARTITION BY session_id ORDER BY ts_us, seq) AS p FROM log), li AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> level || source || message THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts_us, seq) AS run FROM lr)
SELECT session_id, CAST(run AS BIGINT) AS run, max(level) AS level, max(source) AS source, max(message) AS message, count(*) AS count, max(ts_us) AS last_us FROM li GROUP BY session_id, run"""


def folder_stream(spark, d, name, build):
    """A derived table as a stream: written once, then read file by file."""
    df = stored(spark, (d, f"stream-{name}"), lambda: build())
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    return spark.readStream.schema(df.schema).parquet(path)


_ARRIVED: dict[tuple, str] = {}
DAY_US = 86_400_000_000
#: Batches that a table arrives in, and the largest delay of an event.
BATCHES, JITTER_US = 4, 2 * DAY_US


def arriving(spark, d, name, build, late, jitter):
    """A table with a ``ts_us`` as a stream of several out-of-order batches, each one file, and a heartbeat at last.

    A row arrives up to ``jitter`` after its time (``late``, an expression); batches cut the span of arrivals evenly.
    """
    mark = (spark.sparkContext.applicationId, d, name)
    rows = build()
    if mark not in _ARRIVED:
        path = f"{shared_folder(spark)}/tickloom-arriving-{uuid.uuid4().hex}"
        lo, hi = rows.agg(F.min("ts_us"), F.max("ts_us")).first()
        dealt = rows.withColumn("_b", F.call_function("div", (F.col("ts_us") + late - F.lit(lo)) * BATCHES, F.lit(hi - lo + jitter + 1)))
        for k in range(BATCHES):
            dealt.where(F.col("_b") == k).drop("_b").coalesce(1).write.parquet(f"{path}/b={k}")
        beat = spark.range(1).select(*[(F.lit(hi + 100 * DAY_US) if f.name == "ts_us" else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])
        beat.coalesce(1).write.parquet(f"{path}/b={BATCHES}")
        _ARRIVED[mark] = path
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(_ARRIVED[mark])


def event_log(spark, d):
    e = lambda: batch_events(spark, d).select("event_id", "user_id", "event_type", "value", "ts_us")
    return arriving(spark, d, "events", e, F.pmod(F.col("event_id") * 7919, F.lit(JITTER_US // 1_000_000)) * 1_000_000, JITTER_US)


#: SQL of the same: every event with its batch ``b`` and the watermark ``w`` of that batch, ``{delay}`` behind the newest event before it.
ARRIVALS = f"""ev AS (SELECT *, epoch_us(ts) AS ts_us FROM events), sp AS (SELECT min(ts_us) AS lo, max(ts_us) AS hi FROM ev),
ar AS (SELECT ev.*, ((ts_us + (event_id * 7919) % {JITTER_US // 1_000_000} * 1000000 - lo) * {BATCHES}) // (hi - lo + {JITTER_US} + 1) AS b FROM ev, sp),
wm AS (SELECT k.b, coalesce(greatest((SELECT max(ts_us) // 1000 * 1000 - {{delay}} FROM ar WHERE ar.b < k.b), 0), 0) AS w FROM (SELECT DISTINCT b FROM ar) k),
lt AS (SELECT ar.*, w FROM ar JOIN wm USING (b))"""


@query("log_runs", using("log", f", {RUNS}"))
def log_runs(spark, d):
    return ss.log_runs(fx.log(spark, d))


def streamed_runs(spark, d):
    s = event_log(spark, d).select(
        F.col("user_id").alias("session_id"), "ts_us", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"),
        F.concat(F.lit("s"), F.col("event_id") % 2).alias("source"), F.col("event_type").alias("message"),
    )
    rows = live.run_available(live.stream_log_runs(s, "3 days", 40 * DAY_US), spark).where("not late").drop("late", "since_us")
    return live.latest(rows, ["session_id", "run"], ["_batch", "count"]).drop("_batch")


@query("stream_log_runs", using("log", f", {RUNS}"))
def stream_log_runs(spark, d):
    return streamed_runs(spark, d)


@query("stream_log_levels", using("log", f", r AS (WITH {RUNS}) SELECT session_id, level, CAST(sum(count) AS BIGINT) AS entries, count(*) AS runs FROM r GROUP BY 1, 2"))
def stream_log_levels(spark, d):
    return live.level_counts(streamed_runs(spark, d))


@query("import_report", using("log", "SELECT level, message, count(*) AS count FROM log GROUP BY 1, 2"))
def import_report(spark, d):
    return ss.import_report(fx.log(spark, d))


DROPS = """rf AS (SELECT user_id AS session_id, epoch_us(ts) AS ts_us, event_id AS seq, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 60000000 AS frame, value > 5 AS exact FROM events), p AS (SELECT *, lag(frame) OVER w AS f FROM rf WINDOW w AS (PARTITION BY session_id ORDER BY ts_us, seq)),
i AS (SELECT *, sum(CASE WHEN f IS NULL OR f <> frame THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts_us, seq) AS run FROM p), r AS (SELECT session_id, run, bool_or(exact) AS seen, max(CASE WHEN f <> frame THEN frame - f END) AS m FROM i GROUP BY 1, 2)
SELECT session_id, count(*) FILTER (seen) AS shown, CAST(count(*) FILTER (NOT seen) + sum(CASE WHEN m > 1 AND m < 1000 THEN m - 1 ELSE 0 END) AS BIGINT) AS dropped FROM r GROUP BY 1"""


def refreshes(e):
    base = F.unix_micros(F.lit(fx.EPOCH).cast("timestamp"))
    return e.select(F.col("user_id").alias("session_id"), "ts_us", F.col("event_id").alias("seq"), F.call_function("div", F.col("ts_us") - base, F.lit(60_000_000)).alias("frame"), (F.col("value") > 5).alias("exact"))


def batch_events(spark, d):
    return fx.table(spark, d, "events").withColumn("ts_us", F.unix_micros(F.col("ts").cast("timestamp")))


@query("drop_meter", "WITH " + DROPS)
def drop_meter(spark, d):
    return ss.drop_meter(refreshes(batch_events(spark, d)))


@query("stream_drop_meter", "WITH " + DROPS)
def stream_drop_meter(spark, d):
    rows = live.run_available(live.stream_drop_meter(refreshes(event_log(spark, d)), 1, "3 days", 40 * DAY_US), spark)
    return rows.where("ended").select("session_id", "shown", "dropped")


QUIET, LONGEST = 3_600_000_000, 4 * 3_600_000_000
BURST = f"""WITH RECURSIVE e AS (SELECT user_id AS project_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w(project_id, i, b, f, l) AS (SELECT project_id, i, 1, t, t FROM e WHERE i = 1 UNION ALL SELECT e.project_id, e.i, CASE WHEN t < least(l + {QUIET}, f + {LONGEST}) THEN b ELSE b + 1 END, CASE WHEN t < least(l + {QUIET}, f + {LONGEST}) THEN f ELSE t END, t FROM w JOIN e ON e.project_id = w.project_id AND e.i = w.i + 1)
SELECT project_id, count(*) AS edits, min(f) AS first_us, least(max(l) + {QUIET}, min(f) + {LONGEST}) AS saved_us FROM w GROUP BY project_id, b"""


def edit_feed(e):
    return e.select(F.col("user_id").alias("project_id"), "ts_us", F.col("event_id").alias("seq"))


@query("changes_debounced", BURST)
def changes_debounced(spark, d):
    return ss.changes_debounced(edit_feed(batch_events(spark, d)), QUIET, LONGEST)


@query("stream_changes_debounced", BURST)
def stream_changes_debounced(spark, d):
    rows = live.run_available(live.stream_changes_debounced(edit_feed(event_log(spark, d)), QUIET, LONGEST, "3 days"), spark)
    return rows.where("not late").select("project_id", "edits", "first_us", "saved_us")


GAP = 6 * 3_600_000_000
CUTS = f"""WITH p AS (SELECT user_id AS sequence_id, epoch_us(ts) AS ts_us, event_id AS press, epoch_us(ts) // 7200000000 AS time, event_id % 4 AS angle FROM events WHERE event_type = 'view'), g AS (SELECT *, lag(ts_us) OVER (PARTITION BY sequence_id ORDER BY ts_us, press) AS l FROM p),
i AS (SELECT *, sum(CASE WHEN l IS NULL OR ts_us - l >= {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY sequence_id ORDER BY ts_us, press) AS n FROM g) SELECT sequence_id, CAST(n AS BIGINT) AS pass_no, time, arg_max(angle, press) AS angle FROM i GROUP BY 1, 2, 3"""


def presses(e):
    # a heartbeat has no type
    return e.filter("event_type = 'view' or event_type is null").select(F.col("user_id").alias("sequence_id"), "ts_us", F.col("event_id").alias("press"), F.call_function("div", F.col("ts_us"), F.lit(7_200_000_000)).alias("time"), (F.col("event_id") % 4).alias("angle"))


@query("multicam_cut_list", CUTS)
def multicam_cut_list(spark, d):
    return ss.multicam_cut_list(presses(batch_events(spark, d)), GAP)


@query("stream_multicam_cuts", CUTS)
def stream_multicam_cuts(spark, d):
    rows = live.run_available(live.stream_multicam_cuts(presses(event_log(spark, d)), GAP, "3 days"), spark).where("not late")
    cuts = live.latest(rows, ["sequence_id", "pass_us", "time"], ["press"])
    passes = scan(rows.select("sequence_id", "pass_us").distinct(), ["sequence_id"], ["pass_us"], 24 * ss.HOUR_US, pass_no=sum_upto(F.lit(1).cast("long")))
    return cuts.join(passes, ["sequence_id", "pass_us"]).select("sequence_id", "pass_no", "time", "angle")


PEAKS = "SELECT user_id AS track_id, CAST(event_id % 2 AS INT) AS ch, epoch_us(ts) // 7200000000 * 7200000000 AS start_us, max(abs(value)) AS peak FROM events GROUP BY 1, 2, 3"


def level_blocks(e):
    return e.select(F.col("user_id").alias("track_id"), (F.col("event_id") % 2).cast("int").alias("ch"), "ts_us", F.col("value").alias("x"))


@query("levels", PEAKS)
def levels(spark, d):
    return ss.levels(level_blocks(batch_events(spark, d)), 7_200_000_000)


@query("stream_levels", PEAKS)
def stream_levels(spark, d):
    blocks = level_blocks(event_log(spark, d)).withColumn("ts", F.timestamp_micros("ts_us"))
    rows = live.run_available(live.stream_levels(blocks, "2 hours", "3 days"), spark, "update").where("track_id is not null")
    return live.latest(rows, ["track_id", "ch", "start_us"], ["peak"]).drop("_batch")


@query("stream_levels_counted", "WITH " + ARRIVALS.format(delay=DAY_US) + """ SELECT user_id AS track_id, CAST(event_id % 2 AS INT) AS ch, ts_us // 7200000000 * 7200000000 AS start_us,
    max(abs(value)) FILTER (ts_us // 7200000000 * 7200000000 + 7200000000 > w) AS peak, count(*) FILTER (ts_us // 7200000000 * 7200000000 + 7200000000 <= w) AS late_rows FROM lt GROUP BY 1, 2, 3""")
def stream_levels_counted(spark, d):
    rows = live.run_available(live.stream_levels_counted(level_blocks(event_log(spark, d)), 7_200_000_000, "1 day"), spark)
    return rows.groupBy("track_id", "ch", "start_us").agg(F.max("peak").alias("peak"), F.sum("late_rows").alias("late_rows"))


@query("stream_log_late", "WITH " + ARRIVALS.format(delay=DAY_US) + " SELECT user_id AS session_id, count(*) FILTER (ts_us <= w) AS late_rows FROM lt GROUP BY 1")
def stream_log_late(spark, d):
    rows = live.run_available(live.stream_changes_debounced(edit_feed(event_log(spark, d)), QUIET, LONGEST, "1 day"), spark)
    return live.late_counts(rows.withColumnRenamed("project_id", "session_id"), ["session_id"])


@query("stream_loudness", using("samples", f", {SER}, {gated('momentary', 'em', 3, 10)}, fin AS (SELECT stream_id, -0.691::DOUBLE + 10 * log10(sum(e) / sum(m)) AS l FROM kp GROUP BY 1) SELECT stream_id, block, round(momentary, 6) AS momentary, round(short_term, 6) AS short_term, round(l, 6) AS integrated FROM se JOIN fin USING (stream_id) WHERE block = (SELECT max(block) FROM se x WHERE x.stream_id = se.stream_id)"))
def stream_loudness(spark, d):
    rows = live.run_available(live.stream_loudness(folder_stream(spark, d, "blocks", lambda: blocks(spark, d))), spark)
    last = live.latest(rows.where("not late"), ["stream_id"], ["block", "_batch"])
    return rounded(last.select("stream_id", "block", "momentary", "short_term", "integrated"), "momentary", "short_term", "integrated")


#: Blocks that a loudness stream waits for, and how many a block can be late.
WAIT, BEHIND = 20, 40


@query("stream_loudness_late", using("samples", f""", {SER}, ba AS (SELECT stream_id, block, block * 100000 AS ts_us FROM se), bs AS (SELECT min(ts_us) AS lo, max(ts_us) AS hi FROM ba),
bb AS (SELECT ba.*, ((ts_us + (block * 37) % {BEHIND} * 100000 - lo) * {BATCHES}) // (hi - lo + {BEHIND * 100_000} + 1) AS b FROM ba, bs),
bw AS (SELECT x.*, (SELECT max(block) - {WAIT} FROM bb y WHERE y.stream_id = x.stream_id AND y.b < x.b) AS w FROM bb x)
SELECT stream_id, count(*) FILTER (block <= w) AS late_rows FROM bw GROUP BY 1"""))
def stream_loudness_late(spark, d):
    def build():
        return blocks(spark, d).select("stream_id", "block", "e", "m", (F.col("block") * 100_000).alias("ts_us"))

    s = arriving(spark, d, "blocks", build, F.pmod(F.col("block") * 37, F.lit(BEHIND)) * 100_000, BEHIND * 100_000)
    return live.late_counts(live.run_available(live.stream_loudness(s.where("stream_id is not null").drop("ts_us"), WAIT), spark), ["stream_id"])


@query("stream_scene_cuts", rec(using("pixels", SHOT + " SELECT clip_id, frame FROM cu WHERE frame IS NOT NULL")))
def stream_scene_cuts(spark, d):
    def build():
        # every batch takes its part of the signatures: they are made once
        s = stored(spark, (d, "signatures"), lambda: shot_signatures(spark, d).select("clip_id", "frame", "grid", "hist"))
        return s.withColumn("ts_us", F.col("frame") * 40_000)

    s = arriving(spark, d, "signatures", build, F.pmod(F.col("frame") * 7, F.lit(12)) * 40_000, 480_000)
    return live.run_available(live.stream_scene_cuts(s, 60.0, 6, "1 second"), spark).where("not late").select("clip_id", "frame")
