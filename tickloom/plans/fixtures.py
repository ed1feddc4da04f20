"""Timeline tables derived from the driver's parquet, in Spark."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tickloom.functions.timebase import fdiv, idiv
from tickloom.session import stored
from tickloom.operators.ordered import INDEX_CHUNK, scan, sum_before



def kept(build):
    """Tables that cost ordered scans to derive are written once and shared by all queries."""

    @wraps(build)
    def read(spark, d):
        return stored(spark, (d, build.__name__), lambda: build(spark, d))

    return read


EPOCH = "2024-01-01 00:00:00"
MS = 254_016_000
WORD_RATE = 8_475_667_200
FRAME_TICKS = [10_594_584_000, 10_584_000_000, 10_160_640_000, 8_475_667_200, 8_467_200_000]
NUMS = [24000, 24, 25, 30000, 30]
DENS = [1001, 1, 1, 1001, 1]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pick(values, key):
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (F.col(key) % 5 + 1).cast("int"))


def sequences(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(
        (F.col("o_orderkey") % 10).alias("project_id"),
        F.col("o_orderkey").alias("sequence_id"),
        F.concat(F.lit("seq "), F.col("o_orderkey")).alias("name"),
        pick(NUMS, "o_orderkey").alias("rate_num"),
        pick(DENS, "o_orderkey").alias("rate_den"),
        pick(FRAME_TICKS, "o_orderkey").alias("ft"),
    )


def lines(spark, d) -> DataFrame:
    """lineitem with ``rn``, the row number inside an order by all columns."""
    li = table(spark, d, "lineitem").withColumn("day", F.datediff("l_shipdate", F.lit("1970-01-01")).cast("long"))
    order = ["day", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    # an order has few lines: one shuffle by the order serves this window and that over its tracks
    return li.withColumn("rn", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)).cast("long"))


@kept
def clips(spark, d) -> DataFrame:
    ft = pick(FRAME_TICKS, "l_orderkey")
    t = F.when(F.col("l_suppkey") % 3 == 0, 2).otherwise(F.col("rn") % 2).cast("long")
    rows = lines(spark, d).select(
        F.col("l_orderkey").alias("sequence_id"),
        (F.col("l_orderkey") * 4 + t).alias("track_id"),
        F.when(t == 1, "video").otherwise("audio").alias("kind"),
        (F.col("l_orderkey") * 10_000_000 + F.col("rn")).alias("clip_id"),
        F.col("l_partkey").alias("item_id"),
        F.concat(F.lit("clip "), F.col("l_partkey") % 50).alias("name"),
        "rn", ft.alias("ft"),
        F.col("l_quantity").cast("long").alias("df"),
        (F.round(F.col("l_discount") * 100).cast("long") % 7).alias("gap"),
        ((F.col("l_suppkey") % 20) * ft).alias("source_in"),
        F.when(F.col("l_tax") > 0.06, 2.0).otherwise(1.0).alias("speed"),
        (F.col("l_returnflag") == "R").alias("reverse"),
        (F.col("l_linestatus") == "O").alias("enabled"),
    )
    before = W.partitionBy("sequence_id", "track_id").orderBy("rn").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.col("df") + F.col("gap")).over(before), F.lit(0)))
    return rows.select(
        "sequence_id", "track_id", "kind", "clip_id", "item_id", "name", "rn", "ft",
        ((F.col("at") + F.col("gap")) * F.col("ft")).alias("start"),
        (F.col("df") * F.col("ft")).alias("duration"),
        "source_in", "speed", "reverse", "enabled", F.lit(None).cast("long").alias("frame_hold"),
    )


def spans(spark, d) -> DataFrame:
    return clips(spark, d).withColumn("end", F.col("start") + F.col("duration"))


def through(spark, d) -> DataFrame:
    """Clips longer than 20 frames cut once at half their length, as an added edit leaves them."""
    c = clips(spark, d)
    half = fdiv(fdiv("duration", "ft"), F.lit(2)) * F.col("ft")
    cut = F.col("duration") > 20 * F.col("ft")
    src = lambda x: F.round(x.cast("double") * F.col("speed"), 0).cast("long")
    whole = c.filter(~cut)
    left = c.filter(cut).withColumn("h", half).withColumn("source_in", F.when(F.col("reverse"), F.col("source_in") + src(F.col("duration")) - src(F.col("h"))).otherwise(F.col("source_in"))).withColumn("duration", F.col("h")).drop("h")
    right = (
        c.filter(cut).withColumn("h", half)
        .withColumn("source_in", F.when(F.col("reverse"), F.col("source_in")).otherwise(F.col("source_in") + src(F.col("h"))))
        .withColumns({"start": F.col("start") + F.col("h"), "duration": F.col("duration") - F.col("h"), "clip_id": F.col("clip_id") + 5_000_000}).drop("h")
    )
    return whole.unionByName(left).unionByName(right)


def items(spark, d) -> DataFrame:
    return table(spark, d, "part").select(
        (F.col("p_partkey") % 10).alias("project_id"),
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("label"),
        F.when(F.col("p_partkey") % 10 == 9, "graphic").otherwise("media").alias("kind"),
        F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string")).alias("metadata"),
    )


def media(spark, d) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.concat(F.lit("/vol/"), "p_brand", F.lit("/"), "p_type", F.lit("/"), "p_name", F.lit("_"), "p_partkey", F.lit(".mov")).alias("path"),
        (F.col("p_partkey") % 13 == 0).alias("offline"),
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("/proxy/"), "p_partkey", F.lit(".mov"))).alias("proxy_path"),
        (F.col("p_size").cast("long") * 40 * 10_160_640_000).alias("duration"),
        ((F.col("p_partkey") % 5) * 254_016_000_000).alias("start_timecode"),
        (F.col("p_size").cast("long") * 1_000_000 + F.col("p_partkey")).alias("size"),
        (F.col("p_partkey") * 7919).alias("fingerprint"),
    )


def files(spark, d) -> DataFrame:
    """Media files on disk: some moved, some gone, some changed; proxies of every eighth part gone."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    real = p.filter(k % 7 != 0).select(
        F.concat(F.when(k % 3 == 0, "/new").otherwise("/vol"), F.lit("/"), "p_brand", F.lit("/"), "p_type", F.lit("/"), "p_name", F.lit("_"), "p_partkey", F.lit(".mov")).alias("path"),
        (F.col("p_size").cast("long") * 1_000_000 + k + F.when(k % 11 == 0, 1).otherwise(0)).alias("size"),
        (k * 7919).alias("fingerprint"),
    )
    proxies = p.filter((k % 4 == 0) & (k % 8 != 0)).select(F.concat(F.lit("/proxy/"), "p_partkey", F.lit(".mov")).alias("path"), F.lit(1000).cast("long").alias("size"), k.alias("fingerprint"))
    return real.unionByName(proxies)


def ticks_of(ts):
    return (F.unix_micros(ts) - F.unix_micros(F.lit(EPOCH).cast("timestamp"))) * 254_016


def points(spark, d) -> DataFrame:
    """Every event as a time on its user's timeline."""
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props", ticks_of(F.col("ts").cast("timestamp")).alias("t"))


def markers(spark, d) -> DataFrame:
    return points(spark, d).filter("event_type = 'click'").select(
        F.col("user_id").alias("owner_id"), F.col("event_id").alias("marker_id"), F.col("t").alias("start"),
        F.lit(0).cast("long").alias("duration"), F.col("event_type").alias("name"), F.col("props").alias("comment"),
    )


@kept
def words(spark, d) -> DataFrame:
    """Words of every conversation laid end to end; a sentence end is followed by 900 ms."""
    w = table(spark, d, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split("text", r"\s+")).alias("pos", "text")).filter("text != ''")
    dur = F.greatest(F.lit(120), F.length("text") * 60).cast("long") * MS
    gap = F.when(F.col("text").rlike(r"[.!?]$"), 900).otherwise(40).cast("long") * MS
    w = w.withColumns({"dur": dur, "gap": gap, "pos": F.col("pos").cast("long")})
    w = scan(w, ["conv_id"], ["turn", "pos"], 4, idx=sum_before(F.lit(1).cast("long")), start=sum_before(F.col("dur") + F.col("gap")))
    return w.select(F.col("conv_id").alias("sequence_id"), F.col("conv_id").alias("item_id"), "idx", "text", "start", (F.col("start") + F.col("dur")).alias("end"), F.col("role").alias("speaker"))


def captions(spark, d) -> DataFrame:
    """Non-empty lines of each document, 2 s each with 200 ms between."""
    lines_ = table(spark, d, "documents").select("doc_id", F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("pos", "text"))
    return lines_.select(
        F.col("doc_id").alias("track_id"), (F.col("doc_id") * 1_000_000 + F.col("pos")).alias("caption_id"),
        (F.col("pos").cast("long") * 2200 * MS).alias("start"), F.lit(2000 * MS).alias("duration"), F.trim("text").alias("text"),
    )


def keyframes(spark, d) -> DataFrame:
    p = points(spark, d)
    return p.groupBy("user_id", "t").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("event_id")).select(
        F.col("user_id").alias("owner_id"), F.col("t").alias("time"), F.col("value"),
        F.when(F.col("event_id") % 3 == 1, "hold").when(F.col("event_id") % 6 == 2, "bezier").otherwise("linear").alias("interp"),
        F.lit(0.3333).alias("in_influence"), F.lit(0.3333).alias("out_influence"),
    )


def log(spark, d) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("user_id").alias("session_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"),
        F.concat(F.lit("s"), F.col("event_id") % 2).alias("source"), F.col("event_type").alias("message"),
    )


@kept
def vectors(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("stream_id"), "embedding")
    return scan(e, ["stream_id"], ["vec_id"], INDEX_CHUNK, rank=sum_before(F.lit(1).cast("long")))


def samples(spark, d, repeat: int = 1) -> DataFrame:
    """One stream per label; each vector is 64 samples at its place ``vec_id``. ``n`` has no holes."""
    s = vectors(spark, d).select("stream_id", "rank", F.posexplode("embedding").alias("pos", "x"))
    s = s.select("stream_id", F.lit(0).alias("ch"), (F.col("rank") * 64 + F.col("pos")).alias("n"), F.col("x").cast("double").alias("x"))
    if repeat > 1:
        per = s.groupBy("stream_id").agg((F.max("n") + 1).alias("len"))
        s = s.join(per, "stream_id").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1)))).withColumn("n", F.col("n") + F.col("r") * F.col("len")).drop("r", "len")
    return s


#: Frames that one task grows; more frames make more tasks, not larger ones.
FRAMES = 2048


def pixels(spark, d) -> DataFrame:
    """A 16 x 9 frame per part."""
    # a row grows to a frame: spread the rows before they do
    p = table(spark, d, "part").select(F.col("p_partkey").alias("frame_id"))
    p = p.repartition(max(spark.sparkContext.defaultParallelism, -(-p.count() // FRAMES)), "frame_id")
    p = p.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(8))))
    v = lambda c: (((F.col("frame_id") * 31 + F.col("x") * 7 + F.col("y") * 13 + c * 17) % 256) / F.lit(255.0)).cast("double")
    return p.select("frame_id", "x", "y", v(0).alias("r"), v(1).alias("g"), v(2).alias("b"), F.lit(1.0).alias("a"))
