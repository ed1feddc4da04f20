"""Media files, image sequences, transcripts, and user-supplied readers and recognisers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.functions.timebase import idiv
from tickloom.operators.ordered import INDEX_CHUNK
from tickloom.operators.transcripts import normalize_transcript
from tickloom.sources.documents import HELD, list_files, system_of

SPAN = 1 << 20
WHOLE = 1 << 30


def scan_media_files(spark: SparkSession, path: str, name_filter: str = "*") -> DataFrame:
    """File catalogue ``(path, size, fingerprint)`` of a folder; the fingerprint covers size, first and last MiB.

    Files are listed in the tasks, and only the two ends of each are read there.
    """

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system = system_of(path)
        for pdf in batches:
            rows, held = [], 0
            for uri, name, size in zip(pdf["path"], pdf["name"], pdf["size"], strict=True):
                with system.open_input_file(name) as f:
                    head = f.read(SPAN)
                    f.seek(max(size - SPAN, SPAN))
                    rows.append((uri, size, head, f.read(SPAN)))
                held += len(rows[-1][2]) + len(rows[-1][3])
                if held > HELD:
                    yield pd.DataFrame(rows, columns=["path", "size", "head", "tail"])
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=["path", "size", "head", "tail"])

    both = list_files(spark, path, name_filter).mapInPandas(ends, "path string, size long, head binary, tail binary")
    return both.select("path", "size", F.xxhash64("size", "head", "tail").alias("fingerprint"))


# Fixed value: extensions of still images.
STILLS = "png|jpg|jpeg|gif|webp|tif|tiff|bmp"
NUMBERED = rf"^(.*[/\\])?((?:[^/\\]*?[^0-9/\\])?)([0-9]+)([^0-9/\\]*\.(?i:{STILLS}))$"


def scan_image_sequences(files: DataFrame, span: int = 1_000_000, block: int = 10_000) -> DataFrame:
    """Numbered stills grouped by folder, prefix, suffix and padding, with the count and ranges of missing frames.

    The frames of a folder are never gathered: gaps come from neighbouring numbers.
    """
    from tickloom.operators.ordered import prev, scan

    g = lambda i: F.regexp_extract("path", NUMBERED, i)
    f = files.filter(F.col("path").rlike(NUMBERED)).select(g(1).alias("dir"), g(2).alias("prefix"), g(3).alias("digits"), g(4).alias("suffix"))
    # of a longer number the digits before the last 18 belong to the prefix
    f = f.withColumns({"prefix": F.when(F.length("digits") > 18, F.concat("prefix", F.expr("left(digits, length(digits) - 18)"))).otherwise(F.col("prefix")), "digits": F.expr("right(digits, 18)")})
    n = F.col("digits").cast("long")
    # a zero-padded number fixes the width; wider numbers without zeros follow the padded ones
    pad = F.when(F.col("digits").startswith("0") & (F.length("digits") > 1), F.length("digits"))
    f = f.select("dir", "prefix", "suffix", n.alias("n"), pad.alias("pad"), F.length("digits").alias("w"))
    key = ["dir", "prefix", "suffix"]
    pads = f.filter("pad is not null").groupBy(*key).agg(F.collect_set("pad").alias("_pads"))
    f = f.join(pads, key, "left").withColumn("width", F.coalesce("pad", F.array_max(F.filter("_pads", lambda p: p <= F.col("w"))), F.lit(1)))
    key = [*key, "width"]
    f = f.select(*key, "n").distinct()
    first = f.groupBy(*key).agg(F.min("n").alias("first"))
    # frames further than ``span`` from the first are a sequence of their own
    f = f.join(first, key).withColumn("_part", F.floor((F.col("n") - F.col("first")) / (span + 1))).drop("first")
    key = [*key, "_part"]
    s = scan(f, key, ["n"], block, _p=prev("n"))
    hole = F.when(F.col("n") - F.col("_p") > 1, F.col("n") - F.col("_p") - 1).otherwise(0)
    return s.groupBy(*key).agg(F.min("n").alias("first"), F.max("n").alias("last"), F.count("*").alias("present"), F.sum(hole).alias("missing")).drop("_part")


WORDS = "array<struct<text:string, start:long, end:long, speaker:int, confidence:double>>"


def load_transcripts(documents: DataFrame) -> DataFrame:
    """External word lists ``(item_id, value JSON)`` as well-formed words."""
    w = documents.select("item_id", F.posexplode(F.from_json("value", WORDS)).alias("idx", "w"))
    w = w.select("item_id", F.col("idx").cast("long").alias("idx"), "w.*").na.fill({"confidence": 1.0})
    return normalize_transcript(w.filter("text is not null and start is not null").withColumn("end", F.coalesce("end", "start")))


def transcribe(samples: DataFrame, recogniser: Callable[[], Callable[[np.ndarray, int], list[tuple[str, float, float, float]]]], rate: int = 16_000, chunk_seconds: int = 30) -> DataFrame:
    """Words ``(stream_id, text, start_s, end_s, confidence)`` from a user's recogniser.

    ``recogniser()`` is called once per Python worker and returns ``f(audio, rate)`` giving words
    relative to the audio; words that start beyond it are dropped, ends are cut to it. Chunks are
    independent tasks.
    """
    size = chunk_seconds * rate
    loaded: dict = {}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if "f" not in loaded:
            loaded["f"] = recogniser()
        pdf = pdf.sort_values("n")
        n0, stream = int(pdf["n"].iloc[0]), pdf["stream_id"].iloc[0]
        top = len(pdf) / rate
        rows = [(stream, t, n0 / rate + a, n0 / rate + min(b, top), c) for t, a, b, c in loaded["f"](pdf["x"].to_numpy(), rate) if a < top]
        return pd.DataFrame(rows, columns=["stream_id", "text", "start_s", "end_s", "confidence"])

    mono = samples.groupBy("stream_id", "n").agg(F.avg("x").alias("x")) if "ch" in samples.columns else samples
    chunked = mono.withColumn("_c", idiv("n", F.lit(size)))
    return chunked.groupBy("stream_id", "_c").applyInPandas(run, "stream_id long, text string, start_s double, end_s double, confidence double")


def read_media(requests: DataFrame, reader: Callable[[int, int, int], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Rows from a user's ``reader(item_id, lo, hi)`` for each requested media range.

    Requests are spread over the tasks; a reader yields frames, so no range is held whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                yield from reader(r.item_id, r.lo, r.hi)

    return requests.select("item_id", "lo", "hi").repartition("item_id", "lo").mapInPandas(run, schema)
