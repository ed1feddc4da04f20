"""Media ranges as a Spark data source: planned partitions, range pushdown, rows from a user's reader.

    spark.dataSource.register(media_source("ramp", reader, "stream_id long, ch int, n long, x double"))
    spark.read.format("ramp").option("ranges", path).load().where("n >= 1000")
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Positions of one partition: long ranges are cut, short ones are read together.
CHUNK = 1 << 20


@dataclass
class Pieces(InputPartition):
    """Ranges (item, lo, hi) that one task reads, ``hi`` exclusive."""

    ranges: list[tuple[int, int, int]]


class RangeReader(DataSourceReader):
    """Plans the ranges of a Parquet table ``(item_id, lo, hi)`` and narrows them by filters on the item and the position."""

    def __init__(self, schema: StructType, options: dict, read: Callable[[int, int, int], Iterator[pd.DataFrame]], item: str, position: str) -> None:
        self.schema, self.read_range, self.item, self.position = schema, read, item, position
        self.path, self.chunk = options["ranges"], int(options.get("chunk", CHUNK))
        self.lo, self.hi, self.items = None, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on the position and sets of items are taken over whole; the rest is left to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == self.position and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                least = f.value + isinstance(f, GreaterThan)
                self.lo = least if self.lo is None else max(self.lo, least)
            elif name == self.position and isinstance(f, (LessThan, LessThanOrEqual)):
                stop = f.value + isinstance(f, LessThanOrEqual)
                self.hi = stop if self.hi is None else min(self.hi, stop)
            elif name == self.item and isinstance(f, (EqualTo, In)):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.items = some if self.items is None else self.items & some
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        where, path = fs.FileSystem.from_uri(self.path)
        out: list[Pieces] = []
        held, size = [], 0
        for batch in pq.ParquetDataset(path, filesystem=where).read(["item_id", "lo", "hi"]).to_batches():
            for item, lo, hi in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if item is None or lo is None or hi is None or (self.items is not None and item not in self.items):
                    continue
                lo, hi = lo if self.lo is None else max(lo, self.lo), hi if self.hi is None else min(hi, self.hi)
                while lo < hi:
                    stop = min(hi, lo + self.chunk - size)
                    held.append((item, lo, stop))
                    size += stop - lo
                    lo = stop
                    if size >= self.chunk:
                        out.append(Pieces(held))
                        held, size = [], 0
        return [*out, Pieces(held)] if held or not out else out

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        for item, lo, hi in partition.ranges:
            for frame in self.read_range(item, lo, hi):
                yield pa.RecordBatch.from_pandas(frame, schema=schema, preserve_index=False)


def media_source(name: str, reader: Callable[[int, int, int], Iterator[pd.DataFrame]], schema: str, item: str = "stream_id", position: str = "n") -> type[DataSource]:
    """A data source called ``name`` over ``reader(item, lo, hi)``, which yields frames with the columns of ``schema``.

    Option ``ranges`` is the path of the Parquet table of requests, ``chunk`` the number of positions of a task. A
    reader must be able to start anywhere in an item.
    """

    class MediaSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return RangeReader(schema, self.options, reader, item, position)

    return MediaSource
