"""Session helpers."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tickloom", cores: str = "*", shuffle: int = 8) -> SparkSession:
    """A session for tests and the local bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; one of our own only where the session has none."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, used by iterative operators."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_STORED: dict[tuple, str] = {}


def stored(spark: SparkSession, key: tuple, build) -> DataFrame:
    """A derived table written once per session to the shared folder, then read as parquet."""
    mark = (spark.sparkContext.applicationId, *key)
    if mark not in _STORED:
        path = f"{shared_folder(spark)}/tickloom-{uuid.uuid4().hex}/{key[-1]}"
        build().write.parquet(path)
        _STORED[mark] = path
    return spark.read.parquet(_STORED[mark])


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Sets a session setting for the length of a block and puts the old one back."""
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, old) if old is not None else spark.conf.unset(name)
