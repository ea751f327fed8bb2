"""Results that several parts of one query read, as tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []
_held: dict[tuple, DataFrame] = {}


def folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a local session without it uses a temporary folder, any other must set it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='paperloom-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def once(spark: SparkSession, name: str, sf_dir: str, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` as a table, made at its first use within a query."""
    key = (spark, name, sf_dir)
    if key not in _held:
        path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
        _made.append(path)
        frame, keep = make(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = spark.conf.get(keep, "false")
        spark.conf.set(keep, "true")  # the job's shuffle files go when the table is there
        try:
            frame.write.option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(keep, before)
        _held[key] = spark.read.schema(frame.schema).parquet(path)
    return _held[key]


def begin() -> None:
    """A new query: what earlier ones made is not read again."""
    _held.clear()


def clean(spark: SparkSession) -> None:
    """Deletes the tables of all queries so far; results that still read them are lost."""
    begin()
    while _made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
