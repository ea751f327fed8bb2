"""Tables in the folder that all executors and the driver share, and Arrow batches in and out of Python."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that become Python objects at a time.
ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local session without one gets a temporary folder, which is then set.

    On a cluster the driver and the executors share no temporary folder, so there it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='paperloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Folders that this process wrote and has not deleted, and tables of the catalog over some of them.
_made: list[str] = []
_names: dict[str, str] = {}


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def made() -> int:
    """How many folders there are; ``clean`` from here on deletes the later ones."""
    return len(_made)


def clean(spark: SparkSession, since: int = 0, newest: int = 0) -> None:
    """Deletes the tables that this process wrote to the shared folder, but for the first ``since`` and the last ``newest``; results that still read them are lost."""
    jvm, end = spark.sparkContext._jvm, len(_made) - newest
    for own in _made[since:end]:
        if own in _names:
            spark.sql(f"DROP TABLE IF EXISTS {_names.pop(own)}")
        path = jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del _made[since:end]


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is run inside go when it has ended, as its result is a table by then."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str, codec: str = "zstd", **options: int) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, so a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.options(compression=codec, **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, *columns: str, codec: str = "zstd") -> DataFrame:
    """The same, bucketed by ``columns`` as a shuffle by them deals rows out: ``df`` comes so from a grouping, and joins by them read the table without a shuffle."""
    spark = df.sparkSession
    path, table = new_path(spark, name), f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    buckets = min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with shuffles_dropped(spark):
        df.write.format("parquet").option("compression", codec).option("path", path).bucketBy(buckets, *columns).saveAsTable(table)
    _names[path] = table
    return spark.table(table)


def arrow_schema(ddl: str) -> pa.Schema:
    """For the plain column types the operators return."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<float>": pa.list_(pa.float32()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(n, kinds[k]) for n, k in (c.strip().split(" ") for c in ddl.split(","))])


def tidy() -> None:
    """Gives memory that is done with back to the system: a worker keeps what its largest batch took while it waits for other stages' tasks."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def by_batch(df: DataFrame, function: Callable[[dict[str, list]], dict[str, list]], ddl: str) -> DataFrame:
    """``function`` over ROWS rows at a time, columns as Python lists."""
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                yield pa.RecordBatch.from_pydict(function(b.slice(k, ROWS).to_pydict()), schema=schema)
        tidy()

    return df.mapInArrow(run, ddl)


def crc_rest(column: str, mod: int):
    """crc32 of an id as decimal text, modulo ``mod``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod
