"""Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master, where there is one machine, may leave it unset; it
    then becomes a temporary folder for the life of the process.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    """Remove a table that stash() wrote."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_live: set[str] = set()


@contextlib.contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    """A session setting for the length of a block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stash(df: DataFrame, name: str = "t", packed: bool = False) -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage ends, each row is computed once.

    (checkpoint() computes its input twice unless that is cached.)  Shuffle
    files that the write needed go once it is done.  The table goes when
    release() is called or with the process.  packed: the rows are compressed already.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quarry-{name}-{uuid.uuid4().hex}"
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", "none" if packed else "zstd").parquet(path)
    if not _live:
        atexit.register(_drop_all, spark)
    _live.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path  # for release()
    return out


#: Rows of a file of a small table.
FILE_ROWS = 50_000


def few_files(df: DataFrame, rows: int, each: int = FILE_ROWS) -> DataFrame:
    """df, known to have at most so many rows, in no more partitions than these fill: a small table isn't spread over as many files as a large one."""
    return df.coalesce(max(1, -(-rows // each)))


def release(*tables: DataFrame) -> None:
    """Drop stashed tables that no lazy result needs any more."""
    for t in tables:
        path = getattr(t, "_quarry_path", None)
        if path in _live:
            _live.discard(path)
            drop(t.sparkSession, path)


def _drop_all(spark: SparkSession) -> None:
    for path in list(_live):
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001, the session may be gone at exit
            return


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows; sees to it that Python gets them in batches of a few MB (Spark's default of 64 MB costs each worker several times that)."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(name, None) == "67108864b":  # unless set otherwise
        conf.set(name, "4m")
    return df


def trim() -> None:
    """Give freed memory back to the system: Python workers and drivers live long, and stand beside a JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[dict | pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow where f yields dicts of columns (arrays, lists or Arrow arrays) in the schema's types."""
    kind = T._parse_datatype_string(schema) if hasattr(T, "_parse_datatype_string") else df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(kind)

    def run(batches):
        for out in f(batches):
            if isinstance(out, dict):
                cols = [out[x.name] if isinstance(out[x.name], pa.Array) else pa.array(out[x.name], x.type) for x in arrow]
                out = pa.RecordBatch.from_arrays([c if c.type == x.type else c.cast(x.type) for c, x in zip(cols, arrow)], schema=arrow)
            if out.num_rows:
                yield out
        trim()

    return small_batches(df).mapInArrow(run, kind)


def text_key() -> F.Column:
    """A 64-bit key of the text; with doc_id it names a row, and rows that share both are the same."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def crc_mod(divisor: int) -> F.Column:
    """crc32 of doc_id as text, modulo; null doc_id counts as the text ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor
