"""What the operators share: the shared work folder, written tables, word rules and checks of columns."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the contracts: ASCII white space, a word, and the ASCII letters that are lower-cased.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_made: list[tuple[SparkSession, str]] = []


def work_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only where the session names none and all runs on one machine, as in tests, is a local one made and set; on a cluster
    that is an error, for executors don't see each other's folders.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; deleted when the driver ends, or earlier by drop_path()."""
    path = f"{work_dir(spark)}/weft-{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the session may be gone
            drop_path(spark, path)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back: later steps survive lost executors and don't repeat it."""
    spark = df.sparkSession
    df.write.parquet(path := new_path(spark, tag))
    return spark.read.schema(df.schema).parquet(path)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function over a task's batches, after which the worker gives freed memory back: workers live on between tasks, and
    what each of them keeps would add up with what the next stage needs."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """Returns this process's freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def rest(spark: SparkSession) -> None:
    """give_back() for the driver as a whole: a full collection in its JVM returns the free heap to the system, and Spark then removes the broadcasts and
    shuffles that nothing names any more. For moments when Python needs memory itself or much has just become garbage."""
    give_back()  # first, for Python's objects hold some of the JVM's
    spark.sparkContext._jvm.System.gc()


def checked(df: DataFrame, *names: str) -> DataFrame:
    """df, if it has the columns; an error that names the missing ones otherwise."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


def text_of(column: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def hashable(df: DataFrame) -> list[Column]:
    """The columns that xxhash64 takes: all but maps and variants."""
    return [F.col(f"`{f.name}`") for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]


def row_hash(df: DataFrame, seed: int) -> Column:
    """A seeded 64-bit hash of the whole row, the same wherever the row lies."""
    return F.xxhash64(F.lit(seed), *hashable(df))


def fold_case(column: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def doc_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus: the folds of the contracts."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(modulus))
