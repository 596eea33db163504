"""Scratch tables and column helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
ROW = "__row"
#: Spark deletes the shuffle files of an execution as it ends.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_OWN: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where that is unset (local tests) a temporary folder of this process."""
    global _OWN
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        hadoop = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = hadoop.get() if hadoop.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if _OWN is None:
            _OWN = tempfile.mkdtemp(prefix="pixelloom-")
            atexit.register(shutil.rmtree, _OWN, ignore_errors=True)
        root = f"file://{_OWN}"
    return root


#: Scratch tables that are still there, in the order they were made.
_MADE: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    _MADE.append(f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def cut(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read again: its lineage ends there, and a lost executor costs one file read.

    What it has shuffled is deleted once it is written, without waiting for the driver's garbage collection.
    """
    path, conf = scratch_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(_FREE, None)
    conf.set(_FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_FREE) if before is None else conf.set(_FREE, before)
    drop_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def drop_at_end(spark: SparkSession, path: str) -> None:
    """Lets the driver delete a scratch table as it ends, if nothing does before."""
    target, files = _files(spark, path)
    files.deleteOnExit(target)


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables that no later plan reads."""
    for path in paths:
        if path in _MADE:
            _MADE.remove(path)
        target, files = _files(spark, path)
        files.delete(target, True)


def made() -> int:
    """A mark for drop_since()."""
    return len(_MADE)


def drop_since(spark: SparkSession, mark: int, keep: str | None = None) -> None:
    """Deletes the scratch tables made since the mark, but for one; for use once results that read them are written."""
    drop(spark, *[p for p in _MADE[mark:] if p != keep])


def with_row(df: DataFrame) -> DataFrame:
    """df with a number for each row; the same one wherever the same stored table is read."""
    return df.withColumn(ROW, F.monotonically_increasing_id())


def nulls_last(c: Column) -> Column:
    """Sorts after every value if null, inside a struct that min() compares."""
    return F.struct(c.isNull(), c)


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id written as text, modulo m; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
