"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NO_WORD = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where neither the setting nor a checkpoint folder exists, a local master (tests on
    one machine) gets a temporary folder; on a cluster that is an error. All folders
    of an application lie below one, which ``clean`` removes."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="pageloom-shared-")
        spark.sparkContext.setCheckpointDir(base)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/pageloom-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}")
    # With its scheme, so that Spark and pyarrow take it alike.
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def clean(spark: SparkSession) -> None:
    """Remove what this application has written to the shared folder. Results that were
    not stored elsewhere cannot be read any more."""
    jvm, path = spark.sparkContext._jvm, shared_dir(spark, "x").rpartition("/")[0]
    path = jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut at files
    that outlive any executor."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(text: str, limit: int) -> list[str]:
    """``text`` cut into parts of about ``limit`` characters, at ASCII characters that
    belong to no word; a word longer than that stays whole."""
    out, at = [], 0
    while len(text) - at > limit:
        m = _NO_WORD.search(text, at + limit)
        if m is None:
            break
        out.append(text[at : m.end()])
        at = m.end()
    return [*out, text[at:]]


def release() -> None:
    """Give a Python worker's freed memory back: workers outlive their stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def text_key(col: Column) -> Column:
    """64-bit key of a text, the same for null wherever it is computed."""
    return F.xxhash64(col)
