"""Shared by the operators: the shared folder, written tables, and a few column expressions."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from math import ceil, log2

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import scratch

#: A maximal run of characters other than white space is a word.
WORD = r"[^\x20\x09-\x0D]+"
LIBRARY = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SPACE = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Raises if there is none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder.rstrip("/")


def prepared(spark: SparkSession) -> SparkSession:
    """Lets Python workers find the library, and bounds the bytes that they get at a time.

    On one machine a shared folder is set where the session names none, as in tests; a cluster has to name it.
    """
    try:
        shared_folder(spark)
    except ValueError:
        if not spark.sparkContext.master.startswith("local"):
            raise
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if LIBRARY not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([LIBRARY, *paths])
    return spark


#: Bytes of rows that a Python worker gets at a time.
BATCH_BYTES = 4 << 20
#: Lets Spark delete the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read back: later reads survive lost executors.

    Nothing reads the shuffles behind a written table again, so they go at once. The table stays until dropped().
    """
    spark = df.sparkSession
    path, before = f"{shared_folder(spark)}/{uuid.uuid4().hex}", spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that stored() returned, once their last reader is done."""
    for table in tables:
        scratch.remove(table.sparkSession, table.stored_at)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def small_side(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """The frame with a broadcast hint if its counted rows are few; else Spark joins it by shuffling."""
    return F.broadcast(df) if rows <= limit else df


def hash_filter(hashes: DataFrame, most_bits: int = 1 << 28) -> np.ndarray:
    """A bit map of evenly spread 64-bit hashes (column h): 16 bits for each, up to most_bits, so it can be broadcast.

    A fuller one lets more through; what passes is to be joined exactly, or does no harm.
    """
    bits = 1 << max(10, min(int(log2(most_bits)), ceil(log2(16 * max(1, hashes.count())))))
    place = F.shiftrightunsigned("h", 64 - int(log2(bits)))
    words = hashes.groupBy(F.shiftright(place, 6).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))).alias("b")
    ).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out.view(np.uint64)


def in_filter(seen: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether hashes may be in a hash_filter."""
    place = hashes >> np.uint64(64 - int(log2(len(seen) * 64)))
    return (seen[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
