"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import inspect
import tempfile
import uuid
from functools import wraps

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: One word: a run of anything but the six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset and
    Spark is a single process (tests) a temporary folder that then becomes the checkpoint folder."""
    sc = spark.sparkContext
    have = spark.conf.get("spark.checkpoint.dir", None)
    if have:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(have)
        return have.rstrip("/")
    if sc.getCheckpointDir() is None:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lodestone-{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and go on from a reliable copy in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Like cut(), as a Parquet table: compressed and columnar, for what is wide or read in parts."""
    spark = df.sparkSession
    small_batches(spark)
    path = fresh_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored tables that only matter until an operator's result stands; clear() deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        small_batches(self.spark)
        self.paths.append(fresh_dir(self.spark, label))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def clear(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            there = jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(conf).delete(there, True)
        self.paths = []


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Arrow batches of whole texts are limited by bytes, not rows alone; a limit that the session sets itself stands."""
    if spark.conf.get(_BATCH_BYTES, "64m") in ("64m", "64MB", "67108864b"):
        spark.conf.set(_BATCH_BYTES, size)


#: What a worker keeps between batches of one task; emptied when the task ends.
CACHES: list[dict] = []


def tidy(step):
    """A step for mapInArrow or applyInArrow after which the worker, which lives on for other tasks,
    gives back what the task has gathered."""

    def release():
        for cache in CACHES:
            cache.clear()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass  # not a glibc system

    @wraps(step)
    def batches_of(batches):
        try:
            yield from step(batches)
        finally:
            release()

    @wraps(step)
    def group_of(group):
        try:
            return step(group)
        finally:
            release()

    return batches_of if inspect.isgeneratorfunction(step) else group_of


def compressed(texts: pa.Array) -> pa.Array:
    """Each text as zstandard-compressed UTF-8 (null: as empty): what is shuffled of texts."""
    pack = zstandard.ZstdCompressor(3).compress
    return pa.array([pack(x) for x in texts.fill_null("").cast(pa.large_binary()).to_pylist()], pa.binary())


def row_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and where each starts and ends; null: empty."""
    texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
    n = len(texts)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def smallest(rows: DataFrame, group: list[str], order: list[Column], keep: int, salts: int = 64) -> DataFrame:
    """The `keep` first rows of each group; groups are thinned in `salts` parts each before they meet."""
    salt = F.pmod(F.xxhash64(*order), F.lit(salts))
    for parts in ([*group, "_salt"], group):
        rank = F.row_number().over(Window.partitionBy(*parts).orderBy(*order))
        rows = rows.withColumn("_salt", salt).withColumn("_rank", rank).where(F.col("_rank") <= keep)
    return rows.drop("_salt")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_of_id(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary"))
