"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The vocabulary file that queries give to the operators, by its place on this machine.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def give_back() -> None:
    """Returns freed memory of this process to the machine: a Python worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps it, or returns it by itself
        pass


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which grows with the cluster."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A session on one machine may do without; it gets a folder in its warehouse.  On a
    cluster the setting must be there.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        given = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    context.setCheckpointDir(given)
    return context._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder among the shared ones."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more, wherever it is stored."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


#: With it, the shuffle files of a query are deleted when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rules that adaptive execution leaves out, and the one that drops a part of a plan once another part turns out to be empty.
_EXCLUDED, _EMPTY = "spark.sql.adaptive.optimizer.excludedRules", "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and read it from there ever after; the shuffles that made it leave no files.

    All jobs of the query end before its shuffles are deleted.  Were a part of the plan
    dropped as empty, the job of another part would run on; the driver never answers when
    its tasks ask for a shuffle that is gone, so they would hold their cores until a time-out.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = {key: spark.conf.get(key, None) for key in (_CLEANUP, _EXCLUDED)}
    spark.conf.set(_CLEANUP, "true")
    spark.conf.set(_EXCLUDED, ",".join(filter(None, (before[_EXCLUDED], _EMPTY))))
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own: the settings are read when a plan is made and run
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def drop_cut(df: DataFrame) -> None:
    """Deletes the files of a frame that ``cut`` gave, when nothing reads it any more."""
    spark = df.sparkSession
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        remove_folder(spark, file.get())


def document_remainder(modulus: int) -> Column:
    """crc32 of the document id's text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % F.lit(modulus)
