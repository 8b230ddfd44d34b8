"""Shared pieces: the work folder, tables written between steps, row numbers and white space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: White space of all operators: space and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_IN_PARTITION = (1 << 33) - 1


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables between steps, in the folder that the cluster shares (``spark.checkpoint.dir``)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-llm-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, path: str) -> DataFrame:
    """Write a table and return it as read back: lineage ends here, and the job's shuffle files are freed."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the work folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings (dots written as two underscores) for the jobs inside the block."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def number(df: DataFrame, order: Sequence[Column], path: str, name: str = "_row") -> DataFrame:
    """Add the position of each row in a total order, from 0, by a distributed sort.

    Partitions are sorted ranges; only one count per partition is gathered to place them.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = save(ranged.withColumn("_at", F.monotonically_increasing_id()), path)
    part = F.shiftright("_at", 33)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = stored.withColumn("_part", part).join(offsets, "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(_IN_PARTITION)).drop("_part", "_at", "_before")


def keyed(docs: DataFrame, path: str) -> DataFrame:
    """(_row, doc_id, text, _doc): a unique row number in the order of doc_id, and the whole row as a struct.

    Where doc_id is unique and never null it is the number. Otherwise rows are numbered by (doc_id with null
    first, text hash, row), so repeated ids and repeated rows stay apart.
    """
    packed = docs.select("doc_id", "text", F.struct("*").alias("_doc"))
    if ids_are_keys(docs):
        return packed.select(F.col("doc_id").cast("long").alias("_row"), "doc_id", "text", "_doc")
    stored = save(packed.withColumn("_uid", F.monotonically_increasing_id()), f"{path}/rows")
    narrow = stored.select("doc_id", F.xxhash64("text").alias("_tie"), "_uid")
    order = number(narrow, [F.col("doc_id").asc_nulls_first(), F.col("_tie"), F.col("_uid")], f"{path}/order")
    return stored.join(order.select("_uid", "_row"), "_uid").select("_row", "doc_id", "text", "_doc")


def ids_are_keys(docs: DataFrame) -> bool:
    """Whether doc_id is unique and never null; a narrow scan."""
    n, ids, distinct = docs.agg(F.count(F.lit(1)), F.count("doc_id"), F.count_distinct("doc_id")).first()
    return n == ids == distinct


def ascii_lower(c: Column | str) -> Column:
    """Lower-case A to Z only."""
    return F.translate(c, UPPER, LOWER)


def whole_text() -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col("text"), F.lit(""))
