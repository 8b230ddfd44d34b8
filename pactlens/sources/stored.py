"""Stored tables that change in place: the corpus index by hash buckets, and vectors by the hash of their text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.functions.embed import Encoder
from pactlens.operators.ingest import sync_cards, upsert_index, upsert_plan

BUCKETS = 256


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-stored-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """Rows with the bucket of their key; the number of buckets belongs to the stored table and must not change."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def write_index(index: DataFrame, path: str, key: str = "stable_id", buckets: int = BUCKETS) -> None:
    """A new stored index, one folder for each bucket of the key. The path must be new."""
    rows = bucketed(index, key, buckets)
    rows.repartition(F.col("bucket")).write.mode("errorifexists").partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The stored index with its bucket column."""
    return spark.read.parquet(path).withColumn("bucket", F.col("bucket").cast("int"))


def _touched(changes: DataFrame) -> list[int]:
    """Buckets with a change: at most as many numbers as the table has buckets."""
    return [r.bucket for r in changes.select("bucket").distinct().collect()]


def _replace(spark: SparkSession, rows: DataFrame, path: str, touched: Sequence[int]) -> None:
    """Write whole buckets anew, and no others. A bucket that becomes empty is emptied as well."""
    rows.repartition(F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    filled = set(_touched(rows))
    for bucket in touched:
        if bucket not in filled:
            remove_path(spark, f"{path}/bucket={bucket}")


def upsert_stored(
    spark: SparkSession, path: str, incoming: DataFrame, meta: Sequence[str], order: str, buckets: int = BUCKETS
) -> DataFrame:
    """Upsert rows into a stored index; returns (stable_id, action) of every incoming id.

    Only buckets with an added or updated row are read in full and written again. The plan is a table of its own before anything
    changes, so it does not see its own effect. The same rows again change nothing, and a run that was cut off is made good by
    running it again: what it had written counts as unchanged. One writer at a time.
    """
    stored = read_index(spark, path)
    folder = shared_folder(spark, "upsert")
    bucketed(upsert_plan(stored.drop("bucket"), incoming, meta, order), "stable_id", buckets).write.parquet(f"{folder}/plan")
    plan = spark.read.parquet(f"{folder}/plan")
    touched = _touched(plan.filter("action <> 'skip'"))
    if touched:
        now = upsert_index(stored.filter(F.col("bucket").isin(touched)), plan)
        now.select(stored.columns).write.parquet(f"{folder}/rows")
        _replace(spark, spark.read.parquet(f"{folder}/rows"), path, touched)
        remove_path(spark, f"{folder}/rows")
    return plan.select("stable_id", "action")


def sync_stored(
    spark: SparkSession, path: str, cards: DataFrame, key: str = "card_id", version: str = "card_version", buckets: int = BUCKETS
) -> DataFrame:
    """Bring a stored table of cards to the given ones; returns (key, action). As ``upsert_stored``, and stale cards go."""
    stored = read_index(spark, path)
    folder = shared_folder(spark, "sync")
    bucketed(sync_cards(stored, cards, key, version), key, buckets).write.parquet(f"{folder}/plan")
    plan = spark.read.parquet(f"{folder}/plan")
    changes = plan.filter("action <> 'skip'")
    touched = _touched(changes)
    if touched:
        kept = stored.filter(F.col("bucket").isin(touched)).join(changes.select(key), key, "left_anti")
        fresh = bucketed(cards.join(changes.filter("action <> 'delete'").select(key), key, "left_semi"), key, buckets)
        kept.unionByName(fresh, allowMissingColumns=True).select(stored.columns).write.parquet(f"{folder}/rows")
        _replace(spark, spark.read.parquet(f"{folder}/rows"), path, touched)
        remove_path(spark, f"{folder}/rows")
    return plan.select(key, "action")


def encode_stored(texts: DataFrame, encoder: Encoder, path: str, batch: int = 256) -> DataFrame:
    """Rows of ``texts`` (a column ``text``, and others) with their ``vector``, each distinct text encoded once for all runs.

    Vectors are stored by the SHA-256 of their text, together with nothing else; only hashes that the store does not have reach
    the encoder, ``batch`` texts at a time. Null texts have no vector. Two runs at once may store a vector twice; it is read once.
    """
    spark = texts.sparkSession
    hashed = texts.withColumn("_hash", F.sha2("text", 256))
    missing = hashed.filter("text IS NOT NULL").select("_hash")
    if path_exists(spark, path):
        missing = missing.join(spark.read.parquet(path).select(F.col("text_sha256").alias("_hash")), "_hash", "left_anti")
    # One row stands for all copies; only ids and hashes meet before the texts are looked at.
    one = hashed.filter("text IS NOT NULL").join(missing.distinct(), "_hash", "left_semi").groupBy("_hash").agg(F.any_value("text").alias("text"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), batch):
                some = part.iloc[i:i + batch]
                vectors = [[float(x) for x in v] for v in encoder(some["text"].tolist())]
                yield pd.DataFrame({"text_sha256": some["_hash"].tolist(), "vector": vectors})

    one.mapInPandas(run, "text_sha256 string, vector array<double>").write.mode("append").parquet(path)
    store = spark.read.schema("text_sha256 string, vector array<double>").parquet(path).dropDuplicates(["text_sha256"])
    return hashed.join(store.withColumnRenamed("text_sha256", "_hash"), "_hash", "left").drop("_hash")
