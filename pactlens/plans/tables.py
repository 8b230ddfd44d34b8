"""Readers for the driver tables, shaped as the operators expect them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.operators.prefix import spread
from pactlens.packs.defaults import LATIN_RULES, LATIN_SECTIONS
from pactlens.plans.review import ReviewConfig

LATIN = ReviewConfig(rules=LATIN_RULES, sections=LATIN_SECTIONS)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One driver table."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text), spread over the cores when the scan has few splits."""
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def source_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as the pages of their source: (source, page_no, text)."""
    return spread(table(spark, sf, "documents").select("source", F.col("doc_id").alias("page_no"), "text"))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as pages: (conv_id, page_no, text)."""
    return table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("page_no"), "text")


def sha(c: str):
    """Text fingerprint for result rows."""
    return F.sha2(c, 256)
