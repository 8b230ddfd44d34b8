"""Distributed helpers that stay safe when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 4096


def running_offsets(
    df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], block: int = BLOCK
) -> DataFrame:
    """Add ``<value>_before``: the sum of ``value`` over earlier rows of the same key.

    A two-level prefix sum. Rows are blocked by ``order div block``; block totals get a small prefix
    sum of their own, which is joined back, and only rows of one block meet in one window. No task
    ever holds a whole hot key. ``order`` must be a non-negative integer column; pass narrow rows.
    """
    # Rows need a key and a place. Stating it here keeps both uses of the exchange identical, so the
    # input is computed and shuffled once.
    placed = df.withColumn("_block", F.floor(F.col(order) / block))
    for c in [*keys, "_block"]:
        placed = placed.filter(F.col(c).isNotNull())
    blocked = placed.repartition(*keys, "_block")
    totals = blocked.groupBy(*keys, "_block").agg(
        F.min(order).alias("_lo"), *[F.sum(v).alias(f"_t_{v}") for v in values]
    )
    before = W.partitionBy(*keys).orderBy("_lo").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(
        *keys, "_block", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_b_{v}") for v in values]
    )
    inner = W.partitionBy(*keys, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    out = blocked.join(base, [*keys, "_block"])
    for v in values:
        out = out.withColumn(f"{v}_before", F.col(f"_b_{v}") + F.coalesce(F.sum(v).over(inner), F.lit(0)))
    return out.drop("_block", *[f"_b_{v}" for v in values])


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence, keep: int, rank: str = "rank") -> DataFrame:
    """Keep the first ``keep`` rows per key; the rank filter is pushed below the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= keep)


def keep_where(df: DataFrame, condition) -> DataFrame:
    """Filter on an expensive derived column without letting the optimizer copy it down the plan.

    A plain filter is pushed below the projections that compute its columns and repeats them; after a
    chain of text steps that multiplies the work. A generator is a boundary for that rewrite.
    """
    flag = F.explode_outer(F.when(condition, F.array(F.lit(True)))).alias("_kept")
    return df.select("*", flag).filter("_kept IS NOT NULL").drop("_kept")


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence, rank: str = "rank") -> DataFrame:
    """Number the rows of each key from 1. For keys whose rows are bounded by one document's size."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, spread: Sequence[str], salts: int = 16
) -> DataFrame:
    """Join on ``keys`` with the left rows of one key spread over ``salts`` tasks.

    ``spread`` names left columns that vary inside a key. The right side, which must be the small
    per-key side, is repeated once per salt.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def spread(df: DataFrame) -> DataFrame:
    """Use every core for a scan that has fewer splits than the cluster has cores.

    Large inputs already have more splits than cores and are returned unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
