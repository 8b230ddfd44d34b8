"""Mixing sources to target weights by weighted sampling without replacement.

Every document draws an exponential key divided by its quality weight (Efraimidis and Spirakis); sorted keys are a
weighted random order of the source. Complete epochs are taken first, the rest of the target is filled in that order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactlens.llm.common import WORD, number, save, work_folder

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BINS = 4096


def word_count(text: Column | str) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, folder: str, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code-point order, null last, have the weights in turn. A target stops at ``most`` times its source; what
    is over is shared again by weight until no source is above. Each round is one aggregate of the narrow source table,
    so any number of sources works.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = number(sizes, [F.col("source").asc_nulls_last()], f"{folder}/sources", "rank")
    weighed = save(ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))), f"{folder}/weights")
    level, done = 0.0, -1
    while True:
        full = F.col("source_size") * F.lit(most) <= F.col("weight") * F.lit(level)
        total, taken, free, n = weighed.agg(
            F.sum("source_size"), F.sum(F.when(full, F.col("source_size") * F.lit(most))),
            F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1)),
        ).first()
        if not total or not free or n == done:
            break
        done, level = n, (share * total - (taken or 0.0)) / free
    target = F.least(F.col("source_size") * F.lit(most), F.col("weight") * F.lit(level))
    return weighed.select("source", "source_size", target.alias("target"))


def sampling_key(doc_id: Column, quality: Column, seed: int) -> Column:
    """An exponential with rate ``quality``, fixed by the id: reruns agree."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 11) + 0.5) / float(1 << 53)
    return -F.log(uniform) / quality


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 11, bins: int = BINS
) -> DataFrame:
    """Take words from each source up to its target.

    ``docs``: doc_id, source, size, quality (positive weight; null is 1). Returns doc_id, source, size, source_size,
    target, key, epochs (complete passes), taken. The order inside a source is by (key, doc_id, size); the document at
    the budget's end is taken in part, so sources meet their targets. Null doc_ids share one key and are ordered by
    size; repeated rows are documents of their own. Sizes of zero take zero. Further columns are ignored.

    No source is sorted in one task: the keys are cut into ``bins`` ranges of equal probability, sums of the ranges
    give each range its offset, and only rows of one range of a source meet in a window.
    """
    folder = work_folder(docs.sparkSession, "mix")
    key = sampling_key(F.col("doc_id"), F.coalesce(F.col("quality"), F.lit(1.0)).cast("double"), seed)
    # The rank of an exponential's value is 1 - exp(-x): monotone in the key, so the ranges are in key order.
    place = F.floor((1 - F.exp(-F.col("key"))) * bins).cast("int")
    rows = docs.select("doc_id", "source", F.col("size").cast("long").alias("size"), key.alias("key")).withColumn("bin", place)
    rows = save(rows, f"{folder}/rows")
    ranges = save(rows.groupBy("source", "bin").agg(F.sum("size").alias("n")), f"{folder}/bins")
    goal = save(targets(ranges.groupBy("source").agg(F.sum("n").alias("source_size")), folder, weights, share, most), f"{folder}/targets")
    before = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    # One row for each range of a source: at most `bins` rows of a source meet here.
    starts = ranges.select("source", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    starts = starts.join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    starts = starts.withColumnsRenamed({"source": "_s", "bin": "_b"})
    own = W.partitionBy("source", "bin").orderBy("key", F.col("doc_id").asc_nulls_first(), "size")
    earlier = F.coalesce(F.sum("size").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("inside", earlier).join(
        starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bin") == F.col("_b"))
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor(F.col("target") - F.col("epochs") * F.col("source_size"))
    extra = F.least(F.greatest(rest - F.col("start") - F.col("inside"), F.lit(0)), F.col("size"))
    return placed.withColumn("epochs", epochs).select(
        "doc_id", "source", "size", "source_size", "target", "key", "epochs", (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken")
    )
