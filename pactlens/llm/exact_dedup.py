"""Exact dedup by deterministic block naming.

A text is cut into blocks of a fixed size. The distinct blocks are sorted and numbered, so every block has an integer
name. Then pairs of adjacent names are named in the same way, level by level, until one name is left for each document.
Two documents have the same level and name exactly when their texts are identical.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.functions.text import let
from pactlens.llm.common import SPACE, keyed, remove, save, whole_text, work_folder

BLOCK_BYTES = 4096


def normalised(text: Column) -> Column:
    """One space for each run of white space. Single spaces are not touched, so most words cost nothing."""
    return F.regexp_replace(text, rf"[\x09-\x0D]{SPACE}*|\x20{SPACE}+", " ")


def _data() -> Column:
    """The UTF-8 bytes of the normalised text."""
    return F.encode(normalised(whole_text()), "UTF-8")


def _blocks(data: Column, size: int) -> Column:
    """Bytes in blocks of ``size``; no bytes are one empty block. ``data`` is a column or a bound value: it is read for each block."""
    last = F.greatest(F.floor((F.octet_length(data) - 1) / size), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _key(block: Column, seed: int) -> Column:
    """128 bits that stand for a block in joins. Whether they tell all blocks apart is checked, not assumed."""
    return F.struct(F.xxhash64(F.lit(2 * seed), block).alias("a"), F.xxhash64(F.lit(2 * seed + 1), block).alias("b"))


def _name_blocks(docs: DataFrame, size: int, seed: int, path: str) -> DataFrame | None:
    """(a, b, name) for every distinct block, named in sorted order; None if two blocks share a key."""
    blocks = docs.select(F.explode(let(_data(), lambda d: _blocks(d, size))).alias("block"))
    keyed_blocks = blocks.select(_key(F.col("block"), seed).alias("k"), "block").select("k.*", "block")
    # Copies meet before the shuffle, and each distinct block crosses it once per task.
    distinct = keyed_blocks.groupBy("a", "b").agg(F.min("block").alias("block"), F.max("block").alias("other"))
    ordered = distinct.sortWithinPartitions("block")
    names = ordered.select(
        "a", "b", F.monotonically_increasing_id().alias("name"), (F.col("block") != F.col("other")).alias("clash")
    )
    stored = save(names, path)
    return None if stored.filter("clash").limit(1).count() else stored.drop("clash")


def identities(docs: DataFrame, folder: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(_row, doc_id, text_sha256, level, name) of every row of keyed documents; (level, name) is the text's identity."""
    spark, seed = docs.sparkSession, 0
    while (names := _name_blocks(docs, block_bytes, seed, f"{folder}/names0-{seed}")) is None:
        seed += 1
    read = let(_data(), lambda d: F.struct(
        F.sha2(d, 256).alias("text_sha256"), F.transform(_blocks(d, block_bytes), lambda b: _key(b, seed)).alias("keys")))
    # Packed in an array and taken out by a generator, so that both fields come from one reading of the text.
    rows = save(docs.select("_row", "doc_id", F.inline(F.array(read))), f"{folder}/rows")
    parts = rows.select("_row", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "k"))
    longest = rows.agg(F.max(F.size("keys"))).first()[0] or 1
    # Names and keys are narrow: 24 bytes for each block. A hot key is split by the skew join.
    level = save(parts.select("_row", "n", "pos", "k.*").join(names, ["a", "b"]).select("_row", "n", "pos", "name"), f"{folder}/level0")
    depth, finished = 0, [level.filter("n = 1").select("_row", F.lit(0).alias("level"), "name")]
    while longest > 1:
        depth += 1
        pairs = level.filter("n > 1").groupBy("_row", "n", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.min(F.struct("pos", "name")).alias("l"), F.max(F.struct("pos", "name")).alias("r")
        )
        # A block without a partner is paired with -1, which is no name.
        right = F.when(F.col("r.pos") > F.col("l.pos"), F.col("r.name")).otherwise(F.lit(-1))
        pairs = save(pairs.select("_row", "n", "pos", F.col("l.name").alias("left"), right.alias("right")), f"{folder}/pairs{depth}")
        named = save(pairs.select("left", "right").distinct().sortWithinPartitions("left", "right").withColumn(
            "name", F.monotonically_increasing_id()), f"{folder}/names{depth}")
        half = F.ceil(F.col("n") / 2).cast("int").alias("n")
        level = save(pairs.join(named, ["left", "right"]).select("_row", half, "pos", "name"), f"{folder}/level{depth}")
        remove(spark, f"{folder}/pairs{depth}")
        finished.append(level.filter("n = 1").select("_row", F.lit(depth).alias("level"), "name"))
        longest = (longest + 1) // 2
    ids = finished[0]
    for more in finished[1:]:
        ids = ids.unionByName(more)
    return rows.select("_row", "doc_id", "text_sha256").join(ids, "_row")


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Group documents with the same white-space-normalised text.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256. The row with the smallest doc_id of
    a group stays (a null doc_id counts as the smallest; of repeated rows with that id one stays). Null texts are empty
    texts and equal to each other. Further columns of ``docs`` are ignored. An empty table gives an empty result.
    """
    folder = work_folder(docs.sparkSession, "exact")
    ids = save(identities(keyed(docs.select("doc_id", "text"), f"{folder}/keyed"), f"{folder}", block_bytes), f"{folder}/ids")
    groups = ids.groupBy("level", "name").agg(
        F.min(F.struct("_row", "doc_id")).alias("first"), F.count(F.lit(1)).alias("group_size")
    )
    kept = F.col("_row") == F.col("first._row")
    return ids.join(groups, ["level", "name"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256"
    )
