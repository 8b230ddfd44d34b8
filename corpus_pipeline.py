"""From raw documents to a training mix: quality, lines, near copies, benchmark leaks, source weights.

Each stage takes all that the one before kept, as a table in the cluster's shared folder, and returns whole documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.llm import decontaminate, line_dedup, mixing, quality, shingle_dedup
from pactlens.llm.common import keyed, remove, save, work_folder
from pactlens.llm.queries import quality_weights, table, toxic, trusted

#: Near copies: sets of five-word shingles with a similarity of 0.8 or more.
SHINGLE, SIMILARITY = 5, 0.8


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects, as unlike trusted text or as toxic, go.

    Null and empty texts have no tokens and stay; long texts are scored whole; repeated rows are judged alike; an empty table stays empty.
    """
    return quality.classify(docs, trusted(spark, sf_dir), toxic(spark, sf_dir)).filter("kept").select("_doc.*")


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents go from all of them; n_chars follows the text.

    A null text stays null, an empty one empty; repeated rows are documents of their own; an empty table stays empty.
    """
    done = line_dedup.drop_frequent_lines(docs).select("_doc.*")
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; of repeated rows one.

    Null and empty texts are one group; a null id is the smallest; long texts are compared whole; an empty table stays empty.
    """
    folder = work_folder(spark, "near")
    rows = keyed(docs, folder)
    groups = shingle_dedup.near_groups(rows, "_row", SHINGLE, SIMILARITY, folder=f"{folder}/groups")
    stay = save(groups.filter("_row = component_id").select("_row"), f"{folder}/stay")
    remove(spark, f"{folder}/groups")
    return rows.join(stay, "_row", "left_semi").select("_doc.*")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also with other numbers and names, go.

    Null and empty texts hold none and stay; repeated rows go or stay together; an empty table or benchmark changes nothing.
    """
    folder = work_folder(spark, "leaks")
    rows = keyed(docs, folder)
    found = decontaminate.matches(rows.select(F.col("_row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaks = save(found.select(F.col("doc_id").alias("_row")).distinct(), f"{folder}/found")
    return rows.join(leaks, "_row", "left_anti").select("_doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix with the words that it takes from each, and with their source's size and target.

    Null and empty texts have no words and are not taken; a null source is a source; repeated rows are documents of their own. Columns
    named size, source_size, target and taken are replaced. An empty table stays empty.
    """
    folder = work_folder(spark, "mixed")
    rows = keyed(docs, folder)
    sizes = rows.select("_row", "doc_id", F.col("_doc.source").alias("source"), mixing.word_count("text").alias("size"))
    graded = sizes.join(quality_weights(spark, sf_dir), F.col("doc_id") == F.col("_id"), "left")
    taken = mixing.mix(graded.select(F.col("_row").alias("doc_id"), "source", "size", "quality"))
    taken = save(taken.filter("taken > 0").select(F.col("doc_id").alias("_row"), "size", "source_size", "target", "taken"), f"{folder}/taken")
    return rows.join(taken, "_row").select(
        *[F.col("_doc")[c].alias(c) for c in docs.columns if c not in ("size", "source_size", "target", "taken")], "size", "source_size", "target", "taken"
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", drop_low_quality),
    ("line_dedup", drop_common_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

#: Fitted models and fingerprints can't be stated in SQL; tests compare the stages with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, folder = table(spark, sf_dir, "documents"), work_folder(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = save(docs, f"{folder}/{name}")
            if i:  # what the stage has read
                remove(spark, f"{folder}/{STAGES[i - 1][0]}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
