"""Sources: JSON lines, nested configuration, binary uploads, operational tables, job streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens import schemas
from pactlens.operators.lifecycle import upload_error
from pactlens.packs.model import RulePack


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped, malformed ones fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _config(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_ruleset(spark: SparkSession, path: str) -> DataFrame:
    """One row per rule in file order, with explanations."""
    return _config(spark, path, schemas.RULESET).select("version", F.posexplode("rules").alias("rule_ord", "r")).select(
        F.col("version").alias("rule_version"), "rule_ord", "r.*"
    )


def load_pack(spark: SparkSession, path: str) -> RulePack:
    """A user-supplied ruleset as a pack; rulesets are small configuration by nature."""
    rows = read_ruleset(spark, path).orderBy("rule_ord").collect()
    rules = [{k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in rows]
    return RulePack(rows[0]["rule_version"] if rows else "", rules)


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """One row per decision card."""
    return _config(spark, path, schemas.CARDS).select(F.col("version").alias("card_version"), F.inline("cards"))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Prototypes as rows: (version, rule_id, polarity, ord, text)."""
    p = _config(spark, path, schemas.TAXONOMY).select("version", F.explode("profiles").alias("p"))
    both = F.map_from_arrays(
        F.array(F.lit("positive"), F.lit("negative")), F.array("p.positive_prototypes", "p.hard_negatives")
    )
    rows = p.select("version", "p.rule_id", F.explode(both).alias("polarity", "texts"))
    return rows.select("version", "rule_id", "polarity", F.posexplode("texts").alias("ord", "text"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifests as raw JSON text, one row per file, for the manifest gate."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("manifest")
    )


def read_guidance(spark: SparkSession, path: str) -> DataFrame:
    """Drafting guidance rows."""
    return read_jsonl(spark, path, schemas.GUIDANCE)


def scan_uploads(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Binary uploads with their validation verdict and content hash."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(
        "path", "length", "modificationTime",
        upload_error(F.col("path"), F.lit(None).cast("string"), F.col("content")).alias("error_code"),
        F.sha2("content", 256).alias("sha256"),
        "content",
    )


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An operational parquet table with its declared schema."""
    return spark.read.schema(schema).parquet(path)


def job_stream(spark: SparkSession, path: str, schema: str = schemas.JOB, fmt: str = "json", max_files: int = 100) -> DataFrame:
    """Stream of job rows; the payload is an opaque id and a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(path)
