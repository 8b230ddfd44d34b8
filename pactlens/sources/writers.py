"""Sinks: results, reports, metrics, corpus snapshots and the dead-letter table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.schemas import RUN_META


def write_results(results: DataFrame, path: str, mode: str = "append") -> None:
    """Typed nested results as parquet."""
    results.write.mode(mode).parquet(path)


def export_results(results: DataFrame, key: str) -> DataFrame:
    """JSON text per row for the outer edge; other characters than ASCII are kept."""
    body = F.struct(*[c for c in results.columns if c != key])
    return results.select(key, F.to_json(body, {"ignoreNullFields": "false"}).alias("result_json"))


def write_report(rows: DataFrame, path: str, fmt: str = "json") -> None:
    """Report lines, kept in order within each output file."""
    keys = [c for c in ("doc_id", "finding_no", "line_no") if c in rows.columns]
    rows.sortWithinPartitions(*keys).write.mode("overwrite").format(fmt).save(path)


def with_run_meta(metrics: DataFrame, meta: dict[str, str]) -> DataFrame:
    """Metric rows stamped with run identity; unknown keys are refused so case text cannot slip in."""
    unknown = sorted(set(meta) - set(RUN_META))
    if unknown:
        raise ValueError(f"unsupported run metadata: {unknown}")
    if "text" in metrics.columns:
        raise ValueError("metrics must not carry case text")
    stamped = {k: F.lit(meta.get(k, "unknown")) for k in RUN_META}
    return metrics.withColumns({**stamped, "executed_at_utc": F.current_timestamp()})


def dataset_hash(cases: DataFrame, key: str) -> DataFrame:
    """Order-independent fingerprint of a dataset: row hashes are summed, then hashed."""
    row = F.sha2(F.to_json(F.struct(*sorted(cases.columns))), 256)
    part = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")
    return cases.agg(F.sha2(F.concat_ws(":", F.count(key), F.sum(part)), 256).alias("dataset_sha256"))


def write_snapshot(index: DataFrame, path: str, partition: str = "corpus_type") -> None:
    """A new corpus snapshot, partitioned by collection. The path must be new, never the one read."""
    index.write.mode("errorifexists").partitionBy(partition).parquet(path)


def write_dead_letters(failed: DataFrame, path: str) -> None:
    """Terminal failures of one batch: ids and codes only. Writing the batch again replaces it."""
    failed.select("analysis_id", "attempts", "error_code").write.mode("overwrite").parquet(path)
