"""The job queue as Structured Streaming: dedupe, retry state, progress, processing, retention."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from pactlens.constants import MAX_ATTEMPTS, PROGRESS_TTL_SECONDS
from pactlens.operators.lifecycle import expire_audit, expire_documents, expiry_audit, retention_cascade
from pactlens.sources.stored import path_exists
from pactlens.sources.writers import write_dead_letters

RETRY_OUTPUT = "analysis_id string, attempts int, state string, dead_letter boolean, disposition string, error_code string"
_STATE = StructType([StructField("attempts", IntegerType()), StructField("state", StringType())])


class RetryProcessor(StatefulProcessor):
    """Counts failures per analysis and emits its state after every micro-batch."""

    def __init__(self, max_attempts: int = MAX_ATTEMPTS, ttl_seconds: int = PROGRESS_TTL_SECONDS) -> None:
        self.max_attempts, self.ttl_ms = max_attempts, ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.saved = handle.getValueState("retry", _STATE, ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        attempts, state = self.saved.get() if self.saved.exists() else (0, "queued")
        code = None
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"])
        for failed, can_retry, error in zip(batch["failed"], batch["retryable"], batch["error_code"]):
            if state in ("completed", "failed"):
                break
            if not failed:
                state = "completed"
                continue
            attempts += 1
            if can_retry and attempts < self.max_attempts:
                state, code = "queued", "ANALYSIS_RETRYING"
            else:
                state, code = "failed", error or "ANALYSIS_FAILED"
        self.saved.update((attempts, state))
        dead = state == "failed"
        yield pd.DataFrame({
            "analysis_id": [key[0]], "attempts": [attempts], "state": [state], "dead_letter": [dead],
            "disposition": ["needs_review" if dead else None], "error_code": [code],
        })

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """State of this kind needs the RocksDB provider."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def retry_states(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS, ttl: int = PROGRESS_TTL_SECONDS) -> DataFrame:
    """Keyed retry state over a stream of attempts; state expires after the progress time."""
    return attempts.groupBy("analysis_id").transformWithStateInPandas(
        statefulProcessor=RetryProcessor(max_attempts, ttl), outputStructType=RETRY_OUTPUT,
        outputMode="Update", timeMode="ProcessingTime",
    )


def dedupe_jobs(jobs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each analysis id at most once within the delay."""
    return jobs.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["analysis_id"])


def plan_batch(jobs: DataFrame, analyses: DataFrame, documents: DataFrame) -> DataFrame:
    """Decide every queued id: run it, fail it because its document is gone, or ignore it."""
    ids = jobs.select("analysis_id").distinct()
    a = analyses.select(F.col("id").alias("analysis_id"), "document_id", "status")
    d = documents.select(F.col("id").alias("document_id"), F.col("deleted_at").alias("_gone"), F.lit(True).alias("_doc"))
    joined = ids.join(a, "analysis_id").join(d, "document_id", "left")
    done = F.col("status").isin("completed", "deleted")
    lost = F.col("_doc").isNull() | F.col("_gone").isNotNull()
    return joined.select(
        "analysis_id", "document_id",
        F.when(done, "ignore").when(lost, "fail").otherwise("run").alias("step"),
        F.when(~done & lost, F.lit("DOCUMENT_NOT_FOUND")).alias("error_code"),
    )


def process_jobs(
    jobs: DataFrame, load: Callable[[], tuple[DataFrame, DataFrame]], review: Callable[[DataFrame], DataFrame],
    results_path: str, checkpoint: str,
):
    """Start the worker: each micro-batch reviews its runnable documents and appends results.

    ``load`` gives the current analyses and documents; ``review`` maps (analysis_id, document_id)
    rows to result rows. Ids that the results of other batches show as completed are skipped. A replayed batch
    replaces its own results, so it has no second effect.
    """

    def finished(spark: SparkSession, batch_id: int) -> DataFrame | None:
        if not path_exists(spark, results_path):
            return None
        columns = "analysis_id string, status string, batch_id long"
        done = spark.read.schema(columns).option("basePath", results_path).parquet(results_path)
        return done.filter((F.col("status") == "completed") & (F.col("batch_id") != batch_id)).select("analysis_id")

    def run(batch: DataFrame, batch_id: int) -> None:
        analyses, documents = load()
        plan = plan_batch(batch, analyses, documents)
        done_before = finished(batch.sparkSession, batch_id)
        if done_before is not None:
            plan = plan.join(done_before, "analysis_id", "left_anti")
        run_now = plan.filter("step = 'run'").select("analysis_id", "document_id")
        failed = plan.filter("step = 'fail'").select(
            "analysis_id", "document_id", F.lit("failed").alias("status"), "error_code"
        )
        done = review(run_now).withColumn("status", F.lit("completed")).withColumn("error_code", F.lit(None).cast("string"))
        out = done.unionByName(failed, allowMissingColumns=True).withColumn("batch_id", F.lit(batch_id))
        # Overwriting the batch's own partition makes a replayed batch harmless.
        out.drop("batch_id").write.mode("overwrite").parquet(f"{results_path}/batch_id={batch_id}")

    return jobs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_retries(attempts: DataFrame, states_path: str, dead_path: str, checkpoint: str):
    """Write every state change, and terminal failures once more to the dead-letter table."""

    def split(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        batch.write.mode("overwrite").parquet(f"{states_path}/batch_id={batch_id}")
        write_dead_letters(batch.filter("dead_letter"), f"{dead_path}/batch_id={batch_id}")
        batch.unpersist()

    return (
        retry_states(attempts).writeStream.outputMode("update").foreachBatch(split)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def progress(states: DataFrame) -> DataFrame:
    """Progress rows of a retry-state stream: retrying shows 0 percent, terminal states 100."""
    shown = F.when((F.col("state") == "queued") & (F.col("attempts") > 0), "retrying").otherwise(F.col("state"))
    return states.select(
        "analysis_id", shown.alias("state"),
        F.when(F.col("state").isin("completed", "failed"), 100).otherwise(0).alias("percent"),
    )


def start_retention(
    ticks: DataFrame, load: Callable[[], tuple[DataFrame, dict[str, tuple[DataFrame, str, Column]]]], path: str, checkpoint: str
):
    """Start the retention job: each micro-batch of ticks (ts) is one pass at its latest tick.

    A pass writes the deletions of documents and of all their children as one table, so both become visible in one commit; readers
    leave them out with ``lifecycle.without_deleted``. What another pass has taken is not taken again. A replayed batch has the
    same time and replaces its own deletions.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = batch.agg(F.max("ts").alias("ts")).first().ts
        if last is None:
            return
        documents, children = load()
        taken = retention_deletions(spark, path, batch_id)
        found = retention_cascade(documents, children, F.lit(last).cast("timestamp"))
        if taken is not None:
            found = found.join(taken.select("kind", "id"), ["kind", "id"], "left_anti")
        found.select("kind", "id", "document_id", "deleted_at").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retention_deletions(spark: SparkSession, path: str, but: int | None = None) -> DataFrame | None:
    """All deletions so far, without those of one batch; None before the first pass."""
    if not path_exists(spark, path):
        return None
    schema = "kind string, id string, document_id string, deleted_at timestamp, batch_id long"
    rows = spark.read.schema(schema).option("basePath", path).parquet(path)
    return rows if but is None else rows.filter(F.col("batch_id") != but)


def retention_run(documents: DataFrame, audit: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """One retention pass: updated documents, and the audit rows that stay plus the new ones."""
    moment = F.lit(now).cast("timestamp")
    updated = expire_documents(documents, moment)
    fresh = expiry_audit(updated, moment)
    kept = expire_audit(audit, moment).unionByName(fresh, allowMissingColumns=True)
    return updated.drop("expired_now"), kept
