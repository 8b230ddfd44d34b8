"""The queue as streams: equality with the batch twins, dedupe, processing, retention."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from pactlens import schemas
from pactlens.operators import lifecycle
from pactlens.sources.readers import job_stream
from pactlens.streaming import jobs

T0 = dt.datetime(2026, 1, 1)


def _write(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def test_three_failures_give_two_requeues_and_one_dead_letter(spark):
    rows = [("a", T0 + dt.timedelta(seconds=i), i, True, True) for i in range(3)] + [("b", T0, 0, True, True), ("c", T0, 0, True, False), ("d", T0, 0, False, True)]
    df = spark.createDataFrame(rows, "analysis_id string, ts timestamp, seq long, failed boolean, retryable boolean")
    got = {r.analysis_id: (r.attempts, r.state, r.dead_letter, r.disposition) for r in lifecycle.retry_plan(df).collect()}
    assert got == {
        "a": (3, "failed", True, "needs_review"), "b": (1, "queued", False, None),
        "c": (1, "failed", True, "needs_review"), "d": (0, "completed", False, None),
    }


def test_stream_state_equals_batch_plan(spark, tmp_path):
    jobs.use_rocksdb(spark)
    rnd = random.Random(11)
    rows = [
        {"analysis_id": f"j{rnd.randrange(12)}", "ts": (T0 + dt.timedelta(minutes=i)).isoformat(), "seq": i,
         "failed": rnd.random() < 0.8, "retryable": rnd.random() < 0.85, "error_code": "OCR_TIMEOUT"}
        for i in range(80)
    ]
    src = tmp_path / "in"
    src.mkdir()
    for n in range(4):
        _write(src / f"{n}.json", rows[n * 20:(n + 1) * 20])
    stream = job_stream(spark, str(src), schemas.ATTEMPT, max_files=4)
    q = jobs.start_retries(stream, str(tmp_path / "st"), str(tmp_path / "dead"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {r.analysis_id: (r.attempts, r.state) for r in spark.read.parquet(str(tmp_path / "st")).collect()}
    batch = spark.read.schema(schemas.ATTEMPT).json(str(src))
    want = {r.analysis_id: (r.attempts, r.state) for r in lifecycle.retry_plan(batch).collect()}
    assert got == want
    dead = spark.read.parquet(str(tmp_path / "dead" / "batch_id=0"))
    assert {r.analysis_id for r in dead.collect()} == {k for k, v in want.items() if v[1] == "failed"}
    shown = {r.analysis_id: r.percent for r in jobs.progress(spark.read.parquet(str(tmp_path / "st"))).collect()}
    assert all(p == (100 if want[k][1] in ("failed", "completed") else 0) for k, p in shown.items())


def test_jobs_are_processed_once_and_lost_documents_fail(spark, tmp_path):
    analyses = spark.createDataFrame([("a1", "d1", "queued"), ("a2", "d2", "queued"), ("a3", "d3", "completed"), ("a4", "d9", "queued")], "id string, document_id string, status string")
    documents = spark.createDataFrame([("d1", None), ("d2", T0), ("d3", None)], "id string, deleted_at timestamp")
    src = tmp_path / "q"
    src.mkdir()
    _write(src / "0.json", [{"analysis_id": a, "ts": T0.isoformat()} for a in ("a1", "a1", "a2", "a3", "a4")])
    q = jobs.process_jobs(
        jobs.dedupe_jobs(job_stream(spark, str(src))), lambda: (analyses, documents),
        lambda ids: ids.withColumn("disposition", F.lit("no_signal")), str(tmp_path / "out"), str(tmp_path / "cp"),
    )
    q.awaitTermination(120)
    got = {r.analysis_id: (r.status, r.error_code) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a1": ("completed", None), "a2": ("failed", "DOCUMENT_NOT_FOUND"), "a4": ("failed", "DOCUMENT_NOT_FOUND")}


def test_retention_pass(spark):
    docs = spark.createDataFrame([("d1", "ready", "t", T0, None), ("d2", "ready", "t", T0 + dt.timedelta(days=9), None)], "id string, status string, masked_text string, expires_at timestamp, deleted_at timestamp")
    audit = spark.createDataFrame([("document_uploaded", "d1", T0 - dt.timedelta(days=400)), ("document_uploaded", "d2", T0)], "event_type string, document_id string, created_at timestamp")
    updated, kept = jobs.retention_run(docs, audit, "2026-01-02 00:00:00")
    state = {r.id: (r.status, r.masked_text) for r in updated.collect()}
    assert state == {"d1": ("expired", None), "d2": ("ready", "t")}
    assert sorted((r.event_type, r.document_id) for r in kept.collect()) == [("document_expired", "d1"), ("document_uploaded", "d2")]


def test_retention_takes_children_along_and_a_replay_changes_nothing(spark, tmp_path):
    day = dt.timedelta(days=1)
    docs = spark.createDataFrame([("d1", T0, None), ("d2", T0 + 2 * day, None), ("d3", T0, T0 - day), ("d4", T0 + 9 * day, None)], "id string, expires_at timestamp, deleted_at timestamp")
    clauses = spark.createDataFrame([("d1", 1), ("d1", 2), ("d2", 1), ("d3", 1), ("d4", 1), (None, 1)], "doc string, n int")
    own = F.concat_ws(":", "doc", "n")
    src, path = tmp_path / "ticks", str(tmp_path / "gone")
    src.mkdir()

    def run(checkpoint):
        ticks = job_stream(spark, str(src), "ts timestamp", max_files=1)
        jobs.start_retention(ticks, lambda: (docs, {"clause": (clauses, "doc", own)}), path, str(tmp_path / checkpoint)).awaitTermination(120)
        return sorted((r.batch_id, r.kind, r.id) for r in jobs.retention_deletions(spark, path).collect())

    _write(src / "0.json", [{"ts": (T0 + day / 2).isoformat()}, {"ts": (T0 + day).isoformat()}])
    first = [(0, "clause", "d1:1"), (0, "clause", "d1:2"), (0, "clause", "d3:1"), (0, "document", "d1")]
    assert run("cp") == first
    assert run("other") == first  # a lost checkpoint: batch 0 again
    _write(src / "1.json", [{"ts": (T0 + 3 * day).isoformat()}])
    assert run("cp") == [*first, (1, "clause", "d2:1"), (1, "document", "d2")]
    left = lifecycle.without_deleted(clauses, jobs.retention_deletions(spark, path), "clause", own)
    assert {(r.doc, r.n) for r in left.collect()} == {("d4", 1), (None, 1)}
