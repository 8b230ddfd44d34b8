"""Document life cycle: validation, retention, retries, audit, public views, encryption."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.constants import (
    ALLOWED_UPLOADS, AUDIT_LIMIT_DEFAULT, AUDIT_LIMIT_MAX, AUDIT_RETENTION_DAYS, DOCUMENT_TTL_HOURS, HIDDEN_WARNINGS,
    MAX_ATTEMPTS, MAX_UPLOAD_BYTES, PROGRESS_TTL_SECONDS, RETRYABLE_ERRORS,
)
from pactlens.operators.prefix import top_rows

PERCENT = {"queued": 0, "analyzing": 25, "retrying": 0, "completed": 100, "failed": 100}


def upload_error(
    name: Column, mime: Column, content: Column, max_bytes: int = MAX_UPLOAD_BYTES
) -> Column:
    """First failed upload check as a code, or NULL; ``content`` is binary."""
    ext = F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))
    size = F.octet_length(content)
    expected = F.create_map(*[F.lit(x) for kv in ALLOWED_UPLOADS.items() for x in kv])

    def starts(sig: bytes) -> Column:
        return F.substring(content, 1, len(sig)) == F.lit(sig)

    return (
        F.when(~ext.isin(list(ALLOWED_UPLOADS)), "UNSUPPORTED_TYPE")
        .when(F.coalesce(size, F.lit(0)) == 0, "EMPTY_FILE")
        .when(size > max_bytes, "FILE_TOO_LARGE")
        .when((ext == ".pdf") & ~starts(b"%PDF-"), "BAD_PDF_SIGNATURE")
        .when((ext == ".docx") & ~starts(b"PK\x03\x04"), "BAD_DOCX_SIGNATURE")
        .when(
            (F.coalesce(mime, F.lit("")) != "") & (mime != F.try_element_at(expected, ext)) & (mime != "application/octet-stream"),
            "MIME_MISMATCH",
        )
        .when((ext == ".txt") & ~F.is_valid_utf8(content.cast("string")), "NOT_UTF8")
    )


def retryable(error_code: Column) -> Column:
    """Retry hint; NULL when there is no code."""
    return F.when(error_code.isNotNull() & (error_code != ""), error_code.isin(RETRYABLE_ERRORS))


def live(entities: DataFrame) -> DataFrame:
    """Rows that are not tombstoned."""
    return entities.filter("deleted_at IS NULL")


def read_entities(entities: DataFrame, status: str | None = None, entity_id=None, key: str = "id") -> DataFrame:
    """Live rows, optionally of one status or id; predicates reach the scan."""
    out = live(entities)
    if status is not None:
        out = out.filter(F.col("status") == status)
    return out if entity_id is None else out.filter(F.col(key) == entity_id)


def audit_query(
    events: DataFrame, document_id=None, limit: int = AUDIT_LIMIT_DEFAULT, key: str = "id",
    created: str = "created_at", document: str = "document_id",
) -> DataFrame:
    """Most recent audit events; the id breaks ties."""
    if not 1 <= limit <= AUDIT_LIMIT_MAX:
        raise ValueError(f"limit must be between 1 and {AUDIT_LIMIT_MAX}")
    rows = events if document_id is None else events.filter(F.col(document) == document_id)
    return rows.orderBy(F.col(created).desc(), F.col(key).desc()).limit(limit)


def public_view(results: DataFrame) -> DataFrame:
    """Drop the document text and hide internal warnings from typed results."""
    return results.withColumns({
        "document": F.col("document").dropFields("masked_text"),
        "warnings": F.filter("warnings", lambda w: ~w.isin(HIDDEN_WARNINGS)),
    })


def purge_field(results: DataFrame, column: str, field: str) -> DataFrame:
    """Rewrite JSON objects that still hold ``field`` without it; other rows keep their exact bytes.

    All other keys keep their values, nested ones too. ``purged`` tells which rows changed.
    """
    holds = F.array_contains(F.json_object_keys(column), field)
    changed = F.coalesce(holds, F.lit(False))
    members = F.try_parse_json(F.when(changed, F.col(column))).cast("map<string, variant>")
    rest = F.map_filter(members, lambda k, _: k != field)
    return results.withColumn("purged", changed).withColumn(column, F.when(changed, F.to_json(rest)).otherwise(F.col(column)))


def expires_at(uploaded: Column, hours: int = DOCUMENT_TTL_HOURS) -> Column:
    """End of a document's life."""
    return uploaded + F.make_interval(hours=F.lit(hours))


def expire_documents(docs: DataFrame, now: Column) -> DataFrame:
    """Expire live documents at or past their end: status, text and deletion time change together."""
    due = F.col("deleted_at").isNull() & (F.col("expires_at") <= now)
    return docs.withColumns({
        "expired_now": due,
        "status": F.when(due, "expired").otherwise(F.col("status")),
        "masked_text": F.when(due, F.lit(None).cast("string")).otherwise(F.col("masked_text")),
        "deleted_at": F.when(due, now).otherwise(F.col("deleted_at")),
    })


def expiry_audit(expired: DataFrame, now: Column, key: str = "id") -> DataFrame:
    """One audit row per document expired in this run."""
    return expired.filter("expired_now").select(
        F.lit("document_expired").alias("event_type"), F.col(key).alias("document_id"), now.alias("created_at")
    )


def cascade_children(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children of the given parents."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_semi")


def retention_cascade(documents: DataFrame, children: dict[str, tuple[DataFrame, str, Column]], now: Column) -> DataFrame:
    """(kind, id, document_id, deleted_at) of everything that a retention pass takes away: due documents and all their children.

    ``children`` gives for each kind its rows, their column with the document's id and an expression of their own id. Ids are text.
    A child of a document that went in an earlier pass and came too late is taken as well; rows without a document stay.
    """
    gone = documents.withColumn("_due", F.col("deleted_at").isNull() & (F.col("expires_at") <= now))
    due = gone.filter("_due").select(F.col("id").cast("string").alias("document_id"))
    lost = gone.filter(F.col("_due") | F.col("deleted_at").isNotNull()).select(F.col("id").cast("string").alias("document_id"))
    out = due.select(F.lit("document").alias("kind"), F.col("document_id").alias("id"), "document_id")
    for kind, (rows, key, own) in sorted(children.items()):
        named = rows.select(F.lit(kind).alias("kind"), own.cast("string").alias("id"), F.col(key).cast("string").alias("document_id"))
        out = out.unionByName(cascade_children(named, lost, "document_id", "document_id").select("kind", "id", "document_id"))
    return out.withColumn("deleted_at", now)


def without_deleted(rows: DataFrame, deletions: DataFrame, kind: str, own: Column) -> DataFrame:
    """Rows of a kind that no retention pass has taken."""
    gone = deletions.filter(F.col("kind") == kind).select(F.col("id").alias("_gone"))
    return rows.withColumn("_own", own.cast("string")).join(gone, F.col("_own") == F.col("_gone"), "left_anti").drop("_own")


def expire_audit(events: DataFrame, now: Column, days: int = AUDIT_RETENTION_DAYS, created: str = "created_at") -> DataFrame:
    """Audit rows that stay: strictly older ones go."""
    return events.filter(F.col(created) >= now - F.make_interval(days=F.lit(days)))


def owned_previews(requests: DataFrame, results: DataFrame, live_docs: DataFrame) -> DataFrame:
    """Requests whose preview id belongs to a finding or candidate of a live document."""
    owned = (
        results.join(live_docs.select("document_id"), "document_id", "left_semi")
        .select("analysis_id", F.explode("preview_ids").alias("preview_id"))
        .distinct()
    )
    return requests.join(owned, ["analysis_id", "preview_id"], "left_semi")


def preview_id_valid(preview_id: Column) -> Column:
    """Shape of a preview id."""
    return preview_id.rlike("^[0-9a-f]{24}$")


def retry_plan(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Final state per analysis from its attempt log: the batch twin of the streaming retry state.

    ``attempts`` is (analysis_id, ts, seq, failed, retryable). The job ends at its first success,
    its first non-retryable failure or its last allowed failure, whichever comes first; later rows
    have no effect. Only the first few failures per id travel, so a hot id cannot overload a task.
    """
    order = F.struct("ts", "seq")
    failures = top_rows(attempts.filter("failed"), ["analysis_id"], ["ts", "seq"], max_attempts, "nth")
    fail_side = failures.groupBy("analysis_id").agg(
        F.min(F.when(~F.col("retryable") | (F.col("nth") >= max_attempts), order)).alias("_dead"),
        F.array_sort(F.collect_list(F.struct(order.alias("at"), "nth"))).alias("_f"),
    )
    hard = attempts.filter(F.col("failed") & ~F.col("retryable")).groupBy("analysis_id").agg(F.min(order).alias("_hard"))
    good = attempts.filter(~F.col("failed")).groupBy("analysis_id").agg(F.min(order).alias("_ok"))
    joined = good.join(fail_side, "analysis_id", "full").join(hard, "analysis_id", "full")
    dead = F.least("_dead", "_hard")
    done = F.col("_ok").isNotNull() & (dead.isNull() | (F.col("_ok") < dead))
    stop = F.when(done, F.col("_ok")).otherwise(dead)
    counted = F.when(
        F.col("_f").isNull(), F.lit(0)
    ).otherwise(F.size(F.filter("_f", lambda f: stop.isNull() | (f["at"] <= stop))))
    out = joined.select(
        "analysis_id",
        counted.alias("attempts"),
        F.when(done, "completed").when(dead.isNotNull(), "failed").otherwise("queued").alias("state"),
    )
    return out.withColumns({
        "dead_letter": F.col("state") == "failed",
        "disposition": F.when(F.col("state") == "failed", "needs_review"),
    })


def progress_latest(states: DataFrame, now: Column, ttl: int = PROGRESS_TTL_SECONDS) -> DataFrame:
    """Latest unexpired progress per analysis from (analysis_id, ts, seq, state)."""
    last = states.groupBy("analysis_id").agg(F.max(F.struct("ts", "seq", "state")).alias("_l"))
    percent = F.create_map(*[F.lit(x) for kv in PERCENT.items() for x in kv])
    fresh = last.filter(F.col("_l.ts") >= now - F.make_interval(secs=F.lit(ttl)))
    return fresh.select(
        "analysis_id", F.col("_l.state").alias("state"), F.try_element_at(percent, F.col("_l.state")).alias("percent"),
        F.col("_l.ts").alias("updated_at"),
    )


def queue_depths(states: DataFrame) -> DataFrame:
    """Pending and dead-letter counts."""
    return states.agg(
        F.count_if(F.col("state").isin("queued", "retrying")).alias("queue_depth"),
        F.count_if(F.col("state") == "failed").alias("dead_letter_depth"),
    )


def lifecycle_audit(documents: DataFrame, analyses: DataFrame) -> DataFrame:
    """Audit events of every transition visible on document and analysis rows; ids and types only."""
    def event(kind: str, at: Column, when: Column | None = None) -> Column:
        body = F.struct(F.lit(kind).alias("event_type"), at.alias("created_at"))
        return F.when(at.isNotNull() if when is None else when, body)

    doc_events = F.array_compact(
        F.array(
            event("document_uploaded", F.col("uploaded_at")),
            event("document_expired", F.col("deleted_at"), (F.col("status") == "expired")),
            event("document_deleted", F.col("deleted_at"), (F.col("status") == "deleted")),
        )
    )
    run_events = F.array_compact(
        F.array(
            event("analysis_created", F.col("created_at")),
            event("analysis_completed", F.col("completed_at"), F.col("status") == "completed"),
            event("analysis_failed", F.coalesce("completed_at", "created_at"), F.col("status") == "failed"),
        )
    )
    d = documents.select(F.col("id").alias("document_id"), F.lit(None).cast("string").alias("analysis_id"), F.explode(doc_events).alias("_e"))
    a = analyses.select("document_id", F.col("id").cast("string").alias("analysis_id"), F.explode(run_events).alias("_e"))
    return d.unionByName(a).select("document_id", "analysis_id", "_e.event_type", "_e.created_at")


def encrypt(content: Column, key: Column) -> Column:
    """Authenticated encryption of a text or binary column."""
    return F.aes_encrypt(content.cast("binary"), key, F.lit("GCM"))


def decrypt(cipher: Column, key: Column) -> tuple[Column, Column]:
    """Plain text and error code; a wrong key or altered data gives NULL and a code."""
    plain = F.try_aes_decrypt(cipher, key, F.lit("GCM")).cast("string")
    return plain, F.when(plain.isNull() & cipher.isNotNull(), F.lit("STORAGE_INTEGRITY_FAILED"))


def preview_key(analysis_id: Column, item_id: Column, page: Column) -> Column:
    """24-hex preview id from its parts."""
    return F.substring(F.sha2(F.concat_ws(":", analysis_id, item_id, page.cast("string")), 256), 1, 24)


def sorted_ids(*arrays: Sequence[str]) -> Column:
    """Sorted distinct union of id arrays."""
    out = F.col(arrays[0]) if isinstance(arrays[0], str) else arrays[0]
    for other in arrays[1:]:
        out = F.array_union(out, F.col(other) if isinstance(other, str) else other)
    return F.array_sort(F.array_distinct(out))
