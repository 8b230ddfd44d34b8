"""Queries over the document life cycle and the checks around model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.constants import HIDDEN_WARNINGS, RETRYABLE_ERRORS, ROUTING_ROLES
from pactlens.operators import lifecycle as lc
from pactlens.operators import modelio as mo
from pactlens.operators import retrieve, screen, summarize
from pactlens.packs.defaults import LATIN_RULES
from pactlens.plans import review
from pactlens.plans.queries_text import _CLAUSES, _R, _RULES
from pactlens.plans.tables import LATIN, documents, table, turns
from pactlens.sources import stored
from pactlens.sources.readers import job_stream, read_jsonl
from pactlens.sources.writers import export_results
from pactlens.streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

NOW = "1999-01-01 00:00:00"
AUDIT_NOW = "2025-01-10 00:00:00"


def query(sql: str | None = None):
    """Register a query under its function name, with its oracle when there is one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _time(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# ---- uploads, reads, views -----------------------------------------------------------------------


@query(r"""WITH p AS (SELECT page_id, html, page_id % 6 AS k FROM pages)
SELECT page_id, CASE WHEN k = 5 THEN 'UNSUPPORTED_TYPE' WHEN k = 4 THEN 'EMPTY_FILE' WHEN octet_length(encode(html)) > 20000 THEN 'FILE_TOO_LARGE' WHEN k = 1 THEN 'BAD_PDF_SIGNATURE' WHEN k = 2 THEN 'BAD_DOCX_SIGNATURE'
 WHEN k = 3 THEN 'MIME_MISMATCH' END AS error_code, sha256(CASE WHEN k = 4 THEN '' ELSE html END) AS sha256 FROM p""")
def validate_uploads(spark: SparkSession, sf: str) -> DataFrame:
    """Raw pages as uploads: extension, size, signature, type and encoding checks in order."""
    p = table(spark, sf, "pages").withColumn("k", F.col("page_id") % 6)
    k = F.col("k")
    name = F.concat(F.col("page_id").cast("string"), F.when(k == 1, ".PDF").when(k == 2, ".docx").when(k == 5, ".exe").otherwise(".txt"))
    mime = F.when(k == 3, "application/pdf").when(k == 0, "application/octet-stream").otherwise("")
    content = F.when(k == 4, F.lit("")).otherwise(F.col("html")).cast("binary")
    return p.select("page_id", lc.upload_error(name, mime, content, 20000).alias("error_code"), F.sha2(content, 256).alias("sha256"))


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as document rows; finished ones are tombstoned."""
    o = table(spark, sf, "orders")
    up = F.col("o_orderdate").cast("timestamp")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("masked_text"),
        up.alias("uploaded_at"), lc.expires_at(up).alias("expires_at"),
        F.when(F.col("o_orderstatus") == "F", up).alias("deleted_at"),
    )


@query("SELECT o_orderkey AS id, o_orderstatus AS status, strftime(o_orderdate + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S') AS expires_at FROM orders WHERE o_orderstatus = 'O'")
def live_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Live rows of one status; the predicates reach the scan."""
    e = lc.read_entities(_orders(spark, sf), status="O")
    return e.select("id", "status", _time("expires_at").alias("expires_at"))


@query(f"""SELECT o_orderkey AS id, o_orderstatus <> 'F' AND o_orderdate + INTERVAL 24 HOUR <= TIMESTAMP '{NOW}' AS expired_now,
 CASE WHEN o_orderstatus <> 'F' AND o_orderdate + INTERVAL 24 HOUR <= TIMESTAMP '{NOW}' THEN 'expired' ELSE o_orderstatus END AS status,
 CASE WHEN o_orderstatus <> 'F' AND o_orderdate + INTERVAL 24 HOUR <= TIMESTAMP '{NOW}' THEN NULL ELSE o_orderpriority END AS masked_text,
 CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN o_orderdate + INTERVAL 24 HOUR <= TIMESTAMP '{NOW}' THEN '{NOW}' END AS deleted_at FROM orders""")
def retention_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Documents after a retention pass."""
    e = lc.expire_documents(_orders(spark, sf), F.lit(NOW).cast("timestamp"))
    return e.select("id", "expired_now", "status", "masked_text", _time("deleted_at").alias("deleted_at"))


@query(f"""SELECT l_orderkey AS id, CAST(l_linenumber AS BIGINT) AS line, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_orderkey IN
 (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate + INTERVAL 24 HOUR <= TIMESTAMP '{NOW}') GROUP BY 1, 2""")
def cascade_children(spark: SparkSession, sf: str) -> DataFrame:
    """Child rows of the documents that expire."""
    e = lc.expire_documents(_orders(spark, sf), F.lit(NOW).cast("timestamp")).filter("expired_now")
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")  # noqa: E741
    c = lc.cascade_children(l, e, "l_orderkey", "id")
    return c.groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH due AS (SELECT o_orderkey, o_orderstatus <> 'F' AS fresh FROM orders WHERE o_orderstatus = 'F' OR o_orderdate + INTERVAL 24 HOUR <= TIMESTAMP '{NOW}')
SELECT 'document' AS kind, CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderkey AS VARCHAR) AS document_id, '{NOW}' AS deleted_at FROM due WHERE fresh
UNION ALL SELECT 'line', l_orderkey || ':' || l_linenumber || ':' || l_partkey, CAST(l_orderkey AS VARCHAR), '{NOW}' FROM lineitem JOIN due ON l_orderkey = o_orderkey""")
def retention_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that a pass takes away, with their children; children of documents that are gone already go as well."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    own = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey")
    out = lc.retention_cascade(_orders(spark, sf), {"line": (lines, "l_orderkey", own)}, F.lit(NOW).cast("timestamp"))
    return out.withColumn("deleted_at", _time("deleted_at"))


@query(f"SELECT event_type, CAST(count(*) AS BIGINT) AS kept FROM events WHERE ts >= TIMESTAMP '{AUDIT_NOW}' - INTERVAL 365 DAY GROUP BY event_type")
def audit_retention(spark: SparkSession, sf: str) -> DataFrame:
    """Audit rows inside the retention window."""
    e = lc.expire_audit(table(spark, sf, "events"), F.lit(AUDIT_NOW).cast("timestamp_ntz"), created="ts")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))


@query("SELECT event_id, event_type, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def audit_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred most recent audit events."""
    e = table(spark, sf, "events").select("event_id", "event_type", "user_id", "ts")
    return lc.audit_query(e, key="event_id", created="ts", document="user_id").select("event_id", "event_type", "user_id")


@query("""SELECT event_id, CASE WHEN json_exists(props, '$.k') THEN '{}' ELSE props END AS props, coalesce(json_exists(props, '$.k'), false) AS purged FROM events""")
def purge_text(spark: SparkSession, sf: str) -> DataFrame:
    """Remove a private field from JSON results; rows without it keep their exact bytes."""
    return lc.purge_field(table(spark, sf, "events").select("event_id", "props"), "props", "k")


@query("SELECT doc_id, lang AS visible, concat_ws(',', CASE WHEN n_chars % 2 = 0 THEN 'W_' || source END) AS warnings, false AS has_text FROM documents")
def public_view(spark: SparkSession, sf: str) -> DataFrame:
    """Results as shown outside: no document text, no internal warnings."""
    d = table(spark, sf, "documents")
    hidden = F.get(F.array(*[F.lit(w) for w in HIDDEN_WARNINGS]), (F.col("n_chars") % 4).cast("int"))
    extra = F.when(F.col("n_chars") % 2 == 0, F.array(F.concat(F.lit("W_"), F.col("source")))).otherwise(F.array().cast("array<string>"))
    r = d.select(
        "doc_id", F.struct(F.col("text").alias("masked_text"), F.col("lang").alias("visible")).alias("document"),
        F.concat(F.array(hidden), extra).alias("warnings"),
    )
    v = lc.public_view(r)
    return v.select(
        "doc_id", F.col("document.visible").alias("visible"), F.array_join("warnings", ",").alias("warnings"),
        F.lit("masked_text" in v.schema["document"].dataType.names).alias("has_text"),
    )


@query("""WITH r AS (SELECT l_orderkey AS a, l_orderkey * 10 + l_linenumber AS p FROM lineitem), live AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'),
rq AS (SELECT l_orderkey AS a, l_orderkey * 10 + l_linenumber + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS p FROM lineitem)
SELECT a AS analysis_id, p AS preview_id, CAST(count(*) AS BIGINT) AS n FROM rq WHERE (a, p) IN (SELECT a, p FROM r WHERE a IN (SELECT o_orderkey FROM live)) GROUP BY 1, 2""")
def owned_previews(spark: SparkSession, sf: str) -> DataFrame:
    """Preview requests that a live document's result owns."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")  # noqa: E741
    pid = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    results = l.select(
        F.col("l_orderkey").alias("analysis_id"), F.col("l_orderkey").alias("document_id"), F.array(pid).alias("preview_ids")
    )
    requests = l.select(F.col("l_orderkey").alias("analysis_id"), (pid + F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("preview_id"))
    live = lc.live(_orders(spark, sf)).select(F.col("id").alias("document_id"))
    o = lc.owned_previews(requests, results, live)
    return o.groupBy("analysis_id", "preview_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE event_type IN ('error', 'signup') END AS retryable FROM events")
def retryable_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Retry hint per error code; no code gives NULL."""
    e = table(spark, sf, "events").select("event_id", "event_type")
    t = F.col("event_type")
    code = F.when(t == "error", RETRYABLE_ERRORS[0]).when(t == "signup", RETRYABLE_ERRORS[3]).when(t != "view", "OTHER")
    return e.select("event_id", lc.retryable(code).alias("retryable"))


# ---- queue ---------------------------------------------------------------------------------------


def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as job attempts: about nine tenths fail, some of them for good."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("analysis_id"), "ts", F.col("event_id").alias("seq"),
        ((F.col("event_type") != "purchase") | (F.col("value") < 20)).alias("failed"), (F.col("value") < 90).alias("retryable"),
    )


_RETRY = """a AS (SELECT user_id AS id, ts, event_id AS s, event_type <> 'purchase' OR value < 20 AS f, value < 90 AS rt FROM events),
n AS (SELECT *, sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY ts, s) AS fc, row_number() OVER (PARTITION BY id ORDER BY ts, s) AS k FROM a),
e AS (SELECT id, min(k) FILTER (NOT f) AS ok, min(k) FILTER (f AND (NOT rt OR fc >= 3)) AS dead FROM n GROUP BY id),
g AS (SELECT n.id, CAST(count_if(f AND k <= coalesce(least(ok, dead), 999999999)) AS BIGINT) AS attempts, min(ok) AS ok, min(dead) AS dead FROM n JOIN e ON e.id = n.id GROUP BY n.id),
st AS (SELECT id, attempts, CASE WHEN ok IS NOT NULL AND (dead IS NULL OR ok < dead) THEN 'completed' WHEN dead IS NOT NULL THEN 'failed' ELSE 'queued' END AS state FROM g)"""


@query(f"WITH {_RETRY} SELECT id AS analysis_id, attempts, state, state = 'failed' AS dead_letter, CASE WHEN state = 'failed' THEN 'needs_review' END AS disposition FROM st")
def retry_states(spark: SparkSession, sf: str) -> DataFrame:
    """Final state of every job from its attempts."""
    r = lc.retry_plan(_attempts(spark, sf))
    return r.withColumn("attempts", F.col("attempts").cast("long"))


@query(f"WITH {_RETRY} SELECT CAST(count_if(state = 'queued') AS BIGINT) AS queue_depth, CAST(count_if(state = 'failed') AS BIGINT) AS dead_letter_depth FROM st")
def queue_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Pending and dead-letter depth."""
    return lc.queue_depths(lc.retry_plan(_attempts(spark, sf)))


_STATE_SQL = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'analyzing' WHEN 'click' THEN 'retrying' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"


@query(f"""WITH m AS (SELECT max(ts) AS m FROM events), l AS (SELECT user_id, arg_max({_STATE_SQL}, (ts, event_id)) AS s, max(ts) AS t FROM events GROUP BY 1)
SELECT user_id AS analysis_id, s AS state, CAST(CASE s WHEN 'analyzing' THEN 25 WHEN 'completed' THEN 100 WHEN 'failed' THEN 100 ELSE 0 END AS BIGINT) AS percent FROM l, m WHERE t >= m.m - INTERVAL 86400 SECOND""")
def progress_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Latest progress per job, unexpired at the time of the newest event."""
    e = table(spark, sf, "events")
    t = F.col("event_type")
    s = F.when(t == "signup", "queued").when(t == "view", "analyzing").when(t == "click", "retrying").when(t == "purchase", "completed").otherwise("failed")
    states = e.select(F.col("user_id").alias("analysis_id"), "ts", F.col("event_id").alias("seq"), s.alias("state"))
    now = e.agg(F.max("ts")).scalar()
    return lc.progress_latest(states, now, 86400).select("analysis_id", "state", F.col("percent").cast("long"))


@query("""WITH d AS (SELECT o_orderkey AS id, o_orderdate AS t, o_orderstatus AS s FROM orders), e AS (
SELECT id, 'document_uploaded' AS ty FROM d UNION ALL SELECT id, 'document_deleted' FROM d WHERE s = 'F' UNION ALL
SELECT l_orderkey, 'analysis_created' FROM lineitem UNION ALL SELECT l_orderkey, 'analysis_completed' FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT l_orderkey, 'analysis_failed' FROM lineitem WHERE l_linestatus <> 'F')
SELECT id AS document_id, ty AS event_type, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY 1, 2""")
def lifecycle_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Audit events of all visible transitions."""
    docs = _orders(spark, sf).withColumn("status", F.when(F.col("status") == "F", "deleted").otherwise("ready"))
    l = table(spark, sf, "lineitem")  # noqa: E741
    at = F.col("l_shipdate").cast("timestamp")
    runs = l.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").alias("document_id"),
        F.when(F.col("l_linestatus") == "F", "completed").otherwise("failed").alias("status"), at.alias("created_at"), at.alias("completed_at"),
    )
    return lc.lifecycle_audit(docs, runs).groupBy("document_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


# ---- stored results ------------------------------------------------------------------------------


@query("SELECT doc_id, '{\"lang\":\"' || lang || '\",\"n\":' || n_chars || ',\"warnings\":' || CASE WHEN n_chars % 2 = 0 THEN '[\"' || source || '\"]' ELSE '[]' END || '}' AS result_json, lang AS lang_back FROM documents")
def results_flat(spark: SparkSession, sf: str) -> DataFrame:
    """Typed results to JSON at the edge, and a field read back."""
    d = table(spark, sf, "documents").select(
        "doc_id", "lang", F.col("n_chars").alias("n"),
        F.when(F.col("n_chars") % 2 == 0, F.array("source")).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )
    return export_results(d, "doc_id").withColumn("lang_back", F.get_json_object("result_json", "$.lang"))


@query("SELECT page_id, sha256(html) AS plain_sha, CASE WHEN page_id % 5 = 0 THEN 'STORAGE_INTEGRITY_FAILED' END AS error_code FROM pages")
def encrypted_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Encrypt and decrypt every page; a wrong key gives an error code instead of text."""
    p = table(spark, sf, "pages").select("page_id", "html")
    key = F.lit("0123456789abcdef")
    c = p.withColumn("cipher", lc.encrypt(F.col("html"), key))
    wrong = F.when(F.col("page_id") % 5 == 0, F.lit("fedcba9876543210")).otherwise(key)
    plain, code = lc.decrypt(F.col("cipher"), wrong)
    return c.select("page_id", F.sha2(F.coalesce(plain, F.col("html")), 256).alias("plain_sha"), code.alias("error_code"))


@query(f"""WITH {_CLAUSES}, {_RULES}, f AS (SELECT doc_id, 'rule' AS kind, category FROM {_R}), c AS (SELECT doc_id, 'candidate' AS kind, lang AS category FROM documents WHERE n_chars % 2 = 0)
SELECT doc_id, kind, category, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM f UNION ALL SELECT * FROM c) GROUP BY ALL""")
def all_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Findings and candidates as one signal table."""
    d = documents(spark, sf)
    f = screen.screen(review.clauses_of(review.masked_documents(d, LATIN), LATIN), LATIN_RULES).select("doc_id", F.lit("rule").alias("kind"), "category", "rule_id")
    c = table(spark, sf, "documents").filter("n_chars % 2 = 0").select("doc_id", F.lit("candidate").alias("kind"), F.col("lang").alias("category"))
    return f.unionByName(c, allowMissingColumns=True).groupBy("doc_id", "kind", "category").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_CLAUSES}, {_RULES}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY clause_ord, rule_ord) AS fn FROM {_R}),
l AS (SELECT doc_id, fn, list_concat(list_concat(list_concat([label || ' · ' || rule_name], [category]), list_transform(list_zip(labels, hits), lambda z: z[1] || ': ' || z[2])),
 list_concat(list_transform(legal_basis, lambda b: b || ' · candidate_unverified'), [rule_id || ' / 1.0.0 · corpus not_available'])) AS c FROM f)
SELECT doc_id, CAST(fn AS BIGINT) AS finding_no, CAST(i - 1 AS BIGINT) AS line_no, c[i] AS content FROM l, unnest(range(1, len(c) + 1)) u(i)""")
def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Report lines of every finding, in order."""
    f = screen.screen(review.clauses_of(review.masked_documents(documents(spark, sf), LATIN), LATIN), LATIN_RULES)
    none = f.sparkSession.createDataFrame([], "doc_id bigint, clause_ord int, rank int, evidence_id string, title string, status string, manifest_version string")
    a = retrieve.attach_evidence(f, none, ["doc_id", "clause_ord"]).withColumn("summary_sentence", F.col("category"))
    r = summarize.report_rows(a)
    return r.select("doc_id", F.col("finding_no").cast("long"), F.col("line_no").cast("long"), "content")


# ---- model input and output ----------------------------------------------------------------------


@query("""WITH s AS (SELECT source, doc_id, length(text) AS n FROM documents), u AS (SELECT *, CASE WHEN n <= 12000 THEN n ELSE 0 END AS u FROM s),
r AS (SELECT *, coalesce(sum(u) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM u)
SELECT source, CAST(count_if(n <= 12000 AND b + n <= 12000) AS BIGINT) AS sent_clauses, CAST(sum(CASE WHEN n <= 12000 AND b + n <= 12000 THEN n ELSE 0 END) AS BIGINT) AS sent_chars,
 bool_or(NOT (n <= 12000 AND b + n <= 12000)) AS truncated FROM r GROUP BY source""")
def budget_batches(spark: SparkSession, sf: str) -> DataFrame:
    """What fits into one call per source, in page order."""
    d = table(spark, sf, "documents").select("source", F.col("doc_id").alias("clause_ord"), "text")
    return mo.batch_summary(mo.budget_batches(d, doc="source"), "source")


_EVID_IDS = "[CAST(event_id % 40 AS VARCHAR), CAST((event_id + 1) % 40 AS VARCHAR), CAST((event_id + 7) % 40 AS VARCHAR)]"


@query(f"""WITH a AS (SELECT event_id, CASE event_type WHEN 'signup' THEN [] WHEN 'click' THEN {_EVID_IDS}[1:2] WHEN 'view' THEN ['x'] ELSE {_EVID_IDS}[1:1] END AS cited, {_EVID_IDS} AS ids,
 [event_id % 3 <> 0, true, event_id % 2 = 0] AS good, CASE WHEN value > 80 THEN '이 조항은 무효이다' ELSE 'ok' END AS w FROM events),
i AS (SELECT event_id, concat_ws(',', CASE WHEN len(cited) = 0 OR len(list_filter(cited, lambda c: NOT list_contains(ids, c))) > 0 THEN 'INVALID_EVIDENCE_ID' END,
 CASE WHEN (list_contains(cited, ids[1]) AND NOT good[1]) OR (list_contains(cited, ids[3]) AND NOT good[3]) THEN 'UNVERIFIED_EVIDENCE' END, CASE WHEN contains(w, '무효이다') THEN 'LEGAL_CONCLUSION' END) AS issues FROM a)
SELECT event_id, issues, CASE WHEN issues = '' THEN 'passed' ELSE 'failed' END AS verification FROM i""")
def verify_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Citations of assessments against the evidence they were given."""
    e = table(spark, sf, "events")
    n = F.col("event_id")
    ids = [((n + k) % 40).cast("string") for k in (0, 1, 7)]
    good = [n % 3 != 0, F.lit(True), n % 2 == 0]
    evidence = F.array(*[
        F.struct(i.alias("evidence_id"), F.lit("").alias("status"), F.when(g, "source_verified").otherwise("draft").alias("review_status"))
        for i, g in zip(ids, good)
    ])
    t = F.col("event_type")
    cited = F.when(t == "signup", F.array().cast("array<string>")).when(t == "click", F.array(ids[0], ids[1])).when(t == "view", F.array(F.lit("x"))).otherwise(F.array(ids[0]))
    a = e.select("event_id", cited.alias("cited_ids"), evidence.alias("evidence"), F.when(F.col("value") > 80, "이 조항은 무효이다").otherwise("ok").alias("wording"))
    return mo.verify_citations(a).select("event_id", F.array_join("issues", ",").alias("issues"), "verification")


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'verified' WHEN event_type = 'click' THEN 'verified' WHEN event_type = 'error' THEN 'draft' ELSE 'unverified' END AS status FROM events")
def evidence_status(spark: SparkSession, sf: str) -> DataFrame:
    """Effective status of evidence items."""
    t = F.col("event_type")
    status = F.when(t == "view", "source_verified").when(t == "error", "draft").otherwise("")
    reviewed = F.when(t == "click", "verified").when(t == "signup", "")
    return table(spark, sf, "events").select("event_id", mo.evidence_status(status, reviewed).alias("status"))


_RULE_LIST = [r["id"] for r in LATIN_RULES.rules] + ["R99_UNKNOWN"]
_CATS = [r["category"] for r in LATIN_RULES.rules]
_RIDS = "[" + ", ".join(f"'{r}'" for r in _RULE_LIST) + "]"
_RCAT = "[" + ", ".join(f"'{c}'" for c in _CATS) + "]"


@query(f"""WITH o AS (SELECT conv_id, turn, turn * 10 + j AS seq, CASE WHEN j = 2 THEN turn + 5 ELSE turn - turn % 2 END AS sec, CAST((turn + j) % 7 + 1 AS BIGINT) AS ri,
 CASE j WHEN 0 THEN substr(text, 1, 20) WHEN 1 THEN '' WHEN 2 THEN substr(text, 5, 10) ELSE substr(text, 2, 1) END AS quote, CASE WHEN turn % 4 = 3 THEN '무효이다' ELSE 'ok' END AS w FROM conversations, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS j)),
c AS (SELECT o.*, {_RCAT}[ri] AS cat, t.text AS body FROM o LEFT JOIN conversations t ON t.conv_id = o.conv_id AND t.turn = o.sec),
k AS (SELECT *, CASE WHEN body IS NULL OR cat IS NULL THEN 'UNKNOWN_REFERENCE' WHEN sec % 3 = 0 AND cat = 'broad_scope' THEN 'ALREADY_COVERED' WHEN quote = '' THEN 'NO_QUOTE' WHEN NOT contains(body, quote) THEN 'QUOTE_NOT_FOUND' WHEN w <> 'ok' THEN 'LEGAL_CONCLUSION' END AS reason FROM c),
n AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY conv_id, sec, cat, reason IS NULL ORDER BY seq) END AS d FROM k),
m AS (SELECT *, CASE WHEN d = 1 THEN row_number() OVER (PARTITION BY conv_id, sec, coalesce(d, 0) = 1 ORDER BY seq) END AS p FROM n)
SELECT conv_id, CAST(seq AS BIGINT) AS seq, coalesce(p <= 2, false) AS accepted, CASE WHEN coalesce(p <= 2, false) THEN NULL ELSE coalesce(reason, 'DUPLICATE_OR_CAPPED') END AS reason FROM m""")
def context_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Model candidates per turn: grounded, not duplicated, capped per section."""
    t = turns(spark, sf)
    j = F.col("j")
    o = t.select("conv_id", "page_no", "text", F.explode(F.array(*[F.lit(i) for i in range(6)])).alias("j")).select(
        "conv_id", (F.col("page_no") * 10 + j).alias("seq"),
        F.concat(F.lit("turn:"), F.when(j == 2, F.col("page_no") + 5).otherwise(F.col("page_no") - F.col("page_no") % 2).cast("string")).alias("section_id"),
        F.get(F.array(*[F.lit(r) for r in _RULE_LIST]), ((F.col("page_no") + j) % 7).cast("int")).alias("rule_id"),
        F.when(j == 0, F.substring("text", 1, 20)).when(j == 1, "").when(j == 2, F.substring("text", 5, 10)).otherwise(F.substring("text", 2, 1)).alias("evidence_quote"),
        F.when(F.col("page_no") % 4 == 3, "무효이다").otherwise("ok").alias("wording"),
    )
    clauses = t.select("conv_id", F.concat(F.lit("turn:"), F.col("page_no").cast("string")).alias("section_id"), "text", F.col("page_no").alias("clause_ord"))
    excluded = t.filter("page_no % 3 = 0").select("conv_id", F.concat(F.lit("turn:"), F.col("page_no").cast("string")).alias("section_id"), F.lit("broad_scope").alias("category"))
    rules = screen.rules_table(spark, LATIN_RULES)
    v = mo.validate_context(o, clauses, rules, excluded, cap=2, doc="conv_id")
    return v.select("conv_id", "seq", "accepted", "reason")


_ROLES = [r for r, *_ in ROUTING_ROLES] + ["poet"]
_ROLE_SQL = "[" + ", ".join(f"'{r}'" for r in _ROLES) + "]"


@query(f"""WITH r AS (SELECT event_id, CAST(ts AS DATE) AS day, {_ROLE_SQL}[event_id % 6 + 1] AS role, CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE CASE WHEN value > 30 THEN 'extreme' ELSE 'high' END END AS risk,
 event_id % 3 AS fa, value > 5 AS cf, CAST(floor(value * 150) AS BIGINT) AS tk, CASE WHEN event_id % 50 = 0 THEN -1 ELSE 0 END AS db FROM events),
p AS (SELECT *, CASE role WHEN 'planner' THEN 3000 WHEN 'evidence_selector' THEN 5000 WHEN 'analyst' THEN 12000 WHEN 'verifier' THEN 6000 WHEN 'adjudicator' THEN 14000 END AS mi,
 CASE WHEN role = 'verifier' AND fa >= 1 THEN 'balanced' WHEN role = 'analyst' AND risk = 'high' AND cf THEN 'deep' WHEN role IN ('planner', 'evidence_selector', 'verifier') THEN 'fast' WHEN role = 'analyst' THEN 'balanced' WHEN role = 'adjudicator' THEN 'deep' END AS tier FROM r),
c AS (SELECT *, CASE WHEN mi IS NULL THEN 'UNKNOWN_ROLE' WHEN risk = 'extreme' THEN 'UNKNOWN_RISK_LEVEL' WHEN db < 0 THEN 'NEGATIVE_COUNTER' WHEN role = 'adjudicator' AND NOT (risk = 'high' AND cf) THEN 'ADJUDICATOR_NOT_ALLOWED' END AS rc FROM p),
d AS (SELECT *, CASE WHEN rc IS NULL AND tier = 'deep' AND tk <= mi THEN row_number() OVER (PARTITION BY day, rc IS NULL AND tier = 'deep' AND tk <= mi ORDER BY event_id) END AS nth FROM c),
z AS (SELECT *, CASE WHEN rc IS NOT NULL THEN rc WHEN tier = 'deep' AND tk <= mi AND nth > 20 THEN 'DEEP_LIMIT_REACHED' WHEN tk > mi THEN 'INPUT_BUDGET_EXCEEDED' END AS code FROM d)
SELECT event_id AS request_id, CASE WHEN code IS NULL THEN tier END AS tier, CASE WHEN code IS NULL THEN CASE tier WHEN 'fast' THEN 700 WHEN 'balanced' THEN 1600 ELSE 2400 END END::BIGINT AS max_output_tokens,
 CASE WHEN code IS NULL THEN CASE WHEN role = 'verifier' AND fa >= 1 THEN 'verification retry escalation' WHEN role = 'analyst' AND tier = 'deep' THEN 'high-risk analysis with conflicting evidence' ELSE 'role default' END END AS reason, code AS rejected_code FROM z""")
def routing(spark: SparkSession, sf: str) -> DataFrame:
    """Model tier and budgets of every request, or why it was refused."""
    e = table(spark, sf, "events")
    n = F.col("event_id")
    risk = F.when(n % 4 == 0, "high").when(n % 4 == 1, "medium").when(n % 4 == 2, "low").otherwise(F.when(F.col("value") > 30, "extreme").otherwise("high"))
    r = e.select(
        n.alias("request_id"), F.to_date("ts").alias("day"), n.alias("seq"),
        F.get(F.array(*[F.lit(x) for x in _ROLES]), (n % 6).cast("int")).alias("role"), risk.alias("risk_level"),
        (n % 3).alias("failed_attempts"), (F.col("value") > 5).alias("conflicting"), F.floor(F.col("value") * 150).alias("input_tokens"),
        F.when(n % 50 == 0, -1).otherwise(0).alias("deep_before"),
    )
    out = mo.route_requests(r, mo.routing_policy(spark))
    return out.select("request_id", "tier", F.col("max_output_tokens").cast("long"), "reason", "rejected_code")


@query("""WITH o AS (SELECT conv_id, turn, length(text) AS n, turn % 7 AS k, role FROM conversations)
SELECT conv_id, turn, k IN (0, 6) AND n <= 1000 AS valid, CASE WHEN k IN (0, 6) AND n <= 1000 THEN NULL ELSE 'LLM_SCHEMA_INVALID' END AS error_code FROM o""")
def model_output_schema(spark: SparkSession, sf: str) -> DataFrame:
    """Model outputs as JSON text against the closed assessment schema."""
    c = table(spark, sf, "conversations")
    k = F.col("turn") % 7
    ids = F.array(F.lit("e1"))
    body = F.struct(
        F.when(k == 1, "severe").otherwise("medium").alias("risk_level"), F.when(k != 2, "unknown").alias("applicability"),
        F.col("text").alias("summary"), F.lit("because").alias("rationale"),
        F.when(k == 3, F.array_repeat(F.lit("x"), 11)).otherwise(ids).alias("counter_considerations"), ids.alias("review_questions"),
        F.when(k == 4, F.array().cast("array<string>")).otherwise(ids).alias("cited_evidence_ids"), F.when(k == 5, "y").alias("note"),
    )
    v = mo.validate_assessment(c.select("conv_id", "turn", F.to_json(body).alias("output")))
    return v.select("conv_id", "turn", "valid", "error_code")


# ---- files and streams ---------------------------------------------------------------------------


@query("SELECT doc_id, lang, sha256(text) AS sha256, n_chars FROM documents")
def jsonl_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as JSON lines and read back with their schema."""
    path = stored.shared_folder(spark, "jsonl")
    table(spark, sf, "documents").select("doc_id", "lang", "text", "n_chars").write.json(path)
    rows = read_jsonl(spark, path, "doc_id long, lang string, text string, n_chars long")
    return rows.select("doc_id", "lang", F.sha2("text", 256).alias("sha256"), "n_chars")


@query("""WITH l AS (SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1)
SELECT CAST(o_orderkey AS VARCHAR) AS analysis_id, CASE WHEN c_custkey IS NULL OR c_acctbal < 0 THEN 'failed' ELSE 'completed' END AS status,
 CASE WHEN c_custkey IS NULL OR c_acctbal < 0 THEN 'DOCUMENT_NOT_FOUND' END AS error_code, CASE WHEN c_acctbal >= 0 THEN coalesce(n, 0) END AS findings
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN l ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F'""")
def processed_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Every order queued twice and worked off as a stream: finished ones are ignored, those of customers in debt have lost their document."""
    folder, orders = stored.shared_folder(spark, "jobs"), table(spark, sf, "orders")
    queued = orders.select(F.col("o_orderkey").cast("string").alias("analysis_id"), F.lit(NOW).cast("timestamp").alias("ts"))
    queued.unionByName(queued).write.json(f"{folder}/queue")

    def load() -> tuple[DataFrame, DataFrame]:
        status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("queued").alias("status")
        analyses = orders.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").alias("document_id"), status)
        gone = F.when(F.col("c_acctbal") < 0, F.lit(NOW).cast("timestamp")).alias("deleted_at")
        return analyses, table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), gone)

    def count_lines(ids: DataFrame) -> DataFrame:
        n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("analysis_id")).agg(F.count(F.lit(1)).alias("n"))
        return ids.join(n, "analysis_id", "left").select("analysis_id", "document_id", F.coalesce("n", F.lit(0)).alias("findings"))

    jobs.use_rocksdb(spark)
    stream = jobs.dedupe_jobs(job_stream(spark, f"{folder}/queue"))
    jobs.process_jobs(stream, load, count_lines, f"{folder}/results", f"{folder}/checkpoint").awaitTermination()
    out = spark.read.schema("analysis_id string, status string, error_code string, findings long").parquet(f"{folder}/results")
    return out.select("analysis_id", "status", "error_code", "findings")


@query("""WITH now AS (SELECT max(ts) AS t FROM events),
due AS (SELECT o_orderkey, o_orderstatus <> 'F' AS fresh FROM orders, now WHERE o_orderstatus = 'F' OR o_orderdate + INTERVAL 24 HOUR <= t)
SELECT 'document' AS kind, CAST(o_orderkey AS VARCHAR) AS id FROM due WHERE fresh
UNION ALL SELECT 'line', l_orderkey || ':' || l_linenumber || ':' || l_partkey FROM lineitem JOIN due ON l_orderkey = o_orderkey""")
def retention_job(spark: SparkSession, sf: str) -> DataFrame:
    """The retention stream, whose ticks are the last event of each type: documents and children that it has taken away."""
    folder = stored.shared_folder(spark, "retention")
    table(spark, sf, "events").groupBy("event_type").agg(F.max("ts").alias("ts")).select("ts").write.json(f"{folder}/ticks")
    own = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey")

    def load() -> tuple[DataFrame, dict]:
        lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
        return _orders(spark, sf), {"line": (lines, "l_orderkey", own)}

    ticks = job_stream(spark, f"{folder}/ticks", "ts timestamp")
    jobs.start_retention(ticks, load, f"{folder}/gone", f"{folder}/checkpoint").awaitTermination()
    return jobs.retention_deletions(spark, f"{folder}/gone").select("kind", "id")
