"""Queries over quality metrics, agreement, calibration and ingestion gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.constants import COLLECTIONS
from pactlens.operators import evaluate as ev
from pactlens.operators import ingest, lifecycle
from pactlens.operators.prefix import top_rows
from pactlens.plans.tables import table
from pactlens.sources import stored
from pactlens.sources.writers import with_run_meta

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with its oracle when there is one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# ---- rule metrics: a labelled document is a case, its source the label ------------------------


def _confusion(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source")
    j = table(spark, sf, "labels").join(d, "doc_id").select(F.col("doc_id").alias("case_id"), F.col("source").alias("label"), "quality", "toxic")
    labels = d.select(F.col("source").alias("label")).distinct()
    return ev.confusion(j.filter("quality = 1"), j.filter("toxic = 1"), j, labels)


_CONF = """j AS (SELECT l.doc_id, d.source AS label, quality, toxic FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
c AS (SELECT s.label, count_if(quality = 1 AND toxic = 1) AS tp, count_if(quality = 0 AND toxic = 1) AS fp, count_if(quality = 1 AND toxic = 0) AS fn
 FROM (SELECT DISTINCT source AS label FROM documents) s LEFT JOIN j ON j.label = s.label GROUP BY s.label),
m AS (SELECT *, (SELECT count(*) FROM j) - tp - fp - fn AS tn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM c)"""


@query(f"""WITH {_CONF} SELECT label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
 round(p, 4) AS "precision", round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM m""")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    """Confusion counts and scores per label."""
    return ev.prf(_confusion(spark, sf)).select("label", "tp", "fp", "fn", "tn", "precision", "recall", "f1")


@query(f"""WITH {_CONF} SELECT round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS macro_f1, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1 FROM m""")
def macro_micro(spark: SparkSession, sf: str) -> DataFrame:
    """Macro and micro F1 over the labels."""
    return ev.macro_micro(_confusion(spark, sf))


@query(f"""WITH {_CONF} SELECT label, CAST(tp AS BIGINT) AS tp, 'nightly' AS run_id, '1.0.0' AS ruleset_version, 'unknown' AS provider FROM m""")
def metrics_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Metric rows stamped with run metadata, without case text."""
    m = with_run_meta(_confusion(spark, sf), {"run_id": "nightly", "ruleset_version": "1.0.0"})
    return m.select("label", "tp", "run_id", "ruleset_version", "provider")


# ---- policy metrics ---------------------------------------------------------------------------


def _policy(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    j = table(spark, sf, "labels").join(d, "doc_id")
    none = F.array().cast("array<string>")

    def when(cond, *items):
        return F.when(cond, F.array(*items)).otherwise(none)

    return ev.policy_sections(j.select(
        "doc_id",
        (F.col("n_chars") % 5 != 0).alias("evaluated"),
        when(F.col("quality") == 1, F.col("lang")).alias("required"),
        when(F.col("n_chars") % 2 == 0, F.col("source")).alias("allowed"),
        F.array(F.lit("de"), F.lit("src3")).alias("forbidden"),
        F.concat(when(F.col("n_chars") > 900, F.col("lang")), when(F.col("toxic") == 1, F.col("source"))).alias("actual"),
        F.concat(when(F.col("n_chars") % 3 == 0, F.col("source")), when(F.col("n_chars") % 4 == 0, F.col("lang"))).alias("candidates"),
        when(F.col("n_chars") % 6 == 0, F.col("source")).alias("expected_candidates"),
        when(F.col("n_chars") % 8 == 0, F.col("lang")).alias("allowed_candidates"),
        F.concat(when(F.col("n_chars") % 3 == 0, F.col("source")), when(F.col("n_chars") % 4 == 0, F.col("lang"))).alias("candidate_rules"),
    ))


def _has(x: str, arr: str) -> str:
    return f"list_contains({arr}, {x})"


def _minus(a: str, *bs: str) -> str:
    return f"list_filter({a}, lambda x: NOT (" + " OR ".join(_has("x", b) for b in bs) + "))"


def _meet(a: str, b: str) -> str:
    return f"list_filter({a}, lambda x: {_has('x', b)})"


_POL = f"""s AS (SELECT l.doc_id, n_chars % 5 <> 0 AS evaluated, CASE WHEN quality = 1 THEN [lang] ELSE [] END AS req, CASE WHEN n_chars % 2 = 0 THEN [source] ELSE [] END AS alw, ['de', 'src3'] AS ban,
 list_concat(CASE WHEN n_chars > 900 THEN [lang] ELSE [] END, CASE WHEN toxic = 1 THEN [source] ELSE [] END) AS act,
 list_concat(CASE WHEN n_chars % 3 = 0 THEN [source] ELSE [] END, CASE WHEN n_chars % 4 = 0 THEN [lang] ELSE [] END) AS can,
 CASE WHEN n_chars % 6 = 0 THEN [source] ELSE [] END AS exc, CASE WHEN n_chars % 8 = 0 THEN [lang] ELSE [] END AS alc FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
k AS (SELECT *, list_distinct(list_concat(act, can)) AS com FROM s),
x AS (SELECT *, {_minus('req', 'act')} AS missing, {_minus('act', 'req', 'alw')} AS unexpected, {_meet('act', 'ban')} AS hits, {_minus('com', 'req', 'alw')} AS cu, {_meet('com', 'ban')} AS ch,
 len({_meet('req', 'act')}) AS rule_tp, len({_minus('req', 'act')}) AS rule_fn, len(list_distinct(list_concat({_minus('act', 'req', 'alw')}, {_meet('act', 'ban')}))) AS rule_fp,
 len({_meet('exc', 'can')}) AS candidate_tp, len({_minus('exc', 'can')}) AS candidate_fn, len({_minus('can', 'exc', 'alc')}) AS candidate_fp,
 len({_meet('req', 'com')}) AS combined_tp, len({_minus('req', 'com')}) AS combined_fn, len(list_distinct(list_concat({_minus('com', 'req', 'alw')}, {_meet('com', 'ban')}))) AS combined_fp FROM k)"""


def _prf_sql(digits: int = 6) -> str:
    p, r = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END", "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END"
    return (
        f'round({p}, {digits}) AS "precision", round({r}, {digits}) AS recall, '
        f"round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, {digits}) AS f1"
    )


_COUNTS = "CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn"


@query(f"WITH {_POL}, t AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS family, sum({f}_tp) AS tp, sum({f}_fp) AS fp, sum({f}_fn) AS fn FROM x" for f in ("rule", "candidate", "combined")
) + f") SELECT family, {_COUNTS}, {_prf_sql()} FROM t")
def policy_prf(spark: SparkSession, sf: str) -> DataFrame:
    """Micro totals of the three metric families."""
    return ev.policy_totals(_policy(spark, sf))


@query(f"""WITH {_POL}, r AS (SELECT *, unnest(list_distinct(list_concat(list_concat(req, act), ban))) AS label FROM x),
t AS (SELECT label, count_if({_has('label', 'req')} AND {_has('label', 'act')}) AS tp,
 count_if(NOT {_has('label', 'req')} AND {_has('label', 'act')} AND ({_has('label', 'ban')} OR NOT {_has('label', 'alw')})) AS fp,
 count_if({_has('label', 'req')} AND NOT {_has('label', 'act')}) AS fn FROM r GROUP BY label)
SELECT label, {_COUNTS}, {_prf_sql()} FROM t""")
def policy_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Policy metrics per rule."""
    return ev.policy_labels(_policy(spark, sf))


@query(f"""WITH {_POL} SELECT CAST(sum(CASE WHEN evaluated AND len(req) = 0 AND len(exc) = 0 THEN combined_fp ELSE 0 END) AS BIGINT) AS normal_clause_fp,
 round(count_if(evaluated AND len(com) > 0 AND len({_meet('act', 'can')}) > 0) / count_if(evaluated AND len(com) > 0), 6) AS duplicate_signal_rate,
 bool_and(CASE WHEN evaluated THEN len(missing) = 0 AND len(unexpected) = 0 AND len(hits) = 0 END) AS passed,
 bool_and(CASE WHEN evaluated THEN combined_fn = 0 AND combined_fp = 0 END) AS combined_passed FROM x""")
def policy_flags(spark: SparkSession, sf: str) -> DataFrame:
    """False positives on normal clauses, duplicate signals, pass flags."""
    return ev.policy_flags(_policy(spark, sf))


@query(f"""WITH {_POL} SELECT doc_id, array_to_string(list_sort(missing), ',') AS missing, array_to_string(list_sort(unexpected), ',') AS unexpected,
 array_to_string(list_sort(hits), ',') AS forbidden_hits, array_to_string(list_sort(com), ',') AS combined FROM x""")
def sorted_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted set differences and unions per section."""
    p = _policy(spark, sf)
    names = ["missing", "unexpected", "forbidden_hits", "combined"]
    return p.select("doc_id", *[F.array_join(lifecycle.sorted_ids(n), ",").alias(n) for n in names])


# ---- agreement, calibration, stability ----------------------------------------------------------


def _ratings(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "labels")  # noqa: E741
    a = F.when(F.col("quality") == 1, "high").otherwise("low")
    b = F.when((F.col("toxic") == 1) & (F.col("quality") == 1), "medium").when(F.col("toxic") == 1, "none").otherwise(a)
    both = F.array(F.struct(F.lit("a").alias("reviewer_id"), a.alias("risk_level")), F.struct(F.lit("b").alias("reviewer_id"), b.alias("risk_level")))
    return l.select(F.col("doc_id").alias("case_id"), F.inline(both))


_RATE = """r AS (SELECT doc_id AS case_id, 'a' AS reviewer_id, CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS lv FROM labels
 UNION ALL SELECT doc_id, 'b', CASE WHEN toxic = 1 AND quality = 1 THEN 'medium' WHEN toxic = 1 THEN 'none' WHEN quality = 1 THEN 'high' ELSE 'low' END FROM labels)"""


@query(f"""WITH {_RATE}, c AS (SELECT case_id, lv, count(*) AS c FROM r GROUP BY 1, 2), p AS (SELECT case_id, sum(c) AS n, sum(c * (c - 1)) AS ag, count(*) AS kinds FROM c GROUP BY 1),
e AS (SELECT sum(pow(n / (SELECT count(*) FROM r), 2)) AS e FROM (SELECT lv, count(*) AS n FROM r GROUP BY 1)),
t AS (SELECT count(*) AS cc, max(n) AS rc, sum(n) AS an, avg(CASE WHEN kinds = 1 THEN 1.0::DOUBLE ELSE 0 END) AS ex, avg(ag / (n * (n - 1))) AS ob FROM p)
SELECT CAST(cc AS BIGINT) AS case_count, CAST(rc AS BIGINT) AS reviewer_count_per_case, CAST(an AS BIGINT) AS annotation_count, round(ex, 6) AS exact_agreement_rate,
 round(ob, 6) AS observed_pair_agreement, round(e, 6) AS expected_pair_agreement, round(CASE WHEN e = 1 THEN 1 ELSE (ob - e) / (1 - e) END, 6) AS fleiss_kappa FROM t, e""")
def kappa(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement of two raters."""
    return ev.fleiss_kappa(_ratings(spark, sf))


@query(f"WITH {_RATE} SELECT case_id, reviewer_id, lv AS risk_level FROM r WHERE case_id IN (SELECT case_id FROM r GROUP BY 1 HAVING count(DISTINCT lv) > 1)")
def disagreements(spark: SparkSession, sf: str) -> DataFrame:
    """Judgments of the cases raters disagree on."""
    return ev.disagreements(_ratings(spark, sf))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.round(F.col("value") / (F.col("value") + 25), 6).alias("score"),
        ((F.col("value") > 60) | ((F.col("event_type") == "purchase") & (F.col("value") > 20))).alias("positive"),
    )


_CAL = """s AS (SELECT round(value / (value + 25), 6) AS score, value > 60 OR (event_type = 'purchase' AND value > 20) AS pos FROM events),
g AS (SELECT score, count_if(pos) AS p, count_if(NOT pos) AS n FROM s GROUP BY 1),
c AS (SELECT score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, (SELECT sum(p) FROM g) AS ap FROM g WINDOW w AS (ORDER BY score DESC)),
m AS (SELECT score, tp / (tp + fp) AS pr, CASE WHEN ap > 0 THEN tp / ap ELSE 0 END AS re, CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / ap) / (tp / (tp + fp) + tp / ap) ELSE 0 END AS f FROM c)"""


@query(f"""WITH {_CAL} SELECT coalesce((SELECT score FROM m WHERE pr >= 0.75 ORDER BY f DESC, score DESC LIMIT 1), 0.72) AS threshold, coalesce(round((SELECT max(f) FROM m WHERE pr >= 0.75), 6), 0) AS f1,
 round((SELECT pr FROM m WHERE pr >= 0.75 ORDER BY f DESC, score DESC LIMIT 1), 6) AS "precision", round((SELECT re FROM m WHERE pr >= 0.75 ORDER BY f DESC, score DESC LIMIT 1), 6) AS recall""")
def calibrate(spark: SparkSession, sf: str) -> DataFrame:
    """Threshold with the best F1 above the precision floor."""
    return ev.calibrate_threshold(_scores(spark, sf))


@query(f"""WITH {_CAL} SELECT score AS threshold, round(pr, 6) AS "precision", round(re, 6) AS recall, round(f, 6) AS f1 FROM m""")
def threshold_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Precision, recall and F1 at every score."""
    c = ev.threshold_curve(_scores(spark, sf))
    return c.select("threshold", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


@query("""WITH j AS (SELECT d.source, d.lang, d.doc_id, quality, toxic FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
f AS (SELECT source, count_if(quality = 1 AND toxic = 0) AS b, count_if(quality = 1 OR toxic = 0) AS a FROM j GROUP BY 1)
SELECT source, round(b / a, 6) AS jaccard, round(1 - b / a, 6) AS churn, a = b AS exact FROM f WHERE a > 0""")
def stability(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap of two runs per document group."""
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    j = table(spark, sf, "labels").join(d, "doc_id").withColumn("section_id", F.col("lang")).withColumn("rule_id", F.col("doc_id").cast("string"))
    return ev.run_stability(j.filter("quality = 1"), j.filter("toxic = 0"), "source")


@query("""SELECT source, round(coalesce(avg(CASE WHEN quality = 1 AND toxic = 1 THEN 0.5::DOUBLE WHEN quality = 1 THEN 1 WHEN toxic = 0 THEN 0 END), 0) * 100, 4) AS score,
 CAST(count_if(quality = 0 AND toxic = 1) AS BIGINT) AS fp FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY source""")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage score per document group."""
    d = table(spark, sf, "documents").select("doc_id", "source")
    q, t = F.col("quality"), F.col("toxic")
    outcome = F.when((q == 1) & (t == 1), "PARTIAL").when(q == 1, "FULL").when(t == 0, "MISS").otherwise("FP")
    return ev.coverage_score(table(spark, sf, "labels").join(d, "doc_id").withColumn("outcome", outcome), "source")


# ---- ingestion gates ----------------------------------------------------------------------------


@query("""WITH j AS (SELECT doc_id, n_chars % 6 AS k, n_chars % 4 AS s FROM documents)
SELECT doc_id, CASE k WHEN 1 THEN 'datasets.0.invalid:raw_count' WHEN 2 THEN 'datasets.0.missing:license_basis' WHEN 3 THEN 'extra:owner' WHEN 4 THEN 'datasets.0.invalid:corpus_type,invalid:cutoff_date'
  WHEN 5 THEN 'datasets.0.extra:note,missing:generated_at' ELSE CASE WHEN s = 0 THEN '' ELSE 'not_verified' END END AS violations, k = 0 AND s = 0 AS accepted FROM j""")
def manifest_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Provenance manifests built from document rows, checked against the closed contract."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", (F.col("n_chars") % 6).alias("k"))
    k = F.col("k")
    dataset = F.struct(
        F.concat(F.lit("ds-"), F.col("source")).alias("dataset_id"),
        F.when(k == 4, "blogs").otherwise("statutes").alias("corpus_type"),
        F.col("source").alias("source_name"), F.lit("https://example.org/a").alias("source_url"), F.col("lang").alias("authority"),
        F.lit("download").alias("collection_method"), F.array(F.lit("a")).alias("inclusion_criteria"), F.array().cast("array<string>").alias("exclusion_criteria"),
        F.when(k == 1, -1).otherwise(F.col("n_chars")).alias("raw_count"), F.lit(1).alias("deduplicated_count"), F.lit(1).alias("accepted_count"),
        F.lit(0).alias("rejected_count"), F.lit("document_id:chunk_id").alias("deduplication_key"), F.lit("approved").alias("license_status"),
        F.when(k != 2, "public").alias("license_basis"), F.lit("https://example.org/l").alias("license_basis_url"), F.lit(True).alias("redistribution_allowed"),
        F.lit("verified").alias("review_status"), F.when(k == 5, "x").alias("note"),
    )
    body = F.struct(
        F.concat(F.lit("v"), F.col("source")).alias("manifest_version"),
        F.when(k != 5, "2026-08-31T00:00:00+09:00").alias("generated_at"),
        F.when(k == 4, "2026-13-01").otherwise("2026-08-31").alias("cutoff_date"),
        F.when(F.col("n_chars") % 4 == 0, "verified").otherwise("reviewing").alias("status"),
        F.when(k == 3, "someone").alias("owner"),
        F.array(dataset).alias("datasets"),
    )
    g = ingest.gate_manifest(d.select("doc_id", F.to_json(body).alias("manifest")), "doc_id")
    return g.select("doc_id", F.array_join("violations", ",").alias("violations"), "accepted")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as corpus records, some of them defective."""
    d = table(spark, sf, "documents")
    kinds = F.array(*[F.lit(c) for c in [*COLLECTIONS, "blogs"]])
    n = F.col("n_chars")
    return d.select(
        F.col("doc_id"), F.col("source").alias("document_id"), F.col("doc_id").cast("string").alias("chunk_id"),
        F.get(kinds, (n % 6).cast("int")).alias("corpus_type"), F.when(n % 11 != 0, F.col("lang")).alias("title"),
        F.lit("office").alias("authority"), F.when(n % 13 != 0, "https://example.org").alias("source_url"),
        F.when(n % 5 == 0, F.lit("sha256:0")).otherwise(ingest.source_hash(F.col("text"))).alias("source_hash"),
        F.col("lang").alias("language"), F.col("source").alias("section"),
        F.when(n % 7 == 0, "v0").otherwise("v1").alias("manifest_version"), F.lit("verified").alias("review_status"),
        F.when(n % 3 == 0, (n % 10) / 10).alias("authority_weight"), "text",
    )


@query("""SELECT doc_id, concat_ws(';', CASE WHEN n_chars % 11 = 0 AND n_chars % 13 = 0 THEN 'missing:source_url,title' WHEN n_chars % 11 = 0 THEN 'missing:title' WHEN n_chars % 13 = 0 THEN 'missing:source_url' END,
 CASE WHEN n_chars % 6 = 5 THEN 'unknown_corpus_type' END, CASE WHEN n_chars % 7 = 0 THEN 'version_mismatch' END) AS violations,
 NOT (n_chars % 11 = 0 OR n_chars % 13 = 0 OR n_chars % 6 = 5 OR n_chars % 7 = 0) AS accepted FROM documents""")
def record_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus records against the manifest."""
    g = ingest.gate_records(_records(spark, sf), F.lit("v1"))
    return g.select("doc_id", F.array_join("violations", ";").alias("violations"), "accepted")


@query("""WITH r AS (SELECT ['statutes','ftc_decisions','court_decisions','dispute_cases','clause_patterns','blogs'][n_chars % 6 + 1] AS t, n_chars % 5 = 0 AS bad, n_chars FROM documents)
SELECT t AS corpus_type, CAST(count(*) - count_if(n_chars % 100 = 0) AS BIGINT) AS accepted_count, CAST(count(*) AS BIGINT) AS record_count, CAST(count_if(bad) AS BIGINT) AS hash_mismatches,
 count_if(n_chars % 100 = 0) = 0 AND count_if(bad) = 0 AS reconciled FROM r GROUP BY t""")
def hash_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Record counts and content hashes against the manifest."""
    r = _records(spark, sf)
    n = table(spark, sf, "documents").select("doc_id", "n_chars")
    counts = r.join(n, "doc_id").groupBy("corpus_type").agg(F.count_if(F.col("n_chars") % 100 != 0).alias("accepted_count"))
    return ingest.hash_reconcile(r, counts)


@query("""WITH inc AS (SELECT doc_id, source || ':' || (doc_id // 2) AS id, CASE WHEN doc_id % 4 < 2 AND n_chars % 3 = 0 THEN 0.9 ELSE 0.5 END AS w, lang, text, n_chars FROM documents WHERE n_chars % 5 <> 0),
nw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id DESC) AS r FROM inc) WHERE r = 1),
old AS (SELECT DISTINCT source || ':' || (doc_id // 2) AS id FROM documents WHERE n_chars % 7 <> 0),
oh AS (SELECT * FROM (SELECT source || ':' || (doc_id // 2) AS id, text, lang, row_number() OVER (PARTITION BY source || ':' || (doc_id // 2) ORDER BY doc_id DESC) AS r FROM documents WHERE n_chars % 7 <> 0) WHERE r = 1)
SELECT nw.id AS stable_id, CASE WHEN oh.id IS NULL THEN 'add' WHEN nw.text = oh.text AND nw.lang = oh.lang AND nw.w = 0.5 THEN 'skip' ELSE 'update' END AS action FROM nw LEFT JOIN oh ON oh.id = nw.id""")
def upsert_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Add, update or skip per chunk; two rows may share an id and the last one wins."""
    d = table(spark, sf, "documents").select(
        "doc_id", ingest.stable_id(F.col("source"), F.floor(F.col("doc_id") / 2).cast("string")).alias("stable_id"),
        F.col("lang").alias("language"), ingest.source_hash(F.col("text")).alias("source_hash"), "n_chars",
    )
    incoming = d.filter("n_chars % 5 <> 0").withColumn(
        "authority_weight", F.when((F.col("doc_id") % 4 < 2) & (F.col("n_chars") % 3 == 0), 0.9)
    )
    existing = top_rows(d.filter("n_chars % 7 <> 0"), ["stable_id"], [F.col("doc_id").desc()], 1, "_r").drop("_r").withColumn("authority_weight", F.lit(0.5))
    return ingest.upsert_plan(existing, incoming, ["language"], "doc_id").select("stable_id", "action")


@query("""WITH a AS (SELECT doc_id AS id, n_chars % 3 AS v FROM documents WHERE n_chars % 4 <> 0), b AS (SELECT doc_id AS id, n_chars % 2 AS v FROM documents WHERE n_chars % 5 <> 0)
SELECT coalesce(a.id, b.id) AS card_id, CASE WHEN b.id IS NULL THEN 'delete' WHEN a.id IS NULL THEN 'add' WHEN a.v = b.v THEN 'skip' ELSE 'update' END AS action FROM a FULL JOIN b ON a.id = b.id""")
def card_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Stale, missing and version-changed cards."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("card_id"), "n_chars")
    old = d.filter("n_chars % 4 <> 0").withColumn("card_version", F.col("n_chars") % 3)
    new = d.filter("n_chars % 5 <> 0").withColumn("card_version", F.col("n_chars") % 2)
    return ingest.sync_cards(old, new)


@query("""WITH d AS (SELECT *, CASE WHEN n_chars % 10 = 0 THEN doc_id - 1 ELSE doc_id END AS cid FROM documents),
u AS (SELECT cid, count(*) AS c FROM d GROUP BY 1)
SELECT d.doc_id, concat_ws(';', CASE WHEN c > 1 THEN 'duplicate_id' END, CASE WHEN n_chars % 9 = 0 THEN 'missing:title' END, CASE WHEN n_chars % 4 = 3 THEN 'unknown_polarity' END, CASE WHEN n_chars % 8 = 0 THEN 'unverified' END) AS violations,
 NOT (c > 1 OR n_chars % 9 = 0 OR n_chars % 4 = 3 OR n_chars % 8 = 0) AS accepted FROM d JOIN u ON u.cid = d.cid""")
def card_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Decision-card records against their contract."""
    d = table(spark, sf, "documents")
    n = F.col("n_chars")
    cards = d.select(
        "doc_id", F.when(n % 10 == 0, F.col("doc_id") - 1).otherwise(F.col("doc_id")).cast("string").alias("card_id"),
        F.col("source").alias("rule_id"), F.when(n % 4 == 3, "other").when(n % 2 == 0, "risk_pattern").otherwise("safe_exception").alias("polarity"),
        F.when(n % 9 != 0, F.col("lang")).alias("title"), F.lit("synthetic").alias("source_class"),
        F.when(n % 8 == 0, "draft").otherwise("synthetic_verified").alias("review_status"), F.lit("dev").alias("evaluation_split"),
        F.array(F.lit("p")).alias("factor_groups"), "text",
    )
    g = ingest.gate_cards(cards)
    return g.select("doc_id", F.array_join("violations", ";").alias("violations"), "accepted")


@query("""WITH a AS (SELECT doc_id, 'a' AS rv, 'low' AS lv, true AS bl FROM labels UNION ALL
 SELECT CASE WHEN doc_id % 9 = 0 THEN doc_id ELSE doc_id END, CASE WHEN doc_id % 9 = 0 THEN 'a' ELSE 'b' END, CASE WHEN quality = 0 THEN 'severe' ELSE 'high' END, toxic = 0 FROM labels)
SELECT doc_id AS case_id, rv AS reviewer_id, lv AS risk_level, concat_ws(';', CASE WHEN lv = 'severe' THEN 'unknown_level' END, CASE WHEN NOT bl THEN 'not_blinded' END, CASE WHEN doc_id % 9 = 0 THEN 'duplicate_pair' END) AS violations,
 NOT (lv = 'severe' OR NOT bl OR doc_id % 9 = 0) AS accepted FROM a""")
def annotation_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Blinded judgments against their contract."""
    l = table(spark, sf, "labels")  # noqa: E741
    ids = F.array(F.lit("e1"))

    def side(reviewer, level, blinded):
        return F.struct(reviewer.alias("reviewer_id"), level.alias("risk_level"), blinded.alias("blinded"))

    both = F.array(
        side(F.lit("a"), F.lit("low"), F.lit(True)),
        side(F.when(F.col("doc_id") % 9 == 0, "a").otherwise("b"), F.when(F.col("quality") == 0, "severe").otherwise("high"), F.col("toxic") == 0),
    )
    a = l.select(F.col("doc_id").cast("string").alias("case_id"), F.inline(both)).withColumns(
        {"evidence_ids": ids, "reason_codes": ids, "review_question_codes": ids}
    )
    g = ingest.gate_annotations(a)
    return g.select(F.col("case_id").cast("long"), "reviewer_id", "risk_level", F.array_join("violations", ";").alias("violations"), "accepted")


@query("""WITH r AS (SELECT source AS c, CASE WHEN source IN ('src1', 'src2') AND n_chars % 2 = 0 THEN 'other' WHEN source = 'src4' THEN 'other' ELSE 'local_hashing' END AS p FROM documents),
s AS (SELECT c, min(p) AS lo, max(p) AS hi, count(*) AS n FROM r GROUP BY c),
k AS (SELECT s.*, CASE WHEN c IN ('src3', 'src1', 'src4', 'src0') THEN NULL WHEN c = 'src5' THEN 'other' ELSE 'local_hashing' END AS own FROM s)
SELECT c AS collection, CAST(n AS BIGINT) AS record_count, coalesce(own, CASE WHEN lo = hi THEN lo END) AS effective, NOT coalesce(coalesce(own, CASE WHEN lo = hi THEN lo END) = 'local_hashing', false) AS violation FROM k""")
def provider_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Embedding provider of each collection against the configured one."""
    d = table(spark, sf, "documents")
    s = F.col("source")
    records = d.select(
        s.alias("collection"),
        F.when(s.isin("src1", "src2") & (F.col("n_chars") % 2 == 0), "other").when(s == "src4", "other").otherwise("local_hashing").alias("provider"),
    )
    own = F.when(s.isin("src3", "src1", "src4", "src0"), F.lit(None)).when(s == "src5", "other").otherwise("local_hashing")
    collections = d.select(s.alias("collection"), own.alias("provider")).distinct()
    return ingest.provider_guard(collections, records, F.lit("local_hashing"))


@query("""WITH n AS (SELECT unnest(['statutes','ftc_decisions','court_decisions','dispute_cases','clause_patterns']) AS c),
r AS (SELECT CASE lang WHEN 'en' THEN 'statutes' WHEN 'fr' THEN 'court_decisions' WHEN 'de' THEN 'clause_patterns' ELSE 'elsewhere' END AS c FROM documents)
SELECT n.c AS collection, CAST(count(r.c) AS BIGINT) AS records, count(r.c) = 0 AS "empty" FROM n LEFT JOIN r ON r.c = n.c GROUP BY n.c""")
def collection_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Records per known collection, zero included."""
    l = F.col("lang")  # noqa: E741
    c = F.when(l == "en", "statutes").when(l == "fr", "court_decisions").when(l == "de", "clause_patterns").otherwise("elsewhere")
    return ingest.collection_counts(table(spark, sf, "documents").select(c.alias("collection")))


# ---- stored tables -------------------------------------------------------------------------------

_CHUNKS_SQL = "SELECT doc_id, source || ':' || (doc_id // 2) AS id, lang, 'sha256:' || sha256(text) AS h FROM documents"


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as index rows; two neighbouring documents of a source are versions of one chunk."""
    return table(spark, sf, "documents").select(
        "doc_id", ingest.stable_id(F.col("source"), F.floor(F.col("doc_id") / 2).cast("string")).alias("stable_id"),
        F.col("lang").alias("language"), ingest.source_hash(F.col("text")).alias("source_hash"),
    )


@query(f"""WITH c AS ({_CHUNKS_SQL}),
old AS (SELECT * FROM c WHERE doc_id IN (SELECT vec_id FROM embeddings) QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id) = 1),
nw AS (SELECT * FROM c WHERE doc_id IN (SELECT doc_id FROM labels) QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id DESC) = 1)
SELECT coalesce(nw.id, old.id) AS stable_id, CASE WHEN nw.id IS NULL THEN old.doc_id WHEN old.h = nw.h AND old.lang = nw.lang THEN old.doc_id ELSE nw.doc_id END AS doc_id,
 coalesce(nw.h, old.h) AS source_hash, coalesce(nw.lang, old.lang) AS language,
 CASE WHEN nw.id IS NULL THEN 'kept' WHEN old.id IS NULL THEN 'add' WHEN old.h = nw.h AND old.lang = nw.lang THEN 'skip' ELSE 'update' END AS action
FROM old FULL JOIN nw ON old.id = nw.id""")
def stored_index(spark: SparkSession, sf: str) -> DataFrame:
    """A stored index of the documents with vectors, after an upsert of the labelled ones, read back from its buckets."""
    c, path = _chunks(spark, sf), stored.shared_folder(spark, "index")
    old = c.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    old = top_rows(old, ["stable_id"], ["doc_id"], 1, "_r").drop("_r").withColumn("authority_weight", F.lit(0.5))
    stored.write_index(old, path, buckets=16)
    incoming = c.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").withColumn("authority_weight", F.lit(0.5))
    done = stored.upsert_stored(spark, path, incoming, ["language"], "doc_id", buckets=16)
    now = stored.read_index(spark, path).join(done, "stable_id", "left")
    return now.select("stable_id", "doc_id", "source_hash", "language", F.coalesce("action", F.lit("kept")).alias("action"))


@query("""SELECT doc_id, length(text)::DOUBLE AS chars, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS spaces,
 (doc_id IN (SELECT doc_id FROM labels)) AS labelled FROM documents""")
def encoder_store(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of labelled documents go to the store first; the run over all documents encodes only what is missing."""
    d, path = table(spark, sf, "documents").select("doc_id", "text"), stored.shared_folder(spark, "vectors")
    labels = table(spark, sf, "labels").select("doc_id").distinct().withColumn("_l", F.lit(True))
    counts = lambda texts: [[len(t), t.count(" ")] for t in texts]
    stored.encode_stored(d.join(labels, "doc_id", "left_semi"), counts, path)
    both = stored.encode_stored(d, counts, path).join(labels, "doc_id", "left")
    return both.select(
        "doc_id", F.get("vector", F.lit(0)).alias("chars"), F.get("vector", F.lit(1)).alias("spaces"),
        F.coalesce("_l", F.lit(False)).alias("labelled"),
    )
