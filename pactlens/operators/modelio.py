"""Checks around optional model calls: routing, budgets, schema, citations and grounding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.constants import (
    CITATION_FORBIDDEN, CONTEXT_BUDGET, CONTEXT_CAP, DEEP_DAILY_LIMIT, ROUTING_ROLES, ROUTING_TIERS,
)
from pactlens.operators.prefix import running_offsets, top_rows

RISK = ["low", "medium", "high"]
APPLICABILITY = ["applicable", "not_applicable", "unknown"]


def evidence_status(status: Column, review_status: Column) -> Column:
    """Effective status of an evidence item."""
    raw = F.coalesce(F.nullif(status, F.lit("")), F.nullif(review_status, F.lit("")), F.lit("unverified"))
    return F.when(raw.isin("verified", "source_verified"), "verified").otherwise(raw)


def citation_issues(cited: Column, evidence: Column, wording: Column, require_verified: bool = True) -> Column:
    """Issue codes of an assessment: ``evidence`` is array<struct<evidence_id,status,review_status>>."""
    allowed = F.transform(evidence, lambda e: e["evidence_id"])
    stray = (F.size(cited) == 0) | (F.size(F.array_except(cited, allowed)) > 0)
    weak = F.exists(
        evidence,
        lambda e: F.array_contains(cited, e["evidence_id"]) & (evidence_status(e["status"], e["review_status"]) != "verified"),
    )
    said = wording.rlike("|".join(CITATION_FORBIDDEN))
    return F.array_compact(
        F.array(
            F.when(F.coalesce(stray, F.lit(True)), "INVALID_EVIDENCE_ID"),
            F.when(weak & F.lit(require_verified), "UNVERIFIED_EVIDENCE"),
            F.when(F.coalesce(said, F.lit(False)), "LEGAL_CONCLUSION"),
        )
    )


def verify_citations(assessments: DataFrame, require_verified: bool = True) -> DataFrame:
    """Add issues and status to rows with cited_ids, evidence and wording."""
    return assessments.withColumn(
        "issues", citation_issues(F.col("cited_ids"), F.col("evidence"), F.col("wording"), require_verified)
    ).withColumn("verification", F.when(F.size("issues") > 0, "failed").otherwise("passed"))


def validate_context(
    outputs: DataFrame, clauses: DataFrame, rules: DataFrame, excluded: DataFrame | None = None, cap: int = CONTEXT_CAP,
    doc: str = "doc_id",
) -> DataFrame:
    """Accept grounded context candidates; every other row carries a reason.

    ``outputs`` is (doc, seq, section_id, rule_id, evidence_quote, wording). Checks that concern
    one row come first, then one candidate per (section, category), then the cap per section.
    """
    c = clauses.select(doc, "section_id", F.col("text").alias("_text"), "clause_ord")
    # A repeated section id means its last clause.
    c = top_rows(c, [doc, "section_id"], [F.col("clause_ord").desc()], 1, "_r").drop("_r", "clause_ord")
    joined = outputs.join(rules.select("rule_id", "category"), "rule_id", "left").join(c, [doc, "section_id"], "left")
    if excluded is not None:
        ex = excluded.select(doc, "section_id", "category").distinct().withColumn("_seen", F.lit(True))
        joined = joined.join(ex, [doc, "section_id", "category"], "left")
    else:
        joined = joined.withColumn("_seen", F.lit(None).cast("boolean"))
    quote = F.coalesce("evidence_quote", F.lit(""))
    reason = (
        F.when(F.col("_text").isNull() | F.col("category").isNull(), "UNKNOWN_REFERENCE")
        .when(F.col("_seen").isNotNull(), "ALREADY_COVERED")
        .when(quote == "", "NO_QUOTE")
        .when(~F.contains(F.col("_text"), quote), "QUOTE_NOT_FOUND")
        .when(F.coalesce(F.col("wording"), F.lit("")).rlike("|".join(CITATION_FORBIDDEN)), "LEGAL_CONCLUSION")
    )
    checked = joined.withColumn("reason", reason).drop("_text", "_seen")
    valid = checked.filter("reason IS NULL")
    once = top_rows(valid, [doc, "section_id", "category"], ["seq"], 1, "_n")
    capped = top_rows(once.drop("_n"), [doc, "section_id"], ["seq"], cap, "_k").select(doc, "seq", F.lit(True).alias("accepted"))
    return checked.join(capped, [doc, "seq"], "left").withColumns({
        "accepted": F.coalesce("accepted", F.lit(False)),
        "reason": F.when(F.coalesce("accepted", F.lit(False)), F.lit(None)).otherwise(F.coalesce("reason", F.lit("DUPLICATE_OR_CAPPED"))),
    })


def budget_batches(
    clauses: DataFrame, max_chars: int = CONTEXT_BUDGET, max_calls: int = 1, doc: str = "doc_id", order: str = "clause_ord"
) -> DataFrame:
    """Clauses of the first call per document: (doc, order, chars, batch_no); NULL marks those left out.

    One call is the product case: the clauses whose running length stays within the budget. Clauses
    over the budget on their own are skipped and do not count. More than one call is taken as one.
    """
    max_calls = min(max(max_calls, 0), 1)
    # Only lengths travel; the texts stay where they are.
    sized = clauses.select(doc, order, F.length("text").cast("long").alias("chars"))
    fits = F.col("chars") <= max_chars
    run = running_offsets(sized.withColumn("_use", F.when(fits, F.col("chars")).otherwise(0)), [doc], order, ["_use"])
    inside = fits & (F.col("_use_before") + F.col("chars") <= max_chars) & F.lit(max_calls == 1)
    return run.withColumn("batch_no", F.when(inside, F.lit(1))).drop("_use", "_use_before")


def batch_summary(batched: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document: clauses and characters sent, and whether anything was left out."""
    sent = F.col("batch_no").isNotNull()
    return batched.groupBy(doc).agg(
        F.count_if(sent).alias("sent_clauses"),
        F.coalesce(F.sum(F.when(sent, F.col("chars"))), F.lit(0)).cast("long").alias("sent_chars"),
        F.bool_or(~sent).alias("truncated"),
    )


def routing_policy(spark: SparkSession) -> DataFrame:
    """The built-in routing policy, one row per role and tier."""
    tiers = {t: (m, o) for t, m, o in ROUTING_TIERS}
    rows = [(r, d, t, i, n, *tiers[t]) for r, d, i, n in ROUTING_ROLES for t in tiers]
    return spark.createDataFrame(
        rows,
        "role string, default_tier string, tier string, max_input_tokens int, max_turns int, model_key string, "
        "max_output_tokens int",
    )


def route_requests(
    requests: DataFrame, policy: DataFrame, available: list[str] | None = None, deep_limit: int = DEEP_DAILY_LIMIT
) -> DataFrame:
    """Tier, model and budgets per request, or a rejection code.

    ``requests``: request_id, day, seq, role, risk_level, failed_attempts, conflicting, input_tokens
    and deep_before (deep requests already spent that day). Deep requests of a day are accepted in
    order up to the limit.
    """
    roles = policy.select("role", "default_tier", F.col("max_input_tokens").alias("_in"), "max_turns").distinct()
    r = requests.join(roles, "role", "left")
    escalated = (F.col("role") == "verifier") & (F.col("failed_attempts") >= 1)
    deep = (F.col("role") == "analyst") & (F.col("risk_level") == "high") & F.col("conflicting")
    r = r.withColumns({
        "tier": F.when(escalated, "balanced").when(deep, "deep").otherwise(F.col("default_tier")),
        "reason": F.when(escalated, "verification retry escalation")
        .when(deep, "high-risk analysis with conflicting evidence").otherwise("role default"),
    })
    checked = r.withColumn(
        "rejected_code",
        F.when(F.col("default_tier").isNull(), "UNKNOWN_ROLE")
        .when(~F.col("risk_level").isin(RISK), "UNKNOWN_RISK_LEVEL")
        .when(F.least("failed_attempts", "input_tokens", "deep_before") < 0, "NEGATIVE_COUNTER")
        .when((F.col("role") == "adjudicator") & ~((F.col("risk_level") == "high") & F.col("conflicting")), "ADJUDICATOR_NOT_ALLOWED"),
    )
    over = F.col("input_tokens") > F.col("_in")
    # Only requests that would really run use up the day's deep budget.
    spends = F.col("rejected_code").isNull() & (F.col("tier") == "deep") & ~over
    granted = top_rows(checked.filter(spends), ["day"], ["seq"], deep_limit, "_nth").select(
        "request_id", F.col("_nth").alias("_deep_nth")
    )
    joined = checked.join(granted, "request_id", "left")
    spent = F.coalesce(F.col("_deep_nth"), F.lit(deep_limit + 1)) + F.col("deep_before") > deep_limit
    exhausted = (F.col("tier") == "deep") & F.when(over, F.col("deep_before") >= deep_limit).otherwise(spent)
    with_models = joined.withColumn(
        "rejected_code",
        F.when(F.col("rejected_code").isNotNull(), F.col("rejected_code"))
        .when(exhausted, "DEEP_LIMIT_REACHED")
        .when(over, "INPUT_BUDGET_EXCEEDED"),
    ).join(policy.select("role", "tier", "model_key", "max_output_tokens"), ["role", "tier"], "left")
    if available is not None:
        missing = ~F.coalesce(F.col("model_key").isin(available), F.lit(False))
        with_models = with_models.withColumn(
            "rejected_code", F.when(F.col("rejected_code").isNull() & missing, "MODEL_NOT_CONFIGURED").otherwise(F.col("rejected_code"))
        )
    ok = F.col("rejected_code").isNull()
    return with_models.select(
        "request_id",
        *[F.when(ok, F.col(c)).alias(c) for c in ("tier", "model_key")],
        F.when(ok, F.col("_in")).alias("max_input_tokens"),
        *[F.when(ok, F.col(c)).alias(c) for c in ("max_output_tokens", "max_turns", "reason")],
        "rejected_code",
    )


_ASSESSMENT = (
    "risk_level string, applicability string, summary string, rationale string, counter_considerations array<string>, "
    "review_questions array<string>, cited_evidence_ids array<string>"
)
_ASSESSMENT_KEYS = [f.split()[0] for f in _ASSESSMENT.split(", ")]


def _text_in(c: Column, lo: int, hi: int) -> Column:
    return F.length(c).between(lo, hi)


def validate_assessment(outputs: DataFrame, body: str = "output") -> DataFrame:
    """Parse model assessments with a closed schema: parsed struct, or LLM_SCHEMA_INVALID."""
    raw, v = F.col(body), F.try_parse_json(body)
    p = F.from_json(raw, _ASSESSMENT)
    keys = F.array_sort(F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")))
    typed = [F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) for k in _ASSESSMENT_KEYS]
    strings = [t == "STRING" for t in typed[:4]]
    lists = [t.isin("ARRAY<STRING>", "ARRAY<VOID>") for t in typed[4:]]
    ok = (keys == F.array(*[F.lit(k) for k in sorted(_ASSESSMENT_KEYS)])) & p["risk_level"].isin(RISK)
    ok = ok & p["applicability"].isin(APPLICABILITY) & _text_in(p["summary"], 1, 1000) & _text_in(p["rationale"], 1, 2000)
    for cond in [*strings, *lists]:
        ok = ok & cond
    ok = ok & (F.size(p["counter_considerations"]) <= 10) & (F.size(p["review_questions"]) <= 10)
    ok = ok & F.size(p["cited_evidence_ids"]).between(1, 20)
    valid = F.coalesce(ok, F.lit(False))
    return outputs.withColumns({
        "parsed": F.when(valid, p), "valid": valid, "error_code": F.when(~valid, F.lit("LLM_SCHEMA_INVALID")),
    })


_CONTEXT = (
    "candidates array<struct<section_id string, rule_id string, evidence_quote string, rationale string, "
    "review_question string, confidence string, counter_considerations array<string>>>"
)
_CONTEXT_KEYS = [
    "section_id", "rule_id", "evidence_quote", "rationale", "review_question", "confidence", "counter_considerations",
]


def validate_context_json(outputs: DataFrame, body: str = "output") -> DataFrame:
    """Parse context-review outputs with a closed schema and bounded fields."""
    raw = F.col(body)
    p = F.from_json(raw, _CONTEXT)["candidates"]
    members = F.from_json(F.get_json_object(raw, "$.candidates"), "array<string>")
    want = F.array(*[F.lit(k) for k in sorted(_CONTEXT_KEYS)])
    shape = F.forall(members, lambda m: F.coalesce(F.array_sort(F.json_object_keys(m)) == want, F.lit(False)))
    bounds = F.forall(
        p,
        lambda c: F.coalesce(
            _text_in(c["section_id"], 1, 200) & _text_in(c["rule_id"], 1, 100) & _text_in(c["evidence_quote"], 1, 600)
            & _text_in(c["rationale"], 1, 500) & _text_in(c["review_question"], 1, 240)
            & c["confidence"].isin(RISK) & (F.size(c["counter_considerations"]) <= 3),
            F.lit(False),
        ),
    )
    top = F.json_object_keys(raw) == F.array(F.lit("candidates"))
    valid = F.coalesce(top & (F.size(members) <= 12) & shape & bounds, F.lit(False))
    return outputs.withColumns({
        "candidates": F.when(valid, p), "valid": valid, "error_code": F.when(~valid, F.lit("LLM_SCHEMA_INVALID")),
    })


def call_model(batches: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Hook for a user-supplied provider: ``fn`` maps an Arrow batch of requests to outputs."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield fn(pdf)

    return batches.mapInPandas(run, schema)


def input_tokens(text: Column) -> Column:
    """Estimated input tokens."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 3)).cast("int")


def usage_totals(calls: DataFrame, key: str) -> DataFrame:
    """Calls and token totals per key."""
    return calls.groupBy(key).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("estimated_input_tokens").cast("long").alias("total_estimated_input_tokens"),
        F.sum("max_output_tokens").cast("long").alias("total_max_output_tokens"),
    )
