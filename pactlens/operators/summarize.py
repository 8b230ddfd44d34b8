"""Extractive summaries of findings and candidates, document roll-ups, and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.constants import (
    ACTORS, DEFAULT_RIGHT_NAME, LINE_FORBIDDEN, MAX_SUMMARY_LINE, RIGHT_NAMES, STRENGTH_RANK, UNKNOWN_STRENGTH,
)
from pactlens.functions.text import bounded, excerpt, facts, object_particle, squeeze
from pactlens.operators.prefix import number_rows

NO_SIGNAL = (
    "현재 19개 규칙과 추가 의미 검토에서 위험 신호가 확인되지 않았습니다. 계약의 안전성이나 적법성을 보장하지는 않습니다."
)
CAVEAT = "각 신호는 법률 결론이 아니므로 표시된 원문 조각과 적용 조건을 함께 확인해야 합니다."


def strength_rank(strength: Column) -> Column:
    """0 for high, 1 for medium, 2 for low, a large number for anything else."""
    expr = F.lit(UNKNOWN_STRENGTH)
    for name, rank in STRENGTH_RANK.items():
        expr = F.when(strength == name, F.lit(rank)).otherwise(expr)
    return expr


def span_excerpt(text: Column, start: Column, stop: Column, fallback: Column) -> Column:
    """Excerpt of a span when it is valid and not blank, else of the fallback text."""
    valid = (start >= 0) & (start < stop) & (stop <= F.length(text))
    inside = F.when(valid, squeeze(F.substring(text, start + 1, stop - start))).otherwise(F.lit(""))
    return excerpt(F.when(inside != "", inside).otherwise(F.coalesce(fallback, F.lit(""))))


def finding_sentence(
    name: Column, text: Column, start: Column, stop: Column, fallback: Column, why: Column
) -> Column:
    """One sentence per finding: its excerpt, else the clause's facts, else the rule's reason."""
    cited = span_excerpt(text, start, stop, fallback)
    found = facts(text, ACTORS)
    reason = F.regexp_replace(F.substring(squeeze(F.coalesce(why, F.lit(""))), 1, 48), " +$", "")
    lead = (
        F.when(cited != "", F.concat(F.lit("‘"), cited, F.lit("’ 문구에서 ")))
        .when(F.size(found) > 0, F.concat(F.array_join(found, ", "), F.lit(" 조건과 관련해 ")))
        .when(reason != "", F.concat(reason, F.lit("와 관련해 ")))
        .otherwise(F.lit(""))
    )
    return bounded(F.concat(lead, F.lit("‘"), name, F.lit("’ 위험 신호가 확인되어 고객 영향을 검토해야 합니다.")))


def candidate_sentence(name: Column, text: Column, method: Column) -> Column:
    """One sentence per candidate, never worded as a finding."""
    cited = excerpt(text)
    lead = F.when(cited != "", F.concat(F.lit("‘"), cited, F.lit("’ 문구가 "))).otherwise(F.lit("해당 문구가 "))
    relation = F.when(method == "openai_context", "문맥상 해당할 가능성이 있어").otherwise("의미적으로 유사해")
    return bounded(F.concat(lead, F.lit("‘"), name, F.lit("’ 유형에 "), relation, F.lit(" 추가 확인이 필요합니다.")))


def category_order(findings: DataFrame, doc: str, name: str, strength: str, order: list[str]) -> DataFrame:
    """Rule names per document by strength, then frequency, then first appearance."""
    grouped = findings.groupBy(doc, name).agg(
        F.min(strength_rank(F.col(strength))).alias("best_strength"),
        F.count(F.lit(1)).alias("finding_count"),
        F.min(F.struct(*order)).alias("first_seen"),
    )
    return number_rows(grouped, [doc], ["best_strength", F.col("finding_count").desc(), "first_seen"], "category_rank")


def headline(top: Column, remaining: Column, findings: Column, candidates: Column) -> Column:
    """Headline of a document from its leading categories and counts."""
    phrase = F.concat(
        F.array_join(top, ", "),
        F.when(remaining > 0, F.format_string(" 외 %d개 유형", remaining)).otherwise(F.lit("")),
    )
    lead = F.when(F.size(top) > 0, F.concat(F.lit("이 문서에서는 "), phrase, F.lit(" 관련 "))).otherwise(
        F.lit("이 문서에서는 ")
    )
    parts = F.array_compact(
        F.array(
            F.when(findings > 0, F.format_string("규칙 위험 신호 %d건", findings)),
            F.when(candidates > 0, F.format_string("추가 검토 후보 %d건", candidates)),
        )
    )
    text = bounded(F.concat(lead, F.array_join(parts, "과 "), F.lit("이 확인되어 해당 조항을 우선 검토해야 합니다.")))
    return F.when((findings == 0) & (candidates == 0), F.lit(NO_SIGNAL)).otherwise(text)


def summarize(
    docs: DataFrame, findings: DataFrame, candidates: DataFrame | None = None, doc: str = "doc_id"
) -> DataFrame:
    """Headline, top three categories and summary lines per document.

    ``findings`` needs clause_ord, rule_ord, rule_name and strength.
    """
    ranked = category_order(findings, doc, "rule_name", "strength", ["clause_ord", "rule_ord"])
    per_doc = ranked.groupBy(doc).agg(
        F.sum("finding_count").alias("finding_count"),
        F.count(F.lit(1)).alias("_kinds"),
        F.array_sort(
            F.collect_list(F.when(F.col("category_rank") <= 3, F.struct("category_rank", "rule_name")))
        ).alias("_top"),
    )
    out = docs.join(per_doc, doc, "left")
    if candidates is None:
        out = out.withColumn("candidate_count", F.lit(0).cast("long"))
    else:
        counts = candidates.groupBy(doc).agg(F.count(F.lit(1)).alias("candidate_count"))
        out = out.join(counts, doc, "left").withColumn("candidate_count", F.coalesce("candidate_count", F.lit(0)))
    top = F.coalesce(F.transform("_top", lambda s: s["rule_name"]), F.array().cast("array<string>"))
    out = out.withColumn("finding_count", F.coalesce("finding_count", F.lit(0))).withColumn("top_categories", top)
    left = F.coalesce("_kinds", F.lit(0)) - F.size("top_categories")
    out = out.withColumn("headline", headline(F.col("top_categories"), left, F.col("finding_count"), F.col("candidate_count")))
    return out.withColumn("lines", F.array("headline", F.lit(CAVEAT))).drop("_kinds", "_top")


def disposition(masked: Column, clause_review: Column, candidates: Column, findings: Column) -> Column:
    """Review state of a document."""
    return (
        F.when(~masked, "needs_review")
        .when(clause_review | (candidates > 0), "needs_review")
        .when(findings == 0, "no_signal")
        .otherwise("ready_for_review")
    )


def rollup(
    docs: DataFrame, clauses: DataFrame | None = None, findings: DataFrame | None = None,
    candidates: DataFrame | None = None, warnings: DataFrame | None = None, doc: str = "doc_id",
) -> DataFrame:
    """One row per document: counts, sorted distinct warnings and the disposition.

    ``docs`` needs ``passed`` and ``error_code``; counts it already carries are used as they are.
    Other sides are aggregated before the join, so only document-sized rows are shuffled.
    ``warnings`` is (doc, warning) and comes on top of a ``warnings`` array on ``docs``.
    """
    out = docs
    for name, side in (("clause_count", clauses), ("finding_count", findings), ("candidate_count", candidates)):
        if name in docs.columns:
            continue
        if side is None:
            out = out.withColumn(name, F.lit(0).cast("long"))
        else:
            out = out.join(side.groupBy(doc).agg(F.count(F.lit(1)).alias(name)), doc, "left").withColumn(
                name, F.coalesce(name, F.lit(0))
            )
    none = F.array().cast("array<string>")
    own = F.coalesce("warnings", none) if "warnings" in docs.columns else none
    if warnings is not None:
        out = out.join(warnings.groupBy(doc).agg(F.collect_set("warning").alias("_more")), doc, "left")
        own = F.array_union(own, F.coalesce("_more", none))
    out = out.withColumn("warnings", F.array_sort(own)).drop("_more")
    return out.withColumn(
        "disposition",
        disposition(
            F.col("passed"), F.col("error_code").isNotNull(), F.col("candidate_count"), F.col("finding_count")
        ),
    )


def right_name(detected: Column) -> Column:
    """Full name of a restricted right from the detected expression."""
    names = F.create_map(*[F.lit(x) for kv in RIGHT_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, detected), F.lit(DEFAULT_RIGHT_NAME))


def attach_guidance(findings: DataFrame, guidance: DataFrame, rights_rule: str = "R18_CUSTOMER_RIGHTS_RESTRICTION") -> DataFrame:
    """Add drafting guidance per rule; a rule without a template is left unchanged.

    ``guidance`` is (rule_id, point_one, point_two, example_clause, guidance_version), one row per
    rule. For the rights rule the first point and the example name the detected right.
    """
    joined = findings.join(guidance, "rule_id", "left")
    detected = F.get("elements", F.lit(0))["excerpt"]
    named = F.concat(right_name(detected), object_particle(right_name(detected)))
    special = (F.col("rule_id") == rights_rule) & F.col("point_one").isNotNull() & detected.isNotNull()
    point = F.when(special, F.concat(F.lit("고객의 "), named, F.lit(" 원칙적으로 보존합니다."))).otherwise(F.col("point_one"))
    clause = F.when(
        special,
        F.concat(
            F.lit("고객은 관련 법령과 이 계약에서 정한 절차에 따라 "), named,
            F.lit(" 행사할 수 있습니다. 권리 행사가 제한되는 경우에는 그 사유·범위·기간을 구체적으로 명시하고 고객에게 이의제기 및 구제 절차를 안내합니다."),
        ),
    ).otherwise(F.col("example_clause"))
    return joined.withColumns({
        "revision_points": F.when(F.col("point_one").isNotNull(), F.array(point, F.col("point_two"))),
        "example_clause": clause,
    }).drop("point_one", "point_two")


def valid_summary_lines(lines: Column) -> Column:
    """Two or three non-empty lines within the limit, without conclusion wording."""
    clean = F.transform(lines, squeeze)
    safe = F.forall(
        clean,
        lambda s: (s != "") & (F.length(s) <= MAX_SUMMARY_LINE) & ~s.rlike("|".join(LINE_FORBIDDEN)),
    )
    return F.coalesce(F.size(clean).between(2, 3) & safe, F.lit(False))


def report_rows(findings: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Findings flattened to ordered report lines: (doc, finding_no, line_no, section, content).

    ``findings`` needs label, rule_name, summary_sentence, elements, rule_id, rule_version, evidence,
    grounding and corpus_version. Findings are numbered by clause, then rule.
    """
    order = number_rows(findings, [doc], ["clause_ord", "rule_ord"], "finding_no")
    elements = F.transform(
        "elements",
        lambda e: F.struct(F.lit("element").alias("section"), F.concat(e["label"], F.lit(": "), e["excerpt"]).alias("content")),
    )
    evidence = F.transform(
        "evidence",
        lambda e: F.struct(F.lit("evidence").alias("section"), F.concat_ws(" · ", e["title"], e["status"]).alias("content")),
    )

    def line(section: str, content: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), content.alias("content"))

    lines = F.concat(
        F.array(
            line("heading", F.concat_ws(" · ", "label", "rule_name")),
            line("summary", F.col("summary_sentence")),
        ),
        elements,
        evidence,
        F.array(line("verification", F.format_string("%s / %s · corpus %s", "rule_id", "rule_version", "corpus_version"))),
    )
    return order.select(doc, "finding_no", F.posexplode(lines).alias("line_no", "_l")).select(
        doc, "finding_no", "line_no", "_l.section", "_l.content"
    )
