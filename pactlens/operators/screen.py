"""Screen clauses against a rule pack, and locate the findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.constants import GROUP_SUPPRESSION_WINDOW, MEDIUM_CONTEXT_TERMS, SUPPRESSION_WINDOW
from pactlens.functions.text import first_match, same_length_space, sentence_left, sentence_right
from pactlens.operators.factors import candidate_rules
from pactlens.operators.pages import page_fragments, page_of
from pactlens.operators.prefix import keep_where
from pactlens.operators.segment import subclause_of
from pactlens.packs.model import RulePack, portable

RULE_SCHEMA = (
    "rule_ord int, rule_id string, rule_name string, category string, groups array<array<string>>, "
    "negatives array<string>, negative_groups array<array<string>>, labels array<string>, "
    "context_terms array<string>, legal_basis array<string>"
)


def _raw_groups(rule: dict) -> list[list[str]]:
    return rule.get("required_pattern_groups") or [rule.get("positive_patterns", [])]


def _groups(rule: dict) -> list[list[str]]:
    return [[portable(p) for p in g] for g in _raw_groups(rule)]


def rules_table(spark: SparkSession, pack: RulePack, rule_ids: list[str] | None = None) -> DataFrame:
    """The pack as a small table, one row per rule, in pack order."""
    rows = [
        (
            i, r["id"], r["name"], r["category"], _groups(r),
            [portable(p) for p in r.get("negative_patterns", [])],
            [[portable(p) for p in g] for g in r.get("negative_pattern_groups", [])],
            r.get("labels", []), r["context_terms"], r.get("legal_basis_candidates", []),
        )
        for i, r in pack.select(rule_ids)
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def _all_groups_hit(text: Column, rule: dict) -> Column:
    any_of = [reduce(lambda a, b: a | b, [text.rlike(p) for p in g], F.lit(False)) for g in _groups(rule)]
    return reduce(lambda a, b: a & b, any_of)


#: Packs up to this size are tested as literal patterns in one projection; larger ones by the automaton of their literals.
LITERAL_RULES = 64


def _around(text: Column, anchor: Column, width: int) -> Column:
    """The text around the anchor match, clipped to the clause."""
    begin = F.greatest(anchor["start"] - width, F.lit(0))
    return F.substring(text, begin + 1, anchor["stop"] + width - begin)


def _any_of(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(portable(p)) for p in patterns], F.lit(False))


def _matches(text: Column, rule: dict) -> Column:
    """The first match of each group: pattern order first, then leftmost."""
    return F.array(*[F.coalesce(*[first_match(text, F.lit(p)) for p in g]) for g in _groups(rule)])


def _suppressed(rule: dict) -> Column:
    """An exception near the anchor, or one of each safe group in the wider window."""
    groups = rule.get("negative_pattern_groups", [])
    safe = reduce(lambda a, b: a & b, [_any_of(F.col("_wide"), g) for g in groups]) if groups else F.lit(False)
    return _any_of(F.col("_near"), rule.get("negative_patterns", [])) | safe


def _by_rule(chosen: list[tuple[int, dict]], value) -> Column:
    """A value that depends on the row's rule, with the rule's patterns as literals."""
    first, rest = chosen[0], chosen[1:]
    return reduce(lambda c, ir: c.when(F.col("rule_ord") == ir[0], value(ir[1])), rest, F.when(F.col("rule_ord") == first[0], value(first[1])))


def _pattern_any(patterns: Column, text: Column) -> Column:
    return F.exists(patterns, lambda p: F.call_function("rlike", text, p))


def screen(clauses: DataFrame, pack: RulePack, rule_ids: list[str] | None = None, literal_rules: int = LITERAL_RULES) -> DataFrame:
    """At most one match per clause and rule, with spans, elements, strength and rationale.

    Stage one finds the few rule numbers that hit, in a projection without a join. A pack of up to ``literal_rules`` rules is tested as literal
    patterns. A larger one goes by the automaton of :mod:`~pactlens.operators.factors`, and patterns run only for the rules
    it names. Stage two works out spans and exceptions for those rows only, with the patterns of a small pack as literals,
    which are compiled once. The rule table is a driver-side constant, so its broadcast is bounded.
    """
    chosen = pack.select(rule_ids)
    small = 0 < len(chosen) <= literal_rules
    normed = clauses.withColumn("_norm", same_length_space(F.col("text")))
    table = rules_table(clauses.sparkSession, pack, rule_ids)
    if small:
        flags = [F.when(_all_groups_hit(F.col("_norm"), r), F.lit(i)) for i, r in chosen]
        hits = F.array_compact(F.array(*flags))
    else:
        hits = candidate_rules(F.col("_norm"), [(i, _raw_groups(r)) for i, r in chosen])
    # The outer form keeps the optimizer from copying the rule tests into an inferred filter.
    stage1 = normed.select("*", F.explode_outer(hits).alias("rule_ord")).filter("rule_ord IS NOT NULL")
    if small:
        matched = stage1.withColumn("_m", _by_rule(chosen, lambda r: _matches(F.col("_norm"), r)))
    else:
        stage1 = stage1.join(F.broadcast(table), "rule_ord")
        some = F.transform(
            "groups",
            lambda g: F.get(F.filter(F.transform(g, lambda p: first_match(F.col("_norm"), p)), lambda m: m.isNotNull()), F.lit(0)),
        )
        # The automaton names rules that can match; those whose groups all do go on.
        matched = keep_where(stage1.withColumn("_m", some), F.forall("_m", lambda m: m.isNotNull()) & (F.size("_m") > 0))
    windowed = matched.withColumn("_a", F.get("_m", F.lit(0))).withColumns({
        "_near": _around(F.col("_norm"), F.col("_a"), SUPPRESSION_WINDOW), "_wide": _around(F.col("_norm"), F.col("_a"), GROUP_SUPPRESSION_WINDOW)
    })
    if small:
        kept = keep_where(windowed, ~_by_rule(chosen, _suppressed)).join(F.broadcast(table), "rule_ord")
    else:
        near = _pattern_any(F.col("negatives"), F.col("_near"))
        safe = (F.size("negative_groups") > 0) & F.forall("negative_groups", lambda g: _pattern_any(g, F.col("_wide")))
        kept = keep_where(windowed, ~near & ~safe)
    context = F.size(F.filter("context_terms", lambda t: F.contains(F.col("_norm"), t)))
    first = F.array_min(F.transform("_m", lambda m: m["start"]))
    last = F.array_max(F.transform("_m", lambda m: m["stop"]))
    elements = F.transform(
        "_m",
        lambda m, i: F.struct(
            F.coalesce(F.get("labels", i), F.format_string("판단 표현 %d", i + 1)).alias("label"),
            m["hit"].alias("excerpt"), m["start"].alias("start"), m["stop"].alias("stop"),
        ),
    )
    located = kept.withColumn("context_count", context)
    return located.select(
        *clauses.columns,
        "rule_ord", "rule_id", "rule_name", "category", "legal_basis",
        F.lit(pack.version).alias("rule_version"),
        F.col("_a.hit").alias("matched_excerpt"),
        F.col("_a.start").alias("match_start"),
        F.col("_a.stop").alias("match_end"),
        sentence_left(F.col("_norm"), first).alias("risk_start"),
        sentence_right(F.col("_norm"), last).alias("risk_end"),
        elements.alias("elements"),
        "context_count",
        F.when(F.col("context_count") >= MEDIUM_CONTEXT_TERMS, F.lit("medium")).otherwise(F.lit("low")).alias("strength"),
        F.format_string(
            "'%s' 검토 신호와 문맥어 %d개가 탐지됨. 위법성 결론이 아니며 예외와 계약 전체 문맥을 검토해야 함.",
            F.col("rule_name"), F.col("context_count"),
        ).alias("rationale"),
    )


def finding_id(section_id: Column, rule_id: Column) -> Column:
    """Public id of a finding. Section ids may repeat in a document, so never join on it."""
    return F.concat_ws(":", F.lit("finding"), section_id, rule_id)


def locate(findings: DataFrame, ranges: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """Add finding_id, absolute offsets, the sub-item label and, given page ranges, the page."""
    placed = findings.select(
        "*",
        finding_id(F.col("section_id"), F.col("rule_id")).alias("finding_id"),
        (F.col("char_start") + F.col("risk_start")).alias("abs_start"),
        (F.col("char_start") + F.col("risk_end")).alias("abs_end"),
    )
    if "subclauses" in findings.columns:
        placed = placed.withColumn("subclause_label", subclause_of(F.col("subclauses"), F.col("abs_start")))
    if ranges is not None:
        placed = page_of(placed, ranges, doc, "page_no", "abs_start")
    return placed


def fragments(located: DataFrame, ranges: DataFrame, pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Up to two page-local text pieces per located finding, cut from ``pages`` (doc, page_no, text)."""
    matches = located.select(
        doc, "clause_ord", "rule_ord", F.col("abs_start").alias("match_start"), F.col("abs_end").alias("match_end")
    )
    return page_fragments(matches, ranges, pages, doc, [doc, "clause_ord", "rule_ord"])
