"""Quality, agreement and stability metrics over tables of cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactlens.constants import RISK_LEVELS

SCORE_RANGES = 128


def ratio(num: Column, den: Column) -> Column:
    """Quotient, or 0 when the denominator is 0."""
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


def prf(counts: DataFrame, digits: int = 4) -> DataFrame:
    """Add precision, recall and F1 to tp/fp/fn; F1 uses the unrounded values."""
    p = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = ratio(2 * p * r, p + r)
    return counts.withColumns(
        {"precision": F.round(p, digits), "recall": F.round(r, digits), "f1": F.round(f1, digits)}
    )


def confusion(gold: DataFrame, predicted: DataFrame, cases: DataFrame, labels: DataFrame) -> DataFrame:
    """tp, fp, fn and tn per label from (case_id, label) sets.

    True negatives are the remaining cases, by arithmetic instead of a cases-by-labels product.
    """
    g = gold.select("case_id", "label", F.lit(1).alias("_g")).distinct()
    p = predicted.select("case_id", "label", F.lit(1).alias("_p")).distinct()
    joined = g.join(p, ["case_id", "label"], "full")
    counts = joined.groupBy("label").agg(
        F.count_if(F.col("_g").isNotNull() & F.col("_p").isNotNull()).alias("tp"),
        F.count_if(F.col("_g").isNull()).alias("fp"),
        F.count_if(F.col("_p").isNull()).alias("fn"),
    )
    total = cases.agg(F.count_distinct("case_id").alias("n")).scalar()
    out = labels.select("label").join(counts, "label", "left")
    filled = out.select("label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    return filled.withColumn("tn", total - F.col("tp") - F.col("fp") - F.col("fn"))


def macro_micro(per_label: DataFrame) -> DataFrame:
    """Macro F1 (mean over labels) and micro F1 (from summed counts)."""
    p = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    return per_label.agg(
        F.round(F.avg(ratio(2 * p * r, p + r)), 6).alias("macro_f1"),
        F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("micro_f1"),
    )


def _sets(c: str) -> Column:
    return F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>")))


def policy_sections(sections: DataFrame) -> DataFrame:
    """Per section: set comparisons of the rule, candidate and combined families.

    ``sections`` has required, allowed, forbidden, actual (rule ids), candidates,
    expected_candidates, allowed_candidates (categories), candidate_rules (their rule ids) and
    ``evaluated``.
    """
    names = [
        "required", "allowed", "forbidden", "actual", "candidates", "expected_candidates", "allowed_candidates",
        "candidate_rules",
    ]
    s = sections.withColumns({n: _sets(n) for n in names})
    s = s.withColumn("combined", F.array_union("actual", "candidate_rules"))

    def unexpected(actual: str) -> Column:
        return F.array_except(F.array_except(F.col(actual), F.col("required")), F.col("allowed"))

    def hits(actual: str) -> Column:
        return F.array_intersect(actual, "forbidden")

    return s.withColumns({
        "missing": F.array_except("required", "actual"),
        "unexpected": unexpected("actual"),
        "forbidden_hits": hits("actual"),
        "rule_tp": F.size(F.array_intersect("required", "actual")),
        "rule_fp": F.size(F.array_union(unexpected("actual"), hits("actual"))),
        "candidate_tp": F.size(F.array_intersect("expected_candidates", "candidates")),
        "candidate_fn": F.size(F.array_except("expected_candidates", "candidates")),
        "candidate_fp": F.size(
            F.array_except(F.array_except("candidates", "expected_candidates"), F.col("allowed_candidates"))
        ),
        "combined_tp": F.size(F.array_intersect("required", "combined")),
        "combined_fn": F.size(F.array_except("required", "combined")),
        "combined_fp": F.size(F.array_union(unexpected("combined"), hits("combined"))),
    }).withColumn("rule_fn", F.size("missing"))


def policy_totals(checked: DataFrame) -> DataFrame:
    """Micro totals per family with precision, recall and F1."""
    families = ["rule", "candidate", "combined"]
    sums = checked.agg(
        *[F.sum(f"{f}_{k}").cast("long").alias(f"{f}_{k}") for f in families for k in ("tp", "fp", "fn")]
    )
    rows = F.explode(
        F.array(*[
            F.struct(F.lit(f).alias("family"), *[F.coalesce(f"{f}_{k}", F.lit(0)).alias(k) for k in ("tp", "fp", "fn")])
            for f in families
        ])
    )
    return prf(sums.select(rows.alias("_r")).select("_r.*"), 6)


def policy_labels(checked: DataFrame, family: str = "rule") -> DataFrame:
    """Counts per label: required wins over forbidden; allowed extras do not count."""
    if family == "rule":
        want, got, allow, ban = "required", "actual", "allowed", F.col("forbidden")
    else:
        want, got, allow, ban = "expected_candidates", "candidates", "allowed_candidates", F.array().cast("array<string>")
    labels = F.array_union(F.array_union(F.col(want), F.col(got)), ban)
    rows = checked.select(want, got, allow, ban.alias("_ban"), F.explode(labels).alias("label"))
    wanted, seen = F.array_contains(want, F.col("label")), F.array_contains(got, F.col("label"))
    wrong = F.array_contains("_ban", F.col("label")) | ~F.array_contains(allow, F.col("label"))
    kind = F.when(wanted & seen, "tp").when(seen & wrong, "fp").when(wanted, "fn")
    return prf(
        rows.groupBy("label").agg(*[F.count_if(kind == k).alias(k) for k in ("tp", "fp", "fn")]), 6
    )


def policy_flags(checked: DataFrame) -> DataFrame:
    """Document-level counters: normal-clause false positives, duplicate-signal rate, pass flags."""
    quiet = F.col("evaluated") & (F.size("required") == 0) & (F.size("expected_candidates") == 0)
    signal = F.col("evaluated") & (F.size("combined") > 0)
    both = signal & (F.size(F.array_intersect("actual", "candidate_rules")) > 0)
    rules_ok = (F.size("missing") == 0) & (F.size("unexpected") == 0) & (F.size("forbidden_hits") == 0)
    combined_ok = (F.col("combined_fn") == 0) & (F.col("combined_fp") == 0)
    return checked.agg(
        F.sum(F.when(quiet, F.col("combined_fp")).otherwise(0)).cast("long").alias("normal_clause_fp"),
        F.round(ratio(F.count_if(both), F.count_if(signal)), 6).alias("duplicate_signal_rate"),
        F.coalesce(F.bool_and(F.when(F.col("evaluated"), rules_ok)), F.lit(True)).alias("passed"),
        F.coalesce(F.bool_and(F.when(F.col("evaluated"), combined_ok)), F.lit(True)).alias("combined_passed"),
    )


def fleiss_kappa(annotations: DataFrame, levels: Sequence[str] = RISK_LEVELS) -> DataFrame:
    """Agreement over (case_id, reviewer_id, risk_level); every case needs the same rater count."""
    per_level = annotations.groupBy("case_id", "risk_level").agg(F.count(F.lit(1)).alias("c"))
    per_case = per_level.groupBy("case_id").agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("agree"), F.count(F.lit(1)).alias("kinds"),
        *[F.sum(F.when(F.col("risk_level") == v, F.col("c")).otherwise(0)).alias(f"l{i}") for i, v in enumerate(levels)],
    )
    total = per_case.agg(
        F.count(F.lit(1)).alias("case_count"),
        F.max("n").alias("reviewer_count_per_case"),
        F.sum("n").alias("annotation_count"),
        F.avg((F.col("kinds") == 1).cast("double")).alias("exact"),
        F.avg(F.col("agree") / (F.col("n") * (F.col("n") - 1))).alias("obs"),
        *[F.sum(f"l{i}").alias(f"t{i}") for i in range(len(levels))],
    )
    expected = sum((F.pow(F.col(f"t{i}") / F.col("annotation_count"), 2) for i in range(len(levels))), F.lit(0.0))
    kappa = F.when(F.col("exp") == 1, F.lit(1.0)).otherwise((F.col("obs") - F.col("exp")) / (1 - F.col("exp")))
    return total.withColumn("exp", expected).select(
        "case_count", "reviewer_count_per_case", "annotation_count",
        F.round("exact", 6).alias("exact_agreement_rate"),
        F.round("obs", 6).alias("observed_pair_agreement"),
        F.round("exp", 6).alias("expected_pair_agreement"),
        F.round(kappa, 6).alias("fleiss_kappa"),
    )


def disagreements(annotations: DataFrame) -> DataFrame:
    """Ratings of the cases on which reviewers differ, one row per judgment."""
    split = annotations.groupBy("case_id").agg(
        F.min("risk_level").alias("_lo"), F.max("risk_level").alias("_hi")
    ).filter("_lo <> _hi").select("case_id")
    return annotations.join(split, "case_id", "left_semi").select("case_id", "reviewer_id", "risk_level")


def threshold_curve(scores: DataFrame) -> DataFrame:
    """Precision, recall and F1 at every distinct score, from (score double, positive boolean).

    Rows are first summed per distinct score, then cumulated with a two-level prefix over ranges of scores. The ranges end at
    approximate quantiles of the distinct scores, so each task gets about as many of them however close they lie.
    """
    per = scores.groupBy("score").agg(
        F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg")
    )
    all_pos = scores.agg(F.count_if("positive").alias("n")).scalar()
    placed = per.filter("score IS NOT NULL")
    ends = placed.agg(F.percentile_approx("score", [i / SCORE_RANGES for i in range(1, SCORE_RANGES)], 20 * SCORE_RANGES)).scalar()
    blocked = placed.withColumn("_ends", ends).withColumn("_b", F.size(F.filter("_ends", lambda e: e <= F.col("score")))).drop("_ends")
    totals = blocked.groupBy("_b").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    above = W.orderBy(F.col("_b").desc()).rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(
        "_b", F.coalesce(F.sum("_bp").over(above), F.lit(0)).alias("_pp"), F.coalesce(F.sum("_bn").over(above), F.lit(0)).alias("_pn")
    )
    inner = W.partitionBy("_b").orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, 0)
    curve = blocked.join(base, "_b").select(
        F.col("score").alias("threshold"),
        (F.col("_pp") + F.sum("pos").over(inner)).alias("tp"),
        (F.col("_pn") + F.sum("neg").over(inner)).alias("fp"),
    )
    p = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = ratio(F.col("tp"), all_pos)
    return curve.select("threshold", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def calibrate_threshold(scores: DataFrame, floor: float = 0.75, fallback: float = 0.72) -> DataFrame:
    """The score with the best F1 among those meeting the precision floor; ties go higher."""
    fit = threshold_curve(scores).filter(F.col("precision") >= floor)
    best = fit.agg(F.max(F.struct("f1", "threshold", "precision", "recall")).alias("b"))
    return best.select(
        F.coalesce("b.threshold", F.lit(fallback)).alias("threshold"),
        F.round(F.coalesce("b.f1", F.lit(0.0)), 6).alias("f1"),
        F.round("b.precision", 6).alias("precision"),
        F.round("b.recall", 6).alias("recall"),
    )


def run_stability(run_a: DataFrame, run_b: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Jaccard overlap, churn and set equality of two runs' (doc, section_id, rule_id) per document."""
    keys = [doc, "section_id", "rule_id"]
    a = run_a.select(*keys, F.lit(1).alias("_a")).distinct()
    b = run_b.select(*keys, F.lit(1).alias("_b")).distinct()
    per = a.join(b, keys, "full").groupBy(doc).agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("_both"), F.count(F.lit(1)).alias("_any")
    )
    jaccard = F.round(F.col("_both") / F.col("_any"), 6)
    return per.select(
        doc, jaccard.alias("jaccard"), F.round(1 - F.col("_both") / F.col("_any"), 6).alias("churn"),
        (F.col("_both") == F.col("_any")).alias("exact"),
    )


def coverage_score(gold: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Score 0-100 per document from ``outcome`` (FULL, PARTIAL, MISS); FP rows are counted apart."""
    points = F.when(F.col("outcome") == "FULL", 1.0).when(F.col("outcome") == "PARTIAL", 0.5).when(
        F.col("outcome") == "MISS", 0.0
    )
    return gold.groupBy(doc).agg(
        F.round(F.coalesce(F.avg(points), F.lit(0.0)) * 100, 4).alias("score"),
        F.count_if(F.col("outcome") == "FP").alias("fp"),
    )
