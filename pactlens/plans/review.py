"""The whole review of a document table as one declarative plan."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.constants import MASKING_FAILED_WARNING, MAX_DOCUMENT_CHARS
from pactlens.operators import candidates as cand
from pactlens.operators import pages as pg
from pactlens.operators import masking, retrieve, screen, segment, summarize
from pactlens.operators.prefix import keep_where
from pactlens.packs.defaults import KOREAN_RULES, KOREAN_SECTIONS, PII_PATTERNS
from pactlens.packs.model import PiiPattern, RulePack, SectionPack
from pactlens.sources import stored


@dataclass(frozen=True)
class ReviewConfig:
    """What to review with; the defaults are the Korean packs."""

    rules: RulePack = KOREAN_RULES
    sections: SectionPack = KOREAN_SECTIONS
    patterns: tuple[PiiPattern, ...] = tuple(PII_PATTERNS)
    rule_ids: list[str] | None = None


@dataclass(frozen=True)
class Review:
    """The tables of one review, all lazy."""

    documents: DataFrame
    clauses: DataFrame
    findings: DataFrame
    candidates: DataFrame | None
    results: DataFrame


def masked_documents(docs: DataFrame, config: ReviewConfig) -> DataFrame:
    """Masked documents; ``text`` holds the masked text from here on."""
    masked = masking.mask_documents(docs.select("doc_id", "text"), "text", config.patterns)
    return masked.drop("text").withColumnRenamed("masked_text", "text")


def outlined_documents(masked: DataFrame, config: ReviewConfig) -> DataFrame:
    """Masked documents with their section plan; a failed masking counts no clauses and has no bad ones."""
    plan = segment.outline(masked, pack=config.sections)
    return plan.withColumns({
        "clause_count": F.when(F.col("passed"), F.col("clause_count")).otherwise(F.lit(0)),
        "error_code": F.when(F.col("passed"), F.col("error_code")),
    })


def clauses_of(masked: DataFrame, config: ReviewConfig, drop_failed: bool = False) -> DataFrame:
    """Analyzable clauses of the documents whose masking passed.

    With ``drop_failed``, one bad clause also stops its document, as in the full review.
    """
    # Masking decides first: a failed document never reaches a rule.
    planned = outlined_documents(masked, config) if "parts" not in masked.columns else masked
    ok = F.col("passed") & F.col("error_code").isNull() if drop_failed else F.col("passed")
    safe = keep_where(planned, ok).select("doc_id", "text", "parts")
    return segment.analyzable(segment.segment(safe, pack=config.sections))


def findings_of(clauses: DataFrame, config: ReviewConfig) -> DataFrame:
    """Located findings with sub-item labels."""
    marked = segment.with_subclauses(clauses, config.sections)
    return screen.locate(screen.screen(marked, config.rules, config.rule_ids))


def run_review(
    docs: DataFrame, config: ReviewConfig = ReviewConfig(), index: DataFrame | None = None,
    prototypes: tuple[DataFrame, DataFrame] | None = None, cards: DataFrame | None = None, encoder=None,
) -> Review:
    """Review ``docs`` (doc_id, text); a null text counts as empty. Retrieval, candidates and the gate run when their tables are given."""
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    return review_masked(outlined_documents(masked_documents(docs, config), config), config, index, prototypes, cards, encoder)


def review_pages(
    pages: DataFrame, config: ReviewConfig = ReviewConfig(), index: DataFrame | None = None,
    prototypes: tuple[DataFrame, DataFrame] | None = None, cards: DataFrame | None = None, encoder=None,
    max_chars: int = MAX_DOCUMENT_CHARS,
) -> Review:
    """Review ``pages`` (doc_id, page_no, text); findings also get ``page_number`` and ``fragments``.

    Pages are cleaned and masked one by one, with placeholders numbered over the document, and joined by line feeds. A finding is on
    the page on which its match begins; ``fragments`` are the pieces of the first two pages that the match touches. Documents without
    text or over ``max_chars`` get their error code and no findings. Masked pages and findings are each read several times, so
    both are written to the cluster's shared folder when this is called.
    """
    spark, folder = pages.sparkSession, stored.shared_folder(pages.sparkSession, "review")
    clean = pages.select("doc_id", "page_no", pg.clean_page(F.coalesce("text", F.lit(""))).alias("text"))
    names = [masking.count_name(p.pii_type) for p in config.patterns]
    # Masked text is cleaned once, as it is stored: every later read takes it as it is.
    text = pg.clean_page(F.col("masked_text")).alias("text")
    kept = masking.mask_pages(clean, patterns=config.patterns).select("doc_id", "page_no", text, "passed", "replacement_count", *names)
    kept.write.parquet(f"{folder}/pages")
    masked = spark.read.schema(kept.schema).parquet(f"{folder}/pages")
    texts = masked.select("doc_id", "page_no", "text")
    whole = pg.assemble_pages(texts, max_chars=max_chars, cleaned=True).select("doc_id", F.coalesce("page_text", F.lit("")).alias("text"), F.col("error_code").alias("_error"))
    found = [F.sum(n).alias(n) for n in names]
    per = masked.groupBy("doc_id").agg(F.every("passed").alias("passed"), F.sum("replacement_count").alias("replacement_count"), *found)
    types = F.array_compact(F.array(*[F.when(F.col(n) > 0, F.lit(p.pii_type)) for n, p in zip(names, config.patterns, strict=True)]))
    states = per.select("doc_id", "passed", "replacement_count", types.alias("detected_types"))
    planned = outlined_documents(whole.join(states, "doc_id"), config)
    planned = planned.withColumn("error_code", F.coalesce("_error", "error_code")).withColumn("clause_count", F.when(F.col("_error").isNull(), F.col("clause_count")).otherwise(F.lit(0))).drop("_error")
    done = review_masked(planned, config, index, prototypes, cards, encoder)
    ranges, key = pg.page_ranges(texts), ["doc_id", "clause_ord", "finding_id"]
    done.findings.write.parquet(f"{folder}/findings")
    done = replace(done, findings=spark.read.schema(done.findings.schema).parquet(f"{folder}/findings"))
    placed = pg.page_of(done.findings.withColumn("offset", F.col("abs_start")), ranges).drop("offset")
    spans = done.findings.select(*key, F.col("abs_start").alias("match_start"), F.col("abs_end").alias("match_end"))
    pieces = pg.page_fragments(spans, ranges, texts, "doc_id", key, cleaned=True).groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("page_number", "fragment"))).alias("fragments")
    )
    return replace(done, findings=placed.join(pieces, key, "left"))


def review_masked(
    masked: DataFrame, config: ReviewConfig, index: DataFrame | None = None,
    prototypes: tuple[DataFrame, DataFrame] | None = None, cards: DataFrame | None = None, encoder=None,
) -> Review:
    """The review of masked documents with their section plan."""
    clauses = clauses_of(masked, config, drop_failed=True)
    findings = findings_of(clauses, config)
    if index is not None:
        keyed = clauses.withColumn("query_id", F.concat_ws("#", "doc_id", "clause_ord"))
        hits = retrieve.hybrid_search(keyed.select("query_id", "text"), index, 3, encoder=encoder)
        findings = retrieve.attach_evidence(
            findings.withColumn("query_id", F.concat_ws("#", "doc_id", "clause_ord")), hits, ["query_id"]
        )
    chosen = None
    if prototypes is not None:
        marked = segment.with_subclauses(clauses, config.sections)
        chosen = cand.suggest(
            marked, ["doc_id", "clause_ord"], *prototypes, excluded=findings.select("doc_id", "clause_ord", "category"),
            encoder=encoder,
        )
        if cards is not None:
            named = chosen.withColumn("candidate_id", F.concat_ws(":", "doc_id", "clause_ord", "rule_id")).withColumn(
                "text", F.col("segment_text")
            )
            chosen = cand.gate(cand.search_cards(named, cards, encoder=encoder), named).filter("kept")
    notes = F.array_compact(F.array(F.when(~F.col("passed"), F.lit(MASKING_FAILED_WARNING)), F.col("error_code")))
    states = masked.select(
        "doc_id", "passed", "detected_types", "replacement_count", "clause_count", "error_code", notes.alias("warnings")
    )
    results = summarize.rollup(summarize.summarize(states, findings, chosen))
    return Review(masked, clauses, findings, chosen, results)
