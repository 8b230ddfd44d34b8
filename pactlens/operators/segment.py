"""Split masked documents into sections and sub-items, entirely inside the document row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.constants import MAX_CLAUSE_CHARS
from pactlens.functions.text import is_blank, leading_space, spans, strip
from pactlens.operators.prefix import keep_where
from pactlens.packs.defaults import KOREAN_SECTIONS
from pactlens.packs.model import SectionPack

_PART = "struct<start:int,next:int,hit:string,nth:int>"


def section_label(section_type: Column, number: Column, pack: SectionPack = KOREAN_SECTIONS) -> Column:
    """Display label of a section."""
    printed = number.cast("string")
    return (
        F.when(section_type == "preamble", F.lit(pack.preamble_label))
        .when(section_type == "appendix", F.format_string(pack.appendix_label, printed))
        .otherwise(F.format_string(pack.article_label, printed))
    )


def outline(
    docs: DataFrame, text: str = "text", pack: SectionPack = KOREAN_SECTIONS, max_chars: int = MAX_CLAUSE_CHARS
) -> DataFrame:
    """Add the section plan of each document: ``parts``, ``clause_count`` and ``error_code``.

    A section ends where the next heading starts. Everything happens on the document's own heading
    array, so no shuffle carries document text. The error code is that of the first bad clause; a
    section that opens with a heading cannot be blank, and only long texts need the length check.
    """
    marked = docs.withColumn("_h", spans(F.col(text), pack.heading))
    sections = F.transform(
        "_h",
        lambda h, i: F.struct(
            h["start"].alias("start"), F.get("_h", i + 1)["start"].alias("next"), h["hit"].alias("hit"),
            (i + 1).alias("nth"),
        ),
    )
    no_hit = F.lit(None).cast("string")
    whole = F.array(F.struct(F.lit(0), F.lit(None), no_hit, F.lit(1)).cast(_PART))
    opening = F.array(F.struct(F.lit(0), F.get("_h", F.lit(0))["start"], no_hit, F.lit(0)).cast(_PART))
    lead_text = F.substring(F.col(text), F.lit(1), F.get("_h", F.lit(0))["start"])
    parts = (
        F.when(F.size("_h") == 0, whole)
        .when(is_blank(lead_text), sections)
        .otherwise(F.concat(opening, sections))
    )
    planned = marked.withColumn("parts", parts)
    too_long = (F.length(text) > max_chars) & F.exists(
        F.filter("parts", lambda p: p["nth"] > 0), lambda p: F.length(_part_text(text, p)) > max_chars
    )
    return planned.withColumns({
        "clause_count": F.size(F.filter("parts", lambda p: p["nth"] > 0)).cast("long"),
        "error_code": F.when((F.size("_h") == 0) & is_blank(F.col(text)), "CLAUSE_EMPTY").when(too_long, "CLAUSE_TOO_LONG"),
    }).drop("_h")


def _part_text(text: str, part: Column) -> Column:
    raw = F.substring(F.col(text), part["start"] + 1, F.coalesce(part["next"], F.length(text)) - part["start"])
    return F.when(part["hit"].isNotNull(), strip(raw)).otherwise(raw)


def segment(docs: DataFrame, text: str = "text", pack: SectionPack = KOREAN_SECTIONS) -> DataFrame:
    """One row per section with exact offsets; text before the first heading is the preamble.

    Packs without printed numbers count headings. Documents already outlined are not planned again.
    """
    planned = docs if "parts" in docs.columns else outline(docs, text, pack)
    keep = [c for c in docs.columns if c not in (text, "parts", "clause_count", "error_code")]
    body = F.substring(
        F.col(text), F.col("_p.start") + 1, F.coalesce(F.col("_p.next"), F.length(text)) - F.col("_p.start")
    )
    cut = planned.select(*keep, text, F.posexplode_outer("parts").alias("clause_ord", "_p")).withColumn("_body", body)
    headed = F.col("_p.hit").isNotNull()

    def group(i: int) -> Column:
        return F.regexp_extract("_p.hit", pack.heading, i) if i else F.lit("")

    appendix = F.coalesce(group(pack.appendix_group) != "", F.lit(False))
    kind = (
        F.when(F.col("_p.nth") == 0, "preamble").when(headed & appendix, "appendix").otherwise("article")
    )
    if pack.article_number_group:
        printed = F.when(appendix, group(pack.appendix_number_group)).otherwise(group(pack.article_number_group))
        number = F.when(headed, printed.try_cast("int")).otherwise(F.col("_p.nth"))
    else:
        number = F.col("_p.nth")
    shaped = cut.select(
        *keep,
        "clause_ord",
        number.alias("number"),
        kind.alias("section_type"),
        F.when(headed, strip(F.col("_body"))).otherwise(F.col("_body")).alias("text"),
        (F.col("_p.start") + F.when(headed, leading_space(F.col("_body"))).otherwise(F.lit(0))).alias("char_start"),
    )
    return shaped.select(
        "*",
        section_label(F.col("section_type"), F.col("number"), pack).alias("label"),
        F.when(F.col("section_type") == "preamble", F.lit("preamble"))
        .otherwise(F.concat_ws(":", "section_type", F.col("number").cast("string")))
        .alias("section_id"),
        (F.col("section_type") != "preamble").alias("analyzable"),
        (F.col("char_start") + F.length("text")).alias("char_end"),
    )


def with_subclauses(clauses: DataFrame, pack: SectionPack = KOREAN_SECTIONS) -> DataFrame:
    """Add ``subclauses``: numbered items of the clause with absolute offsets, blanks dropped."""
    marked = clauses.withColumn("_m", spans(F.col("text"), pack.marker))
    items = F.transform(
        "_m",
        lambda m, i: F.struct(
            F.regexp_extract(m["hit"], pack.marker, pack.marker_label_group).alias("label"),
            (F.col("char_start") + m["start"]).alias("char_start"),
            (F.col("char_start") + F.coalesce(F.get("_m", i + 1)["start"], F.length("text"))).alias("char_end"),
        ),
    )
    seen = F.filter(
        items,
        lambda s: ~is_blank(
            F.substring(F.col("text"), s["char_start"] - F.col("char_start") + 1, s["char_end"] - s["char_start"])
        ),
    )
    return marked.withColumn("subclauses", seen).drop("_m")


def subsegment(clauses: DataFrame, pack: SectionPack = KOREAN_SECTIONS) -> DataFrame:
    """One row per numbered item."""
    keys = [c for c in clauses.columns if c not in ("text", "char_start", "char_end", "label")]
    return with_subclauses(clauses, pack).select(
        *keys, F.posexplode_outer("subclauses").alias("sub_ord", "_s")
    ).filter("_s IS NOT NULL").select(*keys, "sub_ord", F.col("_s.label").alias("label"), "_s.char_start", "_s.char_end")


def subclause_of(subclauses: Column, offset: Column) -> Column:
    """Label of the first item holding the absolute offset, or NULL before the first marker."""
    return F.get(F.filter(subclauses, lambda s: (s["char_start"] <= offset) & (offset < s["char_end"])), F.lit(0))["label"]


def analyzable(clauses: DataFrame) -> DataFrame:
    """Drop preambles."""
    return clauses.filter("analyzable")


def clause_gate(clauses: DataFrame, max_chars: int = MAX_CLAUSE_CHARS) -> DataFrame:
    """Add ``error_code`` for blank or oversized clauses; any such clause fails its document."""
    return clauses.withColumn(
        "error_code",
        F.when(is_blank(F.col("text")), F.lit("CLAUSE_EMPTY")).when(
            F.length("text") > max_chars, F.lit("CLAUSE_TOO_LONG")
        ),
    )


def failed_documents(clauses: DataFrame, max_chars: int = MAX_CLAUSE_CHARS, doc: str = "doc_id") -> DataFrame:
    """Documents with a bad clause and the code of their first one."""
    gated = clause_gate(clauses, max_chars).select(doc, "clause_ord", "error_code")
    return keep_where(gated, F.col("error_code").isNotNull()).groupBy(doc).agg(
        F.min_by("error_code", "clause_ord").alias("error_code")
    )
