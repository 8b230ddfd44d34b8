"""Personal-data masking with numbered placeholders, per text or across the pages of a document."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactlens.functions.text import fold_rows, spans
from pactlens.operators.prefix import running_offsets
from pactlens.packs.defaults import PII_PATTERNS
from pactlens.packs.model import DIGIT, PiiPattern

LABEL_TRIGGER = "[가-힣]"


def _triggers(text: Column) -> dict[str, Column]:
    return {
        "digit": text.rlike(f"{DIGIT}{{2}}"),
        "at": F.contains(text, F.lit("@")),
        "label": text.rlike(LABEL_TRIGGER),
    }


def _count(name: str) -> str:
    return f"n_{name}"


def count_name(pii_type: str) -> str:
    """Column of ``mask_pages`` with the number of a type's replacements."""
    return _count(pii_type)


def _pieces(text: Column, p: PiiPattern) -> Column:
    """Cut the text at the matches: (gap, kept prefix) per match, then the tail with no prefix."""
    gaps = F.split(text, p.regex, -1)
    if not p.prefix_groups:
        return F.transform(gaps, lambda g: F.struct(g.alias("gap"), F.lit("").alias("kept")))
    groups = [F.regexp_extract_all(text, F.lit(p.regex), F.lit(i)) for i in p.prefix_groups]
    kept = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, y)), groups)
    return F.zip_with(gaps, kept, lambda g, k: F.struct(g.alias("gap"), F.coalesce(k, F.lit("")).alias("kept")))


def _rebuild(pieces: Column, p: PiiPattern, offset: Column) -> Column:
    def render(piece: Column, i: Column) -> Column:
        label = F.concat(F.lit(f"[{p.pii_type.upper()}_"), (i + 1 + offset).cast("string"), F.lit("]"))
        tail = i + 1 == F.size(pieces)
        return F.when(tail, piece["gap"]).otherwise(F.concat(piece["gap"], piece["kept"], label))

    return F.array_join(F.transform(pieces, render), "")


def apply_patterns(
    df: DataFrame, text: str, patterns: Sequence[PiiPattern], offsets: dict[str, Column] | None = None, where: Column | None = None
) -> DataFrame:
    """Mask ``text`` in place, one pattern after the other, and add ``n_<type>`` counts.

    Each step is its own projection, so a step's text is computed once. Clean texts only pay for
    the three trigger checks, and rows that are not ``where`` for nothing.
    """
    offsets = offsets or {}
    where = F.lit(True) if where is None else where
    df = df.withColumns({f"_has_{kind}": where & expr for kind, expr in _triggers(F.col(text)).items()})
    for p in patterns:
        offset = offsets.get(p.pii_type, F.lit(0))
        hit = F.col(f"_has_{p.needs}") & F.col(text).rlike(p.regex)
        df = df.withColumn("_pieces", F.when(hit, _pieces(F.col(text), p)))
        df = df.withColumns({
            _count(p.pii_type): F.coalesce(F.size("_pieces") - 1, F.lit(0)),
            text: F.coalesce(_rebuild(F.col("_pieces"), p, offset), F.col(text)),
        })
    return df.drop("_pieces", "_has_digit", "_has_at", "_has_label")


def residual(text: Column, patterns: Sequence[PiiPattern]) -> Column:
    """True when some pattern still matches."""
    return reduce(lambda a, b: a | b, [text.rlike(p.regex) for p in patterns])


def _totals(patterns: Sequence[PiiPattern]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(_count(p.pii_type)) for p in patterns])


def mask_documents(
    docs: DataFrame, text: str = "text", patterns: Sequence[PiiPattern] = PII_PATTERNS
) -> DataFrame:
    """Add masked_text, type_counts, detected_types (pattern order), replacement_count and passed.

    The residual check runs only on changed texts: an unchanged text already failed every pattern.
    """
    masked = apply_patterns(docs.withColumn("masked_text", F.col(text)), "masked_text", patterns)
    counts = F.array_compact(
        F.array(*[
            F.when(
                F.col(_count(p.pii_type)) > 0,
                F.struct(F.lit(p.pii_type).alias("pii_type"), F.col(_count(p.pii_type)).alias("n")),
            )
            for p in patterns
        ])
    )
    masked = masked.withColumn("type_counts", counts).withColumn("replacement_count", _totals(patterns))
    masked = masked.withColumn("detected_types", F.transform("type_counts", lambda t: t["pii_type"]))
    passed = F.when(F.col("replacement_count") == 0, F.lit(True)).otherwise(
        ~residual(F.col("masked_text"), patterns)
    )
    return masked.withColumn("passed", passed).drop(*[_count(p.pii_type) for p in patterns])


def mask_pages(
    pages: DataFrame,
    doc: str = "doc_id",
    page: str = "page_no",
    text: str = "text",
    patterns: Sequence[PiiPattern] = PII_PATTERNS,
) -> DataFrame:
    """Mask every page while numbering placeholders over the whole document.

    Numbers depend on earlier pages, so counts come first: every pattern looks through every page once. Only pages in
    which something was found are then masked. The first pattern sees raw text; its numbers are fixed before
    the rest run, because their width can matter to later patterns.
    """
    first, rest = patterns[0], patterns[1:]
    raw = pages.withColumn("masked_text", F.col(text))
    n_first = F.when(
        _triggers(F.col("masked_text"))[first.needs], F.regexp_count("masked_text", F.lit(first.regex))
    ).otherwise(F.lit(0))
    started = _with_offsets(raw, raw.select(doc, page, n_first.alias(_count(first.pii_type))), doc, page, [first])
    named = apply_patterns(started, "masked_text", [first], _offset_columns([first]), F.col("_busy")).drop("_busy", *_offset_names([first]))
    counts = apply_patterns(named, "masked_text", rest).select(doc, page, *[_count(p.pii_type) for p in rest])
    placed = _with_offsets(named, counts, doc, page, rest)
    final = apply_patterns(placed, "masked_text", rest, _offset_columns(rest), F.col("_busy"))
    final = final.withColumn("replacement_count", _totals(patterns))
    passed = F.when(F.col("replacement_count") == 0, F.lit(True)).otherwise(
        ~residual(F.col("masked_text"), patterns)
    )
    return final.withColumn("passed", passed).drop("_busy", *_offset_names(rest))


def _offset_names(patterns: Sequence[PiiPattern]) -> list[str]:
    return [f"{_count(p.pii_type)}_before" for p in patterns]


def _offset_columns(patterns: Sequence[PiiPattern]) -> dict[str, Column]:
    return {p.pii_type: F.coalesce(F.col(n), F.lit(0)) for p, n in zip(patterns, _offset_names(patterns))}


def _with_offsets(
    pages: DataFrame, counts: DataFrame, doc: str, page: str, patterns: Sequence[PiiPattern]
) -> DataFrame:
    """Join the number each page starts from. Only counts travel through the prefix sums, and only
    pages that have something to number take part in the join, so texts are not sorted by document."""
    names = [_count(p.pii_type) for p in patterns]
    offsets = running_offsets(counts, [doc], page, names)
    busy = offsets.filter(reduce(lambda a, b: a + b, [F.col(n) for n in names]) > 0)
    placed = pages.join(busy.select(doc, page, F.lit(True).alias("_busy"), *_offset_names(patterns)), [doc, page], "left")
    return placed.withColumn("_busy", F.coalesce("_busy", F.lit(False)))


def page_profile(masked_pages: DataFrame, doc: str = "doc_id", page: str = "page_no",
                 patterns: Sequence[PiiPattern] = PII_PATTERNS) -> DataFrame:
    """Document row over masked pages: types in first-seen order, replacements, passed, pages."""
    first_page = [
        F.min(F.when(F.col(_count(p.pii_type)) > 0, F.col(page))).alias(f"_p_{p.pii_type}") for p in patterns
    ]
    agg = masked_pages.groupBy(doc).agg(
        F.count(F.lit(1)).alias("page_count"),
        F.sum("replacement_count").alias("replacement_count"),
        F.bool_and("passed").alias("passed"),
        *first_page,
    )
    seen = F.array_sort(
        F.array_compact(
            F.array(*[
                F.when(
                    F.col(f"_p_{p.pii_type}").isNotNull(),
                    F.struct(F.col(f"_p_{p.pii_type}").alias("page"), F.lit(i).alias("ord"), F.lit(p.pii_type).alias("t")),
                )
                for i, p in enumerate(patterns)
            ])
        )
    )
    return agg.withColumn("detected_types", F.transform(seen, lambda s: s["t"])).drop(
        *[f"_p_{p.pii_type}" for p in patterns]
    )


def pii_spans(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", patterns: Sequence[PiiPattern] = PII_PATTERNS
) -> DataFrame:
    """Non-overlapping spans on the unmasked text: earliest first, longest first, in one sweep.

    A rejected span must not move the cursor, so the sweep is a fold over the row's own spans.
    """
    triggers = _triggers(F.col(text))
    found = []
    for order, p in enumerate(patterns):
        hits = F.transform(spans(F.col(text), p.regex, p.prefix_groups), _value_span(p, order))
        found.append(F.when(triggers[p.needs], hits).otherwise(F.array().cast(f"array<{_SWEEP}>")))
    rows = docs.select(doc, F.array_sort(F.concat(*found)).alias("_all"))

    def sweep(cursor: Column, s: Column) -> tuple[Column, Column]:
        keep = s["start"] >= cursor
        return F.when(keep, s["stop"]).otherwise(cursor), F.when(keep, s)

    kept = rows.select(doc, F.inline_outer(fold_rows(F.col("_all"), F.lit(-1), sweep, _SWEEP))).filter("start IS NOT NULL")
    nth = F.row_number().over(W.partitionBy(doc, "pii_type").orderBy("start"))
    return kept.select(
        doc,
        "pii_type",
        F.col("start").alias("char_start"),
        F.col("stop").alias("char_end"),
        F.concat(F.lit("["), F.upper("pii_type"), F.lit("_"), nth.cast("string"), F.lit("]")).alias("replacement"),
    )


def _value_span(p: PiiPattern, order: int):
    """Build the per-match mapper: the masked value starts after the kept prefix."""

    def shape(s: Column) -> Column:
        start = s["start"] + s["kept"]
        return F.struct(
            start.alias("start"), (start - s["stop"]).alias("neg_len"), F.lit(order).alias("ord"),
            s["stop"].alias("stop"), F.lit(p.pii_type).alias("pii_type"),
        )

    return shape


_SWEEP = "struct<start:int,neg_len:int,ord:int,stop:int,pii_type:string>"


def outbound_gate(payloads: DataFrame, text: str = "text", patterns: Sequence[PiiPattern] = PII_PATTERNS) -> DataFrame:
    """Flag payloads that must not leave: any match before or after masking blocks them."""
    triggers = _triggers(F.col(text))
    hit = reduce(lambda a, b: a | b, [triggers[p.needs] & F.col(text).rlike(p.regex) for p in patterns])
    return payloads.withColumn("blocked", hit).withColumn(
        "error_code", F.when(F.col("blocked"), F.lit("OUTBOUND_PII_BLOCKED"))
    )


def pii_profile(masked: DataFrame) -> DataFrame:
    """Corpus profile: documents and replacements per detected type."""
    return masked.select(F.explode_outer("type_counts").alias("_t")).filter("_t IS NOT NULL").groupBy(
        F.col("_t.pii_type").alias("pii_type")
    ).agg(F.count(F.lit(1)).alias("documents"), F.sum("_t.n").alias("replacements"))
