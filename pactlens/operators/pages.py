"""Page-level operators: assembly with bounds, page ranges, repeated margins, point location."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.constants import MARGIN_LINES, MARGIN_MIN_PAGES, MAX_DOCUMENT_CHARS
from pactlens.functions.text import is_blank, leading_space, margin_key, strip
from pactlens.operators.prefix import running_offsets, salted_join, top_rows
from pactlens.packs.model import WS

BIN = 4096

# Every character or pair that ends a line.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def clean_page(text: Column) -> Column:
    """Remove NUL characters and surrounding whitespace. Only texts with such a first or last character pay for the search."""
    plain = F.translate(text, "\x00", "")
    edges = F.concat(F.substring(plain, 1, 1), F.substring(plain, -1, 1))
    return F.when(edges.rlike(WS), strip(plain)).otherwise(plain)


def assemble_pages(
    pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text",
    max_chars: int = MAX_DOCUMENT_CHARS, cleaned: bool = False,
) -> DataFrame:
    """Join the pages of each document into one text, or give an error code.

    The length verdict is computed first from page lengths alone, with map-side combine; only
    documents within the bound are ever collected, so one huge document cannot fill a task.
    ``text`` skips empty pages (extraction text); ``page_text`` keeps them (analysed text). ``cleaned`` says that the pages are clean.
    """
    clean = pages.withColumn("_t", F.col(text) if cleaned else clean_page(F.col(text)))
    size = F.length("_t")
    sizes = clean.groupBy(doc).agg(
        F.count(F.lit(1)).alias("page_count"),
        (F.sum(size) + F.sum(F.when(size > 0, 1).otherwise(0)) - 1).alias("text_chars"),
        F.sum(F.when(size > 0, 1).otherwise(0)).alias("_visible"),
    )
    verdict = sizes.select(
        doc,
        "page_count",
        F.greatest("text_chars", F.lit(0)).alias("text_chars"),
        F.when(F.col("_visible") == 0, F.lit("TEXT_EMPTY"))
        .when(F.col("text_chars") > max_chars, F.lit("TEXT_TOO_LONG"))
        .alias("error_code"),
    )
    accepted = salted_join(
        clean.select(doc, page, "_t"), verdict.filter("error_code IS NULL").select(doc), [doc], "left_semi", [page]
    )
    ordered = accepted.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(page, "_t"))).alias("_p"))
    texts = ordered.select(
        doc,
        F.array_join(F.filter(F.transform("_p", lambda s: s["_t"]), lambda t: t != ""), "\n").alias("text"),
        F.array_join(F.transform("_p", lambda s: s["_t"]), "\n").alias("page_text"),
    )
    return verdict.join(texts, doc, "left")


def page_ranges(
    pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text"
) -> DataFrame:
    """Offsets of each page in the newline-joined document."""
    sized = pages.select(doc, page, (F.length(text) + 1).alias("_step"))
    start = F.col("_step_before")
    return running_offsets(sized, [doc], page, ["_step"]).select(
        doc, page, start.alias("char_start"), (start + F.col("_step") - 1).alias("char_end")
    )


def page_of(
    points: DataFrame, ranges: DataFrame, doc: str = "doc_id", page: str = "page_no", offset: str = "offset"
) -> DataFrame:
    """Attach the page holding each offset; both page ends count, offsets past the end take the last page.

    Ranges are cut into fixed bins and joined on (document, bin), so a document with very many
    pages is spread over tasks instead of being compared page by page.
    """
    total = ranges.groupBy(doc).agg(F.max("char_end").alias("_end"))
    clamped = points.join(total, doc, "left").withColumn("_o", F.least(F.col(offset).cast("long"), F.col("_end")))
    binned = ranges.select(
        doc, F.col(page).alias("page_number"), F.col("char_start").alias("_s"), F.col("char_end").alias("_e"),
        F.explode(F.sequence(F.floor(F.col("char_start") / BIN), F.floor(F.col("char_end") / BIN))).alias("_bin"),
    )
    keyed = clamped.withColumn("_bin", F.floor(F.col("_o") / BIN))
    return (
        keyed.join(binned, [doc, "_bin"], "left")
        .filter(F.col("_s").isNull() | F.col("_o").between(F.col("_s"), F.col("_e")))
        .drop("_bin", "_s", "_e", "_o", "_end")
    )


def page_fragments(
    matches: DataFrame, ranges: DataFrame, pages: DataFrame, doc: str, key: list[str], page: str = "page_no", keep: int = 2,
    text: str = "text", cleaned: bool = False,
) -> DataFrame:
    """Page-local pieces of matches that may cross pages; blank pieces are skipped before the cap.

    ``matches`` needs match_start and match_end (absolute). Overlaps are found on offsets alone; each piece is then cut from its
    own page's text in ``pages``, so documents of any length work and no text is copied per bin. ``cleaned`` says that the pages are clean.
    """
    left = matches.withColumn(
        "_bin",
        F.explode(
            F.sequence(
                F.floor(F.col("match_start") / BIN), F.floor(F.greatest("match_start", F.col("match_end") - 1) / BIN)
            )
        ),
    )
    right = ranges.select(
        doc, F.col(page).alias("page_number"), F.col("char_start").alias("_s"), F.col("char_end").alias("_e"),
        F.explode(F.sequence(F.floor(F.col("char_start") / BIN), F.floor(F.col("char_end") / BIN))).alias("_bin"),
    )
    lo, hi = F.greatest("match_start", "_s"), F.least("match_end", "_e")
    pairs = (
        left.join(right, [doc, "_bin"])
        # Count a pair once: in the bin where the overlap begins.
        .filter((lo < hi) & (F.floor(lo / BIN) == F.col("_bin")))
        .select(*dict.fromkeys([doc, *key]), "page_number", (lo - F.col("_s")).alias("_lo"), (hi - lo).alias("_n"))
    )
    own = pages.select(doc, F.col(page).alias("page_number"), (F.col(text) if cleaned else clean_page(F.col(text))).alias("_text"))
    cut = F.expr("substring(_text, cast(_lo + 1 as int), cast(_n as int))")
    pairs = pairs.join(own, [doc, "page_number"]).withColumn("fragment", strip(cut)).filter(~is_blank(F.col("fragment")))
    return top_rows(pairs.select(*key, "page_number", "fragment"), key, ["page_number"], keep, "fragment_no")


def margin_lines(pages: DataFrame, doc: str, page: str, text: str, edge: int = MARGIN_LINES) -> DataFrame:
    """The first and last ``edge`` lines of each page with their comparable key."""
    lines = pages.select(doc, page, F.split(text, LINE_BREAK, -1).alias("_l"))
    # A trailing line break does not open another line.
    lines = lines.withColumn(
        "_l", F.when(F.element_at("_l", -1) == "", F.slice("_l", F.lit(1), F.size("_l") - 1)).otherwise(F.col("_l"))
    )
    n = F.size("_l")
    edges = F.array_distinct(
        F.concat(
            F.filter(F.sequence(F.lit(1), F.least(F.lit(edge), n)), lambda i: i <= n),
            F.filter(F.sequence(F.greatest(F.lit(1), n - edge + 1), F.greatest(F.lit(1), n)), lambda i: i <= n),
        )
    )
    return (
        lines.filter(n > 0)
        .select(doc, page, F.explode(F.transform(edges, lambda i: F.struct(i.alias("line_no"), F.get("_l", i - 1).alias("line")))).alias("_x"))
        .select(doc, page, "_x.line_no", margin_key(F.col("_x.line")).alias("line_key"))
        .filter(F.col("line_key") != "")
    )


def repeated_margins(
    pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text",
    edge: int = MARGIN_LINES, min_pages: int = MARGIN_MIN_PAGES,
) -> DataFrame:
    """Margin lines seen on at least ``min_pages`` pages of a document."""
    return (
        margin_lines(pages, doc, page, text, edge)
        .select(doc, page, "line_key").distinct()
        .groupBy(doc, "line_key").agg(F.count(F.lit(1)).alias("page_count"))
        .filter(F.col("page_count") >= min_pages)
    )


def remove_margins(
    pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text",
    edge: int = MARGIN_LINES, min_pages: int = MARGIN_MIN_PAGES,
) -> DataFrame:
    """Drop repeated headers and footers, in margins only, and trim the pages."""
    repeated = repeated_margins(pages, doc, page, text, edge, min_pages).select(doc, "line_key")
    marks = (
        salted_join(margin_lines(pages, doc, page, text, edge), repeated, [doc, "line_key"], "left_semi", [page])
        .groupBy(doc, page).agg(F.collect_set("line_no").alias("_drop"))
    )
    lines = F.split(F.col(text), LINE_BREAK, -1)
    kept = F.filter(
        F.transform(lines, lambda v, i: F.struct(v.alias("v"), (i + 1).alias("i"))),
        lambda s: F.col("_drop").isNull() | ~F.array_contains("_drop", s["i"]),
    )
    return (
        pages.join(marks, [doc, page], "left")
        .withColumn(text, strip(F.array_join(F.transform(kept, lambda s: s["v"]), "\n")))
        .drop("_drop")
    )
