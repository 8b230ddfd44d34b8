"""Column expressions over text. Offsets are 0-based, half-open and count code points."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.constants import MAX_EXCERPT, MAX_SENTENCE, SUMMARY_FORBIDDEN
from pactlens.packs.model import DIGIT, NOT_WS, WS

# Whitespace other than the plain space: far fewer hits to replace in ordinary prose.
OTHER_WS = WS.replace(r"\x20", r"\x1f")
ABBREVIATION_TAIL = "[ ,·]+$"
SPAN = "struct<start:int,stop:int,hit:string,kept:int>"
#: Items whose rows are collected before the parts are put together.
FOLD_ROWS = 32


def same_length_space(text: Column) -> Column:
    """Turn every whitespace character into a space, keeping all offsets valid."""
    return F.regexp_replace(text, OTHER_WS, " ")


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def leading_space(text: Column) -> Column:
    """Number of whitespace characters at the start of the text."""
    return F.coalesce(F.length(F.regexp_substr(text, F.lit(f"^{WS}+"))), F.lit(0))


def squeeze(text: Column) -> Column:
    """Collapse whitespace runs to one space and strip."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def is_blank(text: Column) -> Column:
    """True when no visible character is present."""
    return ~text.rlike(NOT_WS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body and its lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_rows(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """Walk an array with a running state and collect what ``step`` emits, in time proportional to its length.

    ``step(state, item)`` gives the next state and a struct of type ``kind``, or null for nothing. Appending copies an array, so rows are
    collected for ``FOLD_ROWS`` items at a time and the parts are put together at the end.
    """
    none = F.array().cast(f"array<{kind}>").alias("out")

    def inner(acc: Column, item: Column) -> Column:
        after, row = step(acc["s"], item)
        return F.struct(after.alias("s"), F.when(row.isNull(), acc["out"]).otherwise(F.array_append(acc["out"], row)).alias("out"))

    def outer(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc["s"].alias("s"), none), inner)
        return let(done, lambda d: F.struct(d["s"].alias("s"), F.array_append(acc["parts"], d["out"]).alias("parts")))

    last = lambda p: F.greatest(F.floor((F.size(p) - 1) / FOLD_ROWS), F.lit(0)).cast("int")
    parts = let(items, lambda p: F.transform(F.sequence(F.lit(0), last(p)), lambda b: F.slice(p, b * FOLD_ROWS + 1, F.lit(FOLD_ROWS))))
    start = F.struct(state.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("parts"))
    return F.flatten(F.aggregate(parts, start, outer, lambda acc: acc["parts"]))


def spans(text: Column, regex: str, kept_groups: Sequence[int] = ()) -> Column:
    """All matches of ``regex`` with offsets, as an array built inside the row.

    ``split`` and ``regexp_extract_all`` run once each; the fold only adds lengths. ``kept`` is the length of what the groups
    ``kept_groups`` hold at the start of the match.
    """
    sizes = [F.transform(F.regexp_extract_all(text, F.lit(regex), F.lit(i)), lambda g: F.length(g)) for i in kept_groups]
    kept = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))), sizes) if sizes else None
    hits = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    named = F.transform(hits, lambda h: F.struct(h.alias("hit"), F.lit(0).alias("kept"))) if kept is None else F.zip_with(
        hits, kept, lambda h, k: F.struct(h.alias("hit"), F.coalesce(k, F.lit(0)).alias("kept"))
    )
    pairs = F.zip_with(F.split(text, regex, -1), named, lambda gap, n: F.struct(F.length(gap).alias("gap"), n["hit"].alias("hit"), n["kept"].alias("kept")))

    def step(pos: Column, pair: Column) -> tuple[Column, Column]:
        start = pos + pair["gap"]
        stop = start + F.length(pair["hit"])
        row = F.struct(start.alias("start"), stop.alias("stop"), pair["hit"].alias("hit"), pair["kept"].alias("kept"))
        return F.coalesce(stop, start), F.when(pair["hit"].isNotNull(), row)

    return F.when(text.rlike(regex), fold_rows(pairs, F.lit(0), step, SPAN)).otherwise(F.array().cast(f"array<{SPAN}>"))


def first_match(text: Column, pattern: Column) -> Column:
    """Leftmost match as (start, stop, hit), or NULL; ``pattern`` may vary by row."""
    hit = F.regexp_substr(text, pattern)
    start = F.length(F.element_at(F.split(text, pattern, 2), 1))
    return F.when(
        hit.isNotNull(),
        F.struct(start.alias("start"), (start + F.length(hit)).alias("stop"), hit.alias("hit")),
    )


def sentence_left(text: Column, start: Column) -> Column:
    """Start of the sentence that holds ``start``: after the last mark, then after spaces."""
    prefix = F.substring(text, F.lit(1), start)
    return F.coalesce(F.length(F.regexp_substr(prefix, F.lit(f"(?s)^(?:.*[.!?])?{WS}*"))), F.lit(0))


def sentence_right(text: Column, stop: Column) -> Column:
    """End of the sentence: just past the first mark at or after ``stop``, else the text end."""
    rest = F.substring(text, stop + 1, F.length(text))
    upto = F.length(F.regexp_substr(rest, F.lit("^[^.!?]*[.!?]")))
    return F.coalesce(stop + upto, F.length(text))


def margin_key(line: Column) -> Column:
    """Comparable form of a header or footer line: squeezed, digits masked, lower case."""
    return F.lower(F.regexp_replace(squeeze(line), f"{DIGIT}+", "#"))


def alnum_ratio(text: Column) -> Column:
    """Share of letters and digits among the visible characters (0 when there are none)."""
    visible = F.regexp_replace(text, WS, "")
    alnum = F.length(F.regexp_replace(visible, r"[^\p{L}\p{N}]", ""))
    return F.when(F.length(visible) > 0, alnum / F.length(visible)).otherwise(F.lit(0.0))


def usable_text(text: Column, min_chars: int, min_ratio: float) -> Column:
    """Text-quality gate: enough visible characters and enough of them alphanumeric."""
    visible = F.length(F.regexp_replace(text, WS, ""))
    return (visible >= min_chars) & (alnum_ratio(text) >= F.lit(min_ratio))


def cut(text: Column, limit: int, keep: int) -> Column:
    """Shorten to ``keep`` characters plus an ellipsis when longer than ``limit``."""
    head = F.regexp_replace(F.substring(text, 1, keep), ABBREVIATION_TAIL, "")
    return F.when(F.length(text) > limit, F.concat(head, F.lit("…"))).otherwise(text)


def bounded(sentence: Column) -> Column:
    """Clean a sentence, soften conclusions, and keep it within the sentence limit."""
    text = squeeze(sentence)
    for term in SUMMARY_FORBIDDEN:
        text = F.replace(text, F.lit(term), F.lit("추가 검토"))
    return cut(text, MAX_SENTENCE, MAX_SENTENCE - 2)


def excerpt(text: Column) -> Column:
    """A display excerpt of at most the excerpt limit."""
    return cut(squeeze(text), MAX_EXCERPT, MAX_EXCERPT - 1)


# What counts as a percentage, an amount of money or a duration.
FACT_PATTERNS = (
    rf"(?<!{DIGIT}){DIGIT}+(?:\.{DIGIT}+)?{WS}*%",
    rf"(?<!{DIGIT}){DIGIT}{{1,3}}(?:,{DIGIT}{{3}})*(?:\.{DIGIT}+)?{WS}*(?:원|만원|억원)",
    rf"(?<!{DIGIT}){DIGIT}+{WS}*(?:일|개월|년)(?:{WS}*(?:이내|이상|이하|간))?",
)


def facts(text: Column, actors: Sequence[str], patterns: Sequence[str] = FACT_PATTERNS, keep: int = 3) -> Column:
    """First ``keep`` distinct facts by position: pattern hits plus first mention of each actor."""
    located = [
        F.transform(spans(text, p), lambda s: F.struct(s["start"].alias("pos"), squeeze(s["hit"]).alias("value")))
        for p in patterns
    ]
    named = [
        F.when(F.instr(text, a) > 0, F.struct((F.instr(text, a) - 1).alias("pos"), F.lit(a).alias("value")))
        for a in actors
    ]
    ordered = F.array_sort(F.concat(*located, F.array_compact(F.array(*named))))
    return F.slice(F.array_distinct(F.transform(ordered, lambda s: s["value"])), 1, keep)


def object_particle(word: Column) -> Column:
    """Korean object particle, chosen by whether the last syllable has a final consonant."""
    code = F.ascii(F.right(word, F.lit(1))) - 0xAC00
    closed = code.between(0, 11171) & (code % 28 != 0)
    return F.when(closed, F.lit("을")).otherwise(F.lit("를"))


def locate_compact(df: DataFrame, text: str, target: str, out: str = "located") -> DataFrame:
    """Add ``out``: where ``target`` occurs in ``text`` ignoring whitespace and case, or NULL.

    The match is found on the compacted strings, then mapped back by walking the words once; offsets
    refer to ``text``. Case folding is ``lower``, which differs from full folding only for a few
    letters such as ß. Positions are computed in their own projection, so the walk only adds numbers.
    """
    needle = F.lower(F.regexp_replace(target, WS, ""))
    placed = df.withColumn("_needle", F.length(needle)).withColumn(
        "_at", F.when(F.length(needle) > 0, F.instr(F.lower(F.regexp_replace(text, WS, "")), needle) - 1)
    )
    words = F.zip_with(
        F.split(text, f"{WS}+", -1),
        F.regexp_extract_all(text, F.lit(f"{WS}+"), F.lit(0)),
        lambda w, g: F.struct(F.length(w).alias("size"), F.coalesce(F.length(g), F.lit(0)).alias("gap")),
    )
    zero = F.struct(*[F.lit(v).alias(n) for n, v in (("seen", 0), ("pos", 0), ("start", -1), ("stop", -1))])
    last = F.col("_at") + F.col("_needle") - 1

    def step(acc: Column, w: Column) -> Column:
        def inside(k: Column) -> Column:
            return (k >= acc["seen"]) & (k < acc["seen"] + w["size"])

        return F.struct(
            (acc["seen"] + w["size"]).alias("seen"),
            (acc["pos"] + w["size"] + w["gap"]).alias("pos"),
            F.when(inside(F.col("_at")), acc["pos"] + F.col("_at") - acc["seen"]).otherwise(acc["start"]).alias("start"),
            F.when(inside(last), acc["pos"] + last - acc["seen"] + 1).otherwise(acc["stop"]).alias("stop"),
        )

    walked = F.aggregate(words, zero, step, lambda a: F.struct(a["start"].alias("start"), a["stop"].alias("stop")))
    return placed.withColumn(out, F.when(F.col("_at") >= 0, walked)).drop("_needle", "_at")
