"""Queries over text: masking, pages, sections, screening, locating, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.constants import DEFAULT_RIGHT_NAME, LINE_FORBIDDEN, MASKING_FAILED_WARNING, MAX_SUMMARY_LINE, RIGHT_NAMES
from pactlens.functions import text as tx
from pactlens.operators import lifecycle, masking, pages, screen, segment, summarize
from pactlens.operators.prefix import spread
from pactlens.packs.defaults import LATIN_RULES, LATIN_SECTIONS
from pactlens.packs.model import RulePack
from pactlens.plans import review, sqltext as q
from pactlens.plans.tables import LATIN, documents, sha, source_pages, table, turns

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

LATIN_FACTS = (r"(?<!\p{Nd})\p{Nd}+(?:\.\p{Nd}+)?\s*%".replace(r"\s", tx.WS), "[Vv]ersion [0-9.]+", r"[a-z]+\.[0-9]{2}@")
LATIN_ACTORS = ["License", "token", "the ", "mail", " que "]
NEUTRAL = RulePack("1.0.0", [{**r, "negative_patterns": [], "negative_pattern_groups": []} for r in LATIN_RULES.rules])


def query(sql: str | None = None):
    """Register a query under its function name, with its oracle when there is one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _strings(c: str):
    return F.array_join(c, ",")


_MASK, _M = q.mask_chain("documents", "doc_id")
_DETECTED = "concat_ws(',', " + ", ".join(f"CASE WHEN n_{t} > 0 THEN '{t}' END" for t in q.TYPES) + ")"
_TOTAL = " + ".join(f"n_{t}" for t in q.TYPES)
_SEC, _S = q.sections("documents", "doc_id")
_MSEC, _MS = q.sections("mt", "doc_id", "text")
_CLAUSES = f"{_MASK}, mt AS (SELECT doc_id, t AS text FROM {_M}), {_MSEC}, cl AS (SELECT * FROM {_MS} WHERE analyzable)"
_RULES, _R = q.rule_hits("cl", "doc_id, clause_ord", LATIN_RULES.select(None))


def _masked(spark: SparkSession, sf: str) -> DataFrame:
    return review.masked_documents(documents(spark, sf), LATIN)


def _clauses(spark: SparkSession, sf: str) -> DataFrame:
    return review.clauses_of(_masked(spark, sf), LATIN)


@query(f"""WITH {_MASK}
SELECT doc_id, sha256(t) AS masked_sha, {_TOTAL} AS replacement_count, {_DETECTED} AS detected_types,
  NOT {q.leftover('t')} AS passed FROM {_M}""")
def mask_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered masking of every document."""
    m = masking.mask_documents(documents(spark, sf))
    return m.select(
        "doc_id", sha("masked_text").alias("masked_sha"), F.col("replacement_count").cast("long").alias("replacement_count"),
        _strings("detected_types").alias("detected_types"), "passed",
    )


@query(f"WITH {_MASK} " + " UNION ALL ".join(
    f"SELECT '{t}' AS pii_type, CAST(count(*) AS BIGINT) AS documents, CAST(sum(n_{t}) AS BIGINT) AS replacements FROM {_M} WHERE n_{t} > 0 HAVING count(*) > 0"
    for t in q.TYPES))
def pii_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data per type over the corpus."""
    return masking.pii_profile(masking.mask_documents(documents(spark, sf)))


_P1, _PM = q.mask_chain("documents", "source, doc_id", prefix="a")
_P2, _PF = q.mask_chain("src", "source, doc_id", prefix="b", offsets=True)
_OFF = ", ".join(
    f"CAST(coalesce(sum(n_{t}) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o_{t}"
    for t in q.TYPES
)


@query(f"""WITH {_P1}, offs AS (SELECT source, doc_id, {_OFF} FROM {_PM}),
src AS (SELECT o.*, d.text FROM offs o JOIN documents d ON d.doc_id = o.doc_id), {_P2}
SELECT source, doc_id AS page_no, sha256(t) AS masked_sha, {_TOTAL} AS replacement_count FROM {_PF}""")
def pii_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Masking with numbers that run over all pages of a source."""
    m = masking.mask_pages(source_pages(spark, sf), "source", "page_no")
    return m.select("source", "page_no", sha("masked_text").alias("masked_sha"), F.col("replacement_count").cast("long").alias("replacement_count"))


@query(f"""WITH {_P1} SELECT source, CAST(count(*) AS BIGINT) AS page_count, CAST(sum({_TOTAL}) AS BIGINT) AS replacement_count,
 (SELECT coalesce(string_agg(ty, ',' ORDER BY pg, o), '') FROM ({" UNION ALL ".join(
     f"SELECT '{t}' AS ty, {i} AS o, source AS s2, min(doc_id) AS pg FROM {_PM} WHERE n_{t} > 0 GROUP BY source" for i, t in enumerate(q.TYPES))})
  WHERE s2 = {_PM}.source) AS detected_types
FROM {_PM} GROUP BY source""")
def pii_page_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Document row over masked pages: types in first-seen order and totals."""
    m = masking.mask_pages(source_pages(spark, sf), "source", "page_no")
    p = masking.page_profile(m, "source", "page_no")
    return p.select("source", "page_count", "replacement_count", _strings("detected_types").alias("detected_types"))


_SPANS = " UNION ALL ".join(
    f"""SELECT doc_id, {i} AS o, '{t}' AS pii_type, sp.st AS st, sp.en AS en FROM (
 SELECT doc_id, unnest(list_transform(range(1, len(h) + 1), lambda k: {{'st': CAST(list_sum(list_transform(p[1:k], lambda x: length({q.unwrap('x')}))) AS BIGINT)
   + CAST(coalesce(list_sum(list_transform(h[1:k-1], lambda x: length({q.unwrap('x')}))), 0) AS BIGINT),
   'en': CAST(list_sum(list_transform(p[1:k], lambda x: length({q.unwrap('x')}))) AS BIGINT)
   + CAST(list_sum(list_transform(h[1:k], lambda x: length({q.unwrap('x')}))) AS BIGINT)}})) AS sp
 FROM (SELECT doc_id, string_split_regex({s}, '{rx}') AS p, regexp_extract_all({s}, '{rx}') AS h FROM w))"""
    for i, (t, rx, s) in enumerate([("email", q.EMAIL, "text"), *[(n, rx, "wt") for n, rx in q.NUMBERS]])
)


@query(f"""WITH RECURSIVE w AS (SELECT doc_id, text, {q.wrap('text')} AS wt FROM documents WHERE regexp_matches(text, '[0-9]{{2}}|@')),
allspans AS ({_SPANS}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY st, en DESC, o) AS k FROM allspans),
sweep AS (
 SELECT doc_id, k, pii_type, st, en, true AS keep, en AS cur FROM ranked WHERE k = 1
 UNION ALL
 SELECT r.doc_id, r.k, r.pii_type, r.st, r.en, r.st >= s.cur, CASE WHEN r.st >= s.cur THEN r.en ELSE s.cur END
 FROM sweep s JOIN ranked r ON r.doc_id = s.doc_id AND r.k = s.k + 1)
SELECT doc_id, pii_type, st AS char_start, en AS char_end,
 '[' || upper(pii_type) || '_' || row_number() OVER (PARTITION BY doc_id, pii_type ORDER BY st) || ']' AS replacement
FROM sweep WHERE keep""")
def pii_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Original spans for redaction, overlaps removed in one sweep."""
    s = masking.pii_spans(documents(spark, sf))
    return s.select("doc_id", "pii_type", F.col("char_start").cast("long"), F.col("char_end").cast("long"), "replacement")


@query(f"SELECT doc_id, {q.leftover('text')} AS blocked, CASE WHEN {q.leftover('text')} THEN 'OUTBOUND_PII_BLOCKED' END AS error_code FROM documents")
def outbound_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Which documents may leave unmasked."""
    return masking.outbound_gate(documents(spark, sf)).select("doc_id", "blocked", "error_code")


@query(f"""WITH {_SEC} SELECT doc_id, clause_ord, number, label, section_type, section_id, analyzable, char_start, char_end,
 sha256(text) AS text_sha FROM {_S}""")
def sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of every document with exact offsets."""
    s = segment.segment(documents(spark, sf), pack=LATIN_SECTIONS)
    ints = ["clause_ord", "number", "char_start", "char_end"]
    return s.select("doc_id", *[F.col(c).cast("long") for c in ints], "label", "section_type", "section_id", "analyzable", sha("text").alias("text_sha"))


_SUB, _U = q.subclauses(_S, "doc_id, clause_ord")


@query(f"WITH {_SEC}, {_SUB} SELECT doc_id, clause_ord, sub_ord, label, char_start, char_end FROM {_U}")
def subsections(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered items inside sections."""
    s = segment.subsegment(segment.segment(documents(spark, sf), pack=LATIN_SECTIONS), LATIN_SECTIONS)
    return s.select("doc_id", *[F.col(c).cast("long") for c in ("clause_ord", "sub_ord", "char_start", "char_end")], "label")


@query(f"""WITH {_SEC} SELECT doc_id, clause_ord, length(text) AS chars,
 CASE WHEN NOT regexp_matches(text, '{q.NOT_WS}') THEN 'CLAUSE_EMPTY' WHEN length(text) > 20000 THEN 'CLAUSE_TOO_LONG' END AS error_code
FROM {_S} WHERE analyzable""")
def clause_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Blank and oversized clauses."""
    c = segment.analyzable(segment.segment(documents(spark, sf), pack=LATIN_SECTIONS))
    return segment.clause_gate(c).select("doc_id", F.col("clause_ord").cast("long"), F.length("text").cast("long").alias("chars"), "error_code")


_RANGES = """pr AS (SELECT conv_id, turn, text, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cs,
 length(text) AS len FROM conversations)"""


@query(f"WITH {_RANGES} SELECT conv_id, turn AS page_no, cs AS char_start, cs + len AS char_end FROM pr")
def page_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Page offsets of multi-page documents."""
    return pages.page_ranges(turns(spark, sf), "conv_id")


@query(f"""WITH {_RANGES}, pts AS (SELECT conv_id, turn, k, CASE k WHEN 0 THEN cs + len WHEN 1 THEN cs + len // 2 ELSE cs + len + 5000 END AS o FROM pr, (SELECT unnest([0, 1, 2]) AS k)),
tot AS (SELECT conv_id, max(cs + len) AS e FROM pr GROUP BY conv_id)
SELECT p.conv_id, p.turn AS page_no, CAST(p.k AS BIGINT) AS k, p.o AS "offset", r.turn AS page_number FROM pts p JOIN tot t ON t.conv_id = p.conv_id
JOIN pr r ON r.conv_id = p.conv_id AND least(p.o, t.e) BETWEEN r.cs AND r.cs + r.len""")
def page_of(spark: SparkSession, sf: str) -> DataFrame:
    """The page of an offset: page ends, page middles, and points past the end."""
    ranges = pages.page_ranges(turns(spark, sf), "conv_id")
    size = F.col("char_end") - F.col("char_start")
    at = F.array(F.col("char_end"), F.col("char_start") + F.floor(size / 2), F.col("char_end") + 5000)
    points = ranges.select("conv_id", "page_no", F.posexplode(at).alias("k", "offset"))
    return pages.page_of(points, ranges, "conv_id").select(
        "conv_id", "page_no", F.col("k").cast("long"), "offset", "page_number"
    )


@query(f"""WITH {_RANGES}, j AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id),
m AS (SELECT conv_id, turn, cs + len // 2 AS ms, coalesce(lead(cs + len // 2, 2) OVER (PARTITION BY conv_id ORDER BY turn), cs + len) AS me FROM pr),
x AS (SELECT m.conv_id, m.turn, r.turn AS pn, {q.strip("substr(j.body, greatest(ms, r.cs) + 1, least(me, r.cs + r.len) - greatest(ms, r.cs))")} AS f
 FROM m JOIN pr r ON r.conv_id = m.conv_id AND greatest(ms, r.cs) < least(me, r.cs + r.len) JOIN j ON j.conv_id = m.conv_id),
y AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pn) AS n FROM x WHERE regexp_matches(f, '{q.NOT_WS}'))
SELECT conv_id, turn AS match_no, CAST(n AS BIGINT) AS fragment_no, pn AS page_number, sha256(f) AS fragment_sha FROM y WHERE n <= 2""")
def fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Two page-local pieces of matches that run over several pages."""
    t = turns(spark, sf)
    ranges = pages.page_ranges(t, "conv_id")
    mid = F.col("char_start") + F.floor((F.col("char_end") - F.col("char_start")) / 2)
    later = ranges.select("conv_id", (F.col("page_no") - 2).alias("page_no"), mid.alias("_later"))
    matches = (
        ranges.join(later, ["conv_id", "page_no"], "left")
        .select("conv_id", F.col("page_no").alias("match_no"), mid.alias("match_start"), F.coalesce("_later", "char_end").alias("match_end"))
    )
    f = pages.page_fragments(matches, ranges, t, "conv_id", ["conv_id", "match_no"])
    return f.select("conv_id", "match_no", F.col("fragment_no").cast("long"), "page_number", sha("fragment").alias("fragment_sha"))


_LINES = r"""ln AS (SELECT source, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i, len(l) AS n FROM (
 SELECT source, doc_id, CASE WHEN l[len(l)] = '' THEN l[1:len(l)-1] ELSE l END AS l FROM (
 SELECT source, doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS l FROM documents)))"""
_KEYED = f"""mk AS (SELECT source, doc_id, i, line, (i <= 5 OR i > n - 5) AS margin,
 lower(regexp_replace({q.squeeze('line')}, '[0-9]+', '#', 'g')) AS k FROM ln)"""
_REP = "rep AS (SELECT source, k, count(DISTINCT doc_id) AS c FROM mk WHERE margin AND k <> '' GROUP BY source, k HAVING count(DISTINCT doc_id) >= 2)"


@query(f"WITH {_LINES}, {_KEYED}, {_REP} SELECT source, sha256(k) AS line_sha, CAST(c AS BIGINT) AS page_count FROM rep")
def repeated_margins(spark: SparkSession, sf: str) -> DataFrame:
    """Header and footer lines repeated over the pages of a source."""
    r = pages.repeated_margins(source_pages(spark, sf), "source", "page_no")
    return r.select("source", sha("line_key").alias("line_sha"), "page_count")


@query(f"""WITH {_LINES}, {_KEYED}, {_REP},
kept AS (SELECT m.source, m.doc_id, string_agg(m.line, chr(10) ORDER BY m.i) AS t FROM mk m LEFT JOIN rep r ON r.source = m.source AND r.k = m.k
 WHERE NOT (m.margin AND r.k IS NOT NULL) GROUP BY m.source, m.doc_id)
SELECT d.source, d.doc_id AS page_no, sha256({q.strip("coalesce(kept.t, '')")}) AS text_sha FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id""")
def remove_margins(spark: SparkSession, sf: str) -> DataFrame:
    """Pages without repeated headers and footers."""
    r = pages.remove_margins(source_pages(spark, sf), "source", "page_no")
    return r.select("source", "page_no", sha("text").alias("text_sha"))


@query(f"""SELECT doc_id, sha256(lower(regexp_replace({q.squeeze('text')}, '[0-9]+', '#', 'g'))) AS key_sha FROM documents""")
def margin_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Comparable line form of whole texts."""
    return documents(spark, sf).select("doc_id", F.sha2(tx.margin_key(F.col("text")), 256).alias("key_sha"))


@query(f"""WITH c AS (SELECT conv_id, turn, {q.strip("replace(text, chr(0), '')")} AS t FROM conversations)
SELECT conv_id, CAST(count(*) AS BIGINT) AS page_count,
 CAST(greatest(sum(length(t)) + count(*) FILTER (t <> '') - 1, 0) AS BIGINT) AS text_chars,
 CASE WHEN count(*) FILTER (t <> '') = 0 THEN 'TEXT_EMPTY' WHEN sum(length(t)) + count(*) FILTER (t <> '') - 1 > 200000 THEN 'TEXT_TOO_LONG' END AS error_code,
 sha256(string_agg(t, chr(10) ORDER BY turn) FILTER (t <> '')) AS text_sha, sha256(string_agg(t, chr(10) ORDER BY turn)) AS page_text_sha
FROM c GROUP BY conv_id""")
def assemble_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Whole document texts from their pages, within the length bound."""
    a = pages.assemble_pages(turns(spark, sf), "conv_id")
    return a.select("conv_id", "page_count", "text_chars", "error_code", sha("text").alias("text_sha"), sha("page_text").alias("page_text_sha"))


@query(f"""WITH v AS (SELECT doc_id, regexp_replace(text, '{q.WS}', '', 'g') AS c FROM documents),
w AS (SELECT doc_id, length(c) AS chars, length(regexp_replace(c, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS a FROM v)
SELECT doc_id, chars, round(CASE WHEN chars > 0 THEN a / chars ELSE 0 END, 6) AS ratio,
 chars >= 10 AND CASE WHEN chars > 0 THEN a / chars ELSE 0 END >= 0.25 AS usable FROM w""")
def text_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Is the text usable: visible characters and their alphanumeric share."""
    t = F.col("text")
    return documents(spark, sf).select(
        "doc_id", F.length(F.regexp_replace(t, tx.WS, "")).cast("long").alias("chars"),
        F.round(tx.alnum_ratio(t), 6).alias("ratio"), tx.usable_text(t, 10, 0.25).alias("usable"),
    )


@query(f"""WITH {_CLAUSES}, {_RULES} SELECT doc_id, clause_ord, rule_id, match_start, match_end, matched_excerpt FROM {_R}""")
def screen_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Every clause against every rule."""
    f = screen.screen(_clauses(spark, sf), LATIN_RULES)
    return f.select("doc_id", F.col("clause_ord").cast("long"), "rule_id", F.col("match_start").cast("long"), F.col("match_end").cast("long"), "matched_excerpt")


@query(f"""WITH {_CLAUSES}, {_RULES} SELECT doc_id, clause_ord, rule_id, strength, context_count, risk_start, risk_end,
 array_to_string(list_transform(list_zip(labels, hits, starts, ends), lambda z: z[1] || '=' || z[2] || '@' || z[3] || '-' || z[4]), ';') AS elements FROM {_R}""")
def rule_strength(spark: SparkSession, sf: str) -> DataFrame:
    """Strength, sentence span and matched elements of each finding."""
    f = screen.screen(_clauses(spark, sf), LATIN_RULES)
    el = F.transform("elements", lambda e: F.concat(e["label"], F.lit("="), e["excerpt"], F.lit("@"), e["start"].cast("string"), F.lit("-"), e["stop"].cast("string")))
    return f.select("doc_id", *[F.col(c).cast("long") for c in ("clause_ord", "context_count", "risk_start", "risk_end")], "rule_id", "strength", F.array_join(el, ";").alias("elements"))


_ALLHITS, _AH = q.rule_hits("cl", "doc_id, clause_ord", NEUTRAL.select(None), negatives=False, prefix="z")


@query(f"""WITH {_CLAUSES}, {_RULES}, {_ALLHITS},
a AS (SELECT rule_id, count(*) AS n FROM {_AH} GROUP BY 1), b AS (SELECT rule_id, count(*) AS n FROM {_R} GROUP BY 1)
SELECT a.rule_id, CAST(a.n AS BIGINT) AS matched, CAST(coalesce(b.n, 0) AS BIGINT) AS reported, CAST(a.n - coalesce(b.n, 0) AS BIGINT) AS suppressed
FROM a LEFT JOIN b ON b.rule_id = a.rule_id""")
def suppression(spark: SparkSession, sf: str) -> DataFrame:
    """How many matches each rule's exceptions remove."""
    clauses = _clauses(spark, sf)
    a = screen.screen(clauses, NEUTRAL).groupBy("rule_id").agg(F.count(F.lit(1)).alias("matched"))
    b = screen.screen(clauses, LATIN_RULES).groupBy("rule_id").agg(F.count(F.lit(1)).alias("reported"))
    out = a.join(b, "rule_id", "left").withColumn("reported", F.coalesce("reported", F.lit(0)))
    return out.withColumn("suppressed", F.col("matched") - F.col("reported"))


_SUBSET = ["R51_LICENSE_NOTICE", "R53_CONTACT_POINT", "R99_UNKNOWN"]
_SUBRULES, _SR = q.rule_hits("cl", "doc_id, clause_ord", LATIN_RULES.select(_SUBSET), prefix="y")


@query(f"WITH {_CLAUSES}, {_SUBRULES} SELECT rule_id, CAST(count(*) AS BIGINT) AS findings, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents FROM {_SR} GROUP BY rule_id")
def rule_subset(spark: SparkSession, sf: str) -> DataFrame:
    """Screening with chosen rules; unknown ids match nothing."""
    f = screen.screen(_clauses(spark, sf), LATIN_RULES, _SUBSET)
    return f.groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("doc_id").alias("documents"))


_FSUB, _FU = q.subclauses("cl", "doc_id, clause_ord", prefix="v")


@query(f"""WITH {_CLAUSES}, {_RULES}, {_FSUB},
f AS (SELECT *, char_start + risk_start AS abs_start FROM {_R})
SELECT f.doc_id, f.clause_ord, 'finding:' || f.section_id || ':' || f.rule_id AS finding_id, f.abs_start, f.char_start + f.risk_end AS abs_end,
 (SELECT arg_min(u.label, u.sub_ord) FROM {_FU} u WHERE u.doc_id = f.doc_id AND u.clause_ord = f.clause_ord AND u.char_start <= f.abs_start AND f.abs_start < u.char_end) AS subclause_label
FROM f""")
def locate_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Finding ids, absolute offsets and the numbered item of each finding."""
    f = review.findings_of(_clauses(spark, sf), LATIN)
    return f.select("doc_id", F.col("clause_ord").cast("long"), "finding_id", F.col("abs_start").cast("long"), F.col("abs_end").cast("long"), "subclause_label")


@query(f"""WITH x AS (SELECT doc_id, {q.norm('text')} AS n FROM documents), y AS (SELECT doc_id, n, {q.first('n', ' the | la | der ')} AS st, length(regexp_extract(n, ' the | la | der ')) AS l
 FROM x WHERE regexp_matches(n, ' the | la | der '))
SELECT doc_id, st AS match_start, length(regexp_extract(substr(n, 1, st), '(?s)^(?:.*[.!?])?{q.WS}*')) AS sentence_start,
 CASE WHEN regexp_matches(substr(n, st + l + 1), '[.!?]') THEN st + l + length(regexp_extract(substr(n, st + l + 1), '^[^.!?]*[.!?]')) ELSE length(n) END AS sentence_end FROM y""")
def sentence_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The sentence around the first match in each document."""
    d = documents(spark, sf).withColumn("n", tx.same_length_space(F.col("text")))
    m = d.withColumn("_m", tx.first_match(F.col("n"), F.lit(" the | la | der ")))
    got = m.select("doc_id", "n", F.explode_outer(F.array("_m")).alias("_m")).filter("_m IS NOT NULL")
    return got.select(
        "doc_id", F.col("_m.start").cast("long").alias("match_start"),
        tx.sentence_left(F.col("n"), F.col("_m.start")).cast("long").alias("sentence_start"),
        tx.sentence_right(F.col("n"), F.col("_m.stop")).cast("long").alias("sentence_end"),
    )


_REVIEW, _V = q.review_chain("documents", "doc_id")
_BAD = f"""bad AS (SELECT doc_id, arg_min(code, clause_ord) AS code FROM (SELECT doc_id, clause_ord,
 CASE WHEN NOT regexp_matches(text, '{q.NOT_WS}') THEN 'CLAUSE_EMPTY' WHEN length(text) > 20000 THEN 'CLAUSE_TOO_LONG' END AS code FROM cl) WHERE code IS NOT NULL GROUP BY doc_id)"""


@query(f"""WITH {_REVIEW}, mt AS (SELECT doc_id, t AS text FROM {_V} WHERE passed), {_MSEC}, cl AS (SELECT * FROM {_MS} WHERE analyzable), {_RULES}, {_BAD},
c AS (SELECT doc_id, count(*) AS n FROM cl GROUP BY 1), f AS (SELECT doc_id, count(*) AS n FROM {_R} WHERE doc_id NOT IN (SELECT doc_id FROM bad) GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS clause_count, CAST(coalesce(f.n, 0) AS BIGINT) AS finding_count,
 CASE WHEN NOT d.passed THEN '{MASKING_FAILED_WARNING}' ELSE coalesce(bad.code, '') END AS warnings,
 CASE WHEN NOT d.passed OR bad.doc_id IS NOT NULL THEN 'needs_review' WHEN coalesce(f.n, 0) = 0 THEN 'no_signal' ELSE 'ready_for_review' END AS disposition
FROM {_V} d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN f ON f.doc_id = d.doc_id LEFT JOIN bad ON bad.doc_id = d.doc_id""")
def doc_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The whole review: mask, segment, screen, and one result row per document."""
    r = review.run_review(documents(spark, sf), LATIN)
    return r.results.select("doc_id", "clause_count", "finding_count", _strings("warnings").alias("warnings"), "disposition")


_CAT = f"""g AS (SELECT doc_id, rule_name, min(CASE strength WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 99 END) AS s, count(*) AS n,
 min(struct_pack(c := clause_ord, r := rule_ord)) AS f FROM {_R} GROUP BY doc_id, rule_name),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, n DESC, f) AS k FROM g)"""


@query(f"WITH {_CLAUSES}, {_RULES}, {_CAT} SELECT doc_id, rule_name, CAST(k AS BIGINT) AS category_rank, CAST(n AS BIGINT) AS finding_count FROM h")
def top_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Rule names per document by strength, frequency and first appearance."""
    f = screen.screen(_clauses(spark, sf), LATIN_RULES)
    c = summarize.category_order(f, "doc_id", "rule_name", "strength", ["clause_ord", "rule_ord"])
    return c.select("doc_id", "rule_name", F.col("category_rank").cast("long"), "finding_count")


@query(f"""WITH {_CLAUSES}, {_RULES} SELECT doc_id, category, CAST(f.c AS BIGINT) AS first_clause, CAST(f.r AS BIGINT) AS first_rule
FROM (SELECT doc_id, category, min(struct_pack(c := clause_ord, r := rule_ord)) AS f FROM {_R} GROUP BY doc_id, category)""")
def first_seen(spark: SparkSession, sf: str) -> DataFrame:
    """First position of each category in its document."""
    f = screen.screen(_clauses(spark, sf), LATIN_RULES)
    return f.groupBy("doc_id", "category").agg(F.min(F.struct("clause_ord", "rule_ord")).alias("_f")).select(
        "doc_id", "category", F.col("_f.clause_ord").cast("long").alias("first_clause"), F.col("_f.rule_ord").cast("long").alias("first_rule")
    )


_NO = summarize.NO_SIGNAL


def _bounded_sql(t: str) -> str:
    for term in ("위법", "무효", "불공정 확정", "법률 위반"):
        t = f"replace({t}, '{term}', '추가 검토')"
    return t


def _line_sql(t: str) -> str:
    line = q.squeeze(t)
    return f"({line} <> '' AND length({line}) <= {MAX_SUMMARY_LINE} AND NOT regexp_matches({line}, '{'|'.join(LINE_FORBIDDEN)}'))"


@query(f"""WITH {_CLAUSES}, {_RULES}, {_CAT},
d AS (SELECT doc_id, string_agg(rule_name, ', ' ORDER BY k) FILTER (k <= 3) AS top, count(*) AS kinds, sum(n) AS n FROM h GROUP BY doc_id),
t AS (SELECT x.doc_id, top, kinds, n, '이 문서에서는 ' || top || CASE WHEN kinds > 3 THEN ' 외 ' || (kinds - 3) || '개 유형' ELSE '' END || ' 관련 규칙 위험 신호 ' || CAST(n AS BIGINT) || '건이 확인되어 해당 조항을 우선 검토해야 합니다.' AS s
 FROM documents x LEFT JOIN d ON d.doc_id = x.doc_id)
SELECT doc_id, coalesce(top, '') AS top_categories,
 headline, {_line_sql('headline')} AND {_line_sql(f"'{summarize.CAVEAT}'")} AS lines_ok
FROM (SELECT *, CASE WHEN n IS NULL THEN '{_NO}' WHEN length(s) <= 120 THEN s ELSE regexp_replace(substr(s, 1, 118), '[ ,·]+$', '') || '…' END AS headline FROM t)""")
def summary_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Headline and leading categories per document."""
    d = documents(spark, sf)
    f = screen.screen(review.clauses_of(review.masked_documents(d, LATIN), LATIN), LATIN_RULES)
    s = summarize.summarize(d.select("doc_id"), f)
    ok = summarize.valid_summary_lines(F.col("lines"))
    return s.select("doc_id", _join_top().alias("top_categories"), "headline", ok.alias("lines_ok"))


def _join_top():
    return F.array_join("top_categories", ", ")


_SQZ = q.squeeze("substr(text, risk_start + 1, risk_end - risk_start)")
_EX = f"""e AS (SELECT *, CASE WHEN x <> '' THEN x ELSE {q.squeeze('matched_excerpt')} END AS x2 FROM (SELECT *, CASE WHEN risk_start >= 0 AND risk_start < risk_end AND risk_end <= length(text) THEN {_SQZ} ELSE '' END AS x FROM {_R})),
e2 AS (SELECT *, CASE WHEN length(x2) > 64 THEN regexp_replace(substr(x2, 1, 63), '[ ,·]+$', '') || '…' ELSE x2 END AS ex FROM e),
e3 AS (SELECT *, {_bounded_sql(q.squeeze("'‘' || ex || '’ 문구에서 ‘' || rule_name || '’ 위험 신호가 확인되어 고객 영향을 검토해야 합니다.'"))} AS s FROM e2)"""


@query(f"""WITH {_CLAUSES}, {_RULES}, {_EX} SELECT doc_id, clause_ord, rule_id,
 CASE WHEN length(s) <= 120 THEN s ELSE regexp_replace(substr(s, 1, 118), '[ ,·]+$', '') || '…' END AS sentence FROM e3""")
def finding_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """One bounded sentence per finding."""
    f = screen.screen(_clauses(spark, sf), LATIN_RULES)
    s = summarize.finding_sentence(F.col("rule_name"), F.col("text"), F.col("risk_start"), F.col("risk_end"), F.col("matched_excerpt"), F.lit(""))
    return f.select("doc_id", F.col("clause_ord").cast("long"), "rule_id", s.alias("sentence"))


def _fact_sql(rx: str, s: str) -> str:
    return f"""SELECT doc_id, CAST(list_sum(list_transform(p[1:k], lambda x: length({q.unwrap('x')}))) + coalesce(list_sum(list_transform(h[1:k-1], lambda x: length({q.unwrap('x')}))), 0) AS BIGINT) AS pos,
 {q.squeeze(q.unwrap('h[k]'))} AS v FROM (SELECT doc_id, p, h, unnest(range(1, len(h) + 1)) AS k FROM (SELECT doc_id, string_split_regex({s}, '{rx}') AS p, regexp_extract_all({s}, '{rx}') AS h FROM w))"""


@query(f"""WITH w AS (SELECT doc_id, text, {q.wrap('text')} AS wt FROM documents),
a AS ({_fact_sql(f'{q.OPEN}[0-9]+{q.CLOSE}(?:[.]{q.OPEN}[0-9]+{q.CLOSE})?{q.WS}*%', 'wt')} UNION ALL {_fact_sql('[Vv]ersion [0-9.]+', 'text')} UNION ALL {_fact_sql('[a-z]+[.][0-9]{2}@', 'text')}
 UNION ALL SELECT doc_id, instr(text, a) - 1 AS pos, a AS v FROM documents, (SELECT unnest(['License', 'token', 'the ', 'mail', ' que ']) AS a) WHERE instr(text, a) > 0),
b AS (SELECT doc_id, v, pos, row_number() OVER (PARTITION BY doc_id, v ORDER BY pos) AS r FROM a),
c AS (SELECT doc_id, v, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos, v) AS k FROM b WHERE r = 1)
SELECT d.doc_id, coalesce((SELECT string_agg(v, '|' ORDER BY k) FROM c WHERE c.doc_id = d.doc_id AND k <= 3), '') AS facts FROM documents d""")
def facts(spark: SparkSession, sf: str) -> DataFrame:
    """First three distinct facts of each document."""
    return documents(spark, sf).select("doc_id", F.array_join(tx.facts(F.col("text"), LATIN_ACTORS, LATIN_FACTS), "|").alias("facts"))


@query("SELECT doc_id, sha256(text) AS text_sha, substr(sha256(doc_id || ':' || source || ':1'), 1, 24) AS preview_id, true AS preview_valid, 'sha256:' || sha256(text) AS source_hash FROM documents")
def text_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Content hashes and preview ids."""
    d = spread(table(spark, sf, "documents").select("doc_id", "source", "text"))
    pid = lifecycle.preview_key(F.col("doc_id").cast("string"), F.col("source"), F.lit(1))
    return d.select("doc_id", sha("text").alias("text_sha"), pid.alias("preview_id"), lifecycle.preview_id_valid(pid).alias("preview_valid"), F.concat(F.lit("sha256:"), sha("text")).alias("source_hash"))


@query(f"""WITH t AS (SELECT doc_id, text, lower(regexp_replace(substr(text, length(text) // 3, 40), '{q.WS}', '  ', 'g')) AS tgt FROM documents),
c AS (SELECT *, lower(regexp_replace(text, '{q.WS}', '', 'g')) AS ct, lower(regexp_replace(tgt, '{q.WS}', '', 'g')) AS cg FROM t),
w AS (SELECT *, instr(ct, cg) - 1 AS p0 FROM c WHERE cg <> ''),
ch AS (SELECT doc_id, p0, length(cg) AS gl, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM w WHERE p0 >= 0),
v AS (SELECT doc_id, p0, gl, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM ch WHERE regexp_matches(ch, '{q.NOT_WS}'))
SELECT t.doc_id, (SELECT i - 1 FROM v WHERE v.doc_id = t.doc_id AND k = p0) AS char_start, (SELECT i FROM v WHERE v.doc_id = t.doc_id AND k = p0 + gl - 1) AS char_end FROM t""")
def locate_compact(spark: SparkSession, sf: str) -> DataFrame:
    """Find a snippet with other spacing and case; offsets point into the original."""
    d = documents(spark, sf)
    snippet = F.substring("text", F.floor(F.length("text") / 3).cast("int"), F.lit(40))
    d = d.withColumn("target", F.lower(F.regexp_replace(snippet, tx.WS, "  ")))
    found = tx.locate_compact(d, "text", "target")
    return found.select(
        "doc_id", F.col("located.start").cast("long").alias("char_start"), F.col("located.stop").cast("long").alias("char_end")
    )


_LAST_SYLLABLES = ["권", "리", "해지", "통지", "책임", "x", "1", "가"]


@query(f"""WITH w AS (SELECT doc_id, text, list_extract({_LAST_SYLLABLES!r}, CAST(1 + doc_id % {len(_LAST_SYLLABLES)} AS INTEGER)) AS last FROM documents),
t AS (SELECT doc_id, regexp_extract(text, '[A-Za-z]+') || CASE WHEN doc_id % 9 = 0 THEN '' ELSE last END AS word FROM w)
SELECT doc_id, CASE WHEN unicode(right(word, 1)) BETWEEN 44032 AND 55203 AND (unicode(right(word, 1)) - 44032) % 28 <> 0 THEN '을' ELSE '를' END AS particle FROM t""")
def object_particles(spark: SparkSession, sf: str) -> DataFrame:
    """Object particle after each document's first word; most words get a Korean ending here, as the texts have none."""
    ending = F.get(F.array(*[F.lit(s) for s in _LAST_SYLLABLES]), (F.col("doc_id") % len(_LAST_SYLLABLES)).cast("int"))
    word = F.concat(F.regexp_extract("text", "[A-Za-z]+", 0), F.when(F.col("doc_id") % 9 == 0, "").otherwise(ending))
    return documents(spark, sf).select("doc_id", tx.object_particle(word).alias("particle"))


_GUIDED = ["R18_CUSTOMER_RIGHTS_RESTRICTION", "R01", "R02"]  # the last has no template
_RIGHT_WORDS = [*RIGHT_NAMES, "그 밖의 것"]
_NAMED_SQL = "CASE word " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RIGHT_NAMES.items()) + f" ELSE '{DEFAULT_RIGHT_NAME}' END"


@query(f"""WITH f AS (SELECT doc_id, list_extract({_GUIDED!r}, CAST(1 + doc_id % 3 AS INTEGER)) AS rule_id,
  CASE WHEN doc_id % 5 > 0 THEN list_extract({_RIGHT_WORDS!r}, CAST(1 + length(text) % {len(_RIGHT_WORDS)} AS INTEGER)) END AS word FROM documents),
n AS (SELECT *, {_NAMED_SQL} AS named FROM f),
p AS (SELECT *, named || CASE WHEN (unicode(right(named, 1)) - 44032) % 28 > 0 THEN '을' ELSE '를' END AS object, rule_id = '{_GUIDED[0]}' AND word IS NOT NULL AS special FROM n)
SELECT doc_id, rule_id, CASE WHEN rule_id = 'R02' THEN NULL WHEN special THEN '고객의 ' || object || ' 원칙적으로 보존합니다.|second' ELSE rule_id || ' first|second' END AS points,
  CASE WHEN rule_id = 'R02' THEN NULL WHEN special THEN '고객은 관련 법령과 이 계약에서 정한 절차에 따라 ' || object ||
    ' 행사할 수 있습니다. 권리 행사가 제한되는 경우에는 그 사유·범위·기간을 구체적으로 명시하고 고객에게 이의제기 및 구제 절차를 안내합니다.' ELSE rule_id || ' example' END AS example_clause,
  CASE WHEN rule_id <> 'R02' THEN 'v1' END AS guidance_version FROM p""")
def drafting_guidance(spark: SparkSession, sf: str) -> DataFrame:
    """Drafting guidance of one finding for each document: rules with and without a template, and the rule that names a right."""
    rule = F.get(F.array(*[F.lit(r) for r in _GUIDED]), (F.col("doc_id") % 3).cast("int"))
    word = F.get(F.array(*[F.lit(w) for w in _RIGHT_WORDS]), F.length("text") % len(_RIGHT_WORDS))
    elements = F.when(F.col("doc_id") % 5 > 0, F.array(F.struct(word.alias("excerpt")))).otherwise(F.array().cast("array<struct<excerpt: string>>"))
    findings = documents(spark, sf).select("doc_id", rule.alias("rule_id"), elements.alias("elements"))
    templates = [(r, f"{r} first", "second", f"{r} example", "v1") for r in _GUIDED[:2]]
    guidance = spark.createDataFrame(templates, "rule_id string, point_one string, point_two string, example_clause string, guidance_version string")
    out = summarize.attach_guidance(findings, guidance)
    return out.select("doc_id", "rule_id", F.array_join("revision_points", "|").alias("points"), "example_clause", "guidance_version")


_PG_MASK, _PG_M = q.mask_chain("pg", "doc_id")
_PG_SEC, _PG_S = q.sections("pt", "doc_id", "text")
_PG_RULES, _PG_R = q.rule_hits("pc", "doc_id, clause_ord", LATIN_RULES.select(None))


@query(f"""WITH pg AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: {q.strip('x')}), chr(10)) AS text FROM documents),
{_PG_MASK}, pt AS (SELECT doc_id, t AS text FROM {_PG_M}), {_PG_SEC}, pc AS (SELECT * FROM {_PG_S} WHERE analyzable), {_PG_RULES},
f AS (SELECT r.doc_id, r.clause_ord, 'finding:' || r.section_id || ':' || r.rule_id AS finding_id, r.char_start + r.risk_start AS s, r.char_start + r.risk_end AS e FROM {_PG_R} r)
SELECT f.doc_id, f.clause_ord, finding_id, s AS abs_start, CAST(1 + length(substr(text, 1, s)) - length(replace(substr(text, 1, s), chr(10), '')) AS BIGINT) AS page_number,
 list_filter(list_transform(string_split(substr(text, s + 1, e - s), chr(10)), lambda x: {q.strip('x')}), lambda x: x <> '')[1] AS first_fragment FROM f JOIN pt ON pt.doc_id = f.doc_id
WHERE f.doc_id NOT IN (SELECT doc_id FROM pc WHERE length(text) > 20000)""")
def review_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of any length as pages of one line each: every finding with its page and the piece of the match on its first page.

    As in every review, a document with a clause of over 20,000 characters fails and has no findings.
    """
    lines = documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("_at", "text"))
    done = review.review_pages(lines.select("doc_id", (F.col("_at") + 1).cast("long").alias("page_no"), "text"), LATIN, max_chars=2**31 - 1)
    return done.findings.select(
        "doc_id", F.col("clause_ord").cast("long"), "finding_id", F.col("abs_start").cast("long"), "page_number",
        F.get("fragments", F.lit(0))["fragment"].alias("first_fragment"),
    )
