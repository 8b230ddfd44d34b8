"""DuckDB fragments for the text operators, written for an engine without lookaround.

Digit runs are wrapped in \\x01 and \\x02 first, so "no digit before" and "no digit after" become
plain anchors that consume nothing else.
"""

from __future__ import annotations

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = WS.replace("[", "[^", 1)
OPEN, CLOSE = r"\x01", r"\x02"
_S = f"{CLOSE}[- ]{OPEN}"
_OS = f"(?:{_S})?"

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
# (type, pattern on text with wrapped digit runs); passports carry their own start mark.
NUMBERS = [
    ("phone", f"{OPEN}(?:01[016789]|0[0-9]{{1,2}}){_OS}[0-9]{{3,4}}{_OS}[0-9]{{4}}{CLOSE}"),
    ("resident_id", f"{OPEN}[0-9]{{6}}{_OS}[1-8][0-9]{{6}}{CLOSE}"),
    ("passport", rf"\x03[A-Z]{{1,2}}{OPEN}[0-9]{{7,8}}{CLOSE}"),
    ("driver_license", f"{OPEN}[0-9]{{2}}{_S}[0-9]{{2}}{_S}[0-9]{{6}}{_S}[0-9]{{2}}{CLOSE}"),
    ("business_registration", f"{OPEN}[0-9]{{3}}{_S}[0-9]{{2}}{_S}[0-9]{{5}}{CLOSE}"),
    ("card", f"{OPEN}(?:[0-9]{{4}}{_OS}){{3}}[0-9]{{4}}{CLOSE}"),
    ("account_candidate", f"{OPEN}[0-9]{{2,6}}{_S}[0-9]{{2,6}}{_S}[0-9]{{4,8}}{CLOSE}"),
]
TYPES = ["email", *[t for t, _ in NUMBERS]]


def wrap(text: str) -> str:
    """Wrap digit runs and mark passport starts."""
    runs = f"regexp_replace({text}, '([0-9]+)', chr(1) || '\\1' || chr(2), 'g')"
    return (
        f"regexp_replace({runs}, '(^|[^A-Za-z0-9\\x02])([A-Z]{{1,2}}\\x01[0-9]{{7,8}}\\x02)', '\\1' || chr(3) || '\\2', 'g')"
    )


def unwrap(text: str) -> str:
    """Remove the marks."""
    return f"translate({text}, chr(1) || chr(2) || chr(3), '')"


def mask_chain(src: str, keys: str, text: str = "text", prefix: str = "m", offsets: bool = False) -> tuple[str, str]:
    """CTEs that mask ``text`` of ``src``; returns (ctes, last name).

    The last relation has keys, t (masked, unwrapped), n_<type> counts. With ``offsets``, ``src``
    also has o_<type> columns that numbers start from.
    """
    out, prev = [], src
    counts = ""
    offs = ", " + ", ".join(f"o_{t}" for t in TYPES) if offsets else ""
    steps = [("email", EMAIL), *NUMBERS]
    for i, (name, rx) in enumerate(steps):
        cur = f"{prefix}{i}"
        source = text if i == 0 else (wrap("t") if i == 1 else "t")
        off = f" + o_{name}" if offsets else ""
        out.append(
            f"{cur}p AS (SELECT {keys}{offs}{counts}, string_split_regex({source}, '{rx}') AS p FROM {prev})"
        )
        counts += f", n_{name}"
        out.append(
            f"{cur} AS (SELECT {keys}{offs}{counts.replace(f', n_{name}', '')}, "
            f"array_to_string(list_transform(p, lambda x, i: CASE WHEN i = 1 THEN x ELSE "
            f"'[{name.upper()}_' || CAST(i - 1{off} AS BIGINT) || ']' || x END), '') AS t, "
            f"CAST(len(p) - 1 AS BIGINT) AS n_{name} FROM {cur}p)"
        )
        prev = cur
    last = f"{prefix}x"
    out.append(f"{last} AS (SELECT {keys}{counts}, {unwrap('t')} AS t FROM {prev})")
    return ",\n".join(out), last


def leftover(text: str) -> str:
    """True when any pattern still matches."""
    tests = [f"regexp_matches({text}, '{EMAIL}')"]
    tests += [f"regexp_matches({wrap(text)}, '{rx}')" for _, rx in NUMBERS]
    return "(" + " OR ".join(tests) + ")"


# The ten patterns of the whole review, each with the marks that stand for what its lookaround sees.
_ALL_MARKS, _STAND_IN = " || ".join(f"chr({i})" for i in range(1, 8)), f"repeat(chr({0x0E}), 7)"
_HANGUL, _NOT_A_NAME = "[가-힣]", "은행|회사|법인|사업자|채권자|금융사"
_GAP = rf"(?:\x05{WS})*"
NAME = (
    rf"((?:성명|\x06?이름|계약자명|채무자명|고객명){_GAP}[:：]{_GAP})(?:[\x06\x07]*{_HANGUL}){{2,5}}\x05"
    rf"|((?:계약자|채무자|고객)\x07?(?:는|은){_GAP})\x06?{_HANGUL}(?:[\x06\x07]*{_HANGUL}){{1,4}}\x06"
)
ADDRESS = rf"((?:주소|거주지|송달주소){WS}*(?:[:：]|은|는){WS}*){_HANGUL}[^\n;.!?]{{4,99}}"
PASSPORT = r"\x03[A-Z]{1,2}(?:\x03?\p{Nd}){7,8}\x02"


def _mark(text: str, rx: str, before: str = "", after: str = "") -> str:
    return f"regexp_replace({text}, '({rx})', {before and before + ' || '}'\\1'{after and ' || ' + after}, 'g')"


def _mark_name(text: str) -> str:
    """5 stands where a name may end before white space, a stop or the end, 6 where it may before a predicate, 7 before what is no name."""
    words = _mark(_mark(text, "이|입니|씨", "chr(6)"), _NOT_A_NAME, "chr(7)")
    return _mark(words, f"{WS}|[.,;]", "chr(5)") + " || chr(5)"


def _mark_digits(text: str) -> str:
    return _mark(text, r"\p{Nd}+", "chr(1)", "chr(2)")


def _mark_passport(text: str) -> str:
    """3 stands before letters and digits that none precede, 2 where digits end."""
    return _mark(_mark(text, "[A-Za-z0-9]+", "chr(3)"), r"(?:\x03?\p{Nd})+", "", "chr(2)")


# (type, what a text must show first, marks, pattern, groups of which one is kept)
REVIEW_STEPS = [
    ("name", "label", _mark_name, NAME, (1, 2)),
    ("address", "label", str, ADDRESS, (1,)),
    ("email", "at", str, EMAIL, ()),
    *[(t, "digit", _mark_passport if t == "passport" else _mark_digits, PASSPORT if t == "passport" else rx.replace("[0-9]", r"\p{Nd}"), ()) for t, rx in NUMBERS],
]


def review_chain(src: str, keys: str, text: str = "text", prefix: str = "k") -> tuple[str, str]:
    """CTEs that mask ``text`` of ``src`` as the whole review does; returns (ctes, last name).

    All ten patterns go one after the other, and each marks the text that the ones before have left, so a placeholder can open the start
    of a match. Texts that show nothing that a pattern needs stay as they are. The last relation has keys, t (masked) and passed: no
    pattern matches what is left. A null text is an empty one, and control characters that serve as marks are replaced, which changes no length.
    """
    p, flags = prefix, "has_label, has_at, has_digit"
    plain = f"CASE WHEN regexp_matches({text}, '[\\x01-\\x07]') THEN translate({text}, {_ALL_MARKS}, {_STAND_IN}) ELSE coalesce({text}, '') END"
    out = [
        f"{p}0 AS (SELECT {keys}, t, CAST(0 AS BIGINT) AS n, regexp_matches(t, '{_HANGUL}') AS has_label, contains(t, '@') AS has_at, "
        f"regexp_matches(t, '\\p{{Nd}}{{2}}') AS has_digit FROM (SELECT {keys}, {plain} AS t FROM {src}))",
        f"{p}1 AS (SELECT * FROM {p}0 WHERE has_label OR has_at OR has_digit)",
    ]
    prev = f"{p}1"
    for name, needs, mark, rx, groups in REVIEW_STEPS:
        cuts = [f"CASE WHEN has_{needs} THEN string_split_regex(w, '{rx}') ELSE [w] END AS p"]
        cuts += [f"CASE WHEN has_{needs} THEN regexp_extract_all(w, '{rx}', {g}) END AS h{g}" for g in groups]
        kept = f"coalesce({', '.join(f'h{g}[i - 1]' for g in groups)}, '') || " if groups else ""
        out.append(
            f"{p}_{name}p AS (SELECT {keys}, n, {flags}, {', '.join(cuts)} "
            f"FROM (SELECT *, CASE WHEN has_{needs} THEN {mark('t')} ELSE t END AS w FROM {prev}))"
        )
        out.append(
            f"{p}_{name} AS (SELECT {keys}, n + len(p) - 1 AS n, {flags}, translate(array_to_string(list_transform(p, lambda x, i: CASE WHEN i = 1 THEN x ELSE "
            f"{kept}'[{name.upper()}_' || CAST(i - 1 AS BIGINT) || ']' || x END), ''), {_ALL_MARKS}, '') AS t FROM {p}_{name}p)"
        )
        prev = f"{p}_{name}"
    left = " OR ".join(f"regexp_matches({mark('t')}, '{rx}')" for _, _, mark, rx, _ in REVIEW_STEPS)
    out.append(
        f"{p}x AS (SELECT {keys}, t, CASE WHEN n = 0 THEN true ELSE NOT ({left}) END AS passed FROM {prev} "
        f"UNION ALL SELECT {keys}, t, true FROM {p}0 WHERE NOT (has_label OR has_at OR has_digit))"
    )
    return ",\n".join(out), f"{p}x"


def strip(text: str) -> str:
    """Trim Unicode whitespace."""
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze(text: str) -> str:
    """Collapse whitespace and trim."""
    return f"trim(regexp_replace({text}, '{WS}+', ' ', 'g'))"


HEADING = r"(?m)^[ \t]*(?:([A-Z][a-z]{0,11})\.$|(Licensed under|Released under|This work is licensed))"
MARKER = r"(?m)^[ \t]*([A-Z][a-z]{0,2}) "


def sections(src: str, keys: str, text: str = "text", prefix: str = "s") -> tuple[str, str]:
    """CTEs that cut ``src`` at headings; last relation: keys and section columns with text."""
    k = keys
    p = prefix
    ctes = f"""
{p}0 AS (SELECT {k}, string_split(regexp_replace({text}, '{HEADING}', chr(4) || '\\0', 'g'), chr(4)) AS parts FROM {src}),
{p}1 AS (SELECT {k}, len(parts) AS np, unnest(parts) AS piece, generate_subscripts(parts, 1) AS i FROM {p}0),
{p}2 AS (SELECT *, CAST(coalesce(sum(length(piece)) OVER (PARTITION BY {k} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS st,
         regexp_matches(first_value(piece) OVER (PARTITION BY {k} ORDER BY i), '{NOT_WS}') AS has_pre FROM {p}1),
{p}3 AS (SELECT *, CASE WHEN np > 1 AND i = 1 THEN 'preamble'
              WHEN i > 1 AND regexp_matches(piece, '^[ \\t]*(Licensed under|Released under|This work is licensed)') THEN 'appendix'
              ELSE 'article' END AS section_type
         FROM {p}2 WHERE np = 1 OR i > 1 OR has_pre),
{p}4 AS (SELECT {k}, CAST(CASE WHEN np = 1 THEN 0 WHEN has_pre THEN i - 1 ELSE i - 2 END AS BIGINT) AS clause_ord,
         CAST(CASE WHEN np = 1 THEN 1 ELSE i - 1 END AS BIGINT) AS number, section_type,
         CASE WHEN i > 1 THEN {strip('piece')} ELSE piece END AS text,
         st + CASE WHEN i > 1 THEN length(piece) - length(regexp_replace(piece, '^{WS}+', '')) ELSE 0 END AS char_start
         FROM {p}3),
{p}x AS (SELECT *, char_start + length(text) AS char_end,
         CASE section_type WHEN 'preamble' THEN 'preamble' ELSE section_type || ':' || number END AS section_id,
         CASE section_type WHEN 'preamble' THEN 'preamble' WHEN 'appendix' THEN 'notice ' || number ELSE 'section ' || number END AS label,
         section_type <> 'preamble' AS analyzable FROM {p}4)"""
    return ctes, f"{p}x"


def subclauses(src: str, keys: str, prefix: str = "u") -> tuple[str, str]:
    """CTEs that list numbered items of the clauses in ``src``."""
    p = prefix
    ctes = f"""
{p}0 AS (SELECT {keys}, char_start AS c0, string_split(regexp_replace(text, '{MARKER}', chr(4) || '\\0', 'g'), chr(4)) AS parts FROM {src}),
{p}1 AS (SELECT {keys}, c0, unnest(parts) AS piece, generate_subscripts(parts, 1) AS i FROM {p}0),
{p}2 AS (SELECT *, c0 + CAST(coalesce(sum(length(piece)) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS st FROM {p}1),
{p}x AS (SELECT {keys}, CAST(i - 2 AS BIGINT) AS sub_ord, regexp_extract(piece, '^[ \\t]*([A-Z][a-z]{{0,2}}) ', 1) AS label,
         st AS char_start, st + length(piece) AS char_end FROM {p}2 WHERE i > 1)"""
    return ctes, f"{p}x"


def norm(text: str) -> str:
    """Whitespace to single spaces, same length."""
    return f"regexp_replace({text}, '{WS}', ' ', 'g')"


def first(text: str, rx: str) -> str:
    """0-based start of the first match."""
    return f"length(string_split_regex({text}, '{rx}')[1])"


def rule_hits(src: str, keys: str, rules: list[dict], negatives: bool = True, prefix: str = "r") -> tuple[str, str]:
    """CTEs that screen ``src`` (text column); last relation has spans, elements and strength."""
    p = prefix
    parts = []
    for o, r in rules:
        groups = r["required_pattern_groups"]
        cond = " AND ".join("(" + " OR ".join(f"regexp_matches(n, '{x}')" for x in g) + ")" for g in groups)
        hits, starts = [], []
        for g in groups:
            pick = "CASE " + " ".join(f"WHEN regexp_matches(n, '{x}') THEN regexp_extract(n, '{x}')" for x in g) + " END"
            at = "CASE " + " ".join(f"WHEN regexp_matches(n, '{x}') THEN {first('n', x)}" for x in g) + " END"
            hits.append(pick)
            starts.append(at)
        labels = r["labels"]
        names = [labels[i] if i < len(labels) else f"판단 표현 {i + 1}" for i in range(len(groups))]
        ctx = " + ".join(f"CAST(contains(n, '{t}') AS BIGINT)" for t in r["context_terms"])
        near = " OR ".join(f"regexp_matches(w1, '{x}')" for x in r["negative_patterns"]) if negatives else ""
        safe = (
            " AND ".join("(" + " OR ".join(f"regexp_matches(w2, '{x}')" for x in g) + ")" for g in r["negative_pattern_groups"])
            if negatives else ""
        )
        where = " AND ".join([f"NOT ({c})" for c in (near, safe) if c]) or "true"
        parts.append(f"""
SELECT * FROM (SELECT *, substr(n, 1 + greatest(starts[1] - 140, 0), ends[1] + 140 - greatest(starts[1] - 140, 0)) AS w1,
   substr(n, 1 + greatest(starts[1] - 220, 0), ends[1] + 220 - greatest(starts[1] - 220, 0)) AS w2
 FROM (SELECT *, list_transform(list_zip(starts, hits), lambda z: z[1] + length(z[2])) AS ends
 FROM (SELECT *, [{', '.join(starts)}] AS starts, [{', '.join(hits)}] AS hits, [{', '.join(repr(x) for x in names)}] AS labels,
   CAST({o} AS BIGINT) AS rule_ord, '{r["id"]}' AS rule_id, '{r["name"]}' AS rule_name, '{r["category"]}' AS category, {ctx} AS context_count,
   [{', '.join(repr(x) for x in r["legal_basis_candidates"])}] AS legal_basis
 FROM {p}n WHERE {cond}))) WHERE {where}""")
    union = "\nUNION ALL BY NAME ".join(parts)
    ctes = f"""
{p}n AS (SELECT *, {norm('text')} AS n FROM {src}),
{p}u AS ({union}),
{p}x AS (SELECT * EXCLUDE (w1, w2), hits[1] AS matched_excerpt, starts[1] AS match_start, ends[1] AS match_end,
   length(regexp_extract(substr(n, 1, list_min(starts)), '(?s)^(?:.*[.!?])?{WS}*')) AS risk_start,
   CASE WHEN regexp_matches(substr(n, list_max(ends) + 1), '[.!?]')
        THEN list_max(ends) + length(regexp_extract(substr(n, list_max(ends) + 1), '^[^.!?]*[.!?]')) ELSE length(n) END AS risk_end,
   CASE WHEN context_count >= 2 THEN 'medium' ELSE 'low' END AS strength FROM {p}u)"""
    return ctes, f"{p}x"
