"""Built-in packs: Korean patterns for contracts, and a Latin-text pack for other corpora."""

from __future__ import annotations

from pactlens.packs import korean
from pactlens.packs.model import DIGIT, WS, PiiPattern, RulePack, SectionPack, portable

KOREAN_RULES = RulePack(korean.RULESET_VERSION, korean.RULES)

# The ten personal-data patterns in masking order.
PII_PATTERNS = [
    PiiPattern(
        "name",
        portable(
            r"((?:성명|이름|계약자명|채무자명|고객명)\s*[:：]\s*)([가-힣]{2,5})(?=\s|$|[.,;])"
            r"|((?:계약자|채무자|고객)(?:는|은)\s*)((?!(?:은행|회사|법인|사업자|채권자|금융사))[가-힣]{2,5})(?=(?:이|입니|이며|이고|씨))"
        ),
        "label",
        (1, 3),
    ),
    PiiPattern("address", portable(r"((?:주소|거주지|송달주소)\s*(?:[:：]|은|는)\s*)([가-힣][^\n;.!?]{4,99})"), "label", (1,)),
    PiiPattern("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "at"),
    PiiPattern("phone", portable(r"(?<!\d)(?:01[016789]|0\d{1,2})[- ]?\d{3,4}[- ]?\d{4}(?!\d)"), "digit"),
    PiiPattern("resident_id", portable(r"(?<!\d)\d{6}[- ]?[1-8]\d{6}(?!\d)"), "digit"),
    PiiPattern("passport", portable(r"(?<![A-Za-z0-9])[A-Z]{1,2}\d{7,8}(?!\d)"), "digit"),
    PiiPattern("driver_license", portable(r"(?<!\d)\d{2}[- ]\d{2}[- ]\d{6}[- ]\d{2}(?!\d)"), "digit"),
    PiiPattern("business_registration", portable(r"(?<!\d)\d{3}[- ]\d{2}[- ]\d{5}(?!\d)"), "digit"),
    PiiPattern("card", portable(r"(?<!\d)(?:\d{4}[- ]?){3}\d{4}(?!\d)"), "digit"),
    PiiPattern("account_candidate", portable(r"(?<!\d)\d{2,6}[- ]\d{2,6}[- ]\d{4,8}(?!\d)"), "digit"),
]

# Article and appendix headings, and numbered items.
KOREAN_SECTIONS = SectionPack(
    heading=(
        f"(?md)^{WS}*(?:(제{WS}*({DIGIT}+){WS}*조)"
        f"|(별{WS}*지{WS}*(?:제{WS}*)?({DIGIT}+){WS}*호?))"
    ),
    article_group=1,
    article_number_group=2,
    appendix_group=3,
    appendix_number_group=4,
    marker=f"(?md)^{WS}*([①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳]|{DIGIT}+\\))",
)

# A pack for Latin prose: a one-word line is a heading, a licence line opens an appendix.
LATIN_SECTIONS = SectionPack(
    heading="(?md)^[ \\t]*(?:([A-Z][a-z]{0,11})\\.$|(Licensed under|Released under|This work is licensed))",
    article_group=1,
    article_number_group=0,
    appendix_group=2,
    appendix_number_group=0,
    marker="(?md)^[ \\t]*([A-Z][a-z]{0,2}) ",
    article_label="section %s",
    appendix_label="notice %s",
    preamble_label="preamble",
)

LATIN_RULES = RulePack(
    "1.0.0",
    [
        {
            "id": "R51_LICENSE_NOTICE",
            "name": "license notice",
            "category": "license_notice",
            "required_pattern_groups": [["Licensed under", "Released under"], ["MIT|Apache|GNU"]],
            "negative_patterns": ["version 3"],
            "negative_pattern_groups": [],
            "labels": ["grant", "license"],
            "context_terms": ["License", "Version", "under"],
            "legal_basis_candidates": ["license text"],
            "candidate_terms": ["license"],
        },
        {
            "id": "R52_EXPOSED_CREDENTIAL",
            "name": "exposed credential",
            "category": "exposed_credential",
            "required_pattern_groups": [["token = ", "key = "], ["[0-9a-f]{16,40}"]],
            "negative_patterns": [],
            "negative_pattern_groups": [],
            "labels": ["assignment"],
            "context_terms": ["token", "secret"],
            "legal_basis_candidates": ["security policy", "key rotation"],
            "candidate_terms": ["token"],
        },
        {
            "id": "R53_CONTACT_POINT",
            "name": "contact point",
            "category": "contact_point",
            "required_pattern_groups": [[r"\[EMAIL_[0-9]+\]", r"\[PHONE_[0-9]+\]", r"\[CARD_[0-9]+\]"]],
            "negative_patterns": ["example\\.net"],
            "negative_pattern_groups": [],
            "labels": ["contact"],
            "context_terms": ["the", "and"],
            "legal_basis_candidates": ["privacy policy"],
            "candidate_terms": ["contact"],
        },
        {
            "id": "R54_BROAD_SCOPE",
            "name": "broad scope",
            "category": "broad_scope",
            "required_pattern_groups": [["ention|ement"], [" the | la | der "], [" of | de | und "]],
            "negative_patterns": [" was ", " sich "],
            "negative_pattern_groups": [[" is ", " est "], [" it ", " que "]],
            "labels": ["scope", "actor", "object"],
            "context_terms": ["that", "les", "mit", "for"],
            "legal_basis_candidates": ["scope rule 1", "scope rule 2"],
            "candidate_terms": ["scope"],
        },
        {
            "id": "R55_REPEATED_TERM",
            "name": "repeated term",
            "category": "repeated_term",
            "required_pattern_groups": [["haha|keitkeit|tionre"], ["[.,] [A-Za-z]+"]],
            "negative_patterns": [],
            "negative_pattern_groups": [[" with ", " von "], [" to ", " zu "]],
            "labels": ["term", "break"],
            "context_terms": ["are", "the", "die"],
            "legal_basis_candidates": ["style rule"],
            "candidate_terms": ["repeat"],
        },
        {
            "id": "R56_UNBOUNDED_DUTY",
            "name": "unbounded duty",
            "category": "unbounded_duty",
            "required_pattern_groups": [["heitkeit|thation|eaument"], [" on | en | ein "], ["ing|ung|ion"], [" by ", " par ", " bei "]],
            "negative_patterns": ["wh[a-z]{0,3} the"],
            "negative_pattern_groups": [],
            "labels": ["duty", "place", "action", "agent"],
            "context_terms": ["all", "are", "aux", "ver"],
            "legal_basis_candidates": ["duty rule"],
            "candidate_terms": ["duty"],
        },
    ],
)
