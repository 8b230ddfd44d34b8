"""Thresholds, limits and message formats that results must agree with."""

SUPPRESSION_WINDOW = 140
GROUP_SUPPRESSION_WINDOW = 220
MEDIUM_CONTEXT_TERMS = 2

VECTOR_WEIGHT, LEXICAL_WEIGHT, AUTHORITY_WEIGHT = 0.45, 0.40, 0.15
DEFAULT_AUTHORITY = 0.5
BM25_K1, BM25_B = 1.5, 0.75
CARD_VECTOR_WEIGHT, CARD_LEXICAL_WEIGHT, CARD_FACTOR_WEIGHT = 0.6, 0.2, 0.2
CARD_HITS = 8
GATE_MIN_SCORE, GATE_MARGIN, GATE_MIN_FACTORS = 0.70, 0.08, 2

CANDIDATE_THRESHOLD, CANDIDATE_MARGIN, CANDIDATE_LIMIT = 0.90, 0.04, 2
HIGH_CONFIDENCE = 0.85
HASH_DIMENSION = 128
NGRAM_DIMENSION = 384
NGRAM_SIZES = (2, 3, 4)

MAX_SENTENCE, MAX_EXCERPT, MAX_SUMMARY_LINE = 120, 64, 100
CONTEXT_BUDGET, CONTEXT_CAP = 12_000, 3
MAX_ATTEMPTS, PROGRESS_TTL_SECONDS = 3, 3600
DOCUMENT_TTL_HOURS, AUDIT_RETENTION_DAYS = 24, 365
OCR_MIN_CHARS, OCR_MIN_RATIO = 10, 0.25
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
MAX_DOCUMENT_CHARS, MAX_CLAUSE_CHARS = 200_000, 20_000
MARGIN_LINES, MARGIN_MIN_PAGES = 5, 2
DEEP_DAILY_LIMIT = 20
AUDIT_LIMIT_DEFAULT, AUDIT_LIMIT_MAX = 100, 200

COLLECTIONS = ["statutes", "ftc_decisions", "court_decisions", "dispute_cases", "clause_patterns"]

ALLOWED_UPLOADS = {
    ".txt": "text/plain",
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}

RETRYABLE_ERRORS = [
    "ANALYSIS_FAILED",
    "ANALYSIS_RETRYING",
    "ANALYSIS_QUEUE_UNAVAILABLE",
    "LLM_RATE_LIMITED",
    "LLM_UNAVAILABLE",
    "OCR_TIMEOUT",
    "API_UNREACHABLE",
]

HIDDEN_WARNINGS = [
    "LLM_SCHEMA_INVALID",
    "mock 에이전트 결과는 실제 LLM 품질 평가에 사용할 수 없습니다.",
    "법적 근거는 검증 전 후보이며 원문·시행일 확인이 필요합니다.",
    "이 결과는 법률 판단이 아닌 검토 보조 자료입니다.",
]
MASKING_FAILED_WARNING = "개인정보 마스킹 검증에 실패해 분석을 중단했습니다."

# Conclusion wording that must never appear: in model output, in summaries, in summary lines.
CITATION_FORBIDDEN = ["위법하다", "적법하다", "무효이다", "반드시 승소"]
SUMMARY_FORBIDDEN = ["위법", "무효", "불공정 확정", "법률 위반"]
LINE_FORBIDDEN = ["위법하다", "적법하다", "무효이다", "불공정하다", "법률 위반이다", "반드시 승소"]

ACTORS = ["채권자", "금융회사", "금융사", "은행", "대주", "채무자", "차주", "고객"]
RISK_LEVELS = ["none", "low", "medium", "high"]
STRENGTH_RANK = {"high": 0, "medium": 1, "low": 2}
UNKNOWN_STRENGTH = 99

RECORD_FIELDS = [
    "document_id", "chunk_id", "corpus_type", "title", "authority", "source_url",
    "source_hash", "language", "section", "manifest_version", "review_status", "text",
]
CARD_FIELDS = [
    "card_id", "rule_id", "polarity", "title", "source_class", "review_status",
    "evaluation_split", "factor_groups", "text",
]

# Routing policy: role -> (default tier, input budget, turns); tier -> (model setting, output budget).
ROUTING_ROLES = [
    ("planner", "fast", 3000, 1),
    ("evidence_selector", "fast", 5000, 1),
    ("analyst", "balanced", 12000, 1),
    ("verifier", "fast", 6000, 1),
    ("adjudicator", "deep", 14000, 1),
]
ROUTING_TIERS = [
    ("fast", "fast_model", 700),
    ("balanced", "balanced_model", 1600),
    ("deep", "deep_model", 2400),
]

# Names of the customer rights that the rights-restriction rule can detect.
RIGHT_NAMES = {
    "이의": "이의제기권", "이의제기": "이의제기권", "항변권": "항변권", "상계권": "상계권",
    "해지": "해지권", "해지권": "해지권", "철회": "철회권", "취소권": "취소권",
    "민원": "민원 제기 권리", "손해배상청구": "손해배상청구권", "다투": "다툴 권리",
    "다툴": "다툴 권리", "소송": "소송 제기 권리",
}
DEFAULT_RIGHT_NAME = "해당 권리"
