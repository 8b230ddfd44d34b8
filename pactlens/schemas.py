"""Explicit schemas; nothing is inferred from data."""

RULE_CASE = "case_id string, text string, expected_rule_ids array<string>, case_type string, synthetic boolean"
PII_CASE = "case_id string, text string, expected_types array<string>, forbidden array<string>"
RETRIEVAL_CASE = "case_id string, query string, expected_evidence_ids array<string>"
ANNOTATION = (
    "case_id string, reviewer_id string, risk_level string, evidence_ids array<string>, reason_codes array<string>, "
    "review_question_codes array<string>, blinded boolean"
)
CORPUS_RECORD = (
    "document_id string, chunk_id string, corpus_type string, title string, authority string, source_url string, "
    "source_hash string, language string, section string, manifest_version string, review_status string, "
    "authority_weight double, text string"
)
CORPUS_INDEX = f"stable_id string, {CORPUS_RECORD}"
DOCUMENT = (
    "id string, original_filename string, mime_type string, sha256 string, status string, storage_path string, "
    "masked_text string, uploaded_at timestamp, expires_at timestamp, deleted_at timestamp"
)
ANALYSIS = (
    "id string, document_id string, status string, disposition string, experiment_arm string, result_json string, "
    "error_code string, created_at timestamp, completed_at timestamp"
)
AUDIT_EVENT = "id string, event_type string, document_id string, analysis_id string, created_at timestamp"
JOB = "analysis_id string, ts timestamp"
ATTEMPT = "analysis_id string, ts timestamp, seq bigint, failed boolean, retryable boolean, error_code string"
RULESET = (
    "version string, rules array<struct<id:string,name:string,category:string,"
    "required_pattern_groups:array<array<string>>,positive_patterns:array<string>,negative_patterns:array<string>,"
    "negative_pattern_groups:array<array<string>>,labels:array<string>,context_terms:array<string>,"
    "legal_basis_candidates:array<string>,candidate_terms:array<string>,"
    "explanation:struct<why_flagged:string,possible_impact:string,review_points:array<string>,"
    "suggested_revision:string,disclaimer:string>>>"
)
TAXONOMY = (
    "version string, profiles array<struct<rule_id:string,positive_prototypes:array<string>,hard_negatives:array<string>>>"
)
CARDS = (
    "version string, cards array<struct<card_id:string,rule_id:string,polarity:string,title:string,source_class:string,"
    "review_status:string,evaluation_split:string,factor_groups:array<struct<code:string,patterns:array<string>>>,text:string>>"
)
GUIDANCE = "rule_id string, point_one string, point_two string, example_clause string, guidance_version string"
RUN_META = [
    "run_id", "experiment", "provider", "code_commit", "code_dirty", "container_image_id", "container_architecture",
    "platform", "ruleset_version", "dataset", "dataset_sha256", "dataset_is_synthetic",
]
