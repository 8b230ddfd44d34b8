"""Evidence rows keep all their fields, and findings without hits fall back to the rule's own."""

from pactlens.operators.retrieve import EVIDENCE_FIELDS, attach_evidence


def test_evidence_keeps_its_fields(spark):
    findings = spark.createDataFrame([("q1", "R1", ["law a", "law b"]), ("q2", "R1", ["law a"])], "query_id string, rule_id string, legal_basis array<string>")
    hits = spark.createDataFrame(
        [("q1", 2, "e2", "t2", 0.5, "statutes", "cited", "http://x"), ("q1", 1, "e1", "t1", 0.9, "cases", "said", None)],
        "query_id string, rank int, evidence_id string, title string, relevance_score double, collection string, quoted_excerpt string, source_url string",
    )
    got = {r.query_id: r for r in attach_evidence(findings, hits, ["query_id"]).collect()}
    first, second = got["q1"].evidence
    assert (first.evidence_id, first.collection, first.quoted_excerpt, first.relevance_score) == ("e1", "cases", "said", 0.9)
    assert second.source_url == "http://x" and set(first.asDict()) == {"rank", "evidence_id", *EVIDENCE_FIELDS}
    assert [(e.evidence_id, e.title, e.status) for e in got["q2"].evidence] == [("candidate:R1:1", "law a", "candidate_unverified")]
    assert got["q1"].grounding == "grounded" and got["q2"].grounding == "unavailable"
