"""Rule screening, summaries and the whole review on Korean gold texts."""

import random

import pytest
from pyspark.sql import functions as F

from pactlens.operators import candidates as cand
from pactlens.operators import factors, retrieve, screen, summarize
from pactlens.packs import korean
from pactlens.packs.defaults import KOREAN_RULES
from pactlens.packs.model import RulePack
from pactlens.plans.review import run_review

GOLD = [
    ("UC-P1", "은행은 필요하다고 인정하는 경우 서비스 내용을 일방적으로 변경할 수 있다.", {"R04_UNILATERAL_CHANGE"}),
    ("UC-P2", "회사는 고객에게 사전 통지 없이 수수료를 변경할 수 있다.", {"R04_UNILATERAL_CHANGE"}),
    ("UC-N1", "회사는 고객의 명시적 동의를 받은 경우에만 서비스 내용을 변경할 수 있다.", set()),
    ("UC-B1", "법령의 개정으로 필요한 경우 은행은 금리를 변경할 수 있다.", set()),
    ("AC-P1", "은행이 필요하다고 인정하는 경우 고객은 기한의 이익을 상실하고 즉시 변제한다.", {"R05_ACCELERATION"}),
    ("AC-P2", "고객의 신용상태가 악화된 경우 별도 통지 없이 기한의 이익을 상실한다.", {"R05_ACCELERATION"}),
    ("AC-N1", "고객이 연체한 경우 은행은 서면으로 통지하고 상당한 기간을 정하여 이행을 최고한다.", set()),
    ("JU-P1", "본 계약에 관한 소송은 은행 본점 소재지 법원을 전속적 관할법원으로 한다.", {"R08_EXCLUSIVE_JURISDICTION"}),
    ("JU-P2", "분쟁에 관한 소송은 회사 주사무소 소재지 법원에서만 제기할 수 있다.", {"R08_EXCLUSIVE_JURISDICTION"}),
    ("JU-N1", "분쟁은 민사소송법에서 정한 관할법원에 제기할 수 있다.", set()),
]
ONE_EACH = {
    "R01": "고객은 실제 손해와 관계없이 위약금 전액을 지급한다.",
    "R02": "은행은 필요하다고 인정하는 경우 계약을 해지할 수 있다.",
    "R03": "은행은 어떠한 책임을 지지 않는다.",
    "R04": "은행은 필요하다고 인정하는 경우 서비스 내용을 일방적으로 변경할 수 있다.",
    "R05": "은행이 필요하다고 판단하는 경우 기한의 이익을 상실한다.",
    "R06": "은행은 고객의 동의 없이 채권을 제3자에게 양도할 수 있다.",
    "R07": "계약은 만료일에 자동으로 갱신된다.",
    "R08": "소송은 은행 본점 소재지 법원에서만 한다.",
    "R09": "채무자는 기간과 관계없이 중도상환수수료 5%를 부담한다.",
    "R10": "고객은 신용카드를 반드시 가입하여야 한다.",
    "R11": "고객이 이의를 제기하지 않으면 동의한 것으로 본다.",
    "R12": "우대금리를 소급 적용하여 모두 취소한다.",
    "R13": "채권자는 추가 담보를 제출하도록 요구한다.",
    "R14": "은행 전산 기록을 최종 증거로 하며 이의를 제기할 수 없다.",
    "R15": "채무자는 모든 변호사비용을 전액 부담한다.",
    "R16": "회사는 고객 개인정보를 동의 없이 제3자에게 제공한다.",
    "R17": "우편 발송 즉시 통지가 도달한 것으로 본다.",
    "R18": "고객은 항변권을 포기하고 이의제기할 수 없다.",
    "R19": "보증인은 모든 채무를 연대하여 전액 변제한다.",
}
SAFE = (
    "은행은 수수료 조건을 변경할 수 있다. 다만 금전 부담이 늘어나는 경우 30일 전 고객에게 개별 통지하고, 고객은 변경을 거절하여 "
    "계약을 종료할 수 있으며 변경 내용은 변경일 이후 거래에만 적용한다."
)
PARTIAL = (
    "은행은 수수료 조건을 변경할 수 있다. 변경 내용은 30일 전 개별 통지하지만 고객은 변경을 거절하거나 계약을 종료할 수 없다. "
    "변경일 이후 거래에 적용한다."
)


def _clauses(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, text string").select(
        "doc_id", "text", F.lit(0).alias("clause_ord"), F.lit(0).alias("char_start"), F.lit("article:1").alias("section_id"),
    )


def _fired(spark, rows):
    out = {d: set() for d, _ in rows}
    for r in screen.screen(_clauses(spark, rows), KOREAN_RULES).collect():
        out[r.doc_id].add(r.rule_id)
    return out


def test_gold_cases_and_one_per_rule(spark):
    fired = _fired(spark, [(c, t) for c, t, _ in GOLD] + list(ONE_EACH.items()) + [("safe", SAFE), ("partial", PARTIAL)])
    for case, _, expected in GOLD:
        assert fired[case] == expected, case
    for rule in ONE_EACH:
        assert any(f.startswith(rule) for f in fired[rule]), rule
    assert "R04_UNILATERAL_CHANGE" not in fired["safe"]
    assert "R04_UNILATERAL_CHANGE" in fired["partial"]


def test_elements_lie_inside_the_risk_span(spark):
    got = screen.screen(_clauses(spark, list(ONE_EACH.items())), KOREAN_RULES).collect()
    assert len({r.rule_id for r in got}) == 19
    for r in got:
        assert r.risk_start <= min(e.start for e in r.elements) and r.risk_end >= max(e.stop for e in r.elements)
        assert all(ONE_EACH[r.doc_id][e.start:e.stop] == e.excerpt for e in r.elements)
        assert r.strength in ("low", "medium") and "위법성 결론이 아니며" in r.rationale


def test_unknown_rules_match_nothing(spark):
    assert screen.screen(_clauses(spark, list(ONE_EACH.items())), KOREAN_RULES, ["UNKNOWN"]).count() == 0


def test_document_summary_order(spark):
    rows = [(1, 0, 0, "중간 선행", "medium"), (1, 1, 0, "높음", "high"), (1, 2, 0, "중간 반복", "medium"), (1, 3, 0, "중간 반복", "medium"), (1, 4, 0, "낮음", "low")]
    f = spark.createDataFrame(rows, "doc_id int, clause_ord int, rule_ord int, rule_name string, strength string")
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    got = {r.doc_id: r for r in summarize.summarize(docs, f).collect()}
    assert got[1].top_categories == ["높음", "중간 반복", "중간 선행"] and "외 1개 유형" in got[1].headline
    assert "위험 신호가 확인되지 않았습니다" in got[2].headline


def test_finding_sentence_fallbacks(spark):
    df = spark.createDataFrame(
        [("채권자는 대출금의 5%를 청구한다.", 0, 0, "", ""), ("일반 문장", 0, 0, "", "조건을 바꿀 수 있습니다."), ("가나다라", 0, 2, "", "")],
        "text string, a int, b int, m string, why string",
    )
    s = summarize.finding_sentence(F.lit("조건 변경"), F.col("text"), F.col("a"), F.col("b"), F.col("m"), F.col("why"))
    one, two, three = [r.s for r in df.select(s.alias("s")).collect()]
    assert "채권자" in one and "5%" in one
    assert "조건을 바꿀 수 있습니다" in two and three.startswith("‘가나’ 문구에서")


def test_rights_guidance_names_the_detected_right(spark):
    f = screen.screen(_clauses(spark, [("R18", ONE_EACH["R18"]), ("R02", ONE_EACH["R02"])]), KOREAN_RULES)
    g = spark.createDataFrame([("R18_CUSTOMER_RIGHTS_RESTRICTION", "p1", "p2", "ex", "v1")], "rule_id string, point_one string, point_two string, example_clause string, guidance_version string")
    got = {r.rule_id: r for r in summarize.attach_guidance(f, g).collect()}
    assert got["R18_CUSTOMER_RIGHTS_RESTRICTION"].revision_points == ["고객의 항변권을 원칙적으로 보존합니다.", "p2"]
    assert got["R02_UNFAIR_TERMINATION"].revision_points is None


def test_hybrid_search_finds_the_expected_law(spark):
    index = spark.createDataFrame(
        [("law:damages", "고객에게 부당하게 과중한 지연 손해금을 부담시키는 조항"), ("law:jurisdiction", "고객에게 부당하게 불리한 전속 재판관할 합의 조항")],
        "evidence_id string, text string",
    ).selectExpr("*", "0 AS collection_ord", "'statutes' AS collection", "1.0D AS authority_weight", "evidence_id AS title", "'verified' AS status", "'test' AS manifest_version")
    queries = spark.createDataFrame([("damages", "과중한 지연 손해금"), ("jurisdiction", "불리한 전속 재판관할")], "query_id string, text string")
    judged = spark.createDataFrame([("damages", ["law:damages"]), ("jurisdiction", ["law:jurisdiction"])], "case_id string, expected_evidence_ids array<string>")
    m = retrieve.retrieval_metrics(retrieve.first_relevant(retrieve.hybrid_search(queries, index, 1), judged)).collect()[0]
    assert (m.case_count, m.hit_at_k, m.mrr) == (2, 1.0, 1.0)


def _two_sided(markers):
    """Encoder with two directions; a local function travels to the workers by value."""

    def encode(texts):
        return [[0.0, 1.0] if any(m in t for m in markers) else [1.0, 0.0] for t in texts]

    return encode


def _side():
    return _two_sided(("거절하여", "명시적", "정상 예외", "절차가 필요"))


def test_gate_supports_contests_and_keeps(spark):
    cards = cand.cards_table(spark, korean.CARDS, korean.CARDS_VERSION)
    rows = [
        ("use", "R11_DEEMED_CONSENT", "고객이 계속 사용하면 새 조건에 동의한 것으로 처리한다."),
        ("silence", "R11_DEEMED_CONSENT", "고객이 48시간 동안 응답하지 않으면 변경 조건을 수용한 것으로 확정한다."),
        ("assign", "R11_DEEMED_CONSENT", "계약상 지위 이전 뒤 계속 거래하면 새 상대방을 승인한 것으로 처리한다."),
        ("safe", "R04_UNILATERAL_CHANGE", "은행은 조건을 변경할 수 있다. 30일 전 개별 통지하고 고객은 변경을 거절하여 계약을 종료할 수 있으며 변경일 이후 거래에만 적용한다."),
        ("half", "R04_UNILATERAL_CHANGE", "은행은 조건을 변경할 수 있다. 30일 전 개별 통지하지만 고객은 거절할 수 없다."),
        ("none", "R99_OTHER", "카드가 없는 규칙"),
    ]
    c = spark.createDataFrame(rows, "candidate_id string, rule_id string, text string")
    got = {r.candidate_id: r for r in cand.gate(cand.search_cards(c, cards, encoder=_side()), c).collect()}
    assert {k: got[k].status for k in ("use", "silence", "assign")} == dict.fromkeys(("use", "silence", "assign"), "supported")
    assert set(got["silence"].matched_factors) == {"bounded_silence", "silence_as_consent", "choice_absent"}
    assert got["safe"].status == "contested" and not got["safe"].kept
    assert got["half"].kept and got["half"].status != "contested"
    assert got["none"].kept and got["none"].status == "insufficient"


def _target():
    return _two_sided(("소급", "우대 혜택"))


def _prototypes(spark):
    return cand.prototypes(cand.rule_terms(spark, KOREAN_RULES), cand.taxonomy_table(spark, korean.TAXONOMY), korean.SHARED_NEGATIVE)


def test_prototypes_fall_back_to_terms(spark):
    rules = spark.createDataFrame([(0, "R1", "a", ["t1", "t2"]), (1, "R2", "b", ["u"])], "rule_ord int, rule_id string, category string, candidate_terms array<string>")
    taxonomy = spark.createDataFrame([("R2", "positive", 1, "second"), ("R2", "positive", 0, "first"), ("R1", "negative", 0, "no")], "rule_id string, polarity string, ord int, text string")
    pos, neg = cand.prototypes(rules, taxonomy, "shared")
    assert sorted((r.prototype_id, r.text) for r in pos.collect()) == [("R1:p1", "t1"), ("R1:p2", "t2"), ("R2:p1", "first"), ("R2:p2", "second")]
    assert sorted((r.category, r.text) for r in neg.collect()) == [("a", "no"), ("a", "shared"), ("b", "shared")]


def test_scoring_in_parts_equals_one_part(spark):
    v = lambda i: [float((i * 7 + j * 3) % 11) - 5 for j in range(4)]
    pos = spark.createDataFrame([(f"R{i % 6}", i % 6, f"p{i}", i, v(i)) for i in range(40)], "rule_id string, category int, prototype_id string, ord int, vec array<double>")
    neg = spark.createDataFrame([(i % 3, v(i + 50)) for i in range(10)], "category int, vec array<double>")
    segs = spark.createDataFrame([(i, v(i + 90)) for i in range(30)], "k int, vec array<double>")
    one, many = (sorted(map(tuple, cand.category_scores(segs, pos, neg, ["k"], 5.0, 1.0, part_rows=n).collect())) for n in (4096, 3))
    assert one and one == many


def test_candidates_come_from_prototypes(spark):
    pos, neg = _prototypes(spark)
    assert pos.count() == 22 and neg.filter(F.col("text") == korean.SHARED_NEGATIVE).count() == 19
    clauses = _clauses(spark, [("a", "고객의 우대금리를 소급 취소할 수 있습니다."), ("b", "평범한 문장")]).withColumn(
        "subclauses", F.array().cast("array<struct<label:string,char_start:int,char_end:int>>")
    )
    got = cand.suggest(clauses, ["doc_id", "clause_ord"], pos, neg, threshold=0.7, encoder=_target()).collect()
    assert [(r.doc_id, r.category, r.confidence) for r in got] == [("a", "retroactive_disadvantage", "high")]
    none = cand.suggest(clauses, ["doc_id", "clause_ord"], pos, neg)
    assert none.count() == 0


@pytest.fixture(scope="module")
def review_docs(spark):
    return spark.createDataFrame(
        [
            (1, "제1조 은행은 필요하다고 인정하는 경우 서비스 내용을 일방적으로 변경할 수 있다."),
            (2, "제1조 정상 조항. 성명: 홍길동"),
            (3, "제1조 " + "가" * 20_001),
            (4, "제1조 고객의 우대금리 혜택을 과거분까지 소급하여 없앤다."),
        ],
        "doc_id int, text string",
    )


def test_review_dispositions(spark, review_docs):
    got = {r.doc_id: r for r in run_review(review_docs).results.collect()}
    assert {k: v.disposition for k, v in got.items()} == {1: "ready_for_review", 2: "no_signal", 3: "needs_review", 4: "no_signal"}
    assert got[3].warnings == ["CLAUSE_TOO_LONG"] and got[1].finding_count == 1
    assert got[2].detected_types == ["name"]


def test_full_mode_keeps_rule_findings(spark, review_docs):
    protos = _prototypes(spark)
    full = run_review(review_docs, prototypes=protos, cards=cand.cards_table(spark, korean.CARDS, korean.CARDS_VERSION), encoder=_target())
    base = run_review(review_docs)
    keys = lambda r: sorted((x.doc_id, x.finding_id) for x in r.findings.select("doc_id", "finding_id").collect())
    assert keys(full) == keys(base)
    got = {r.doc_id: r.disposition for r in full.results.collect()}
    assert got[4] == "needs_review"


@pytest.mark.parametrize(("pattern", "literals"), [
    ("일방적으로", {"일방적으로"}), ("MIT|Apache|GNU", {"MIT", "Apache", "GNU"}), (r"\[EMAIL_[0-9]+\]", {"[EMAIL_"}), ("a(?:bc|de)f?x{2}", {"bc", "de"}),
    ("[0-9]+", None), ("ab|[cd]", None), ("(?i)license", None), ("x*longer(y|)", {"longer"}), ("(?=ahead)z", {"z"}), ("(", None), ("", None),
])
def test_required_literals(pattern, literals):
    found = factors.required_literals(pattern)
    assert (found and set(found)) == literals


def _generated(n):
    """Rules whose groups have alternatives of a literal with something around it."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(rnd.randint(2, 4)))
    part = lambda: rnd.choice([word(), f"{word()}[a-f]?", f"(?:{word()}|{word()})", f"{word()} ?{word()}", "[ab]c"])
    rules = [
        {"id": f"G{i}", "name": f"rule {i}", "category": f"c{i}", "context_terms": [word()], "labels": ["one"],
         "required_pattern_groups": [[part() for _ in range(rnd.randint(1, 2))] for _ in range(rnd.randint(1, 3))],
         "negative_patterns": [word()] * rnd.randint(0, 1), "negative_pattern_groups": [[word()], [word()]] if rnd.random() < 0.3 else []}
        for i in range(n)
    ]
    return RulePack("1", rules)


def test_automaton_and_literal_screening_agree(spark):
    rnd = random.Random(11)
    pack = _generated(40)
    rows = [(i, "".join(rnd.choice("abcdef .") for _ in range(rnd.randint(0, 120)))) for i in range(300)]
    clauses = spark.createDataFrame(rows, "k int, text string")
    literal, by_factor = (sorted(map(str, screen.screen(clauses, pack, literal_rules=n).collect())) for n in (1000, 0))
    assert literal and literal == by_factor
    assert screen.screen(clauses, RulePack("1", [])).count() == 0


def test_automaton_names_only_rules_whose_literals_occur():
    """A thousand rules: a text without their literals is left to the few rules that have none."""
    rnd = random.Random(12)
    finder = factors.RuleFinder([(i, r["required_pattern_groups"]) for i, r in _generated(1000).select(None)])
    assert len(finder.always) < 100
    text = "".join(rnd.choice("ghijkl .") for _ in range(2000))
    assert finder.candidates(text) == finder.always and finder.candidates("") == finder.always


def test_review_of_pages_gives_the_page_and_its_pieces(spark):
    from pactlens.plans.review import review_pages

    rule = "제1조 은행은 필요하다고 인정하는 경우 서비스 내용을"
    rows = [(1, 1, "  안내 전화 010-1234-5678 \n"), (1, 2, rule), (1, 3, "일방적으로 변경할 수 있다. 전화 010-9999-8888"), (1, 4, None), (2, 1, " "), (2, 2, None)]
    done = review_pages(spark.createDataFrame(rows, "doc_id int, page_no int, text string"))
    findings = done.findings.collect()
    assert findings and {r.doc_id for r in findings} == {1}
    body = done.documents.filter("doc_id = 1").first()
    assert body.passed and body.replacement_count == 2 and "010-" not in body.text
    for r in findings:
        page = 1 + body.text[:r.abs_start].count("\n")
        want = [(page + i, t.strip()) for i, t in enumerate(body.text[r.abs_start:r.abs_end].split("\n")) if t.strip()][:2]
        assert r.page_number == page and [(f.page_number, f.fragment) for f in r.fragments] == want
    results = {r.doc_id: r for r in done.results.collect()}
    assert set(results) == {1, 2} and done.documents.filter("doc_id = 2").first().error_code == "TEXT_EMPTY"


def test_review_of_pages_cleans_each_page_once(spark):
    """Pages are stored clean, so what reads them for ranges, assembly and fragments does not clean them again."""
    from pactlens.plans.review import review_pages

    rows = [(1, 1, " \x00 제1조 은행은 필요하다고 인정하는 경우 서비스 내용을　"), (1, 2, "\n일방적으로 변경할 수 있다. \x00a@b.com "), (2, 1, "\x00 ")]
    done = review_pages(spark.createDataFrame(rows, "doc_id int, page_no int, text string"))
    for table in (done.findings, done.documents):
        assert "translate(" not in table._jdf.queryExecution().optimizedPlan().toString()
    assert done.documents.filter("doc_id = 1").first().text == "제1조 은행은 필요하다고 인정하는 경우 서비스 내용을\n일방적으로 변경할 수 있다. [EMAIL_1]"
    found = done.findings.first()
    assert found.page_number == 1 and [f.page_number for f in found.fragments] == [1, 2]


def test_clean_page_strips_at_the_ends_only(spark):
    from pactlens.functions.text import strip
    from pactlens.operators.pages import clean_page

    texts = [None, "", " ", "\x00", "a", " a", "a\n", "\u3000a b ", "\x00 a \x00", "a\x85", "\x1c\x1d", "\r\n", "a b\r\n", "x\n\ny"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    both = rows.select(clean_page(F.col("t")).alias("a"), strip(F.translate("t", "\x00", "")).alias("b"))
    assert all(r.a == r.b for r in both.collect())
