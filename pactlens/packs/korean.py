"""The Korean financial-contract review pack.

Fixed values: rule ids, names, categories, patterns, element labels, prototype
sentences and decision cards below are data that screening results must agree
with. They are stated in rule order. Longer prose (explanations, drafting
guidance) is not bundled; ``pactlens.sources.readers`` reads it from a ruleset file.
"""

RULESET_VERSION = "0.5.0"
TAXONOMY_VERSION = "0.5.0"
CARDS_VERSION = "decision-cards-v0.1.0"

# The screening rules, in evaluation order.
RULES = [
    {
        "id": "R01_EXCESSIVE_LIQUIDATED_DAMAGES",
        "name": "과도하거나 일방적인 손해배상 예정",
        "category": "liquidated_damages",
        "required_pattern_groups": [
            ["위약금|손해배상금|예정손실액|계약종료손실액"],
            ["전액|일체|실제 손해.*(?:관계없이|확인되지 않)|[3-9](?:\\.\\d+)?%"],
            ["고객|채무자|차주|지급|부과|청구"],
        ],
        "negative_patterns": [
            "실제 발생한 손해.{0,40}입증",
        ],
        "negative_pattern_groups": [],
        "labels": ["금전 부담", "과도성 표현", "부담 주체·행위"],
        "context_terms": ["위약금", "손해배상", "고객"],
        "legal_basis_candidates": ["약관의 규제에 관한 법률 제8조", "약관의 규제에 관한 법률 제6조"],
        "candidate_terms": ["위약금", "손해배상금", "실제 손해", "전액 부담"],
    },
    {
        "id": "R02_UNFAIR_TERMINATION",
        "name": "사업자의 광범위한 임의 해지",
        "category": "unfair_termination",
        "required_pattern_groups": [
            ["해지|종료"],
            ["필요하다고 인정|임의로 판단|언제든지|적절하지 않다고 판단|계속하기.*판단"],
            ["은행|회사|사업자|채권자|금융사|당사"],
        ],
        "negative_patterns": [
            "상당한 기간.{0,30}시정",
            "법령상 해지 사유",
        ],
        "negative_pattern_groups": [],
        "labels": ["종료 행위", "포괄적 판단", "행사 주체"],
        "context_terms": ["해지", "종료", "시정"],
        "legal_basis_candidates": ["약관의 규제에 관한 법률 제9조", "약관의 규제에 관한 법률 제6조"],
        "candidate_terms": ["언제든지 해지", "임의 해지", "계약 종료"],
    },
    {
        "id": "R03_LIMITATION_OF_LIABILITY",
        "name": "사업자 책임의 포괄적 면제",
        "category": "limitation_of_liability",
        "required_pattern_groups": [
            ["책임을 지지 않|책임이 없|면책|배상 책임.*부담하지|손해배상청구.*제기하지"],
            ["어떠한|일체의|고의.*관계없이|배상.*청구하지|손실.*고객.*부담"],
            ["은행|회사|사업자|채권자|금융사|당사"],
        ],
        "negative_patterns": [
            "고의 또는 중대한 과실",
            "법령에서 정한 책임",
        ],
        "negative_pattern_groups": [],
        "labels": ["책임 배제", "포괄 범위", "면책 주체"],
        "context_terms": ["책임", "면책", "과실"],
        "legal_basis_candidates": ["약관의 규제에 관한 법률 제7조", "약관의 규제에 관한 법률 제6조"],
        "candidate_terms": ["책임 면제", "일체 책임", "면책"],
    },
    {
        "id": "R04_UNILATERAL_CHANGE",
        "name": "사업자의 일방적 계약내용 변경",
        "category": "unilateral_change",
        "required_pattern_groups": [
            ["변경|조정|상향"],
            ["할 수 있|합니다|한다"],
            ["은행|회사|사업자|채권자|금융사|대주|당사"],
            ["계약|조건|금리|수수료|우대|한도|상환방식|서비스.*범위|내용|충당.*순서"],
        ],
        "negative_patterns": [
            "고객의 명시적 동의",
            "동의하지.{0,30}(해지|종료)",
            "법령의 (제정|개정|변경)",
        ],
        "negative_pattern_groups": [
            ["[0-9]{1,3}일.{0,20}전.{0,40}(개별|서면|전자문서).{0,20}통지", "사전.{0,30}(개별|서면|전자문서).{0,20}통지"],
            ["(변경|조건).{0,30}(거절|동의하지 않).{0,40}(해지|종료).{0,15}(할 수 있|가능)", "고객.{0,30}(거절|동의하지 않).{0,40}(해지|종료).{0,15}(할 수 있|가능)"],
            ["변경일 이후", "효력발생일 이후", "장래에 한하여", "변경 이후.{0,20}(적용|거래)"],
        ],
        "labels": ["변경 행위", "변경 권한", "행사 주체", "변경 대상"],
        "context_terms": ["변경", "조정", "금리", "수수료", "계약"],
        "legal_basis_candidates": ["약관의 규제에 관한 법률 제10조", "약관의 규제에 관한 법률 제6조"],
        "candidate_terms": ["일방 변경", "조건 변경", "금리 변경", "수수료 변경"],
    },
    {
        "id": "R05_ACCELERATION",
        "name": "기한의 이익의 과도한 상실",
        "category": "acceleration",
        "required_pattern_groups": [
            ["기한의 이익.*상실|즉시.*(변제|상환)|잔여.*전부.*상환|전액.*상환"],
            ["신용상태.*악화|기타 사유|내부지침|필요하다고.*(인정|판단)|변경.*동의하지|담보.*제공하지|보증.*제공하지"],
        ],
        "negative_patterns": [
            "상당한 기간.{0,30}(이행|시정)",
            "연체한 경우.{0,40}서면.*통지",
            "회생절차|파산절차",
        ],
        "negative_pattern_groups": [],
        "labels": ["즉시 상환", "발생 조건"],
        "context_terms": ["기한의 이익", "즉시", "상환", "신용상태"],
        "legal_basis_candidates": ["약관의 규제에 관한 법률 제9조", "약관의 규제에 관한 법률 제6조"],
        "candidate_terms": ["기한의 이익", "즉시 상환", "전액 상환", "잔여 대출금"],
    },
    {
        "id": "R06_TRANSFER_OF_RIGHTS",
        "name": "고객 동의 없는 계약상 지위 이전",
        "category": "transfer_of_rights",
        "required_pattern_groups": [
            ["양도|이전|승계"],
            ["고객.*동의 없이|채무자.*동의 없이|제3자|타인"],
            ["채권|계약상 지위|은행|회사|사업자|채권자"],
        ],
        "negative_patterns": [
            "고객의 사전 동의",
            "법률에 따른 이전",
        ],
        "negative_pattern_groups": [],
        "labels": ["이전 행위", "동의 배제·이전 대상", "계약 관계"],
        "context_terms": ["양도", "이전", "동의", "제3자"],
        "legal_basis_candidates": ["약관의 규제에 관한 법률 제11조", "약관의 규제에 관한 법률 제6조"],
        "candidate_terms": ["채권 양도", "계약 이전", "제3자 이전"],
    },
    {
        "id": "R07_AUTOMATIC_RENEWAL",
        "name": "고객 선택권 없는 자동 갱신",
        "category": "automatic_renewal",
        "required_pattern_groups": [
            ["자동(으로)?|자동 갱신"],
            ["갱신|연장"],
            ["만료일|만기|고객의 의사와 관계없이|별도 통지 없이"],
        ],
        "negative_patterns": [
            "고객.*갱신 거절",
            "갱신하지 않을 의사",
            "사전 통지",
        ],
        "negative_pattern_groups": [],
        "labels": ["자동 처리", "갱신 행위", "발생 조건"],
        "context_terms": ["자동", "갱신", "연장", "고객"],
        "legal_basis_candidates": ["약관의 규제에 관한 법률 제9조", "약관의 규제에 관한 법률 제6조"],
        "candidate_terms": ["자동 갱신", "자동 연장", "만료일"],
    },
    {
        "id": "R08_EXCLUSIVE_JURISDICTION",
        "name": "고객에게 불리한 전속적 재판관할",
        "category": "exclusive_jurisdiction",
        "required_pattern_groups": [
            ["전속적?\\s*관할|전속적?\\s*합의관할|전속\\s*관할법원|법원에서만"],
            ["소재지|본점|주사무소|영업점"],
            ["은행|회사|사업자|채권자|금융사|당사"],
        ],
        "negative_patterns": [
            "민사소송법.{0,30}(정한|따른) 관할법원",
            "분쟁 발생 후.{0,30}합의",
            "고객의 주소지.{0,30}관할법원",
        ],
        "negative_pattern_groups": [],
        "labels": ["관할 제한", "지정 기준", "사업자 연계"],
        "context_terms": ["관할", "법원", "소송", "소재지"],
        "legal_basis_candidates": ["약관의 규제에 관한 법률 제14조", "약관의 규제에 관한 법률 제6조"],
        "candidate_terms": ["전속 관할", "전속 관할법원", "소재지 법원"],
    },
    {
        "id": "R09_EXCESSIVE_FEES_OR_RATE",
        "name": "과도한 수수료 또는 가산금리",
        "category": "excessive_fees_or_rate",
        "required_pattern_groups": [
            ["중도상환수수료|정액\\s*비용|행정비용|가산금리"],
            ["부담|지급|납부|청구|부과|적용|취소"],
            ["고객|채무자|차주|대출"],
            ["[3-9](?:\\.\\d+)?%|10%|증빙.{0,20}(없|없이)|기간.{0,20}관계없이|감면.{0,20}(없|하지 않)|정액"],
        ],
        "negative_patterns": [
            "실비.*증빙",
            "합리적인 산정",
            "법정.{0,20}상한",
            "최초 적용금리는",
        ],
        "negative_pattern_groups": [],
        "labels": ["비용 항목", "부과 행위", "부담 주체", "과도성 표현"],
        "context_terms": ["수수료", "가산금리", "비용", "부담"],
        "legal_basis_candidates": ["약관의 규제에 관한 법률 제6조", "약관의 규제에 관한 법률 제8조"],
        "candidate_terms": ["높은 중도상환수수료", "증빙 없는 정액비용", "감면 없는 가산금리", "기간과 관계없는 수수료"],
    },
    {
        "id": "R10_TYING_OR_ANCILLARY_TRANSACTION",
        "name": "부수거래 또는 상품 결합 강제",
        "category": "tying_or_ancillary_transaction",
        "required_pattern_groups": [
            ["신용카드|급여계좌|자동이체계좌|보험|보장성 상품|부수거래|지정 서비스"],
            ["가입|개설|유지|이용"],
            ["필수|하여야|요구|조건|지정|계속 유지"],
        ],
        "negative_patterns": [
            "선택할 수 있",
            "자율적으로",
        ],
        "negative_pattern_groups": [],
        "labels": ["부수 상품", "요구 행위", "강제 조건"],
        "context_terms": ["카드", "계좌", "보험", "조건"],
        "legal_basis_candidates": ["약관의 규제에 관한 법률 제6조"],
        "candidate_terms": ["신용카드", "급여계좌", "보험 가입", "부수거래"],
    },
    {
        "id": "R11_DEEMED_CONSENT",
        "name": "거절·이의 미표시에 따른 동의 간주",
        "category": "deemed_consent",
        "required_pattern_groups": [
            ["동의한 것으로|동의로 간주|동의한 것으로 봄|승낙한 것으로|승인한 것으로|승인의 의사표시로 해석|최종 확정한 것으로"],
            ["거절.*표시하지 않|거절하지 않|이의.*없으면|이의.*제기하지 않|이의.*제출하지 않|계속.*이용|포괄적으로 동의|모두.*확인|일체.*확인"],
        ],
        "negative_patterns": [
            "명시적으로 동의",
        ],
        "negative_pattern_groups": [],
        "labels": ["동의 간주", "침묵·계속 이용 조건"],
        "context_terms": ["동의", "거절", "이의", "간주"],
        "legal_basis_candidates": ["약관의 규제에 관한 법률 제6조"],
        "candidate_terms": ["동의 간주", "이의 없음", "거절 의사"],
    },
    {
        "id": "R12_RETROACTIVE_DISADVANTAGE",
        "name": "소급적 불이익 또는 혜택 취소",
        "category": "retroactive_disadvantage",
        "required_pattern_groups": [
            ["소급.*취소|소급.*적용|모두 취소"],
            ["우대금리|우대조건|혜택|할인"],
        ],
        "negative_patterns": [
            "고객에게 유리하게",
            "명시적 동의",
        ],
        "negative_pattern_groups": [],
        "labels": ["소급 적용", "취소 대상"],
        "context_terms": ["소급", "우대", "취소", "혜택"],
        "legal_basis_candidates": ["약관의 규제에 관한 법률 제6조"],
        "candidate_terms": ["소급 취소", "우대금리", "우대금리 취소", "소급 적용", "혜택"],
    },
    {
        "id": "R13_ADDITIONAL_COLLATERAL_OR_GUARANTEE",
        "name": "포괄적 추가 담보 또는 보증 요구",
        "category": "additional_collateral_or_guarantee",
        "required_pattern_groups": [
            ["추가 담보|담보 보강|보증인 추가|연대보증|담보.*제공"],
            ["요구|제출|하여야|청구"],
            ["채권자|은행|금융사|대주|당사"],
        ],
        "negative_patterns": [
            "객관적인 담보가치",
            "고객의 동의",
        ],
        "negative_pattern_groups": [],
        "labels": ["추가 부담", "요구 행위", "요구 주체"],
        "context_terms": ["담보", "보증", "추가", "요구"],
        "legal_basis_candidates": ["약관의 규제에 관한 법률 제6조"],
        "candidate_terms": ["추가 담보", "연대보증", "담보 제공"],
    },
    {
        "id": "R14_EVIDENCE_MONOPOLY_AND_OBJECTION_LIMIT",
        "name": "사업자 기록의 일방적 증거화와 이의 제한",
        "category": "evidence_monopoly_and_objection_limit",
        "required_pattern_groups": [
            ["최종 증거|최종적인 증거|우선 증거"],
            ["기록|장부|전산"],
            ["이의.*제기.*제한|이의.*할 수 없|금융사|채권자|은행"],
        ],
        "negative_patterns": [
            "반증할 수 있",
            "고객의 이의 제기",
        ],
        "negative_pattern_groups": [],
        "labels": ["일방적 증거", "사업자 기록", "이의 제한"],
        "context_terms": ["증거", "기록", "이의", "전산"],
        "legal_basis_candidates": ["약관의 규제에 관한 법률 제6조"],
        "candidate_terms": ["최종 증거", "전산 기록", "이의 제한"],
    },
    {
        "id": "R15_UNFAIR_COST_SHIFTING",
        "name": "사업자 비용의 부당한 고객 전가",
        "category": "unfair_cost_shifting",
        "required_pattern_groups": [
            ["비용|경비|제세공과금|변호사비용"],
            ["고객|채무자|차주"],
            ["전액.*부담|모두.*부담|일체.*부담|사업자.*비용.*부담|금융사.*비용.*(?:고객|채무자|차주).*부담|비용.*(?:고객|채무자|차주).*부담"],
        ],
        "negative_patterns": [
            "귀책사유에 따라",
            "실제 발생.{0,20}입증",
            "법령에서 정한",
        ],
        "negative_pattern_groups": [],
        "labels": ["전가 비용", "부담 주체", "포괄 전가"],
        "context_terms": ["비용", "부담", "전액", "고객"],
        "legal_basis_candidates": ["약관의 규제에 관한 법률 제6조", "약관의 규제에 관한 법률 제7조"],
        "candidate_terms": ["사업자 비용을 고객에게 전가", "모든 소송비용 고객 부담", "제세공과금 전액 부담"],
    },
    {
        "id": "R16_BROAD_DATA_USE_OR_THIRD_PARTY_SHARING",
        "name": "포괄적 개인정보 이용 또는 제3자 제공",
        "category": "broad_data_use_or_third_party_sharing",
        "required_pattern_groups": [
            ["개인정보|신용정보|고객정보|거래정보"],
            ["제3자.*제공|제휴회사.*제공|공유|목적 외.*이용|마케팅.*제공|포괄적.*이용"],
            ["동의 없이|별도 동의 없이|포괄적으로 동의|홈페이지.*갈음|국내외.*(?:계열사|제휴사)|언제든지|모든|일체"],
        ],
        "negative_patterns": [
            "별도 동의를 받",
            "법령상 의무",
            "목적과 항목.{0,20}고지",
        ],
        "negative_pattern_groups": [],
        "labels": ["이용 정보", "이용·제공 행위", "포괄 범위"],
        "context_terms": ["개인정보", "제3자", "제공", "동의"],
        "legal_basis_candidates": ["약관의 규제에 관한 법률 제6조", "약관의 규제에 관한 법률 제11조"],
        "candidate_terms": ["동의 없는 개인정보 제3자 제공", "고객정보 목적 외 이용", "모든 신용정보 공유"],
    },
    {
        "id": "R17_DEEMED_OR_INADEQUATE_NOTICE",
        "name": "통지 간주 또는 불충분한 통지",
        "category": "deemed_or_inadequate_notice",
        "required_pattern_groups": [
            ["통지|도달|발송"],
            ["도달한 것으로|통지한 것으로|발송.*효력|게시.*(?:효력|유효)|수령 여부.*관계없이"],
            ["간주|본다|효력|유효"],
        ],
        "negative_patterns": [
            "실제 도달",
            "수령 확인",
            "개별 통지",
        ],
        "negative_pattern_groups": [],
        "labels": ["통지 행위", "도달 간주", "효력 표현"],
        "context_terms": ["통지", "도달", "수령", "간주"],
        "legal_basis_candidates": ["약관의 규제에 관한 법률 제6조"],
        "candidate_terms": ["수령하지 않아도 통지로 간주", "게시만으로 통지 효력", "발송 즉시 도달 간주"],
    },
    {
        "id": "R18_CUSTOMER_RIGHTS_RESTRICTION",
        "name": "고객의 이의제기·해지·방어권 제한",
        "category": "customer_rights_restriction",
        "required_pattern_groups": [
            ["이의제기|이의|항변권|상계권|해지권|해지|철회|취소권|민원|손해배상청구|다투|다툴|소송"],
            ["할 수 없|수 없|하지 않기로|포기|제한|배제|승인을 받아야"],
            ["고객|채무자|차주"],
        ],
        "negative_patterns": [
            "법령에 따른 권리.{0,20}보장",
            "정당한 사유",
        ],
        "negative_pattern_groups": [],
        "labels": ["제한되는 권리", "제한 방식", "영향받는 주체"],
        "context_terms": ["권리", "제한", "이의", "포기"],
        "legal_basis_candidates": ["약관의 규제에 관한 법률 제6조", "약관의 규제에 관한 법률 제11조"],
        "candidate_terms": ["고객의 이의제기 금지", "항변권 포기", "해지권 제한", "소송 권리 배제"],
    },
    {
        "id": "R19_REPRESENTATIVE_OR_GUARANTOR_BURDEN",
        "name": "대리인·보증인의 포괄적 책임 부담",
        "category": "representative_or_guarantor_burden",
        "required_pattern_groups": [
            ["대리인|보증인|연대보증인"],
            ["책임|채무|변제|상환"],
            ["연대하여|일체|모든|전액|본인과 동일"],
        ],
        "negative_patterns": [
            "보증 범위와 기간",
            "최고액.{0,20}명시",
            "개별 동의",
        ],
        "negative_pattern_groups": [],
        "labels": ["책임 주체", "책임 내용", "포괄 범위"],
        "context_terms": ["대리인", "보증인", "책임", "연대"],
        "legal_basis_candidates": ["약관의 규제에 관한 법률 제6조"],
        "candidate_terms": ["대리인이 본인과 동일한 책임", "보증인이 모든 채무 부담", "보증인 전액 연대 책임"],
    },
]

# Positive prototypes and hard negatives per rule.
TAXONOMY = [
    {
        "rule_id": "R01_EXCESSIVE_LIQUIDATED_DAMAGES",
        "positive_prototypes": [
            "실제 손해와 관계없이 고객에게 위약금이나 손해배상금 전액을 부담시킨다.",
        ],
        "hard_negatives": [
            "입증된 실제 손해 범위에서만 배상한다.",
        ],
    },
    {
        "rule_id": "R02_UNFAIR_TERMINATION",
        "positive_prototypes": [
            "금융회사가 자신의 판단만으로 언제든지 계약을 해지할 수 있다.",
        ],
        "hard_negatives": [
            "중대한 위반을 통지하고 시정기간 후 해지한다.",
        ],
    },
    {
        "rule_id": "R03_LIMITATION_OF_LIABILITY",
        "positive_prototypes": [
            "금융회사는 고의나 과실이 있어도 모든 책임을 지지 않는다.",
        ],
        "hard_negatives": [
            "고의 또는 중대한 과실에 대한 책임은 부담한다.",
        ],
    },
    {
        "rule_id": "R04_UNILATERAL_CHANGE",
        "positive_prototypes": [
            "채권자가 고객 동의 없이 계약 조건이나 금리와 수수료를 일방적으로 변경한다.",
        ],
        "hard_negatives": [
            "고객의 명시적 동의를 받아 계약을 변경한다.",
        ],
    },
    {
        "rule_id": "R05_ACCELERATION",
        "positive_prototypes": [
            "포괄적인 사유나 변경 거부만으로 잔여 대출금 전액을 즉시 상환하게 한다.",
        ],
        "hard_negatives": [
            "중대한 연체를 통지하고 시정기간 후 기한의 이익을 상실한다.",
        ],
    },
    {
        "rule_id": "R06_TRANSFER_OF_RIGHTS",
        "positive_prototypes": [
            "고객 동의 없이 채권이나 계약상 지위를 제3자에게 양도한다.",
        ],
        "hard_negatives": [
            "고객에게 이전 내용을 알리고 필요한 동의를 받는다.",
        ],
    },
    {
        "rule_id": "R07_AUTOMATIC_RENEWAL",
        "positive_prototypes": [
            "계약 만료 때 고객의 선택이나 통지 없이 자동으로 갱신된다.",
        ],
        "hard_negatives": [
            "갱신 전에 고객에게 알리고 거절할 수 있게 한다.",
        ],
    },
    {
        "rule_id": "R08_EXCLUSIVE_JURISDICTION",
        "positive_prototypes": [
            "금융회사 소재지 법원만 전속 관할법원으로 정하여 고객의 선택을 막는다.",
        ],
        "hard_negatives": [
            "법정 관할이나 고객 주소지 법원을 선택할 수 있다.",
        ],
    },
    {
        "rule_id": "R09_EXCESSIVE_FEES_OR_RATE",
        "positive_prototypes": [
            "높은 중도상환수수료나 증빙 없는 정액비용과 가산금리를 고객에게 부과한다.",
        ],
        "hard_negatives": [
            "증빙된 실제 비용과 공개된 상한 안에서만 수수료를 받는다.",
        ],
    },
    {
        "rule_id": "R10_TYING_OR_ANCILLARY_TRANSACTION",
        "positive_prototypes": [
            "대출 조건으로 신용카드 급여계좌 보험 같은 다른 상품 가입을 강제한다.",
        ],
        "hard_negatives": [
            "부수 상품은 대출과 무관하게 고객이 자유롭게 선택한다.",
        ],
    },
    {
        "rule_id": "R11_DEEMED_CONSENT",
        "positive_prototypes": [
            "고객이 거절하거나 이의를 표시하지 않으면 계약 변경에 동의한 것으로 간주한다.",
            "고객이 계속 상품을 사용하거나 보유하는 행동을 변경된 조건에 동의한 의사 표시로 해석한다.",
            "고객이 정해진 시간 동안 응답하지 않으면 변경 조건을 수용한 것으로 확정한다.",
            "고객이 계약상 지위가 이전된 뒤에도 거래를 계속하면 새 상대방을 승인한 것으로 처리한다.",
        ],
        "hard_negatives": [
            "중요한 변경은 고객의 명시적 동의를 받는다.",
            "고객이 동의하지 않으면 불이익 없이 계약을 종료할 수 있다.",
        ],
    },
    {
        "rule_id": "R12_RETROACTIVE_DISADVANTAGE",
        "positive_prototypes": [
            "이미 적용한 우대 혜택을 과거 기간까지 거슬러 취소하여 고객에게 불이익을 준다.",
        ],
        "hard_negatives": [
            "불리한 조건 변경은 통지 이후 장래에만 적용한다.",
        ],
    },
    {
        "rule_id": "R13_ADDITIONAL_COLLATERAL_OR_GUARANTEE",
        "positive_prototypes": [
            "금융회사가 객관적 기준 없이 언제든 추가 담보나 연대보증을 요구한다.",
        ],
        "hard_negatives": [
            "구체적인 담보가치 하락 범위에서만 추가 담보를 요청한다.",
        ],
    },
    {
        "rule_id": "R14_EVIDENCE_MONOPOLY_AND_OBJECTION_LIMIT",
        "positive_prototypes": [
            "금융회사 전산 기록을 최종 증거로 정하고 고객의 이의나 반증을 금지한다.",
        ],
        "hard_negatives": [
            "금융회사 기록에 대해 고객이 이의를 제기하고 반증할 수 있다.",
        ],
    },
    {
        "rule_id": "R15_UNFAIR_COST_SHIFTING",
        "positive_prototypes": [
            "금융회사가 부담할 소송비용과 경비까지 귀책과 관계없이 고객에게 모두 전가한다.",
        ],
        "hard_negatives": [
            "각자의 귀책에 따라 실제 입증된 비용만 부담한다.",
        ],
    },
    {
        "rule_id": "R16_BROAD_DATA_USE_OR_THIRD_PARTY_SHARING",
        "positive_prototypes": [
            "고객 동의 없이 개인정보와 신용정보를 목적 외로 이용하거나 제3자에게 제공한다.",
        ],
        "hard_negatives": [
            "구체적인 목적과 항목을 고지하고 별도 동의를 받는다.",
        ],
    },
    {
        "rule_id": "R17_DEEMED_OR_INADEQUATE_NOTICE",
        "positive_prototypes": [
            "고객이 실제로 받지 않아도 발송이나 게시만 하면 통지가 도달한 것으로 간주한다.",
        ],
        "hard_negatives": [
            "중요 통지의 실제 수령을 확인하고 미도달 때 다시 전달한다.",
        ],
    },
    {
        "rule_id": "R18_CUSTOMER_RIGHTS_RESTRICTION",
        "positive_prototypes": [
            "고객의 이의제기 항변 상계 해지 소송 같은 권리를 포기시키거나 제한한다.",
        ],
        "hard_negatives": [
            "고객의 법률상 권리와 실질적인 구제 절차를 보장한다.",
        ],
    },
    {
        "rule_id": "R19_REPRESENTATIVE_OR_GUARANTOR_BURDEN",
        "positive_prototypes": [
            "대리인이나 보증인이 본인과 똑같이 모든 채무를 제한 없이 갚도록 한다.",
        ],
        "hard_negatives": [
            "보증 최고액과 기간 및 책임 범위를 명확히 정한다.",
        ],
    },
]

# Fixed value: the negative example every category shares.
SHARED_NEGATIVE = "고객은 약정한 날짜에 원금과 이자를 정상적으로 상환한다."

# Decision cards used by the exception gate.
CARDS = [
    {
        "card_id": "R04:risk:unilateral-economic-change",
        "rule_id": "R04_UNILATERAL_CHANGE",
        "polarity": "risk_pattern",
        "title": "고객 선택권 없는 중요 조건 변경",
        "source_class": "synthetic_development_pattern",
        "review_status": "synthetic_verified",
        "evaluation_split": "development",
        "factor_groups": [
            {"code": "business_controls_change", "patterns": ["은행|회사|사업자|채권자|금융사", "일방|임의|내부.*판단"]},
            {"code": "important_term_changes", "patterns": ["조건|금리|수수료|한도|상환|서비스", "변경|조정|상향|재설계"]},
            {"code": "choice_absent", "patterns": ["동의 없이|승낙 없이|거절.*수 없|종료.*수 없|선택권.*없"]},
        ],
        "text": "사업자가 고객의 동의나 실질적인 거절 선택권 없이 금리, 수수료 또는 계약의 중요 조건을 변경하는 구조는 일방적 변경 위험을 검토해야 한다.",
    },
    {
        "card_id": "R04:safe:notice-exit-prospective",
        "rule_id": "R04_UNILATERAL_CHANGE",
        "polarity": "safe_exception",
        "title": "사전 통지와 종료권이 보장된 장래 변경",
        "source_class": "synthetic_development_pattern",
        "review_status": "synthetic_verified",
        "evaluation_split": "development",
        "factor_groups": [
            {"code": "advance_individual_notice", "patterns": ["[0-9]{1,3}일.{0,20}전.{0,30}(개별|서면|전자문서).{0,20}통지", "사전.{0,30}(개별|서면|전자문서).{0,20}통지"]},
            {"code": "meaningful_rejection_or_exit", "patterns": ["(변경|조건).{0,30}(거절|동의하지 않).{0,40}(해지|종료).{0,15}(할 수 있|가능)", "고객.{0,30}(거절|동의하지 않).{0,40}(해지|종료).{0,15}(할 수 있|가능)"]},
            {"code": "prospective_effect", "patterns": ["변경일 이후", "효력발생일 이후", "장래에 한하여", "변경 이후.{0,20}(적용|거래)"]},
        ],
        "text": "불리한 변경을 사전에 고객에게 개별 통지하고 고객이 변경을 거절해 계약을 종료할 수 있으며 변경이 장래에만 적용되는 절차는 정상 예외를 검토해야 한다.",
    },
    {
        "card_id": "R11:risk:continued-use-consent",
        "rule_id": "R11_DEEMED_CONSENT",
        "polarity": "risk_pattern",
        "title": "계속 이용 또는 보유를 동의로 간주",
        "source_class": "synthetic_development_pattern",
        "review_status": "synthetic_verified",
        "evaluation_split": "development",
        "factor_groups": [
            {"code": "continued_behavior", "patterns": ["계속.{0,20}(이용|사용|보유)", "이용을 계속|사용을 계속|보유를 계속"]},
            {"code": "behavior_as_consent", "patterns": ["동의|승인|수용|승낙", "의사.*표시|받아들인 것으로"]},
            {"code": "changed_terms", "patterns": ["새.{0,10}조건|변경.{0,10}조건|재설계|불이익|경제조건"]},
        ],
        "text": "고객이 상품을 계속 사용하거나 보유하는 행동만으로 변경된 조건에 동의한 것으로 처리하는 구조는 묵시적 동의 위험을 검토해야 한다.",
    },
    {
        "card_id": "R11:risk:silence-consent",
        "rule_id": "R11_DEEMED_CONSENT",
        "polarity": "risk_pattern",
        "title": "정해진 시간의 무응답을 수용으로 확정",
        "source_class": "synthetic_development_pattern",
        "review_status": "synthetic_verified",
        "evaluation_split": "development",
        "factor_groups": [
            {"code": "bounded_silence", "patterns": ["[0-9]{1,3}(시간|일).{0,30}(응답하지 않|무응답|이의.*없)", "기간.{0,20}(응답하지 않|무응답|이의.*없)"]},
            {"code": "silence_as_consent", "patterns": ["동의|승인|수용|승낙|확정"]},
            {"code": "choice_absent", "patterns": ["응답하지 않|무응답|이의.*없|침묵"]},
        ],
        "text": "고객이 짧게 정해진 시간 동안 응답하지 않았다는 이유만으로 변경이나 정산을 수용한 것으로 확정하는 구조는 동의 간주 위험을 검토해야 한다.",
    },
    {
        "card_id": "R11:risk:continued-transaction-assignment",
        "rule_id": "R11_DEEMED_CONSENT",
        "polarity": "risk_pattern",
        "title": "계속 거래를 계약상 지위 이전 승인으로 간주",
        "source_class": "synthetic_development_pattern",
        "review_status": "synthetic_verified",
        "evaluation_split": "development",
        "factor_groups": [
            {"code": "continued_transaction", "patterns": ["계속.{0,20}거래", "거래를 계속"]},
            {"code": "assignment_context", "patterns": ["지위.{0,20}이전|채권.{0,20}(양도|이전)|새.{0,10}상대방"]},
            {"code": "transaction_as_approval", "patterns": ["동의|승인|수용|승낙|받아들인 것으로"]},
        ],
        "text": "계약상 지위나 채권이 이전된 뒤 고객이 거래를 계속했다는 사정만으로 새 상대방을 승인한 것으로 처리하는 구조는 동의 간주 위험을 검토해야 한다.",
    },
    {
        "card_id": "R11:safe:explicit-opt-in",
        "rule_id": "R11_DEEMED_CONSENT",
        "polarity": "safe_exception",
        "title": "중요 변경에 대한 명시적 동의",
        "source_class": "synthetic_development_pattern",
        "review_status": "synthetic_verified",
        "evaluation_split": "development",
        "factor_groups": [
            {"code": "explicit_opt_in", "patterns": ["명시적.{0,20}동의", "서면.{0,20}동의", "전자서명.{0,20}동의"]},
            {"code": "no_silence_substitution", "patterns": ["무응답.{0,20}동의로.{0,10}보지 않", "침묵.{0,20}동의로.{0,10}보지 않", "별도.{0,20}동의"]},
        ],
        "text": "중요한 조건 변경은 고객의 별도 명시적 동의를 받고 침묵이나 계속 이용을 동의로 대체하지 않는 절차가 필요하다.",
    },
]
