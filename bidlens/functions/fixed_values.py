"""Fixed values.

Word lists, thresholds and formats that results depend on.  They are data, stated once,
in their natural order (order decides the first match in several operators).
"""

# ---- fixed values: sizes and thresholds -------------------------------------------------
CHUNK_CHARS = 1600
CHUNK_OVERLAP = 180
CHUNK_STEP = CHUNK_CHARS - CHUNK_OVERLAP
OCR_MIN_CHARS = 80
CITATION_MIN_SCORE = 0.25
MASK_MAX_CHARS = 1200
SUGGESTION_TAKE = 0.7
SUGGESTION_REVIEW = 0.5
MAX_TOP_K = 20
SUPPORTED_EXTENSIONS = [".pdf", ".docx"]

# ---- fixed values: labels of types and states -------------------------------------------
REQUIREMENT_TYPE_LABELS = {
    "region": "지역 제한", "license": "면허/업종", "company_type": "기업유형",
    "required_document": "제출/증빙서류", "money": "금액 조건", "date": "일정 조건",
    "requirement_line": "원문 요구조건",
}
REQUIREMENT_CONFIDENCE = {
    "region": 0.84, "license": 0.86, "company_type": 0.8, "required_document": 0.76,
    "money": 0.72, "date": 0.72, "requirement_line": 0.64,
}
REQUIREMENT_SOURCE_TEXT = {
    "region": "공고 지역 제한", "license": "공고 면허/업종 제한", "company_type": "공고 기업유형/우대조건",
    "required_document": "공고 제출/증빙서류", "money": "공고 금액 조건", "date": "공고 일정 조건",
}
MONEY_LABELS = {"presmpt_prce": "추정가격", "bdgt_amt": "예산금액", "bssamt": "기초금액"}
DATE_LABELS = {"bid_ntce_dt": "공고일시", "bid_begin_dt": "입찰개시", "bid_clse_dt": "입찰마감", "openg_dt": "개찰일시"}
MANUAL_TYPES = ["money", "date", "requirement_line"]
SEMANTIC_TYPES = ["region", "license", "company_type", "required_document", "requirement_line"]
COMPARISON_STATUSES = ["prepared", "possibly_missing", "needs_review", "not_found"]
JUDGMENT_STATUSES = ["matched", "missing", "uncertain", "needs_review", "not_applicable"]
SUGGESTION_STATUSES = ["matched", "missing", "needs_review", "uncertain"]
RULE_STATUSES = ["needs_review", "approved", "rejected", "archived"]
DEFAULT_GROUP = "기본 관리그룹"
REQUIREMENT_PROFILE_FIELDS = {
    "region": ["region", "business_address", "headquarters_address"],
    "license": ["license_summary", "business_type", "business_item", "procurement_registration_status"],
    "company_type": ["company_size_classification", "certifications_json", "preference_tags_json"],
    "required_document": ["corporation_evidence_documents", "approved_evidence_labels"],
}
RULE_PROFILE_FIELDS = {
    **REQUIREMENT_PROFILE_FIELDS,
    "required_document": ["approved_evidence_labels", "corporation_evidence_documents"],
}
MANUAL_PROFILE_FIELDS = ["manual_review"]
FALLBACK_EVIDENCE = {
    "license": "면허/등록/허가증", "region": "사업장 소재지 증빙",
    "company_type": "기업유형 확인서", "required_document": "제출서류",
}

# ---- fixed values: dictionaries, canonical label -> aliases -------------------------------
REGION_ALIASES = {
    "서울": ["서울", "서울특별시"], "부산": ["부산", "부산광역시"], "대구": ["대구", "대구광역시"],
    "인천": ["인천", "인천광역시"], "광주": ["광주", "광주광역시"], "대전": ["대전", "대전광역시"],
    "울산": ["울산", "울산광역시"], "세종": ["세종", "세종특별자치시"], "경기": ["경기", "경기도"],
    "강원": ["강원", "강원도", "강원특별자치도"], "충북": ["충북", "충청북도"], "충남": ["충남", "충청남도"],
    "전북": ["전북", "전라북도", "전북특별자치도"], "전남": ["전남", "전라남도"], "경북": ["경북", "경상북도"],
    "경남": ["경남", "경상남도"], "제주": ["제주", "제주도", "제주특별자치도"],
}
REGION_WORD = "[가-힣]{2,12}(?:시|군|구)"
REGION_FALSE_WORDS = ["공고시", "개찰시", "입찰시", "공고일시", "입찰개시", "개찰일시"]
LICENSE_ALIASES = {
    "건설업": ["건설업"],
    "조경식재": ["조경식재", "조경식재공사업", "조경식재·시설물공사업", "조경식재시설물공사업"],
    "조경시설물": ["조경시설물", "조경시설물설치공사업", "조경식재·시설물공사업", "조경식재시설물공사업"],
    "산림사업법인": ["산림사업법인", "산림사업"],
    "전기공사업": ["전기공사업", "전기공사"],
    "정보통신공사업": ["정보통신공사업", "정보통신공사"],
    "소방시설공사업": ["소방시설공사업", "전문소방시설공사업", "일반소방시설공사업"],
    "폐기물처리": ["폐기물처리", "폐기물처리업"],
    "엔지니어링사업자": ["엔지니어링사업자", "엔지니어링활동주체"],
    "소프트웨어사업자": ["소프트웨어사업자", "소프트웨어사업"],
    "직접생산확인": ["직접생산확인", "직접생산확인증명서"],
}
COMPANY_ALIASES = {
    "중소기업": ["중소기업", "중소기업자"], "소기업": ["소기업"], "소상공인": ["소상공인"], "여성기업": ["여성기업"],
    "장애인기업": ["장애인기업"], "사회적기업": ["사회적기업"], "창업기업": ["창업기업"], "벤처기업": ["벤처기업"],
}
DOCUMENT_ALIASES = {
    "사업자등록증": ["사업자등록증", "사업자 등록증"],
    "법인등기부등본": ["법인등기부등본", "법인 등기부 등본", "등기사항전부증명서"],
    "인감증명서": ["인감증명서", "법인인감증명서"],
    "사용인감계": ["사용인감계"],
    "국세 납세증명서": ["국세 납세증명서", "국세납세증명서"],
    "지방세 납세증명서": ["지방세 납세증명서", "지방세납세증명서"],
    "4대보험 완납증명서": ["4대보험 완납증명서", "4대 보험 완납증명서", "보험료 완납증명서"],
    "중소기업확인서": ["중소기업확인서", "중소기업 확인서"],
    "직접생산확인증명서": ["직접생산확인증명서", "직접생산 확인증명서", "직접생산확인"],
    "나라장터 경쟁입찰참가자격 등록증": ["경쟁입찰참가자격 등록증", "입찰참가자격 등록증", "나라장터 등록증"],
    "기업신용평가등급확인서": ["기업신용평가등급확인서", "신용평가등급확인서", "신용평가등급"],
    "실적증명서": ["실적증명서", "수행실적증명서"],
    "입찰보증서": ["입찰보증서", "입찰보증금"],
    "청렴계약이행서약서": ["청렴계약이행서약서", "청렴계약 이행서약서"],
}
# an alias that only counts where it stands outside the longer word
SHADOWED_ALIASES = {"소기업": "중소기업"}
# company-type label -> confirmation; first that matches wins, contained in the label
COMPANY_EVIDENCE = [
    (["여성"], "여성기업확인서"), (["장애인"], "장애인기업확인서"), (["소기업", "소상공인", "중소기업"], "중소기업확인서"),
]

# ---- fixed values: keywords of rule and requirement lines ---------------------------------
RULE_LINE_KEYWORDS = [
    "참가자격", "입찰참가", "자격요건", "제출", "증빙", "확인서", "면허", "등록", "소기업", "중소기업", "여성기업",
    "직접생산", "지역", "영업소", "qualification", "license", "certificate", "document", "submit",
    "small business", "required",
]
REQUIREMENT_LINE_KEYWORDS = [
    "참가자격", "입찰참가", "입찰 참가", "제출서류", "제출 서류", "구비서류", "자격요건", "등록요건", "면허", "업종",
    "직접생산", "중소기업", "소기업", "소상공인", "지역제한", "영업소",
]
RULE_LOWER_TOKENS = {
    "company_type": ["small business", "women-owned", "disabled-owned", "company type"],
    "license": ["license", "permit", "registered contractor", "construction business"],
    "required_document": ["certificate", "document", "tax payment", "business registration"],
}
RULE_MODAL_TOKENS = ["하여야", "해야", "제출", "등록", "보유", "갖추"]
RULE_MODAL_LOWER_TOKENS = ["must", "shall", "submit", "hold", "required"]
FORBIDDEN_TERMS = ["eligible", "not eligible", "지원 가능", "지원 불가능"]
DISPLAY_REPLACEMENTS = [
    ("보강 필요", "준비 필요"), ("보강할", "준비할"), ("보강 사유", "준비 사유"), ("보강이 필요", "준비가 필요"),
    ("보강하세요", "자료를 보완하세요"), ("보강", "보완"), ("citation", "근거"),
]

# ---- fixed values: masking patterns ---------------------------------------------------------
SENSITIVE_KEY = (
    "(?i)(api[_-]?key|service[_-]?key|servicekey|authorization|access[_-]?token|refresh[_-]?token|token|secret|password)"
)
REDACTED, REDACTED_RRN = "[REDACTED]", "[REDACTED_RRN]"

# ---- fixed values: notices --------------------------------------------------------------------
BUSINESS_TYPE_ALIASES = {
    "cnstwk": "construction", "공사": "construction", "servc": "service", "용역": "service", "thng": "goods",
    "물품": "goods", "goods": "goods", "etc": "etc", "기타": "etc", "all": "all", "전체": "all",
    "construction": "construction", "service": "service",
}
BUSINESS_TYPES = ["construction", "service", "goods", "etc"]
BUSINESS_TYPE_KEYS = ["business_type", "_nara_business_type", "businessType", "bsnsDivNm", "bidNtceBgn"]
BUSINESS_TYPE_OPERATIONS = [
    ("getbidpblanclistinfoservc", "service"), ("getbidpblanclistinfothng", "goods"),
    ("getbidpblanclistinfocnstwk", "construction"), ("getbidpblanclistinfoetc", "etc"),
]
BUSINESS_TYPE_WORDS = [
    ("용역", "service"), ("물품", "goods"), ("구매", "goods"), ("제조", "goods"), ("공사", "construction"), ("기타", "etc"),
]
NOTICE_FIELDS = {
    "business_type": ["business_type", "businessType", "_nara_business_type", "bsnsDivNm"],
    "business_type_label": ["business_type_label", "businessTypeLabel", "bsnsDivNm"],
    "bid_ntce_no": ["bidNtceNo"], "bid_ntce_ord": ["bidNtceOrd"], "bid_ntce_nm": ["bidNtceNm"],
    "ntce_instt_nm": ["ntceInsttNm"], "dminstt_nm": ["dminsttNm"], "bid_ntce_dt": ["bidNtceDt"],
    "bid_begin_dt": ["bidBeginDt"], "bid_clse_dt": ["bidClseDt"], "openg_dt": ["opengDt"],
    "presmpt_prce": ["presmptPrce", "asignBdgtAmt"], "bdgt_amt": ["bdgtAmt", "asignBdgtAmt"],
    "bssamt": ["bssamt", "bssAmt"], "region_text": ["prtcptPsblRgnNm", "cnstrtsiteRgnNm", "rgstTyNm"],
    "license_text": ["lcnsLmtNm", "indstrytyNm", "indstrytyLmtYn"], "source_url": ["bidNtceUrl", "bidNtceDtlUrl"],
}
DEFAULT_NOTICE_ORDER = "000"
STANDARD_NOTICE_NAME = "표준공고문.pdf"
SERVICE_WORDS = ["용역", "위탁", "운영", "유지관리", "관리", "대행", "컨설팅", "설계"]
CONTRACT_CUSTOM_FIELDS = [
    "contract_number", "buyer_representative_name", "buyer_address", "corporation_phone", "total_service_amount",
    "contract_deposit", "delay_penalty_rate", "contract_period", "delivery_location", "other_terms", "attachment_notes",
]

# ---- fixed values: text quality -----------------------------------------------------------------
REQUIRED_TERMS = ["직접생산", "확인기준", "중소기업자간", "경쟁제품", "세부품명", "생산시설", "검사설비"]
TABLE_TERMS = ["세부품명", "품명", "제품명", "생산시설", "생산설비", "검사설비", "검사시설", "기준"]
TABLE_HEADER_TERMS = [
    "항목", "내용", "비고", "연번", "생산시설", "생산공정", "세부", "설명", "품명", "기준", "item", "content", "note",
]
DEFAULT_LINE_QUERIES = [
    "직접생산 확인기준", "중소기업자간 경쟁제품", "세부품명 직접생산", "생산시설 검사설비", "공장등록 직접생산",
]
TERM_STOPWORDS = ["기준", "확인", "한다", "있는", "없는", "따른", "경우", "제조", "제품"]
MOJIBAKE_TOKENS = [
    "�", "Ã", "Â", "ì", "í", "î", "ï", "ê", "ë", "ã", "â",
    "ð", "異", "媛", "寃", "援", "以", "利", "肄", "潡", "愿", "袁",
    "냅뜲", "댄드", "깅깃", "듦낙", "뗎다",
]

# ---- fixed values: operations ---------------------------------------------------------------------
FAILURE_STATUSES = ["failed", "partial_failed", "needs_ocr_setup", "unavailable", "not_configured"]
RUNNING_NOTICE_STATUSES = ["pending", "queued", "saving", "processing"]

# ---- fixed values: company profile -------------------------------------------------------------------
READINESS_LABELS = [
    ("business_registration_number", "사업자등록번호"), ("representative_name", "대표자"),
    ("business_address", "사업장 주소"), ("business_category", "업종/종목"), ("region", "지역"),
    ("company_size_classification", "기업 규모"), ("certifications", "인증/확인서"),
    ("preference_or_direct_production", "우대조건/직접생산"), ("license_or_procurement", "면허/나라장터 등록"),
    ("approved_evidence", "승인된 증빙 이력"),
]
WATCHED_COMPANY_FIELDS = [
    "name", "management_group_name", "business_category", "region", "certifications_json",
    "company_size_classification", "business_registration_number", "business_address", "headquarters_address",
    "business_type", "business_item", "preference_tags_json", "direct_production_items_json", "license_summary",
    "procurement_registration_status", "evidence_verification_status",
]
LIST_PROFILE_FIELDS = ["certifications_json", "preference_tags_json", "direct_production_items_json"]
PRIORITY_GROUPS = [
    ("면허/등록/허가", "license", ["면허", "등록", "허가", "업종"]),
    ("인증/기업유형", "company_type", ["중소", "소상공", "여성기업", "장애인", "벤처", "인증"]),
    ("제출서류", "required_document", ["서류", "증명서", "확인서", "제출"]),
    ("직접생산/제품·기술", None, ["직접생산", "제품", "기술", "특허"]),
    ("지역 조건", "region", []),
]
PRIORITY_GROUP_OTHER = "기타 확인 항목"
RISK_REVIEW = "사람 확인 필요 항목은 자동 비교만으로 결론을 내리지 말고 원문과 증빙을 다시 확인하세요."
RISK_COVERAGE = "기준문서 근거가 부족한 항목은 검토 완료 전 근거 원문 확인이 필요합니다."
HEADLINES = {"missing": "준비 필요", "review": "사람 확인 필요", "ready": "대체로 준비됨", "other": "검토 필요"}
ACTION_REVIEW_WORDS = ["자동", "수동", "검토", "판단", "사람", "금액", "일정"]
ACTION_MISSING_WORDS = ["준비", "부족", "필요", "증빙", "서류"]
