"""Fixed values. Labels, word lists and value shapes that decide the results.

Patterns are Java regular expressions. ``(?U)`` makes ``\\d \\s \\b`` Unicode;
word characters are spelled ``[\\p{L}\\p{N}_]``.
"""

# --- fixed values: types, in detection order -------------------------------
TYPES = [
    "name", "phone", "email", "address", "dob", "resident_id", "foreign_id",
    "passport", "driver_license", "account", "card", "management_id",
]
DOCUMENT_CLASSES = [
    "report_minutes", "contract_agreement", "transaction_settlement",
    "personnel_roster", "case_record", "other",
]
METHODS = ["full", "partial", "delete", "keep"]
AUTOMATIC_SOURCES = ["ai_automatic", "local_automatic"]

# --- fixed values: field labels (spaces removed, lower case) ----------------
LABELS = {
    "name": ["이름", "성명", "성명(한글)", "성명(영문)", "예금주", "신청인", "신청자", "작성자",
             "담당자", "대표자", "수령인", "참가자", "내담자", "상담자"],
    "address": ["주소", "자택주소", "거주지주소", "현주소", "주민등록주소", "배송주소",
                "갑의주소", "을의주소", "병의주소", "정의주소"],
    "dob": ["생년월일", "출생일", "생일", "생년"],
    "passport": ["여권번호", "passportno", "passportnumber"],
    "driver_license": ["운전면허번호", "운전면허증번호"],
    "account": ["계좌번호", "정산계좌번호", "환급계좌번호", "입금계좌번호", "급여계좌번호"],
    "card": ["카드번호", "사용카드번호", "결제카드번호", "신용카드번호", "법인카드번호", "체크카드번호"],
    "management_id": ["사번", "학번", "직원번호", "회원번호", "고객번호", "환자번호", "수험번호",
                      "개인관리번호", "사원번호"],
}
HEADER_ONLY = ["연락처", "전화번호", "휴대전화", "휴대폰번호", "이메일", "전자우편",
               "주민등록번호", "외국인등록번호", "항목", "비고"]
PARTY_ADDRESS = ["갑의주소", "을의주소", "병의주소", "정의주소"]
COLUMN_KINDS = {
    "phone": ["연락처", "전화번호", "휴대전화"],
    "email": ["이메일", "전자우편"],
    "number": ["no", "번호", "순번"],
}
EMPTY_MARKERS = ["해당없음", "없음", "미발급", "미기재", "비공개", "작성중", "검토메모", "확인필요",
                 "담당자", "성명", "이름"]
LABEL_EDGE = ":：.·*[]"

# --- fixed values: format patterns -----------------------------------------
RESIDENT_ID = r"(?U)(?<!\d)\d{6}[- ]?[1-4]\d{6}(?!\d)"
FOREIGN_ID = r"(?U)(?<!\d)\d{6}[- ]?[5-8]\d{6}(?!\d)"
PHONE = r"(?U)(?<![\d\-.])(?:01[016789]|0\d{1,2})[- ]?\d{3,4}[- ]?\d{4}(?!\d)"
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[a-zA-Z]{2,}"
FORMATS = [("resident_id", RESIDENT_ID), ("foreign_id", FOREIGN_ID), ("phone", PHONE), ("email", EMAIL)]

# --- fixed values: value shapes --------------------------------------------
NAME_SHAPE = r"[가-힣A-Za-z][가-힣A-Za-z'-]{1,29}(?:[ \t][가-힣A-Za-z][가-힣A-Za-z'-]{0,29}){0,3}"
REGION_STEMS = ["서울", "부산", "대구", "인천", "광주", "대전", "울산", "세종", "경기", "강원", "충청",
                "충북", "충남", "전라", "전북", "전남", "경상", "경북", "경남", "제주"]
STREET_WORDS = ["street", "road", "avenue", "boulevard", "lane"]
DATE_SPLIT = r"(?U)(\d{4})[-./년]\s*(\d{1,2})[-./월]\s*(\d{1,2})\s*일?\.?"
DATE_JOINED = r"(?U)(\d{4})(\d{2})(\d{2})\.?"
PASSPORT_SHAPE = r"(?=.*[0-9])[A-Z0-9]{6,12}"
LICENSE_SHAPE = r"(?:(?:[0-9]{2}|[가-힣]{2,4})[- ][0-9]{2}[- ][0-9]{6}[- ][0-9]{2}|[0-9]{12})"
DIGIT_GROUPS = r"[0-9]+(?:[ \t-][0-9]+)*"
MANAGEMENT_SHAPE = r"(?=.*[0-9])[A-Za-z0-9][A-Za-z0-9_-]{2,63}"
PHONE_CELL = r"(?U)0\d{1,2}[- ]?\d{3,4}[- ]?\d{4}"
NUMBER_CELL = r"(?U)\d{1,6}"
ADDRESS_DETAIL = r"(?U)\d+\s*(?:동|호|층|번지)(?:\b|\s|$)"

# --- fixed values: person names --------------------------------------------
SURNAMES_LONG = ["남궁", "황보", "제갈", "선우", "독고", "서문", "사공", "동방"]
SURNAMES = ("김이박최정강조윤장임한오서신권황안송전홍유류고문양손배백허남심노하곽성차주우구민진나지엄채원천방공현함변염여추"
            "도소석선설마길연위표명기반왕금옥육인맹제모탁국어은편용")
NOT_A_PERSON = ["전화", "문의", "작성", "검토", "확인", "정보", "모집", "명단", "미정", "없음", "이름",
                "성명", "일정", "상담", "지원", "담당", "연락처"]
ORGANISATION_ENDINGS = ["회사", "은행", "병원", "센터", "부서", "명단"]
PERSON = "(?:" + "|".join(SURNAMES_LONG) + "|[" + SURNAMES + "])[가-힣]{1,3}"
NAME_FOLLOW = (r"(?U)^(?:님|씨)?(?:께서|에게는|에게|한테|으로|과|와|은|는|이|가|을|를|의|도)?"
               r"(?=$|[\s.,，。:;!?()\[\]·/])")

# --- fixed values: role wording, (label part)(value)(what must follow) ------
_EDGE = r"(?<![가-힣A-Za-z0-9_])"
ROLE_NAMES = [
    (rf"(?U)({_EDGE}(?:성명|이름|내담자|상담자|예금주)\s*[:：]?\s+)({PERSON})(?=\s*(?:$|[,，)·;|]|부서\b|연락처\b))", False),
    (rf"(?U)(\(대표\s+)({PERSON})(?=\s*\))", False),
    (rf"(?U)((?<![가-힣])(?:갑|을|병|정)\s*[:：]\s*)({PERSON})(?=\s*(?:$|\((?:생년월일|인|서명)))", False),
    (rf"(?U)((?<![가-힣])(?:문의\s*[:：]\s*(?:급여담당\s+)?|급여담당\s+))({PERSON})(?=\s*(?:\(?0\d|내선\s+0\d))", True),
    (rf"(?U)(가족\((?:모|부|배우자|자녀|형제|자매)\)\s+)({PERSON})(?=(?:에게도|에게|은|는)?[\s,])", True),
]
# Words without which the rule above or below them cannot match.
ROLE_WORDS = [["성명", "이름", "내담자", "상담자", "예금주"], ["(대표"], ["갑", "을", "병", "정"], ["문의", "급여담당"], ["가족("]]
RESIDENCE_WORDS = ["거주지", "자택주소", "현주소"]
RECEIPT_WORDS = ["접수번호"]
LABELLED_WORDS = {"account": ["계좌"], "card": ["카드"], "passport": ["여권"], "driver_license": ["면허"],
                  "management_id": ["사번", "학번", "번호"], "dob": ["생년월일", "출생일"]}
RESIDENCE = r"(?U)((?<![가-힣])(?:거주지|자택주소|현주소)\s*[:：]?\s+)([^;|\n]+)"
CARE_RECORD = r"(?U)(?:상담|진료|환자|내담자)\s*(?:일지|기록|접수)"
RECEIPT = r"(?U)(접수번호\s*[:：]?\s+)([A-Za-z0-9][A-Za-z0-9_-]{2,63})(?![A-Za-z0-9_-])"
LABELLED = [
    ("account", rf"(?U)({_EDGE}(?:입금\s*계좌|계좌번호|계좌)(?:\s*[:：(]\s*|\s+)(?:[가-힣]{{2,12}}\s+)?)([0-9]+(?:[- ][0-9]+){{1,4}})(?![0-9-])"),
    ("card", rf"(?U)({_EDGE}(?:법인카드\s*정산|신용카드번호|카드번호)(?:\s*[:：]\s*|\s+))([0-9]{{4}}(?:[- ][0-9]{{4}}){{3}})(?![0-9-])"),
    ("passport", rf"(?U)({_EDGE}(?:여권번호|여권)\s*[:：]?\s+)([A-Z0-9]{{6,12}})(?![A-Za-z0-9_-])"),
    ("driver_license", rf"(?U)({_EDGE}(?:운전면허번호|운전면허|면허)\s*[:：]?\s+)((?:[0-9]{{2}}|[가-힣]{{2,4}})[- ][0-9]{{2}}[- ][0-9]{{6}}[- ][0-9]{{2}}|[0-9]{{12}})(?![A-Za-z0-9_-])"),
    ("management_id", rf"(?U)({_EDGE}(?:사번|학번|직원번호|회원번호|고객번호|환자번호|수험번호|개인관리번호|사원번호)\s*[:：]?\s+)([A-Za-z0-9][A-Za-z0-9_-]{{2,63}})(?![A-Za-z0-9_-])"),
    ("dob", rf"(?U)({_EDGE}(?:생년월일|출생일)\s*[:：]?\s+)(\d{{4}}[-./]\d{{1,2}}[-./]\d{{1,2}})(?![0-9])"),
]

# --- fixed values: document classes by title wording, in order --------------
TITLE_CLASSES = [
    ("transaction_settlement", r"정산|지출결의|급여명세|영수증|출장비"),
    ("contract_agreement", r"계약서|협약서|동의서"),
    ("personnel_roster", r"(?U)참가자\s*명단|참여자\s*명부|인사기록|이력서|등록신청"),
    ("case_record", r"상담일지|민원기록|인터뷰"),
    ("report_minutes", r"보고서|회의록|기획서"),
]

# --- fixed values: location evidence ----------------------------------------
EXCERPT = 300
EVIDENCE_LIMIT = 8
REGION_NAMES = {"body": "본문", "header": "머리말", "footer": "꼬리말"}
NUMBERED_LINE = r"(?U)^\s*(?:\d{1,2}[.)]?|[가-하][.)])\s+\S"
FIELD_RELATIONS = ["same_cell", "table_row_first_cell", "table_first_row", "same_row_left", "preceding_paragraph"]
DIRECT_RELATIONS = ["self", "same_cell", "table_row_first_cell", "table_first_row", "same_row_left"]

# --- fixed values: records from outside extraction --------------------------
ABSENCE_WORDS = ["해당없음", "없음", "미제출", "미기재", "미발급", "n/a", "-"]
NUMBER_TYPES = ["resident_id", "foreign_id", "passport", "driver_license", "phone", "account", "card",
                "dob", "management_id"]
WRAPPED_EMAIL = r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
SPAN_LIMIT = 1000

# --- fixed values: masking presets ------------------------------------------
PRESET_REGIONS = ("서울 서울시 서울특별시 부산 부산시 부산광역시 대구 대구시 대구광역시 인천 인천시 인천광역시 광주 광주광역시 "
                  "대전 대전시 대전광역시 울산 울산시 울산광역시 세종 세종시 세종특별자치시 경기 경기도 강원 강원도 강원특별자치도 "
                  "충북 충청북도 충남 충청남도 전북 전라북도 전북특별자치도 전남 전라남도 경북 경상북도 경남 경상남도 제주 제주도 "
                  "제주특별자치도").split()
NEVER_AUTOMATIC = ["resident_id", "foreign_id", "passport", "driver_license"]
UNSAFE_VALUE = r"[\p{M}\p{Cs}\x{200D}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}\x{1F1E6}-\x{1F1FF}]"
UNSAFE_EMAIL = (r"[\p{C}\x{1100}-\x{11FF}\x{A960}-\x{A97F}\x{D7B0}-\x{D7FF}\x{1F3FB}-\x{1F3FF}\x{0D4E}\x{1193F}"
                r"\x{11941}\x{11A3A}\x{11D46}\x{11F02}\x{111C2}-\x{111C3}\x{11A84}-\x{11A89}]")

# --- fixed values: keep policy -----------------------------------------------
PUBLIC_CONTACT = r"(?U)(?:대표\s*(?:전화|번호|연락처|메일|이메일|문의)|공용|공식\s*(?:전화|메일|이메일)|문의\s*창구)"
PRIVATE_CONTACT = r"(?iu)개인|휴대|자택|비상|신청인|직원|사적|private|personal"
CONTACT_SHAPE = r"(?U)[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|0\d{1,2}[- ]\d{3,4}[- ]\d{4}"
OPAQUE_GLYPHS = "*█■ \t\n"

# --- fixed values: limits ------------------------------------------------------
MAX_BYTES = 10 * 1024 * 1024
MAX_PAGES = 100
TTL_SECONDS = 3600
BATCH_SIZE = 20
