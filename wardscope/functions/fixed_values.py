"""Fixed values that results must agree on: labels, thresholds, word lists."""

# --- fixed values: composite risk ---------------------------------------
RISK_WEIGHTS = {"s_load": 0.35, "s_access": 0.30, "s_pop": 0.20, "s_staff": 0.15}
RISK_UPPER_EDGES = [20.0, 35.0, 50.0, 65.0]
RISK_GRADES = [1, 2, 3, 4, 5]
RISK_GRADE_NAMES = ["매우낮음", "낮음", "보통", "높음", "매우높음"]
STATE_COMPLETE = "완료"
STATE_INCOMPLETE = "원천데이터부족"
COMPONENT_NAMES = {
    "s_load": "병상포화도점수",
    "s_access": "접근성점수",
    "s_pop": "인구대비병상점수",
    "s_staff": "의료진부족점수",
}
COMPONENT_SHORT = {
    "s_load": "병상포화도",
    "s_access": "접근성",
    "s_pop": "인구대비병상",
    "s_staff": "의료진부족",
}

# --- fixed values: bed status and freshness ------------------------------
STATUS_UPPER_EDGES = [50.0, 80.0]
STATUS_NAMES = ["여유", "주의", "포화"]
STATUS_MISSING = "결측"
COVERAGE_NONE = "결측"
COVERAGE_FULL = "전체응답"
COVERAGE_PART = "부분응답"
SOURCE_ZONE = "Asia/Seoul"
SOURCE_MAX_AGE_HOURS = 12.0
FUTURE_SKEW_MINUTES = 5.0
MIN_LIVE_MATCHES = 373
LIVE_DROP_RATIO = 0.9
DATA_STALE_AFTER_MINUTES = 600
DAY_NAMES = ["월", "화", "수", "목", "금", "토", "일"]

# --- fixed values: facility grades by feed code ---------------------------
GRADE_BY_CODE = {
    "G001": "권역응급의료센터",
    "G006": "지역응급의료센터",
    "G007": "지역응급의료기관",
    "G008": "기타",
    "G009": "응급실운영신고기관",
}
ROUTE_TARGET_PATTERN = "권역|지역응급의료센터"
SINGLE_TIER_PROVINCE = "세종특별자치시"
SINGLE_TIER_DISTRICT = "세종시"
SINGLE_TIER_CODE = "36110"
COUNTRY_BOX = {"lat": (33.0, 39.0), "lon": (124.0, 132.0)}

# --- fixed values: routes ---------------------------------------------------
ROUTE_SCHEMA_VERSION = "kakao-directions-v1-distance"
ROUTE_OK = "성공"
ROUTE_OK_ZERO = "성공:출도착5m이내"
ROUTE_NONE = "경로없음"
ROUTE_ERROR_PREFIX = "경로오류:"
ROUTE_BAD_FORMAT = "응답형식오류"
ROUTE_BAD_VALUE = "응답값오류"
ROUTE_CONFIRMED_NONE_CODES = [1, 101, 102, 103, 105, 106, 107]
ROUTE_INITIAL_CANDIDATES = 10
ROUTE_TTL_DAYS = 30
BASIS_ROAD = "카카오 도로거리"
BASIS_STRAIGHT = "직선거리 대체"
BASIS_NONE = "미산출"

# --- fixed values: identity matching ---------------------------------------
MATCH_THRESHOLD = 0.84
MATCH_MARGIN = 0.05
MATCH_TOP_CANDIDATES = 20
MATCH_REVIEW_CANDIDATES = 5
NAME_SIMILARITY_FLOOR = 0.72
STATE_AUTOMATIC = "자동매칭"
STATE_MANUAL = "수동검증"
STATE_NONE = "미매칭"
STATE_LOW = "낮은유사도"
STATE_AMBIGUOUS = "후보모호"
STATE_CONFLICT = "식별자충돌검토필요"
STATE_DUPLICATE = "중복식별자검토필요"
STATE_EXCLUDED = "HIRA원천불일치"
STATE_WRONG_REGION = "지역불일치"
MATCHED_STATES = [STATE_AUTOMATIC, STATE_MANUAL]
GATE_FACILITY = "시설종별불일치"
GATE_REGION = "지역불일치"
GATE_SCORE = "점수미달"
GATE_NAME = "이름근거부족"
GATE_CROSS = "교차근거부족"
GATE_PASSED = "자동확정기준통과"
LEGAL_WORDS = (
    "의료법인|재단법인|학교법인|사회복지법인|사단법인|"
    "의료재단|교육재단|사회복지재단|학원|병원|의원|대학교"
)
PARENTHESES = r"\([^)]*\)|（[^）]*）"
NOT_IDENTITY_CHARACTER = "[^0-9A-Za-z가-힣]"
OLD_PROVINCES = [
    ("강원도", "강원특별자치도"),
    ("전라북도", "전북특별자치도"),
    ("전라남도", "전남광주통합특별시"),
    ("광주광역시", "전남광주통합특별시"),
]
ROAD_NUMBER = r"(.+?(?:대로|로|길))\s*(\d+(?:-\d+)?)"
FACILITY_KEYWORDS = [
    ("치과병원", "치과병원"),
    ("한방병원", "한방병원"),
    ("요양병원", "요양병원"),
    ("치과의원", "치과의원"),
    ("한의원", "한의원"),
    ("보건소", "보건기관"),
    ("보건지소", "보건기관"),
    ("의원", "의원"),
]
FACILITY_DEFAULT = "병원"
PROVINCE_ALIASES = {
    "강원특별자치도": ["강원특별자치도", "강원도"],
    "전북특별자치도": ["전북특별자치도", "전라북도"],
    "전남광주통합특별시": ["전남광주통합특별시", "광주광역시", "전라남도"],
}
DISTRICT_ALIASES = {
    "서해구": ["서구"],
    "영종구": ["중구"],
    "세종시": ["세종특별자치시"],
}
STAFF_SUBJECT_CODE = "24"
EXCLUSION_REASONS = ["HIRA_SOURCE_NOT_FOUND"]
EVIDENCE_DOMAIN = "hira.or.kr"
CATALOG_ID_PATTERN = r"^[A-Za-z0-9_-]{80}$"
EXCLUSION_MAX_AGE_DAYS = 30
QUALITY_RATE = 0.8
QUALITY_OK = "사용가능"
QUALITY_REVIEW = "검토필요"

# --- fixed values: province short labels -----------------------------------
PROVINCE_SHORT = {
    "서울특별시": "서울",
    "부산광역시": "부산",
    "대구광역시": "대구",
    "인천광역시": "인천",
    "대전광역시": "대전",
    "울산광역시": "울산",
    "세종특별자치시": "세종",
    "경기도": "경기",
    "강원특별자치도": "강원",
    "충청북도": "충북",
    "충청남도": "충남",
    "전북특별자치도": "전북",
    "경상북도": "경북",
    "경상남도": "경남",
    "제주특별자치도": "제주",
    "전남광주통합특별시": "전남·광주",
}

# --- fixed values: correlation strength and cluster labels -----------------
CORRELATION_LEVELS = [
    (0.0, "매우 약함"),
    (0.2, "약함"),
    (0.4, "보통"),
    (0.6, "강함"),
    (0.8, "매우 강함"),
]
CLUSTER_VULNERABLE = "접근성·의료진 복합취약형"
CLUSTER_MODERATE = "접근성 양호·병상부담형"

# --- fixed values: missing-value reasons -----------------------------------
REASON_LABELS = {
    "BED_API_NO_RESPONSE": "NEMC 병상 API 응답 없음",
    "BED_SOURCE_STALE": "병원 API기준시각이 수집시각보다 12시간 초과",
    "BED_TOTAL_MISSING": "전체병상 누락 또는 0 이하",
    "BED_AVAILABLE_MISSING": "가용병상 누락",
    "BED_AVAILABLE_NEGATIVE": "가용병상 음수 이상값",
    "BED_SATURATION_MISSING": "병상 원천값은 있으나 포화율 미산출",
    "HIRA_MATCH_DEFERRED": "HIRA 후보를 1:1로 확정할 근거 부족",
    "REGION_COMPONENT_MISSING": "최종 위험도 구성점수 결측",
}
NEXT_ACTIONS = {
    "BED_API_NO_RESPONSE": "NEMC 운영 쿼터·응답 상태 확인 후 beds 재수집",
    "BED_SOURCE_STALE": "NEMC 원천 API기준시각 갱신 여부 확인 후 beds 재수집",
    "BED_TOTAL_MISSING": "NEMC 전체병상 원천값 재조회 및 기관 확인",
    "BED_AVAILABLE_MISSING": "NEMC 가용병상 원천값 재조회 및 기관 확인",
    "BED_AVAILABLE_NEGATIVE": "NEMC 음수 가용병상 재조회 및 이상값 확인",
    "BED_SATURATION_MISSING": "병상 계산식과 원천 필드를 재검증",
    "HIRA_MATCH_DEFERRED": "HIRA 공식 상세에서 이름·주소·전화·요양기호 수동검증",
    "REGION_COMPONENT_MISSING": "소속 병원 결측 해소 후 beds → full 순서로 재실행",
}
MISSING_FIELDS = {
    "BED_API_NO_RESPONSE": "가용병상|전체병상|포화율",
    "BED_SOURCE_STALE": "가용병상|전체병상|포화율",
    "BED_TOTAL_MISSING": "전체병상|포화율",
    "BED_AVAILABLE_MISSING": "가용병상|포화율",
    "BED_AVAILABLE_NEGATIVE": "가용병상|포화율",
    "BED_SATURATION_MISSING": "포화율",
}
MATCH_MISSING_FIELDS = "HIRA식별자|응급의학과전문의수"

# --- fixed values: carry-forward limits ------------------------------------
MAX_CARRIED = 3
MAX_CONSECUTIVE_MISSES = 3
MAX_MISSING_AGE_HOURS = 72.0

# --- fixed values: population sources ---------------------------------------
REGISTRY_COLUMN_SUFFIX = "_계_총인구수"
REGISTRY_SOURCE = "행정안전부 주민등록 인구통계"
FALLBACK_SOURCE = "KOSIS 주민등록 인구"
MERGED_PROVINCE = "전남광주통합특별시"
MERGED_CITY = "광주광역시"
MERGED_RURAL = "전라남도"
MERGED_CITY_DISTRICTS = ["동구", "서구", "남구", "북구", "광산구"]

# region sentence: fixed wording between district, risk, grade, first factor, its score, second factor, its score
SENTENCE_TEXTS = ["의 종합 위험도는 ", "점 (", ")입니다. 네 요인 중 ", "(", "점)과 ", "(", "점)이 가장 큰 영향을 주고 있어"]
SENTENCE_LABEL = [", ", " 지역으로 분석됩니다."]
SENTENCE_END = "입니다."

# road probes: fixed compass moves (east, north) in steps of one kilometre, and parts of the way to the nearest facility
PROBE_MOVES = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
PROBE_PARTS = [0.25, 0.5, 0.75]
KM_PER_LATITUDE = 111.32
LEAST_LONGITUDE_COSINE = 0.2

# pair score: fixed weights of the evidence, and distance steps (up to km, points)
PAIR_WEIGHTS = {
    "name_similarity": 0.40, "name_exact": 0.17, "name_contains": 0.12, "address_similarity": 0.14, "road_matches": 0.16,
    "address_exact": 0.12, "phone_matches": 0.10, "district_matches": 0.05, "province_matches": 0.02,
}
PAIR_DISTANCES = [(0.25, 0.18), (0.75, 0.15), (2.0, 0.10), (5.0, 0.05)]
OTHER_KIND_FACTOR = 0.20
FOREIGN_FACTOR = 0.45

# boundary collection: fixed properties of the published file, and texts its notes must hold
BOUNDARY_SOURCE = {"level": "sgg", "crs": "EPSG:4326", "resolution": "light"}
BOUNDARY_SOURCE_TEXTS = {"license": "CC-BY-4.0", "attribution": "SGIS"}
WEAK_ORIGIN_METHOD = "병원좌표평균"
