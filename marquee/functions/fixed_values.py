"""Patterns, word lists and tables that decide results and must not drift.

Patterns are Java regular expressions. Word boundaries are spelled out with look-arounds and
the end of text as ``\\z`` so that multi-line texts and Hangul behave the same everywhere.
"""

# --- character classes -------------------------------------------------------------------
HANGUL = "가-\ud7af\u1100-\u11ff\u3130-\u318f"
HANGUL_SYLLABLE = "가-힣"
SPACE = "\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
NOT_WORD_BEFORE = r"(?<![\p{L}\p{N}_])"
NOT_WORD_AFTER = r"(?![\p{L}\p{N}_])"

# --- data-quality patterns ---------------------------------------------------------------
PRICE = r"(?:\d{1,3}(?:,\d{3})*원|₩\s*\d[\d,]*|\d+만\s*원)"
TICKET_GRADE = f"(?i){NOT_WORD_BEFORE}(?:[RSABVIP]석|VIP|스탠딩|STANDING|FLOOR){NOT_WORD_AFTER}"
DATE = r"\d{4}[.\-/]\d{1,2}[.\-/]\d{1,2}|\d{4}년\s*\d{1,2}월"
URL = r"(?i)https?://|www\."
HTTP_URL = r"(?i)^https?://"
ADDRESS_WORDS = r"시|구|동|로|길|번지|특별시|광역시|도\s|읍|면"
VENUE_LIKE = r"(?i)(?:홀|관|돔|구장|경기장|아레나|센터|HALL|DOME|ARENA)\z"

# --- titles ------------------------------------------------------------------------------
TICKET_MARKER = r"(?i)스탠딩|지정석|얼리버드|예매|선예매|티켓|블라인드|vip|premium|pass|[rsa]석"
FESTIVAL = r"(?i)페스티벌|페스타|페스트|festival|fes(?![a-z0-9_])|fest(?![a-z0-9_])"
LISTING = r"(?i)라인업|얼리버드|티켓|발표|개최|크루|예매|오픈|lineup|[0-9]\s*차|최종"
LEADING_CITY = r"^\s*[\[(［（]([^\])］）]{1,10})[\])］）]\s*"
TRAILING_CITY = "[ \\t]*[-－‐‑–—―_⎽~∼][ \\t]*[가-힣A-Za-z]{1,6}[ \\t]*\\z"
TITLE_STAGE_SUFFIX = (
    r"\s+[\-:·–—]\s*[^\-:·–—]*(?:\d+\s*차|라인업|티켓\s*오픈|티켓\s*정보|선\s*예매"
    r"|예매\s*(?:방법|안내|오픈)|취소|연기|개최\s*무산|공연\s*취소)[^\-:·–—]*\z"
)
TITLE_KIND_SUFFIX = r"(?i)[\s\-_·]*(?:공연|콘서트|페스티벌|festival|concert|show|tour|live)\z"
MULTI_ARTIST_TITLE = (
    r"(?i)페스티벌|페스타|페스트|festival|fest['’\s]|워터밤|펜타포트|락\s?페|록\s?페스|라인업"
    r"|line[\s-]?up|헤드라이너|얼리버드|블라인드|pre[\s-]?sale|premium\s?pass|컨퍼런스|conference"
    r"|박람회|expo|엑스포"
)
PLAIN_FESTIVAL = r"(?i)페스티벌|festival"
PUNCTUATION = r"[!-/:-@\[-`{-~·…“”‘’–—「」『』【】、，。]"
LINEUP_STOP_WORDS = r"(?i)아티스트|라인업|line[\s-]?up|없음|미정|tba"

# --- people names ------------------------------------------------------------------------
PAREN_NAME = r"^(.+?)\s*[(（]\s*([^)）]+?)\s*[)）]?\s*\z"
ANNOTATION = r"[(\[][^)\]]*[)\]]?"
JOINED_NAMES = r"(?i)\s[x×]\s|\s&\s|,\s|\sfeat\.?\s|\swith\s|\svs\.?\s"
JOINED_NAMES_SPLIT = r"(?i)\s+(?:[x×]|&|feat\.?|with|vs\.?)\s+|\s*[,、]\s*"
DATED_BRACKET = r"\s*\([^)]*\d{4}[^)]*\)"
SLASH_AGENCY = r"\s*/\s*.+\z"
AGENCY_SUFFIX = (
    r"(?i)\s*[-–]\s*(?:SM|YG|JYP|HYBE|빅히트|카카오|카카오엔터|큐브|스타쉽|울림|젤리피쉬|FNC|플레디스|WM|DSP|IST).*"
)
JOB_WORDS = (
    r"가수|배우|성우|모델|방송인|예능|프로듀서|드러머|기타리스트|베이시스트|작곡가|작사가?|아나운서|유튜버|만화가|군인"
    r"|개그맨|진행자|싱어송라이터|음악가|뮤지션|디스크\s?자키|(?<![A-Za-z0-9_])DJ(?![A-Za-z0-9_])|Singer|[Aa]ctor"
    r"|[Aa]ctress|rapper|producer|musician|Voice|comedian"
)
MARKUP_RESIDUE = r"\.mw-|parser-output|[{}]"

# --- venues ------------------------------------------------------------------------------
VENUE_INFO_SUFFIX = (
    r"\s+(?:티켓\s*가격|가격\s*[-:·]|가격\s*\(|티켓\s*오픈|오픈\s*[-:·]|예매\s*[-:·]|작성\s|티켓\s*예매|[-·]\s*티켓)"
)
TICKET_OPENING = r"티켓\s*(?:오픈|예매)|예매\s*오픈|오픈\s*예정"
LEGACY_PRICE = r"\d{1,3}(?:,\d{3})*\s*원|₩\s*\d[\d,]*|\d+\s*만\s*원"
TRASH_VENUE_MARK = "예매하기"
CLEANUP_PRICE = r"\d{1,3}(?:,\d{3})*원|₩\s*\d"
CLEANUP_TICKET = r"(?i)[RSABVIP]석|VIP|스탠딩"
HALL_SUFFIX = r"(?i)대극장|소극장|중극장|블랙박스|제\d+전시장|제\d+관|\d+홀|\d+번홀|야외광장|후면광장|올림픽홀"
HALL_RULES = [
    (r"(?i)킨텍스", "킨텍스"),
    (r"(?i)벡스코|bexco", "BEXCO"),
    (r"(?i)올림픽공원", "올림픽공원"),
    (r"(?i)올림픽홀", "올림픽공원"),
    (r"(?i)올림픽체조경기장|kspo\s*dome", "KSPO DOME"),
    (r"(?i)잠실종합운동장|잠실주경기장", "잠실종합운동장"),
    (r"(?i)세종문화회관", "세종문화회관"),
    (r"(?i)예술의전당", "예술의전당"),
    (r"(?i)고양아람누리|아람누리", "고양아람누리"),
    (r"(?i)성남아트리움", "성남아트리움"),
    (r"(?i)경기아트센터", "경기아트센터"),
    (r"(?i)lg아트센터", "LG아트센터 서울"),
    (r"(?i)yes24.*live|예스24.*라이브", "YES24 LIVE HALL"),
    (r"(?i)충무아트센터", "충무아트센터"),
    (r"(?i)dcc|대전컨벤션", "DCC 대전컨벤션센터"),
]
VENUE_ALIASES = {
    "서울올림픽주경기장": "올림픽공원 주경기장",
    "잠실올림픽주경기장": "올림픽공원 주경기장",
    "잠실주경기장": "올림픽공원 주경기장",
    "올림픽주경기장": "올림픽공원 주경기장",
    "올림픽공원주경기장": "올림픽공원 주경기장",
    "올림픽공원88잔디마당": "올림픽공원 88잔디마당",
    "88잔디마당": "올림픽공원 88잔디마당",
    "kspo돔": "KSPO DOME",
    "올림픽체조경기장": "KSPO DOME",
    "체조경기장": "KSPO DOME",
    "고척스카이돔": "고척 스카이돔",
    "고척돔": "고척 스카이돔",
    "잠실실내체육관": "잠실실내체육관",
    "잠실체육관": "잠실실내체육관",
    "코엑스아티움": "코엑스 아티움",
    "코엑스홀": "코엑스 홀",
    "인스파이어아레나": "인스파이어 아레나",
    "잠실야구장": "잠실 야구장",
    "수원월드컵경기장": "수원 월드컵 경기장",
}
GARBAGE_VENUE_WORDS = ["예매하기", "단독공연", "콘서트", "페스티벌", "공연"]
HALL_WORDS = ["대극장", "소극장", "중극장", "전시장", " 홀", "번홀", "번관"]
REGION_PREFIXES = ["서울", "부산", "경기", "강원", "인천", "경남", "경북"]

# --- what is not a concert ---------------------------------------------------------------
EXHIBITION_WORDS = [
    "전시", "전시회", "전람회", "전람", "전시관", "갤러리", "exhibition", "expo", "gallery",
    "개인전", "기획전", "특별전", "상설전", "기념전", "회고전", "미술관", "박물관", "museum", "뮤지엄",
    "보테로", "botero", "롯데뮤지엄", "사진전", "작품전", "예술관", "뮤지컬", "musical", "연극", "오페라", "발레",
    "킨더콘체르트", "관현악", "심포니", "필하모닉", "세미나", "강연", "특강", "포럼",
]
INTAKE_EXCLUDED_WORDS = [
    "뮤지컬", "musical", "연극", "오페라", "발레", "전시회", "전람회", "전시관", "exhibition", "expo",
    "개인전", "기획전", "특별전", "상설전", "기념전", "회고전", "갤러리", "gallery", "미술관", "박물관",
    "킨더콘체르트", "관현악", "심포니", "필하모닉", "세미나", "강연", "특강", "포럼",
]
CLEANUP_WORDS = [
    "전시", "전시회", "전람회", "전람", "전시관", "갤러리", "gallery", "exhibition", "expo",
    "개인전", "기획전", "특별전", "상설전", "기념전", "회고전", "워홀", "warhol", "모네", "monet",
    "피카소", "picasso", "반고흐", "van gogh", "다빈치", "da vinci", "미술관", "박물관", "museum", "뮤지엄",
    "르누아르", "마티스", "드가", "세잔", "보테로", "botero", "롯데뮤지엄", "뮤지컬", "musical", "연극", "오페라",
    "발레", "킨더콘체르트", "관현악", "심포니", "필하모닉", "세미나", "강연", "특강", "포럼", "토크쇼", "마술사의 방",
]
CONCERT_WORDS = [
    "콘서트", "단독콘서트", "concert", "페스티벌", "festival", "내한", "시즌권", "정기공연",
    "투어", "tour", "라이브", "live",
]
MAX_RUN_DAYS = 90
NON_MUSIC_GENRES = ["뮤지컬", "연극", "전시", "미술", "무용", "클래식", "오페라", "발레", "국악"]
BLOCKED_CATEGORY_CODES = ["Musi", "Play", "Exhi", "Clas", "Oper", "Danc", "Ball", "Trad"]
BLOCKED_CATEGORY_NAMES = [
    "뮤지컬", "연극", "전시", "클래식", "오페라", "무용", "발레", "국악",
    "MUSICAL", "PLAY", "EXHIBITION", "CLASSIC", "OPERA", "DANCE", "BALLET",
]

# --- timetable text ----------------------------------------------------------------------
TIME_RANGE = r"(?i)(\d{1,2}[:.]\d{2})\s*(?:~|-|–|—|부터|to)\s*(\d{1,2}[:.]\d{2})"
SINGLE_DATE = r"(?:^|\s)(?:(\d{4})\s*(?:[./-]|년)\s*)?(\d{1,2})\s*(?:[./-]|월)\s*(\d{1,2})(?:일)?(?=\s|\z)"
DAY_MARKER = r"(?i)(?:day|데이)\s*(\d{1,2})"
STAGE_MARKER = r"(?i)(?:@|스테이지|stage|무대|장소)\s*[:\-]?\s*([A-Za-z0-9가-힣\s._-]+)\z"
STAGE_LINE = (
    r"(?i)^(?:@|스테이지|stage|무대|장소)?\s*[:\-]?\s*([A-Za-z0-9가-힣\s._-]+)\s*(?:stage|스테이지|무대)?\z"
)
STAGE_WORD = r"(?i)stage|스테이지|무대|main|sub|green|blue|red|club|zone"
LINEUP_LABEL = r"(?i)(?:line\s*up|라인업|artist|아티스트)\s*[:\-]?"
TIMETABLE_WORD = r"(?i)타임\s*테이블|타임테이블|time\s*table|timetable|schedule|스케줄|라인업|line\s*up|lineup"
CONTEXT_LINE = (
    r"(?i)day|데이|stage|스테이지|무대|zone|존|main|sub|green|blue|red|\d{1,2}\s*[./월]\s*\d{1,2}"
)
DEFAULT_STAGE = "MAIN STAGE"

# --- booking sites -----------------------------------------------------------------------
BOOKING_PROVIDERS = [
    (r"(?i)tickets?\.interpark\.com/goods", "interpark", "인터파크"),
    (r"(?i)ticket\.yes24\.com", "yes24", "YES24"),
    (r"(?i)ticket\.melon\.com", "melon", "멜론티켓"),
    (r"(?i)nol\.yanolja\.com/ticket/products", "yanolja", "놀(야놀자)"),
    (r"(?i)klook\.com", "klook", "클룩"),
]
PROVIDER_HOSTS = [
    (r"(?i)(?:^|\.)ticket\.melon\.com\z", "melon"),
    (r"(?i)(?:^|\.)ticket\.interpark\.com\z", "interpark"),
    (r"(?i)(?:^|\.)tickets\.interpark\.com\z", "interpark"),
    (r"(?i)(?:^|\.)ticket\.yes24\.com\z", "yes24"),
    (r"(?i)(?:^|\.)nol\.yanolja\.com\z", "yanolja"),
]
VENDOR_URL = (
    r"(?i)tickets?\.interpark\.com|ticket\.yes24\.com|ticket\.melon\.com|nol\.yanolja\.com|www\.klook\.com"
)
VENDOR_RANKS = [
    (r"(?i)interpark\.com", 1),
    (r"(?i)ticket\.yes24", 2),
    (r"(?i)ticket\.melon", 3),
    (r"(?i)nol\.yanolja", 4),
    (r"(?i)klook\.com", 5),
]
GOODS_URL = r"(?i)interpark\.com/goods/(\d+)"
POSTER_HOST = "https://ticketimage.interpark.com/Play/image/large/"
DEAD_IMAGE_PREFIX = "http://nocache.stagepick.co.kr/"
SOURCE_TRUST = {
    "enrich": 90, "interpark": 70, "yes24": 70, "melon": 70, "yanolja": 70,
    "festivallife": 55, "gemini-search": 20,
}
UNKNOWN_SOURCE_TRUST = 50

# --- device names ------------------------------------------------------------------------
DEVICE_ID = r"(?i)(iPhone\d+,\d+|iPad\d+,\d+|Watch\d+,\d+)"
DEVICE_NAMES = {
    "iPhone18,3": "iPhone 17", "iPhone18,1": "iPhone 17 Pro", "iPhone18,2": "iPhone 17 Pro Max",
    "iPhone18,4": "iPhone Air",
    "iPhone17,3": "iPhone 16", "iPhone17,4": "iPhone 16 Plus", "iPhone17,1": "iPhone 16 Pro",
    "iPhone17,2": "iPhone 16 Pro Max", "iPhone17,5": "iPhone 16e",
    "iPhone15,4": "iPhone 15", "iPhone15,5": "iPhone 15 Plus", "iPhone16,1": "iPhone 15 Pro",
    "iPhone16,2": "iPhone 15 Pro Max",
    "iPhone14,7": "iPhone 14", "iPhone14,8": "iPhone 14 Plus", "iPhone15,2": "iPhone 14 Pro",
    "iPhone15,3": "iPhone 14 Pro Max",
    "iPhone14,5": "iPhone 13", "iPhone14,4": "iPhone 13 mini", "iPhone14,2": "iPhone 13 Pro",
    "iPhone14,3": "iPhone 13 Pro Max",
    "iPhone14,6": "iPhone SE (3rd gen)", "iPhone13,2": "iPhone 12", "iPhone13,1": "iPhone 12 mini",
    "iPhone13,3": "iPhone 12 Pro", "iPhone13,4": "iPhone 12 Pro Max",
}

# --- HTML entities -----------------------------------------------------------------------
HTML_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "),
    ("&amp;", "&"),
]

# --- profile pages -----------------------------------------------------------------------
INFOBOX_LABELS = [
    ("장르", "occupation"), ("출생일", "birth_date"), ("생년월일", "birth_date"), ("출생지", "birth_place"),
    ("출신지", "birth_place"), ("국적", "country"), ("국가", "country"), ("소속사", "label"),
    ("레이블", "label"), ("음반사", "label"), ("기획사", "label"), ("소속", "related"), ("그룹", "related"),
    ("Born", "birth_date"), ("Origin", "birth_place"), ("Nationality", "country"),
    ("Genres", "occupation"), ("Associated acts", "related"), ("Labels", "label"),
]
PROFILE_SOURCES = ["namu", "melon", "naver", "wikipedia"]
PROFILE_FIELDS = [
    "name_en", "avatar_url", "occupation", "birth_date", "birth_place", "label", "country", "related",
]

# --- scoring -----------------------------------------------------------------------------
ARTIST_SIGNALS = [
    ("followers_count", 0.2, "팔로워 수"),
    ("follower_graph_count", 0.25, "앱 내 팔로우 수"),
    ("upcoming_event_count", 0.1, "예정 공연 수"),
    ("event_bookmark_total", 0.2, "공연 북마크 합"),
    ("review_volume", 0.1, "리뷰 수"),
    ("review_avg", 0.15, "평균 평점"),
]
EVENT_SIGNALS = [
    ("artist_influence", 0.4, "참여 아티스트 영향력"),
    ("ticket_demand", 0.25, "티켓 수요 지표"),
    ("event_scale", 0.15, "공연 규모"),
    ("community_attention", 0.1, "커뮤니티 관심"),
    ("freshness", 0.1, "공연 임박도"),
]
BOUNDED_SIGNALS = {"review_avg": (0.0, 5.0), "artist_influence": (0.0, 100.0), "freshness": (0.0, 100.0)}
MIN_POPULATION = 20
NO_CAPACITY_NOTE = "공연장 수용인원 데이터 없음 — 규모 추정에서 제외"
TREND_CURRENT_DAYS, TREND_BASELINE_DAYS, TREND_MIN_SNAPSHOTS = 7, 30, 2
ARTIST_REC_WEIGHTS = {"co_performer": 0.4, "agency": 0.3, "genre": 0.3}
HOMEPAGE_WEIGHTS = {"popularity": 0.45, "trending": 0.25, "recommendation": 0.2, "freshness": 0.1}
RECOMMENDATION_WEIGHTS = {"favorite": 0.47, "similar": 0.29, "behavior": 0.24}

# --- lifecycle ---------------------------------------------------------------------------
EVENT_STATUSES = ["upcoming", "on_sale", "ongoing", "ended"]
OLD_EVENT_DAYS = 180
STALE_RUN_MINUTES = 15
RUN_MISSED_HOURS, RUN_LATE_HOURS = 15, 13
REENRICH_DAYS, TICKET_REENRICH_DAYS = 14, 30
STEPS = ["crawl", "sweep", "fix", "delete", "enrich", "merge", "score", "purge"]
