import datetime as dt

import pytest
from pyspark.sql import functions as F

from marquee.functions import dates as D
from marquee.functions import links as L
from marquee.functions import nested as K
from marquee.functions import text as T
from marquee.functions import validate as V


def test_legacy_titles(evaluate):
    cases = [
        ("백예린 콘서트", "백예린콘서트"), ("[2026] 백예린 Live!", "2026백예린live"),
        ("BTS World Tour", "btsworldtour"), ("ＢＴＳ　콘서트", "bts콘서트"), ("2026 Tour", "2026tour"),
        ("", ""), ("   ", ""), ("백예린  콘서트", "백예린콘서트"), ("🎵 백예린 콘서트 🎵", "백예린콘서트"),
        ("IU 아이유 Concert 2026", "iu아이유concert2026"),
    ]
    assert evaluate(T.legacy_title_key("t"), [(a,) for a, _ in cases], "t string") == [b for _, b in cases]


def test_legacy_venues(evaluate):
    cases = [
        ("올림픽체조경기장", "some title", "KSPO DOME"), ("잠실올림픽주경기장", "some title", "올림픽공원 주경기장"),
        ("고척돔", "some title", "고척 스카이돔"), ("인스파이어아레나", "some title", "인스파이어 아레나"),
        ("홍대 V홀", "some title", "홍대 V홀"), ("백예린 콘서트", "백예린 콘서트", ""),
        ("2026.08.14 ~ 2026.08.16", "콘서트", ""), ("", "콘서트", ""), ("코엑스아티움", "some title", "코엑스 아티움"),
        ("88잔디마당", "some title", "올림픽공원 88잔디마당"),
        ("예스24 라이브홀 티켓 가격: 110,000원", "x", "예스24 라이브홀"), ("R석 110,000원", "x", ""),
    ]
    got = evaluate(T.legacy_venue_name("v", "t"), [c[:2] for c in cases], "v string, t string")
    assert got == [c[2] for c in cases]


def test_exhibitions(evaluate):
    from marquee.functions import fixed_values as FV

    rows = [("보테로 특별전시",), ("백예린 2026 Live Concert",), ("뮤지컬 레미제라블",), ("오페라 투란도트",)]
    assert evaluate(F.lower("t").rlike(T.any_word(FV.EXHIBITION_WORDS)), rows, "t string") == [True, False, True, True]


def test_date_ranges(evaluate):
    d = dt.date
    cases = [
        ("2026.08.14 ~ 2026.08.16", d(2026, 8, 14), d(2026, 8, 16)),
        ("2026.08.14 - 2026.08.16", d(2026, 8, 14), d(2026, 8, 16)),
        ("2026-08-14 ~ 2026-08-16", d(2026, 8, 14), d(2026, 8, 16)),
        ("2026. 08. 14 ~ 2026. 08. 16", d(2026, 8, 14), d(2026, 8, 16)),
        ("2026.11.20", d(2026, 11, 20), None), ("2026년 6월 6~7일 (토~일)", d(2026, 6, 6), d(2026, 6, 7)),
        ("2026년 6월 6일 (토)", d(2026, 6, 6), None), ("공연 일정: 2026년 12월 25일 (금)", d(2026, 12, 25), None),
        ("", None, None), ("날짜 미정", None, None), ("2026.02.30", None, None),
        ("11.20 ~ 11.23", d(2026, 11, 20), d(2026, 11, 23)), ("01.20 ~ 01.23", d(2027, 1, 20), d(2027, 1, 23)),
    ]
    got = evaluate(D.parse_date_range("r", F.lit("2026-07-01").cast("date")), [(c[0],) for c in cases], "r string")
    assert [(g.start_date, g.end_date) for g in got] == [c[1:] for c in cases]


def test_dates_and_openings(evaluate):
    d = dt.date
    rows = [("2025.07.04 ~ 07.06",), ("2025년 7월 4일",), ("25.07.04",), ("2025-07-04",), ("2025-13-40",), (None,)]
    assert evaluate(D.parse_date("r"), rows, "r string") == [d(2025, 7, 4)] * 4 + [None, None]
    assert evaluate(D.parse_end_date("r"), rows[:2], "r string") == [d(2025, 7, 6), d(2025, 7, 4)]
    rows = [("2026-08-05T20:00:00+09:00",), ("2026.08.05 20:00",), ("2026.8.5",), ("soon",)]
    got = evaluate(D.parse_ticket_opening("r"), rows, "r string")
    assert got == [dt.datetime(2026, 8, 5, 11), dt.datetime(2026, 8, 5, 11), dt.datetime(2026, 8, 4, 15), None]
    asof = F.lit("2026-07-01").cast("date")
    for style, text in (("yes24", "2026.07.04 ~ 07.05"), ("festivallife", "2026년 7월 4일 ~ 7월 5일"), ("melon", "07.04 - 07.05")):
        got = evaluate(D.parse_period("r", style, asof), [(text,)], "r string")[0]
        assert (got.start_date, got.end_date) == (d(2026, 7, 4), d(2026, 7, 5)), style
    assert evaluate(D.parse_compact_kst("r"), [("20260716200000",)], "r string") == [dt.datetime(2026, 7, 16, 11)]
    got = evaluate(D.parse_label_opening("r", F.lit("2026-09-01").cast("date"), asof), [("07.16(목) 20:00",)], "r string")
    assert got == [dt.datetime(2026, 7, 16, 11)]
    assert evaluate(D.parse_birth_date("r"), [("1993년 5월 16일",), ("born 1990",), ("?",)], "r string") == ["1993-05-16", "1990", None]


def test_status(evaluate):
    day = F.lit("2026-07-01").cast("date")
    rows = [("2099-01-01", "2099-01-02"), ("2000-01-01", "2000-01-02"), (None, None), ("2026-06-30", None)]
    got = evaluate(D.legacy_status(F.col("a").cast("date"), F.col("b").cast("date"), day), rows, "a string, b string")
    assert got == ["upcoming", "ended", "upcoming", "on_sale"]


def test_title_keys(evaluate):
    def key(t):
        return evaluate(T.strong_title_key("t"), [(x,) for x in t], "t string")

    a, b = key(["[부산] 유승우 콘서트", "유승우 콘서트 - 부산"])
    assert a == b
    a, b = key(["［서울］ 아이유", "[서울] 아이유"])
    assert a == b
    a, b = key(["굴다리 콘서트 1부", "굴다리 콘서트 2부"])
    assert a != b
    a, b = evaluate(T.core_title_key("t"), [("[스탠딩] 어떤공연",), ("[지정석] 어떤공연",)], "t string")
    assert a != b
    a, b = key(["2026 서울숲재즈페스티벌 - 얼리버드", "2026 서울숲재즈페스티벌 - 1차 라인업"])
    assert a == b == "서울숲재즈페스티벌"
    a, b = key(["서울숲재즈페스티벌 - 티켓", "부산국제록페스티벌 - 티켓"])
    assert a != b
    rows = [("[서울] 신년음악회", None), ("[부산] 신년음악회", None)]
    a, b = evaluate(T.event_key("t", "v", F.lit("2026-01-01")), rows, "t string, v string")
    assert a != b and len(a) == 32


@pytest.mark.parametrize(
    "raw, display, english",
    [
        ("디플로(Diplo)", "디플로", "Diplo"), ("십센치(10CM)", "십센치", "10CM"), ("우즈(WOODZ", "우즈", "WOODZ"),
        ("Luna Li 루나 리", "Luna Li", None), ("지코 Zico", "지코", "Zico"), ("아이유", "아이유", None),
        ("10CM", "10CM", None), ("Charlie Puth", "Charlie Puth", None),
    ],
)
def test_structured_names(evaluate, raw, display, english):
    got = evaluate(T.structured_name("n"), [(raw,)], "n string")[0]
    assert (got.display_name, got.name_en) == (display, english)
    assert display == raw or raw in got.aliases


def test_name_decisions(evaluate):
    cases = [
        ("디플로(Diplo)", "Diplo", True, "auto"), ("지코(Zico)", "지코", True, "auto"), ("십센치(10CM)", "10CM", True, "auto"),
        ("Chalie Puth", "Charlie Puth", True, "propose"), ("아이유", "아이유", True, "keep"),
        ("방탄소년단", "BTS", True, "propose"), ("디플로(Diplo)", "Diplo", False, "propose"), ("지코", None, True, "keep"),
    ]
    got = evaluate(T.name_decision("a", "b", "m"), [c[:3] for c in cases], "a string, b string, m boolean")
    assert got == [c[3] for c in cases]


def test_venue_addresses(evaluate):
    rows = [
        ("서울 송파구 올림픽로 424 5층", "서울 송파구 올림픽로424", True), (None, "서울 송파구 올림픽로 424", True),
        ("서울 송파구 올림픽로 424", "", True), ("서울 송파구 올림픽로 424", "부산 해운대구 센텀로 55", False),
    ]
    assert evaluate(T.addresses_agree("a", "b"), [r[:2] for r in rows], "a string, b string") == [r[2] for r in rows]
    assert evaluate(T.address_key("a"), [(None,), ("",)], "a string") == ["", ""]


def test_day_options(evaluate):
    rows = [("2026-01-03", "2026-01-05"), ("2026-01-03", "2026-01-03"), ("2026-01-03", None), (None, "2026-01-05")]
    got = evaluate(D.day_options(F.col("a").cast("date"), F.col("b").cast("date")), rows, "a string, b string")
    assert [[(x.day, str(x.date)) for x in g] for g in got] == [
        [(1, "2026-01-03"), (2, "2026-01-04"), (3, "2026-01-05")], [(1, "2026-01-03")], [(1, "2026-01-03")], [],
    ]
    got = evaluate(D.date_for_day(F.col("a").cast("date"), F.col("n")), [("2026-01-31", 2), ("2026-01-03", 1)], "a string, n int")
    assert [str(g) for g in got] == ["2026-02-01", "2026-01-03"]


def test_display_and_intake(evaluate):
    rows = [("서울재즈페스티벌 2020 - 2차 라인업",), ("A - 취소",), ("그냥 제목",)]
    assert evaluate(T.display_title("t"), rows, "t string") == ["서울재즈페스티벌 2020", "A - 취소", "그냥 제목"]
    assert evaluate(T.plain_title("t"), [("  봄  Concert ",), ("Foo Tour",)], "t string") == ["봄", "foo"]
    rows = [("예스24 라이브홀 티켓 가격: 1", "x"), ("R석 110,000원", "x"), ("봄", "x"), ("세종홀", "세종홀 콘서트"), ("KSPO  Dome", None)]
    got = evaluate(T.plain_venue_name("v", "t"), rows, "v string, t string")
    assert got == ["예스24 라이브홀", None, None, None, "kspo dome"]
    rows = [("밴드 (2026.06.01~03) / 소속사",), ("가수 - SM엔터",)]
    assert evaluate(T.intake_artist_name("n"), rows, "n string") == ["밴드", "가수"]
    got = evaluate(T.split_joined_names("n"), [("선우정아 X 적재",), ("A, Bee feat. Cee",), ("양파X존박",)], "n string")
    assert got == [["선우정아", "적재"], ["Bee", "Cee"], ["양파X존박"]]
    assert evaluate(T.related_names("n"), [(" A / b,A·C",), (None,)], "n string") == [["a", "b", "c"], []]
    got = evaluate(T.lineup_names(F.split("n", ";")), [("'IU';iu;TBA;Zico",)], "n string")
    assert got == [["IU", "Zico"]]
    assert evaluate(T.name_key("n"), [("ＳＨＩＮｅｅ (샤이니)!",)], "n string") == ["shinee 샤이니"]
    assert evaluate(T.name_tokens("n"), [("SHINee (샤이니)",)], "n string") == [["shinee", "샤이니"]]
    assert evaluate(T.strip_diacritics("n"), [("Beyoncé",)], "n string") == ["Beyonce"]
    assert evaluate(T.annotation_core("n"), [("NEMOPHILA(JP)",)], "n string") == ["nemophila"]
    assert evaluate(T.hall_owner("n"), [("킨텍스 제1전시장",), ("킨텍스",), ("올림픽홀",)], "n string") == ["킨텍스", None, "올림픽공원"]
    assert evaluate(T.trash_venue_name("n"), [("홍대 홀예매하기 x",)], "n string") == ["홍대 홀"]
    assert evaluate(T.is_garbage_address("n", "a"), [("홀", "홀"), ("홀", "서울시 중구 1"), ("홀", None)], "n string, a string") == [True, False, False]


def test_links(evaluate):
    js = '["https://ticket.yes24.com/1", {"site":"interpark","url":"http://tickets.interpark.com/goods/24001"}, "x"]'
    got = evaluate(L.booking_links(L.source_urls_from_json("j"), F.lit("https://www.klook.com/a")), [(js,)], "j string")[0]
    assert [(x.provider, x.url) for x in got] == [
        ("interpark", "http://tickets.interpark.com/goods/24001"), ("yes24", "https://ticket.yes24.com/1"),
        ("klook", "https://www.klook.com/a"),
    ]
    urls = L.source_urls_from_json("j")
    assert evaluate(L.elected_vendor_url(urls), [(js,)], "j string") == ["http://tickets.interpark.com/goods/24001"]
    assert evaluate(L.ticket_provider(L.url_texts(urls)), [(js,)], "j string") == ["yes24"]
    assert evaluate(L.seller_url(L.url_texts(urls)), [(js,)], "j string") == ["https://ticket.yes24.com/1"]
    assert evaluate(L.poster_from_goods(L.url_texts(urls)), [(js,), ("[]",)], "j string") == [
        "https://ticketimage.interpark.com/Play/image/large/24/24001_p.gif", None,
    ]
    assert evaluate(L.https_image("u"), [("HTTP://a/b",), ("/x",)], "u string") == ["https://a/b", None]
    got = evaluate(L.device_label("d"), [("iPhone18,1",), ("iPhone 17 Pro (iPhone18,1)",), ("Pixel",), ("iPhone99,1",), ("",)], "d string")
    assert got == ["iPhone 17 Pro (iPhone18,1)", "iPhone 17 Pro (iPhone18,1)", "Pixel", "iPhone99,1", None]
    assert evaluate(L.source_trust("s"), [("yes24",), ("blog",), (None,)], "s string") == [70, 50, 0]
    assert evaluate(L.html_text("h"), [("<p>a</p><script>x</script>&nbsp;b",)], "h string") == ["a b"]
    assert evaluate(L.clean_wiki_text("h"), [(".mw-a{x}가수[1]  밴드",)], "h string") == ["가수 밴드"]
    assert evaluate(L.display_name(F.col("p"), F.col("e")), [(None, "a@b"), ("", None), ("N", "a@b")], "p string, e string") == ["a", "이름 없음", "N"]


def test_nested(evaluate):
    js = ['{"artists":[" IU ","IU","",3,{"a":1},"Zico"]}', "{}", None]
    assert evaluate(K.candidate_names(F.col("j")), [(x,) for x in js], "j string") == [["IU", "Zico"], [], []]
    got = evaluate(K.reply_verdicts(F.col("r")), [('ok [{"i":1,"v":"KEEP"},{"i":2,"v":"Drop"}]',), ("nope",)], "r string")
    assert got == [{1: "keep", 2: "drop"}, {}]
    got = evaluate(D.format_kst(F.col("t").cast("timestamp_ntz")), [("2026-01-01 18:30:00",), (None,)], "t string")
    assert got == ["2026.01.02 03:30", "–"]
    assert evaluate(D.clock("t"), [("9.30",), ("10:05",)], "t string") == ["09:30", "10:05"]


def test_validation(evaluate):
    assert evaluate(V.is_garbage("n"), [("R석 110,000원",), ("홀",), ("세종 문화회관",)], "n string") == [True, True, False]
    got = evaluate(
        V.event_errors(*[F.col(c) for c in "tseukn"]),
        [("좋은 공연", "2026-01-02", "2026-01-01", "upcoming", "k", "yes24"), ("a", None, None, "open", "", "yes24")],
        "t string, s string, e string, u string, k string, n string",
    )
    assert got == [["end_date: before start_date"], ["title: too short", "status: unknown", "dedup_key: missing"]]
    got = evaluate(V.artist_errors(F.col("n"), F.col("a")), [("123", None), ("밴드/소속", "x"), ("IU", "https://a/b.png")], "n string, a string")
    assert got == [["name: digits only"], ["name: has a slash", "avatar_url: not a URL"], []]
    got = evaluate(V.venue_errors(F.col("n"), F.col("a")), [("VIP 110,000원", None), ("세종문화회관", "www.x")], "n string, a string")
    assert got == [["name: has a price", "name: has a ticket grade", "name: meaningless"], ["address: has a URL"]]
    got = evaluate(V.legacy_venue_errors(F.col("n"), F.col("a")), [("세종", "세종"), ("x", None)], "n string, a string")
    assert got == [["address: same as name"], ["name: too short"]]


def test_keys_keep_exactly_their_characters_and_no_pattern_negates_a_hangul_class(evaluate, spark):
    """Java takes about seven times as long for a negated class with Hangul ranges."""
    odd = " ﻿Ａb-C 1_é😀\n힣ㄱᄀ 　\r\u0085x·、! "
    rows = [(odd,), ("",), (None,)]
    assert evaluate(T.title_key_of(F.lower("s")), rows, "s string") == ["bc1힣x", "", None]
    assert evaluate(T.squeeze("s"), rows, "s string") == ["Ａb-C 1_é😀 힣ㄱᄀ \u0085x·、!", "", None]
    assert evaluate(T.unpunctuated_title("s"), rows, "s string") == ["ａbc1é😀힣ㄱᄀ\u0085x", "", ""]
    for key in (T.title_key, T.name_key, T.address_key, T.venue_key, T.venue_merge_key, T.canon_key, T.venue_tokens):
        plan = spark.createDataFrame(rows, "s string").select(key("s"))._jdf.queryExecution().analyzed().toString()
        assert "[^" not in plan, key.__name__


def test_steps_of_a_title_are_in_the_plan_once(evaluate, spark):
    rows = [("﻿ Show - 2차 라인업",), ("Ab - 2차 라인업",), ("x Festival - lineup 2차",), ("Long Show - 공연",), ("",), (None,)]
    assert evaluate(T.display_title("s"), rows, "s string") == ["Show", "Ab - 2차 라인업", "x Festival", "Long Show - 공연", "", None]
    assert evaluate(T.festival_key_of(F.col("s")), rows, "s string") == ["", "", "festival", None, None, None]
    assert evaluate(L.http_url("s"), [(" http://a ",), ("a",), (None,)], "s string") == ["http://a", None, None]
    for key, pattern in ((T.display_title("s"), r"개최\s*무산"), (T.festival_key_of(F.col("s")), "[-–—]"), (L.http_url("s"), r"]+\z")):
        plan = spark.createDataFrame(rows, "s string").select(key.alias("v"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(pattern) == 1, plan
