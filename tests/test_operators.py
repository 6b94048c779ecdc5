import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from marquee.functions import dates as D
from marquee.operators import audits as A
from marquee.operators import enrich as EN
from marquee.operators import lifecycle as LC
from marquee.operators import lookups as LK
from marquee.operators import quality as Q
from marquee.operators import timetable as TT
from marquee.operators import upsert as U
from marquee.sources import files as FI
from marquee.sources import landing as LD
from marquee.sources import pages as P
from marquee.streaming import counters, ingest
from marquee.streaming.sources import stream_table

from .fixtures import ARTISTS, EVENTS, VENUES, artist, catalogue, event, venue, when

AS_OF = "2026-07-01T00:00:00"


# --- upsert ------------------------------------------------------------------------------
INCOMING = (
    "row_id long, title string, normalized_title string, dedup_key string, poster_url string, start_date date, end_date date, "
    "ticket_open_date timestamp, ticket_provider string, booking_url string, status string, genre string, description string, "
    "artist_id string, venue_id string, source_name string, source_urls array<struct<site:string,url:string>>"
)


def crawl(n, title, key, source, **values):
    names = [p.split()[0] for p in INCOMING.split(", source_urls")[0].split(", ")] + ["source_urls"]
    base = dict.fromkeys(names) | {
        "row_id": n, "title": title, "normalized_title": title.lower(), "dedup_key": key, "status": "on_sale", "source_name": source,
        "start_date": dt.date(2026, 8, 1), "source_urls": [(source, f"https://ticket.{source}.com/{n}")],
    } | values
    return tuple(base[c] for c in names)


def test_upsert_rules(spark):
    at = when("2026-06-01")
    events = spark.createDataFrame([
        event("low", "Low", "2026-08-01", normalized_title="low", genre="good", poster_url="p", field_sources={"genre": ("yes24", at), "poster_url": ("gemini-search", at)}),
        event("lock", "Locked", "2026-08-01", normalized_title="locked", genre="mine", locked_fields=["genre", "status"], status="upcoming"),
        event("done", "Done", "2026-08-01", normalized_title="done", status="ended"),
        event("same", "Same", "2026-08-01", normalized_title="same", created_at=when("2026-02-01")),
        event("same2", "Same", "2026-08-01", normalized_title="same", created_at=when("2026-03-01")),
    ], EVENTS)
    rows = spark.createDataFrame([
        crawl(1, "Low", "key-low", "festivallife", genre="worse", poster_url="https://new"),
        crawl(2, "Locked", "key-lock", "yes24", genre="other", status="on_sale"),
        crawl(3, "Done", "key-done", "yes24", status="on_sale", artist_id="a9"),
        crawl(4, "Same", "fresh-key", "melon"),
        crawl(5, "New", "k-new", "gemini-search", genre="first", venue_id="v"), crawl(6, "New", "k-new", "yes24", genre="second"),
        crawl(7, "New", "k-other", "gemini-search", genre="third"),
        crawl(8, "x", "k-bad", "yes24"), crawl(9, "Late", "k-late", "yes24", end_date=dt.date(2026, 7, 1)),
    ], INCOMING)
    out = U.upsert(rows, events, AS_OF, hold=True)
    got = {r.id: r for r in out["events"].collect()}
    assert (got["low"].genre, got["low"].poster_url) == ("good", "https://new")
    assert got["low"].field_sources["poster_url"].source == "festivallife" and got["low"].field_sources["genre"].source == "yes24"
    assert (got["lock"].genre, got["lock"].status) == ("mine", "upcoming")
    assert (got["done"].status, got["done"].artist_id) == ("ended", "a9")
    assert got["same"].dedup_key == "fresh-key" and got["same2"].dedup_key == "key-same2"
    new = [r for i, r in got.items() if i.startswith("event-")]
    assert len(new) == 1 and new[0].genre == "second" and new[0].is_hidden and new[0].hidden_reason == "pending_classification"
    assert len(new[0].source_urls) == 3 and [b.provider for b in new[0].booking_links] == ["yes24"] and new[0].venue_id == "v"
    changes = {(r.event_id, r.field_name): (r.old_value, r.new_value) for r in out["changes"].collect()}
    assert changes["low", "poster_url"] == ("p", "https://new") and changes["done", "artist_id"] == (None, "a9")
    assert not any(k[0] == "lock" for k in changes)
    assert {r.event_id: r.action for r in out["actions"].collect()}[new[0].id] == "inserted"
    assert {r.title: r.errors for r in out["rejected"].collect()} == {"x": ["title: too short"], "Late": ["end_date: before start_date"]}
    again = U.upsert(rows, out["events"], AS_OF)
    assert {r.action for r in again["actions"].collect()} == {"skipped"} and again["changes"].isEmpty()


# --- matching ----------------------------------------------------------------------------
def test_match_or_create(spark):
    artists = spark.createDataFrame([artist("a1", "아이유", normalized_name="아이유"), artist("a2", "Luna Li")], ARTISTS)
    aliases = spark.createDataFrame([("a1", "IU", "seed")], "artist_id string, alias string, source string")
    raw = ["아이유", " iu ", "아이유!", "Luna Li 루나 리", "디플로(Diplo)", "Diplo 디플로", "12345", "  "]
    profiles = spark.createDataFrame([("디플로(Diplo)", "https://d", "DJ")], "name string, avatar_url string, occupation string")
    names = spark.createDataFrame([(n,) for n in raw], "raw_name string")
    matches, everyone, spelled, rejected = LK.match_or_create_artists(names, artists, aliases, profiles)
    got = {r.raw_name: r.artist_id for r in matches.collect()}
    assert got["아이유"] == got[" iu "] == got["아이유!"] == "a1" and got["Luna Li 루나 리"] == "a2"
    assert {r.raw_name for r in rejected.collect()} == {"12345"}
    by_id = {r.id: r for r in everyone.collect()}
    diplo = by_id[got["디플로(Diplo)"]]
    assert diplo.name == "디플로" and diplo.name_en == "Diplo" and diplo.avatar_url == "https://d"
    assert ("a2", "루나 리") in {(r.artist_id, r.alias) for r in spelled.collect()}
    lists = spark.createDataFrame([("e", "yes24", ["nobody", "Diplo 디플로", "아이유", "IU"])], "event_id string, source_name string, names array<string>")
    ids = spark.createDataFrame([("Diplo 디플로", "d"), ("아이유", "a1"), ("IU", "a1")], "raw_name string, artist_id string")
    edges = sorted((r.display_order, r.artist_id, r.role, r.artist_name) for r in LK.event_artist_rows(lists, ids).collect())
    assert edges == [(1, "d", "primary", "Diplo 디플로"), (2, "a1", "lineup", "아이유")]


def test_match_or_create_venues(spark):
    venues = spark.createDataFrame([venue("v1", "세종홀", normalized_name="세종홀")], VENUES)
    raw = spark.createDataFrame(
        [("세종홀 티켓 가격: 1", None), ("새 극장", " 서울 "), ("R석 10,000원", None), ("www.x", None)], "venue_name string, venue_address string")
    matches, everyone, rejected = LK.match_or_create_venues(raw, venues)
    got = {r.venue_name: r.venue_id for r in matches.collect()}
    assert got["세종홀 티켓 가격: 1"] == "v1" and set(got) == {"세종홀 티켓 가격: 1", "새 극장"}
    assert {(r.name, r.address) for r in everyone.collect()} == {("세종홀", None), ("새 극장", "서울")}
    assert rejected.isEmpty()


def test_titles_and_link_status(spark):
    artists = spark.createDataFrame([("1", "아이유"), ("2", "이유"), ("3", "Luna Li"), ("4", "V")], "id string, name string")
    events = spark.createDataFrame(
        [("a", "아이유 콘서트"), ("b", "LUNA-LI live"), ("c", "친구이유식"), ("d", "서울 페스티벌"), ("e", "nobody")], "id string, title string")
    got = {r.event_id: r.artist_id for r in LK.titles_naming_artists(events, artists).collect()}
    assert got == {"a": "1", "b": "3"}
    status = {r.id: r.artist_link_status for r in LK.link_status(events.withColumn("artist_id", F.lit(None).cast("string")), artists).collect()}
    assert status == {"a": "linked", "b": "linked", "c": "no_artist", "d": "multi_artist", "e": "no_artist"}


# --- timetables --------------------------------------------------------------------------
def test_timetable_text(spark):
    text = "\n".join([
        "DAY 1", "MAIN STAGE", "GREEN 10:00 ~ 10:40", "아이유", "Day 2", "12:00-12:40 to 13:00", "7.12", "RED 14.00-15.00", "RED 15:00-14:00", "지코", "BLUE 16:00~17:00",
    ])
    texts = spark.createDataFrame([("e", text, dt.date(2026, 7, 10), "축제", "t")], "event_id string, text string, start_date date, genre string, title string")
    rows, issues = TT.parse_timetable(texts, AS_OF)
    got = sorted((r.day_number, r.date_string, r.start_time, r.end_time, r.artist_name, r.stage_name) for r in rows.collect())
    assert got[0] == (1, "2026.07.10", "10:00", "10:40", "아이유", "GREEN")
    assert (3, "2026.07.12", "14:00", "15:00", "지코", "RED") in got
    assert {r.reason for r in issues.collect()} >= {"slot_without_artist", "unreadable_line"}
    artists = spark.createDataFrame([artist("a1", "아이유")], ARTISTS)
    none = spark.createDataFrame([], "artist_id string, alias string, source string")
    out = TT.import_timetable(texts, artists, none, AS_OF)
    assert {r.artist_name: r.artist_id for r in out["performances"].collect()}["아이유"] == "a1"
    log = out["unmatched"]
    assert "지코" in {r.artist_name for r in log.collect()}
    todo = spark.createDataFrame([("e", "지코", "create", None, " 지코 ")], "event_id string, artist_name string, action string, artist_id string, new_name string")
    entries, slots, everyone = TT.resolve_unmatched(log, out["performances"], todo, artists, none)
    assert {r.artist_name: r.is_resolved for r in entries.collect()}["지코"]
    made = {r.name: r.id for r in everyone.collect()}["지코"]
    assert {r.artist_name: r.artist_id for r in slots.collect()}["지코"] == made
    gone = todo.withColumn("action", F.lit("delete"))
    entries, slots, _ = TT.resolve_unmatched(log, out["performances"], gone, artists, none)
    assert "지코" not in {r.artist_name for r in slots.collect()} | {r.artist_name for r in entries.collect()}
    assert TT.log_unmatched(log, log).count() == log.count()


def test_stage_overlaps(spark):
    rows = [(1, "s", 0, 100), (2, "s", 10, 20), (3, "s", 50, 60), (4, "s", 100, 120), (5, "s", 100, 110), (6, "t", 5, 6)]
    df = spark.createDataFrame(rows, "id int, stage string, s int, e int")
    got = {r.id: r.busy_until for r in TT.stage_overlaps(df, ["stage"], "s", "e", "id").collect()}
    assert got == {2: 100, 3: 100, 5: 120}


def test_page_timetable(spark):
    lines = ["intro"] * 9 + ["TIMETABLE"] + ["x"] * 2 + ["10:00 ~ 11:00 A"] + ["y"] * 12
    html = "<html><body><script>12:00-13:00</script>" + "\n".join(f"<p>{x}</p>" for x in lines) + "<img alt='time table' src='//i/t.png'></body></html>"
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    kept = [r.pos for r in P.timetable_lines(P.page_lines(pages, "page_id"), "page_id").orderBy("pos").collect()]
    assert kept == list(range(9, 18))
    assert [r.url for r in P.timetable_images(pages, "page_id").collect()] == ["//i/t.png"]


# --- pages -------------------------------------------------------------------------------
def test_list_pages(spark):
    shop = "<a href='/ticket/products/7' aria-label='봄 공연, HOT, 오픈일: 07.16(목) 20:00'><img src='//i/x.png'></a>" * 2
    perf = "<a href='#' onclick='GoToPerfDetail(55)' title='가을'></a>"
    board = "<a href='/b/?bmode=view&idx=3'>게시글</a>"
    pages = spark.createDataFrame([(1, f"<body>{shop}{perf}{board}</body>")], "page_id int, html string")
    links = P.anchors(pages)
    assert [tuple(r) for r in P.shop_items(links, D.at(AS_OF)).collect()] == [("7", "봄 공연", "https://i/x.png", dt.datetime(2026, 7, 16, 11))]
    assert [(r.perf_id, r.title) for r in P.detail_items(links).collect()] == [("55", "가을")]
    assert [tuple(r) for r in P.board_items(links, "https://b").collect()] == [("https://b/b/?bmode=view&idx=3", "게시글")]
    meta = '<meta property="og:description" content="2026년 7월 10일 ~ 7월 11일 장소: 세종홀 &amp; more text"><meta property="og:image" content="https://i">'
    page = P.page_meta(spark.createDataFrame([(1, f"<html><title>t</title>{meta}<body>b</body></html>")], "page_id int, html string"), D.at(AS_OF)).first()
    assert (page.start_date, page.end_date, page.poster_url) == (dt.date(2026, 7, 10), dt.date(2026, 7, 11), "https://i")
    assert page.venue_name.startswith("세종홀")
    text = spark.createDataFrame([(meta,), ("<meta name='description' content='short text'>",)], "h string").select(P.meta_description("h").alias("d")).collect()
    assert text[0].d.endswith("세종홀 & more text") and text[1].d is None
    items = spark.createDataFrame([(2, " A "), (1, "a"), (3, "b")], "n int, title string")
    assert sorted(r.title for r in P.first_titles(items, ["n"]).collect()) == ["a", "b"]


# --- quality -----------------------------------------------------------------------------
def test_verdicts_and_failures(spark):
    titles = spark.createDataFrame([("봄 콘서트",), ("봄  콘서트!",), ("모네 전시",), ("!!",), ("cached",)], "title string")
    cache = spark.createDataFrame([("cached", "drop", "cached")], "title_key string, verdict string, sample_title string")
    judged, grown = Q.verdicts(titles, cache)
    got = {r.title: r.verdict for r in judged.collect()}
    assert got == {"봄 콘서트": "keep", "봄  콘서트!": "keep", "모네 전시": "drop", "!!": "keep", "cached": "drop"}
    assert grown.count() == 3

    def broken(batch):
        raise ValueError("quota")

    judged, grown = Q.verdicts(titles, cache, broken)
    assert {r.verdict for r in judged.collect()} == {"unknown", "keep", "drop"} and grown.count() == 1
    held = spark.createDataFrame(
        [event("1", "봄 콘서트", is_hidden=True, hidden_reason="pending_classification"), event("2", "모네 전시", is_hidden=True, hidden_reason="pending_classification")], EVENTS)
    state, _ = Q.reclassify_held(held, cache)
    assert {r.id: (r.is_hidden, r.hidden_reason) for r in state.collect()} == {"1": (False, None), "2": (True, "non_concert")}
    state, _ = Q.reclassify_held(held, cache, broken)
    assert {r.hidden_reason for r in state.collect()} == {"pending_classification"}


def test_auto_fix_acts_once_per_field(spark):
    t = catalogue(spark)
    artists, log, tasks = Q.auto_fix(t["artists"], "artist", t["queue"])
    assert {r.id: r.occupation for r in artists.collect()}["a3"] is None
    assert [(r.entity_id, r.issue) for r in log.collect()] == [("a3", "artist_occupation_address")]  # a4 has an open task
    assert tasks.isEmpty()
    since = Q.auto_fix(t["artists"], "artist", t["queue"], D.at("2026-06-01"))[1]
    assert since.isEmpty()
    rows, log = Q.auto_delete(t["events"], "event", AS_OF, spark.createDataFrame([], "entity_id string, delete boolean"))
    assert [r.entity_id for r in log.collect()] == ["e6"] and rows.count() == 5
    extra = spark.createDataFrame([("v1", "address"), ("v9", "name")], "entity_id string, field string")
    assert Q.without_known(extra, Q.scan(t["venues"], "venue")).count() == 1


def test_hiding_heals_itself(spark):
    rows = [
        event("bare", "t", artist_link_status="no_artist"), event("tried", "t", enrich_attempted_at=when("2026-06-01")),
        event("festival", "t", artist_link_status="multi_artist", enrich_attempted_at=when("2026-06-01")), event("poster", "t", artist_link_status="no_artist", poster_url="p"),
        event("healed", "t", is_hidden=True, hidden_reason="unlinked_no_artist", artist_id="a"), event("old", "t", is_hidden=True, hidden_reason="ended_180d", artist_id="a"),
    ]
    got = {r.id: r.is_hidden for r in LC.hide_unlinked(spark.createDataFrame(rows, EVENTS), AS_OF).collect()}
    assert got == {"bare": True, "tried": True, "festival": False, "poster": False, "healed": False, "old": True}


def test_enrichment(spark):
    t = catalogue(spark)
    artists, log, aliases = EN.enrich_artists(t["artists"], t["artist_profiles"], AS_OF)
    got = {r.id: r for r in artists.collect()}["a3"]
    assert got.occupation == "서울시 가수" and got.name_en == "ZICO" and got.label == "KOZ" and got.enrichment_status == "enriched"
    assert [(r.alias, r.source) for r in aliases.collect()] == [("ZICO", "enrich:namu")]
    forced, _, _ = EN.enrich_artists(t["artists"], t["artist_profiles"], AS_OF, force=True)
    assert {r.id: r.occupation for r in forced.collect()}["a3"] == "힙합"
    assert {r.entity_id for r in EN.enrichment_tasks(t["artists"], t["queue"]).collect()} == {"a1", "a2", "a3"}
    dirty = spark.createDataFrame([artist("1", "x", occupation=".mw-x{}", country="KR"), artist("2", "y", occupation="발라드", country="KR"), artist("3", "z", occupation="배우", country="KR")], ARTISTS)
    got = {r.id: (r.occupation, r.enrichment_status) for r in Q.reset_dirty_profiles(dirty).collect()}
    assert got == {"1": (None, "pending"), "2": ("발라드", None), "3": (None, "pending")}


def test_health_levels(spark):
    def level(status, started, failed=0, step="done"):
        runs = spark.createDataFrame([(when(started), status, ["fix"])] if started else [], "started_at timestamp, status string, failed_steps array<string>")
        steps = spark.createDataFrame([("crawl", step, when("2026-06-30 20:00"))], "step_name string, status string, started_at timestamp")
        queue = spark.createDataFrame([("failed",)] * failed or [("done",)], "status string")
        artists = spark.createDataFrame([(None,)], "name_proposal string")
        logs = spark.createDataFrame([(True,)], "is_resolved boolean")
        row = LC.health(runs, steps, queue, artists, logs, AS_OF).first()
        return row.level, row.reason

    assert level(None, None) == ("red", "no_runs")
    assert level("done", "2026-06-30 18:00") == ("green", "ok")
    assert level("done", "2026-06-30 18:00", step="running") == ("red", "stalled")
    assert level("failed", "2026-06-30 18:00") == ("red", "last_run_failed")
    assert level("done", "2026-06-30 08:00") == ("red", "run_missed")
    assert level("partial", "2026-06-30 18:00") == ("yellow", "last_run_partial")
    assert level("done", "2026-06-30 10:00") == ("yellow", "run_late")
    assert level("done", "2026-06-30 18:00", failed=2) == ("yellow", "backlog")


def test_non_music_and_unpin(spark):
    events = spark.createDataFrame([event("e", "t", artist_id="a1", locked_fields=["status", "title"])], EVENTS)
    artists = spark.createDataFrame([artist("a1", "x", is_music_artist=False), artist("a2", "y")], ARTISTS)
    edges = spark.createDataFrame([("e", "a1"), ("e", "a2")], "event_id string, artist_id string")
    e, a, l = LC.drop_non_music(events, artists, edges)
    assert e.first().artist_id is None and [r.artist_id for r in l.collect()] == ["a2"] and a.count() == 1
    assert LC.unpin(events, spark.createDataFrame([("e",)], "id string")).first().locked_fields == ["title"]
    assert LC.affected_artists(spark.createDataFrame([("e",)], "id string"), events, edges).count() == 2


def test_user_rollup(spark):
    users = spark.createDataFrame([("u1", "a@x", None, when("2026-06-30")), ("u2", None, when("2026-06-01"), when("2026-01-01"))], "id string, email string, last_sign_in_at timestamp, created_at timestamp")
    profiles = spark.createDataFrame([("u1", "관리", "admin", when("2026-06-02"))], "id string, display_name string, role string, last_visit_date timestamp")
    books = spark.createDataFrame([("u1", "e")], "user_id string, event_id string")
    rows = A.user_rollup(users, books, spark.createDataFrame([], "user_id string"), profiles)
    got = {r.id: (r.display_name, r.role, r.booking_count, r.account_status) for r in rows.collect()}
    assert got == {"u1": ("관리", "admin", 1, "active"), "u2": ("이름 없음", "user", 0, "active")}
    assert A.user_stats(rows, AS_OF).first().asDict() == {"total": 2, "pending": 0, "recent": 1}


# --- files and streams -------------------------------------------------------------------
def test_landing_and_files(spark, tmp_path):
    rows = spark.createDataFrame([("1", "yes24", when("2026-06-30"), "{}"), ("2", "melon", when("2026-06-30"), "{}")], "id string, source_name string, crawled_at timestamp, parsed_json string")
    LD.land(rows, str(tmp_path / "raw"))
    LD.land(rows.limit(1), str(tmp_path / "raw"))
    assert LD.scan(spark, str(tmp_path / "raw")).count() == 3
    assert (tmp_path / "raw" / "source_name=melon").exists()
    users = spark.createDataFrame([tuple(['a"b'] * 9)], ", ".join(f"{c} string" for c in FI.USER_EXPORT))
    FI.export_users(users, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text(encoding="utf-8")
    assert text.startswith("﻿") and '"a""b"' in text
    plan = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, what string")
    FI.write_plan(plan, str(tmp_path / "plan"))
    back = FI.read_plan(spark, str(tmp_path / "plan"), "id string, what string")
    assert FI.approved(back, spark.createDataFrame([("2", True), ("1", False)], "id string, approved boolean"), ["id"]).first().what == "y"
    shots = spark.createDataFrame([("artist", "1", when("2026-06-30")), ("artist", "1", when("2026-01-01"))], "entity_type string, entity_id string, captured_at timestamp")
    LD.append_snapshots(shots, str(tmp_path / "snap"))
    assert LD.read_snapshots(spark, str(tmp_path / "snap"), AS_OF).count() == 1
    LD.append_log(plan, str(tmp_path / "log"))
    LD.append_log(plan, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_streamed_ingest_equals_batch(spark, tmp_path):
    schema = "id long, parsed_json string, crawled_at timestamp"
    record = '{"sourceUrl":"https://ticket.yes24.com/%d","sourceName":"yes24","title":"공연 %d","startDate":"2026.08.0%d","status":"on_sale"}'
    one = spark.createDataFrame([(i, record % (i, i, i), when("2026-06-30")) for i in (1, 2)], schema)
    two = spark.createDataFrame([(3, record % (3, 2, 2), when("2026-06-30")), (4, record % (4, 4, 4), when("2026-06-30"))], schema)
    raw, store = str(tmp_path / "raw"), ingest.EventStore(spark, str(tmp_path / "events"))
    store.write(0, spark.createDataFrame([], EVENTS))
    for part in (one, two):
        part.coalesce(1).write.mode("append").parquet(raw)
        stream = stream_table(spark, raw, "*.parquet", part.schema)
        ingest.start_ingest(stream, store, str(tmp_path / "ckpt"), AS_OF).awaitTermination()
    got = {r.title: len(r.source_urls) for r in store.read(2).collect()}
    assert got == {"공연 1": 1, "공연 2": 2, "공연 4": 1}
    before = sorted(map(repr, store.read(2).collect()))
    ingest.ingest_batch(store, two, 1, AS_OF)  # a repeated batch changes nothing
    assert sorted(map(repr, store.read(2).collect())) == before
    store.compact(2)
    assert sorted(map(repr, store.read(2).collect())) == before and store.read(1).count() == 2 and store.read(0).count() == 0


def test_event_store_versions(spark, tmp_path):
    """Random changes and compactions against a dictionary per version; a small change writes little."""
    import random

    rng, now, kept = random.Random(5), {}, []
    store = ingest.EventStore(spark, str(tmp_path / "store"), buckets=8)
    frame = lambda d: spark.createDataFrame([(k, v, {"k": v}) for k, v in d.items()], "id string, v int, m map<string,int>")
    now = {f"e{k}": k for k in range(2000)}
    store.write(0, frame(now))
    kept.append(dict(now))
    for version in range(1, 6):
        some = {f"e{rng.randrange(2100)}": rng.randrange(10**6) for _ in range(4)} if version != 3 else {}
        store.append(version, frame(some))
        now |= some
        kept.append(dict(now))
        if version in (2, 4):
            store.compact(version)
    for version, want in enumerate(kept):
        got = store.read(version).collect()
        assert {r.id: r.v for r in got} == want and len(got) == len(want) and all(r.m == {"k": r.v} for r in got)
    size = lambda folder: sum(f.stat().st_size for f in (tmp_path / "store" / folder).rglob("*.parquet"))
    assert size("changed/in_version=000000000001") < 0.1 * size("whole/in_version=000000000000")
    assert len(list((tmp_path / "store/whole/in_version=000000000002").glob("id_bucket=*"))) <= 8
    (tmp_path / "store/changed/in_version=000000000005/_SUCCESS").unlink()
    assert {r.id: r.v for r in store.read(5).collect()} == kept[4]  # a version that was not completed does not count


def test_recount(spark):
    t = catalogue(spark)
    fresh = counters.recount(spark.createDataFrame([("e1",)], "event_id string"), t)
    assert [(r.id, r.upcoming_event_count, r.followers_count) for r in fresh.collect()] == [("a1", 1, 1)]


@pytest.mark.parametrize("batches", [1, 3])
def test_crawl_alarms_in_any_order(spark, tmp_path, batches):
    rows = [("s", 10, 5), ("s", 40, 0), ("s", 20, 0), ("s", 30, 0), ("t", 10, 0), ("t", 50, 2), ("t", 60, 0)]
    schema = "source_name string, at long, events_found int"
    for i in range(batches):
        spark.createDataFrame(rows[i::batches], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "jobs"))
    from marquee.streaming.sources import drain

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "jobs"))
    out = drain(ingest.crawl_alarms(stream), "update")
    last = out.groupBy("source_name").agg(F.max_by(F.struct("zero_run", "alarm"), "epoch").alias("s")).collect()
    assert {r.source_name: tuple(r.s) for r in last} == {"s": (3, True), "t": (1, False)}


def test_page_timetable_is_found_where_the_page_is_read(spark):
    rng = random.Random(4)
    lines = ["intro", "x", "", "  y\t z ", "10:00 ~ 11:00 A", "TIMETABLE", "DAY 1", "MAIN", "　 b  c", "7/12", "timetable 12:00-13:00", "a&amp;b"]
    rows = [(n, "<body>" + rng.choice(["\n", "\r\n", " \n\r\n"]).join(rng.choices(lines, [12, 12, 3, 6, 1, 1, 2, 2, 4, 2, 1, 1], k=rng.randint(0, 50))) + "</body>")
            for n in range(200)]
    pages = spark.createDataFrame(rows, "page_id int, html string")
    found = P.page_timetable(pages, "page_id")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    held = {}
    for r in P.page_lines(pages, "page_id").collect():
        held.setdefault(r.page_id, {})[r.pos] = r.line
    want = set()
    for page, at in held.items():
        time = [bool(re.search(r"\d\d:\d\d\s*[~-]\s*\d", at[i])) for i in range(len(at))]
        word = ["timetable" in at[i].lower() and not time[i] for i in range(len(at))]
        telling = [time[i] or word[i] or bool(re.search(r"(?i)day|main|\d/\d", at[i])) for i in range(len(at))]
        told = False
        for i in range(len(at)):
            reach = any(time[max(i - 3, 0):i + 4]) or any(word[max(i - 8, 0):i + 9])
            told = reach and (told or telling[i])
            want |= {(page, i, at[i])} if told else set()
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in P.timetable_lines(P.page_lines(pages, "page_id"), "page_id").collect()} == want


def test_timetable_texts_are_dealt_before_they_are_split(spark):
    """One exchange of whole texts; their lines, with all that is read from them, are neither shuffled nor read twice."""
    texts = spark.createDataFrame([("e", "A\nMAIN 10:00~11:00\nact", dt.date(2026, 7, 10), "x")], "event_id string, text string, start_date date, genre string")
    plan = TT.parse_timetable(texts, AS_OF)[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Generate posexplode") == 1
