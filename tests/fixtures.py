"""A small catalogue with one row for each situation the operators treat specially."""

from __future__ import annotations

import datetime as dt

EVENTS = (
    "id string, title string, normalized_title string, dedup_key string, artist_id string, venue_id string, poster_url string, "
    "genre string, age_restriction string, ticket_open_date timestamp, ticket_close_date timestamp, ticket_provider string, "
    "notice_text string, booking_url string, organizer string, duration string, description string, start_date timestamp, "
    "end_date timestamp, status string, source_name string, created_at timestamp, crawled_at timestamp, enrich_attempted_at timestamp, "
    "is_hidden boolean, hidden_reason string, hidden_at timestamp, merged_into_event_id string, artist_link_status string, "
    "has_timetable boolean, source_urls array<struct<site:string,url:string>>, "
    "booking_links array<struct<provider:string,label:string,url:string>>, locked_fields array<string>, "
    "field_sources map<string,struct<source:string,at:timestamp>>, popularity_score double, trending_score double"
)
ARTISTS = (
    "id string, name string, normalized_name string, name_en string, avatar_url string, occupation string, birth_date string, "
    "birth_place string, related string, label string, country string, followers_count int, upcoming_event_count int, "
    "sns_links map<string,string>, name_proposal string, enrichment_status string, enrichment_attempted_at timestamp, "
    "is_music_artist boolean, popularity_score double, trending_score double, created_at timestamp"
)
VENUES = "id string, name string, normalized_name string, address string, phone_number string, created_at timestamp"


def names(schema: str) -> list[str]:
    out, depth = [], 0
    for part in schema.split(", "):
        if depth == 0:
            out.append(part.split()[0])
        depth += part.count("<") - part.count(">")
    return out


def row(schema: str, defaults: dict, **values) -> tuple:
    full = dict.fromkeys(names(schema)) | defaults | values
    return tuple(full[c] for c in names(schema))


def when(text: str | None):
    return dt.datetime.fromisoformat(text) if text else None


def event(id: str, title: str, start: str | None = "2026-07-10", end: str | None = None, **values) -> tuple:
    base = {
        "id": id, "title": title, "start_date": when(start), "end_date": when(end), "status": "on_sale", "is_hidden": False,
        "created_at": when("2026-01-01"), "crawled_at": when("2026-06-30"), "source_urls": [("yes24", f"https://ticket.yes24.com/{id}")],
        "locked_fields": [], "field_sources": {}, "booking_links": [], "has_timetable": False, "dedup_key": f"key-{id}",
    }
    return row(EVENTS, base, **values)


def artist(id: str, name: str, **values) -> tuple:
    return row(ARTISTS, {"id": id, "name": name, "followers_count": 0, "upcoming_event_count": 0, "created_at": when("2026-01-01")}, **values)


def venue(id: str, name: str, **values) -> tuple:
    return row(VENUES, {"id": id, "name": name, "created_at": when("2026-01-01")}, **values)


def catalogue(spark) -> dict:
    make = spark.createDataFrame
    payloads = [
        ("p1", '{"sourceUrl":"https://ticket.yes24.com/9","sourceName":"yes24","title":"새 공연 - 1차 라인업","startDate":"2026.08.01 ~ 08.02",'
               '"venueName":"세종홀","artists":["아이유","Luna Li 루나 리"],"status":"on_sale"}', "k9"),
        ("p2", '{"sourceUrl":"nope","sourceName":"yes24","title":"x"}', "k8"), ("p3", "{broken", "k7"), ("p0", "{}", "k0"),
    ]
    return {
        "events": make([
            event("e1", "아이유 콘서트", artist_id="a1", venue_id="v1", poster_url="http://p", genre="콘서트"),
            event("e2", "[서울] 아이유 콘서트", artist_id="a2", venue_id="v2", genre="콘서트"),
            event("e3", "지난 공연", "2025-06-01", "2025-06-02", artist_id="a3", genre="콘서트"),
            event("e4", "모네 전시", genre=None, venue_id="v1", created_at=when("2026-06-20")),
            event("e5", "그냥 밤 - 2차 라인업", "2026-09-01", venue_id="v1", genre="콘서트"),
            event("e6", "x", None, genre="콘서트"),
        ], EVENTS),
        "artists": make([
            artist("a1", "아이유", followers_count=5), artist("a2", "아이유!", label="EDAM"), artist("a3", "지코", occupation="서울시 가수"),
            artist("a4", "www.spam.com"),
        ], ARTISTS),
        "venues": make([venue("v1", "세종홀", normalized_name="세종홀", address="세종홀"), venue("v2", "세종 홀", normalized_name="세종홀", address="서울시 1")], VENUES),
        "event_artists": make(
            [("e1", "a1", "아이유", "primary", 1, "yes24"), ("e2", "a2", "아이유!", "primary", 1, "yes24"), ("e3", "a3", "지코", "primary", 1, "yes24")],
            "event_id string, artist_id string, artist_name string, role string, display_order int, source_name string"),
        "event_venues": make([("e1", "v1", 0)], "event_id string, venue_id string, display_order int"),
        "artist_aliases": make([("a3", "Zico", "seed")], "artist_id string, alias string, source string"),
        "user_artist_followings": make([("u1", "a1"), ("u1", "a2"), ("u2", "a3")], "user_id string, artist_id string"),
        "user_interested_events": make([("u1", "e1"), ("u1", "e2"), ("u2", "e3")], "user_id string, event_id string"),
        "user_bookings": make([("u1", "e2", "active")], "user_id string, event_id string, status string"),
        "concert_reviews": make([("e1", 5), ("e2", 3)], "event_id string, star_count int"),
        "popularity_snapshots": make(
            [("artist", "a1", {"x": 1.0}, 10.0, when("2026-06-25"))],
            "entity_type string, entity_id string, signals map<string,double>, popularity_score double, captured_at timestamp"),
        "title_keep_verdicts": make([], "title_key string, verdict string, sample_title string"),
        "artist_profiles": make(
            [("a3", "melon", None, "https://m", "밴드", None, None, "KOZ", None, None), ("a3", "namu", "ZICO", None, "힙합", None, None, None, None, None)],
            "artist_id string, source string, name_en string, avatar_url string, occupation string, birth_date string, birth_place string, "
            "label string, country string, related string"),
        "queue": make([("1", "artist", "a4", "clean_data", "pending", 1, when("2026-06-01"), None)],
                      "id string, entity_type string, entity_id string, task_type string, status string, priority int, created_at timestamp, error string"),
        "payloads": make([(i, j, k, when("2026-06-30")) for i, j, k in payloads], "id string, parsed_json string, payload_key string, crawled_at timestamp"),
        "processed": make([("p0", "e1")], "id string, event_id string"),
    }
