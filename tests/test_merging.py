import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from marquee.functions import text as T
from marquee.operators import cluster as C
from marquee.operators import merge_artists as MA
from marquee.operators import merge_events as ME
from marquee.operators import merge_venues as MV
from marquee.operators import similarity as S

EVENT = (
    "id string, title string, normalized_title string, dedup_key string, artist_id string, venue_id string, "
    "poster_url string, genre string, age_restriction string, ticket_open_date timestamp, ticket_close_date timestamp, "
    "ticket_provider string, notice_text string, booking_url string, organizer string, duration string, "
    "start_date timestamp, end_date timestamp, created_at timestamp, is_hidden boolean, merged_into_event_id string, "
    "source_urls array<struct<site:string,url:string>>"
)
COLUMNS = [c.split()[0] for c in EVENT.replace("array<struct<site:string,url:string>>", "x").split(", ")]


def event(id, title, day="2026-07-10", sites=("yes24",), **values):
    row = dict.fromkeys(COLUMNS)
    row |= {
        "id": id, "title": title, "start_date": dt.datetime.fromisoformat(day) if day else None, "is_hidden": False,
        "created_at": dt.datetime(2026, 1, 1), "source_urls": [(s, f"https://{s}/{id}") for s in sites],
    }
    row |= values
    return tuple(row[c] for c in COLUMNS)


def mapped(df):
    return {r["old_id"]: r["keep_id"] for r in df.collect()}


def brute_greedy(nodes):
    """The sequential rule, seed by seed."""
    out = {}
    for block in {n[0] for n in nodes}:
        rows = sorted([n for n in nodes if n[0] == block], key=lambda n: n[1])
        for i, seed in enumerate(rows):
            if (block, seed[1]) in out:
                continue
            out[block, seed[1]] = seed[1]
            own = set(seed[3])
            for other in rows[i + 1:]:
                if (block, other[1]) not in out and set(seed[2]) & set(other[2]) and not own & set(other[3]):
                    out[block, other[1]] = seed[1]
                    own |= set(other[3])
    return out


@pytest.mark.parametrize("limit", [1000, 0])
def test_greedy_star_matches_sequential_rule(spark, limit):
    rng = random.Random(7)
    nodes = [
        (b, f"{i:03d}", rng.sample("abcdefgh", rng.randint(1, 3)), rng.sample(["s1", "s2", "s3"], rng.randint(0, 2)))
        for b in ("x", "y") for i in range(14)
    ]
    df = spark.createDataFrame(nodes, C._NODE)
    got = {(r.block, r.ord): r.leader for r in C.greedy_star(df, limit).collect()}
    assert got == brute_greedy(nodes)


def test_chains(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "d")], "old_id string, keep_id string")
    assert mapped(C.resolve_chains(df)) == {"a": "d", "b": "d", "c": "d", "x": "d"}


def words(seed, n, alphabet="abc", longest=9):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest))) for _ in range(n)})


def test_containment_equals_brute_force(spark):
    values = words(1, 160)
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for ratio, shortest in ((0.4, 2), (0.5, 2), (0.0, 3)):
        got = {(r.short, r.long) for r in S.containment_pairs(df, "v", ratio, shortest).collect()}
        want = {
            (a, b) for a in values for b in values
            if a != b and len(a) >= shortest and len(a) < len(b) and a in b and len(a) / len(b) >= ratio
        }
        assert got == want


def test_jaccard_equals_brute_force(spark):
    rng = random.Random(3)
    names = sorted({" ".join(rng.sample(["aa", "b", "c", "dd", "e", "f", "g"], rng.randint(1, 6))) for _ in range(150)})
    df = spark.createDataFrame([(n, n.split()) for n in names], "name string, tokens array<string>")
    for threshold in (0.85, 0.7, 0.5):
        got = {(r.name_a, r.name_b): round(r.similarity, 9) for r in S.jaccard_pairs(df, "name", "tokens", threshold).collect()}
        want = {}
        for a, b in itertools.combinations(names, 2):
            x, y = set(a.split()), set(b.split())
            j = len(x & y) / len(x | y)
            if j >= threshold and abs(len(a) - len(b)) <= 2:
                want[a, b] = round(j, 9)
        assert got == want


@pytest.mark.parametrize("common", [0, 4, 1000])
def test_jaccard_by_groups_equals_brute_force(spark, monkeypatch, common):
    """Addresses of one site are alike by what all of them have; some also have a rare token in common."""
    monkeypatch.setattr(S, "_BLOCK", 4)
    rng = random.Random(5)
    names = sorted({f"{rng.choice(['http', 'https'])} {rng.choice('ab')} com en {rng.randint(10, 40)}{rng.choice(['', ' html'])}" for _ in range(120)})
    df = spark.createDataFrame([(n, n.split()) for n in names], "name string, tokens array<string>")
    for threshold in (0.7, 0.5):
        rows = [(r.name_a, r.name_b, round(r.similarity, 9)) for r in S.jaccard_pairs(df, "name", "tokens", threshold, common=common).collect()]
        want = []
        for a, b in itertools.combinations(names, 2):
            x, y = set(a.split()), set(b.split())
            if len(x & y) / len(x | y) >= threshold and abs(len(a) - len(b)) <= 2:
                want.append((a, b, round(len(x & y) / len(x | y), 9)))
        assert sorted(rows) == want


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, prev = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
    return row[-1]


def test_edit_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    values = set()
    for stem in ("seoul jazz festival", "seouls", "busan rock night 2026 live", "seoul"):
        for _ in range(25):
            s = list(stem)
            for _ in range(rng.randint(0, 4)):
                s[rng.randrange(len(s))] = rng.choice("abcxyz ")
            if rng.random() < 0.4:
                s.insert(rng.randrange(len(s)), rng.choice("xyz"))
            values.add("".join(s))
    values = sorted(values)
    got = {(r.a, r.b) for r in S.edit_pairs(spark.createDataFrame([(v,) for v in values], "v string"), "v").collect()}
    want = {
        (a, b) for a, b in itertools.combinations(values, 2)
        if a[:4] == b[:4] and 1 - levenshtein(a, b) / max(len(a), len(b)) >= 0.88
    }
    assert got == want and want


def test_gram_leaders(spark):
    values = words(9, 60, "abcd", 8)
    got = {r.v: r.leader for r in S.gram_leaders(spark.createDataFrame([(v,) for v in values], "v string"), "v", 3).collect()}
    grams = lambda s: {s[i:i + 3] for i in range(len(s) - 2)}
    assert got == {v: min(w for w in values if grams(w) & grams(v)) for v in values if len(v) >= 3}


def test_overlap_losers(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        start = dt.date(2026, 1, 1) + dt.timedelta(days=rng.randrange(30))
        end = None if rng.random() < 0.2 else start + dt.timedelta(days=rng.randrange(5))
        rows.append((f"{i:02d}", rng.choice("tu"), rng.choice(["v", "w", "x", None]), start, end, rng.randrange(4)))
    df = spark.createDataFrame(rows, "id string, title string, venue string, s date, e date, score int")
    got = {r.id for r in S.overlap_losers(df, ["title"], "venue", "s", "e", F.col("score"), "id").collect()}
    want = set()
    for a, b in itertools.combinations(rows, 2):
        if a[1] != b[1]:
            continue
        overlap = a[3] <= (b[4] or b[3]) and b[3] <= (a[4] or a[3])
        if a[2] == b[2] or overlap:
            want.add(b[0] if a[5] >= b[5] else a[0])
    assert got == want


def test_passes(spark):
    long = "아주아주긴제목의내한공연특별한밤에"
    rows = [
        event("01", "A show", artist_id="x"), event("02", "B show", artist_id="x", poster_url="p"),
        event("03", "Same Title!"), event("04", "same title"),
        event("05", long), event("06", long + " 추가 문구"),
        event("07", "near dates", "2026-08-01"), event("08", "near dates", "2026-08-02", sites=("melon",)),
        event("09", "near dates", "2026-08-03", sites=("melon",)),
        event("10", "포스트 말론 내한공연", "2026-09-01"), event("11", "Post Malone 포스트말론 내한공연", "2026-09-01"),
        event("12", "락페스티벌 가나", "2026-10-01", venue_id="v"), event("13", "Rock festival", "2026-10-01", ("melon",), venue_id="v"),
        event("14", "[부산] 유승우 밤무대", "2026-11-01"), event("15", "유승우 밤무대 - 부산", "2026-11-01"),
        event("16", "서울숲재즈페스티벌 - 얼리버드", "2026-12-01"), event("17", "2026 서울숲재즈페스티벌 - 1차 라인업", "2026-12-01"),
        event("18", "다른 공연", None), event("19", "A show", artist_id="x", is_hidden=True),
    ]
    df = spark.createDataFrame(rows, EVENT)
    got = {r.old_id: (r.keep_id, r.pass_name) for r in ME.pass_mapping(df).collect()}
    assert got["01"] == ("02", "pass1_artist_day")
    assert got["04"] == ("03", "pass2_title_day")
    assert got["05"] == ("06", "pass3_title_prefix")
    assert got["08"] == ("07", "pass4_cross_source_2d") and "09" not in got
    assert got["10"] == ("11", "pass5_venue_or_contains")
    assert got["12"] == ("13", "pass6_venue_day_cross_source")
    assert {"14", "15"} & set(got) and {"16", "17"} & set(got)
    assert "18" not in got and "19" not in got


def test_absorb_fills_logs_and_repoints(spark):
    rows = [
        event("a", "t", poster_url="p", created_at=dt.datetime(2026, 1, 5)),
        event("b", "t", genre="콘서트", sites=("melon",), created_at=dt.datetime(2026, 1, 1)),
        event("c", "t", genre="축제", booking_url="u", age_restriction="12", created_at=dt.datetime(2026, 1, 3)),
        event("d", "other"),
    ]
    df = spark.createDataFrame(rows, EVENT)
    mapping = spark.createDataFrame([("b", "a", "p"), ("c", "a", "p")], "old_id string, keep_id string, pass_name string")
    result = ME.absorb(df, mapping)
    kept = {r.id: r for r in result.events.collect()}
    assert set(kept) == {"a", "d"}
    assert kept["a"].genre == "축제" and kept["a"].booking_url == "u" and kept["a"].poster_url == "p"
    assert kept["a"].created_at == dt.datetime(2026, 1, 1) and {u.site for u in kept["a"].source_urls} == {"yes24", "melon"}
    log = {r.merged_event_id: r for r in result.log.collect()}
    assert set(log["b"].transferred_fields) == {"genre", "age_restriction", "booking_url"} and '"genre":"콘서트"' in log["b"].snapshot
    likes = spark.createDataFrame([("u1", "a", 1), ("u1", "b", 2), ("u2", "c", 3), ("u3", "d", 4)], "user_id string, event_id string, n int")
    books = spark.createDataFrame([("u1", "b"), ("u1", "a")], "user_id string, event_id string")
    acts = spark.createDataFrame([("b", "x"), ("a", "x")], "event_id string, artist_id string")
    out = ME.repoint_user_data({"user_interested_events": likes, "user_bookings": books, "event_artists": acts}, mapping)
    assert sorted(tuple(r) for r in out["user_interested_events"].collect()) == [("u1", "a", 1), ("u2", "a", 3), ("u3", "d", 4)]
    assert sorted(tuple(r) for r in out["user_bookings"].collect()) == [("u1", "a"), ("u1", "a")]
    assert [tuple(r) for r in out["event_artists"].collect()] == [("a", "x")]


def test_auto_merge_is_idempotent(spark):
    rows = [event(f"{i:02d}", t, d, venue_id="v") for i, (t, d) in enumerate(
        [("봄 콘서트", "2026-03-01"), ("[서울] 봄 콘서트", "2026-03-01"), ("봄 콘서트", "2026-03-09"), ("가을 밤", "2026-03-01")])]
    venues = spark.createDataFrame([("v", "세종홀")], "id string, normalized_name string")
    df = spark.createDataFrame(rows, EVENT)
    first = ME.auto_merge(df, venues)
    assert first.events.count() == 3
    again = ME.auto_merge(first.events, venues)
    assert again.events.count() == 3 and again.mapping.isEmpty()
    assert ME.stale_keys(first.events, venues).count() == 3


ARTIST = (
    "id string, name string, normalized_name string, name_en string, avatar_url string, occupation string, "
    "birth_date string, birth_place string, related string, label string, country string, followers_count int, "
    "sns_links map<string,string>, name_proposal string, gemini_canon string, created_at timestamp"
)


def artist(id, name, followers=0, **v):
    cols = [c.split()[0] for c in ARTIST.replace("map<string,string>", "x").split(", ")]
    row = dict.fromkeys(cols) | {"id": id, "name": name, "followers_count": followers, "created_at": dt.datetime(2026, 1, 1)} | v
    return tuple(row[c] for c in cols)


def test_artist_candidates_and_merge(spark):
    rows = [
        artist("1", "SHINee", 5, label="SM"), artist("2", "Shinee!", 7, country="KR", sns_links={"x": "b", "y": "c"}),
        artist("3", "CHOI YU REE 최유리"), artist("4", "최유리", sns_links={"x": "a"}), artist("5", "샤이니"),
        artist("6", "NEMOPHILA(JP)"), artist("7", "NEMOPHILA"), artist("8", "Aurora(KR)"), artist("9", "Aurora(NO)"),
        artist("10", "Aurora"), artist("11", "찰리 푸스", gemini_canon="charlieputh"), artist("12", "Charlie Puth", gemini_canon="charlieputh"),
    ]
    artists = spark.createDataFrame(rows, ARTIST)
    linked = spark.createDataFrame([("2", 3), ("1", 1), ("6", 2)], "artist_id string, linked_event_count long")
    aliases = spark.createDataFrame([("2", "샤이니", "x"), ("1", "shinee five", None)], "artist_id string, alias string, source string")
    assert {(r.id, r.suggested_keep_id) for r in MA.exact_groups(artists, linked).collect()} == {("1", "2"), ("2", "2")}
    pairs = {(r.id_a, r.id_b): r.reason for r in MA.duplicate_pairs(artists, aliases).collect()}
    assert pairs["2", "5"] == "alias_match" and pairs["6", "7"] == "name_contains"
    assert mapped(MA.annotation_mapping(artists, linked)) == {"7": "6"}
    events = spark.createDataFrame([("e", "12")], "id string, artist_id string")
    assert mapped(MA.canonical_mapping(artists, events)) == {"11": "12"}
    mapping = MA.exact_mapping(artists, linked)
    follows = spark.createDataFrame([("u", "1"), ("u", "2"), ("w", "1")], "user_id string, artist_id string")
    out = MA.merge_artists(artists, mapping, {"user_artist_followings": follows, "events": events}, aliases)
    kept = {r.id: r for r in out["artists"].collect()}
    assert "1" not in kept and kept["2"].followers_count == 12 and kept["2"].label == "SM"
    assert sorted(tuple(r) for r in out["user_artist_followings"].collect()) == [("u", "2"), ("w", "2")]
    got = {(r.artist_id, r.alias) for r in out["artist_aliases"].collect()}
    assert got == {("2", "샤이니"), ("2", "SHINee"), ("2", "shinee five")}
    split = {r.id: r.parts for r in MA.joined_records(spark.createDataFrame([artist("z", "선우정아 X 적재")], ARTIST)).collect()}
    assert split == {"z": ["선우정아", "적재"]}


def test_proposals(spark):
    artists = spark.createDataFrame(
        [artist("1", "지코(Zico)", name_proposal="지코"), artist("2", "아이유"), artist("3", "IU", name_proposal="아이유"), artist("4", "x", name_proposal="y")], ARTIST)
    aliases = spark.createDataFrame([], "artist_id string, alias string, source string")
    todo = spark.createDataFrame(
        [("1", "approve", "Zico", ["Z"]), ("3", "approve", None, None), ("4", "reject", None, None)],
        "id string, action string, name_en string, aliases array<string>")
    state, names, conflicts = MA.apply_proposals(artists, todo, aliases)
    got = {r.id: (r.name, r.name_proposal) for r in state.collect()}
    assert got == {"1": ("지코", None), "2": ("아이유", None), "3": ("IU", "아이유"), "4": ("x", None)}
    assert {(r.artist_id, r.alias) for r in names.collect()} == {("1", "지코(Zico)"), ("1", "Zico"), ("1", "Z")}
    assert [(r.id, r.other_id) for r in conflicts.collect()] == [("3", "2")]


def test_venues(spark):
    schema = "id string, name string, normalized_name string, address string, phone_number string"
    rows = [
        ("1", "올림픽공원 체조경기장", "올림픽공원체조경기장", None, None), ("2", "올림픽공원 체조경기장", "올림픽공원체조경기장", None, "02"),
        ("3", "KSPO DOME", None, None, None), ("4", "KSPO DOME (올림픽체조경기장)", None, None, None), ("5", "전혀다른곳", None, None, None),
    ]
    venues = spark.createDataFrame(rows, schema)
    counts = spark.createDataFrame([("1", 5), ("2", 1), ("3", 3)], "venue_id string, linked_event_count long")
    pairs = {(r.id_a, r.id_b): (r.reason, r.suggested_keep_id) for r in MV.suggested_keep(MV.candidate_pairs(venues), counts).collect()}
    assert pairs["1", "2"] == ("exact_normalized", "1") and pairs["3", "4"][1] == "3"
    assert not any("5" in k for k in pairs)
    mapping, held = MV.exact_merge(venues, counts)
    assert mapped(mapping) == {"2": "1"} and held.isEmpty()
    far = spark.createDataFrame([("1", "홀", "홀", "서울 1", None), ("2", "홀", "홀", "부산 2", None)], schema)
    mapping2, held2 = MV.exact_merge(far, counts)
    assert mapping2.isEmpty() and held2.count() == 1
    events = spark.createDataFrame([("e1", "2"), ("e2", "1")], "id string, venue_id string")
    links = spark.createDataFrame([("e1", "2", 0), ("e1", "1", 1)], "event_id string, venue_id string, display_order int")
    out = MV.merge_venues(venues, mapping, events, links)
    assert {r.id: r.phone_number for r in out["venues"].collect()}["1"] == "02"
    assert {r.venue_id for r in out["events"].collect()} == {"1"}
    assert [tuple(r) for r in out["event_venues"].collect()] == [("e1", "1", 1)]
    dirty = spark.createDataFrame(
        [("1", "홍대 롤링홀예매하기 x"), ("2", "x예매하기"), ("3", "킨텍스 제1전시장"), ("4", "VIP 110,000원"), ("5", "홍대 롤링홀"), ("6", "홍대 롤링홀")],
        "id string, name string")
    plan = MV.cleanup_plan(dirty, counts)
    got = {r.id: (r.action, r.target_name, r.target_id) for r in plan.collect()}
    assert got == {
        "1": ("relink", "홍대 롤링홀", None), "2": ("relink", None, None), "3": ("merge_hall", "킨텍스", None),
        "4": ("drop", None, None), "6": ("merge_exact", None, "5"),
    }
    events = spark.createDataFrame([(f"e{i}", str(i)) for i in range(1, 7)], "id string, venue_id string")
    links = spark.createDataFrame([(f"e{i}", str(i)) for i in range(1, 7)], "event_id string, venue_id string")
    out = MV.apply_cleanup(dirty, plan, events, links)
    got = {r.id: r.venue_id for r in out["events"].collect()}
    assert got["e1"] == "5" and got["e2"] is None and got["e4"] is None and got["e6"] == "5"
    assert {r.name for r in out["venues"].collect()} == {"홍대 롤링홀", "킨텍스"}


def test_user_rows_reach_the_last_survivor(spark, monkeypatch):
    """A is absorbed by B, B by C in a later step: what pointed at A or B points at C."""
    from .fixtures import EVENTS, event

    df = spark.createDataFrame([event(x, "t", "2026-08-01") for x in "abc"], EVENTS)
    maps = "old_id string, keep_id string, pass_name string"
    one, two = spark.createDataFrame([("a", "b", "strong_key")], maps), spark.createDataFrame([("b", "c", "title_day")], maps)
    monkeypatch.setattr(ME, "collapse_by_strong_key", lambda events, venues: ME.absorb(events, one))
    monkeypatch.setattr(ME, "pass_mapping", lambda events: two)
    merged = ME.auto_merge(df, None)
    assert [r.id for r in merged.events.collect()] == ["c"]
    assert sorted(tuple(r) for r in merged.mapping.select("old_id", "keep_id", "pass_name").collect()) == [("a", "c", "strong_key"), ("b", "c", "title_day")]
    children = {"user_interested_events": spark.createDataFrame([("u1", "a"), ("u2", "b"), ("u2", "c")], "user_id string, event_id string")}
    moved = ME.repoint_user_data(children, merged.mapping)["user_interested_events"].collect()
    assert sorted(tuple(r) for r in moved) == [("u1", "c"), ("u2", "c")]


def test_a_cycle_is_an_error(spark):
    import pytest

    from marquee.operators.cluster import resolve_chains

    with pytest.raises(ValueError, match="cycle"):
        resolve_chains(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "old_id string, keep_id string"))
