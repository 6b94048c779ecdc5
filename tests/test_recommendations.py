"""Lists that leave out what cannot reach them must equal those that score every pair."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from marquee.operators import recommend_artists as RA
from marquee.operators import recommend_events as RE
from marquee.session import cut_lineage

NOW = "2026-07-01T00:00:00"
EVENT_COLUMNS = "id long, title string, genre string, status string, start_date date, end_date date, popularity_score double, trending_score double"


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}


def test_shuffle_files_go_when_a_table_is_written(spark):
    """They stayed until the driver's next garbage collection, all steps of a query at once."""
    before = shuffle_files(spark)
    table = cut_lineage(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count())
    assert not shuffle_files(spark) - before
    assert sorted(r["count"] for r in table.collect()) == [100] * 10


def event_case(seed):
    rng = random.Random(seed)
    day = dt.date(2026, 7, 1)
    events = [
        (i, f"t{i}", rng.choice(["a", "b", "c", "d", None]), "on_sale", day + dt.timedelta(days=rng.randrange(200)), dt.date(2027, 12, 1),
         float(rng.randrange(1000)) / 10, float(rng.randrange(2500)) / 10)
        for i in range(200)
    ]
    lineup = sorted({(e, a) for e in range(200) for a in rng.sample(range(40), rng.choice([0, 1, 1, 2, 3, 7]))})
    lineup = [(e, a, f" Act{a} ", rng.randrange(5)) for e, a in lineup]
    artists = [(a, f"Act{a}", f"act{(a + 1) % 40} / ACT{(a + 7) % 40}" if a % 5 else None) for a in range(40)]
    users = list(range(30))
    follows = sorted({(rng.randrange(25), rng.randrange(40)) for _ in range(80)})
    seen = sorted({(rng.randrange(5, 30), rng.randrange(200)) for _ in range(120)})
    return users, events, lineup, artists, follows, seen[:60], seen[40:]


def frames(table, case, *more):
    users, events, lineup, artists, follows, interested, bookings = case
    pairs = "user_id long, event_id long"
    return (
        table([(u,) for u in users], "id long"), table(events, EVENT_COLUMNS),
        table(lineup, "event_id long, artist_id long, artist_name string, display_order int"), table(artists, "id long, name string, related string"),
        table(follows, "user_id long, artist_id long"), table(interested, pairs), table(bookings, pairs), NOW, *more,
    )


def event_lists(case, depth):
    """Every user with every event."""
    users, events, lineup, artists, follows, interested, bookings = case
    clamp = lambda x: min(max(x, 0.0), 1.0)
    genre_of, out = {e[0]: e[2] for e in events}, {}
    for u in users:
        followed = {a for x, a in follows if x == u}
        seen = {e for x, e in [*interested, *bookings] if x == u}
        liked = {genre_of[e] for e in seen} - {None}
        known = {a for e, a, *_ in lineup if e in seen}
        near = {n.strip().lower() for a, _, r in artists if a in followed and r for n in r.split("/")}
        rows = []
        for e, _, genre, _, start, _, pop, trend in events:
            acts = [x for x in lineup if x[0] == e]
            mine = [x for x in acts if x[1] in followed]
            head = mine and min(x[3] for x in mine) == min(x[3] for x in acts)
            favorite = clamp((0.7 if head else 0.5) + (0.3 * len(mine)) / max(1, len(acts))) if mine else 0.0
            similar = clamp((0.6 if genre in liked else 0.0) + (0.4 if near & {x[2].strip().lower() for x in acts} else 0.0))
            behavior = clamp((0.5 if genre in liked else 0.0) + (0.5 if known & {x[1] for x in acts} else 0.0))
            rec = clamp(0.47 * favorite + 0.29 * similar + 0.24 * behavior)
            days = (start - dt.date(2026, 7, 1)).days
            fresh = next((f for d, f in [(14, 1.0), (30, 0.8), (60, 0.65), (90, 0.5), (180, 0.35)] if days <= d), 0.2)
            final = 0.45 * clamp(pop / 100) + 0.25 * clamp(trend / 200) + 0.2 * rec + 0.1 * fresh
            rows.append((-math.floor(final * 10000 + 0.5) / 10000, e))
        out |= {(u, i): (e, -s) for i, (s, e) in enumerate(sorted(rows)[:depth], 1)}
    return out


def test_event_lists_equal_those_of_all_pairs(spark, table):
    for seed, depth in ((1, 4), (2, 9)):
        case = event_case(seed)
        want = event_lists(case, depth)
        for small in (50, 1, 0):
            recs = RE.event_recommendations(*frames(table, case, depth), small_lineup=small)
            assert {(r.user_id, r["rank"]): (r.event_id, r.final_score) for r in recs.collect()} == want


def test_users_without_id_or_row_keep_their_lists(table):
    """Links of users who are in no table of users, or have no id, are listed as before; only links, with few events."""
    users, events, lineup, artists, _, _, _ = event_case(3)
    case = users[:2], events[:40], lineup, artists, [(0, 3), (77, 3), (None, 3)], [(77, 5), (None, 5)], []
    lists = [
        sorted((r.user_id is None, r.user_id or 0, r["rank"], r.event_id, r.final_score, r.behavior_match) for r in
               RE.event_recommendations(*frames(table, case, 60), small_lineup=small).collect())
        for small in (50, 0)
    ]
    assert lists[0] == lists[1] and {x[:2] for x in lists[0]} == {(False, 0), (False, 1), (False, 77), (True, 0)}
    linked = {e for e, a, *_ in lineup if e < 40 and a == 3}
    known = {a for e, a, *_ in lineup if e == 5}
    linked |= {e for e, a, *_ in lineup if e < 40 and a in known} | {e for e, _, n, _ in lineup if e < 40 and n.strip().lower() in ("act4", "act10")}
    assert {x[3] for x in lists[0] if x[0]} >= linked and all(x[5] in (0.0, 0.5) for x in lists[0] if x[0])


def artist_case(seed):
    rng = random.Random(seed)
    artists = [(a, f"Act{a}", rng.choice(["L1", "L2", "L3", "L4", " L1", "", None]), float(rng.randrange(6))) for a in range(60)]
    lineup = sorted({(e, a) for e in range(40) for a in rng.sample(range(60), rng.choice([1, 2, 2, 3, 5, 12]))})
    genres = sorted({(rng.randrange(60), rng.choice("abcdef")) for _ in range(150)})
    follows = sorted({(rng.randrange(25), rng.randrange(60)) for _ in range(90)})
    return artists, lineup, genres, [*follows, (7, None), (None, 3)]


def artist_lists(case, limit):
    """Every user with every artist."""
    artists, lineup, genres, follows = case
    label_of, out = {a: l for a, _, l, _ in artists}, {}
    for u in {u for u, _ in follows} - {None}:
        followed = {a for x, a in follows if x == u}
        labels = {label_of[a].strip() for a in followed - {None} if label_of[a]} - {""}
        liked = {g for a, g in genres if a in followed}
        seen = {e for e, a in lineup if a in followed}
        rows = []
        for a, _, label, popularity in artists:
            shared = len({e for e, x in lineup if x == a and e in seen})
            co = min(0.5 + 0.5 * (shared - 1) / 3, 1.0) if shared else 0.0
            ge = len(liked & {g for x, g in genres if x == a}) / max(1, len(liked))
            score = min(0.4 * co + 0.3 * (1 if label and label in labels else 0) + 0.3 * ge, 1.0)
            if a not in followed and score > 0:
                rows.append((-math.floor(score * 10000 + 0.5) / 10000, -popularity, a))
        out |= {(u, i): (a, -s) for i, (s, _, a) in enumerate(sorted(rows)[:limit], 1)}
    return out


def test_artist_lists_equal_those_of_all_pairs(table, monkeypatch):
    """Also whichever events are spelled out. No table of all events that users have seen is written any more."""
    written, cut = [], RA.cut_lineage
    monkeypatch.setattr(RA, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    for seed, limit, routes in ((1, 3, [(200, 8), (200, 0)]), (2, 8, [(200, 2), (4, 2), (0, 0)])):
        case = artist_case(seed)
        artists, lineup, genres, follows = case
        want = artist_lists(case, limit)
        for hot, small in routes:
            recs = RA.artist_recommendations(
                table(follows, "user_id long, artist_id long"), table(artists, "id long, name string, label string, popularity_score double"),
                table(lineup, "event_id long, artist_id long"), table(genres, "artist_id long, genre string"), limit, hot, small)
            rows = recs.collect()
            assert {(r.user_id, r["rank"]): (r.artist_id, r.score) for r in rows} == want
            for r in rows:
                with_name = [x for x in r.reasons if "같은 무대" in x]
                stages = [e for e, a in lineup if a == r.artist_id and any((r.user_id, x) in follows for y, x in lineup if y == e)]
                first = stages and min(x for y, x in lineup if y == min(stages) and (r.user_id, x) in follows)
                assert with_name == ([f"회원님이 팔로우한 Act{first}와 같은 무대에 섰어요"] if stages else [])
        if (hot, small) == (200, 0):
            assert sum("followed_id" in columns for columns in written) == len(routes)
