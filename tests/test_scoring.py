import bisect
import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from marquee.functions import fixed_values as V
from marquee.operators import engagement as E
from marquee.operators import listing as LS
from marquee.operators import recommend_artists as RA
from marquee.operators import recommend_events as RE
from marquee.operators import scoring as S
from marquee.plans import recommend_queries as RQ
from marquee.plans.roles import AS_OF, Roles

NOW = "2026-07-01T00:00:00"


def test_weights_sum_to_one():
    for signals in (V.ARTIST_SIGNALS, V.EVENT_SIGNALS):
        assert math.isclose(sum(w for _, w, _ in S.renormalised_weights(signals)), 1.0)
    assert math.isclose(sum(V.HOMEPAGE_WEIGHTS.values()), 1.0)
    assert math.isclose(sum(V.RECOMMENDATION_WEIGHTS.values()), 1.0)


def test_strictly_below(spark):
    rng = random.Random(4)
    values = [float(rng.choice([0, 0, 0, 1, 2, 5, 7, 1e3, 1e3 + 0.5, 1e6, 3e9])) for _ in range(300)]
    df = spark.createDataFrame([("k", v) for v in values] + [("other", 9.0)], "key string, value double")
    ordered = sorted(values)
    got = {r.value: r.n_below for r in S.strictly_below(df).filter("key = 'k'").collect()}
    assert got == {v: bisect.bisect_left(ordered, v) for v in set(values)}


@pytest.mark.parametrize("n", [19, 20])
def test_method_switches_with_population(spark, n):
    rows = [(str(i), "followers_count", float(i // 2)) for i in range(n)] + [(str(i), "review_avg", 2.5) for i in range(n)]
    got = {(r.id, r.key): r for r in S.normalise_signals(spark.createDataFrame(rows, "id string, key string, value double")).collect()}
    top = got[str(n - 1), "followers_count"]
    if n < 20:
        assert top.method == "log_min_max" and top.low_confidence and top.normalized == 100.0
    else:
        assert top.method == "percentile" and not top.low_confidence and top.normalized == 18 / 20 * 100
    assert got["0", "followers_count"].normalized == 0
    assert got["0", "review_avg"].normalized == 50 and got["0", "review_avg"].method == "min_max"


def test_breakdown(spark):
    artists = spark.createDataFrame([(str(i), i, 0) for i in range(25)], "id string, followers_count int, upcoming_event_count int")
    empty = lambda s: spark.createDataFrame([], s)
    engagement = E.artist_engagement(
        artists, empty("user_id string, artist_id string"), empty("event_id string, artist_id string"),
        empty("user_id string, event_id string"), empty("event_id string, star_count int"),
    )
    best = S.artist_popularity(artists, engagement, NOW).filter("id = '24'").first()
    assert best.popularity_score == 19.2 and not best.low_confidence
    first = best.score_breakdown.signals[0]
    assert (first.key, first.raw, first.normalized, first.contribution) == ("followers_count", 24.0, 96.0, 19.2)
    assert first.reason == "팔로워 수 상위 4% (24)"


def test_trending_edges(spark):
    day = lambda d: dt.datetime(2026, 7, 1) - dt.timedelta(days=d)
    rows = [
        ("artist", "one", 5.0, day(1)), ("artist", "old", 5.0, day(20)), ("artist", "old", 5.0, day(21)),
        ("artist", "up", 10.0, day(20)), ("artist", "up", 30.0, day(1)), ("artist", "nulls", None, day(1)), ("artist", "nulls", None, day(2)),
        ("artist", "gone", 5.0, day(40)),
    ]
    df = spark.createDataFrame(rows, "entity_type string, entity_id string, popularity_score double, captured_at timestamp")
    got = {r.entity_id: (r.trending_score, r.cold_start) for r in S.trending(df, NOW).collect()}
    assert got == {"one": (0.0, True), "old": (0.0, False), "up": (150.0, False), "nulls": (0.0, False)}


def test_apply_scores_keeps_what_the_patch_lacks(spark):
    base = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "id string, p double, t double")
    patch = spark.createDataFrame([("a", None, 9.0)], "id string, p double, t double")
    assert sorted(tuple(r) for r in S.apply_scores(base, patch, ["p", "t"]).collect()) == [("a", 1.0, 9.0), ("b", 3.0, 4.0)]


def test_signal_providers_merge(spark):
    a = spark.createDataFrame([("1", {"x": 1.0, "y": 1.0})], "entity_id string, signals map<string,double>")
    b = spark.createDataFrame([("1", {"y": 2.0}), ("2", {"z": 3.0})], "entity_id string, signals map<string,double>")
    got = {r.entity_id: r.signals for r in E.merge_signals(a, b).collect()}
    assert got == {"1": {"x": 1.0, "y": 2.0}, "2": {"z": 3.0}}


def test_artist_recommendations_do_not_depend_on_the_route(spark, sf_dir):
    """Treating some or all events as too large to spell out must not change any list."""
    r = Roles(spark, sf_dir)
    genres = E.genre_profile(r.event_artists, r.events, r.performances)
    lists = []
    for hot in (200, 1, 0):
        recs = RA.artist_recommendations(r.followings, RQ.rated_artists(r), r.event_artists, genres, 5, hot_lineup=hot)
        lists.append(sorted((x.user_id, x["rank"], x.artist_id, x.name, x.score, x.co_performer, tuple(x.reasons)) for x in recs.collect()))
    assert lists[0] and lists[0] == lists[1] == lists[2]


def test_artist_views(spark, sf_dir):
    r = Roles(spark, sf_dir)
    genres = E.genre_profile(r.event_artists, r.events, r.performances)
    recs = RA.artist_recommendations(r.followings, RQ.rated_artists(r), r.event_artists, genres, 5)
    assert RA.public_view(recs).columns == ["user_id", "rank", "artist_id", "name", "reasons"]


def test_event_recommendation_pages(spark, sf_dir):
    r = Roles(spark, sf_dir)
    users = r.table("customer").select(F.col("c_custkey").alias("id"))
    args = (users, RQ.rated_events(r), r.event_artists, RQ.rated_artists(r), r.followings, r.interested, r.bookings, AS_OF)
    key = lambda x: (x.user_id, x["rank"], x.event_id, x.final_score)
    whole = sorted(key(x) for x in RE.event_recommendations(*args, limit=6).collect())
    late = sorted(key(x) for x in RE.event_recommendations(*args, limit=3, offset=3).collect())
    assert late == [x for x in whole if x[1] > 3]
    first = RE.event_recommendations(*args, limit=1).first()
    assert first.has_more and len(first.reasons) >= 1


def test_listing(spark):
    df = spark.createDataFrame([(i, f"t{i % 3}", None if i % 4 else "x", i % 2 == 0) for i in range(25)], "id int, title string, genre string, is_hidden boolean")
    df = df.withColumn("merged_into_event_id", F.lit(None).cast("string"))
    rows, meta = LS.list_entities(df, filters=[LS.is_active()], missing="genre", missing_allowed=["genre"], duplicates_of="title", ascending=True, page=1, page_size=7)
    assert meta.first().asDict() == {"page": 1, "page_size": 20, "total": 12, "total_pages": 1}
    assert [r.id for r in rows.collect()] == [i for i in range(25) if i % 2 and i % 4]
    assert LS.total_pages(0, 20) == 1 and LS.clamp_page_size(50) == 50
    top = LS.top_ranked(df, [("title", False)], "id", 2).collect()
    assert [(r["rank"], r.id) for r in top] == [(1, 2), (2, 5)]
    assert df.filter(LS.matches_text(["title", "genre"], "T1")).count() == 8
    assert df.filter(LS.status_filter("x", True, ["ended"])).count() == 25
