"""Events for every user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from ..functions.dates import at, freshness_norm
from ..functions.maths import clamp01, round0, round2, round4, trending_norm
from ..session import cut_lineage
from .listing import has_more, top_per_group, top_ranked

_H, _R = V.HOMEPAGE_WEIGHTS, V.RECOMMENDATION_WEIGHTS
_GENRE, _RELATED, _ALIKE, _VISITED = 0.6, 0.4, 0.5, 0.5
# Up to this many acts, a followed event's acts are compared with the user's in its row; links to larger events
# are all spelled out.
SMALL_LINEUP = 50


def open_events(events: DataFrame, as_of: str) -> DataFrame:
    """Events on sale or upcoming that are not over."""
    live = F.col("status").isin("on_sale", "upcoming") & (F.col("end_date").cast("date") >= F.lit(as_of[:10]).cast("date"))
    return events.filter(live)


def _final(recommendation: Column) -> Column:
    return round4(
        _H["popularity"] * F.col("popularity") + _H["trending"] * F.col("trending")
        + _H["recommendation"] * recommendation + _H["freshness"] * F.col("freshness")
    )


def _recommendation(favorite: Column, similar: Column, behavior: Column) -> Column:
    return clamp01(_R["favorite"] * favorite + _R["similar"] * similar + _R["behavior"] * behavior)


def _at_most(favorite: float, related: bool) -> Column:
    """The final score of an event whose genre and acts the user knows."""
    similar = clamp01(F.lit(_GENRE) + F.lit(_RELATED if related else 0.0))
    return _final(_recommendation(F.lit(favorite), similar, clamp01(F.lit(_ALIKE) + F.lit(_VISITED))))


def _all_of(c: str) -> Column:
    return F.array_distinct(F.flatten(F.collect_list(c)))


def user_rows(
    users: DataFrame, followings: DataFrame, artists: DataFrame, behavior: DataFrame, events: DataFrame, lineups: DataFrame
) -> DataFrame:
    """(user_id, member, liked, known, follows, related): genres and acts of events seen, acts followed and names related to them.

    One row for everybody who has any of these. Visits meet their events once and go to their users once.
    """
    genre = events.select(F.col("id").alias("event_id"), "genre").filter(T.or_empty("genre") != "")
    seen = genre.join(lineups.select("event_id", F.col("acts").alias("known")), "event_id", "full")
    names = artists.select(F.col("id").alias("artist_id"), F.explode(T.related_names("related")).alias("n"))
    names = names.groupBy("artist_id").agg(F.collect_set("n").alias("related"))
    rows = users.select(F.col("id").alias("user_id"), F.lit(True).alias("member"))
    rows = rows.unionByName(behavior.join(seen, "event_id").select("user_id", "genre", "known"), allowMissingColumns=True)
    rows = rows.unionByName(
        followings.select("user_id", "artist_id").join(names, "artist_id", "left").select("user_id", "artist_id", "related"),
        allowMissingColumns=True,
    )
    return rows.repartition("user_id").groupBy("user_id").agg(
        F.coalesce(F.max("member"), F.lit(False)).alias("member"), F.array_sort(F.collect_set("genre")).alias("liked"),
        _all_of("known").alias("known"), F.collect_set("artist_id").alias("follows"), _all_of("related").alias("related"),
    )


def event_recommendations(
    users: DataFrame,
    events: DataFrame,
    event_artists: DataFrame,
    artists: DataFrame,
    followings: DataFrame,
    interested: DataFrame,
    bookings: DataFrame,
    as_of: str,
    limit: int,
    offset: int = 0,
    small_lineup: int = SMALL_LINEUP,
) -> DataFrame:
    """(user_id, rank, event_id, final_score, parts, reasons, has_more) for all users.

    Scoring every user with every event is not needed. Without a link to one of the user's artists
    an event's score is the same for everybody who likes the same genres; so these users share one list,
    and the score of its last event is their bar. A link is looked at only if the event could reach the
    bar: through followed acts almost any event can, through visited acts alone only the best. Parts that a
    kept pair has through links that were not looked at are taken from the acts of the event and of the
    user; ``small_lineup`` decides for which events, so about the plan only. Scores are compared as shown,
    with four digits.
    """
    depth = limit + offset
    candidates = open_events(events, as_of).select(
        F.col("id").alias("event_id"), "title", "genre",
        clamp01(F.coalesce("popularity_score", F.lit(0.0)) / 100).alias("popularity"),
        trending_norm(F.col("trending_score")).alias("trending"),
        F.coalesce("trending_score", F.lit(0.0)).alias("trending_score"),
        freshness_norm(F.col("start_date"), at(as_of)).alias("freshness"),
    )
    of_genre = _final(_recommendation(F.lit(0.0), clamp01(F.lit(_GENRE)), clamp01(F.lit(_ALIKE))))
    candidates = cut_lineage(candidates.withColumn("base", _final(F.lit(0.0))).withColumn("genre_base", of_genre))
    act = F.lower(T.strip("artist_name"))
    lineup = cut_lineage(event_artists.select("event_id", "artist_id", act.alias("n"), "artist_name", "display_order").distinct())
    lineups = cut_lineage(lineup.groupBy("event_id").agg(
        F.min("display_order").alias("first"), F.count("*").alias("n_acts"),
        F.collect_set("artist_id").alias("acts"), F.collect_set("n").alias("act_names"),
    ))
    behavior = interested.select("user_id", "event_id").unionByName(bookings.select("user_id", "event_id"))
    of_users = cut_lineage(user_rows(users, followings, artists, behavior, events, lineups))

    # one list and bar for all who like the same genres; a user without an id likes none
    best = cut_lineage(top_ranked(candidates, [("base", False)], "event_id", depth).select("genre", "event_id", "base", "genre_base"))
    by_genre = top_per_group(candidates.filter(F.col("genre").isNotNull()), ["genre"], [("genre_base", False)], "event_id", depth)
    by_genre = by_genre.select("genre", "event_id", "base", "genre_base")
    known = F.col("user_id").isNotNull().alias("known_user")
    taste = ["member", "known_user", "liked"]
    tastes = of_users.select("member", known, "liked").distinct()
    score = F.when(F.col("known_user") & F.array_contains("liked", F.col("genre")), F.col("genre_base")).otherwise(F.col("base"))
    listed = tastes.filter("member").crossJoin(F.broadcast(best)).select(*taste, "event_id", score.alias("score"))
    listed = listed.unionByName(
        tastes.select(*taste, F.explode("liked").alias("genre")).join(by_genre, "genre").select(*taste, "event_id", score.alias("score"))
    )
    listed = listed.groupBy(*taste, "event_id").agg(F.max("score").alias("score"))
    listed = cut_lineage(top_per_group(listed, taste, [("score", False)], "event_id", depth).groupBy(*taste).agg(
        F.collect_list("event_id").alias("listed"),
        F.when((F.count("*") >= depth) & F.first("known_user"), F.min("score")).otherwise(0.0).alias("bar"),
    ))
    of_users = of_users.withColumn("known_user", F.col("user_id").isNotNull()).join(listed, taste, "left").drop("known_user")
    of_users = cut_lineage(of_users.withColumn("bar", F.coalesce("bar", F.lit(0.0))))

    # links to events that could still enter a list
    bar = best.agg(F.when(F.count("*") >= depth, F.min("base")).otherwise(0.0)).scalar()
    reach = candidates.groupBy("event_id").agg(
        F.max(_at_most(1.0, True)).alias("up_followed"), F.max(_at_most(0.0, True)).alias("up_related"),
        F.max(_at_most(0.0, False)).alias("up_visited"),
    ).filter(F.col("up_followed") >= bar)
    small = F.col("n_acts") <= small_lineup
    reach = reach.join(lineups.select("event_id", "n_acts"), "event_id").select(
        "event_id", "up_followed", *[F.when(small, F.col(c)).otherwise(F.col("up_followed")).alias(c) for c in ["up_related", "up_visited"]])
    acts = cut_lineage(lineup.join(reach, "event_id"))
    lowest = of_users.agg(F.min("bar")).scalar()
    no_billing = F.lit(None).cast("long").alias("display_order")

    def links(kind: str, held: str, key: str, billing: Column = no_billing) -> DataFrame:
        up = F.col(f"up_{kind}")
        linked = acts.filter(up >= lowest).select(key, "event_id", billing, up)
        if kind != "followed":
            linked = linked.distinct()
        asked = of_users.select("user_id", "bar", F.explode(held).alias(key))
        return asked.join(linked, key).filter(up >= F.col("bar")).select("user_id", "event_id", F.lit(kind).alias("kind"), "display_order")

    pairs = links("followed", "follows", "artist_id", F.col("display_order").cast("long").alias("display_order"))
    pairs = pairs.unionByName(links("visited", "known", "artist_id")).unionByName(links("related", "related", "n"))
    # lists and links are rows of the same grouping, so that each pair is shuffled once
    pairs = pairs.unionByName(of_users.select("user_id", F.explode("listed").alias("event_id"), F.lit("listed").alias("kind"), no_billing))
    pairs = pairs.groupBy("user_id", "event_id").agg(
        F.count_if(F.col("kind") == "followed").alias("n_followed"), F.min("display_order").alias("best_billing"),
        F.max(F.col("kind") == "visited").alias("artist_hit"), F.max(F.col("kind") == "related").alias("related_hit"),
    )

    n_followed = F.col("n_followed")
    unseen = small & ((n_followed > 0) | F.col("related_hit")) & ~F.col("artist_hit")
    unrelated = small & (n_followed > 0) & ~F.col("related_hit")
    lines = pairs.join(candidates, "event_id").join(lineups, "event_id", "left").withColumns({
        "acts": F.when(unseen, F.col("acts")), "act_names": F.when(unrelated, F.col("act_names"))})
    yes = lambda c: F.coalesce(c, F.lit(False))
    rows = lines.join(of_users.select("user_id", "liked", "known", "related"), "user_id", "left").withColumns({
        "genre_hit": yes(F.array_contains("liked", F.col("genre"))),
        "artist_hit": F.col("artist_hit") | yes(F.arrays_overlap("acts", "known")),
        "related_hit": F.col("related_hit") | yes(F.arrays_overlap("act_names", "related")),
    }).drop("liked", "known", "related", "acts", "act_names")
    headliner = F.col("best_billing") == F.col("first")
    favorite = F.when(
        n_followed > 0,
        clamp01(F.when(headliner, 0.7).otherwise(0.5) + (0.3 * n_followed) / F.greatest(F.lit(1), F.col("n_acts"))),
    ).otherwise(F.lit(0.0))
    hit = lambda c, part: F.when(F.col(c), part).otherwise(0.0)
    similar = clamp01(hit("genre_hit", _GENRE) + hit("related_hit", _RELATED))
    visits = clamp01(hit("genre_hit", _ALIKE) + hit("artist_hit", _VISITED))
    rows = rows.withColumns({"favorite": favorite, "similar": similar, "behavior": visits})
    rows = rows.withColumn(
        "recommendation", _recommendation(F.col("favorite"), F.col("similar"), F.col("behavior"))
    ).withColumn("final_score", _final(F.col("recommendation")))
    page = top_per_group(rows, ["user_id"], [("final_score", False)], "event_id", depth)
    page = page.filter(F.col("rank") > offset)
    n_open = candidates.agg(F.count("*")).scalar()
    hot = F.col("trending_score") > 110
    alike = (n_followed == 0) & (F.col("genre_hit") | F.col("artist_hit"))
    first_reasons = F.array_compact(F.array(
        F.when(n_followed > 0, F.concat(F.lit("회원님이 팔로우한 아티스트 "), n_followed.cast("string"), F.lit("명이 출연해요"))),
        F.when(hot, F.concat(F.lit("이번 주 인기 급상승 +"), round0(F.col("trending_score") - 100).cast("string"), F.lit("%"))),
        F.when(alike, F.lit("회원님이 관심 등록한 공연과 비슷해요")),
    ))
    reasons = F.when((F.size(first_reasons) == 0) & (F.col("popularity") >= 0.5), F.array(F.lit("지금 인기 있는 공연"))).otherwise(first_reasons)
    return page.select(
        "user_id", "rank", "event_id", "title", "final_score",
        round2(F.col("popularity")).alias("popularity"), round2(F.col("trending")).alias("trending"),
        round2(F.col("recommendation")).alias("recommendation"), round2(F.col("freshness")).alias("freshness"),
        round2(F.col("favorite")).alias("favorite_match"), round2(F.col("similar")).alias("similar_match"),
        round2(F.col("behavior")).alias("behavior_match"), reasons.alias("reasons"),
        has_more(offset, limit, n_open).alias("has_more"),
    )
