"""Engagement counts: every fact is aggregated before it meets the entity table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counted(entities: DataFrame, key: str, *parts: tuple[DataFrame, dict[str, object]]) -> DataFrame:
    out = entities
    for facts, defaults in parts:
        out = out.join(facts, key, "left").fillna(defaults)
    return out


def artist_engagement(
    artists: DataFrame,
    followings: DataFrame,
    event_artists: DataFrame,
    interested: DataFrame,
    reviews: DataFrame,
) -> DataFrame:
    """Per artist: followers, bookmarks, reviews and mean stars over the events they play.

    Bookmarks and reviews are reduced to one row per event before they meet the lineup, so the
    join carries events, not clicks.
    """
    follows = followings.groupBy("artist_id").agg(F.count("*").alias("follower_graph_count"))
    per_event = interested.groupBy("event_id").agg(F.count("user_id").alias("n"))
    bookmarks = (
        event_artists.join(per_event, "event_id")
        .groupBy("artist_id")
        .agg(F.sum("n").alias("event_bookmark_total"))
    )
    stars = reviews.groupBy("event_id").agg(
        F.count("*").alias("n"), F.count("star_count").alias("rated"), F.sum("star_count").alias("stars")
    )
    reviewed = (
        event_artists.join(stars, "event_id")
        .groupBy("artist_id")
        .agg(
            F.sum("n").alias("review_volume"),
            F.try_divide(F.sum("stars"), F.sum("rated")).alias("review_avg"),
        )
    )
    return _counted(
        artists.select(F.col("id").alias("artist_id")),
        "artist_id",
        (follows, {"follower_graph_count": 0}),
        (bookmarks, {"event_bookmark_total": 0}),
        (reviewed, {"review_volume": 0, "review_avg": 0.0}),
    )


def event_engagement(
    events: DataFrame,
    interested: DataFrame,
    bookings: DataFrame,
    reviews: DataFrame,
    event_artists: DataFrame,
    booking_filter: Column | None = None,
) -> DataFrame:
    """Per event: interest, bookings (every status unless filtered), reviews, lineup size."""
    booked = bookings if booking_filter is None else bookings.filter(booking_filter)
    return _counted(
        events.select(F.col("id").alias("event_id")),
        "event_id",
        (interested.groupBy("event_id").agg(F.count("*").alias("interested_count")), {"interested_count": 0}),
        (booked.groupBy("event_id").agg(F.count("*").alias("booking_count")), {"booking_count": 0}),
        (
            reviews.groupBy("event_id").agg(
                F.count("*").alias("review_count"),
                F.try_divide(F.sum("star_count"), F.count("star_count")).alias("review_avg"),
            ),
            {"review_count": 0, "review_avg": 0.0},
        ),
        (event_artists.groupBy("event_id").agg(F.count("*").alias("artist_count")), {"artist_count": 0}),
    )


def genre_profile(event_artists: DataFrame, events: DataFrame, performances: DataFrame) -> DataFrame:
    """How often an artist plays each genre, over event genres and timetable genres."""
    billed = event_artists.join(events.select(F.col("id").alias("event_id"), "genre"), "event_id").select(
        "artist_id", "genre"
    )
    slots = performances.filter(F.col("artist_id").isNotNull()).select("artist_id", "genre")
    return (
        billed.unionByName(slots)
        .filter(F.col("genre").isNotNull() & (F.col("genre") != ""))
        .groupBy("artist_id", "genre")
        .agg(F.count("*").alias("cnt"))
    )


def upcoming_counts(artists: DataFrame, event_artists: DataFrame, events: DataFrame) -> DataFrame:
    """Distinct events per artist that are not over."""
    live = events.filter(F.col("status") != "ended").select(F.col("id").alias("event_id"))
    counts = (
        event_artists.select("event_id", "artist_id").distinct()
        .join(live, "event_id")
        .groupBy("artist_id")
        .agg(F.count("*").alias("upcoming_event_count"))
    )
    return _counted(
        artists.select(F.col("id").alias("artist_id")), "artist_id", (counts, {"upcoming_event_count": 0})
    )


def follower_counts(artists: DataFrame, followings: DataFrame) -> DataFrame:
    counts = followings.groupBy("artist_id").agg(F.count("*").alias("followers_count"))
    return _counted(
        artists.select(F.col("id").alias("artist_id")), "artist_id", (counts, {"followers_count": 0})
    )


def linked_event_counts(event_artists: DataFrame) -> DataFrame:
    return event_artists.groupBy("artist_id").agg(F.count("*").alias("linked_event_count"))


def venue_event_counts(events: DataFrame) -> DataFrame:
    return events.filter(F.col("venue_id").isNotNull()).groupBy("venue_id").agg(
        F.count("*").alias("linked_event_count")
    )


def refresh_counters(
    artists: DataFrame, followings: DataFrame, event_artists: DataFrame, events: DataFrame,
    affected: DataFrame | None = None,
) -> DataFrame:
    """Artists with both stored counters recomputed; only the affected ids when given."""
    scope = artists if affected is None else artists.join(affected.select("id").distinct(), "id", "left_semi")
    fresh = upcoming_counts(scope, event_artists, events).join(follower_counts(scope, followings), "artist_id")
    fresh = fresh.withColumnsRenamed(
        {"artist_id": "id", "upcoming_event_count": "_upcoming", "followers_count": "_followers"}
    )
    return (
        artists.join(fresh, "id", "left")
        .withColumn("upcoming_event_count", F.coalesce("_upcoming", "upcoming_event_count"))
        .withColumn("followers_count", F.coalesce("_followers", "followers_count"))
        .drop("_upcoming", "_followers")
    )


SignalProvider = Callable[[], DataFrame]


def merge_signals(*providers: DataFrame) -> DataFrame:
    """(entity_id, signals) from several providers; a later one wins for a key it also has."""
    out = providers[0].select("entity_id", F.col("signals").alias("_s0"))
    names = ["_s0"]
    for i, provider in enumerate(providers[1:], start=1):
        out = out.join(provider.select("entity_id", F.col("signals").alias(f"_s{i}")), "entity_id", "full")
        names.append(f"_s{i}")
    merged = F.coalesce(F.col(names[0]), F.create_map().cast("map<string,double>"))
    for name in names[1:]:
        late = F.coalesce(F.col(name), F.create_map().cast("map<string,double>"))
        merged = F.map_concat(
            F.map_filter(merged, (lambda m: lambda k, v: ~F.map_contains_key(m, k))(late)), late
        )
    return out.select("entity_id", merged.alias("signals"))
