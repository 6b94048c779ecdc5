"""Counters kept up to date by change streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.engagement import refresh_counters


def follower_totals(changes: DataFrame) -> DataFrame:
    """Running followers per artist from (artist_id, action) with action follow or unfollow.

    State is one number per artist. Write in update mode; the floor at zero belongs to the reader
    of the total, since an unfollow may overtake its follow.
    """
    step = F.when(F.col("action") == "follow", 1).when(F.col("action") == "unfollow", -1).otherwise(0)
    return changes.groupBy("artist_id").agg(F.sum(step).alias("total"))


def current_counts(totals: DataFrame) -> DataFrame:
    """The newest total per artist, never below zero."""
    last = F.max_by("total", "epoch")
    return totals.groupBy("artist_id").agg(F.greatest(last, F.lit(0)).alias("followers_count"))


def recount(batch: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Artists with fresh counters after a batch of (event_id) whose lineup or status changed."""
    touched = tables["event_artists"].join(batch.select("event_id").distinct(), "event_id", "left_semi")
    affected = touched.select(F.col("artist_id").alias("id")).distinct()
    fresh = refresh_counters(
        tables["artists"], tables["user_artist_followings"], tables["event_artists"], tables["events"], affected
    )
    return fresh.join(affected, "id", "left_semi")
