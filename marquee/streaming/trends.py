"""Trends, error counts and booking outcomes over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.maths import cents, round2


def trending_windows(snapshots: DataFrame, delay: str = "1 day") -> DataFrame:
    """(entity, window end, trending_score) per day, from a stream of score snapshots.

    Snapshots are first summed per day. The 30-day window then slides over days, so a day, not a
    snapshot, is what gets copied into 30 windows; the last 7 days are a condition inside it.
    State is dropped a watermark after the window ends.
    """
    score = cents(F.coalesce("popularity_score", F.lit(0.0)))
    daily = (
        snapshots.withWatermark("captured_at", delay)
        .groupBy("entity_type", "entity_id", F.window("captured_at", "1 day").alias("day"))
        .agg(F.count("*").alias("n"), F.sum(score).alias("total"))
    )
    daily = daily.withColumn("at", F.window_time("day"))
    spread = daily.select(
        "entity_type", "entity_id", "n", "total", "at", F.window("at", f"{V.TREND_BASELINE_DAYS} days", "1 day").alias("w")
    )
    recent = F.col("at") >= F.col("w.end") - F.make_dt_interval(F.lit(V.TREND_CURRENT_DAYS))
    sums = spread.groupBy("entity_type", "entity_id", "w").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"),
        F.sum(F.when(recent, F.col("n")).otherwise(0)).alias("n_now"), F.sum(F.when(recent, F.col("total")).otherwise(0)).alias("now"),
    )
    mean_now = F.coalesce(F.try_divide(F.col("now"), F.col("n_now")), F.lit(0.0))
    mean_all = F.col("total") / F.col("n")
    flat = (F.col("n") < V.TREND_MIN_SNAPSHOTS) | (mean_all <= 0)
    return sums.select(
        "entity_type", "entity_id", F.col("w.end").alias("window_end"),
        F.when(flat, F.lit(0.0)).otherwise(round2(F.try_divide(mean_now, mean_all) * 100)).alias("trending_score"),
    )


def error_counts(logs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """App errors per hour, type and platform, with the unresolved ones."""
    return (
        logs.withWatermark("created_at", delay)
        .groupBy(F.window("created_at", "1 hour").alias("w"), "error_type", "platform")
        .agg(F.count("*").alias("n"), F.count_if(~F.col("is_resolved")).alias("unresolved"))
        .select(F.col("w.start").alias("hour"), "error_type", "platform", "n", "unresolved")
    )


def intent_outcomes(intents: DataFrame, bookings: DataFrame, days: int = 7, delay: str = "1 day") -> DataFrame:
    """Booking intents with the booking that followed within a week, or none once it has expired.

    intents: user_id, event_id, attempted_at; bookings: user_id, event_id, booked_at. Both sides
    are dropped from state when the week, plus the watermark, has passed.
    """
    i = intents.withWatermark("attempted_at", delay).alias("i")
    b = bookings.withWatermark("booked_at", delay).alias("b")
    on = F.expr(
        "i.user_id = b.user_id AND i.event_id = b.event_id AND b.booked_at >= i.attempted_at "
        f"AND b.booked_at <= i.attempted_at + INTERVAL {days} DAYS"
    )
    joined = i.join(b, on, "leftOuter")
    return joined.select(
        "i.user_id", "i.event_id", "i.attempted_at", "b.booked_at",
        F.when(F.col("b.booked_at").isNotNull(), "booked").otherwise("skipped").alias("outcome"),
    )


def sessions(actions: DataFrame, gap: str = "6 hours", delay: str = "1 day") -> DataFrame:
    """Visits of a user: actions no more than `gap` apart, from a stream of (user_id, at, kind, value).

    A visit is given out, and its state dropped, once the watermark has passed its last action by
    `gap`; until then late actions still extend it or join two visits into one.
    """
    return (
        actions.withWatermark("at", delay).groupBy("user_id", F.session_window("at", gap).alias("w"))
        .agg(F.count("*").alias("n_actions"), F.max("at").alias("ended_at"), F.count_if(F.col("kind") == "purchase").alias("n_purchases"),
             F.sum(cents(F.coalesce("value", F.lit(0.0)))).alias("value_cents"))
        .select("user_id", F.col("w.start").alias("started_at"), "ended_at", "n_actions", "n_purchases", "value_cents")
    )
