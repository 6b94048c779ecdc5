"""Reports: missing values, duplicates, coverage, dashboards and user rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import links as L
from ..functions import text as T
from ..functions.dates import at, days_before, moment
from .listing import is_missing


def missing_counts(rows: DataFrame, fields: list[str], null_only: list[str] = ()) -> DataFrame:
    """(field, missing) in one pass over the table."""
    counts = rows.agg(*[F.count_if(is_missing(f, f in null_only)).alias(f) for f in fields])
    return counts.unpivot([], fields, "field", "missing")


def duplicate_row_count(rows: DataFrame, column: str) -> DataFrame:
    """How many rows share their value with another one."""
    groups = rows.groupBy(column).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"))


def duplicate_groups(rows: DataFrame, column: str, place: str) -> DataFrame:
    """(value, n, n_places, same_place) of values that occur more than once."""
    return rows.groupBy(T.strip(T.or_empty(column)).alias("value")).agg(
        F.count("*").alias("n"), F.countDistinct(F.coalesce(F.col(place).cast("string"), F.lit(""))).alias("n_places")
    ).filter("n > 1").withColumn("same_place", F.col("n_places") == 1)


def status_counts(rows: DataFrame, column: str = "status") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def two_level_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def status_pivot(rows: DataFrame, keys: list[str], statuses: list[str], column: str = "status") -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.count_if(F.col(column) == s).alias(s) for s in statuses])


def event_dashboard(events: DataFrame, as_of: str) -> DataFrame:
    """One row of event counts."""
    today = F.lit(as_of[:10]).cast("date")
    status = F.col("status")
    return events.agg(
        F.count("*").alias("total"),
        *[F.count_if(status == s).alias(s) for s in V.EVENT_STATUSES],
        F.count_if((F.col("end_date").cast("date") < today) & (status != "ended")).alias("needs_end_update"),
        F.count_if(F.col("artist_id").isNull()).alias("unlinked"),
    )


def enrichment_counts(artists: DataFrame) -> DataFrame:
    s = F.col("enrichment_status")
    return artists.agg(
        F.count_if(s == "enriched").alias("enriched"), F.count_if(s.isNull() | (s == "pending")).alias("pending"),
        F.count_if(s == "skipped").alias("skipped"), F.count_if(s == "failed").alias("failed"),
    )


def recent_fix_counts(log: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    recent = log.filter(moment("fixed_at") >= days_before(at(as_of), days))
    return recent.groupBy("fix_method").agg(F.count("*").alias("n"))


def opening_soon(events: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Events whose ticket sale opens within the week, with the days to go."""
    d = F.date_diff(F.col("ticket_open_date").cast("date"), F.lit(as_of[:10]).cast("date"))
    return events.withColumn("d_day", d).filter(F.col("d_day").between(0, days)).select("id", "title", "ticket_open_date", "d_day")


def user_rollup(
    users: DataFrame, bookings: DataFrame, followings: DataFrame, profiles: DataFrame | None = None
) -> DataFrame:
    """Per user: names, role, last visit, bookings, follows and account status."""
    booked = bookings.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("booking_count"))
    follows = followings.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("following_count"))
    rows = users.join(booked, "id", "left").join(follows, "id", "left").fillna({"booking_count": 0, "following_count": 0})
    if profiles is not None:
        rows = rows.join(profiles.select("id", "display_name", "role", "last_visit_date"), "id", "left")
    for c in ("display_name", "role", "last_visit_date"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    last = F.coalesce(F.col("last_visit_date").cast("string"), F.col("last_sign_in_at").cast("string"))
    return rows.select(
        "id", L.display_name(F.col("display_name"), F.col("email")).alias("display_name"),
        F.coalesce("email", F.lit("-")).alias("email"),
        F.when(F.col("role") == "admin", "admin").otherwise("user").alias("role"),
        last.alias("last_visit_date"), "booking_count", "following_count", "created_at",
        F.when(last.isNotNull(), "active").otherwise("pending").alias("account_status"),
    )


def user_stats(rollup: DataFrame, as_of: str) -> DataFrame:
    return rollup.agg(
        F.count("*").alias("total"), F.count_if(F.col("account_status") == "pending").alias("pending"),
        F.count_if(moment("created_at") >= days_before(at(as_of), 7)).alias("recent"),
    )


def coverage(events: DataFrame, edges: DataFrame, column: str, edge_key: str = "event_id") -> DataFrame:
    """One row: events without the direct link, split into linked through edges and not at all."""
    linked = edges.select(F.col(edge_key).alias("id")).distinct().withColumn("_linked", F.lit(True))
    rows = events.join(linked, "id", "left")
    bare, joined = F.col(column).isNull(), F.coalesce("_linked", F.lit(False))
    counts = rows.agg(
        F.count("*").alias("total"), F.count_if(bare).alias("without_column"), F.count_if(joined).alias("with_edges"),
        F.count_if(bare & joined).alias("only_edges"), F.count_if(bare & ~joined).alias("unlinked"),
    )
    return counts.withColumn("without_pct", F.floor(F.try_divide(F.col("without_column") * 100, F.col("total")) + 0.5))


def provider_histogram(events: DataFrame) -> DataFrame:
    return events.groupBy(F.size("booking_links").alias("n_providers")).agg(F.count("*").alias("n_events"))


def unlinked_by_source(events: DataFrame) -> DataFrame:
    return events.filter(F.col("artist_id").isNull()).groupBy("source_name").agg(F.count("*").alias("n"))


def venue_audit(venues: DataFrame) -> DataFrame:
    """(class, n): venues named like events, halls, addresses, or like another venue."""
    name = F.col("name")
    like = lambda words: name.rlike(T.any_word(words))
    trash, show = F.contains(name, F.lit(V.TRASH_VENUE_MARK)), F.contains(name, F.lit("공연"))
    region = name.rlike("^(?:" + T.any_word(V.REGION_PREFIXES) + ")")
    counts = venues.agg(
        F.count("*").alias("total"), F.count_if(like(V.GARBAGE_VENUE_WORDS)).alias("title_words"),
        F.count_if(like(V.HALL_WORDS) & ~trash & ~show).alias("hall"), F.count_if(region & ~trash).alias("address"),
    )
    classes = ["total", "title_words", "hall", "address"]
    repeated = venues.groupBy("name").agg(F.count("*").alias("c")).filter("c > 1").agg(F.count("*").alias("n"))
    return counts.unpivot([], classes, "class", "n").unionByName(repeated.select(F.lit("duplicate_names").alias("class"), "n"))


def count_where(rows: DataFrame, **tests: Column) -> DataFrame:
    """Several conditional counts in one pass."""
    return rows.agg(*[F.count_if(t).alias(n) for n, t in tests.items()])


# --- embedded joins ----------------------------------------------------------------------
def bookings_view(bookings: DataFrame, events: DataFrame, venues: DataFrame, users: DataFrame) -> DataFrame:
    e = events.select(F.col("id").alias("event_id"), F.col("title").alias("event_title"), "start_date", "venue_id")
    v = venues.select(F.col("id").alias("venue_id"), F.col("name").alias("venue_name"))
    u = users.select(F.col("id").alias("user_id"), F.col("name").alias("user_name"))
    return bookings.join(e, "event_id", "left").join(v, "venue_id", "left").join(u, "user_id", "left")


def with_event_title(rows: DataFrame, events: DataFrame) -> DataFrame:
    return rows.join(events.select(F.col("id").alias("event_id"), F.col("title").alias("event_title")), "event_id", "left")


def link_issues(issues: DataFrame, events: DataFrame) -> DataFrame:
    """Booking-link reports with whether the event has a link by now."""
    e = events.select(F.col("id").alias("event_id"), F.col("title").alias("event_title"), "booking_url")
    return issues.join(e, "event_id", "left").withColumn("resolved", ~T.is_blank("booking_url"))


def enrichment_backlog(artists: DataFrame, events: DataFrame, event_artists: DataFrame, marker: str) -> DataFrame:
    """Artists not checked yet that play somewhere, the busiest first in (n_events, id) order."""
    led = events.filter(F.col("artist_id").isNotNull()).select(F.col("artist_id").alias("id"))
    counts = led.union(event_artists.select(F.col("artist_id").alias("id"))).groupBy("id").agg(F.count("*").alias("n_events"))
    return artists.filter(F.col(marker).isNull()).join(counts, "id").select("id", "name", "n_events")
