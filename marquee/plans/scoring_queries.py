"""Engagement, popularity and trend queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.dates import at
from ..operators import engagement as E
from ..operators import scoring as S
from ..session import cut_lineage
from .registry import query
from .roles import AS_OF, SNAPSHOT_AS_OF, Roles, with_roles

ARTIST_ENGAGEMENT_SQL = """artist_engagement AS (
  SELECT a.id AS artist_id, coalesce(fg.n, 0) AS follower_graph_count,
    coalesce(bm.n, 0) AS event_bookmark_total, coalesce(rv.n, 0) AS review_volume,
    coalesce(rv.avg_star, 0) AS review_avg
  FROM r_artists a
  LEFT JOIN (SELECT artist_id, count(*) AS n FROM r_followings GROUP BY 1) fg ON fg.artist_id = a.id
  LEFT JOIN (SELECT artist_id, count(*) AS n FROM r_event_artists JOIN r_interested USING (event_id) GROUP BY 1) bm
    ON bm.artist_id = a.id
  LEFT JOIN (SELECT artist_id, count(*) AS n, sum(star_count) / count(star_count) AS avg_star
    FROM r_event_artists JOIN r_reviews USING (event_id) GROUP BY 1) rv ON rv.artist_id = a.id)"""
EVENT_ENGAGEMENT_SQL = """event_engagement AS (
  SELECT e.id AS event_id, coalesce(i.n, 0) AS interested_count, coalesce(b.n, 0) AS booking_count,
    coalesce(r.n, 0) AS review_count, coalesce(r.avg_star, 0) AS review_avg, coalesce(l.n, 0) AS artist_count
  FROM r_events e
  LEFT JOIN (SELECT event_id, count(*) AS n FROM r_interested GROUP BY 1) i ON i.event_id = e.id
  LEFT JOIN (SELECT event_id, count(*) AS n FROM r_bookings GROUP BY 1) b ON b.event_id = e.id
  LEFT JOIN (SELECT event_id, count(*) AS n, sum(star_count) / count(star_count) AS avg_star
    FROM r_reviews GROUP BY 1) r ON r.event_id = e.id
  LEFT JOIN (SELECT event_id, count(*) AS n FROM r_event_artists GROUP BY 1) l ON l.event_id = e.id)"""
UPCOMING_SQL = """upcoming AS (
  SELECT a.id AS artist_id, count(DISTINCT e.id) AS upcoming_event_count
  FROM r_artists a LEFT JOIN r_event_artists ea ON ea.artist_id = a.id
  LEFT JOIN r_events e ON e.id = ea.event_id AND e.status <> 'ended' GROUP BY 1)"""
ARTIST_ROLES = "r_events r_artists r_event_artists r_followings r_interested r_reviews"


def _pct(column: str) -> str:
    """Share strictly below, or log min-max in a population of fewer than twenty."""
    low, high = f"ln(1 + min({column}) OVER ())", f"ln(1 + max({column}) OVER ())"
    return f"""CASE WHEN (SELECT count(*) FROM base) >= {V.MIN_POPULATION}
      THEN (rank() OVER (ORDER BY {column}) - 1) / (SELECT count(*) FROM base) * 100
      WHEN max({column}) OVER () > min({column}) OVER ()
      THEN least(greatest((ln(1 + {column}) - {low}) / ({high} - {low}) * 100, 0), 100) ELSE 0 END"""


def _weights(signals) -> dict[str, float]:
    return {k: w for k, w, _ in S.renormalised_weights(signals)}


_AW, _EW = _weights(V.ARTIST_SIGNALS), _weights(V.EVENT_SIGNALS)
ARTIST_SCORE_SQL = (
    ARTIST_ENGAGEMENT_SQL + ",\n" + UPCOMING_SQL + f""",
artist_norm AS (
  WITH base AS (SELECT a.id, a.followers_count, u.upcoming_event_count, e.* EXCLUDE (artist_id) FROM r_artists a
    JOIN artist_engagement e ON e.artist_id = a.id JOIN upcoming u ON u.artist_id = a.id)
  SELECT id, {_pct('followers_count')} AS n1, {_pct('follower_graph_count')} AS n2,
    {_pct('upcoming_event_count')} AS n3, {_pct('event_bookmark_total')} AS n4, {_pct('review_volume')} AS n5,
    least(greatest(review_avg / 5.0 * 100, 0), 100) AS n6 FROM base),
artist_scores AS (
  SELECT id, floor((0.0e0 + n1 * {_AW['followers_count']!r}e0 + n2 * {_AW['follower_graph_count']!r}e0
    + n3 * {_AW['upcoming_event_count']!r}e0 + n4 * {_AW['event_bookmark_total']!r}e0
    + n5 * {_AW['review_volume']!r}e0 + n6 * {_AW['review_avg']!r}e0) * 100 + 0.5) / 100 AS popularity_score
  FROM artist_norm)"""
)
EVENT_SCORE_SQL = (
    ARTIST_SCORE_SQL + ",\n" + EVENT_ENGAGEMENT_SQL + f""",
influence AS (
  SELECT event_id, floor((0.7e0 * (sum(c) / count(*) / 100) + 0.3e0 * (max(c) / 100)) * 100 + 0.5) / 100 AS influence
  FROM (SELECT event_id, CAST(floor(popularity_score * 100 + 0.5) AS BIGINT) AS c
        FROM r_event_artists JOIN artist_scores ON id = artist_id) GROUP BY 1),
event_raw AS (
  SELECT e.id, e.title, e.status, e.start_date, coalesce(i.influence, 0) AS artist_influence,
    interested_count + 2 * booking_count + review_count AS ticket_demand,
    artist_count + CASE WHEN has_timetable THEN 3 ELSE 0 END AS event_scale,
    interested_count + review_count AS community_attention,
    CASE WHEN e.status = 'ended' THEN 0 WHEN d < 0 THEN 70 WHEN d <= 14 THEN 100 WHEN d <= 30 THEN 80
      WHEN d <= 60 THEN 60 WHEN d <= 120 THEN 40 ELSE 20 END AS freshness
  FROM (SELECT *, date_diff('day', DATE '2024-01-20', start_date) AS d FROM r_events) e
  JOIN event_engagement g ON g.event_id = e.id LEFT JOIN influence i ON i.event_id = e.id),
event_norm AS (
  WITH base AS (SELECT * FROM event_raw)
  SELECT *, least(greatest(artist_influence / 100.0e0 * 100, 0), 100) AS n1, {_pct('ticket_demand')} AS n2,
    {_pct('event_scale')} AS n3, {_pct('community_attention')} AS n4,
    least(greatest(freshness / 100.0e0 * 100, 0), 100) AS n5 FROM base),
event_scores AS (
  SELECT *, floor((0.0e0 + n1 * {_EW['artist_influence']!r}e0 + n2 * {_EW['ticket_demand']!r}e0
    + n3 * {_EW['event_scale']!r}e0 + n4 * {_EW['community_attention']!r}e0
    + n5 * {_EW['freshness']!r}e0) * 100 + 0.5) / 100 AS popularity_score
  FROM event_norm)"""
)
EVENT_ROLES = ARTIST_ROLES + " r_bookings"


def scoring_roles(r: Roles) -> Roles:
    """The roles with those written out that several signals are counted from."""
    return r.kept("deals").kept("event_artists", "interested")


def artist_engagement_of(r: Roles):
    return E.artist_engagement(r.artists, r.followings, r.event_artists, r.interested, r.reviews)


def event_engagement_of(r: Roles):
    return E.event_engagement(r.events, r.interested, r.bookings, r.reviews, r.event_artists)


def scored_artists(r: Roles):
    upcoming = E.upcoming_counts(r.artists, r.event_artists, r.events).withColumnRenamed("artist_id", "id")
    return cut_lineage(S.artist_popularity(r.artists.join(upcoming, "id"), artist_engagement_of(r), AS_OF))


def scored_events(r: Roles, artist_scores=None):
    scores = scored_artists(scoring_roles(r)) if artist_scores is None else artist_scores
    return S.event_popularity(r.events, r.event_artists, scores, event_engagement_of(r), AS_OF)


@query("artist_engagement", with_roles(ARTIST_ROLES, "SELECT * FROM artist_engagement", ARTIST_ENGAGEMENT_SQL))
def artist_engagement(r: Roles):
    return artist_engagement_of(r)


@query(
    "event_engagement",
    with_roles(
        "r_events r_event_artists r_interested r_bookings r_reviews",
        "SELECT * FROM event_engagement", EVENT_ENGAGEMENT_SQL,
    ),
)
def event_engagement(r: Roles):
    return event_engagement_of(r)


@query(
    "genre_profile",
    with_roles(
        "r_events r_event_artists r_performances",
        """SELECT artist_id, genre, count(*) AS cnt FROM (
             SELECT artist_id, genre FROM r_event_artists JOIN r_events ON id = event_id
             UNION ALL SELECT artist_id, genre FROM r_performances)
           WHERE genre IS NOT NULL AND genre <> '' GROUP BY 1, 2""",
    ),
)
def genre_profile(r: Roles):
    return E.genre_profile(r.event_artists, r.events, r.performances)


@query("upcoming_counts", with_roles("r_events r_artists r_event_artists", "SELECT * FROM upcoming", UPCOMING_SQL))
def upcoming_counts(r: Roles):
    return E.upcoming_counts(r.artists, r.event_artists, r.events)


@query(
    "follower_counts",
    with_roles(
        "r_artists r_followings",
        """SELECT a.id AS artist_id, count(f.user_id) AS followers_count
           FROM r_artists a LEFT JOIN r_followings f ON f.artist_id = a.id GROUP BY 1""",
    ),
)
def follower_counts(r: Roles):
    return E.follower_counts(r.artists, r.followings)


@query(
    "linked_event_counts",
    with_roles("r_event_artists", "SELECT artist_id, count(*) AS linked_event_count FROM r_event_artists GROUP BY 1"),
)
def linked_event_counts(r: Roles):
    return E.linked_event_counts(r.event_artists)


@query(
    "venue_event_counts",
    with_roles("r_events", "SELECT venue_id, count(*) AS linked_event_count FROM r_events GROUP BY 1"),
)
def venue_event_counts(r: Roles):
    return E.venue_event_counts(r.events)


@query(
    "refreshed_counters",
    with_roles(
        "r_events r_artists r_event_artists r_followings",
        """SELECT a.id, a.name, u.upcoming_event_count,
             (SELECT count(*) FROM r_followings f WHERE f.artist_id = a.id) AS followers_count
           FROM r_artists a JOIN upcoming u ON u.artist_id = a.id""",
        UPCOMING_SQL,
    ),
)
def refreshed_counters(r: Roles):
    artists = r.artists.withColumn("upcoming_event_count", F.lit(0).cast("long"))
    fresh = E.refresh_counters(artists, r.followings, r.event_artists, r.events)
    return fresh.select("id", "name", "upcoming_event_count", "followers_count")


@query(
    "artist_popularity",
    with_roles(ARTIST_ROLES, "SELECT id, popularity_score FROM artist_scores", ARTIST_SCORE_SQL),
)
def artist_popularity(r: Roles):
    return scored_artists(scoring_roles(r)).select("id", "popularity_score")


@query(
    "event_popularity",
    with_roles(
        EVENT_ROLES,
        """SELECT id, popularity_score, artist_influence, CAST(ticket_demand AS DOUBLE) AS ticket_demand, CAST(event_scale AS DOUBLE) AS event_scale,
             CAST(community_attention AS DOUBLE) AS community_attention, CAST(freshness AS DOUBLE) AS freshness FROM event_scores""",
        EVENT_SCORE_SQL,
    ),
)
def event_popularity(r: Roles):
    raw = {k: F.get(F.filter("score_breakdown.signals", (lambda k: lambda s: s["key"] == k)(k)), F.lit(0))["raw"]
           for k, _, _ in V.EVENT_SIGNALS}
    return scored_events(r).select("id", "popularity_score", *[c.alias(k) for k, c in raw.items()])


def _signal_sql(n: int, key: str, method: str) -> str:
    weight = f"{_EW[key]!r}e0"
    return f"""SELECT id, '{key}' AS key, floor(CAST({key} AS DOUBLE) * 100 + 0.5) / 100 AS raw, floor(n{n} * 100 + 0.5) / 100 AS normalized, {method} AS method,
      floor({weight} * 100 + 0.5) / 100 AS weight, floor(n{n} * {weight} * 100 + 0.5) / 100 AS contribution FROM event_norm"""


_RANKED = f"CASE WHEN (SELECT count(*) FROM event_norm) >= {V.MIN_POPULATION} THEN 'percentile' ELSE 'log_min_max' END"


@query(
    "event_score_breakdown",
    with_roles(
        EVENT_ROLES,
        " UNION ALL ".join(
            _signal_sql(i, k, "'min_max'" if k in V.BOUNDED_SIGNALS else _RANKED) for i, (k, _, _) in enumerate(V.EVENT_SIGNALS, start=1)
        ),
        EVENT_SCORE_SQL,
    ),
)
def event_score_breakdown(r: Roles):
    rows = scored_events(r).select("id", F.explode("score_breakdown.signals").alias("s"))
    return rows.select("id", "s.key", "s.raw", "s.normalized", "s.method", "s.weight", "s.contribution")


@query(
    "event_popularity_ranking",
    with_roles(
        EVENT_ROLES,
        """SELECT row_number() OVER (ORDER BY popularity_score DESC, id) AS rank, id, title, popularity_score
           FROM event_scores ORDER BY rank LIMIT 100""",
        EVENT_SCORE_SQL,
    ),
)
def event_popularity_ranking(r: Roles):
    return top_events(r, 100)


def top_events(r: Roles, limit: int):
    """The best events with their place; only the page itself is numbered."""
    from ..operators.listing import top_ranked

    scored = scored_events(r).join(r.events.select("id", "title"), "id")
    return top_ranked(scored, [("popularity_score", False)], "id", limit).select(
        "rank", "id", "title", "popularity_score"
    )


@query(
    "score_snapshots",
    with_roles(
        EVENT_ROLES,
        """SELECT 'artist' AS entity_type, CAST(id AS VARCHAR) AS entity_id, popularity_score FROM artist_scores
           UNION ALL SELECT 'event', CAST(id AS VARCHAR), popularity_score FROM event_scores""",
        EVENT_SCORE_SQL,
    ),
)
def score_snapshots(r: Roles):
    artists = scored_artists(scoring_roles(r))
    rows = S.snapshot_rows(artists, scored_events(r, artists), at(AS_OF))
    return rows.select("entity_type", "entity_id", "popularity_score")


@query(
    "trending",
    with_roles(
        "r_snapshots",
        """SELECT entity_type, entity_id, n < 2 AS cold_start,
             CASE WHEN n < 2 OR base <= 0 THEN 0 ELSE
               floor(coalesce(cur / nullif(n_cur, 0), 0) / (base / n) * 100 * 100 + 0.5) / 100 END AS trending_score
           FROM (SELECT entity_type, entity_id, count(*) AS n, sum(c) AS base,
                   count(*) FILTER (captured_at >= TIMESTAMP '2024-01-24') AS n_cur,
                   coalesce(sum(c) FILTER (captured_at >= TIMESTAMP '2024-01-24'), 0) AS cur
                 FROM (SELECT *, CAST(floor(coalesce(popularity_score, 0) * 100 + 0.5) AS BIGINT) AS c
                       FROM r_snapshots WHERE captured_at >= TIMESTAMP '2024-01-01')
                 GROUP BY 1, 2)""",
    ),
)
def trending(r: Roles):
    return S.trending(r.snapshots, SNAPSHOT_AS_OF)


@query(
    "scores_applied",
    with_roles(
        "r_snapshots r_artists",
        """SELECT a.id, a.name, coalesce(t.c, a.followers_count) AS followers_count FROM r_artists a
           LEFT JOIN (SELECT entity_id, count(*) AS c FROM r_snapshots GROUP BY 1) t
             ON t.entity_id = CAST(a.id AS VARCHAR)""",
    ),
)
def scores_applied(r: Roles):
    patch = r.snapshots.groupBy("entity_id").agg(F.count("*").alias("followers_count"))
    patch = patch.select(F.col("entity_id").cast("long").alias("id"), "followers_count")
    return S.apply_scores(r.artists, patch, ["followers_count"]).select("id", "name", "followers_count")
