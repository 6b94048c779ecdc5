"""Recommendation queries for all users."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import engagement as E
from ..operators import recommend_artists as RA
from ..operators import recommend_events as RE
from .registry import query
from .roles import AS_OF, Roles, with_roles

LIST_LENGTH = 10


def rated_artists(r: Roles):
    """Artists with a score and the names of acts they are related to."""
    near = lambda n: F.format_string("Supplier#%09d", F.col("id") + n)
    return r.artists.withColumn("popularity_score", F.col("followers_count") / 100).withColumn(
        "related", F.concat(near(1), F.lit(" / "), near(7))
    )


def rated_events(r: Roles):
    key = F.col("id")
    return r.events.withColumn("popularity_score", key * 37 % 1000 / 10).withColumn("trending_score", key * 53 % 2500 / 10)


GENRES_SQL = """gp AS (SELECT DISTINCT artist_id, genre FROM (
    SELECT artist_id, genre FROM r_event_artists JOIN r_events ON id = event_id
    UNION ALL SELECT artist_id, genre FROM r_performances) WHERE genre <> '')"""
ARTIST_RECS_SQL = GENRES_SQL + """,
co AS (SELECT f.user_id, b.artist_id, count(DISTINCT a.event_id) AS shared
  FROM r_followings f JOIN r_event_artists a ON a.artist_id = f.artist_id
  JOIN r_event_artists b ON b.event_id = a.event_id GROUP BY 1, 2),
lab AS (SELECT DISTINCT user_id, label FROM r_followings JOIN r_artists ON id = artist_id),
ug AS (SELECT DISTINCT user_id, genre FROM r_followings JOIN gp USING (artist_id)),
un AS (SELECT user_id, count(*) AS n FROM ug GROUP BY 1),
gm AS (SELECT user_id, artist_id, count(*) AS n FROM ug JOIN gp USING (genre) GROUP BY 1, 2),
pairs AS (SELECT u.user_id, a.id AS artist_id, a.label, a.followers_count / 100 AS pop
  FROM (SELECT DISTINCT user_id FROM r_followings) u CROSS JOIN r_artists a
  WHERE NOT EXISTS (SELECT 1 FROM r_followings f WHERE f.user_id = u.user_id AND f.artist_id = a.id)),
parts AS (SELECT p.user_id, p.artist_id, p.pop,
    CASE WHEN co.shared > 0 THEN least(greatest(0.5e0 + 0.5e0 * (co.shared - 1) / 3, 0), 1) ELSE 0 END AS co,
    CASE WHEN lab.label IS NULL THEN 0 ELSE 1 END AS ag,
    least(coalesce(gm.n, 0) / greatest(1, coalesce(un.n, 0)), 1) AS ge, coalesce(co.shared, 0) AS shared
  FROM pairs p LEFT JOIN co ON co.user_id = p.user_id AND co.artist_id = p.artist_id
  LEFT JOIN lab ON lab.user_id = p.user_id AND lab.label = p.label
  LEFT JOIN un ON un.user_id = p.user_id
  LEFT JOIN gm ON gm.user_id = p.user_id AND gm.artist_id = p.artist_id),
scored AS (SELECT *, floor(least(0.4e0 * co + 0.3e0 * ag + 0.3e0 * ge, 1) * 10000 + 0.5) / 10000 AS score
  FROM parts WHERE 0.4e0 * co + 0.3e0 * ag + 0.3e0 * ge > 0)"""


@query(
    "artist_recommendations",
    with_roles(
        "r_events r_artists r_event_artists r_followings r_performances",
        f"""SELECT * FROM (SELECT user_id, artist_id, score, floor(co * 100 + 0.5) / 100 AS co_performer,
             floor(ag * 100 + 0.5) / 100 AS agency, floor(ge * 100 + 0.5) / 100 AS genre,
             row_number() OVER (PARTITION BY user_id ORDER BY score DESC, pop DESC, artist_id) AS rank FROM scored)
           WHERE rank <= {LIST_LENGTH}""",
        ARTIST_RECS_SQL,
    ),
)
def artist_recommendations(r: Roles):
    r.kept("deals").kept("event_artists")
    genres = E.genre_profile(r.event_artists, r.events, r.performances)
    recs = RA.artist_recommendations(r.followings, rated_artists(r), r.event_artists, genres, LIST_LENGTH)
    return recs.drop("name", "reasons")


@query(
    "co_performers",
    with_roles(
        "r_event_artists r_followings",
        """SELECT f.user_id, b.artist_id, count(DISTINCT a.event_id) AS shared
           FROM r_followings f JOIN r_event_artists a ON a.artist_id = f.artist_id
           JOIN r_event_artists b ON b.event_id = a.event_id
           WHERE NOT EXISTS (SELECT 1 FROM r_followings x WHERE x.user_id = f.user_id AND x.artist_id = b.artist_id)
           GROUP BY 1, 2""",
    ),
)
def co_performers(r: Roles):
    r.kept("deals").kept("event_artists", "followings")
    return RA.co_performers(r.followings, r.event_artists).select("user_id", "artist_id", "shared")


@query(
    "popular_artists",
    with_roles(
        "r_artists",
        """SELECT id, name, followers_count / 100 AS popularity_score,
             row_number() OVER (ORDER BY followers_count DESC, id) AS rank FROM r_artists ORDER BY rank LIMIT 20""",
    ),
)
def popular_artists(r: Roles):
    return RA.popular_artists(rated_artists(r), 20).select("id", "name", "popularity_score", "rank")


@query(
    "cold_start_artists",
    with_roles(
        "r_artists r_followings",
        """, top AS (SELECT id AS artist_id, name, row_number() OVER (ORDER BY followers_count DESC, id) AS rank
             FROM r_artists ORDER BY rank LIMIT 20)
           SELECT c_custkey AS user_id, rank, artist_id, name, 0.0e0 AS score FROM customer CROSS JOIN top
           WHERE c_custkey NOT IN (SELECT user_id FROM r_followings)""",
    ),
)
def cold_start_artists(r: Roles):
    users = r.table("customer").select(F.col("c_custkey").alias("id"))
    return RA.cold_start(users, r.followings, RA.popular_artists(rated_artists(r), 20)).drop("reasons")


EVENT_RECS_SQL = """cand AS (
  SELECT id AS event_id, genre, least(greatest((id * 37 % 1000 / 10) / 100, 0), 1) AS pop,
    least(greatest((id * 53 % 2500 / 10) / 200, 0), 1) AS trend,
    CASE WHEN d < 0 THEN 0.7e0 WHEN d <= 14 THEN 1.0e0 WHEN d <= 30 THEN 0.8e0 WHEN d <= 60 THEN 0.65e0
      WHEN d <= 90 THEN 0.5e0 WHEN d <= 180 THEN 0.35e0 ELSE 0.2e0 END AS fresh
  FROM (SELECT *, date_diff('day', DATE '2024-01-20', start_date) AS d FROM r_events)
  WHERE status IN ('on_sale', 'upcoming') AND end_date >= DATE '2024-01-20'),
beh AS (SELECT user_id, event_id FROM r_interested UNION SELECT user_id, event_id FROM r_bookings),
bg AS (SELECT DISTINCT user_id, genre FROM beh JOIN r_events ON id = event_id),
ba AS (SELECT DISTINCT user_id, artist_id FROM beh JOIN r_event_artists USING (event_id)),
rel AS (SELECT DISTINCT user_id, lower(n) AS n FROM r_followings f
  CROSS JOIN LATERAL (VALUES (printf('Supplier#%09d', f.artist_id + 1)), (printf('Supplier#%09d', f.artist_id + 7))) t(n)),
bill AS (SELECT event_id, min(display_order) AS first, count(*) AS n_acts FROM r_event_artists GROUP BY 1),
fav AS (SELECT user_id, event_id, count(*) AS n, min(display_order) AS best
  FROM r_followings JOIN r_event_artists USING (artist_id) GROUP BY 1, 2),
bhit AS (SELECT DISTINCT user_id, event_id FROM ba JOIN r_event_artists USING (artist_id)),
rhit AS (SELECT DISTINCT user_id, event_id FROM rel JOIN r_event_artists ON lower(trim(artist_name)) = n),
parts AS (
  SELECT u.c_custkey AS user_id, c.*,
    CASE WHEN fav.n IS NULL THEN 0 ELSE least(CASE WHEN fav.best = bill.first THEN 0.7e0 ELSE 0.5e0 END
      + (0.3e0 * fav.n) / greatest(1, bill.n_acts), 1) END AS favorite,
    least(CASE WHEN bg.genre IS NULL THEN 0 ELSE 0.6e0 END + CASE WHEN rhit.event_id IS NULL THEN 0 ELSE 0.4e0 END, 1) AS similar_,
    least(CASE WHEN bg.genre IS NULL THEN 0 ELSE 0.5e0 END + CASE WHEN bhit.event_id IS NULL THEN 0 ELSE 0.5e0 END, 1) AS behavior
  FROM customer u CROSS JOIN cand c
  LEFT JOIN bg ON bg.user_id = u.c_custkey AND bg.genre = c.genre
  LEFT JOIN fav ON fav.user_id = u.c_custkey AND fav.event_id = c.event_id
  LEFT JOIN bill ON bill.event_id = c.event_id
  LEFT JOIN bhit ON bhit.user_id = u.c_custkey AND bhit.event_id = c.event_id
  LEFT JOIN rhit ON rhit.user_id = u.c_custkey AND rhit.event_id = c.event_id),
rec AS (SELECT *, least(greatest(0.47e0 * favorite + 0.29e0 * similar_ + 0.24e0 * behavior, 0), 1) AS r FROM parts),
scored AS (SELECT *, floor((0.45e0 * pop + 0.25e0 * trend + 0.2e0 * r + 0.1e0 * fresh) * 10000 + 0.5) / 10000 AS final_score FROM rec)"""


@query(
    "event_recommendations",
    with_roles(
        "r_events r_event_artists r_followings r_interested r_bookings",
        f"""SELECT user_id, event_id, rank, final_score, floor(r * 100 + 0.5) / 100 AS recommendation,
             floor(favorite * 100 + 0.5) / 100 AS favorite_match, floor(similar_ * 100 + 0.5) / 100 AS similar_match,
             floor(behavior * 100 + 0.5) / 100 AS behavior_match
           FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY final_score DESC, event_id) AS rank FROM scored)
           WHERE rank <= {LIST_LENGTH}""",
        EVENT_RECS_SQL,
    ),
)
def event_recommendations(r: Roles):
    r.kept("deals").kept("event_artists", "followings")
    users = r.table("customer").select(F.col("c_custkey").alias("id"))
    recs = RE.event_recommendations(
        users, rated_events(r), r.event_artists, rated_artists(r), r.followings, r.interested, r.bookings, AS_OF, LIST_LENGTH
    )
    return recs.select(
        "user_id", "event_id", "rank", "final_score", "recommendation", "favorite_match", "similar_match", "behavior_match"
    )
