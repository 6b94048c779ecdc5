"""Reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits as A
from ..operators import merge_venues as MV
from .matching_queries import CATALOG_SQL, catalog, hall_use
from .registry import query
from .roles import AS_OF, Roles, with_roles


@query(
    "missing_counts",
    with_roles(
        "r_events r_event_artists",
        """SELECT 'poster_url' AS field, count(*) FILTER (poster_url IS NULL) AS missing FROM catalog UNION ALL
           SELECT 'artist_id', count(*) FILTER (artist_id IS NULL) FROM catalog UNION ALL
           SELECT 'genre', 0 UNION ALL SELECT 'duration', count(*) FROM catalog""",
        CATALOG_SQL,
    ),
)
def missing_counts(r: Roles):
    return A.missing_counts(catalog(r), ["poster_url", "artist_id", "genre", "duration"], ["artist_id"])


@query("duplicate_counts", "SELECT sum(n) AS duplicate_rows FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)")
def duplicate_counts(r: Roles):
    return A.duplicate_row_count(r.table("documents"), "text")


@query(
    "duplicate_groups",
    with_roles("r_events", """SELECT title AS value, count(*) AS n, count(DISTINCT venue_id) AS n_places, count(DISTINCT venue_id) = 1 AS same_place
        FROM r_events GROUP BY 1 HAVING count(*) > 1"""),
)
def duplicate_groups(r: Roles):
    return A.duplicate_groups(r.events, "title", "venue_id")


@query("status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(r: Roles):
    return A.status_counts(r.table("orders").withColumnRenamed("o_orderstatus", "status"))


@query("queue_counts", "SELECT o_orderpriority AS task_type, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2")
def queue_counts(r: Roles):
    rows = r.table("orders").select(F.col("o_orderpriority").alias("task_type"), F.col("o_orderstatus").alias("status"))
    return A.two_level_counts(rows, ["task_type", "status"])


@query(
    "queue_pivot",
    """SELECT o_orderpriority AS task_type, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'F') AS F FROM orders GROUP BY 1""",
)
def queue_pivot(r: Roles):
    rows = r.table("orders").select(F.col("o_orderpriority").alias("task_type"), F.col("o_orderstatus").alias("status"))
    return A.status_pivot(rows, ["task_type"], ["O", "F"])


@query(
    "event_dashboard",
    with_roles(
        "r_events r_event_artists",
        """SELECT count(*) AS total, count(*) FILTER (status = 'upcoming') AS upcoming, count(*) FILTER (status = 'on_sale') AS on_sale,
             count(*) FILTER (status = 'ongoing') AS ongoing, count(*) FILTER (status = 'ended') AS ended, 0 AS needs_end_update,
             count(*) FILTER (id NOT IN (SELECT event_id FROM r_event_artists)) AS unlinked FROM r_events""",
    ),
)
def event_dashboard(r: Roles):
    led = r.event_artists.groupBy(F.col("event_id").alias("id")).agg(F.min("artist_id").alias("artist_id"))
    return A.event_dashboard(r.events.join(led, "id", "left"), AS_OF)


@query(
    "enrichment_counts",
    """SELECT count(*) FILTER (o_orderstatus = 'F') AS enriched, count(*) FILTER (o_orderstatus = 'O') AS pending,
         count(*) FILTER (o_orderstatus = 'P') AS skipped, 0 AS failed FROM orders""",
)
def enrichment_counts(r: Roles):
    status = F.when(F.col("o_orderstatus") == "F", "enriched").when(F.col("o_orderstatus") == "P", "skipped")
    return A.enrichment_counts(r.table("orders").select(status.alias("enrichment_status")))


@query(
    "recent_fixes",
    "SELECT event_type AS fix_method, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY 1",
)
def recent_fixes(r: Roles):
    log = r.table("events").select(F.col("event_type").alias("fix_method"), F.col("ts").cast("timestamp").alias("fixed_at"))
    return A.recent_fix_counts(log, "2024-01-31T00:00:00")


USERS_SQL = """rollup AS (SELECT c_custkey AS id, lower(c_mktsegment) || c_custkey AS display_name, coalesce(b.n, 0) AS booking_count, coalesce(f.n, 0) AS following_count,
    CASE WHEN c_acctbal > 0 THEN 'active' ELSE 'pending' END AS account_status FROM customer
  LEFT JOIN (SELECT user_id, count(*) AS n FROM r_bookings GROUP BY 1) b ON b.user_id = c_custkey
  LEFT JOIN (SELECT user_id, count(*) AS n FROM r_followings GROUP BY 1) f ON f.user_id = c_custkey)"""


def users(r: Roles):
    key = F.col("c_custkey")
    mail = F.concat(F.lower("c_mktsegment"), key.cast("string"), F.lit("@example.com"))
    return r.table("customer").select(
        key.alias("id"), mail.alias("email"), F.when(F.col("c_acctbal") > 0, F.lit("2024-01-02")).alias("last_sign_in_at"),
        F.date_add(F.lit("2023-12-01").cast("date"), (key % 60).cast("int")).alias("created_at"),
    )


@query("user_rollup", with_roles("r_bookings r_followings", "SELECT * FROM rollup", USERS_SQL))
def user_rollup(r: Roles):
    rows = A.user_rollup(users(r), r.bookings, r.followings)
    return rows.select("id", "display_name", "booking_count", "following_count", "account_status")


@query(
    "user_stats",
    """SELECT count(*) AS total, count(*) FILTER (c_acctbal <= 0) AS pending,
         count(*) FILTER (DATE '2023-12-01' + CAST(c_custkey % 60 AS INTEGER) >= DATE '2024-01-13') AS recent FROM customer""",
)
def user_stats(r: Roles):
    return A.user_stats(A.user_rollup(users(r), r.bookings, r.followings), AS_OF)


@query(
    "link_coverage",
    with_roles(
        "r_events r_event_artists",
        """SELECT count(*) AS total, count(*) FILTER (bare) AS without_column, count(*) FILTER (linked) AS with_edges,
             count(*) FILTER (bare AND linked) AS only_edges, count(*) FILTER (bare AND NOT linked) AS unlinked,
             CAST(floor(count(*) FILTER (bare) * 100 / count(*) + 0.5) AS BIGINT) AS without_pct
           FROM (SELECT genre IN ('PROMO', 'SMALL') AS bare, id IN (SELECT event_id FROM r_event_artists) AS linked FROM r_events)""",
    ),
)
def link_coverage(r: Roles):
    direct = F.when(~F.col("genre").isin("PROMO", "SMALL"), F.col("genre"))
    return A.coverage(r.events.withColumn("artist_id", direct), r.event_artists, "artist_id")


@query(
    "provider_histogram",
    """SELECT n_providers, count(*) AS n_events FROM (SELECT l_orderkey, count(DISTINCT l_returnflag) AS n_providers FROM lineitem GROUP BY 1) GROUP BY 1""",
)
def provider_histogram(r: Roles):
    links = r.table("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("booking_links"))
    return A.provider_histogram(links).select(F.col("n_providers").cast("long").alias("n_providers"), "n_events")


@query(
    "unlinked_by_source",
    "SELECT source AS source_name, count(*) AS n FROM documents WHERE lang <> 'en' GROUP BY 1",
)
def unlinked_by_source(r: Roles):
    rows = r.table("documents").select(F.col("source").alias("source_name"), F.when(F.col("lang") == "en", F.col("lang")).alias("artist_id"))
    return A.unlinked_by_source(rows)


AUDITED_SQL = """named AS (SELECT CASE o_orderstatus WHEN 'F' THEN '서울 ' WHEN 'O' THEN 'big ' ELSE '부산 공연 ' END || CASE o_orderpriority WHEN '1-URGENT' THEN '대극장' ELSE o_orderpriority END AS name FROM orders)"""


@query(
    "venue_audit",
    f"""WITH {AUDITED_SQL} SELECT 'total' AS class, count(*) AS n FROM named UNION ALL SELECT 'title_words', count(*) FROM named WHERE contains(name, '공연')
        UNION ALL SELECT 'hall', count(*) FROM named WHERE contains(name, '대극장') AND NOT contains(name, '공연')
        UNION ALL SELECT 'address', count(*) FROM named WHERE name LIKE '서울%' OR name LIKE '부산%'
        UNION ALL SELECT 'duplicate_names', count(*) FROM (SELECT name FROM named GROUP BY 1 HAVING count(*) > 1)""",
)
def venue_audit(r: Roles):
    region = F.when(F.col("o_orderstatus") == "F", "서울 ").when(F.col("o_orderstatus") == "O", "big ").otherwise("부산 공연 ")
    hall = F.when(F.col("o_orderpriority") == "1-URGENT", "대극장").otherwise(F.col("o_orderpriority"))
    return A.venue_audit(r.table("orders").select(F.concat(region, hall).alias("name")))


@query(
    "venue_cleanup",
    """WITH v AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'hall ' || n_name || '예매하기 x' WHEN 1 THEN '킨텍스 제' || s_nationkey || '전시장'
           WHEN 2 THEN 'VIP ' || s_suppkey ELSE 'hall ' || n_name END AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey),
         u AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1),
         k AS (SELECT v.*, first_value(id) OVER (PARTITION BY lower(trim(name)) ORDER BY coalesce(u.n, 0) DESC, id) AS keep FROM v LEFT JOIN u ON l_suppkey = id WHERE id % 4 <> 0)
       SELECT id, 'relink' AS action, split_part(name, '예매하기', 1) AS target_name, NULL AS target_id FROM v WHERE id % 4 = 0
       UNION ALL SELECT id, CASE WHEN id <> keep THEN 'merge_exact' WHEN id % 4 = 2 THEN 'drop' ELSE 'merge_hall' END,
         CASE WHEN id = keep AND id % 4 = 1 THEN '킨텍스' END, CASE WHEN id <> keep THEN keep END FROM k WHERE id <> keep OR id % 4 IN (1, 2)""",
)
def venue_cleanup(r: Roles):
    nations = r.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    key = F.col("s_suppkey")
    name = (
        F.when(key % 4 == 0, F.concat(F.lit("hall "), "n_name", F.lit("예매하기 x")))
        .when(key % 4 == 1, F.concat(F.lit("킨텍스 제"), F.col("s_nationkey").cast("string"), F.lit("전시장")))
        .when(key % 4 == 2, F.concat(F.lit("VIP "), key.cast("string"))).otherwise(F.concat(F.lit("hall "), "n_name"))
    )
    venues = r.table("supplier").join(nations, "s_nationkey").select(key.alias("id"), name.alias("name"))
    return MV.cleanup_plan(venues, hall_use(r)).select("id", "action", "target_name", "target_id")


@query(
    "bookings_view",
    with_roles(
        "r_events r_bookings",
        """SELECT user_id, event_id, b.status, title AS event_title, lower(venue_id) AS venue_name, c_name AS user_name
           FROM r_bookings b LEFT JOIN r_events e ON e.id = b.event_id LEFT JOIN customer ON c_custkey = user_id""",
    ),
)
def bookings_view(r: Roles):
    venues = r.table("part").select(F.col("p_brand").alias("id"), F.lower("p_brand").alias("name")).distinct()
    people = r.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    rows = A.bookings_view(r.bookings, r.events, venues, people)
    return rows.select("user_id", "event_id", "status", "event_title", "venue_name", "user_name")


@query(
    "link_issues",
    with_roles("r_events r_reviews", "SELECT event_id, title AS event_title, genre = 'PROMO' AS resolved FROM r_reviews JOIN r_events ON id = event_id"),
)
def link_issues(r: Roles):
    events = r.events.withColumn("booking_url", F.when(F.col("genre") == "PROMO", "https://x"))
    return A.link_issues(r.reviews.select("event_id"), events).select("event_id", "event_title", "resolved")


@query(
    "enrichment_backlog",
    with_roles(
        "r_artists r_event_artists",
        "SELECT id, name, count(*) AS n_events FROM r_artists JOIN r_event_artists ON artist_id = id WHERE followers_count > 5000 GROUP BY 1, 2",
    ),
)
def enrichment_backlog(r: Roles):
    artists = r.artists.withColumn("checked", F.when(F.col("followers_count") <= 5000, F.lit(1)))
    bare = r.events.withColumn("artist_id", F.lit(None).cast("long"))
    return A.enrichment_backlog(artists, bare, r.event_artists, "checked")


@query(
    "attention_counts",
    "SELECT count(*) FILTER (o_orderstatus = 'P') AS open_orders, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders",
)
def attention_counts(r: Roles):
    return A.count_where(r.table("orders"), open_orders=F.col("o_orderstatus") == "P", urgent=F.col("o_orderpriority") == "1-URGENT")


@query(
    "completeness",
    with_roles("r_events r_event_artists", "SELECT id, len(list_filter([CASE WHEN poster_url IS NULL THEN 1 END, 1, 1, 1, 1, 1], lambda x: x IS NOT NULL)) AS n_missing FROM catalog", CATALOG_SQL),
)
def completeness(r: Roles):
    from ..functions.validate import EVENT_FIELDS, EVENT_TEXT_FIELDS, missing_fields

    return catalog(r).select("id", F.size(missing_fields(EVENT_FIELDS, EVENT_TEXT_FIELDS)).cast("long").alias("n_missing"))

