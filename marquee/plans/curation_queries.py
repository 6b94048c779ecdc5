"""Upsert, lifecycle, quality and enrichment over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.dates import at
from ..operators import enrich as EN
from ..operators import lifecycle as LC
from ..operators import listing as LS
from ..operators import lookups as LK
from ..operators import quality as Q
from ..operators import upsert as U
from .matching_queries import CATALOG_SQL, catalog
from ..session import cut_lineage, spread
from .registry import query
from .roles import AS_OF, Roles, with_roles

_NOW = "DATE '2024-01-20'"


def none(t: str = "string"):
    return F.lit(None).cast(t)


# --- status ------------------------------------------------------------------------------
STATE_SQL = """state AS (
  SELECT *, CASE id % 5 WHEN 0 THEN 'ended' WHEN 1 THEN 'ongoing' WHEN 2 THEN 'upcoming' ELSE 'on_sale' END AS old_status,
    id % 7 = 0 AS pinned, CASE WHEN id % 4 = 0 THEN start_date - 1 END AS closing, CASE WHEN id % 6 > 0 THEN end_date END AS last_day FROM r_events),
  swept AS (SELECT *, CASE WHEN pinned THEN old_status WHEN coalesce(last_day, start_date) < DATE '2024-01-20' THEN 'ended'
    WHEN start_date <= DATE '2024-01-20' AND last_day >= DATE '2024-01-20' THEN 'ongoing'
    WHEN start_date > DATE '2024-01-20' AND ticket_open_date > DATE '2024-01-20' AND old_status NOT IN ('ended', 'ongoing', 'upcoming') THEN 'upcoming'
    WHEN start_date > DATE '2024-01-20' AND ticket_open_date <= DATE '2024-01-20' AND (closing IS NULL OR closing >= DATE '2024-01-20')
      AND old_status NOT IN ('ended', 'ongoing', 'on_sale') THEN 'on_sale' ELSE old_status END AS new_status FROM state)"""


def stateful(r: Roles) -> DataFrame:
    """Events with a stored status that may be out of date, some pinned, some without an end."""
    key = F.col("id")
    status = F.when(key % 5 == 0, "ended").when(key % 5 == 1, "ongoing").when(key % 5 == 2, "upcoming").otherwise("on_sale")
    return r.events.withColumns({
        "status": status,
        "locked_fields": F.when(key % 7 == 0, F.array(F.lit("status"))).otherwise(F.array().cast("array<string>")),
        "ticket_close_date": F.when(key % 4 == 0, F.date_sub("start_date", 1)),
        "end_date": F.when(key % 6 > 0, F.col("end_date")),
    })


@query("status_sweep", with_roles("r_events", "SELECT id, new_status AS status FROM swept", STATE_SQL))
def status_sweep(r: Roles):
    return LC.sweep(stateful(r), AS_OF)[0].select("id", "status")


@query(
    "status_changes",
    with_roles(
        "r_events",
        "SELECT id AS event_id, 'status' AS field_name, old_status AS old_value, new_status AS new_value FROM swept WHERE old_status <> new_status",
        STATE_SQL,
    ),
)
def status_changes(r: Roles):
    return LC.sweep(stateful(r), AS_OF)[1]


@query(
    "bulk_status",
    with_roles(
        "r_events",
        "SELECT id, CASE WHEN id % 3 = 0 THEN 'ended' ELSE old_status END AS status, pinned OR id % 3 = 0 AS pinned FROM state",
        STATE_SQL,
    ),
)
def bulk_status(r: Roles):
    edits = r.events.select("id", F.when(F.col("id") % 3 == 0, "ended").otherwise("nonsense").alias("new_status"))
    out = LC.set_status(stateful(r), edits)
    return out.select("id", "status", F.array_contains("locked_fields", "status").alias("pinned"))


@query(
    "edited_fields",
    with_roles("r_events", """SELECT id, CASE WHEN has_timetable THEN 'edited ' || id ELSE title END AS title,
        CASE WHEN NOT has_timetable THEN genre END AS genre, CASE WHEN has_timetable THEN 2 ELSE 0 END AS n_locks FROM r_events"""),
)
def edited_fields(r: Roles):
    """Events with a timetable get a new title and lose their genre."""
    events = r.events.withColumn("locked_fields", F.array().cast("array<string>"))
    title = F.struct(F.lit("title").alias("field"), F.concat(F.lit("edited "), F.col("id").cast("string")).alias("value"))
    genre = F.struct(F.lit("genre").alias("field"), F.lit("").alias("value"))
    edits = events.filter("has_timetable").select("id", F.explode(F.array(title, genre)).alias("e")).select("id", "e.*")
    out = LC.edit_fields(events, edits, ["title", "genre"])
    return out.select("id", "title", "genre", F.size("locked_fields").alias("n_locks"))


@query(
    "visibility_edits",
    with_roles("r_events", "SELECT id, id % 3 = 0 AS is_hidden, CASE WHEN id % 3 = 0 THEN 'why' END AS hidden_reason FROM r_events WHERE id % 3 <> 2"),
)
def visibility_edits(r: Roles):
    events = r.events.withColumns({"is_hidden": F.col("id") % 2 == 0, "hidden_at": none("timestamp"), "hidden_reason": none()})
    action = F.when(F.col("id") % 3 == 0, "hide").when(F.col("id") % 3 == 1, "restore").otherwise("delete")
    actions = events.select("id", action.alias("action"), F.lit("why").alias("reason"))
    return LC.hide_or_restore(events, actions, AS_OF).select("id", "is_hidden", "hidden_reason")


@query(
    "hidden_old_events",
    """SELECT o_orderkey AS id, o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '2000-01-01' - INTERVAL 180 DAY AS is_hidden FROM orders""",
)
def hidden_old_events(r: Roles):
    orders = r.table("orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "ended").otherwise("on_sale").alias("status"),
        F.col("o_orderdate").alias("start_date"), none("timestamp").alias("end_date"), F.lit(False).alias("is_hidden"),
        none("timestamp").alias("hidden_at"), none().alias("hidden_reason"),
    )
    return LC.hide_old(orders, "2000-01-01T00:00:00").select("id", "is_hidden")


@query(
    "hidden_unlinked",
    with_roles(
        "r_events r_event_artists",
        f"""SELECT id, artist_id IS NULL AND poster_url IS NULL AND coalesce(st = 'no_artist' OR (id % 3 = 0 AND st IS NULL) OR (st IS NULL AND created_at < {_NOW} - INTERVAL 3 DAY), FALSE) AS is_hidden
            FROM (SELECT *, CASE id % 4 WHEN 0 THEN 'no_artist' WHEN 1 THEN 'multi_artist' END AS st FROM catalog)""",
        CATALOG_SQL,
    ),
)
def hidden_unlinked(r: Roles):
    key = F.col("id")
    events = catalog(r).withColumns({
        "artist_link_status": F.when(key % 4 == 0, "no_artist").when(key % 4 == 1, "multi_artist"),
        "enrich_attempted_at": F.when(key % 3 == 0, at(AS_OF)), "crawled_at": F.col("created_at"),
        "hidden_at": none("timestamp"), "hidden_reason": none(),
    })
    return LC.hide_unlinked(events, AS_OF).select("id", "is_hidden")


@query(
    "without_non_music",
    with_roles(
        "r_events r_artists r_event_artists",
        "SELECT event_id, artist_id FROM r_event_artists JOIN r_artists ON id = artist_id WHERE followers_count > 0",
    ),
)
def without_non_music(r: Roles):
    artists = r.artists.withColumn("is_music_artist", F.col("followers_count") > 0)
    events = catalog(r).withColumns({"artist_link_status": none(), "enrich_attempted_at": none("timestamp")})
    return LC.drop_non_music(events, artists, r.event_artists)[2].select("event_id", "artist_id")


# --- runs --------------------------------------------------------------------------------
@query(
    "crawl_jobs",
    """SELECT event_type AS source_name, CAST(ts AS DATE) AS day, count(*) FILTER (event_type <> 'error') AS events_found,
         count(*) FILTER (value < 10 AND event_type <> 'error') AS events_upserted, count(*) FILTER (value >= 10 AND event_type <> 'error') AS events_skipped,
         count(*) FILTER (event_type = 'error') AS error_count,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status FROM events GROUP BY 1, 2""",
)
def crawl_jobs(r: Roles):
    ok = F.col("event_type") != "error"
    outcomes = r.table("events").select(
        F.col("event_type").alias("source_name"), F.col("ts").cast("date").alias("day"),
        F.when(ok & (F.col("value") < 10), "updated").when(ok, "skipped").alias("action"), F.when(~ok, "http").alias("error"),
    )
    return LC.job_outcome(outcomes, ["source_name", "day"])


JOBS_SQL = """jobs AS (SELECT user_id AS source, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'purchase') AS found FROM events GROUP BY 1, 2)"""


def crawl_history(r: Roles) -> DataFrame:
    return r.table("events").groupBy(F.col("user_id").alias("source"), F.col("ts").cast("date").alias("day")).agg(
        F.count_if(F.col("event_type") == "purchase").alias("found")
    )


@query(
    "zero_runs",
    f"""WITH {JOBS_SQL}, n AS (SELECT *, row_number() OVER w AS rn FROM jobs WINDOW w AS (PARTITION BY source ORDER BY day)),
        z AS (SELECT *, max(CASE WHEN found > 0 THEN rn END) OVER (PARTITION BY source ORDER BY day) AS hit FROM n)
        SELECT source, day, found, CASE WHEN found > 0 THEN 0 ELSE rn - coalesce(hit, 0) END AS zero_run,
          found = 0 AND rn - coalesce(hit, 0) >= 3 AS alarm FROM z""",
)
def zero_runs(r: Roles):
    return LC.structure_alarms(crawl_history(r), "source", "day", "found", "day")


@query(
    "run_history",
    """SELECT user_id AS run, coalesce(array_to_string(list_sort(list_distinct(list('s' || event_id % 8) FILTER (event_type = 'error'))), ';'), '') AS failed_steps, count(*) AS step_count,
         CASE WHEN count(*) FILTER (value > 100) > 0 THEN 'failed' WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'partial' ELSE 'done' END AS status FROM events GROUP BY 1""",
)
def run_history(r: Roles):
    steps = r.table("events").select(
        F.col("user_id").alias("run"), F.concat(F.lit("s"), (F.col("event_id") % 8).cast("string")).alias("step_name"),
        F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"), F.when(F.col("value") > 100, "broke").alias("run_error"),
    )
    return LC.run_status(steps, ["run"]).withColumn("failed_steps", F.array_join("failed_steps", ";"))


@query(
    "reset_runs",
    """SELECT event_id AS id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-20' - INTERVAL 15 MINUTE THEN 'failed'
         WHEN event_type = 'view' THEN 'running' ELSE 'done' END AS status FROM events""",
)
def reset_runs(r: Roles):
    runs = r.table("events").select(
        F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "running").otherwise("done").alias("status"),
        F.col("ts").cast("timestamp").alias("started_at"), none("timestamp").alias("finished_at"), none().alias("error"),
    )
    return LC.reset_stale(runs, AS_OF).select("id", "status")


@query(
    "run_health",
    """SELECT 'red' AS level, 'run_missed' AS reason, floor(date_diff('second', max(ts), TIMESTAMP '2024-02-01') / 3600 * 10 + 0.5) / 10 AS gap_hours,
         count(*) FILTER (event_type = 'error') AS queue_failed, count(*) FILTER (event_type = 'signup') AS app_errors FROM events""",
)
def run_health(r: Roles):
    e = r.table("events")
    runs = e.select(F.date_trunc("second", F.col("ts").cast("timestamp")).alias("started_at"), F.lit("done").alias("status"), F.array().cast("array<string>").alias("failed_steps"))
    steps = e.select(F.lit("crawl").alias("step_name"), F.lit("done").alias("status"), F.col("ts").cast("timestamp").alias("started_at"))
    queue = e.select(F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"))
    artists = r.artists.select(none().alias("name_proposal"))
    logs = e.select((F.col("event_type") != "signup").alias("is_resolved"))
    row = LC.health(runs, steps, queue, artists, logs, "2024-02-01T00:00:00")
    return row.select("level", "reason", "gap_hours", "queue_failed", "app_errors")


@query(
    "flat_metrics",
    """SELECT 's' || event_id AS step, 'k' AS metric, CAST(json_extract(props, '$.k') AS DOUBLE) AS value FROM events
       UNION ALL SELECT 's' || event_id, 'more.value', value FROM events UNION ALL SELECT 's' || event_id, 'kinds', 2 FROM events""",
)
def flat_metrics(r: Roles):
    e = r.table("events")
    result = F.to_json(F.struct(
        F.get_json_object("props", "$.k").cast("int").alias("k"), F.struct("value").alias("more"),
        F.array("event_type", F.lit("x")).alias("kinds"), F.lit("text").alias("note"),
    ))
    return LC.flat_metrics(e.select(F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("step"), result.alias("result")))


# --- upsert ------------------------------------------------------------------------------
def upsert_sql(batches: int = 1) -> str:
    """The crawl rows of each part applied one after another, as often as there are batches."""
    return f"""WITH RECURSIVE crawl AS (
  SELECT l_partkey AS part, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS row_id, 'https://img/' || l_suppkey AS x,
    CASE l_returnflag WHEN 'A' THEN 'yes24' WHEN 'N' THEN 'festivallife' ELSE 'gemini-search' END AS src,
    CASE l_returnflag WHEN 'A' THEN 70 WHEN 'N' THEN 55 ELSE 20 END AS trust FROM lineitem),
  in_order AS (SELECT part, x, trust, batch, row_number() OVER (PARTITION BY part ORDER BY batch, row_id, src) AS k
    FROM crawl, (SELECT unnest(range({batches})) AS batch)),
  walk AS (SELECT p_partkey AS id, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS batch, false AS taken,
      CASE WHEN p_partkey % 2 = 0 THEN 'https://img/old' END AS v, CASE WHEN p_partkey % 2 = 0 THEN 55 ELSE -1 END AS t FROM part
    UNION ALL
    SELECT id, k, batch, take, CASE WHEN take THEN x ELSE v END, CASE WHEN take THEN trust ELSE t END FROM (
      SELECT w.id, o.k, o.batch, o.x, o.trust, w.v, w.t, w.id % 10 <> 0 AND (w.v IS NULL OR (o.x <> w.v AND o.trust >= w.t)) AS take
      FROM walk w JOIN in_order o ON o.part = w.id AND o.k = w.k + 1)),
  ends AS (SELECT id, arg_max(v, k) AS poster_url, max(k) > 0 AS touched FROM walk GROUP BY 1),
  links AS (SELECT part, count(DISTINCT src) AS n FROM crawl GROUP BY 1),
  merged AS (SELECT id, poster_url, touched, p_size > 25 AND touched AS by_genre, p_type, coalesce(n, 0) + 1 AS n_links,
      CASE WHEN id % 2 = 0 THEN 'https://img/old' END AS old_poster
    FROM ends JOIN part ON p_partkey = id LEFT JOIN links ON part = id)"""


def stored_events(r: Roles) -> DataFrame:
    """Parts as stored events: even ones have a poster of middling trust, every tenth has it locked."""
    key = F.col("p_partkey")
    text = key.cast("string")
    stamp = F.create_map(F.lit("poster_url"), F.struct(F.lit("festivallife").alias("source"), at(AS_OF).alias("at")))
    genre_stamp = F.create_map(F.lit("genre"), F.struct(F.when(F.col("p_size") > 25, "gemini-search").otherwise("enrich").alias("source"), at(AS_OF).alias("at")))
    return r.table("part").select(
        text.alias("id"), F.concat("p_name", F.lit(" "), text).alias("title"), F.concat("p_name", F.lit(" "), text).alias("normalized_title"),
        F.concat(F.lit("key"), text).alias("dedup_key"), none().alias("artist_id"), F.col("p_brand").alias("venue_id"),
        F.when(key % 2 == 0, "https://img/old").alias("poster_url"), F.lit("2024-01-01").cast("timestamp").alias("start_date"),
        none("timestamp").alias("end_date"), none("timestamp").alias("ticket_open_date"), none().alias("ticket_provider"), none().alias("booking_url"),
        F.lit("old").alias("genre"), F.lit("upcoming").alias("status"),
        F.array(F.struct(F.lit("seed").alias("site"), F.concat(F.lit("https://seed/"), text).alias("url"))).alias("source_urls"),
        F.array().cast("array<struct<provider:string,label:string,url:string>>").alias("booking_links"),
        F.when(key % 10 == 0, F.array(F.lit("poster_url"))).otherwise(F.array().cast("array<string>")).alias("locked_fields"),
        F.map_concat(stamp, genre_stamp).alias("field_sources"), none().alias("description"), F.lit("seed").alias("source_name"),
        F.lit("2024-01-01").cast("timestamp").alias("created_at"), none("timestamp").alias("crawled_at"), F.lit(False).alias("is_hidden"),
        none().alias("hidden_reason"), none("timestamp").alias("hidden_at"), F.lit(False).alias("has_timetable"),
    )


def crawl_batch(r: Roles) -> DataFrame:
    part = r.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    text = F.col("l_partkey").cast("string")
    source = F.when(F.col("l_returnflag") == "A", "yes24").when(F.col("l_returnflag") == "N", "festivallife").otherwise("gemini-search")
    title = F.concat("p_name", F.lit(" "), text)
    return spread(r.table("lineitem")).join(part, "l_partkey").select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10000000 + F.col("l_partkey")).alias("row_id"), title.alias("title"), title.alias("normalized_title"),
        F.concat(F.lit("key"), text).alias("dedup_key"), F.concat(F.lit("https://img/"), F.col("l_suppkey").cast("string")).alias("poster_url"),
        F.lit("2024-01-01").cast("date").alias("start_date"), none("date").alias("end_date"), none("timestamp").alias("ticket_open_date"),
        none().alias("ticket_provider"), none().alias("booking_url"), F.lit("upcoming").alias("status"), F.col("p_type").alias("genre"),
        none().alias("description"), none().alias("artist_id"), none().alias("venue_id"), source.alias("source_name"),
        F.array(F.struct(source.alias("site"), F.concat(F.lit("https://"), source, F.lit("/"), text).alias("url"))).alias("source_urls"),
    )


@query(
    "upserted_events",
    f"""{upsert_sql()}
        SELECT CAST(id AS VARCHAR) AS id, poster_url, CASE WHEN by_genre THEN p_type ELSE 'old' END AS genre, n_links FROM merged""",
)
def upserted_events(r: Roles):
    table = U.upsert(crawl_batch(r), stored_events(r), AS_OF)["events"]
    return table.select("id", "poster_url", "genre", F.size("source_urls").cast("long").alias("n_links"))


@query(
    "upsert_changes",
    f"""{upsert_sql()}
        SELECT CAST(id AS VARCHAR) AS event_id, 'poster_url' AS field_name, old_poster AS old_value, poster_url AS new_value
          FROM merged WHERE poster_url IS DISTINCT FROM old_poster
        UNION ALL SELECT CAST(id AS VARCHAR), 'genre', 'old', p_type FROM merged WHERE by_genre""",
)
def upsert_changes(r: Roles):
    return U.real_changes(U.upsert(crawl_batch(r), stored_events(r), AS_OF)["changes"])


@query(
    "upsert_actions",
    f"""{upsert_sql(2)}
        SELECT CAST(id AS VARCHAR) AS event_id, batch + 1 AS batch, CASE WHEN batch = 0 OR bool_or(taken) THEN 'updated' ELSE 'skipped' END AS action
        FROM walk WHERE batch >= 0 GROUP BY id, batch""",
)
def upsert_actions(r: Roles):
    """The same batch twice: what moves again, as rows apply in order, is an update."""
    batch = cut_lineage(crawl_batch(r))
    once = U.upsert(batch, stored_events(r), AS_OF)
    again = U.upsert(batch, once["events"], AS_OF)
    said = lambda out, n: out["actions"].select("event_id", F.lit(n).cast("long").alias("batch"), "action")
    return said(once, 1).union(said(again, 2))


@query(
    "inserted_events",
    """SELECT p_name || ' ' || p_partkey AS title, count(DISTINCT l_returnflag) AS n_links, 'inserted' AS action FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1""",
)
def inserted_events(r: Roles):
    out = U.upsert(crawl_batch(r), stored_events(r).limit(0), AS_OF, hold=True)
    acted = out["actions"].withColumnRenamed("event_id", "id")
    return out["events"].filter("is_hidden").join(acted, "id").select("title", F.size("source_urls").cast("long").alias("n_links"), "action")


@query(
    "real_changes",
    """SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F'""",
)
def real_changes(r: Roles):
    """Dates rewritten in another notation are no change; moved ones are."""
    day = F.col("o_orderdate")
    log = r.table("orders").select(
        F.col("o_orderkey").alias("id"), day.cast("date").cast("string").alias("old_value"),
        F.when(F.col("o_orderstatus") == "F", F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(F.date_add(day.cast("date"), 1).cast("string")).alias("new_value"),
    )
    return U.real_changes(log).select("id")


# --- quality -----------------------------------------------------------------------------
def documents_as_events(r: Roles) -> DataFrame:
    return r.table("documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("title"), F.when(F.col("lang") == "en", F.col("source")).alias("venue_id"),
        F.when(F.col("lang") == "fr", F.col("source")).alias("artist_id"), F.when(F.col("lang") != "de", F.lit("2024-01-01")).alias("start_date"),
        F.lit("2024-01-01").cast("timestamp").alias("created_at"),
    )


@query(
    "quality_issues",
    """SELECT issue, count(*) AS n FROM (SELECT 'event_no_venue_artist' AS issue FROM documents WHERE lang NOT IN ('en', 'fr')
         UNION ALL SELECT 'event_no_start_date' FROM documents WHERE lang = 'de'
         UNION ALL SELECT 'event_title_too_short' FROM documents WHERE length(trim(text)) <= 2
         UNION ALL SELECT 'event_title_url' FROM documents WHERE regexp_matches(text, '(?i)https?://|www\\.')) GROUP BY 1""",
)
def quality_issues(r: Roles):
    return Q.issue_counts(Q.scan(documents_as_events(r), "event")).select("issue", "n")


ADDRESSED_SQL = """addressed AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'VIP ' || o_orderpriority ELSE 'hall ' || o_orderkey END AS name,
  CASE o_orderpriority WHEN '1-URGENT' THEN '110,000원' WHEN '2-HIGH' THEN 'www.hall' WHEN '3-MEDIUM' THEN 'big DOME'
    WHEN '5-LOW' THEN CASE o_orderstatus WHEN 'F' THEN 'VIP 5-LOW' ELSE 'hall ' || o_orderkey END ELSE '서울시 1' END AS address FROM orders)"""


def addressed(r: Roles) -> DataFrame:
    """Orders as venues with names and addresses that are wrong in every way the rules know."""
    status, level, key = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderkey").cast("string")
    name = F.when(status == "F", F.concat(F.lit("VIP "), level)).otherwise(F.concat(F.lit("hall "), key))
    address = (
        F.when(level == "1-URGENT", "110,000원").when(level == "2-HIGH", "www.hall").when(level == "3-MEDIUM", "big DOME")
        .when(level == "5-LOW", name).otherwise("서울시 1")
    )
    return r.table("orders").select(
        F.col("o_orderkey").alias("id"), name.alias("name"), address.alias("address"), F.lit("2024-01-01").cast("timestamp").alias("created_at")
    )


@query(
    "fixed_venues",
    f"""WITH {ADDRESSED_SQL} SELECT id, CASE WHEN name NOT LIKE 'VIP%' THEN name END AS name, CASE WHEN address = '서울시 1' THEN address END AS address FROM addressed""",
)
def fixed_venues(r: Roles):
    queue = r.spark.createDataFrame([], "entity_id string, task_type string, status string")
    return Q.auto_fix(addressed(r), "venue", queue)[0].select("id", "name", "address")


@query(
    "fix_log",
    f"""WITH {ADDRESSED_SQL} SELECT issue, count(*) AS n FROM (
          SELECT 'venue_name_contaminated' AS issue FROM addressed WHERE name LIKE 'VIP%' UNION ALL
          SELECT CASE WHEN address LIKE '%원' THEN 'venue_address_price' WHEN address LIKE 'www%' THEN 'venue_address_url'
            WHEN address LIKE '%DOME' THEN 'venue_address_looks_like_name' ELSE 'venue_address_same_as_name' END FROM addressed WHERE address <> '서울시 1') GROUP BY 1""",
)
def fix_log(r: Roles):
    queue = r.spark.createDataFrame([], "entity_id string, task_type string, status string")
    return Q.auto_fix(addressed(r), "venue", queue)[1].groupBy("issue").agg(F.count("*").alias("n"))


@query(
    "removal_candidates",
    f"""WITH {ADDRESSED_SQL} SELECT CAST(id AS VARCHAR) AS entity_id, 'uncertain' AS verdict FROM addressed WHERE name LIKE 'VIP%'""",
)
def removal_candidates(r: Roles):
    return Q.removal_candidates(addressed(r), "venue", AS_OF).select("entity_id", "verdict")


VERDICT_SQL = """shown AS (SELECT p_partkey AS id, CASE WHEN p_type = 'PROMO' THEN p_name || ' concert' ELSE p_name || ' ' || CASE WHEN p_name LIKE '%anvil' THEN 'gallery' ELSE 'night' END END AS title, p_type FROM part),
  judged AS (SELECT *, CASE WHEN title LIKE '%concert' THEN 'keep' WHEN title LIKE '%gallery' THEN 'drop' ELSE 'keep' END AS verdict FROM shown)"""


def shown(r: Roles) -> DataFrame:
    word = F.when(F.col("p_name").like("%anvil"), "gallery").otherwise("night")
    title = F.when(F.col("p_type") == "PROMO", F.concat("p_name", F.lit(" concert"))).otherwise(F.concat("p_name", F.lit(" "), word))
    return r.table("part").select(
        F.col("p_partkey").alias("id"), title.alias("title"), F.when(F.col("p_type") == "SMALL", "연극").alias("genre"),
        F.lit("on_sale").alias("status"), F.lit("2024-01-10").cast("timestamp").alias("created_at"), none("timestamp").alias("enrich_attempted_at"),
        F.when(F.col("p_type") == "LARGE", "pending_classification").alias("hidden_reason"), (F.col("p_type") == "LARGE").alias("is_hidden"),
        none("timestamp").alias("hidden_at"),
    )


def empty_cache(r: Roles) -> DataFrame:
    return r.spark.createDataFrame([], "title_key string, verdict string, sample_title string")


@query("title_verdicts", f"WITH {VERDICT_SQL} SELECT id, title, verdict FROM judged")
def title_verdicts(r: Roles):
    return Q.verdicts(shown(r).select("id", "title"), empty_cache(r))[0]


@query(
    "held_events",
    f"""WITH {VERDICT_SQL} SELECT id, p_type = 'LARGE' AND verdict = 'drop' AS is_hidden, CASE WHEN p_type = 'LARGE' AND verdict = 'drop' THEN 'non_concert' END AS hidden_reason FROM judged""",
)
def held_events(r: Roles):
    return Q.reclassify_held(shown(r), empty_cache(r))[0].select("id", "is_hidden", "hidden_reason")


@query(
    "purged_events",
    f"""WITH {VERDICT_SQL} SELECT id, CASE WHEN p_type = 'SMALL' THEN 'genre:연극' ELSE 'verdict:drop' END AS reason FROM judged WHERE p_type = 'SMALL' OR verdict = 'drop'""",
)
def purged_events(r: Roles):
    return Q.purge_non_concerts(shown(r), empty_cache(r), AS_OF)[1].select("id", "reason")


@query(
    "cleanup_reasons",
    f"""WITH {VERDICT_SQL} SELECT id, 'keyword' AS reason FROM judged WHERE verdict = 'drop'""",
)
def cleanup_reasons(r: Roles):
    dated = shown(r).withColumns({"start_date": none("date"), "end_date": none("date")})
    return Q.cleanup_reasons(dated).select("id", "reason")


@query(
    "backfilled_events",
    with_roles("r_events r_event_artists", "SELECT id, CASE WHEN genre = 'PROMO' THEN 'https://ticket.yes24.com/' || id END AS booking_url, CASE WHEN genre = 'PROMO' THEN 'yes24' END AS ticket_provider FROM catalog", CATALOG_SQL),
)
def backfilled_events(r: Roles):
    url = F.concat(F.lit("https://ticket.yes24.com/"), F.col("id").cast("string"))
    link = F.when(F.col("genre") == "PROMO", F.array(F.struct(F.lit("yes24").alias("site"), url.alias("url")))).otherwise(F.col("source_urls"))
    return Q.backfill_fields(catalog(r).withColumn("source_urls", link)).select("id", "booking_url", "ticket_provider")


@query(
    "missing_venue_links",
    with_roles("r_events r_event_artists", "SELECT id AS event_id, venue_id, 0 AS display_order FROM r_events WHERE id NOT IN (SELECT event_id FROM r_event_artists)"),
)
def missing_venue_links(r: Roles):
    return Q.missing_venue_links(r.events, r.event_artists)


@query(
    "needs_enrichment",
    "SELECT event_id FROM events WHERE event_type = 'view' OR ts < TIMESTAMP '2024-01-31' - INTERVAL 14 DAY",
)
def needs_enrichment(r: Roles):
    rows = r.table("events").withColumn("tried", F.when(F.col("event_type") != "view", F.col("ts")))
    return rows.filter(Q.needs_enrichment("tried", "2024-01-31T00:00:00")).select("event_id")


# --- enrichment --------------------------------------------------------------------------
@query(
    "enriched_artists",
    """SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN 'own' ELSE coalesce(max(p_brand) FILTER (FALSE), min(l_returnflag)) END AS label,
         CASE WHEN p_size > 25 THEN FALSE ELSE TRUE END AS filled FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_size""",
)
def enriched_artists(r: Roles):
    """Profiles from three sources; the source order of the flags A, N, R decides the label."""
    source = F.when(F.col("l_returnflag") == "A", "namu").when(F.col("l_returnflag") == "N", "melon").otherwise("wikipedia")
    profiles = r.table("lineitem").select(F.col("l_partkey").alias("artist_id"), source.alias("source"), F.col("l_returnflag").alias("label")).distinct()
    for f in V.PROFILE_FIELDS:
        if f != "label":
            profiles = profiles.withColumn(f, none())
    artists = r.table("part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 25, "own").alias("label"))
    for f in V.PROFILE_FIELDS:
        if f != "label":
            artists = artists.withColumn(f, none())
    artists = artists.withColumns({"enrichment_status": none(), "enrichment_attempted_at": none("timestamp")})
    table, log, _ = EN.enrich_artists(artists, profiles, AS_OF)
    filled = log.select(F.col("artist_id").alias("id"), F.array_contains("added_fields", "label").alias("filled"))
    return table.select("id", "label").join(filled, "id")


@query(
    "enrichment_tasks",
    """SELECT CAST(c_custkey AS VARCHAR) AS entity_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""",
)
def enrichment_tasks(r: Roles):
    artists = r.table("customer").select(
        F.col("c_custkey").alias("id"), none().alias("enrichment_status"), none().alias("name_en"), none().alias("avatar_url"), none().alias("occupation")
    )
    status = F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done")
    queue = r.table("orders").select(F.col("o_custkey").alias("entity_id"), F.lit("clean_data").alias("task_type"), status.alias("status"))
    return EN.enrichment_tasks(artists, queue).select("entity_id")


@query(
    "tidied_queue",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN 'failed' WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-20' - INTERVAL 1 HOUR THEN 'pending'
         WHEN event_type = 'view' THEN 'processing' ELSE 'pending' END AS status FROM events""",
)
def tidied_queue(r: Roles):
    kind = F.col("event_type")
    queue = r.table("events").select(
        "event_id", F.when(kind == "click", "parse_dates").otherwise("clean_data").alias("task_type"),
        F.when(kind == "view", "processing").otherwise("pending").alias("status"), F.col("ts").cast("timestamp").alias("created_at"), none().alias("error"),
    )
    return EN.tidy_queue(queue, AS_OF).select("event_id", "status")


@query(
    "next_tasks",
    "SELECT event_id FROM events WHERE event_type = 'click' ORDER BY value DESC, ts, CAST(event_id AS VARCHAR) LIMIT 20",
)
def next_tasks(r: Roles):
    queue = r.table("events").filter(F.col("event_type") == "click").select(
        "event_id", F.lit("clean_data").alias("task_type"), F.lit("pending").alias("status"), F.col("value").alias("priority"),
        F.col("ts").alias("created_at"), F.col("event_id").cast("string").alias("entity_id"),
    )
    return EN.next_tasks(queue, 20).select("event_id")


@query(
    "backfilled_lineups",
    with_roles(
        "r_events r_event_artists",
        """SELECT id AS event_id, CASE WHEN l_partkey IS NULL THEN 'missing_raw_payload' ELSE 'missing_artist_candidates' END AS reason FROM r_events
           LEFT JOIN (SELECT l_partkey, arg_max(l_returnflag = 'R', (l_shipdate, l_orderkey * 10 + l_linenumber, l_returnflag = 'R')) AS bare FROM lineitem GROUP BY 1) n
             ON l_partkey = id WHERE l_partkey IS NULL OR bare""",
    ),
)
def backfilled_lineups(r: Roles):
    """Every part linked through the supplier name in its newest order line; returned lines list nobody."""
    from .matching_queries import known_artists

    acts, aliases = known_artists(r)
    named = r.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    listed = F.when(F.col("l_returnflag") == "R", F.array().cast("array<string>")).otherwise(F.array("s_name"))
    payloads = r.table("lineitem").join(named, "l_suppkey").select(
        F.col("l_partkey").alias("event_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lit("yes24").alias("source_name"),
        F.lit("u").alias("source_url"), F.to_json(F.struct(listed.alias("artists"))).alias("parsed_json"), F.col("l_shipdate").alias("crawled_at"),
    )
    events = r.events.withColumn("artist_id", none())
    return EN.backfill_artists(events, payloads, acts, aliases)["issues"].select("event_id", "reason")


@query(
    "lineup_audit",
    with_roles(
        "r_events",
        """SELECT DISTINCT l_partkey AS event_id, 'missing_artist_link' AS reason FROM lineitem UNION
           SELECT DISTINCT l_partkey, 'timetable_artist_mismatch' FROM lineitem WHERE l_returnflag = 'A'""",
    ),
)
def lineup_audit(r: Roles):
    """Payload names against timetable slots that spell the act differently."""
    payloads = spread(r.table("lineitem")).select(
        F.col("l_partkey").alias("event_id"), F.col("l_orderkey").alias("id"), F.lit("yes24").alias("source_name"), F.lit("u").alias("source_url"),
        F.to_json(F.struct(F.array(F.concat(F.lit("act "), F.col("l_suppkey").cast("string"))).alias("artists"))).alias("parsed_json"),
        F.lit(True).alias("processed"),
    )
    slots = r.performances.select("event_id", F.concat(F.lit("Slot of "), F.col("artist_id").cast("string")).alias("artist_name"))
    events = r.events.withColumn("artist_id", none())
    return EN.lineup_audit(payloads, events, slots).select("event_id", "reason")


@query(
    "replaced_lineups",
    with_roles(
        "r_event_artists",
        """SELECT event_id, artist_id, display_order FROM r_event_artists WHERE event_id % 2 = 1 UNION ALL
           SELECT p_partkey, s_suppkey, 0 FROM part JOIN supplier ON s_suppkey = p_size WHERE p_partkey % 2 = 0""",
    ),
)
def replaced_lineups(r: Roles):
    ids = F.when(F.col("p_partkey") % 2 == 0, F.array(F.col("p_size").cast("long")))
    edits = r.table("part").select(F.col("p_partkey").alias("event_id"), ids.alias("artist_ids"))
    edges = r.event_artists.withColumn("role", F.lit("lineup"))
    return LK.replace_links(edges, edits, r.artists).select("event_id", "artist_id", "display_order")


# --- lists -------------------------------------------------------------------------------
@query(
    "event_page",
    with_roles("r_events", "SELECT id, title, start_date FROM r_events WHERE status <> 'ended' AND contains(title, 'ring') ORDER BY start_date DESC, id LIMIT 20 OFFSET 20"),
)
def event_page(r: Roles):
    rows, _ = LS.list_entities(
        r.events, search=(["title"], "RING"), filters=[LS.status_filter(None, False, V.EVENT_STATUSES)],
        sort_by="start_date", sort_allowed=["title", "start_date", "status"], page=2, page_size=20,
    )
    return rows.select("id", "title", "start_date")


@query(
    "event_page_meta",
    with_roles("r_events", "SELECT 2 AS page, 20 AS page_size, count(*) AS total, greatest(1, CAST(ceil(count(*) / 20) AS BIGINT)) AS total_pages FROM r_events WHERE status <> 'ended' AND contains(title, 'ring')"),
)
def event_page_meta(r: Roles):
    _, meta = LS.list_entities(
        r.events, search=(["title"], "ring"), filters=[LS.status_filter(None, False, V.EVENT_STATUSES)], page=2, page_size=20
    )
    return meta


@query(
    "duplicate_titles",
    with_roles("r_events", "SELECT title, count(*) AS n FROM r_events GROUP BY 1 HAVING count(*) > 1"),
)
def duplicate_titles(r: Roles):
    return LS.repeated_values(r.events, "title")


@query(
    "admitted_tasks",
    "SELECT c_custkey AS entity_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
)
def admitted_tasks(r: Roles):
    queue = r.table("orders").select(F.col("o_custkey").alias("entity_id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("status"))
    return LS.admitted(r.table("customer").select(F.col("c_custkey").alias("entity_id")), queue, ["entity_id"])
