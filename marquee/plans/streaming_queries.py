"""The streaming operators, run to the end of the driver's tables read as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import counters, ingest, trends
from ..streaming.sources import drain, stream_table, work_folder
from .curation_queries import stored_events
from .registry import query
from .roles import Roles


def stream(r: Roles, name: str) -> DataFrame:
    return stream_table(r.spark, r.sf_dir, f"{name}.parquet", r.table(name).schema)


@query(
    "streamed_followers",
    """SELECT user_id AS artist_id, greatest(count(*) FILTER (event_type IN ('view', 'click')) - count(*) FILTER (event_type = 'error'), 0) AS followers_count
       FROM events GROUP BY 1""",
)
def streamed_followers(r: Roles):
    kind = F.col("event_type")
    action = F.when(kind.isin("view", "click"), "follow").when(kind == "error", "unfollow").otherwise("other")
    changes = stream(r, "events").select(F.col("user_id").alias("artist_id"), action.alias("action"))
    return counters.current_counts(drain(counters.follower_totals(changes), "update"))


@query(
    "streamed_error_counts",
    """SELECT date_trunc('hour', ts) AS hour, event_type AS error_type, user_id % 3 AS platform, count(*) AS n, count(*) FILTER (value > 10) AS unresolved FROM events
       GROUP BY 1, 2, 3 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def streamed_error_counts(r: Roles):
    logs = stream(r, "events").select(
        F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("error_type"),
        (F.col("user_id") % 3).alias("platform"), (F.col("value") <= 10).alias("is_resolved"),
    )
    counts = drain(trends.error_counts(logs))
    return counts.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query(
    "streamed_trending",
    """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS total FROM events GROUP BY 1, 2),
         last AS (SELECT CAST(max(ts) AS TIMESTAMP) - INTERVAL 1 DAY AS mark FROM events),
         ends AS (SELECT CAST(unnest(range(DATE '2023-12-31', DATE '2024-03-15', INTERVAL 1 DAY)) AS DATE) AS e),
         s AS (SELECT user_id, e, sum(n) AS n, sum(total) AS total, coalesce(sum(n) FILTER (day >= e - 7), 0) AS n_now, coalesce(sum(total) FILTER (day >= e - 7), 0) AS now_
           FROM d JOIN ends ON day < e AND day >= e - 30 WHERE e <= (SELECT mark FROM last) GROUP BY 1, 2)
       SELECT 'artist' AS entity_type, CAST(user_id AS VARCHAR) AS entity_id, CAST(e AS TIMESTAMP) AS window_end,
         CASE WHEN n < 2 OR total <= 0 THEN 0 ELSE floor(coalesce(now_ / nullif(n_now, 0), 0) / (total / n) * 100 * 100 + 0.5) / 100 END AS trending_score FROM s""",
)
def streamed_trending(r: Roles):
    snapshots = stream(r, "events").select(
        F.lit("artist").alias("entity_type"), F.col("user_id").cast("string").alias("entity_id"),
        F.col("value").alias("popularity_score"), F.col("ts").cast("timestamp").alias("captured_at"),
    )
    windows = drain(trends.trending_windows(snapshots))
    return windows.withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


@query("streamed_first_records", "SELECT DISTINCT event_type || user_id AS dedup_key FROM events")
def streamed_first_records(r: Roles):
    """With a watermark of the whole month every key is new once."""
    records = stream(r, "events").select(
        F.concat("event_type", F.col("user_id").cast("string")).alias("dedup_key"), F.col("ts").cast("timestamp").alias("crawled_at")
    )
    return drain(ingest.first_records(records, delay="60 days")).select("dedup_key")


@query(
    "streamed_crawl_alarms",
    """WITH hit AS (SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS t FROM events GROUP BY 1)
       SELECT CAST(e.user_id AS VARCHAR) AS source_name, count(*) FILTER (event_type <> 'purchase' AND (t IS NULL OR ts > t)) AS zero_run,
         count(*) FILTER (event_type <> 'purchase' AND (t IS NULL OR ts > t)) >= 3 AS alarm FROM events e JOIN hit USING (user_id) GROUP BY 1""",
)
def streamed_crawl_alarms(r: Roles):
    jobs = stream(r, "events").select(
        F.col("user_id").cast("string").alias("source_name"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("events_found"),
    )
    states = drain(ingest.crawl_alarms(jobs), "update")
    return states.groupBy("source_name").agg(F.max_by(F.struct("zero_run", "alarm"), "epoch").alias("s")).select("source_name", "s.*")


@query(
    "streamed_intents",
    """SELECT i.user_id, i.e AS event_id, i.ts AS attempted_at, b.ts AS booked_at, CASE WHEN b.ts IS NULL THEN 'skipped' ELSE 'booked' END AS outcome
       FROM (SELECT *, event_id % 5 AS e FROM events WHERE event_type = 'click') i LEFT JOIN (SELECT *, event_id % 5 AS e FROM events WHERE event_type = 'purchase') b
         ON b.user_id = i.user_id AND b.e = i.e AND b.ts >= i.ts AND b.ts <= i.ts + INTERVAL 7 DAY
       WHERE b.ts IS NOT NULL OR i.ts + INTERVAL 7 DAY < (SELECT min(m) FROM (SELECT max(ts) AS m FROM events WHERE event_type IN ('click', 'purchase') GROUP BY event_type)) - INTERVAL 1 DAY""",
)
def streamed_intents(r: Roles):
    def side(kind: str, time: str) -> DataFrame:
        rows = stream(r, "events").filter(F.col("event_type") == kind)
        return rows.select("user_id", F.col("event_id"), (F.col("event_id") % 5).alias("e"), F.col("ts").cast("timestamp").alias(time))

    intents = side("click", "attempted_at").select("user_id", F.col("e").alias("event_id"), "attempted_at", F.col("event_id").alias("intent"))
    bookings = side("purchase", "booked_at").select("user_id", F.col("e").alias("event_id"), "booked_at")
    out = drain(trends.intent_outcomes(intents, bookings))
    ntz = {c: F.col(c).cast("timestamp_ntz") for c in ("attempted_at", "booked_at")}
    return out.withColumns(ntz)


@query(
    "streamed_ingest",
    """SELECT p_name || ' ' || p_partkey AS title, 1 + p_partkey % 2 AS n_links, count(*) AS n_events FROM part GROUP BY 1, 2""",
)
def streamed_ingest(r: Roles):
    """Two crawls of the parts as streamed payloads, the second again as after a failure, then compacted."""
    part, key = r.table("part"), F.col("p_partkey").cast("string")

    def crawl(site: str) -> DataFrame:
        record = F.struct(
            F.concat(F.lit(f"https://ticket.{site}.com/"), key).alias("sourceUrl"), F.lit(site).alias("sourceName"),
            F.concat("p_name", F.lit(" "), key).alias("title"), F.lit("2026.08.01").alias("startDate"), F.lit("on_sale").alias("status"))
        return part.select(F.concat(F.lit(site), key).alias("id"), F.to_json(record).alias("parsed_json"),
                           F.lit("2026-06-30").cast("timestamp").alias("crawled_at"))

    batches = [crawl("yes24"), crawl("melon").filter("p_partkey % 2 = 1")]
    folder = work_folder(r.spark)
    store = ingest.EventStore(r.spark, f"{folder}/events")
    store.write(0, stored_events(r).limit(0))
    for payloads in batches:
        payloads.write.mode("append").parquet(f"{folder}/raw")
        landed = r.spark.readStream.schema(payloads.schema).parquet(f"{folder}/raw")
        ingest.start_ingest(landed, store, f"{folder}/state", "2026-07-01T00:00:00").awaitTermination()
    ingest.ingest_batch(store, batches[1], 1, "2026-07-01T00:00:00")
    store.compact(2)
    return store.read(2).groupBy("title", F.size("source_urls").cast("long").alias("n_links")).agg(F.count("*").alias("n_events"))


@query(
    "streamed_sessions",
    """WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
         i AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS visit FROM e)
       SELECT user_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n_actions, count(*) FILTER (event_type = 'purchase') AS n_purchases,
         sum(CAST(floor(coalesce(value, 0) * 100 + 0.5) AS BIGINT)) AS value_cents
       FROM i GROUP BY user_id, visit HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
)
def streamed_sessions(r: Roles):
    """Visits that are over: six hours without an action of the user."""
    actions = stream(r, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("kind"), "value")
    visits = drain(trends.sessions(actions))
    return visits.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "ended_at")})
