"""Profiles, lineups and queues around outside lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from ..functions.dates import at, moment
from ..functions.nested import candidate_names
from .listing import admitted, latest_per_key
from .lookups import event_artist_rows, match_or_create_artists

# Task types nobody processes any more.
UNHANDLED_TASKS = ["match_artist", "normalize_venue", "parse_dates"]


# --- profiles ----------------------------------------------------------------------------
def merged_profiles(profiles: DataFrame) -> DataFrame:
    """One row per artist: each field from the best source that has it."""
    rank = F.array_position(F.array(*[F.lit(s) for s in V.PROFILE_SOURCES]), F.col("source"))
    picks = [
        F.min(F.when(~T.is_blank(f) & (rank > 0), F.struct(rank.alias("r"), F.col(f).alias("v"), F.col("source").alias("s")))).alias(f)
        for f in V.PROFILE_FIELDS
    ]
    used = F.array_sort(F.collect_set("source")).alias("sources")
    return profiles.groupBy("artist_id").agg(used, *picks)


def enrich_artists(
    artists: DataFrame, profiles: DataFrame, as_of: str, force: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(artists, log, aliases to add): fill blanks, or overwrite with force, by source priority."""
    merged = merged_profiles(profiles).withColumnsRenamed({"artist_id": "id", **{f: f"p_{f}" for f in V.PROFILE_FIELDS}})
    state = artists.join(merged, "id", "left")
    wanting = F.lit(force)
    for f in V.PROFILE_FIELDS:
        wanting = wanting | T.is_blank(f)
    state = state.withColumn("_asked", F.col("sources").isNotNull() & wanting)
    take = {f: F.col("_asked") & (F.lit(force) | T.is_blank(f)) & F.col(f"p_{f}").isNotNull() for f in V.PROFILE_FIELDS}
    added = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(f)) for f, t in take.items()]))
    state = state.withColumn("_added", added)
    log = state.filter("_asked").select(F.col("id").alias("artist_id"), "sources", F.col("_added").alias("added_fields"))
    aliases = state.filter(F.array_contains("_added", "name_en")).select(
        F.col("id").alias("artist_id"), F.col("p_name_en.v").alias("alias"),
        F.concat(F.lit("enrich:"), "p_name_en.s").alias("source"),
    )
    for f, t in take.items():
        state = state.withColumn(f, F.when(F.array_contains("_added", f), F.col(f"p_{f}.v")).otherwise(F.col(f)))
    asked = F.col("_asked")
    state = state.withColumns({
        "enrichment_status": F.when(asked & (F.size("_added") > 0), "enriched").when(asked, "skipped").otherwise(F.col("enrichment_status")),
        "enrichment_attempted_at": F.when(asked, at(as_of)).otherwise(F.col("enrichment_attempted_at")),
    })
    return state.select(*artists.columns), log, aliases


# --- queue -------------------------------------------------------------------------------
def enrichment_tasks(artists: DataFrame, queue: DataFrame) -> DataFrame:
    """New tasks for artists that still need a name, picture or genre and have none open."""
    status = F.col("enrichment_status")
    needy = artists.filter(status.isNull() | (status == "pending")).filter(
        T.is_blank("name_en") | T.is_blank("avatar_url") | T.is_blank("occupation")
    ).select(F.col("id").cast("string").alias("entity_id"), F.lit("clean_data").alias("task_type"))
    open_queue = queue.select(F.col("entity_id").cast("string"), "task_type", "status")
    return admitted(needy, open_queue, ["entity_id", "task_type"]).select(
        F.lit("artist").alias("entity_type"), "entity_id", "task_type", F.lit("pending").alias("status"), F.lit(1).alias("priority")
    )


def tidy_queue(queue: DataFrame, as_of: str) -> DataFrame:
    """Fail tasks nobody handles and take back those stuck in processing for an hour."""
    unhandled = F.col("task_type").isin(UNHANDLED_TASKS) & (F.col("status") == "pending")
    stuck = (F.col("status") == "processing") & (moment("created_at") < at(as_of) - F.make_dt_interval(hours=F.lit(1)))
    state = queue.withColumn("_u", F.coalesce(unhandled, F.lit(False))).withColumn("_s", F.coalesce(stuck, F.lit(False)))
    if "error" in queue.columns:
        state = state.withColumn(
            "error", F.when(F.col("_u"), F.lit("no processor for task_type")).when(~F.col("_s"), F.col("error"))
        )
    return state.withColumn(
        "status", F.when(F.col("_u"), "failed").when(F.col("_s"), "pending").otherwise(F.col("status"))
    ).select(*queue.columns)


def next_tasks(queue: DataFrame, limit: int) -> DataFrame:
    """The batch to work on: highest priority first."""
    return queue.filter((F.col("status") == "pending") & (F.col("task_type") == "clean_data")).orderBy(
        F.desc("priority"), "created_at", "entity_id"
    ).limit(limit)


# --- lineups from payloads ---------------------------------------------------------------
def latest_payloads(payloads: DataFrame) -> DataFrame:
    rows = payloads.filter(F.col("event_id").isNotNull()).select("event_id", "id", "source_name", "source_url", "parsed_json", "crawled_at")
    return latest_per_key(rows, ["event_id"], "crawled_at", "id")


def backfill_artists(
    events: DataFrame, payloads: DataFrame, artists: DataFrame, aliases: DataFrame
) -> dict[str, DataFrame]:
    """Link events without an artist through the names in their newest payload; report the rest."""
    bare = events.filter(F.col("artist_id").isNull()).select(F.col("id").alias("event_id"), F.col("title").alias("event_title"))
    newest = latest_payloads(payloads).select("event_id", "source_name", candidate_names(F.col("parsed_json")).alias("names"))
    rows = bare.join(newest, "event_id", "left")
    listed = rows.filter(F.size("names") > 0)
    names = listed.select(F.explode("names").alias("raw_name")).distinct()
    matches, everyone, known, _ = match_or_create_artists(names, artists, aliases)
    edges = event_artist_rows(listed.select("event_id", "source_name", "names"), matches)
    first = listed.select("event_id", F.get("names", F.lit(0)).alias("raw_name")).join(matches, "raw_name", "left")
    linked = first.filter(F.col("artist_id").isNotNull()).select(F.col("event_id").alias("id"), F.col("artist_id").alias("_found"))
    table = events.join(linked, "id", "left").withColumn(
        "artist_id", F.coalesce(F.col("artist_id").cast("string"), "_found").cast(events.schema["artist_id"].dataType)
    ).select(*events.columns)
    failed = first.filter(F.col("artist_id").isNull()).select("event_id", F.lit(True).alias("_failed"))
    reason = (
        F.when(F.col("names").isNull(), "missing_raw_payload").when(F.size("names") == 0, "missing_artist_candidates")
        .when(F.col("_failed"), "artist_create_failed")
    )
    issues = rows.join(failed, "event_id", "left").select("event_id", "event_title", reason.alias("reason"), "names").filter("reason IS NOT NULL")
    return {"events": table, "event_artists": edges, "artists": everyone, "artist_aliases": known, "issues": issues}


def lineup_audit(payloads: DataFrame, events: DataFrame, performances: DataFrame) -> DataFrame:
    """(event_id, reason, ...) for a crawl's processed payloads, each reason once per event."""
    rows = payloads.filter(F.col("processed") & F.col("event_id").isNotNull()).select(
        "event_id", F.col("id").alias("payload_id"), "source_name", "source_url", candidate_names(F.col("parsed_json")).alias("names")
    )
    norm = lambda names: F.transform(names, lambda n: F.lower(T.squeeze(n)))
    slots = performances.filter(T.strip("artist_name") != "").groupBy("event_id").agg(
        F.array_sort(F.collect_set(T.strip("artist_name"))).alias("acts")
    ).withColumn("_acts", norm("acts"))  # once per event, not per payload
    festival = T.or_empty("title").rlike(V.PLAIN_FESTIVAL) | T.or_empty("genre").rlike(V.PLAIN_FESTIVAL)
    e = events.select(F.col("id").alias("event_id"), F.col("title").alias("event_title"), "artist_id", festival.alias("_festival"))
    none = F.array().cast("array<string>")
    joined = rows.join(e, "event_id").join(slots, "event_id", "left").withColumns({c: F.coalesce(c, none) for c in ("acts", "_acts")})
    no_link = F.col("artist_id").isNull()
    differs = (F.size("acts") > 0) & (F.size("names") > 0) & (F.size(F.array_except("_acts", norm("names"))) > 0)
    issue = lambda topic, reason: F.struct(F.lit(topic).alias("topic"), F.lit(reason).alias("reason"))
    found = F.array_compact(F.array(
        F.when(no_link & (F.size("names") == 0), issue("link", "missing_artist_candidates")),
        F.when(no_link & (F.size("names") > 0), issue("link", "missing_artist_link")),
        F.when(F.col("_festival") & (F.size("acts") == 0), issue("timetable", "missing_festival_timetable")),
        F.when(differs, issue("mismatch", "timetable_artist_mismatch")),
    ))
    spread = joined.select("*", F.explode(found).alias("x"))
    once = spread.groupBy("event_id", F.col("x.topic").alias("topic")).agg(
        F.min(F.struct("payload_id", "x.reason", "event_title", "source_name", "source_url", "names", "acts")).alias("r")
    )
    title = F.col("event_title")
    return once.select("event_id", "r.*").withColumn(
        "search_queries", F.array(F.concat(title, F.lit(" 타임테이블")), F.concat(title, F.lit(" 출연진")), F.concat(title, F.lit(" lineup timetable")))
    )

