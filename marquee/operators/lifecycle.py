"""Event status, hiding and run bookkeeping. Each step returns the new table and its log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.dates import at, days_before, is_stalled, moment
from ..functions.text import is_blank


def swept_status(as_of: str) -> Column:
    """Status by dates, in the order the four updates apply; pinned rows keep theirs."""
    now, s = at(as_of), F.col("status")
    start, end = moment("start_date"), moment("end_date")
    opening, closing = moment("ticket_open_date"), moment("ticket_close_date")
    pinned = F.array_contains(F.coalesce("locked_fields", F.array().cast("array<string>")), "status")
    over = F.coalesce(end, start) < now
    running = (start <= now) & (end >= now)
    waiting = (start > now) & (opening > now) & ~s.isin("ended", "ongoing", "upcoming")
    selling = (
        (start > now) & (opening.isNull() | (opening <= now)) & (closing.isNull() | (closing >= now))
        & ~s.isin("ended", "ongoing", "on_sale")
    )
    return (
        F.when(pinned, s).when(over, F.lit("ended")).when(running, F.lit("ongoing"))
        .when(waiting, F.lit("upcoming")).when(selling, F.lit("on_sale")).otherwise(s)
    )


def sweep(events: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(events, changes)."""
    state = events.withColumn("_new", swept_status(as_of))
    changes = state.filter(~F.col("_new").eqNullSafe(F.col("status"))).select(
        F.col("id").alias("event_id"), F.lit("status").alias("field_name"),
        F.col("status").alias("old_value"), F.col("_new").alias("new_value"),
    )
    return state.withColumn("status", F.col("_new")).drop("_new"), changes


def overdue(today: str) -> Column:
    """Over by date but not marked as ended."""
    return F.coalesce(F.col("end_date").cast("date") < F.lit(today).cast("date"), F.lit(False)) & (F.col("status") != "ended")


def hide(events: DataFrame, test: Column, reason: Column | str, as_of: str) -> DataFrame:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    test = F.coalesce(test, F.lit(False))
    return events.withColumns({
        "is_hidden": F.when(test, F.lit(True)).otherwise(F.col("is_hidden")),
        "hidden_at": F.when(test, at(as_of)).otherwise(F.col("hidden_at")),
        "hidden_reason": F.when(test, reason).otherwise(F.col("hidden_reason")),
    })


def show(events: DataFrame, test: Column) -> DataFrame:
    test = F.coalesce(test, F.lit(False))
    return events.withColumns({
        "is_hidden": F.when(test, F.lit(False)).otherwise(F.col("is_hidden")),
        "hidden_at": F.when(~test, F.col("hidden_at")),
        "hidden_reason": F.when(~test, F.col("hidden_reason")),
    })


def hide_old(events: DataFrame, as_of: str, days: int = V.OLD_EVENT_DAYS) -> DataFrame:
    cutoff = days_before(at(as_of), days)
    last = F.coalesce(moment("end_date"), moment("start_date"))
    test = (F.col("status") == "ended") & ~F.col("is_hidden") & (last < cutoff)
    return hide(events, test, f"ended_{days}d", as_of)


UNLINKED = "unlinked_no_artist"


def hide_unlinked(events: DataFrame, as_of: str) -> DataFrame:
    """Hide events without artist and poster; show them again once they have either."""
    status = F.col("artist_link_status")
    bare = F.col("artist_id").isNull() & F.col("poster_url").isNull() & ~F.col("is_hidden")
    tried = F.col("enrich_attempted_at").isNotNull() & (status.isNull() | (status == "no_artist"))
    stale = status.isNull() & (moment("crawled_at") < days_before(at(as_of), 3))
    hidden = hide(events, bare & ((status == "no_artist") | tried | stale), UNLINKED, as_of)
    healed = (F.col("hidden_reason") == UNLINKED) & (F.col("artist_id").isNotNull() | F.col("poster_url").isNotNull())
    return show(hidden, healed)


def drop_non_music(
    events: DataFrame, artists: DataFrame, event_artists: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove records that are not music artists; their events stay and are matched again."""
    gone = artists.filter(~F.col("is_music_artist")).select(F.col("id").alias("artist_id"))
    flagged = events.join(gone.withColumn("_gone", F.lit(True)), "artist_id", "left")
    for c in ("artist_id", "artist_link_status", "enrich_attempted_at"):
        flagged = flagged.withColumn(c, F.when(F.col("_gone").isNull(), F.col(c)))
    return (
        flagged.select(*events.columns),
        artists.join(gone.withColumnRenamed("artist_id", "id"), "id", "left_anti"),
        event_artists.join(gone, "artist_id", "left_anti"),
    )


# --- operator edits ----------------------------------------------------------------------
def set_status(events: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply (id, new_status) and pin the status so that the sweep leaves it alone."""
    state = events.join(edits.filter(F.col("new_status").isin(V.EVENT_STATUSES)), "id", "left")
    edited = F.col("new_status").isNotNull()
    locks = F.coalesce("locked_fields", F.array().cast("array<string>"))
    return state.withColumn("status", F.coalesce("new_status", "status")).withColumn(
        "locked_fields", F.when(edited, F.array_union(locks, F.array(F.lit("status")))).otherwise(F.col("locked_fields"))
    ).select(*events.columns)


def unpin(events: DataFrame, ids: DataFrame) -> DataFrame:
    state = events.join(ids.select("id").distinct().withColumn("_u", F.lit(True)), "id", "left")
    return state.withColumn(
        "locked_fields", F.when(F.col("_u"), F.array_remove("locked_fields", "status")).otherwise(F.col("locked_fields"))
    ).select(*events.columns)


def edit_fields(events: DataFrame, edits: DataFrame, editable: list[str]) -> DataFrame:
    """Apply (id, field, value) edits; empty text clears, and each edited field is locked."""
    allowed = edits.filter(F.col("field").isin(editable)).groupBy("id", "field").agg(F.max("value").alias("value"))
    wide = allowed.groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_v")  # one entry per editable field
    )
    state = events.join(wide, "id", "left")
    for f in editable:
        new = F.try_element_at("_v", F.lit(f))
        value = F.when(new != "", new).try_cast(events.schema[f].dataType)
        state = state.withColumn(
            f, F.when(F.col("_v").isNotNull() & F.map_contains_key("_v", f), value).otherwise(F.col(f))
        )
    locks = F.coalesce("locked_fields", F.array().cast("array<string>"))
    return state.withColumn(
        "locked_fields",
        F.when(F.col("_v").isNotNull(), F.array_union(locks, F.array_sort(F.map_keys("_v")))).otherwise(F.col("locked_fields")),
    ).select(*events.columns)


def hide_or_restore(events: DataFrame, actions: DataFrame, as_of: str) -> DataFrame:
    """Apply (id, action, reason) with action hide, restore or delete."""
    state = events.join(actions.select("id", "action", "reason"), "id", "left")
    state = hide(state, F.col("action") == "hide", F.coalesce("reason", F.lit("수동 숨김")), as_of)
    state = show(state, F.col("action") == "restore")
    return state.filter(F.coalesce(F.col("action") != "delete", F.lit(True))).select(*events.columns)


def affected_artists(edits: DataFrame, events: DataFrame, event_artists: DataFrame) -> DataFrame:
    """Artists whose counters an edit of these event ids may change."""
    ids = edits.select("id").distinct()
    billed = event_artists.join(ids.withColumnRenamed("id", "event_id"), "event_id", "left_semi").select(F.col("artist_id").alias("id"))
    led = events.join(ids, "id", "left_semi").filter(F.col("artist_id").isNotNull()).select(F.col("artist_id").alias("id"))
    return billed.union(led).distinct()


# --- runs --------------------------------------------------------------------------------
def reset_stale(rows: DataFrame, as_of: str) -> DataFrame:
    """Runs or jobs still marked as running long after any could be are failed."""
    dead = is_stalled(F.col("status"), F.col("started_at"), at(as_of))
    out = rows.withColumn("_dead", dead)
    if "error" in rows.columns:
        text = f"stalled for more than {V.STALE_RUN_MINUTES} minutes"
        out = out.withColumn("error", F.when(F.col("_dead"), F.lit(text)).otherwise(F.col("error")))
    if "error_count" in rows.columns:
        out = out.withColumn("error_count", F.when(F.col("_dead"), F.lit(1)).otherwise(F.col("error_count")))
    return out.withColumn("finished_at", F.when(F.col("_dead"), at(as_of)).otherwise(F.col("finished_at"))).withColumn(
        "status", F.when(F.col("_dead"), F.lit("failed")).otherwise(F.col("status"))
    ).select(*rows.columns)


def run_status(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Per run: done, partial (some steps failed) or failed (the run itself broke)."""
    return steps.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.when(F.col("status") == "failed", F.col("step_name")))).alias("failed_steps"),
        F.count("*").alias("step_count"),
        F.max(F.coalesce("run_error", F.lit(""))).alias("_error"),
    ).withColumn(
        "status",
        F.when(F.col("_error") != "", "failed").when(F.size("failed_steps") > 0, "partial").otherwise("done"),
    ).drop("_error")


def job_outcome(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Crawl job counters and status from per-record outcomes (action, error)."""
    sums = outcomes.groupBy(*keys).agg(
        F.count_if(F.col("action").isNotNull()).alias("events_found"),
        F.count_if(F.col("action").isin("inserted", "updated")).alias("events_upserted"),
        F.count_if(F.col("action") == "skipped").alias("events_skipped"),
        F.count_if(F.col("error").isNotNull()).alias("error_count"),
    )
    return sums.withColumn(
        "status",
        F.when((F.col("events_upserted") == 0) & (F.col("events_found") == 0), "failed")
        .when(F.col("error_count") > 0, "partial").otherwise("success"),
    )


def health(
    runs: DataFrame, steps: DataFrame, queue: DataFrame, artists: DataFrame, error_logs: DataFrame, as_of: str
) -> DataFrame:
    """One row: level green, yellow or red, with the first reason that applies and its signals."""
    now = at(as_of)
    parts = [
        runs.agg(F.max(F.struct("started_at", "status", "failed_steps")).alias("last")),
        steps.agg(
            F.collect_set(F.when(is_stalled(F.col("status"), F.col("started_at"), now), F.col("step_name"))).alias("stalled")
        ),
        queue.agg(F.count_if(F.col("status") == "failed").alias("queue_failed")),
        artists.agg(F.count("name_proposal").alias("proposals")),
        error_logs.agg(F.count_if(~F.col("is_resolved")).alias("app_errors")),
    ]
    signals = parts[0]
    for part in parts[1:]:
        signals = signals.unionByName(part, allowMissingColumns=True)
    row = signals.agg(*[F.max(c).alias(c) for c in ("last", "stalled", "queue_failed", "proposals", "app_errors")])
    row = row.withColumn("stalled", F.array_sort("stalled"))
    gap = (F.unix_micros(now) - F.unix_micros(moment("last.started_at"))) / 3_600_000_000
    status = F.col("last.status")
    red = (
        F.when(F.col("last").isNull(), "no_runs").when(F.size("stalled") > 0, "stalled")
        .when(status == "failed", "last_run_failed").when(gap > V.RUN_MISSED_HOURS, "run_missed")
    )
    yellow = (
        F.when(status == "partial", "last_run_partial").when(gap > V.RUN_LATE_HOURS, "run_late")
        .when(F.col("queue_failed") + F.col("proposals") + F.col("app_errors") > 0, "backlog")
    )
    return row.select(
        F.when(red.isNotNull(), "red").when(yellow.isNotNull(), "yellow").otherwise("green").alias("level"),
        F.coalesce(red, yellow, F.lit("ok")).alias("reason"),
        F.floor(gap * 10 + 0.5).cast("double").alias("_gap"),
        status.alias("last_run_status"), F.col("stalled").alias("stalled_steps"), "queue_failed", "proposals", "app_errors",
    ).withColumn("gap_hours", F.col("_gap") / 10).drop("_gap")


def flat_metrics(results: DataFrame) -> DataFrame:
    """(step, metric, value) rows of nested step results given as JSON (step, result)."""
    top = results.select("step", F.explode(F.from_json("result", "map<string,string>")).alias("k", "v"))
    nested = top.filter(F.col("v").startswith("{")).select(
        "step", F.col("k").alias("p"), F.explode(F.from_json("v", "map<string,string>")).alias("k", "v")
    ).withColumn("k", F.concat_ws(".", "p", "k")).drop("p")
    flat = top.filter(~F.col("v").startswith("{")).unionByName(nested)
    value = F.when(F.col("v").startswith("["), F.json_array_length("v").cast("double")).otherwise(F.col("v").try_cast("double"))
    return flat.select("step", F.col("k").alias("metric"), value.alias("value")).filter("value IS NOT NULL")


def structure_alarms(jobs: DataFrame, key: str = "source_name", order: str = "finished_at", found: str = "events_found",
                     tie: str = "id", limit: int = 3) -> DataFrame:
    """Per job: length of the run of empty crawls ending there, and whether it raises the alarm.

    A run restarts after every crawl that found something. Histories are ordered per source; the
    position of the last success is a running maximum, so nothing is collected.
    """
    w = Window.partitionBy(key).orderBy(order, tie)
    n = F.row_number().over(w)
    rows = jobs.withColumn("_n", n)
    success = F.max(F.when(F.col(found) > 0, F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    run = F.when(F.col(found) > 0, 0).otherwise(F.col("_n") - F.coalesce(success, F.lit(0)))
    return rows.withColumn("zero_run", run).withColumn("alarm", F.col("zero_run") >= limit).drop("_n")
