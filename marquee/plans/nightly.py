"""The nightly run: crawl, sweep, fix, delete, enrich, merge, score, purge.

A step takes the tables and returns new ones together with log rows and a few numbers. Tables are
written between steps, so a lost executor never replays the whole night, and a failing step is
recorded while the others go on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.dates import at
from ..operators import engagement as E
from ..operators import enrich as EN
from ..operators import lifecycle as LC
from ..operators import lookups as LK
from ..operators import merge_artists as MA
from ..operators import merge_events as ME
from ..operators import merge_venues as MV
from ..operators import quality as Q
from ..operators import scoring as S
from ..operators import upsert as U
from ..session import cut_lineage
from ..sources import landing as LD

Tables = dict[str, DataFrame]


@dataclass
class Outcome:
    """What a step changed: tables, appended logs and counts."""

    tables: Tables = field(default_factory=dict)
    logs: Tables = field(default_factory=dict)
    metrics: dict[str, int] = field(default_factory=dict)


Step = Callable[[Tables, str], Outcome]


def crawl(t: Tables, as_of: str) -> Outcome:
    """Landed payloads that no run has processed, normalised, matched and merged."""
    todo = cut_lineage(LD.unprocessed(t["payloads"], t["processed"]))
    parsed = LD.parse_records(todo).withColumn("errors", LD.record_errors())
    bad = parsed.filter(F.size("errors") > 0)
    rows = cut_lineage(LD.normalise_records(parsed.filter(F.size("errors") == 0).drop("corrupt", "errors"), as_of))
    spelled = rows.select(F.explode(F.filter("artists", lambda n: F.trim(n) != "")).alias("raw_name"))
    names, artists, aliases, _ = LK.match_or_create_artists(spelled, t["artists"], t["artist_aliases"])
    names = cut_lineage(names)
    places, venues, _ = LK.match_or_create_venues(rows.select("venue_name", "venue_address"), t["venues"])
    lead = names.withColumnRenamed("raw_name", "_lead").withColumnRenamed("artist_id", "_artist")
    rows = rows.withColumn("_lead", F.get("artists", F.lit(0))).join(lead, "_lead", "left").join(places, "venue_name", "left")
    rows = rows.withColumn("artist_id", F.col("_artist")).drop("_lead", "_artist").withColumnRenamed("id", "row_id")
    merged = U.upsert(cut_lineage(rows), t["events"], as_of)
    keys = merged["events"].select("dedup_key", F.col("id").alias("event_id"))
    lists = rows.join(keys, "dedup_key").select("event_id", "source_name", F.col("artists").alias("names"))
    edges = LK.event_artist_rows(lists, names)
    known = t["event_artists"].join(edges.select("event_id", "artist_id"), ["event_id", "artist_id"], "left_anti")
    marks = LD.marks(todo.join(rows.select(F.col("row_id").alias("id"), "dedup_key"), "id"), keys)
    return Outcome(
        {
            "events": merged["events"], "artists": artists, "artist_aliases": aliases, "venues": venues,
            "event_artists": known.unionByName(edges.select(*known.columns)),
            "processed": t["processed"].unionByName(marks.select(*t["processed"].columns)),
        },
        {"event_change_logs": merged["changes"], "ingestion_errors": bad.select("id", "errors")},
        {"found": todo.count(), "rejected": bad.count()},
    )


def sweep(t: Tables, as_of: str) -> Outcome:
    events, changes = LC.sweep(t["events"], as_of)
    return Outcome({"events": events}, {"event_change_logs": changes}, {"updated": changes.count()})


def fix(t: Tables, as_of: str) -> Outcome:
    out = Outcome()
    for table, kind in (("venues", "venue"), ("artists", "artist"), ("events", "event")):
        rows, log, _ = Q.auto_fix(t[table], kind, t["queue"])
        out.tables[table] = rows
        out.logs["fix_logs"] = log if "fix_logs" not in out.logs else out.logs["fix_logs"].unionByName(log)
    out.metrics["fixed"] = out.logs["fix_logs"].count()
    return out


# Child rows that go with the row they point at.
CASCADES = {
    "events": (("event_artists", "event_id"), ("event_venues", "event_id"), ("user_interested_events", "event_id"),
               ("booking_intents", "event_id"), ("user_bookings", "event_id"), ("concert_reviews", "event_id"),
               ("timetable_performances", "event_id")),
    "artists": (("event_artists", "artist_id"), ("user_artist_followings", "artist_id"), ("artist_aliases", "artist_id")),
    "venues": (("event_venues", "venue_id"),),
}


def without_children(before: Tables, after: Tables) -> Tables:
    """The child tables without rows of parents that are in ``before`` and no longer in ``after``."""
    out: Tables = {}
    for parent, children in CASCADES.items():
        if parent not in after:
            continue
        gone = before[parent].select("id").join(after[parent].select("id"), "id", "left_anti")
        for child, key in children:
            rows = out.get(child, before.get(child))
            if rows is not None and key in rows.columns:
                out[child] = rows.join(gone.withColumnRenamed("id", key), key, "left_anti").select(*rows.columns)
    return out


def delete(t: Tables, as_of: str) -> Outcome:
    venues, v_log = Q.auto_delete(t["venues"], "venue", as_of)
    artists, a_log = Q.auto_delete(t["artists"], "artist", as_of)
    events, e_log = Q.auto_delete(t["events"], "event", as_of)
    events, p_log, cache = Q.purge_non_concerts(cut_lineage(events), t["title_keep_verdicts"], as_of)
    log = v_log.unionByName(a_log).unionByName(e_log)
    kept = {"venues": cut_lineage(venues), "artists": cut_lineage(artists), "events": cut_lineage(events)}
    return Outcome(
        {**kept, **without_children(t, kept), "title_keep_verdicts": cache},
        {"delete_logs": log, "purge_logs": p_log}, {"deleted": log.count()},
    )


def enrich(t: Tables, as_of: str) -> Outcome:
    queue = EN.tidy_queue(t["queue"], as_of)
    artists, log, named = EN.enrich_artists(t["artists"], t["artist_profiles"], as_of)
    events = Q.backfill_posters(Q.backfill_booking_links(Q.backfill_fields(t["events"])))
    links = Q.missing_venue_links(events, t["event_venues"])
    aliases = MA.add_aliases(t["artist_aliases"], named)
    return Outcome(
        {
            "queue": queue, "artists": artists, "artist_aliases": aliases, "events": events,
            "event_venues": t["event_venues"].unionByName(links.select(*t["event_venues"].columns)),
        },
        {"enrich_logs": log}, {"processed": log.count()},
    )


def merge(t: Tables, as_of: str) -> Outcome:
    linked = E.linked_event_counts(t["event_artists"])
    children = {n: t[n] for n in ("event_artists", "user_artist_followings", "timetable_performances", "events") if n in t}
    artists = MA.merge_artists(t["artists"], MA.exact_mapping(t["artists"], linked), children, t["artist_aliases"])
    events = cut_lineage(artists["events"])
    mapping, held = MV.exact_merge(t["venues"], E.venue_event_counts(events))
    venues = MV.merge_venues(t["venues"], mapping, events, t["event_venues"])
    merged = ME.auto_merge(cut_lineage(venues["events"]), venues["venues"])
    links = {**{n: artists[n] for n in ("event_artists", "timetable_performances") if n in artists}, "event_venues": venues["event_venues"]}
    users = {n: t[n] for n in ("user_interested_events", "booking_intents", "user_bookings", "concert_reviews") if n in t}
    moved = ME.repoint_user_data({**links, **users}, cut_lineage(merged.mapping))
    tables = {k: artists[k] for k in ("artists", "artist_aliases", "user_artist_followings") if k in artists}
    tables |= {"venues": venues["venues"], "events": merged.events, **moved}
    logs = {"artist_merge_logs": artists["artist_merge_logs"], "venue_merge_logs": venues["venue_merge_logs"],
            "event_merge_logs": merged.log, "venues_held_back": held}
    return Outcome(tables, logs, {"events": merged.mapping.count(), "venues": mapping.count()})


def score(t: Tables, as_of: str) -> Outcome:
    artists = E.refresh_counters(t["artists"], t["user_artist_followings"], t["event_artists"], t["events"])
    engagement = E.artist_engagement(
        artists, t["user_artist_followings"], t["event_artists"], t["user_interested_events"], t["concert_reviews"]
    )
    a_scores = cut_lineage(S.artist_popularity(artists, engagement, as_of))
    e_engagement = E.event_engagement(
        t["events"], t["user_interested_events"], t["user_bookings"], t["concert_reviews"], t["event_artists"]
    )
    e_scores = cut_lineage(S.event_popularity(t["events"], t["event_artists"], a_scores, e_engagement, as_of))
    fresh = S.snapshot_rows(a_scores, e_scores, at(as_of))
    snapshots = cut_lineage(t["popularity_snapshots"].unionByName(fresh.select(*t["popularity_snapshots"].columns)))
    trend = cut_lineage(S.trending(snapshots, as_of))

    def scored(rows: DataFrame, scores: DataFrame, kind: str) -> DataFrame:
        up = trend.filter(F.col("entity_type") == kind).select(F.col("entity_id").alias("id"), "trending_score")
        out = S.apply_scores(rows, scores, ["popularity_score"])
        return S.apply_scores(out, up, ["trending_score"]).select(*rows.columns)

    return Outcome(
        {"artists": scored(artists, a_scores, "artist"), "events": scored(t["events"], e_scores, "event"), "popularity_snapshots": snapshots},
        {}, {"artist_scored": a_scores.count(), "concert_scored": e_scores.count(), "cold_start": trend.filter("cold_start").count()},
    )


def purge(t: Tables, as_of: str) -> Outcome:
    events = LC.hide_unlinked(LC.hide_old(t["events"], as_of), as_of)
    return Outcome({"events": events}, {}, {"hidden": events.filter("is_hidden").count()})


STEPS: dict[str, Step] = {
    "crawl": crawl, "sweep": sweep, "fix": fix, "delete": delete, "enrich": enrich, "merge": merge, "score": score, "purge": purge,
}


def run_night(tables: Tables, as_of: str, steps: list[str] | None = None) -> tuple[Tables, list[tuple[str, str, Tables]], list[dict]]:
    """(tables, logs, report): all steps in order; the report has one entry per step."""
    logs: list[tuple[str, str, Tables]] = []
    report: list[dict] = []
    for name in steps or V.STEPS:
        try:
            outcome = STEPS[name](tables, as_of)
            written = {k: cut_lineage(v) for k, v in outcome.tables.items()}
            logs += [(name, k, cut_lineage(v)) for k, v in outcome.logs.items()]
            tables = {**tables, **written}
            report.append({"step": name, "status": "done", **outcome.metrics})
        except Exception as error:  # one broken step must not stop the night
            report.append({"step": name, "status": "failed", "error": str(error)[:500]})
    return tables, logs, report


def night_status(report: list[dict]) -> str:
    return "partial" if any(r["status"] == "failed" for r in report) else "done"
