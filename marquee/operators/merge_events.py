"""Duplicate events: finding, absorbing and reviewing them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import text as T
from ..functions.maths import filled_count
from ..functions.nested import distinct_sites
from ..session import cut_lineage
from .cluster import greedy_star, resolve_chains, survivors
from .similarity import containment_pairs

# What counts as information about an event and what a survivor may take over.
INFO_COLUMNS = [
    "poster_url", "genre", "age_restriction", "ticket_open_date", "ticket_provider", "notice_text",
    "booking_url", "venue_id", "end_date",
]
TRANSFERABLE = [
    "poster_url", "genre", "age_restriction", "ticket_open_date", "ticket_close_date", "ticket_provider",
    "notice_text", "booking_url", "organizer", "duration", "artist_id", "venue_id", "end_date",
]


@dataclass
class MergeResult:
    """The new table, who was merged into whom, and the log of absorbed rows."""

    events: DataFrame
    mapping: DataFrame
    log: DataFrame


def sortable(df: DataFrame, column: str) -> Column:
    """A text that sorts like the column, for numeric and textual ids alike."""
    if isinstance(df.schema[column].dataType, NumericType):
        return F.lpad(F.col(column).cast("string"), 20, "0")
    return F.col(column).cast("string")


def is_active() -> Column:
    return F.col("merged_into_event_id").isNull() & ~F.coalesce("is_hidden", F.lit(False))


def survivor_rank() -> Column:
    """Has an artist, knows more, longer title, older, then id."""
    return F.struct(
        F.col("artist_id").isNull().alias("no_artist"),
        (-filled_count(INFO_COLUMNS)).alias("info"),
        (-F.length(T.or_empty("title"))).alias("title"),
        F.col("created_at"),
        F.col("id"),
    )


def review_rank() -> Column:
    """The same choice without the title length, as suggested to reviewers."""
    return F.struct(
        F.col("artist_id").isNull().alias("no_artist"),
        (-filled_count(INFO_COLUMNS)).alias("info"),
        F.col("created_at"),
        F.col("id"),
    )


# --- applying a mapping ------------------------------------------------------------------
def absorb(events: DataFrame, mapping: DataFrame) -> MergeResult:
    """Apply (old_id, keep_id, pass_name): fill the survivor's blanks, drop and log the others.

    Per survivor and column the donor with the most information wins, as a minimum over a struct,
    so even a very large group is reduced before the shuffle. Links are made distinct before they
    are collected.
    """
    columns = [c for c in TRANSFERABLE if c in events.columns]
    donors = events.join(mapping.withColumnRenamed("old_id", "id"), "id")
    offer = [
        F.min(
            F.when(~T.is_blank(c), F.struct((-filled_count(INFO_COLUMNS)).alias("i"), F.col("id").alias("d"), F.col(c).alias("v")))
        ).alias(f"_{c}")
        for c in columns
    ]
    gifts = donors.groupBy("keep_id").agg(F.min("created_at").alias("_created"), *offer)
    links = (
        donors.select("keep_id", F.explode("source_urls").alias("link")).distinct()
        .groupBy("keep_id").agg(F.array_sort(F.collect_list("link")).alias("_links"))
    )
    gifts = gifts.join(links, "keep_id", "left").withColumnRenamed("keep_id", "id")
    kept = events.join(mapping.select(F.col("old_id").alias("id")), "id", "left_anti").join(gifts, "id", "left")
    taken = F.array_compact(
        F.array(*[F.when(T.is_blank(c) & F.col(f"_{c}").isNotNull(), F.lit(c)) for c in columns])
    )
    kept = kept.withColumn("_taken", taken)
    for c in columns:
        kept = kept.withColumn(c, F.when(T.is_blank(c), F.coalesce(F.col(f"_{c}.v"), F.col(c))).otherwise(F.col(c)))
    link_type = events.schema["source_urls"].dataType
    own = F.coalesce("source_urls", F.array().cast(link_type))
    kept = kept.withColumn(
        "source_urls", F.when(F.col("_links").isNull(), F.col("source_urls")).otherwise(F.array_union(own, F.col("_links")))
    ).withColumn("created_at", F.least("created_at", "_created"))
    transferred = kept.filter(F.size("_taken") > 0).select(F.col("id").alias("canonical_event_id"), "_taken")
    log = (
        donors.select(
            F.col("keep_id").alias("canonical_event_id"),
            F.col("id").alias("merged_event_id"),
            "pass_name",
            F.to_json(F.struct(*events.columns)).alias("snapshot"),
        )
        .join(transferred, "canonical_event_id", "left")
        .withColumn("transferred_fields", F.coalesce("_taken", F.array().cast("array<string>")))
        .drop("_taken")
    )
    return MergeResult(kept.select(*events.columns), mapping, log)


def repoint(rows: DataFrame, mapping: DataFrame, key: str, unique: list[str] | None = None) -> DataFrame:
    """Child rows moved to the survivor. With a unique key, rows that already pointed at the
    survivor stay and moved ones that collide with them are dropped."""
    moved = rows.join(
        mapping.select(F.col("old_id").alias(key), F.col("keep_id").alias("_keep")), key, "left"
    )
    moved = moved.withColumn("_moved", F.col("_keep").isNotNull()).withColumn("_was", F.col(key))
    moved = moved.withColumn(key, F.coalesce("_keep", key))
    if unique is None:
        return moved.select(*rows.columns)
    rest = [c for c in rows.columns if c not in unique]
    winner = F.min(F.struct("_moved", "_was", *rest)).alias("_row")
    return moved.groupBy(*unique).agg(winner).select(*unique, *[f"_row.{c}" for c in rest]).select(*rows.columns)


def repoint_user_data(children: dict[str, DataFrame], mapping: DataFrame) -> dict[str, DataFrame]:
    """User rows follow the survivor; crawl links of absorbed events disappear with them."""
    out = dict(children)
    for name in ("user_interested_events", "booking_intents"):
        if name in out:
            out[name] = repoint(out[name], mapping, "event_id", ["user_id", "event_id"])
    for name in ("user_bookings", "concert_reviews"):
        if name in out:
            out[name] = repoint(out[name], mapping, "event_id")
    gone = mapping.select(F.col("old_id").alias("event_id"))
    for name in ("event_artists", "event_venues", "timetable_performances"):
        if name in out:
            out[name] = out[name].join(gone, "event_id", "left_anti")
    return out


# --- matching passes ---------------------------------------------------------------------
def match_columns(events: DataFrame) -> DataFrame:
    """Active events with everything the passes compare, materialised once."""
    title = F.coalesce("normalized_title", "title")
    rows = events.filter(is_active()).select(
        "id",
        "title",
        "artist_id",
        "venue_id",
        "created_at",
        F.col("start_date").cast("date").alias("day"),
        "start_date",
        T.title_key(title).alias("title_key"),
        T.core_title_key(title).alias("core_key"),
        T.festival_key("title").alias("festival_key"),
        distinct_sites(F.col("source_urls")).alias("sites"),
        survivor_rank().alias("rank"),
        sortable(events, "id").alias("ord"),
    )
    return cut_lineage(rows)


def strong_key_mapping(events: DataFrame, venues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mapping, keys of the survivors) of active events with the same dedup key."""
    named = venues.select(F.col("id").alias("venue_id"), F.col("normalized_name").alias("venue_name"))
    keyed = events.filter(is_active()).join(named, "venue_id", "left").withColumn(
        "_key", T.event_key("title", "venue_name", F.col("start_date"))
    )
    keyed = cut_lineage(keyed.select("id", "_key", survivor_rank().alias("rank")))
    mapping = survivors(keyed, ["_key"], F.col("rank")).withColumn("pass_name", F.lit("recompute_collapse"))
    keep = mapping.select(F.col("keep_id").alias("id")).distinct().join(keyed.select("id", "_key"), "id")
    return cut_lineage(mapping), keep.withColumnRenamed("_key", "dedup_key")


def group_pass(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return survivors(rows, keys, F.col("rank")).withColumn("pass_name", F.lit(name))


def star_pass(rows: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """Mapping from greedy star clusters; nodes add block, ord, feats and sites to rows."""
    clustered = greedy_star(nodes.select("block", "ord", "feats", "sites"))
    members = nodes.select("id", "rank", F.col("block").cast("string").alias("block"), "ord").join(
        clustered, ["block", "ord"]
    )
    return survivors(members, ["block", "leader"], F.col("rank")).withColumn("pass_name", F.lit(name))


def artist_day_pass(rows: DataFrame) -> DataFrame:
    rows = rows.filter(F.col("artist_id").isNotNull() & F.col("day").isNotNull())
    return group_pass(rows, ["artist_id", "day"], "pass1_artist_day")


def title_day_pass(rows: DataFrame) -> DataFrame:
    rows = rows.filter((F.length("title_key") >= 3) & F.col("day").isNotNull())
    return group_pass(rows, ["title_key", "day"], "pass2_title_day")


def title_prefix_pass(rows: DataFrame, shortest: int = 15) -> DataFrame:
    """Truncated titles: everything maps to the shortest title of the day that is its prefix.

    Being a prefix is transitive, so the shortest prefix is the cluster; each title asks for its
    own prefixes, which is linear in its length.
    """
    rows = rows.filter((F.length("title_key") >= shortest) & F.col("day").isNotNull())
    seed = F.struct(F.length("title_key").alias("len"), F.col("ord").alias("ord"))
    seeds = rows.groupBy("day", F.col("title_key").alias("prefix")).agg(F.min(seed).alias("seed"))
    prefixes = F.transform(
        F.sequence(F.lit(shortest), F.length("title_key")), lambda n: F.substring("title_key", F.lit(1), n)
    )
    led = (
        rows.select("id", "rank", "day", F.explode(prefixes).alias("prefix")).join(seeds, ["day", "prefix"])
        .groupBy("id", "day").agg(F.min("seed").alias("seed"), F.first("rank").alias("rank"))
    )
    return group_pass(led, ["day", "seed"], "pass3_title_prefix")


def near_date_pass(rows: DataFrame) -> DataFrame:
    """Same title within two days from sources that do not overlap."""
    rows = rows.filter((F.length("title_key") >= 5) & F.col("day").isNotNull() & (F.size("sites") > 0))
    d = F.unix_date("day")
    # rows at most two days apart share exactly one of these day pairs
    pairs = F.array(
        *[F.concat_ws(":", (d + a).cast("string"), (d + b).cast("string")) for a, b in ((0, 0), (0, 1), (0, 2), (-1, 0), (-2, 0))]
    )
    nodes = rows.withColumns(
        {"block": F.col("title_key"), "feats": pairs, "ord": F.concat_ws("|", F.col("start_date").cast("string"), "ord")}
    )
    return star_pass(rows, nodes, "pass4_cross_source_2d")


def venue_or_contains_pass(rows: DataFrame) -> DataFrame:
    """Same day and either one title inside the other or, at one venue, six characters in common."""
    rows = rows.filter(F.col("day").isNotNull() & (F.length("title_key") >= 6))
    edges = containment_pairs(rows.select("title_key", "day"), "title_key", min_length=6, block=["day"])
    edges = edges.filter(F.length("short") >= 7)
    edge = F.concat_ws("|", F.lit("c"), "short", "long")
    sides = edges.select("day", F.explode(F.array("short", "long")).alias("title_key"), edge.alias("f"))
    sides = sides.groupBy("day", "title_key").agg(F.collect_set("f").alias("edges"))
    none = F.array().cast("array<string>")
    grams = F.when(
        F.col("venue_id").isNotNull(),
        F.transform(T.char_ngrams("title_key", 6), lambda g: F.concat_ws("|", F.lit("g"), F.col("venue_id").cast("string"), g)),
    ).otherwise(none)
    same = F.when(F.length("title_key") >= 7, F.array(F.concat_ws("|", F.lit("t"), "title_key"))).otherwise(none)
    nodes = rows.join(sides, ["day", "title_key"], "left").withColumns(
        {"block": F.col("day").cast("string"), "feats": F.concat(F.coalesce("edges", none), grams, same), "sites": none}
    )
    return star_pass(rows, nodes, "pass5_venue_or_contains")


def venue_day_pass(rows: DataFrame) -> DataFrame:
    """Same venue and day from sources that do not overlap: two festivals, or three characters in common."""
    rows = rows.filter(F.col("day").isNotNull() & F.col("venue_id").isNotNull() & (F.size("sites") > 0))
    festival = F.when(T.is_festival_title("title"), F.array(F.lit("*festival*"))).otherwise(F.array().cast("array<string>"))
    nodes = rows.withColumns(
        {
            "block": F.concat_ws("|", F.col("venue_id").cast("string"), F.col("day").cast("string")),
            "feats": F.concat(T.char_ngrams("title_key", 3), festival),
        }
    )
    return star_pass(rows, nodes, "pass6_venue_day_cross_source")


def core_title_pass(rows: DataFrame) -> DataFrame:
    rows = rows.filter((F.length("core_key") >= 6) & F.col("day").isNotNull())
    return group_pass(rows, ["core_key", "day"], "pass7_city_marker")


def festival_pass(rows: DataFrame) -> DataFrame:
    rows = rows.filter(F.col("festival_key").isNotNull() & F.col("day").isNotNull())
    return group_pass(rows, ["festival_key", "day"], "pass8_festival_sublisting")


PASSES = [
    artist_day_pass, title_day_pass, title_prefix_pass, near_date_pass, venue_or_contains_pass, venue_day_pass,
    core_title_pass, festival_pass,
]


def pass_mapping(events: DataFrame) -> DataFrame:
    """(old_id, keep_id, pass_name) of the eight passes; merged rows, kept or absorbed, take no
    part in later passes."""
    rows = match_columns(events)
    found = None
    for step in PASSES:
        mapping = cut_lineage(step(rows))
        found = mapping if found is None else found.unionByName(mapping)
        used = mapping.select(F.explode(F.array("old_id", "keep_id")).alias("id")).distinct()
        rows = rows.join(used, "id", "left_anti")
    return found


def collapse_by_strong_key(events: DataFrame, venues: DataFrame) -> MergeResult:
    mapping, keys = strong_key_mapping(events, venues)
    merged = absorb(events, mapping)
    fresh = keys.withColumnRenamed("dedup_key", "_dedup_key")
    table = merged.events.join(fresh, "id", "left").withColumn("dedup_key", F.coalesce("_dedup_key", "dedup_key"))
    return MergeResult(table.select(*events.columns), mapping, merged.log)


def auto_merge(events: DataFrame, venues: DataFrame) -> MergeResult:
    """Strong-key collapse, then the eight passes over what is left.

    A survivor of the collapse can be absorbed by a pass: the mapping leads every absorbed event to
    the one that is left in the end, with the step that absorbed it; the log keeps the steps.
    """
    first = collapse_by_strong_key(events, venues)
    table = cut_lineage(first.events)
    second = absorb(table, pass_mapping(table))
    steps = cut_lineage(first.mapping.select("old_id", "keep_id", "pass_name").unionByName(second.mapping.select("old_id", "keep_id", "pass_name")))
    mapping = resolve_chains(steps).join(steps.select("old_id", "pass_name"), "old_id")
    return MergeResult(second.events, mapping, first.log.unionByName(second.log))


def merge_pair(events: DataFrame, pairs: DataFrame) -> MergeResult:
    """Merge chosen pairs (keep_id, merge_id)."""
    mapping = pairs.select(
        F.col("merge_id").alias("old_id"), "keep_id", F.lit("manual_admin").alias("pass_name")
    )
    return absorb(events, mapping)


def drop_soft_merged(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, mapping): rows hidden by an earlier soft merge go when their survivor still exists. Where that one
    goes as well, the mapping leads to the event that is left."""
    soft = events.filter(F.col("merged_into_event_id").isNotNull()).select(
        F.col("id").alias("old_id"), F.col("merged_into_event_id").alias("keep_id")
    )
    mapping = soft.join(events.select(F.col("id").alias("keep_id")), "keep_id", "left_semi")
    mapping = resolve_chains(mapping)
    return events.join(mapping.select(F.col("old_id").alias("id")), "id", "left_anti"), mapping


# --- review lists ------------------------------------------------------------------------
def review_groups(events: DataFrame) -> DataFrame:
    """Members of same-title groups, one row each: (title_key, id, similarity, suggested_keep_id)."""
    rows = events.filter(is_active()).select(
        "id", F.col("start_date").cast("date").alias("day"), review_rank().alias("rank"),
        T.title_key(F.coalesce("normalized_title", "title")).alias("title_key"),
    ).filter(F.length("title_key") >= 3)
    groups = rows.groupBy("title_key").agg(
        F.count("*").alias("n"),
        F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        (F.count("day") < F.count("*")).alias("undated"),
        F.min("rank").alias("best"),
    ).filter("n > 1")
    one_day = F.coalesce(F.col("first_day") == F.col("last_day"), F.lit(True)) & (
        ~F.col("undated") | F.col("first_day").isNull()
    )
    return rows.join(groups, "title_key").select(
        "title_key", "id", F.lit("same_title_diff_day").alias("reason"),
        F.when(one_day, 0.97).otherwise(0.85).alias("similarity"),
        F.col("best.id").alias("suggested_keep_id"),
    )


def review_contained(events: DataFrame) -> DataFrame:
    """Titles of one artist inside each other at venues that do not contradict."""
    rows = events.filter(is_active() & F.col("artist_id").isNotNull()).select(
        "artist_id", "venue_id", T.title_key(F.coalesce("normalized_title", "title")).alias("title_key")
    ).distinct()
    pairs = containment_pairs(rows, "title_key", min_length=6, block=["artist_id"]).filter(F.length("short") >= 7)
    short = rows.select("artist_id", F.col("title_key").alias("short"), F.col("venue_id").alias("short_venue"))
    long = rows.select("artist_id", F.col("title_key").alias("long"), F.col("venue_id").alias("long_venue"))
    return (
        pairs.join(short, ["artist_id", "short"]).join(long, ["artist_id", "long"])
        .filter(F.col("short_venue").isNull() | F.col("long_venue").isNull() | (F.col("short_venue") == F.col("long_venue")))
        .select("artist_id", "short", "long", "short_venue", "long_venue",
                F.lit("same_artist_similar").alias("reason"), F.lit(0.75).alias("similarity"))
    )


# --- script variants ---------------------------------------------------------------------
def same_title_day_mapping(events: DataFrame) -> DataFrame:
    """Same unpunctuated title and day; an artist, then a venue, then age decides who stays."""
    rank = F.struct(F.col("artist_id").isNull(), F.col("venue_id").isNull(), F.col("created_at"), F.col("id"))
    rows = events.filter(F.col("start_date").isNotNull()).select(
        "id", rank.alias("rank"), F.col("start_date").cast("date").alias("day"),
        T.unpunctuated_title(F.coalesce("normalized_title", "title")).alias("title_key"),
    )
    return group_pass(rows.filter(F.length("title_key") >= 3), ["title_key", "day"], "same_title_day")


def exact_title_venue_losers(events: DataFrame) -> DataFrame:
    """(old_id, keep_id) of events with the same trimmed title and venue."""
    rank = F.struct(
        T.is_blank("poster_url"), F.col("artist_id").isNull(), F.col("start_date").isNull(),
        -F.coalesce(F.size("source_urls"), F.lit(0)), F.col("id"),
    )
    rows = events.filter(F.col("venue_id").isNotNull()).select(
        "id", rank.alias("rank"), T.strip(T.or_empty("title")).alias("title"), "venue_id"
    )
    return survivors(rows, ["title", "venue_id"], F.col("rank"))


def overlap_score() -> Column:
    return (
        F.when(T.is_blank("poster_url"), 0).otherwise(4) + F.when(F.col("artist_id").isNull(), 0).otherwise(3)
        + F.when(F.col("start_date").isNull(), 0).otherwise(2)
        + F.greatest(F.coalesce(F.size("source_urls"), F.lit(0)), F.lit(0))
    )


def stale_keys(events: DataFrame, venues: DataFrame) -> DataFrame:
    """Events whose stored normalised title or dedup key differs from what the rules give now."""
    named = venues.select(F.col("id").alias("venue_id"), F.col("normalized_name").alias("venue_name"))
    fresh = events.join(named, "venue_id", "left").select(
        "id", "normalized_title", "dedup_key",
        T.plain_title("title").alias("new_normalized_title"),
        T.event_key("title", "venue_name", F.col("start_date")).alias("new_dedup_key"),
    )
    changed = ~F.col("normalized_title").eqNullSafe(F.col("new_normalized_title")) | ~F.col("dedup_key").eqNullSafe(
        F.col("new_dedup_key")
    )
    return fresh.filter(changed)
