"""Matching raw names against what is known, and creating what is not."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from ..functions.validate import artist_errors, venue_errors
from ..session import cut_lineage
from .merge_artists import add_aliases, joined_records
from .similarity import asked_for, contained_names, spread_out


def new_id(prefix: str, key: Column) -> Column:
    """A stable id for a created row: the same name gives the same id on every attempt."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(key, 256), 1, 16))


def match_artists(names: DataFrame, artists: DataFrame, aliases: DataFrame) -> DataFrame:
    """(raw_name, artist_id, matched_by) for distinct raw names: by name, then key, then alias.

    Every side is first reduced to one row per key, so a key shared by many rows cannot multiply.
    """
    oldest = F.min_by("id", F.struct("created_at", "id"))
    by_name = artists.groupBy(F.lower("name").alias("_name")).agg(oldest.alias("_id1"))
    by_key = artists.filter(F.col("normalized_name").isNotNull()).groupBy(F.lower("normalized_name").alias("_key")).agg(
        oldest.alias("_id2")
    )
    by_alias = aliases.groupBy(F.lower("alias").alias("_name")).agg(F.min("artist_id").alias("_id3"))
    raw = names.select("raw_name").distinct().filter(T.strip("raw_name") != "")
    raw = raw.withColumn("_name", F.lower(T.strip("raw_name"))).withColumn("_key", T.name_key("raw_name"))
    hit = raw.join(by_name, "_name", "left").join(by_key, "_key", "left").join(by_alias, "_name", "left")
    return hit.select(
        "raw_name",
        F.coalesce("_id1", "_id2", "_id3").alias("artist_id"),
        F.when(F.col("_id1").isNotNull(), "name").when(F.col("_id2").isNotNull(), "key")
        .when(F.col("_id3").isNotNull(), "alias").alias("matched_by"),
    )


def match_or_create_artists(
    names: DataFrame, artists: DataFrame, aliases: DataFrame, profiles: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(matches, artists, aliases, rejected) for a batch of raw names.

    Unknown names are structured and validated; names with the same display name become one
    artist, and every spelling is kept as an alias. Profiles (name, avatar_url, occupation,
    birth_date, birth_place, related) fill blanks only.
    """
    found = cut_lineage(match_artists(names, artists, aliases))
    unknown = found.filter(F.col("artist_id").isNull()).select("raw_name", T.structured_name("raw_name").alias("s"))
    unknown = unknown.select("raw_name", "s.*").withColumn(
        "errors", artist_errors(F.col("display_name"), F.lit(None).cast("string"))
    )
    rejected = unknown.filter(F.size("errors") > 0).select("raw_name", "errors")
    usable = unknown.filter(F.size("errors") == 0)
    # a display name that already exists is that artist, spelled differently
    existing = artists.groupBy(F.lower("name").alias("_l")).agg(F.min("id").alias("existing_id"))
    usable = usable.withColumn("_l", F.lower("display_name")).join(existing, "_l", "left").withColumn(
        "artist_id", F.coalesce("existing_id", new_id("artist", F.col("_l")))
    )
    usable = cut_lineage(usable)
    created = usable.filter(F.col("existing_id").isNull()).groupBy("artist_id").agg(
        F.min(F.struct("raw_name", "display_name", "name_key", "name_en")).alias("r")
    )
    values = {
        "id": F.col("artist_id"), "name": F.col("r.display_name"), "normalized_name": F.col("r.name_key"),
        "name_en": F.col("r.name_en"), "followers_count": F.lit(0), "upcoming_event_count": F.lit(0),
    }
    fields = artists.schema.fields
    fresh = created.select(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    )
    everyone = artists.unionByName(fresh)
    matches = found.filter(F.col("artist_id").isNotNull()).select("raw_name", F.col("artist_id").cast("string")).unionByName(
        usable.select("raw_name", F.col("artist_id").cast("string"))
    )
    spelled = usable.select(
        "artist_id", F.explode(F.array_distinct(F.concat(F.array("raw_name"), F.col("aliases")))).alias("alias"),
        F.lit("ingest").alias("source"),
    )
    if profiles is not None:
        everyone = fill_profiles(everyone, matches, profiles)
    return matches, everyone, add_aliases(aliases, spelled), rejected


def fill_profiles(artists: DataFrame, matches: DataFrame, profiles: DataFrame) -> DataFrame:
    """Fill blank artist fields from the profiles crawled with the names."""
    fields = [c for c in ("avatar_url", "occupation", "birth_date", "birth_place", "related") if c in profiles.columns]
    keyed = profiles.withColumn("_k", T.name_key("name")).join(
        matches.select(T.name_key("raw_name").alias("_k"), "artist_id").distinct(), "_k"
    )
    best = keyed.groupBy(F.col("artist_id").alias("id")).agg(
        *[F.min(F.when(~T.is_blank(c), F.col(c))).alias(f"_{c}") for c in fields]
    )
    out = artists.join(best, "id", "left")
    for c in fields:
        out = out.withColumn(c, F.when(T.is_blank(c), F.coalesce(F.col(f"_{c}"), F.col(c))).otherwise(F.col(c)))
    return out.select(*artists.columns)


def match_or_create_venues(raw: DataFrame, venues: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches, venues, rejected) for distinct (venue_name, venue_address)."""
    rows = raw.groupBy("venue_name").agg(F.min(T.strip("venue_address")).alias("venue_address"))
    rows = rows.withColumn("clean", T.plain_venue_name("venue_name")).filter(F.col("clean").isNotNull())
    rows = rows.withColumn("stored", T.cut_venue_info("venue_name"))
    by_name = venues.groupBy(F.lower("name").alias("_n")).agg(F.min("id").alias("_id1"))
    by_key = venues.groupBy(F.lower("normalized_name").alias("_k")).agg(F.min("id").alias("_id2"))
    hit = rows.join(by_name, F.lower("stored") == F.col("_n"), "left").join(by_key, F.col("clean") == F.col("_k"), "left")
    hit = hit.withColumn("errors", venue_errors(F.col("stored"), F.col("venue_address")))
    hit = cut_lineage(hit.withColumn("_known", F.coalesce("_id1", "_id2")))
    good = F.size("errors") == 0
    new = hit.filter(F.col("_known").isNull() & good).withColumn("_id", new_id("venue", F.col("clean")))
    created = new.groupBy(F.col("_id")).agg(F.min(F.struct("stored", "clean", "venue_address")).alias("r"))
    values = {
        "id": F.col("_id"), "name": F.col("r.stored"), "normalized_name": F.col("r.clean"),
        "address": F.coalesce("r.venue_address", F.lit("")), "phone_number": F.lit(""),
    }
    fresh = created.select(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in venues.schema.fields]
    )
    matches = hit.filter(F.col("_known").isNotNull()).select("venue_name", F.col("_known").cast("string").alias("venue_id")).unionByName(
        new.select("venue_name", F.col("_id").alias("venue_id"))
    )
    rejected = hit.filter(F.col("_known").isNull() & ~good).select("venue_name", "errors")
    return matches, venues.unionByName(fresh), rejected


def event_artist_rows(lineups: DataFrame, matches: DataFrame) -> DataFrame:
    """Lineup edges from (event_id, names, source_name): first matched act is primary.

    Names that found no artist leave no gap in the display order, which is counted inside the
    event's own list.
    """
    spread = lineups.select("event_id", "source_name", F.posexplode("names").alias("pos", "raw_name"))
    hit = spread.join(matches, "raw_name")
    one = hit.groupBy("event_id", "artist_id").agg(
        F.min(F.struct("pos", "raw_name", "source_name")).alias("r")
    )
    place = F.row_number().over(Window.partitionBy("event_id").orderBy("r.pos"))
    return one.withColumn("display_order", place).select(
        "event_id", "artist_id", F.col("r.raw_name").alias("artist_name"),
        F.when(F.col("display_order") == 1, "primary").otherwise("lineup").alias("role"),
        "display_order", "r.source_name",
    )


def replace_links(edges: DataFrame, edits: DataFrame, artists: DataFrame) -> DataFrame:
    """Replace the lineup of events by ordered id lists (event_id, artist_ids); null keeps it."""
    given = edits.filter(F.col("artist_ids").isNotNull())
    kept = edges.join(given.select("event_id"), "event_id", "left_anti")
    fresh = given.select("event_id", F.posexplode("artist_ids").alias("display_order", "artist_id"))
    named = fresh.join(artists.select(F.col("id").alias("artist_id"), F.col("name").alias("artist_name")), "artist_id")
    return kept.select("event_id", "artist_id", "artist_name", "role", "display_order").unionByName(
        named.select("event_id", "artist_id", "artist_name", F.lit("lineup").alias("role"), "display_order")
    )


def replace_venue_links(edges: DataFrame, edits: DataFrame) -> DataFrame:
    given = edits.filter(F.col("venue_ids").isNotNull())
    kept = edges.join(given.select("event_id"), "event_id", "left_anti").select("event_id", "venue_id", "display_order")
    return kept.unionByName(given.select("event_id", F.posexplode("venue_ids").alias("display_order", "venue_id")).select(
        "event_id", "venue_id", "display_order"
    ))


def titles_naming_artists(events: DataFrame, artists: DataFrame) -> DataFrame:
    """(event_id, artist_id, artist_name): the longest artist name found in each title.

    Names of up to three characters must stand alone in the title. They are looked up as words of
    the title, longer ones through the containment join.
    """
    acts = artists.select("id", "name", T.link_text("name").alias("norm")).filter(F.length("norm") >= 2)
    acts = acts.groupBy("norm").agg(F.min_by(F.struct("id", "name"), F.struct(-F.length("name"), "name", "id")).alias("a"))
    acts = acts.select("norm", F.col("a.id").alias("artist_id"), F.col("a.name").alias("artist_name"))
    titles = events.select(F.col("id").alias("event_id"), "title", T.link_text("title").alias("norm_title"))
    long = acts.filter(F.length("norm") > 3)
    hits = contained_names(titles, "norm_title", long, "norm").select(
        F.col("text").alias("norm_title"), F.col("name").alias("norm")
    )
    by_text = titles.join(spread_out(hits), "norm_title").join(long, "norm").select("event_id", "artist_id", "artist_name")
    short = acts.filter(F.length("norm") <= 3).withColumn("low", F.lower("artist_name"))
    spots = titles.select(
        "event_id", F.lower("title").alias("t"),
        F.explode(F.concat(T.char_ngrams("norm_title", 2), T.char_ngrams("norm_title", 3))).alias("norm"),
    )
    # the spelled name must stand alone: no letter may continue it on either side
    boundary = F.concat(F.lit("(?<![a-z가-힣])\\Q"), F.col("low"), F.lit("\\E(?![a-z가-힣])"))
    alone = spread_out(asked_for(spots, short, "norm")).join(short, "norm").filter(F.regexp_like("t", boundary)).select("event_id", "artist_id", "artist_name")
    rank = F.struct(-F.length("artist_name"), "artist_name", "artist_id")
    best = by_text.unionByName(alone).groupBy("event_id").agg(F.min_by(F.struct("artist_id", "artist_name"), rank).alias("a"))
    return best.select("event_id", "a.artist_id", "a.artist_name")


def link_status(events: DataFrame, artists: DataFrame) -> DataFrame:
    """(id, artist_link_status, artist_id) for unlinked events: festivals are multi_artist, a
    title that names an artist is linked, the rest is no_artist."""
    unlinked = events.filter(F.col("artist_id").isNull()).select("id", "title")
    named = titles_naming_artists(unlinked, artists).withColumnRenamed("event_id", "id")
    multi = T.is_multi_artist_title("title")
    joined = unlinked.join(named, "id", "left")
    return joined.select(
        "id",
        F.when(multi, "multi_artist").when(F.col("artist_id").isNotNull(), "linked").otherwise("no_artist").alias(
            "artist_link_status"
        ),
        F.when(~multi, F.col("artist_id")).alias("artist_id"),
    )


def existing_events(incoming: DataFrame, events: DataFrame) -> DataFrame:
    """Incoming rows with event_id: by dedup key, else the oldest event with that title and start day."""
    by_key = events.filter(F.col("dedup_key").isNotNull()).groupBy("dedup_key").agg(
        F.min_by("id", F.struct("created_at", "id")).alias("_by_key")
    )
    by_title = events.filter(F.col("normalized_title") != "").groupBy(
        "normalized_title", F.col("start_date").cast("date").alias("start_day")
    ).agg(F.min_by("id", F.struct("created_at", "id")).alias("_by_title"))
    rows = incoming.withColumn("start_day", F.col("start_date").cast("date"))
    hit = rows.join(by_key, "dedup_key", "left").join(by_title, ["normalized_title", "start_day"], "left")
    return hit.select(*incoming.columns, F.coalesce("_by_key", "_by_title").alias("event_id"))


def with_verdicts(titles: DataFrame, cache: DataFrame) -> DataFrame:
    """Titles with their cached verdict; an empty key is kept without asking anyone."""
    keyed = titles.withColumn("title_key", T.title_key("title"))
    return keyed.join(cache.select("title_key", "verdict"), "title_key", "left").withColumn(
        "verdict", F.when(F.col("title_key") == "", F.lit("keep")).otherwise(F.col("verdict"))
    )


def is_non_concert(title: Column, start: Column, end: Column) -> Column:
    """Keyword and length rules, waived for titles that say they are concerts."""
    low = F.lower(title)
    concert = low.rlike(T.any_word(V.CONCERT_WORDS))
    too_long = F.coalesce(F.date_diff(end, start) > V.MAX_RUN_DAYS, F.lit(False))
    return (T.strip(title) == "") | (~concert & (low.rlike(T.any_word(V.CLEANUP_WORDS)) | too_long))


def intake_excluded(title: Column, start: Column, end: Column) -> Column:
    return F.lower(title).rlike(T.any_word(V.INTAKE_EXCLUDED_WORDS)) | F.coalesce(
        F.date_diff(end, start) > V.MAX_RUN_DAYS, F.lit(False)
    )


# --- records that hold several performers -----------------------------------------------------
class SplitResult(NamedTuple):
    artists: DataFrame
    aliases: DataFrame
    edges: DataFrame
    events: DataFrame
    performances: DataFrame
    split: DataFrame


def split_joined(artists: DataFrame, aliases: DataFrame, edges: DataFrame, events: DataFrame, performances: DataFrame) -> SplitResult:
    """Records that hold several performers give way to these: found by name, key or alias, else created.

    Each lineup place of such a record becomes one place per performer, in the order of the name, the first as
    main act; places that an event already has stay, and of several that come new the foremost one is kept. The
    event's own artist and timetable slots move to the first performer. A record with fewer than two different
    performers is left as it is. ``split`` is (id, artist_id, artist_name, place), one row per performer.
    """
    joined = cut_lineage(joined_records(artists).select(F.col("id").alias("joined_id"), F.posexplode("parts").alias("at", "raw_name")))
    ids = joined.select("joined_id").distinct()
    single = artists.join(ids, F.col("id") == F.col("joined_id"), "left_anti")
    own = aliases.join(ids, F.col("artist_id") == F.col("joined_id"), "left_anti")
    matches, known, spelled, _ = match_or_create_artists(joined.select("raw_name"), single, own)
    found = joined.join(matches, "raw_name").groupBy("joined_id", "artist_id").agg(F.min(F.struct("at", "raw_name")).alias("m"))
    acts = found.groupBy("joined_id").agg(F.array_sort(F.collect_list(F.struct("m.at", "artist_id", "m.raw_name"))).alias("acts"))
    acts = cut_lineage(acts.filter(F.size("acts") > 1))  # at most the names in one name
    split = acts.select(F.col("joined_id").alias("id"), F.posexplode("acts").alias("k", "a")).select(
        "id", "a.artist_id", F.col("a.raw_name").alias("artist_name"), (F.col("k") + 1).alias("place"))
    gone = acts.select(F.col("joined_id").alias("id"))
    everyone = known.unionByName(artists.join(ids, F.col("id") == F.col("joined_id"), "left_semi").join(gone, "id", "left_anti").select(known.columns))
    kept_aliases = spelled.unionByName(
        aliases.join(ids, F.col("artist_id") == F.col("joined_id"), "left_semi").join(gone, F.col("artist_id") == F.col("id"), "left_anti")
        .select("artist_id", "alias", "source"))

    old = edges.withColumn("artist_id", F.col("artist_id").cast("string"))
    stay = old.join(gone, F.col("artist_id") == F.col("id"), "left_anti")
    split_up = old.select("event_id", F.col("artist_id").alias("id")).distinct().join(split, "id")
    fresh = split_up.groupBy("event_id", "artist_id").agg(F.min(F.struct("place", "id", "artist_name")).alias("p"))
    fresh = fresh.join(stay.select("event_id", "artist_id"), ["event_id", "artist_id"], "left_anti")
    values = {
        "event_id": F.col("event_id"), "artist_id": F.col("artist_id"), "artist_name": F.col("p.artist_name"),
        "role": F.when(F.col("p.place") == 1, "main").otherwise("lineup"), "display_order": F.col("p.place"),
    }
    fresh = fresh.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in old.schema.fields])
    first = split.filter("place = 1").select(F.col("id").alias("_joined"), F.col("artist_id").alias("_first"))

    def led(rows: DataFrame) -> DataFrame:
        both = rows.join(first, F.col("artist_id").cast("string") == F.col("_joined"), "left")
        return both.withColumn("artist_id", F.coalesce("_first", F.col("artist_id").cast("string"))).select(*rows.columns)

    return SplitResult(everyone, kept_aliases, stay.unionByName(fresh), led(events), led(performances), split)
