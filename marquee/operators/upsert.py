"""Provenance-aware upsert of normalised events."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructField, StructType

from ..functions import fixed_values as V
from ..functions import links as L
from ..functions.dates import at
from ..functions.nested import merge_maps
from ..functions.text import is_blank
from ..functions.validate import event_errors
from ..session import cut_lineage
from .lookups import existing_events, new_id

# The fields an upsert compares, and how they come in.
TRACKED = [
    "title", "poster_url", "start_date", "end_date", "ticket_open_date", "ticket_provider", "booking_url", "genre",
]
#: Every trust that a stored value can have; a blank one gives way to all.
LEVELS = sorted({-1, 0, V.UNKNOWN_SOURCE_TRUST, *V.SOURCE_TRUST.values()})
#: For a stored value unlike `first`, the (value, source, trust) in the end; for one like it, the `then_` ones, if any.
STEP = ["first", "value", "source", "trust", "then_value", "then_source", "then_trust"]
_SOURCES = "map<string,struct<source:string,at:timestamp>>"


def validated(incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, rejected) by the event rules."""
    checked = incoming.withColumn(
        "errors",
        event_errors(
            F.col("title"), F.col("start_date").cast("string"), F.col("end_date").cast("string"),
            F.col("status"), F.col("dedup_key"), F.col("source_name"),
        ),
    )
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def same_new_event(rows: DataFrame) -> DataFrame:
    """(dedup_key, leader): keys without a stored event that describe one new event.

    Keys belong together when a title and start day is seen under both; the smallest key spreads
    along those links until nothing changes. Rows are first reduced to distinct keys and titles.
    """
    state = cut_lineage(rows.select(
        "dedup_key", F.col("normalized_title").alias("title"), F.col("start_date").cast("date").alias("day"),
        F.col("dedup_key").alias("leader"),
    ).distinct())
    while True:
        by_key = state.groupBy("dedup_key").agg(F.min("leader").alias("_k"))
        by_title = state.filter((F.col("title") != "") & F.col("day").isNotNull()).groupBy("title", "day").agg(F.min("leader").alias("_t"))
        spread = state.join(by_key, "dedup_key").join(by_title, ["title", "day"], "left")
        new = cut_lineage(spread.select(
            "dedup_key", "title", "day", F.col("leader").alias("_old"), F.least("_k", F.coalesce("_t", "_k")).alias("leader")
        ))
        state = new.drop("_old")
        if new.filter("leader <> _old").isEmpty():
            return state.groupBy("dedup_key").agg(F.min("leader").alias("leader"))


def _typed(c: Column, field: StructField) -> Column:
    nested = isinstance(field.dataType, (ArrayType, MapType, StructType))
    return (c if nested else c.cast(field.dataType)).alias(field.name)


def _change(field: str, old: Column, new: Column) -> Column:
    return F.struct(F.lit(field).alias("field_name"), old.alias("old_value"), new.alias("new_value"))


def _as_incoming(field: str, events: DataFrame, incoming: DataFrame) -> Column:
    """A stored value as the text that an equal incoming one has."""
    return F.col(field).cast(incoming.schema[field].dataType).cast("string")


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a run of rows of one event, in order, does to each field, whatever is stored: see `steps`."""
    share, names = TaskContext.get().partitionId(), ["event_id", "share", *TRACKED]
    kinds = [pa.int32() if n in ("trust", "then_trust") else pa.string() for n in STEP]
    done: list[tuple] = []

    def steps_of(f: int) -> pa.Array:
        """Column by column, as an event has some 400 values; null where no row has the field."""
        touched = [held[f] for _, held in done if held[f] is not None]
        ends = accumulate((held[f] is not None) * len(LEVELS) for _, held in done)
        columns = zip(*chain.from_iterable(touched)) if touched else [()] * len(STEP)
        levels = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=STEP)
        blank = pa.array([held[f] is None for _, held in done], pa.bool_())
        return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), levels, mask=blank)

    def rows() -> pa.RecordBatch:
        ids = [pa.array([k for k, _ in done], pa.string()), pa.array([share] * len(done), pa.int32())]
        return pa.RecordBatch.from_arrays([*ids, *[steps_of(f) for f in range(len(TRACKED))]], names=names)

    key, only, held = None, [], []
    for batch in batches:
        filled = [f for f, c in enumerate(batch.columns[3:]) if c.null_count < len(c)]
        read = [batch.columns[i].to_numpy(zero_copy_only=False).tolist() for i in [0, 1, 2, *[3 + f for f in filled]]]
        for event_id, trust, source, *values in zip(*read):
            if event_id != key:
                if key is not None:
                    done.append((key, held))
                key, only, held = event_id, [None] * len(TRACKED), [None] * len(TRACKED)
            for f, value in zip(filled, values):
                if value is None:
                    continue
                if held[f] is None:
                    held[f], only[f] = [[None] * len(STEP) for _ in LEVELS], (value, trust)
                elif only[f] is not None:  # as long as no other value has come, only more trust has an effect
                    if value != only[f][0]:
                        only[f] = None
                    elif trust <= only[f][1]:
                        continue
                    else:
                        only[f] = value, trust
                for level, now in zip(LEVELS, held[f]):
                    if trust < level:
                        break
                    if now[0] is None:
                        now[:4] = value, value, source, trust
                        continue
                    if now[6] is None and value != now[0] or now[6] is not None and value != now[4] and trust >= now[6]:
                        now[4:] = value, source, trust
                    if value != now[1] and trust >= now[3]:
                        now[1:4] = value, source, trust
        yield rows()
        done.clear()
    if key is not None:
        done.append((key, held))
        yield rows()


def steps(rows: DataFrame) -> DataFrame:
    """event_id and, in order, the effect of its rows on each field, as one struct for each task that held some.

    Stored (value, trust) decides what a row does: it overwrites another value at equal or higher trust and leaves an
    equal one, with its trust, alone. For a trust level, all that matters of the stored value is whether it equals
    the first value that could overwrite it: if not, that one is taken and the rest follows; if it does, the first
    later one that differs is. So seven levels with two outcomes each stand for any number of rows, and effects of
    runs that follow one another are applied one by one: rows are dealt by event and order, and an event of any
    size is split over tasks.
    """
    texts = [F.when(~is_blank(f), F.col(f).cast("string")).alias(f) for f in TRACKED]
    order = ["event_id", "row_id", "source_name"]
    dealt = rows.select(*order, L.source_trust("source_name").alias("trust"), *texts).repartitionByRange(*order).sortWithinPartitions(*order)
    level = "array<struct<" + ",".join(f"{n}:{'int' if n in ('trust', 'then_trust') else 'string'}" for n in STEP) + ">>"
    schema = "event_id string, share int, " + ", ".join(f"{f} {level}" for f in TRACKED)
    shares = dealt.select("event_id", "trust", "source_name", *TRACKED).mapInArrow(_shares, schema)
    return shares.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("share", F.struct(*TRACKED).alias("of")))).alias("shares"))


def settled(field: str, stored: Column, source: Column) -> Column:
    """struct(v, s, t, moved): the stored value after all shares of the incoming rows, and whether any was taken."""
    blank = stored.isNull() | (stored == "")
    start = F.struct(
        stored.alias("v"), source.alias("s"), F.when(blank, LEVELS[0]).otherwise(L.source_trust(source)).cast("int").alias("t"), F.lit(False).alias("moved"))

    def apply(now: Column, share: Column) -> Column:
        step = F.get(share["of"][field], (F.array_position(F.array(*map(F.lit, LEVELS)), now["t"]) - 1).cast("int"))
        to = lambda v, s, t: F.struct(step[v].alias("v"), step[s].alias("s"), step[t].alias("t"), F.lit(True).alias("moved"))
        differs = ~now["v"].eqNullSafe(step["first"])
        return F.when(step["first"].isNull(), now).when(differs, to("value", "source", "trust")).when(
            step["then_trust"].isNotNull(), to("then_value", "then_source", "then_trust")).otherwise(now)

    return F.when(F.col("shares").isNull(), start).otherwise(F.aggregate("shares", start, apply))


def fold(rows: DataFrame) -> DataFrame:
    """All incoming rows of an event as one row: what they do to the tracked fields, and the other columns."""
    ended = F.max(F.col("status") == "ended")
    last_status = F.max(F.when(F.col("status").isNotNull(), F.struct("row_id", "status")))["status"]
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("row_id", c)))[c]
    folded = rows.groupBy("event_id").agg(
        F.when(ended, F.lit("ended")).otherwise(last_status).alias("status"),
        first("normalized_title").alias("normalized_title"), F.max(F.struct("row_id", "dedup_key"))["dedup_key"].alias("dedup_key"),
        first("description").alias("description"), first("artist_id").alias("artist_id"),
        F.min(F.struct("row_id", "venue_id"))["venue_id"].alias("venue_id"), first("source_name").alias("source_name"),
    )
    urls = rows.select("event_id", F.explode("source_urls").alias("u")).distinct().groupBy("event_id").agg(
        F.array_sort(F.collect_list("u")).alias("urls")
    )
    return folded.join(urls, "event_id", "left").join(steps(rows), "event_id", "left")


def upsert(incoming: DataFrame, events: DataFrame, as_of: str, hold: bool = False) -> dict[str, DataFrame]:
    """Insert or merge normalised rows; returns events, changes, actions and rejected.

    Rows carry row_id (arrival order) and the ids found for their artist and venue. Locked fields
    stay, status never leaves ended, a less trusted source cannot overwrite a filled field, links
    are united and booking links recomputed. Several rows of one event count as applied in order, so
    a batch gives what any split of it into batches gives; the change log shows the net effect of this one.
    """
    now = at(as_of)
    usable, rejected = validated(incoming)
    hits = cut_lineage(existing_events(usable, events))
    named = same_new_event(hits.filter(F.col("event_id").isNull())).select(
        F.col("dedup_key").alias("_key"), new_id("event", F.col("leader")).alias("_new")
    )
    keyed = hits.withColumn("_key", F.when(F.col("event_id").isNull(), F.col("dedup_key"))).join(named, "_key", "left")
    keyed = cut_lineage(keyed.withColumn("event_id", F.coalesce(F.col("event_id").cast("string"), "_new")).drop("_new", "_key"))
    folded = cut_lineage(fold(keyed)).withColumnsRenamed(
        {c: f"n_{c}" for c in ["status", "normalized_title", "dedup_key", "description", "artist_id", "venue_id", "source_name"]}
    )
    state = events.join(folded.withColumnRenamed("event_id", "id"), "id", "full")
    old = events.select("id", F.lit(True).alias("_old"))
    state = state.join(old, "id", "left").withColumn("_touched", F.col("n_source_name").isNotNull())
    inserted = F.col("_old").isNull()
    locked = F.coalesce("locked_fields", F.array().cast("array<string>"))
    sources = F.coalesce("field_sources", F.create_map().cast(_SOURCES))
    state = cut_lineage(state.select("*", *[
        settled(f, _as_incoming(f, events, incoming), F.try_element_at(sources, F.lit(f))["source"]).alias(f"_end_{f}") for f in TRACKED]).drop("shares"))
    out, changed = {}, []
    for f in TRACKED:
        end = F.col(f"_end_{f}")
        new = end["v"].cast(incoming.schema[f].dataType).cast(events.schema[f].dataType)
        moved = F.coalesce(end["moved"], F.lit(False)) & ~F.array_contains(locked, f)
        out[f] = F.when(moved, new).otherwise(F.col(f))
        changed.append((f, moved, F.col(f).cast("string"), new.cast("string"), end["s"]))
    take_status = (
        F.col("n_status").isNotNull() & ~F.array_contains(locked, "status")
        & ~F.coalesce(F.col("status") == "ended", F.lit(False)) & ~F.col("n_status").eqNullSafe(F.col("status"))
    )
    out["status"] = F.when(take_status, F.col("n_status")).otherwise(F.col("status"))
    take_artist = F.col("artist_id").isNull() & F.col("n_artist_id").isNotNull()
    out["artist_id"] = F.coalesce("artist_id", "n_artist_id")
    changes = F.array_compact(F.array(
        *[F.when(t & ~o.eqNullSafe(n), _change(f, o, n)) for f, t, o, n, _ in changed],
        F.when(take_status, _change("status", F.col("status"), F.col("n_status"))),
        F.when(take_artist, _change("artist_id", F.lit(None).cast("string"), F.col("n_artist_id").cast("string"))),
    ))
    stamps = F.map_from_entries(F.array_compact(F.array(
        *[F.when(t, F.struct(F.lit(f).alias("k"), F.struct(s.alias("source"), now.alias("at")).alias("v"))) for f, t, _, _, s in changed]
    )))
    link_type = events.schema["source_urls"].dataType
    links = F.array_union(F.coalesce("source_urls", F.array().cast(link_type)), F.coalesce("urls", F.array().cast(link_type)))
    state = state.withColumns({
        "_changes": changes, "_stamps": stamps, "_links": links,
        "_take_links": F.size(links) != F.greatest(F.coalesce(F.size("source_urls"), F.lit(0)), F.lit(0)),
        "_booking": out["booking_url"],
    })
    filled = F.lit(False)
    if "description" in events.columns:
        filled = F.col("description").isNull() & F.col("n_description").isNotNull()
    relinked = ~F.to_json(L.booking_links(F.col("_links"), F.col("_booking"))).eqNullSafe(F.to_json("booking_links"))
    moved = F.size(F.coalesce("_stamps", F.create_map().cast(_SOURCES))) > 0
    state = state.withColumn("_patched", (F.size("_changes") > 0) | moved | F.col("_take_links") | filled | relinked)
    if "description" in events.columns:
        out["description"] = F.coalesce("description", "n_description")
    touched = F.col("_touched")
    out |= {
        "field_sources": F.when(touched, merge_maps(F.col("field_sources"), F.col("_stamps"), _SOURCES)).otherwise(F.col("field_sources")),
        "source_urls": F.when(touched, F.col("_links")).otherwise(F.col("source_urls")),
        "booking_links": F.when(touched, L.booking_links(F.col("_links"), F.col("_booking"))).otherwise(F.col("booking_links")),
        "normalized_title": F.coalesce("normalized_title", "n_normalized_title"),
        "dedup_key": F.coalesce("n_dedup_key", "dedup_key"),
        "venue_id": F.when(inserted, F.col("n_venue_id")).otherwise(F.col("venue_id")),
        "source_name": F.when(inserted, F.col("n_source_name")).otherwise(F.col("source_name")),
        "crawled_at": F.when(touched & (inserted | F.col("_patched")), now).otherwise(F.col("crawled_at")),
        "created_at": F.when(inserted, now).otherwise(F.col("created_at")),
        "is_hidden": F.when(inserted, F.lit(hold)).otherwise(F.col("is_hidden")),
        "hidden_reason": F.when(inserted & F.lit(hold), F.lit("pending_classification")).otherwise(F.col("hidden_reason")),
        "hidden_at": F.when(inserted & F.lit(hold), now).otherwise(F.col("hidden_at")),
        "has_timetable": F.when(inserted, F.lit(False)).otherwise(F.col("has_timetable")),
    }
    state = cut_lineage(state)
    table = state.select(*[_typed(out.get(f.name, F.col(f.name)), f) for f in events.schema.fields])
    action = (
        F.when(inserted, "inserted").when(F.col("_patched"), "updated").otherwise("skipped")
    )
    acted = state.filter("_touched")
    return {
        "events": table,
        "changes": acted.filter(~inserted).select(F.col("id").alias("event_id"), F.explode("_changes").alias("c")).select("event_id", "c.*"),
        "actions": acted.select(F.col("id").alias("event_id"), action.alias("action")),
        "rejected": rejected,
    }


def real_changes(log: DataFrame) -> DataFrame:
    """Change-log rows whose value differs beyond the way a date is written."""
    def core(c: str) -> Column:
        text = F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
        day = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1)
        return F.when(day != "", day).otherwise(text)

    return log.filter(core("old_value") != core("new_value"))
