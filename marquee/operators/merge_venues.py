"""Duplicate and broken venues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from .cluster import resolve_chains, survivors
from .merge_events import repoint
from .similarity import containment_pairs, jaccard_pairs


def _counted(venues: DataFrame, counts: DataFrame) -> DataFrame:
    """counts: (venue_id, linked_event_count)."""
    return venues.join(counts.withColumnRenamed("venue_id", "id"), "id", "left").fillna({"linked_event_count": 0})


def exact_merge(venues: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mapping, held back): same normalised name and addresses that do not contradict.

    The survivor is the venue with the most events; it is compared with each member on its own.
    """
    rows = _counted(venues, counts).withColumn(
        "_key", T.venue_merge_key(F.coalesce("normalized_name", "name"))
    ).filter(F.col("_key") != "")
    rank = F.struct((-F.col("linked_event_count")).alias("n"), F.col("id").alias("id"))
    keep = rows.groupBy("_key").agg(F.min(F.struct(rank, "name", "address")).alias("k"), F.count("*").alias("n"))
    keep = keep.filter("n > 1").select(
        "_key", F.col("k.col1.id").alias("keep_id"), F.col("k.name").alias("keep_name"), F.col("k.address").alias("keep_address")
    )
    pairs = rows.join(keep, "_key").filter("id <> keep_id").withColumn("agree", T.addresses_agree("keep_address", "address"))
    mapping = pairs.filter("agree").select(F.col("id").alias("old_id"), "keep_id")
    held = pairs.filter("NOT agree").select(
        F.col("id").alias("venue_id"), "keep_id", F.col("keep_name").alias("name"), "keep_address", "address"
    )
    return mapping, held


def candidate_pairs(venues: DataFrame) -> DataFrame:
    """(id_a, id_b, reason, similarity): exact names to the first member, containment, token overlap."""
    key = T.venue_key(F.coalesce(T.none_if_blank(F.col("normalized_name")), F.col("name")))
    keyed = venues.select("id", "name", key.alias("k"), T.venue_key("name").alias("name_key"))
    firsts = keyed.filter(F.col("k") != "").groupBy("k").agg(F.min("id").alias("first"))
    exact = keyed.join(firsts, "k").filter("id <> first").select(
        F.least("id", "first").alias("id_a"), F.greatest("id", "first").alias("id_b"),
        F.lit(0).alias("place"), F.lit("exact_normalized").alias("reason"), F.lit(1.0).alias("similarity"),
    )
    names = keyed.groupBy("name_key").agg(F.min("id").alias("id")).filter(F.length("name_key") >= 2)
    inside = containment_pairs(names.select("name_key"), "name_key", 0.5)
    inside = (
        inside.join(names.select(F.col("name_key").alias("short"), F.col("id").alias("a")), "short")
        .join(names.select(F.col("name_key").alias("long"), F.col("id").alias("b")), "long")
        .select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), F.lit(1).alias("place"),
                F.lit("name_contains").alias("reason"), F.col("ratio").alias("similarity"))
    )
    spelled = venues.groupBy("name").agg(F.min("id").alias("id"))
    prepared = spelled.select("name", T.venue_tokens("name").alias("tokens"))
    overlap = jaccard_pairs(prepared, "name", "tokens", 0.7)
    overlap = (
        overlap.join(spelled.select(F.col("name").alias("name_a"), F.col("id").alias("a")), "name_a")
        .join(spelled.select(F.col("name").alias("name_b"), F.col("id").alias("b")), "name_b")
        .select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), F.lit(2).alias("place"),
                F.lit("token_overlap").alias("reason"), "similarity")
    )
    found = exact.unionByName(inside).unionByName(overlap)
    first = F.min(F.struct("place", "reason", "similarity")).alias("r")
    return found.groupBy("id_a", "id_b").agg(first).select("id_a", "id_b", "r.reason", "r.similarity")


def suggested_keep(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    a = counts.select(F.col("venue_id").alias("id_a"), F.col("linked_event_count").alias("_a"))
    b = counts.select(F.col("venue_id").alias("id_b"), F.col("linked_event_count").alias("_b"))
    rows = pairs.join(a, "id_a", "left").join(b, "id_b", "left").fillna({"_a": 0, "_b": 0})
    return rows.withColumn(
        "suggested_keep_id", F.when(F.col("_b") > F.col("_a"), F.col("id_b")).otherwise(F.col("id_a"))
    ).drop("_a", "_b")


def merge_venues(venues: DataFrame, mapping: DataFrame, events: DataFrame, event_venues: DataFrame) -> dict[str, DataFrame]:
    """Apply (old_id, keep_id): move events and links, fill address and phone, drop the merged."""
    mapping = resolve_chains(mapping)
    donors = venues.join(mapping.withColumnRenamed("old_id", "id"), "id")
    offers = [
        F.min(F.when(~T.is_blank(c), F.struct(F.col("id").alias("d"), F.col(c).alias("v")))).alias(f"_{c}")
        for c in ("address", "phone_number")
    ]
    gifts = donors.groupBy("keep_id").agg(*offers).withColumnRenamed("keep_id", "id")
    kept = venues.join(mapping.select(F.col("old_id").alias("id")), "id", "left_anti").join(gifts, "id", "left")
    for c in ("address", "phone_number"):
        kept = kept.withColumn(c, F.when(T.is_blank(c), F.coalesce(F.col(f"_{c}.v"), F.col(c))).otherwise(F.col(c)))
    return {
        "venues": kept.select(*venues.columns),
        "events": repoint(events, mapping, "venue_id"),
        "event_venues": repoint(event_venues, mapping, "venue_id", ["event_id", "venue_id"]),
        "venue_merge_logs": donors.select(
            F.col("keep_id").alias("keep_venue_id"), F.col("id").alias("merged_venue_id"),
            F.to_json(F.struct(*venues.columns)).alias("snapshot"),
        ),
    }


def cleanup_plan(venues: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, action, target_name, target_id): what to do with mis-scraped, doubled and hall venues.

    target_name is a venue to find or create; target_id an existing one; both null means the
    events lose their venue.
    """
    trash = F.contains("name", F.lit(V.TRASH_VENUE_MARK))
    real = T.trash_venue_name("name")
    broken = F.col("name").rlike(V.CLEANUP_PRICE) | F.col("name").rlike(V.CLEANUP_TICKET)
    owner = T.hall_owner("name")
    rows = _counted(venues, counts)
    clean = rows.filter(~trash).withColumn("_key", F.lower(T.strip("name")))
    doubles = survivors(clean, ["_key"], F.struct((-F.col("linked_event_count")).alias("n"), F.col("id")))
    doubled = doubles.withColumnRenamed("old_id", "id")
    rows = rows.join(doubled, "id", "left")
    action = (
        F.when(trash, "relink").when(F.col("keep_id").isNotNull(), "merge_exact").when(broken, "drop")
        .when(owner.isNotNull(), "merge_hall")
    )
    target = F.when(trash & (F.length(real) >= 2), real).when(F.col("keep_id").isNull() & ~broken & ~trash, owner)
    return rows.select("id", "name", action.alias("action"), target.alias("target_name"), F.col("keep_id").alias("target_id")).filter(
        F.col("action").isNotNull()
    )


def apply_cleanup(
    venues: DataFrame, plan: DataFrame, events: DataFrame, event_venues: DataFrame
) -> dict[str, DataFrame]:
    """Apply a cleanup plan; missing target venues are created from their names."""
    going = plan.select("id")
    named = plan.filter(F.col("target_name").isNotNull())
    staying = venues.join(going, "id", "left_anti")
    existing = staying.groupBy(F.lower("name").alias("_l")).agg(F.min("id").alias("found_id"))
    wanted = named.select(F.lower("target_name").alias("_l"), "target_name").groupBy("_l").agg(F.min("target_name").alias("target_name"))
    missing = wanted.join(existing, "_l", "left_anti").select(
        "_l", "target_name", F.concat(F.lit("venue-"), F.substring(F.sha2("_l", 256), 1, 16)).alias("found_id")
    )
    known = existing.unionByName(missing.select("_l", "found_id"))
    mapping = plan.join(known.withColumnRenamed("_l", "_k"), F.lower("target_name") == F.col("_k"), "left").select(
        F.col("id").alias("old_id"), F.coalesce("target_id", "found_id").alias("keep_id")
    )
    chained = resolve_chains(mapping.filter("keep_id IS NOT NULL"))
    blank = [c for c in venues.columns if c not in ("id", "name")]
    created = missing.select(
        F.col("found_id").alias("id"), F.col("target_name").alias("name"),
        *[F.lit(None).cast(venues.schema[c].dataType).alias(c) for c in blank],
    )
    lost = mapping.filter("keep_id IS NULL").select(F.col("old_id").alias("venue_id"))
    moved = repoint(events, chained, "venue_id")
    stays = moved.join(lost.withColumn("_lost", F.lit(True)), "venue_id", "left")
    moved = stays.withColumn("venue_id", F.when(F.col("_lost").isNull(), F.col("venue_id"))).select(*events.columns)
    links = repoint(event_venues.join(lost, "venue_id", "left_anti"), chained, "venue_id", ["event_id", "venue_id"])
    return {"venues": staying.unionByName(created), "events": moved, "event_venues": links, "mapping": mapping}


def unused_venues(venues: DataFrame, events: DataFrame) -> DataFrame:
    used = events.filter(F.col("venue_id").isNotNull()).select(F.col("venue_id").alias("id"))
    return venues.join(used, "id", "left_anti")
