"""Duplicate artists: candidates, automatic merges and the merge itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from ..functions.nested import merge_maps
from .cluster import resolve_chains, survivors
from .merge_events import repoint
from .similarity import containment_pairs, jaccard_pairs, script_class

# Fields a survivor may take over.
FILL_FIELDS = ["name_en", "avatar_url", "occupation", "birth_date", "birth_place", "related", "label", "country"]


def _keyed(artists: DataFrame) -> DataFrame:
    source = F.coalesce(T.none_if_blank(F.col("normalized_name")), F.col("name"))
    return artists.withColumn("_key", T.name_key(source)).filter(F.col("_key") != "")


def _counted(artists: DataFrame, linked: DataFrame) -> DataFrame:
    """linked: (artist_id, linked_event_count)."""
    return artists.join(linked.withColumnRenamed("artist_id", "id"), "id", "left").fillna({"linked_event_count": 0})


def keep_rank() -> Column:
    return F.struct(
        (-F.col("linked_event_count")).alias("linked"),
        (-F.coalesce("followers_count", F.lit(0))).alias("followers"),
        F.col("id"),
    )


def exact_groups(artists: DataFrame, linked: DataFrame) -> DataFrame:
    """Members of groups with the same normalised name, one row each, with the suggested survivor."""
    rows = _counted(_keyed(artists), linked).select("_key", "id", "name", keep_rank().alias("rank"))
    best = rows.groupBy("_key").agg(F.count("*").alias("n"), F.min("rank").alias("best")).filter("n > 1")
    return rows.join(best, "_key").select(
        F.col("_key").alias("name_key"), "id", "name", F.col("best.id").alias("suggested_keep_id"),
        F.lit("exact_normalized").alias("reason"), F.lit(1.0).alias("similarity"),
    )


def alias_pairs(artists: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id_a, id_b) where an alias of one artist is any name of another; the newest entry of a name
    answers for it."""
    names = artists.select(
        "id", "created_at", F.explode(F.array_compact(F.array("name", "name_en", "normalized_name"))).alias("n")
    )
    owner = names.groupBy(F.lower("n").alias("n")).agg(F.min_by("id", F.struct("created_at", "id")).alias("owner"))
    hits = aliases.select("artist_id", F.lower("alias").alias("n")).join(owner, "n").filter("artist_id <> owner")
    known = artists.select(F.col("id").alias("artist_id"))
    hits = hits.join(known, "artist_id", "left_semi")
    return hits.select(
        F.least("artist_id", "owner").alias("id_a"), F.greatest("artist_id", "owner").alias("id_b")
    ).distinct()


def _to_ids(pairs: DataFrame, names: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of values as pairs of ids. Artist names are unique, so this is one row per pair."""
    left = names.select(F.col("value").alias(a), F.col("id").alias("_a"))
    right = names.select(F.col("value").alias(b), F.col("id").alias("_b"))
    return pairs.join(left, a).join(right, b).select(
        F.least("_a", "_b").alias("id_a"), F.greatest("_a", "_b").alias("id_b"), "similarity"
    ).filter("id_a <> id_b")


def token_pairs(artists: DataFrame, min_similarity: float = 0.85) -> DataFrame:
    names = artists.groupBy("name").agg(F.min("id").alias("id"))
    prepared = names.select(
        F.col("name"), T.name_tokens("name").alias("tokens"), script_class(F.col("name")).alias("script")
    )
    pairs = jaccard_pairs(prepared, "name", "tokens", min_similarity, script="script")
    return _to_ids(pairs, names.withColumnRenamed("name", "value"), "name_a", "name_b")


def contains_pairs(artists: DataFrame, min_ratio: float = 0.4) -> DataFrame:
    """Pairs whose normalised names lie inside each other; equal ones belong to the exact groups."""
    keyed = artists.select("id", T.name_key("name").alias("value")).filter(F.length("value") >= 2)
    one = keyed.groupBy("value").agg(F.min("id").alias("id"))
    pairs = containment_pairs(one.select("value"), "value", min_ratio).withColumnRenamed("ratio", "similarity")
    return _to_ids(pairs, one, "short", "long")


def duplicate_pairs(artists: DataFrame, aliases: DataFrame, min_similarity: float = 0.85) -> DataFrame:
    """All pair candidates with one reason each: alias, then tokens, then containment."""
    found = (
        alias_pairs(artists, aliases).select(
            "id_a", "id_b", F.lit(0).alias("place"), F.lit("alias_match").alias("reason"), F.lit(0.95).alias("similarity")
        )
        .unionByName(token_pairs(artists, min_similarity).select(
            "id_a", "id_b", F.lit(2).alias("place"), F.lit("token_overlap").alias("reason"), "similarity"))
        .unionByName(contains_pairs(artists).select(
            "id_a", "id_b", F.lit(3).alias("place"), F.lit("name_contains").alias("reason"), "similarity"))
    )
    first = F.min(F.struct("place", "reason", "similarity")).alias("r")
    return found.groupBy("id_a", "id_b").agg(first).select("id_a", "id_b", "r.reason", "r.similarity")


def ranked_candidates(pairs: DataFrame, linked: DataFrame, limit: int) -> DataFrame:
    """The review page: most similar first, then the most linked."""
    a = linked.select(F.col("artist_id").alias("id_a"), F.col("linked_event_count").alias("_a"))
    b = linked.select(F.col("artist_id").alias("id_b"), F.col("linked_event_count").alias("_b"))
    total = F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0))
    return (
        pairs.join(a, "id_a", "left").join(b, "id_b", "left").withColumn("linked_event_count", total).drop("_a", "_b")
        .orderBy(F.desc("similarity"), F.desc("linked_event_count"), "id_a", "id_b").limit(limit)
    )


# --- mappings ----------------------------------------------------------------------------
def exact_mapping(artists: DataFrame, linked: DataFrame) -> DataFrame:
    rows = _counted(_keyed(artists), linked)
    return survivors(rows, ["_key"], keep_rank())


def annotation_mapping(artists: DataFrame, linked: DataFrame) -> DataFrame:
    """``NAME (JP)`` into ``NAME``: only where a core has exactly one clean and one annotated name."""
    core, key = T.annotation_core("name"), T.name_key("name")
    rows = _counted(artists, linked).select("id", "name", "linked_event_count", core.alias("core"), key.alias("key"))
    rows = rows.filter(F.col("core") != "")
    clean = F.col("key") == F.col("core")
    annotated = T.has_annotation("name") & ~clean
    pick = lambda test, col: F.min(F.when(test, F.col(col)))
    groups = rows.groupBy("core").agg(
        F.count_if(clean).alias("n_clean"), F.count_if(annotated).alias("n_annotated"),
        pick(clean, "id").alias("clean_id"), pick(annotated, "id").alias("annotated_id"),
        pick(clean, "linked_event_count").alias("clean_n"), pick(annotated, "linked_event_count").alias("annotated_n"),
    ).filter("n_clean = 1 AND n_annotated = 1")
    swap = F.col("annotated_n") > F.col("clean_n")
    return groups.select(
        F.when(swap, F.col("clean_id")).otherwise(F.col("annotated_id")).alias("old_id"),
        F.when(swap, F.col("annotated_id")).otherwise(F.col("clean_id")).alias("keep_id"),
    )


def canonical_mapping(artists: DataFrame, events: DataFrame, column: str = "gemini_canon") -> DataFrame:
    """Artists with the same stored standard name of three characters or more."""
    led = events.filter(F.col("artist_id").isNotNull()).groupBy("artist_id").agg(F.count("*").alias("linked_event_count"))
    rows = _counted(artists.filter(F.length(column) >= 3), led)
    return survivors(rows, [column], F.struct((-F.col("linked_event_count")).alias("n"), F.col("id")))


# --- the merge ---------------------------------------------------------------------------
def merge_artists(
    artists: DataFrame, mapping: DataFrame, children: dict[str, DataFrame], aliases: DataFrame
) -> dict[str, DataFrame]:
    """Apply (old_id, keep_id) to artists, their aliases and everything that points at them.

    Chains are followed first, so the whole mapping applies at once.
    """
    mapping = resolve_chains(mapping)
    donors = artists.join(mapping.withColumnRenamed("old_id", "id"), "id")
    offers = [
        F.min(F.when(~T.is_blank(c), F.struct(F.col("id").alias("d"), F.col(c).alias("v")))).alias(f"_{c}")
        for c in FILL_FIELDS
    ]
    gifts = donors.groupBy("keep_id").agg(
        F.sum(F.coalesce("followers_count", F.lit(0))).alias("_followers"), *offers
    ).withColumnRenamed("keep_id", "id")
    links = (
        donors.select("keep_id", F.col("id").alias("d"), F.explode("sns_links").alias("k", "v"))
        .groupBy("keep_id", "k").agg(F.min(F.struct("d", "v")).alias("best"))
        .groupBy("keep_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "best.v"))).alias("_links"))
        .withColumnRenamed("keep_id", "id")
    )
    kept = artists.join(mapping.select(F.col("old_id").alias("id")), "id", "left_anti")
    kept = kept.join(gifts, "id", "left").join(links, "id", "left")
    filled = F.array_compact(
        F.array(*[F.when(T.is_blank(c) & F.col(f"_{c}").isNotNull(), F.lit(c)) for c in FILL_FIELDS])
    )
    kept = kept.withColumn("_filled", filled)
    for c in FILL_FIELDS:
        kept = kept.withColumn(c, F.when(T.is_blank(c), F.coalesce(F.col(f"_{c}.v"), F.col(c))).otherwise(F.col(c)))
    kept = kept.withColumn(
        "followers_count",
        (F.coalesce("followers_count", F.lit(0)) + F.coalesce("_followers", F.lit(0))).cast(
            artists.schema["followers_count"].dataType
        ),
    ).withColumn(
        "sns_links",
        F.when(F.col("_links").isNull(), F.col("sns_links")).otherwise(
            merge_maps(F.col("_links"), F.col("sns_links"), "map<string,string>")
        ),
    )
    out = dict(children)
    if "event_artists" in out:
        out["event_artists"] = repoint(out["event_artists"], mapping, "artist_id", ["event_id", "artist_id"])
    if "user_artist_followings" in out:
        out["user_artist_followings"] = repoint(
            out["user_artist_followings"], mapping, "artist_id", ["user_id", "artist_id"]
        )
    for name in ("timetable_performances", "events"):
        if name in out:
            out[name] = repoint(out[name], mapping, "artist_id")
    log = donors.select(
        F.col("keep_id").alias("keep_artist_id"), F.col("id").alias("merged_artist_id"),
        F.to_json(F.struct(*artists.columns)).alias("merged_snapshot"),
    ).join(
        kept.select(F.col("id").alias("keep_artist_id"), F.col("_filled").alias("filled_fields")), "keep_artist_id", "left"
    )
    out |= {
        "artists": kept.select(*artists.columns),
        "artist_aliases": merged_aliases(aliases, donors),
        "artist_merge_logs": log,
    }
    return out


def merged_aliases(aliases: DataFrame, donors: DataFrame) -> DataFrame:
    """The survivor's aliases plus the names and aliases of the merged, ignoring case."""
    names = donors.select(
        F.col("keep_id").alias("artist_id"),
        F.explode(F.array_compact(F.array("name", "name_en"))).alias("alias"), F.lit("merge").alias("source"),
    )
    moved = aliases.join(donors.select(F.col("id").alias("artist_id"), "keep_id"), "artist_id").select(
        F.col("keep_id").alias("artist_id"), "alias", F.coalesce("source", F.lit("merge")).alias("source")
    )
    own = aliases.join(donors.select(F.col("id").alias("artist_id")), "artist_id", "left_anti")
    taken = own.select("artist_id", F.lower("alias").alias("_l")).distinct()
    incoming = names.unionByName(moved).withColumn("_l", F.lower("alias")).join(taken, ["artist_id", "_l"], "left_anti")
    fresh = incoming.groupBy("artist_id", "_l").agg(F.min(F.struct("alias", "source")).alias("a"))
    return own.select("artist_id", "alias", "source").unionByName(fresh.select("artist_id", "a.alias", "a.source"))


def add_aliases(aliases: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert that ignores what is already there: (artist_id, alias, source)."""
    clean = incoming.withColumn("alias", T.strip("alias")).filter(F.col("alias") != "")
    fresh = clean.groupBy("artist_id", "alias").agg(F.min("source").alias("source"))
    fresh = fresh.join(aliases.select("artist_id", "alias"), ["artist_id", "alias"], "left_anti")
    return aliases.select("artist_id", "alias", "source").unionByName(fresh)


# --- joined records and proposals --------------------------------------------------------
def joined_records(artists: DataFrame) -> DataFrame:
    """(id, name, parts) of records that hold several performers."""
    parts = T.split_joined_names("name")
    return artists.filter(F.col("name").rlike(V.JOINED_NAMES)).select("id", "name", parts.alias("parts")).filter(
        F.size("parts") >= 2
    )


def decided_names(artists: DataFrame, proposals: DataFrame) -> DataFrame:
    """(id, decision, name, normalized_name, name_proposal) for (id, proposed_name, is_music)."""
    rows = artists.select("id", "name").join(proposals, "id")
    decision = T.name_decision("name", "proposed_name", "is_music")
    rows = rows.withColumn("decision", decision)
    auto = F.col("decision") == "auto"
    new = T.strip("proposed_name")
    return rows.select(
        "id", "decision",
        F.when(auto, new).otherwise(F.col("name")).alias("name"),
        F.when(auto, T.name_key("proposed_name")).alias("normalized_name"),
        F.when(F.col("decision") == "propose", new).alias("name_proposal"),
    )


def apply_proposals(
    artists: DataFrame, decisions: DataFrame, aliases: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(artists, aliases, conflicts) after (id, action, name_en, aliases) decisions.

    Approving a name another artist already has is a duplicate to merge, so it is only reported.
    """
    open_rows = artists.filter(F.col("name_proposal").isNotNull()).select(
        "id", F.col("name").alias("_old"), T.strip("name_proposal").alias("_new")
    )
    meta = decisions.select("id", "action", F.col("name_en").alias("_name_en"), F.col("aliases").alias("_aliases"))
    todo = open_rows.join(meta, "id")
    approve = todo.filter(F.col("action") == "approve")
    names = artists.select(F.col("name").alias("_new"), F.col("id").alias("other_id"))
    clash = approve.join(names, "_new").filter("id <> other_id")
    repeated = approve.groupBy("_new").agg(F.min("id").alias("_first"))
    late = approve.join(repeated, "_new").filter("id <> _first").select("id", "_new", F.col("_first").alias("other_id"))
    conflicts = clash.select("id", F.col("_new").alias("name"), "other_id").unionByName(
        late.select("id", F.col("_new").alias("name"), "other_id")
    )
    applied = todo.join(conflicts.select("id").distinct(), "id", "left_anti")
    state = artists.join(applied, "id", "left")
    approved, closed = F.col("action") == "approve", F.col("action").isin("approve", "reject")
    state = state.filter(~F.coalesce(F.col("action") == "delete_artist", F.lit(False)))
    state = state.withColumns({
        "name": F.when(approved, F.col("_new")).otherwise(F.col("name")),
        "normalized_name": F.when(approved, T.name_key("_new")).otherwise(F.col("normalized_name")),
        "name_en": F.when(approved, F.coalesce("_name_en", "name_en")).otherwise(F.col("name_en")),
        "name_proposal": F.when(~F.coalesce(closed, F.lit(False)), F.col("name_proposal")),
    })
    spelled = applied.filter(F.col("action") == "approve").select(
        F.col("id").alias("artist_id"),
        F.explode(F.array_compact(F.concat(F.array("_old", "_name_en"), F.coalesce("_aliases", F.array().cast("array<string>"))))).alias("alias"),
        F.lit("proposal-approve").alias("source"),
    )
    return state.select(*artists.columns), add_aliases(aliases, spelled), conflicts
