"""Popularity and trending scores, explained signal by signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.dates import at, days_before, freshness_score, moment
from ..functions.maths import cents, log_compress, min_max, round0, round2, thousands
from ..session import cut_lineage

# Buckets per unit of ln(1 + v): at most a few tens of thousands of buckets for any double.
_BUCKETS_PER_LOG = 64


def strictly_below(values: DataFrame, group: str = "key", value: str = "value") -> DataFrame:
    """(group, value, n_below): how many rows of the group lie strictly below each value.

    Values are first counted, so a value shared by a third of the rows is one row from there on.
    A monotone bucket of ln(1 + v) then splits the running count: totals of the buckets are
    summed over a table whose size is bounded by the exponent range of a double, and only the
    values inside one bucket are ever sorted together. Values must not be negative.
    """
    bucket = F.floor(F.log1p(F.col(value)) * _BUCKETS_PER_LOG)
    counted = values.groupBy(group, value).agg(F.count("*").alias("n")).withColumn("bucket", bucket)
    totals = counted.groupBy(group, "bucket").agg(F.sum("n").alias("bucket_n"))
    before = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("bucket_n").over(before), F.lit(0)))
    inside = Window.partitionBy(group, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        counted.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(totals.select(group, "bucket", "before"), [group, "bucket"])
        .select(group, value, (F.col("before") + F.col("inside")).alias("n_below"))
    )


def normalise_signals(signals: DataFrame, min_population: int = V.MIN_POPULATION) -> DataFrame:
    """(id, key, value) -> normalized 0-100, method and low_confidence per row.

    Counts become percentiles (share strictly below) once the population is large enough, and
    log min-max below that. Bounded signals are scaled by their bounds. Zero has nothing below
    it, so the zero rows, usually the bulk, never take part in the rank join.
    """
    bounded = signals.filter(F.col("key").isin(list(V.BOUNDED_SIGNALS)))
    counts = signals.filter(~F.col("key").isin(list(V.BOUNDED_SIGNALS))).withColumn(
        "clamped", F.greatest(F.col("value"), F.lit(0.0))
    )
    population = counts.groupBy("key").agg(
        F.count("*").alias("n"), F.min("clamped").alias("least"), F.max("clamped").alias("most")
    )
    ranks = strictly_below(counts.select("key", F.col("clamped").alias("value"))).withColumnsRenamed(
        {"value": "clamped"}
    )
    counts = counts.join(F.broadcast(population), "key")  # one row per signal key
    zero = counts.filter(F.col("clamped") == 0).withColumn("n_below", F.lit(0).cast("long"))
    positive = counts.filter(F.col("clamped") > 0).join(ranks, ["key", "clamped"])
    ranked = zero.unionByName(positive)
    large = F.col("n") >= min_population
    ranked = ranked.select(
        "id",
        "key",
        "value",
        F.when(large, F.col("n_below") / F.col("n") * 100)
        .otherwise(min_max(log_compress(F.col("clamped")), log_compress(F.col("least")), log_compress(F.col("most"))))
        .alias("normalized"),
        F.when(large, F.lit("percentile")).otherwise(F.lit("log_min_max")).alias("method"),
        (~large).alias("low_confidence"),
    )
    low = F.create_map(*[F.lit(x) for k, (a, _) in V.BOUNDED_SIGNALS.items() for x in (k, a)])
    high = F.create_map(*[F.lit(x) for k, (_, b) in V.BOUNDED_SIGNALS.items() for x in (k, b)])
    scaled = bounded.select(
        "id",
        "key",
        "value",
        min_max(F.col("value"), F.try_element_at(low, F.col("key")), F.try_element_at(high, F.col("key"))).alias(
            "normalized"
        ),
        F.lit("min_max").alias("method"),
        F.lit(False).alias("low_confidence"),
    )
    return ranked.unionByName(scaled)


def renormalised_weights(signals: list[tuple[str, float, str]]) -> list[tuple[str, float, str]]:
    total = 0.0
    for _, weight, _ in signals:
        total += weight
    return [(key, weight / (total or 1.0), label) for key, weight, label in signals]


def to_signal_rows(wide: DataFrame, keys: list[str], *keep: str) -> DataFrame:
    """One (id, key, value) row per signal of a wide table."""
    entries = F.array(
        *[F.struct(F.lit(k).alias("key"), F.coalesce(F.col(k).cast("double"), F.lit(0.0)).alias("value")) for k in keys]
    )
    return wide.select("id", *keep, F.explode(entries).alias("s")).select("id", *keep, "s.key", "s.value")


def score_entities(
    wide: DataFrame,
    signals: list[tuple[str, float, str]],
    reason: dict[str, Column] | None,
    notes: Column,
    as_of: Column,
) -> DataFrame:
    """(id, popularity_score, low_confidence, score_breakdown) from one row of signals per entity."""
    weighted = renormalised_weights(signals)
    wide = cut_lineage(wide)  # read once per step below instead of recomputing every count
    rows = normalise_signals(to_signal_rows(wide, [k for k, _, _ in weighted]))
    place = F.create_map(*[F.lit(x) for i, (k, _, _) in enumerate(weighted) for x in (k, i)])
    weight = F.create_map(*[F.lit(x) for k, w, _ in weighted for x in (k, w)])
    label = F.create_map(*[F.lit(x) for k, _, name in weighted for x in (k, name)])
    key = F.col("key")
    rows = (
        rows.withColumn("place", F.try_element_at(place, key))
        .withColumn("weight", F.try_element_at(weight, key))
        .withColumn("label", F.try_element_at(label, key))
        .withColumn("contribution", F.col("normalized") * F.col("weight"))
    )
    text = reason_text() if reason is None else reason_text(reason)
    entry = F.struct(
        F.col("place"),
        F.col("contribution").alias("exact"),
        F.struct(
            key.alias("key"),
            F.col("label"),
            round2(F.col("value")).alias("raw"),
            round2(F.col("normalized")).alias("normalized"),
            F.col("method"),
            round2(F.col("weight")).alias("weight"),
            round2(F.col("contribution")).alias("contribution"),
            text.alias("reason"),
        ).alias("entry"),
    )
    per_entity = rows.groupBy("id").agg(
        F.array_sort(F.collect_list(entry)).alias("entries"),  # one element per signal
        F.max("low_confidence").alias("low_confidence"),
    )
    final = round2(F.aggregate("entries", F.lit(0.0), lambda acc, e: acc + e["exact"]))
    return per_entity.select(
        "id",
        final.alias("popularity_score"),
        "low_confidence",
        F.struct(
            F.lit(1).alias("version"),
            as_of.alias("computed_at"),
            final.alias("final_score"),
            F.col("low_confidence"),
            F.transform("entries", lambda e: e["entry"]).alias("signals"),
            notes.alias("notes"),
        ).alias("score_breakdown"),
    )


def reason_text(special: dict[str, Column] | None = None) -> Column:
    """Why a signal scored: its rank where percentiles apply, otherwise its size."""
    plain = F.concat(F.col("label"), F.lit(" "), thousands(F.col("value")))
    if special is not None:
        out = plain
        for key, text in special.items():
            out = F.when(F.col("key") == key, text).otherwise(out)
        return out
    top = F.greatest(F.lit(1), round0(100 - F.col("normalized")))
    ranked = F.concat(
        F.col("label"), F.lit(" 상위 "), top.cast("string"), F.lit("% ("), thousands(F.col("value")), F.lit(")")
    )
    return F.when(F.col("method") == "percentile", ranked).otherwise(plain)


_NO_NOTES = "array<struct<key:string,note:string>>"


def artist_signals(artists: DataFrame, engagement: DataFrame) -> DataFrame:
    return artists.select("id", "followers_count", "upcoming_event_count").join(
        engagement.withColumnRenamed("artist_id", "id"), "id", "left"
    )


def artist_popularity(artists: DataFrame, engagement: DataFrame, as_of: str) -> DataFrame:
    return score_entities(
        artist_signals(artists, engagement), V.ARTIST_SIGNALS, None, F.array().cast(_NO_NOTES), at(as_of)
    )


def lineup_influence(event_artists: DataFrame, artist_scores: DataFrame) -> DataFrame:
    """0.7 mean + 0.3 best artist score per event, summed in cents so that row order cannot matter."""
    scores = artist_scores.select(F.col("id").alias("artist_id"), cents(F.col("popularity_score")).alias("score"))
    return (
        event_artists.select("event_id", "artist_id")
        .join(scores, "artist_id", "left")
        .groupBy("event_id")
        .agg(
            F.sum(F.coalesce("score", F.lit(0))).alias("total"),
            F.max(F.coalesce("score", F.lit(0))).alias("best"),
            F.count("*").alias("lineup_size"),
        )
        .select(
            F.col("event_id").alias("id"),
            "lineup_size",
            round2(
                0.7 * (F.col("total") / F.col("lineup_size") / 100) + 0.3 * (F.col("best") / 100)
            ).alias("artist_influence"),
        )
    )


def event_signals(
    events: DataFrame, event_artists: DataFrame, artist_scores: DataFrame, engagement: DataFrame, as_of: str
) -> DataFrame:
    counts = engagement.withColumnRenamed("event_id", "id")
    base = (
        events.select("id", "status", "start_date", "has_timetable")
        .join(lineup_influence(event_artists, artist_scores), "id", "left")
        .join(counts, "id", "left")
    )
    interested, booked = F.coalesce("interested_count", F.lit(0)), F.coalesce("booking_count", F.lit(0))
    reviews = F.coalesce("review_count", F.lit(0))
    acts = F.coalesce("artist_count", "lineup_size", F.lit(0))
    return base.select(
        "id",
        F.coalesce("artist_influence", F.lit(0.0)).alias("artist_influence"),
        (interested + 2 * booked + reviews).alias("ticket_demand"),
        (acts + F.when(F.col("has_timetable"), 3).otherwise(0)).alias("event_scale"),
        (interested + reviews).alias("community_attention"),
        freshness_score(F.col("status"), F.col("start_date"), at(as_of)).alias("freshness"),
    )


def event_popularity(
    events: DataFrame, event_artists: DataFrame, artist_scores: DataFrame, engagement: DataFrame, as_of: str
) -> DataFrame:
    fresh = F.concat(
        F.col("label"), F.lit(" "), round0(F.col("normalized")).cast("string"), F.lit("/100")
    )
    notes = F.array(F.struct(F.lit("event_scale").alias("key"), F.lit(V.NO_CAPACITY_NOTE).alias("note")))
    return score_entities(
        event_signals(events, event_artists, artist_scores, engagement, as_of),
        V.EVENT_SIGNALS,
        {"freshness": fresh},
        notes,
        at(as_of),
    )


def snapshot_rows(artist_scores: DataFrame, event_scores: DataFrame, captured_at: Column) -> DataFrame:
    """One row per scored entity: its score and the raw signals behind it."""
    def rows(scores: DataFrame, kind: str) -> DataFrame:
        signals = F.map_from_entries(
            F.transform("score_breakdown.signals", lambda s: F.struct(s["key"], s["raw"]))
        )
        return scores.filter(F.col("popularity_score").isNotNull()).select(
            F.lit(kind).alias("entity_type"),
            F.col("id").cast("string").alias("entity_id"),
            signals.alias("signals"),
            "popularity_score",
            captured_at.alias("captured_at"),
        )

    return rows(artist_scores, "artist").unionByName(rows(event_scores, "event"))


def trending(snapshots: DataFrame, as_of: str) -> DataFrame:
    """Mean score of the last week against the last month (which includes that week), in percent."""
    now = at(as_of)
    score = cents(F.coalesce("popularity_score", F.lit(0.0)))
    current = moment("captured_at") >= days_before(now, V.TREND_CURRENT_DAYS)
    windowed = snapshots.filter(moment("captured_at") >= days_before(now, V.TREND_BASELINE_DAYS))
    sums = windowed.groupBy("entity_type", "entity_id").agg(
        F.count("*").alias("n_baseline"),
        F.sum(score).alias("baseline"),
        F.count(F.when(current, 1)).alias("n_current"),
        F.coalesce(F.sum(F.when(current, score)), F.lit(0)).alias("current"),
    )
    mean_now = F.coalesce(F.try_divide(F.col("current"), F.col("n_current")), F.lit(0.0))
    mean_all = F.col("baseline") / F.col("n_baseline")
    cold = F.col("n_baseline") < V.TREND_MIN_SNAPSHOTS
    ratio = round2(F.try_divide(mean_now, mean_all) * 100)
    return sums.select(
        "entity_type",
        "entity_id",
        F.when(cold | (mean_all <= 0), F.lit(0.0)).otherwise(ratio).alias("trending_score"),
        cold.alias("cold_start"),
    )


def apply_scores(base: DataFrame, patch: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Partial update: a value in the patch replaces the stored one, null keeps it."""
    renamed = patch.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = base.join(renamed, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(f"_new_{c}"), F.col(c)))
    return out.drop(*[f"_new_{c}" for c in columns])
