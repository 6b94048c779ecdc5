"""Finding, fixing and removing bad values."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import links as L
from ..functions import text as T
from ..functions.dates import at, days_before, moment
from ..functions.validate import is_garbage, is_pure_url
from .cluster import batches_of
from .listing import admitted
from .lookups import is_non_concert, with_verdicts

Rule = tuple[str, Column, str]  # field, test, issue

CLASSIFY_BATCH = 25


def _rules(kind: str) -> list[Rule]:
    """Every issue of a table; the order within a field matters to the fixer."""
    if kind == "venue":
        name, address = F.col("name"), F.col("address")
        return [
            ("name", name.rlike(V.PRICE), "venue_name_price"),
            ("name", name.rlike(V.TICKET_GRADE), "venue_name_ticket_grade"),
            ("name", name.rlike(V.DATE), "venue_name_date"),
            ("address", address.rlike(V.PRICE), "venue_address_price"),
            ("address", (F.length(address) > 2) & ~address.rlike(V.ADDRESS_WORDS) & address.rlike(V.VENUE_LIKE),
             "venue_address_looks_like_name"),
            ("address", (address != "") & (T.strip(address) == T.strip(name)), "venue_address_same_as_name"),
        ]
    if kind == "artist":
        return [
            ("name", F.col("name").rlike(V.URL), "artist_name_url"),
            ("occupation", F.col("occupation").rlike(V.ADDRESS_WORDS), "artist_occupation_address"),
            ("label", F.col("label").rlike(V.PRICE), "artist_label_price"),
            ("country", F.length("country") > 30, "artist_country_too_long"),
            ("birth_place", F.col("birth_place").rlike(V.PRICE), "artist_birthplace_price"),
        ]
    title = F.col("title")
    return [
        ("title", F.length(T.strip(title)) <= 2, "event_title_too_short"),
        ("title", title.rlike(V.URL), "event_title_url"),
        ("venue_id,artist_id", F.col("venue_id").isNull() & F.col("artist_id").isNull(), "event_no_venue_artist"),
        ("start_date", F.col("start_date").isNull(), "event_no_start_date"),
    ]


def _issues(rows: DataFrame, kind: str, rules: list[tuple[str, Column, str, str]], value: dict[str, Column]) -> DataFrame:
    """One row per broken rule: (entity_type, entity_id, field, issue, method, old_value)."""
    def entry(field: str, test: Column, issue: str, method: str, place: int) -> Column:
        old = value.get(field, F.col(field).cast("string") if "," not in field else F.lit(None).cast("string"))
        return F.when(test, F.struct(
            F.lit(place).alias("place"), F.lit(field).alias("field"), F.lit(issue).alias("issue"),
            F.lit(method).alias("method"), old.alias("old_value")))

    found = F.array_compact(F.array(*[entry(f, t, i, m, n) for n, (f, t, i, m) in enumerate(rules)]))
    return rows.select(F.col("id").cast("string").alias("entity_id"), F.explode(found).alias("x")).select(
        F.lit(kind).alias("entity_type"), "entity_id", "x.*"
    )


def scan(rows: DataFrame, kind: str) -> DataFrame:
    """Every issue of a table, for the report."""
    value = {"venue_id,artist_id": F.col("title"), "start_date": F.col("title")} if kind == "event" else {}
    rules = [(f, t, i, "report") for f, t, i in _rules(kind)]
    return _issues(rows, kind, rules, value).drop("place", "method")


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("entity_type", "issue").agg(F.count("*").alias("n"))


def without_known(extra: DataFrame, known: DataFrame) -> DataFrame:
    """Issues from another checker that the rules have not already reported for that field."""
    return extra.join(known.select("entity_id", "field"), ["entity_id", "field"], "left_anti")


def fix_rules(kind: str) -> list[tuple[str, Column, str, str]]:
    if kind == "venue":
        name, address = F.col("name"), F.col("address")
        dirty = name.rlike(V.PRICE) | name.rlike(V.TICKET_GRADE) | name.rlike(V.DATE)
        return [
            ("name", dirty, "venue_name_contaminated", "null_field"),
            ("address", address.rlike(V.PRICE), "venue_address_price", "null_field"),
            ("address", address.rlike(V.URL), "venue_address_url", "null_field"),
            ("address", (F.length(address) > 2) & ~address.rlike(V.ADDRESS_WORDS) & address.rlike(V.VENUE_LIKE),
             "venue_address_looks_like_name", "null_field"),
            ("address", (address != "") & (T.strip(address) == T.strip(name)), "venue_address_same_as_name", "null_field"),
        ]
    if kind == "artist":
        return [(f, t, i, "queued_ai" if f == "name" else "null_field") for f, t, i in _rules("artist")]
    title = F.col("title")
    cleaned = T.display_title("title") != title
    (_, short, short_issue), (_, url, url_issue), (pair, orphan, orphan_issue), (start, undated, undated_issue) = _rules("event")
    return [
        ("title", short, short_issue, "queued_ai"),
        ("title", url & ~short, url_issue, "queued_ai"),
        ("title", cleaned, "event_title_announcement_suffix", "title_cleaned"),
        (pair, orphan, orphan_issue, "flagged"),
        (start, undated, undated_issue, "flagged"),
    ]


def auto_fix(
    rows: DataFrame, kind: str, queue: DataFrame, since: Column | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, log, new tasks): the first issue per field is acted on.

    Bad fields are cleared, titles cut, names queued for review unless a task is already open.
    """
    scope = rows if since is None else rows.filter(moment("created_at") >= since)
    found = _issues(scope, kind, fix_rules(kind), {"venue_id,artist_id": F.col("title")} if kind == "event" else {})
    first = found.groupBy("entity_type", "entity_id", "field").agg(
        F.min(F.struct("place", "issue", "method", "old_value")).alias("r")
    ).select("entity_type", "entity_id", "field", "r.issue", "r.method", "r.old_value")
    tasks = first.filter(F.col("method") == "queued_ai").withColumn("task_type", F.lit("clean_data"))
    open_queue = queue.select(F.col("entity_id").cast("string"), "task_type", "status")
    tasks = admitted(tasks, open_queue, ["entity_id", "task_type"])
    log = first.filter(F.col("method") != "queued_ai").unionByName(tasks.drop("task_type"))
    todo = first.filter(F.col("method").isin("null_field", "title_cleaned")).groupBy(F.col("entity_id").alias("_id")).agg(
        F.collect_set("field").alias("_fields")  # at most one entry per field
    )
    state = rows.join(todo, rows["id"].cast("string") == F.col("_id"), "left")
    none = F.array().cast("array<string>")
    for field in {f for f, _, _, m in fix_rules(kind) if m in ("null_field", "title_cleaned")}:
        hit = F.array_contains(F.coalesce("_fields", none), field)
        new = T.display_title("title") if field == "title" else F.lit(None)
        state = state.withColumn(field, F.when(hit, new).otherwise(F.col(field)))
    return state.select(*rows.columns), log, tasks


def removal_candidates(rows: DataFrame, kind: str, as_of: str) -> DataFrame:
    """(entity_type, entity_id, label, verdict): delete by rule, or uncertain and for review."""
    if kind == "venue":
        rule, issue = is_garbage("name"), "venue_name_pure_garbage"
        doubt = F.col("name").rlike(V.PRICE) | F.col("name").rlike(V.TICKET_GRADE) | F.col("name").rlike(V.DATE)
        label = F.col("name")
    elif kind == "artist":
        rule, issue = is_pure_url("name"), "artist_name_pure_url"
        doubt, label = F.lit(False), F.col("name")
    else:
        orphan = F.col("venue_id").isNull() & F.col("artist_id").isNull()
        short = F.length(T.strip("title")) <= 2
        rule, issue = short & orphan, "event_orphan_stub"
        old = moment("created_at") < days_before(at(as_of), 7)
        doubt, label = (orphan & old) | short | F.col("title").rlike(V.URL), F.col("title")
    rule, doubt = F.coalesce(rule, F.lit(False)), F.coalesce(doubt, F.lit(False))
    return rows.filter(rule | doubt).select(
        F.lit(kind).alias("entity_type"), F.col("id").cast("string").alias("entity_id"), label.alias("label"),
        F.when(rule, F.lit(issue)).otherwise(F.lit("uncertain")).alias("verdict"),
    )


def auto_delete(rows: DataFrame, kind: str, as_of: str, reviewed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, log): rule hits go, uncertain ones only when a review (entity_id, delete) says so."""
    found = removal_candidates(rows, kind, as_of)
    log = found.filter(F.col("verdict") != "uncertain")
    if reviewed is not None:
        agreed = reviewed.filter("delete").select(F.col("entity_id").cast("string"))
        doubtful = found.filter(F.col("verdict") == "uncertain").join(agreed, "entity_id", "left_semi")
        log = log.unionByName(doubtful.withColumn("verdict", F.lit(f"reviewed_{kind}_garbage")).select(*found.columns))
    gone = log.select(F.col("entity_id").cast(rows.schema["id"].dataType).alias("id"))
    return rows.join(gone, "id", "left_anti"), log


# --- keep or drop ------------------------------------------------------------------------
Classifier = Callable[[list[str]], list[str]]


def keyword_verdicts(titles: DataFrame) -> DataFrame:
    """The offline classifier: keyword rules decide every title."""
    none = F.lit(None).cast("date")
    return titles.withColumn("verdict", F.when(is_non_concert(F.col("title"), none, none), "drop").otherwise("keep"))


def classify(titles: DataFrame, classifier: Classifier) -> DataFrame:
    """Ask a classifier in batches of 25; a failing batch is unknown, not kept."""
    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches_of(CLASSIFY_BATCH)(frames):
            try:
                verdicts = classifier(list(batch["title"]))
            except Exception:  # any failure of an outside service means the same: no verdict
                verdicts = ["unknown"] * len(batch)
            yield batch.assign(verdict=verdicts)

    return titles.select("title_key", "title").mapInPandas(ask, "title_key string, title string, verdict string")


def verdicts(titles: DataFrame, cache: DataFrame, classifier: Classifier | None = None) -> tuple[DataFrame, DataFrame]:
    """(titles with verdicts, cache): one question per new title key; unknown is never cached."""
    asked = with_verdicts(titles.select("title").distinct(), cache)
    new = asked.filter(F.col("verdict").isNull()).groupBy("title_key").agg(F.min("title").alias("title"))
    answered = keyword_verdicts(new) if classifier is None else classify(new, classifier)
    fresh = answered.filter(F.col("verdict") != "unknown").select(
        "title_key", "verdict", F.substring("title", 1, 300).alias("sample_title")
    )
    by_key = answered.select("title_key", F.col("verdict").alias("_v"))
    out = asked.join(by_key, "title_key", "left").select("title", F.coalesce("verdict", "_v").alias("verdict"))
    return titles.join(out, "title"), cache.select("title_key", "verdict", "sample_title").unionByName(fresh)


def reclassify_held(events: DataFrame, cache: DataFrame, classifier: Classifier | None = None) -> tuple[DataFrame, DataFrame]:
    """Held events: keep shows them, drop marks them as no concert, unknown waits."""
    held = events.filter(F.col("hidden_reason") == "pending_classification").select("id", "title")
    judged, cache = verdicts(held, cache, classifier)
    state = events.join(judged.select("id", F.col("verdict").alias("_v")), "id", "left")
    keep, drop = F.coalesce(F.col("_v") == "keep", F.lit(False)), F.coalesce(F.col("_v") == "drop", F.lit(False))
    return state.withColumns({
        "is_hidden": F.when(keep, F.lit(False)).otherwise(F.col("is_hidden")),
        "hidden_at": F.when(~keep, F.col("hidden_at")),
        "hidden_reason": F.when(drop, F.lit("non_concert")).when(~keep, F.col("hidden_reason")),
    }).select(*events.columns), cache


def purge_candidates(events: DataFrame, as_of: str, recent_days: int = 30) -> DataFrame:
    """Recent live events without a genre, or with a guessed one that nobody has enriched yet."""
    recent = (F.col("status") != "ended") & (moment("created_at") >= days_before(at(as_of), recent_days))
    base = events.filter(recent).select("id", "title", "genre", "enrich_attempted_at")
    unset = base.filter(F.col("genre").isNull())
    guessed = base.filter((F.col("genre") == "콘서트") & F.col("enrich_attempted_at").isNull())
    return unset.unionByName(guessed).select("id", "title").dropDuplicates(["id"])


def purge_non_concerts(
    events: DataFrame, cache: DataFrame, as_of: str, recent_days: int = 30, classifier: Classifier | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, log, cache): non-music genres go at once, doubtful titles after a verdict."""
    events, cache = reclassify_held(events, cache, classifier)
    by_genre = events.filter(F.col("genre").isin(V.NON_MUSIC_GENRES)).select(
        "id", "title", F.concat(F.lit("genre:"), "genre").alias("reason")
    )
    left = events.join(by_genre.select("id"), "id", "left_anti")
    judged, cache = verdicts(purge_candidates(left, as_of, recent_days), cache, classifier)
    dropped = judged.filter(F.col("verdict") == "drop").select("id", "title", F.lit("verdict:drop").alias("reason"))
    log = by_genre.unionByName(dropped)
    return events.join(log.select("id"), "id", "left_anti"), log, cache


def cleanup_reasons(events: DataFrame) -> DataFrame:
    """(id, title, reason) of events that are no concerts by title, emptiness or length."""
    low = F.lower(T.or_empty("title"))
    concert = low.rlike(T.any_word(V.CONCERT_WORDS))
    word = F.regexp_extract(low, "(" + T.any_word(V.CLEANUP_WORDS) + ")", 1)
    days = F.date_diff("end_date", "start_date")
    reason = (
        F.when(T.strip(T.or_empty("title")) == "", "no_title")
        .when(~concert & (word != ""), F.lit("keyword"))
        .when(~concert & (days > V.MAX_RUN_DAYS), F.lit("too_long"))
    )
    return events.select("id", "title", reason.alias("reason")).filter("reason IS NOT NULL")


# --- backfill ----------------------------------------------------------------------------
def backfill_fields(events: DataFrame) -> DataFrame:
    """Fill booking link, provider and end date from what is already known; never overwrite."""
    urls = L.url_texts(F.col("source_urls"))
    return events.withColumns({
        "booking_url": F.when(T.is_blank("booking_url"), L.seller_url(urls)).otherwise(F.col("booking_url")),
        "ticket_provider": F.when(T.is_blank("ticket_provider"), L.ticket_provider(urls)).otherwise(F.col("ticket_provider")),
        "end_date": F.coalesce("end_date", "start_date"),
    })


def missing_venue_links(events: DataFrame, event_venues: DataFrame) -> DataFrame:
    linked = event_venues.select("event_id").distinct()
    return events.filter(F.col("venue_id").isNotNull()).select(F.col("id").alias("event_id"), "venue_id").join(
        linked, "event_id", "left_anti"
    ).withColumn("display_order", F.lit(0))


def backfill_booking_links(events: DataFrame) -> DataFrame:
    return events.withColumn("booking_links", L.booking_links(F.col("source_urls"), F.col("booking_url")))


def backfill_posters(events: DataFrame) -> DataFrame:
    """Poster from the goods code in any known link; existing posters stay."""
    candidate = L.poster_from_goods(L.url_texts(F.col("source_urls"), F.col("booking_url")))
    return events.withColumn("poster_url", F.coalesce("poster_url", candidate))


def needs_enrichment(column: str, as_of: str, days: int = V.REENRICH_DAYS) -> Column:
    """Never tried, or tried too long ago."""
    return F.col(column).isNull() | (moment(column) < days_before(at(as_of), days))


def reset_dirty_profiles(artists: DataFrame) -> DataFrame:
    """Genres holding markup residue or job words are cleared and queued for another look."""
    residue, job = F.col("occupation").rlike(V.MARKUP_RESIDUE), F.col("occupation").rlike(V.JOB_WORDS)
    bad = F.coalesce(residue | job, F.lit(False))
    cleaned = artists.withColumn("_bad", bad).withColumn("occupation", F.when(~F.col("_bad"), F.col("occupation")))
    again = F.col("_bad") | F.col("country").isNull() | F.col("occupation").isNull()
    return cleaned.withColumn(
        "enrichment_status", F.when(again, F.lit("pending")).otherwise(F.col("enrichment_status"))
    ).drop("_bad")
