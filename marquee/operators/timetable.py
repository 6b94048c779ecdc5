"""Timetable text: parsing, importing, checking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import fixed_values as V
from ..functions import text as T
from ..session import many_tasks
from .lookups import match_artists


def _clock(line: Column, i: int) -> Column:
    return D.clock(F.regexp_extract(line, V.TIME_RANGE, i))


def _date_text(day: Column) -> Column:
    return F.date_format(day, "yyyy.MM.dd")


def parse_lines(texts: DataFrame, as_of: str) -> DataFrame:
    """Numbered, cleaned lines of (event_id, text, start_date, genre) with their reading context.

    Day, date and stage carry forward from the last line that set them. A line with a stage and a
    time waits for its act on the next line without a time. Windows run over one event's text.
    """
    lines = T.text_lines(F.translate("text", "|", " "))
    # texts are dealt by event, their lines stay where they are
    dealt = texts.select("event_id", "text", "start_date", "genre").repartition(many_tasks(texts.sparkSession), "event_id")
    rows = dealt.select("event_id", "start_date", "genre", F.posexplode(lines).alias("pos", "line"))
    line, start = F.col("line"), F.coalesce(F.col("start_date").cast("date"), D.at(as_of).cast("date"))
    # patterns first, each once; what follows is built on their columns
    rows = rows.withColumns({
        "timed": line.rlike(V.TIME_RANGE), "begins": _clock(line, 1), "ends": _clock(line, 2),
        "stage_rest": T.strip(T.drop_first(line, V.TIME_RANGE)), "_day_n": F.regexp_extract(line, V.DAY_MARKER, 1).try_cast("int"),
        "_year": F.regexp_extract(line, V.SINGLE_DATE, 1).try_cast("int"), "_month": F.regexp_extract(line, V.SINGLE_DATE, 2),
        "_dom": F.regexp_extract(line, V.SINGLE_DATE, 3), "_has_date": line.rlike(V.SINGLE_DATE),
        "stage_line": F.when(line.rlike(V.STAGE_LINE) & line.rlike(V.STAGE_WORD), T.strip(F.regexp_extract(line, V.STAGE_LINE, 1))),
        "_start": start,
    })
    start, day_n = F.col("_start"), F.col("_day_n")
    rows = rows.withColumns({
        "valid": D.is_clock(F.col("begins")) & D.is_clock(F.col("ends")) & (D.clock_minutes(F.col("begins")) < D.clock_minutes(F.col("ends"))),
        "_written": F.concat_ws(".", F.coalesce("_year", F.year(start)).cast("string"), F.lpad("_month", 2, "0"), F.lpad("_dom", 2, "0")),
    })
    written = F.col("_written")
    real = F.replace(written, F.lit("."), F.lit("-")).try_cast("date")
    rows = rows.withColumns({
        "slot": F.col("timed") & F.col("valid") & (F.col("stage_rest") != "") & ~F.col("stage_rest").rlike(r"\d{1,2}[:.]\d{2}"),
        "marked": F.when(
            F.col("_has_date"), F.struct(F.coalesce(D.day_number(F.col("start_date"), real), F.lit(1)).alias("day"), written.alias("date"))
        ).when(day_n.isNotNull(), F.struct(day_n.alias("day"), _date_text(D.date_for_day(start, day_n)).alias("date"))),
        "stage_line": F.when(~F.col("_has_date"), F.col("stage_line")),
        "first_day": _date_text(start),
    })
    w = Window.partitionBy("event_id").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last_slot = F.max(F.when(F.col("slot"), F.col("pos"))).over(before)
    last_plain = F.max(F.when(~F.col("timed"), F.col("pos"))).over(before)
    waiting = ~F.col("timed") & last_slot.isNotNull() & (last_slot > F.coalesce(last_plain, F.lit(-1)))
    rows = rows.withColumn("takes_slot", waiting)
    context = ~F.col("timed") & ~F.col("takes_slot")
    rows = rows.withColumns({
        "day_set": F.when(context, F.col("marked")),
        "stage_set": F.when(F.col("slot"), F.col("stage_rest")).when(context, F.col("stage_line")),
    })
    carried = lambda c: F.last(c, ignorenulls=True).over(before)
    first = F.struct(F.lit(1).alias("day"), F.col("first_day").alias("date"))
    rows = rows.withColumns({
        "at_day": F.coalesce(carried("day_set"), first),
        "at_stage": F.coalesce(carried("stage_set"), F.lit(V.DEFAULT_STAGE)),
    })
    slot_now = F.when(F.col("slot"), F.struct("at_day", "begins", "ends", F.col("stage_rest").alias("stage")))
    return rows.withColumn("slot_now", slot_now).withColumn("waiting_slot", carried("slot_now"))


def parse_timetable(texts: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(rows, issues) of timetable texts."""
    rows = parse_lines(texts, as_of)
    alone = F.col("timed") & ~F.col("slot")
    told = rows.filter(F.col("takes_slot") | alone)  # read once for both kinds of line
    line = T.drop_first(F.col("line"), V.DAY_MARKER)
    own = F.coalesce("marked", "at_day")
    line = T.drop_first(line, V.SINGLE_DATE)
    stage = T.strip(F.regexp_extract(line, V.STAGE_MARKER, 1))
    act = F.regexp_replace(T.drop_first(F.regexp_replace(line, V.STAGE_MARKER, " "), V.TIME_RANGE), V.LINEUP_LABEL, " ")
    told = told.withColumns({
        "own": own, "act": T.squeeze(act), "stage": F.when(stage != "", stage).otherwise(F.col("at_stage")),
    })
    good = F.col("valid") & (F.col("act") != "") & (F.col("stage") != "")
    paired = F.struct(
        F.col("waiting_slot.at_day.day").alias("day_number"), F.col("waiting_slot.at_day.date").alias("date_string"),
        F.col("waiting_slot.begins").alias("start_time"), F.col("waiting_slot.ends").alias("end_time"), F.col("line").alias("artist_name"),
        F.col("waiting_slot.stage").alias("stage_name"),
    )
    whole = F.struct(
        F.col("own.day").alias("day_number"), F.col("own.date").alias("date_string"), F.col("begins").alias("start_time"),
        F.col("ends").alias("end_time"), F.col("act").alias("artist_name"), F.col("stage").alias("stage_name"),
    )
    kept = told.select("event_id", "pos", F.when(F.col("takes_slot"), paired).when(good, whole).alias("r"), T.or_empty("genre").alias("genre"))
    kept = kept.filter(F.col("r").isNotNull()).select("event_id", "pos", "r.*", "genre")
    unread = told.filter(alone & ~good).select("event_id", "line", F.lit("unreadable_line").alias("reason"))
    tail = rows.groupBy("event_id").agg(
        F.max(F.when(F.col("slot"), F.col("pos"))).alias("_slot"), F.max(F.when(~F.col("timed"), F.col("pos"))).alias("_plain"),
        F.max_by("line", F.when(F.col("slot"), F.col("pos"))).alias("line"),
    )
    open_slot = tail.filter(F.col("_slot") > F.coalesce("_plain", F.lit(-1))).select(
        "event_id", "line", F.lit("slot_without_artist").alias("reason")
    )
    return kept, unread.unionByName(open_slot)


def stage_overlaps(rows: DataFrame, stage: list[str], start: str, end: str, order: str) -> DataFrame:
    """Slots that begin before an earlier slot of their stage has ended, and when that one ends.

    start and end are minutes of the day, slots count in the order of start, then ``order``. For
    earlier minutes a stage keeps one row per minute, whatever the number of slots, so the running
    maximum is over at most 1440 rows; only slots of one minute are put in order themselves.
    """
    minutes = rows.groupBy(*stage, start).agg(F.max(end).alias("_latest"))
    earlier = Window.partitionBy(*stage).orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    minutes = minutes.select(*stage, start, F.max("_latest").over(earlier).alias("_earlier"))
    same = Window.partitionBy(*stage, start).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_same", F.max(end).over(same)).join(minutes, [*stage, start])
    busy_until = F.greatest("_earlier", "_same")
    return placed.withColumn("busy_until", busy_until).filter(F.col(start) < F.col("busy_until")).drop("_earlier", "_same")


def import_timetable(
    texts: DataFrame, artists: DataFrame, aliases: DataFrame, as_of: str
) -> dict[str, DataFrame]:
    """Parsed performances linked to known artists only; unknown names are reported, not created."""
    rows, issues = parse_timetable(texts, as_of)
    names = rows.select(F.col("artist_name").alias("raw_name"))
    hits = match_artists(names, artists, aliases).select(F.col("raw_name").alias("artist_name"), "artist_id")
    linked = rows.join(hits, "artist_name", "left")
    titles = texts.select("event_id", F.col("title").alias("event_title")) if "title" in texts.columns else None
    unmatched = linked.filter(F.col("artist_id").isNull()).groupBy("event_id", T.strip("artist_name").alias("artist_name")).agg(
        F.max_by(F.struct("stage_name", "day_number"), "pos").alias("r")
    ).select("event_id", "artist_name", "r.*", F.lit("text").alias("source"), F.lit(False).alias("is_resolved"))
    if titles is not None:
        unmatched = unmatched.join(titles, "event_id", "left")
    timed = rows.withColumns({"_s": D.clock_minutes("start_time"), "_e": D.clock_minutes("end_time")})
    clashes = stage_overlaps(timed, ["event_id", "day_number", "stage_name"], "_s", "_e", "pos")
    return {
        "performances": linked.drop("pos"),
        "unmatched": unmatched,
        "issues": issues,
        "overlaps": clashes.drop("_s", "_e", "pos"),
        "events_with_timetable": linked.select("event_id").distinct(),
    }


def log_unmatched(log: DataFrame, fresh: DataFrame) -> DataFrame:
    """Upsert by event and name: a name that shows up again is open again."""
    keys = ["event_id", "artist_name"]
    return log.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def resolve_unmatched(
    log: DataFrame, performances: DataFrame, decisions: DataFrame, artists: DataFrame, aliases: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(log, performances, artists) after decisions (event_id, artist_name, action, artist_id, new_name).

    link uses the given artist; create matches or makes one; rename matches the new name or only
    renames; delete drops the slots and the entry. Only slots without an artist are touched.
    """
    names = decisions.filter(F.col("action").isin("create", "rename")).select(T.strip("new_name").alias("raw_name"))
    hits = match_artists(names, artists, aliases).select(F.col("raw_name").alias("_n"), F.col("artist_id").alias("_hit"))
    todo = decisions.withColumn("_n", T.strip("new_name")).join(hits, "_n", "left")
    made = todo.filter((F.col("action") == "create") & F.col("_hit").isNull() & (F.col("_n") != ""))
    made = made.select("_n").distinct().withColumn("_made", F.concat(F.lit("artist-"), F.substring(F.sha2(F.lower("_n"), 256), 1, 16)))
    values = {"id": F.col("_made"), "name": F.col("_n"), "normalized_name": T.name_key("_n")}
    fresh = made.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in artists.schema.fields])
    everyone = artists.unionByName(fresh)
    todo = todo.join(made, "_n", "left").withColumn("_id", F.coalesce(
        F.when(F.col("action") == "link", F.col("artist_id").cast("string")), F.col("_hit").cast("string"),
        F.when(F.col("action") == "create", F.col("_made"))))
    official = everyone.select(F.col("id").cast("string").alias("_id"), F.col("name").alias("_official"))
    todo = todo.join(official, "_id", "left")
    todo = todo.filter((F.col("action") != "link") | F.col("_official").isNotNull())
    todo = todo.select("event_id", "artist_name", "action", "_id", F.coalesce("_official", "_n").alias("_name"))
    keys = ["event_id", "artist_name"]
    slots = performances.join(todo, keys, "left")
    free = F.col("artist_id").isNull() & F.col("action").isNotNull()
    slots = slots.filter(~F.coalesce(free & (F.col("action") == "delete"), F.lit(False)))
    slots = slots.withColumns({
        "artist_name": F.when(free, F.coalesce("_name", "artist_name")).otherwise(F.col("artist_name")),
        "artist_id": F.when(free, F.col("_id")).otherwise(F.col("artist_id").cast("string")),
    }).select(*performances.columns)
    entries = log.join(todo, keys, "left").filter(F.coalesce(F.col("action") != "delete", F.lit(True)))
    renamed = F.col("action") == "rename"
    entries = entries.withColumns({
        "artist_name": F.when(renamed, F.coalesce("_name", "artist_name")).otherwise(F.col("artist_name")),
        "is_resolved": F.when(F.col("_id").isNotNull(), F.lit(True)).when(renamed, F.lit(False)).otherwise(F.col("is_resolved")),
    }).select(*log.columns)
    return entries, slots, everyone
