"""Dates, times and lifecycle classes. Every clock is an explicit as_of argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import col_of, strip

_DAY_MICROS = 86_400_000_000

# Accepted shapes of a date, in the order they are tried.
DATE_SHAPES = [
    (r"(\d{4})\.(\d{1,2})\.(\d{1,2})\s*[~–-]\s*\d{1,2}\.(\d{1,2})", ""),
    (r"(\d{4})년\s*(\d{1,2})월\s*(\d{1,2})일", ""),
    (r"(\d{4})\.(\d{1,2})\.(\d{1,2})", ""),
    (r"(\d{2})\.(\d{1,2})\.(\d{1,2})", "20"),
    (r"(\d{4})-(\d{2})-(\d{2})", ""),
]
RANGE_TAIL = r"(\d{4})\.(\d{1,2})\.(\d{1,2})\s*[~–-]\s*(\d{1,2})\.(\d{1,2})"
DATE_AND_TIME = r"(\d{4})[.\-/](\d{1,2})[.\-/](\d{1,2})\D+(\d{1,2}):(\d{2})"
LEGACY_SHAPES = {
    "two_dates": r"(\d{4})[.\-](\d{1,2})[.\-](\d{1,2})\s*[~～\-]\s*(\d{4})[.\-](\d{1,2})[.\-](\d{1,2})",
    "one_date": r"(\d{4})[.\-](\d{1,2})[.\-](\d{1,2})",
    "korean_range": r"(\d{4})년\s*(\d{1,2})월\s*(\d{1,2})[~～](\d{1,2})일",
    "korean_date": r"(\d{4})년\s*(\d{1,2})월\s*(\d{1,2})일",
    "no_year": r"(\d{1,2})[.\-](\d{1,2})\s*[~～]\s*(\d{1,2})[.\-](\d{1,2})",
}
# Per site: full range (optional second year), single date, range without a year.
PERIOD_STYLES = {
    "yes24": (
        r"(\d{4})[.\-](\d{1,2})[.\-](\d{1,2})\s*[~–]\s*(?:(\d{4})[.\-])?(\d{1,2})[.\-](\d{1,2})",
        r"(\d{4})[.\-](\d{1,2})[.\-](\d{1,2})",
        r"(\d{1,2})[.\-](\d{1,2})\s*[~–]\s*(\d{1,2})[.\-](\d{1,2})",
    ),
    "festivallife": (
        r"(\d{4})[.\-년\s]+\s*(\d{1,2})[.\-월\s]+\s*(\d{1,2})[일\s]*\s*[~–]\s*(?:(\d{4})[.\-년\s]+\s*)?(\d{1,2})[.\-월\s]+\s*(\d{1,2})",
        r"(\d{4})[.\-년\s]+\s*(\d{1,2})[.\-월\s]+\s*(\d{1,2})",
        r"(\d{1,2})[월.\-]?\s*(\d{1,2})\s*[~–]\s*(\d{1,2})[월.\-]?\s*(\d{1,2})",
    ),
    "melon": (
        r"(\d{4})[.\-](\d{1,2})[.\-](\d{1,2})\s+[-~–]\s+(?:(\d{4})[.\-])?(\d{1,2})[.\-](\d{1,2})",
        r"(\d{4})[.\-](\d{1,2})[.\-](\d{1,2})",
        r"(\d{1,2})[.\-](\d{1,2})\s+[-~–]\s+(\d{1,2})[.\-](\d{1,2})",
    ),
}


def moment(c: Column | str) -> Column:
    return col_of(c).cast("timestamp")


def at(as_of: str) -> Column:
    """An explicit clock reading, as UTC; a bare date is its midnight."""
    text = as_of + "T00:00:00" if len(as_of) == 10 else as_of
    return F.lit(text if text.endswith("Z") or "+" in text else text + "Z").cast("timestamp")


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days from earlier to later."""
    return (F.unix_micros(moment(later)) - F.unix_micros(moment(earlier))) / _DAY_MICROS


def days_before(as_of: Column, days: int) -> Column:
    return as_of - F.make_dt_interval(F.lit(days))


def _ymd(y: Column, m: Column, d: Column) -> Column:
    return F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")).try_cast("date")


def _part(c: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(c, pattern, i)


def parse_date(c: Column | str) -> Column:
    c = col_of(c)
    # one look per shape: the match is rewritten as y-m-d, and anything else is no date
    tries = [
        F.regexp_replace(F.regexp_extract(c, pattern, 0), f"(?s)^{pattern}.*", f"{century}$1-$2-$3").try_cast("date")
        for pattern, century in DATE_SHAPES
    ]
    return F.coalesce(*tries)


def parse_end_date(c: Column | str) -> Column:
    c = col_of(c)
    tail = _ymd(_part(c, RANGE_TAIL, 1), _part(c, RANGE_TAIL, 4), _part(c, RANGE_TAIL, 5))
    return F.coalesce(F.when(c.rlike(RANGE_TAIL), tail), parse_date(c))


def parse_ticket_opening(c: Column | str) -> Column:
    """Opening instant; a written time is kept, a bare date means midnight in Korea."""
    text = strip(c)
    iso = F.when(
        text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}"),
        F.when(text.rlike(r"(?:Z|[+-]\d{2}:?\d{2})\z"), text).otherwise(F.concat(text, F.lit("Z"))),
    ).try_cast("timestamp")
    written = F.when(
        text.rlike(DATE_AND_TIME),
        F.concat(
            _ymd(*(_part(text, DATE_AND_TIME, i) for i in (1, 2, 3))).cast("string"),
            F.lit("T"),
            F.lpad(_part(text, DATE_AND_TIME, 4), 2, "0"),
            F.lit(":"),
            _part(text, DATE_AND_TIME, 5),
            F.lit(":00+09:00"),
        ),
    ).try_cast("timestamp")
    midnight = F.concat(parse_date(text).cast("string"), F.lit("T00:00:00+09:00")).try_cast("timestamp")
    return F.coalesce(iso, written, midnight)


def parse_date_range(c: Column | str, as_of: Column) -> Column:
    """struct(start_date, end_date) of a printed period; the first shape that fits decides."""
    text = F.regexp_replace(strip(c), r"(\d)\s*\.\s*(\d)", "$1.$2")
    shape = LEGACY_SHAPES
    none = F.lit(None).cast("date")

    def g(name: str, i: int) -> Column:
        return _part(text, shape[name], i)

    def pair(start: Column, end: Column) -> Column:
        return F.struct(start.alias("start_date"), end.alias("end_date"))

    month = g("no_year", 1).try_cast("int")
    year = (F.year(as_of) + F.when(month >= F.month(as_of), 0).otherwise(1)).cast("string")
    return (
        F.when(
            text.rlike(shape["two_dates"]),
            pair(_ymd(*(g("two_dates", i) for i in (1, 2, 3))), _ymd(*(g("two_dates", i) for i in (4, 5, 6)))),
        )
        .when(text.rlike(shape["one_date"]), pair(_ymd(*(g("one_date", i) for i in (1, 2, 3))), none))
        .when(
            text.rlike(shape["korean_range"]),
            pair(
                _ymd(*(g("korean_range", i) for i in (1, 2, 3))),
                _ymd(*(g("korean_range", i) for i in (1, 2, 4))),
            ),
        )
        .when(text.rlike(shape["korean_date"]), pair(_ymd(*(g("korean_date", i) for i in (1, 2, 3))), none))
        .when(
            text.rlike(shape["no_year"]),
            pair(_ymd(year, g("no_year", 1), g("no_year", 2)), _ymd(year, g("no_year", 3), g("no_year", 4))),
        )
        .otherwise(pair(none, none))
    )


def parse_period(c: Column | str, style: str, as_of: Column) -> Column:
    """struct(start_date, end_date) of a site's period text; a single date starts and ends it."""
    text = col_of(c)
    full, single, short = PERIOD_STYLES[style]
    start = _ymd(*(_part(text, full, i) for i in (1, 2, 3)))
    end_year = F.when(_part(text, full, 4) != "", _part(text, full, 4)).otherwise(_part(text, full, 1))
    end = _ymd(end_year, _part(text, full, 5), _part(text, full, 6))
    one = _ymd(*(_part(text, single, i) for i in (1, 2, 3)))
    this_year = F.year(as_of).cast("string")
    none = F.lit(None).cast("date")

    def pair(a: Column, b: Column) -> Column:
        return F.struct(a.alias("start_date"), b.alias("end_date"))

    return (
        F.when(text.rlike(full), pair(start, end))
        .when(text.rlike(single), pair(one, one))
        .when(
            text.rlike(short),
            pair(
                _ymd(this_year, _part(text, short, 1), _part(text, short, 2)),
                _ymd(this_year, _part(text, short, 3), _part(text, short, 4)),
            ),
        )
        .otherwise(pair(none, none))
    )


def parse_compact_date(c: Column | str) -> Column:
    pattern = r"^(\d{4})(\d{2})(\d{2})"
    return _ymd(*(_part(col_of(c), pattern, i) for i in (1, 2, 3)))


def parse_compact_kst(c: Column | str) -> Column:
    """A 14-digit Korean local time as an instant."""
    c = col_of(c)
    return F.when(
        c.rlike(r"^\d{14}\z"),
        F.regexp_replace(c, r"(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})", "$1-$2-$3T$4:$5:$6+09:00"),
    ).try_cast("timestamp")


def parse_label_opening(c: Column | str, start: Column, as_of: Column) -> Column:
    """``MM.DD(day) HH:MM`` on a list page; the year is that of the show, else the current one."""
    c = col_of(c)
    pattern = r"(\d{1,2})[.\-](\d{1,2})(?:\([^)]*\))?\s*(\d{1,2}:\d{2})?"
    year = F.coalesce(F.year(start), F.year(as_of)).cast("string")
    clock = F.when(_part(c, pattern, 3) != "", F.lpad(_part(c, pattern, 3), 5, "0")).otherwise(F.lit("00:00"))
    text = F.concat(
        year, F.lit("-"), F.lpad(_part(c, pattern, 1), 2, "0"), F.lit("-"),
        F.lpad(_part(c, pattern, 2), 2, "0"), F.lit("T"), clock, F.lit(":00+09:00"),
    )
    return F.when(c.rlike(pattern), text).try_cast("timestamp")


def parse_birth_date(c: Column | str) -> Column:
    c = col_of(c)
    pattern = r"(\d{4})[^0-9]*(\d{1,2})[^0-9]*(\d{1,2})"
    full = F.concat_ws(
        "-", _part(c, pattern, 1), F.lpad(_part(c, pattern, 2), 2, "0"), F.lpad(_part(c, pattern, 3), 2, "0")
    )
    return F.when(c.rlike(pattern), full).when(c.rlike(r"\d{4}"), _part(c, r"(\d{4})", 1))


def legacy_birth_date(c: Column | str) -> Column:
    """The date as written: Korean full date, Korean year, or an English month name date."""
    c = col_of(c)
    tries = [r"(\d{4}년\s*\d{1,2}월\s*\d{1,2}일)", r"(\d{4}년)", r"([\p{L}\p{N}_]+ \d{1,2},?\s*\d{4})"]
    return F.coalesce(*[F.when(c.rlike(p), _part(c, p, 1)) for p in tries])


# --- lifecycle ---------------------------------------------------------------------------
def infer_status(start: Column, end: Column, opening: Column, as_of: Column) -> Column:
    begins, now = moment(start), moment(as_of)
    ends = F.coalesce(moment(end), begins)
    return (
        F.when(begins.isNull(), F.lit("upcoming"))
        .when(ends < now, F.lit("ended"))
        .when((begins <= now) & (now <= ends), F.lit("ongoing"))
        .when(moment(opening) > now, F.lit("upcoming"))
        .otherwise(F.lit("on_sale"))
    )


def legacy_status(start: Column, end: Column, today: Column) -> Column:
    return (
        F.when(start.isNull(), F.lit("upcoming"))
        .when(today > end, F.lit("ended"))
        .when(today >= start, F.lit("on_sale"))
        .otherwise(F.lit("upcoming"))
    )


def freshness_score(status: Column, start: Column, as_of: Column) -> Column:
    """0-100: how near an event is."""
    days = days_between(start, as_of)
    return (
        F.when(status == "ended", 0).when(days < 0, 70).when(days <= 14, 100).when(days <= 30, 80)
        .when(days <= 60, 60).when(days <= 120, 40).otherwise(20).cast("double")
    )


def freshness_norm(start: Column, as_of: Column) -> Column:
    """0-1 variant used for recommendations; its steps differ from the popularity one."""
    days = days_between(start, as_of)
    return (
        F.when(days < 0, 0.7).when(days <= 14, 1.0).when(days <= 30, 0.8).when(days <= 60, 0.65)
        .when(days <= 90, 0.5).when(days <= 180, 0.35).otherwise(0.2).cast("double")
    )


def format_kst(ts: Column | str, with_time: bool = True) -> Column:
    """Korean wall-clock text of a UTC timestamp column; a dash when there is none."""
    local = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Seoul"), col_of(ts).cast("timestamp_ntz"))
    return F.coalesce(F.date_format(local, "yyyy.MM.dd HH:mm" if with_time else "yyyy.MM.dd"), F.lit("–"))


def kst_day(ts: Column | str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit("Asia/Seoul"), col_of(ts).cast("timestamp_ntz")).cast("date")


# --- festival days and slots -------------------------------------------------------------
def date_for_day(start: Column, day: Column) -> Column:
    return F.date_add(start.cast("date"), F.greatest(day - 1, F.lit(0)).cast("int"))


def day_options(start: Column, end: Column) -> Column:
    """array(struct(day, date)) from start to end, at least one day; empty without a start."""
    first = start.cast("date")
    last = F.greatest(first, F.coalesce(end.cast("date"), first))
    days = F.transform(
        F.sequence(first, last),
        lambda d, i: F.struct((i + 1).cast("int").alias("day"), d.alias("date")),
    )
    return F.when(first.isNotNull(), days).otherwise(F.array().cast("array<struct<day:int,date:date>>"))


def day_number(start: Column, day: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(1), F.date_diff(day.cast("date"), start.cast("date")) + 1), F.lit(1))


def next_free_day(max_day: Column, start: Column, end: Column) -> Column:
    n_days = F.greatest(F.lit(1), F.date_diff(end.cast("date"), start.cast("date")) + 1)
    return F.least(F.coalesce(max_day, F.lit(0)) + 1, F.coalesce(n_days, F.lit(1)))


def clock(c: Column | str) -> Column:
    """``9.30`` or ``9:30`` as ``09:30``."""
    text = F.replace(col_of(c), F.lit("."), F.lit(":"))
    return F.concat(
        F.lpad(F.split_part(text, F.lit(":"), F.lit(1)), 2, "0"), F.lit(":"), F.split_part(text, F.lit(":"), F.lit(2))
    )


def is_clock(c: Column | str) -> Column:
    return col_of(c).rlike(r"^(?:[01]\d|2[0-3]):[0-5]\d\z")


def clock_minutes(c: Column | str) -> Column:
    c = col_of(c)
    return F.split_part(c, F.lit(":"), F.lit(1)).try_cast("int") * 60 + F.split_part(
        c, F.lit(":"), F.lit(2)
    ).try_cast("int")


def is_stalled(status: Column, started: Column, as_of: Column) -> Column:
    limit = F.make_dt_interval(mins=F.lit(V.STALE_RUN_MINUTES))
    return F.coalesce((status == "running") & (moment(started) < as_of - limit), F.lit(False))
