"""Validation rules; each set returns the array of broken rules, empty when the row is fine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import col_of, drop_first, is_blank, or_empty, strip


def broken_rules(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in rules]))


def is_garbage(c: Column | str, every: bool = False) -> Column:
    """Nothing but prices, grades, dates and separators (first hit of each, or every hit)."""
    out = col_of(c)
    for pattern in (V.PRICE, V.TICKET_GRADE, V.DATE):
        out = F.regexp_replace(out, pattern, "") if every else drop_first(out, pattern)
    return F.length(strip(F.regexp_replace(out, r"[\s\-·_,]+", ""))) <= 1


def is_pure_url(c: Column | str) -> Column:
    """Any URL makes the name unusable: whatever else is in it counts as part of the link."""
    return col_of(c).rlike(V.URL)


def empty_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def event_errors(
    title: Column, start: Column, end: Column, status: Column, key: Column, source: Column
) -> Column:
    begins, ends = start.try_cast("timestamp"), end.try_cast("timestamp")
    return broken_rules(
        (F.length(or_empty(title)) < 2, "title: too short"),
        (F.length(title) > 300, "title: too long"),
        (title.rlike(V.URL), "title: has a URL"),
        (strip(or_empty(title)) == "", "title: blank"),
        (~is_blank(start) & begins.isNull(), "start_date: not a date"),
        (~is_blank(end) & ends.isNull(), "end_date: not a date"),
        (~status.isin(V.EVENT_STATUSES), "status: unknown"),
        (is_blank(key), "dedup_key: missing"),
        (is_blank(source), "source_name: missing"),
        (ends < begins, "end_date: before start_date"),
    )


def artist_errors(name: Column, avatar: Column) -> Column:
    return broken_rules(
        (F.length(or_empty(name)) < 1, "name: missing"),
        (F.length(name) > 100, "name: too long"),
        (name.rlike(V.URL), "name: has a URL"),
        (strip(or_empty(name)) == "", "name: blank"),
        (strip(name).rlike(r"^\d+\z"), "name: digits only"),
        (name.rlike(V.DATE), "name: has a date"),
        (F.contains(name, F.lit("/")), "name: has a slash"),
        (~is_blank(avatar) & F.try_parse_url(avatar, F.lit("PROTOCOL")).isNull(), "avatar_url: not a URL"),
    )


def venue_errors(name: Column, address: Column) -> Column:
    return broken_rules(
        (F.length(or_empty(name)) < 2, "name: too short"),
        (F.length(name) > 200, "name: too long"),
        (name.rlike(V.PRICE), "name: has a price"),
        (name.rlike(V.TICKET_GRADE), "name: has a ticket grade"),
        (name.rlike(V.DATE), "name: has a date"),
        (name.rlike(V.URL), "name: has a URL"),
        (is_garbage(or_empty(name)), "name: meaningless"),
        (address.rlike(V.PRICE), "address: has a price"),
        (address.rlike(V.URL), "address: has a URL"),
    )


def first_error(*rules: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for bad, name in reversed(rules):
        out = F.when(bad, F.lit(name)).otherwise(out)
    return out


def legacy_event_errors(title: Column, key: Column, start: Column, end: Column) -> Column:
    return F.array_compact(F.array(
        first_error(
            (F.length(strip(or_empty(title))) < 2, "title: too short"),
            (F.length(title) > 300, "title: too long"),
            (title.rlike(V.URL), "title: has a URL"),
        ),
        F.when(is_blank(key), F.lit("dedup_key: missing")),
        F.when(end < start, F.lit("end_date: before start_date")),
    ))


def legacy_artist_errors(name: Column, avatar: Column) -> Column:
    return F.array_compact(F.array(
        first_error(
            (strip(or_empty(name)) == "", "name: missing"),
            (F.length(name) > 100, "name: too long"),
            (name.rlike(V.URL), "name: has a URL"),
            (strip(name).rlike(r"^\p{Nd}+\z"), "name: digits only"),
        ),
        F.when(~is_blank(avatar) & ~avatar.rlike("^https?://"), F.lit("avatar_url: not a URL")),
    ))


def legacy_venue_errors(name: Column, address: Column) -> Column:
    return F.array_compact(F.array(
        first_error(
            (F.length(strip(or_empty(name))) < 2, "name: too short"),
            (F.length(name) > 200, "name: too long"),
            (name.rlike(V.PRICE), "name: has a price"),
            (name.rlike(V.TICKET_GRADE), "name: has a ticket grade"),
            (name.rlike(V.DATE), "name: has a date"),
            (name.rlike(V.URL), "name: has a URL"),
            (is_garbage(or_empty(name), every=True), "name: meaningless"),
        ),
        F.when(
            ~is_blank(address),
            first_error(
                (address.rlike(V.PRICE), "address: has a price"),
                (address.rlike(V.URL), "address: has a URL"),
                (strip(address) == strip(name), "address: same as name"),
            ),
        ),
    ))


def missing_fields(null_or_empty: list[str], null_or_spaces: list[str] = ()) -> Column:
    """Names of the columns without a value."""
    tests = [F.when(is_blank(n), F.lit(n)) for n in null_or_empty]
    tests += [F.when(strip(or_empty(n)) == "", F.lit(n)) for n in null_or_spaces]
    return F.array_compact(F.array(*tests))


# The fields whose absence the completeness views report.
ARTIST_FIELDS = ["avatar_url", "occupation", "label", "country", "birth_date", "birth_place", "related"]
VENUE_FIELDS = ["address", "phone_number"]
EVENT_FIELDS = [
    "poster_url", "end_date", "genre", "duration", "age_restriction", "ticket_open_date", "ticket_provider",
]
EVENT_TEXT_FIELDS = ["notice_text"]
EVENT_NULL_ONLY = ["artist_id", "venue_id", "end_date", "ticket_open_date"]
