"""Arrays, maps and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def distinct_sites(source_urls: Column) -> Column:
    sites = F.filter(F.transform(source_urls, lambda s: s["site"]), lambda x: x.isNotNull() & (x != ""))
    return F.array_sort(F.array_distinct(F.coalesce(sites, F.array().cast("array<string>"))))


def merge_maps(base: Column, winner: Column, map_type: str) -> Column:
    """Both maps together; where both have a key the second one decides."""
    empty = F.create_map().cast(map_type)
    base, winner = F.coalesce(base, empty), F.coalesce(winner, empty)
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(winner, k))
    return F.map_concat(kept, winner)


def stamp_sources(field_sources: Column, fields: Column, source: Column, at: Column) -> Column:
    """Record who filled the fields and when."""
    stamp = F.map_from_entries(
        F.transform(fields, lambda f: F.struct(f, F.struct(source.alias("source"), at.alias("at"))))
    )
    return merge_maps(field_sources, stamp, "map<string,struct<source:string,at:timestamp>>")


def candidate_names(parsed_json: Column) -> Column:
    """Distinct non-empty strings under ``artists``; anything else in that list is ignored."""
    raw = F.from_json(parsed_json, "artists array<variant>")["artists"]
    strings = F.transform(F.filter(raw, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.variant_get(v, "$", "string"))
    names = F.filter(F.transform(strings, strip), lambda n: n != "")
    return F.array_distinct(F.coalesce(names, F.array().cast("array<string>")))


def replaced_children(old: Column, new: Column) -> Column:
    """null keeps the list, an empty list clears it, anything else replaces it."""
    return F.when(new.isNull(), old).otherwise(new)


def reply_verdicts(reply: Column) -> Column:
    """map(position -> verdict) from a classifier's reply; unreadable replies keep everything."""
    body = F.regexp_extract(reply, r"(?s)(\[.*\])", 1)
    items = F.from_json(body, "array<struct<i:int,v:string>>", {"mode": "PERMISSIVE"})
    usable = F.filter(items, lambda x: x["i"].isNotNull())
    verdicts = F.transform(
        usable,
        lambda x: F.struct(x["i"], F.when(x["v"].rlike("(?i)drop"), "drop").otherwise("keep")),
    )
    last = F.filter(
        verdicts,
        lambda x, n: F.size(F.filter(F.slice(verdicts, n + 2, F.size(verdicts)), lambda y: y["i"] == x["i"])) == 0,
    )
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<int,string>"))


def row_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))
