"""Name, title and venue normalisation as Column expressions.

Everything stays inside whole-stage codegen except Unicode normalisation, which Spark SQL does
not have: that is one Arrow UDF per form, applied once per key column. (Arrow's own kernel
leaves Hangul decomposed, so the standard library does the work.)
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import fixed_values as V

_SPACE_RUN = f"[{V.SPACE}]+"
_EDGE_SPACE = f"^[{V.SPACE}]+|[{V.SPACE}]+\\z"


def _all_but(chars: str) -> str:
    """A pattern for one character outside a class; Java takes many times as long for ``[^...]`` with Hangul ranges."""
    return f"(?s)(?![{chars}])."


_NOT_TITLE_CHAR = _all_but("a-z0-9가-힣")


def _normalised(values: pa.Array, form: str) -> pa.Array:
    """ASCII batches pass through untouched; only text that needs it reaches unicodedata."""
    if pc.all(pc.string_is_ascii(values), min_count=0).as_py() is not False:
        return values
    return pa.array(
        [v if v is None or v.isascii() else unicodedata.normalize(form, v) for v in values.to_pylist()],
        pa.string(),
    )


@F.arrow_udf(StringType())
def nfkc(values: pa.Array) -> pa.Array:
    return _normalised(values, "NFKC")


@F.arrow_udf(StringType())
def nfc(values: pa.Array) -> pa.Array:
    return _normalised(values, "NFC")


@F.arrow_udf(StringType())
def nfd(values: pa.Array) -> pa.Array:
    return _normalised(values, "NFD")


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, where c is worked out one time only, however often f names it.

    A Column that is named twice is copied into the plan twice, and steps that build on each other
    multiply. A lambda's variable is a value. f holds no Python function, and its own lambdas do not
    name the value: chain ``once`` instead.
    """
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not just U+0020."""
    return F.regexp_replace(col_of(c), _EDGE_SPACE, "")


def squeeze(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col_of(c), _SPACE_RUN, " "))  # no other white space is left


def text_lines(c: Column | str) -> Column:
    """The squeezed lines of a text that are not blank; the text is cleaned as a whole, not line by line."""
    text = F.regexp_replace(col_of(c), f"[{V.SPACE}&&[^\\n]]+", " ")
    text = F.replace(F.replace(text, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    return F.filter(F.split(F.trim(text), "\n"), lambda x: x != "")


def is_blank(c: Column | str) -> Column:
    c = col_of(c)
    return c.isNull() | (c.cast("string") == "")


def none_if_blank(c: Column) -> Column:
    return F.when(c != "", c)


def or_empty(c: Column | str) -> Column:
    return F.coalesce(col_of(c), F.lit(""))


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match of pattern, or null."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def drop_first(c: Column, pattern: str) -> Column:
    """Remove the first match only."""
    start = F.regexp_instr(c, F.lit(pattern))
    end = start + F.length(F.regexp_extract(c, pattern, 0))
    without = F.concat(F.substring(c, F.lit(1), start - 1), F.substring(c, end, F.length(c)))
    return F.when(start > 0, without).otherwise(c)


def any_word(words: Iterable[str]) -> str:
    """An alternation that matches any of the words literally."""
    return "|".join("\\Q" + w + "\\E" for w in words)


# --- scripts -----------------------------------------------------------------------------
def is_korean(c: Column | str) -> Column:
    return col_of(c).rlike(f"[{V.HANGUL}]")


def is_latin(c: Column | str) -> Column:
    return col_of(c).rlike("[A-Za-z]")


def is_korean_only(c: Column | str) -> Column:
    return is_korean(c) & ~is_latin(c)


def is_latin_only(c: Column | str) -> Column:
    return is_latin(c) & ~is_korean(c)


def is_non_korean(c: Column | str) -> Column:
    return ~is_korean(c)


# --- names -------------------------------------------------------------------------------
def name_key(c: Column | str) -> Column:
    """The key under which two spellings of an artist count as the same name."""
    kept = F.regexp_replace(F.lower(nfkc(col_of(c))), _all_but(f"{V.HANGUL}A-Za-z0-9{V.SPACE}"), "")
    return squeeze(kept)


def same_name(a: Column | str, b: Column | str) -> Column:
    return name_key(a) == name_key(b)


def name_tokens(c: Column | str) -> Column:
    text = F.regexp_replace(F.lower(nfc(col_of(c))), r"[()\[\]{}]", " ")
    return F.filter(F.split(text, f"[{V.SPACE}\\-·._/]+"), lambda t: t != "")


def strip_diacritics(c: Column | str) -> Column:
    return F.regexp_replace(nfd(col_of(c)), "[\u0300-\u036f]", "")


def jaccard(a: Column, b: Column) -> Column:
    """Token-set similarity; two empty sets count as identical."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.when(union > 0, union)
    )


def annotation_core(c: Column | str) -> Column:
    return name_key(F.regexp_replace(col_of(c), V.ANNOTATION, " "))


def has_annotation(c: Column | str) -> Column:
    return col_of(c).rlike(r"[(\[]")


def structured_name(c: Column | str) -> Column:
    """Split a raw name into struct(display_name, name_en, aliases, name_key)."""
    raw = strip(c)
    split = once(once(once(raw, _name_pieces), _ordered_pieces), _named_pieces)
    return F.when(
        raw.isNotNull(),
        F.struct(
            split["display_name"].alias("display_name"),
            split["name_en"].alias("name_en"),
            split["aliases"].alias("aliases"),
            name_key(split["display_name"]).alias("name_key"),
        ),
    )


def _name_pieces(raw: Column) -> Column:
    return F.struct(
        raw.alias("raw"),
        strip(F.regexp_extract(raw, V.PAREN_NAME, 1)).alias("outer"),
        strip(F.regexp_extract(raw, V.PAREN_NAME, 2)).alias("inner"),
        squeeze(F.regexp_replace(raw, "[A-Za-z0-9]+", " ")).alias("korean"),
        squeeze(F.regexp_replace(raw, f"[{V.HANGUL}]+", " ")).alias("latin"),
    )


def _ordered_pieces(n: Column) -> Column:
    raw, korean, latin = n["raw"], n["korean"], n["latin"]
    bilingual = is_korean(raw) & is_latin(raw) & (korean != "") & (latin != "")
    latin_first = F.regexp_instr(raw, F.lit("[A-Za-z]")) < F.regexp_instr(raw, F.lit("[가-\ud7af]"))
    pieces = (
        F.when((n["outer"] != "") & (n["inner"] != ""), F.array(n["outer"], n["inner"]))
        .when(bilingual & latin_first, F.array(latin, korean))
        .when(bilingual, F.array(korean, latin))
        .otherwise(F.array(raw))
    )
    return F.struct(raw.alias("raw"), F.array_distinct(F.array_remove(pieces, "")).alias("parts"))


def _named_pieces(n: Column) -> Column:
    """The first of at most two different parts is shown, the other one may be its English name."""
    display, other = F.coalesce(F.get(n["parts"], F.lit(0)), n["raw"]), F.get(n["parts"], F.lit(1))
    aliases = F.array_remove(F.array_remove(F.array_append(n["parts"], n["raw"]), F.lit("")), display)
    return F.struct(
        display.alias("display_name"),
        F.when(is_latin(other) & ~is_korean(other), other).alias("name_en"),
        F.array_distinct(aliases).alias("aliases"),
    )


def name_decision(current: Column | str, proposed: Column | str, is_music: Column | str) -> Column:
    """keep, auto (the proposal is a fragment of the current name) or propose (needs review)."""
    now, new = name_key(current), name_key(proposed)
    same = F.coalesce(new, F.lit("")).isin("") | (new == now)
    fragment = F.contains(now, new) & F.coalesce(col_of(is_music), F.lit(True))
    return F.when(same, F.lit("keep")).when(fragment, F.lit("auto")).otherwise(F.lit("propose"))


def canon_key(c: Column | str) -> Column:
    return F.regexp_replace(nfkc(F.lower(col_of(c))), _NOT_TITLE_CHAR, "")


def split_joined_names(c: Column | str) -> Column:
    """The separate performers behind a record such as ``A X B`` or ``A feat. B``."""
    parts = F.transform(F.split(col_of(c), V.JOINED_NAMES_SPLIT), strip)
    return F.filter(parts, lambda p: F.length(p) >= 2)


def intake_artist_name(c: Column | str) -> Column:
    out = col_of(c)
    for pattern in (V.DATED_BRACKET, V.SLASH_AGENCY, V.AGENCY_SUFFIX):
        out = F.regexp_replace(out, pattern, "")
    return strip(drop_first(out, V.DATE))


def related_names(c: Column | str) -> Column:
    parts = F.transform(F.split(or_empty(c), r"[,·、/|]"), lambda p: F.lower(strip(p)))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def lineup_names(names: Column) -> Column:
    """Clean a collected lineup: no quotes, no stop words, no case-only repeats, 150 at most."""
    cleaned = F.transform(
        names, lambda n: strip(F.regexp_replace(n, "^[\"'\\[({]|[\"'\\])}]\\z", ""))
    )
    usable = F.filter(
        cleaned, lambda n: (n != "") & (F.length(n) <= 40) & ~n.rlike(V.LINEUP_STOP_WORDS)
    )
    lowered = F.transform(usable, lambda n: F.lower(n))
    first_seen = F.filter(
        usable, lambda n, i: F.array_position(lowered, F.lower(n)) == i + 1
    )
    return F.slice(first_seen, 1, 150)


# --- titles ------------------------------------------------------------------------------
# The _of functions take text that has been through NFKC already.
def title_key_of(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), _NOT_TITLE_CHAR, "")


def title_key(c: Column | str) -> Column:
    return title_key_of(nfkc(or_empty(c)))


def core_title_key_of(text: Column) -> Column:
    bracket = F.regexp_extract(text, V.LEADING_CITY, 1)
    is_city = (bracket != "") & ~bracket.rlike(V.TICKET_MARKER)
    text = F.when(is_city, F.regexp_replace(text, V.LEADING_CITY, "")).otherwise(text)
    return title_key_of(F.regexp_replace(text, V.TRAILING_CITY, ""))


def core_title_key(c: Column | str) -> Column:
    """Title key without a leading ``[city]`` or trailing ``- city``; ticket markers stay."""
    return core_title_key_of(nfkc(or_empty(c)))


def festival_key_of(text: Column) -> Column:
    at = once(text, lambda t: F.struct(t.alias("text"), F.regexp_instr(t, F.lit(f"[{V.SPACE}][-–—][{V.SPACE}]")).alias("dash")))
    return once(once(at, _title_halves), _festival_tokens)


def _title_halves(t: Column) -> Column:
    text, dash = t["text"], t["dash"]
    return F.struct(
        F.when(dash > 0, F.substring(text, F.lit(1), dash - 1)).otherwise(text).alias("head"),
        F.when(dash > 0, F.substring(text, dash, F.length(text))).otherwise(F.lit("")).alias("tail"),
    )


def _festival_tokens(t: Column) -> Column:
    is_listing = t["head"].rlike(V.FESTIVAL) | t["tail"].rlike(V.LISTING)
    tokens = F.transform(
        F.split(F.lower(t["head"]), f"[{V.SPACE}·,]+"),
        lambda t: F.regexp_replace(t, _NOT_TITLE_CHAR, ""),
    )
    kept = F.filter(
        tokens,
        lambda t: (F.length(t) >= 2)
        & ~t.rlike(r"^20\d\d\z")
        & ~t.rlike(V.LISTING)
        & ~t.rlike(r"^[a-z]{1,5}\z"),
    )
    key = F.when(is_listing, F.array_join(F.array_sort(kept), ""))
    return F.regexp_extract(key, r"(?s)^(.{6,})\z", 1)


def festival_key(c: Column | str) -> Column:
    """Sorted token set of a festival title, or null when the title is not a festival listing."""
    return none_if_blank(festival_key_of(nfkc(or_empty(c))))


def strong_title_key(c: Column | str) -> Column:
    return F.coalesce(festival_key(c), core_title_key(c))


def _event_hash(key: Column, title: Column, venue: Column, day: Column) -> Column:
    parts = F.concat_ws(
        "|",
        F.coalesce(none_if_blank(key), F.lower(strip(or_empty(title)))),
        F.lower(strip(F.coalesce(venue, F.lit("unknown")))),
        F.coalesce(day.cast("date").cast("string"), F.lit("unknown")),
    )
    return F.substring(F.sha2(parts, 256), 1, 32)


def event_key(title: Column | str, venue: Column | str, day: Column | str) -> Column:
    """Dedup key of an event; city and festival markers only come off when a venue anchors it."""
    title, venue = col_of(title), col_of(venue)
    key = F.when(venue.isNull(), title_key(title)).otherwise(strong_title_key(title))
    return _event_hash(key, title, venue, col_of(day))


def with_event_key(df: DataFrame, title: str, venue: str, day: Column, out: str) -> DataFrame:
    """The same key as a column, worked out in steps so that no pattern runs twice per row."""
    steps = df.withColumn("_text", nfkc(or_empty(title)))
    steps = steps.withColumn("_festival", F.when(F.col(venue).isNotNull(), once(festival_key_of(F.col("_text")), none_if_blank)))
    key = (
        F.when(F.col(venue).isNull(), title_key_of(F.col("_text"))).when(F.col("_festival").isNotNull(), F.col("_festival"))
        .otherwise(core_title_key_of(F.col("_text")))
    )
    steps = steps.withColumn("_key", key).withColumn(out, _event_hash(F.col("_key"), F.col(title), F.col(venue), day))
    return steps.drop("_text", "_festival", "_key")


def legacy_title_key(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(nfkc(col_of(c))), r"[^\p{L}\p{N}_]", "")


legacy_venue_key = legacy_title_key


def legacy_event_key(title: Column | str, venue: Column | str, day: Column | str) -> Column:
    stamp = F.coalesce(F.date_format(col_of(day).cast("date"), "yyyyMMdd"), F.lit("00000000"))
    parts = F.concat_ws("|", legacy_title_key(title), legacy_venue_key(venue), stamp)
    return F.substring(F.sha2(parts, 256), 1, 32)


def display_title(c: Column | str) -> Column:
    """Drop an announcement tail, unless that would eat most of the title."""
    both = once(strip(c), lambda whole: F.struct(whole.alias("whole"), strip(F.regexp_replace(whole, V.TITLE_STAGE_SUFFIX, "")).alias("cut")))

    def chosen(t: Column) -> Column:
        length = F.length(t["cut"])
        return F.when((length >= 4) & (length >= F.length(t["whole"]) * 0.3), t["cut"]).otherwise(t["whole"])

    return once(both, chosen)


def plain_title(c: Column | str) -> Column:
    return F.trim(F.lower(F.regexp_replace(
        F.regexp_replace(strip(c), V.TITLE_KIND_SUFFIX, ""), _SPACE_RUN, " ")))


def link_text(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(nfkc(or_empty(c))), f"[{V.SPACE}\\-_·•]", "")


def unpunctuated_title(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(or_empty(c)), f"[{V.SPACE}{V.PUNCTUATION[1:-1]}]+", "")


def is_multi_artist_title(c: Column | str) -> Column:
    return col_of(c).rlike(V.MULTI_ARTIST_TITLE)


def is_festival_title(c: Column | str) -> Column:
    return or_empty(c).rlike(V.FESTIVAL)


# --- venues ------------------------------------------------------------------------------
def cut_venue_info(c: Column | str) -> Column:
    return strip(F.regexp_replace(col_of(c), f"(?is)(?:{V.VENUE_INFO_SUFFIX}).*\\z", ""))


def plain_venue_name_of(name: Column, title: Column | None = None) -> Column:
    """The same for a name that has been normalised and cut already."""
    bad = (
        (F.length(name) <= 1)
        | F.substring(name, 1, 20).rlike(V.DATE)
        | name.rlike(V.PRICE)
        | name.rlike(V.TICKET_GRADE)
        | name.rlike(V.URL)
    )
    if title is not None:
        bad = bad | F.coalesce((title != "") & (plain_title(name) == plain_title(title)), F.lit(False))
    return F.when(~bad, F.lower(squeeze(name)))


def plain_venue_name(c: Column | str, title: Column | str | None = None) -> Column:
    """Normalised venue name, or null when the value is not a venue at all."""
    return plain_venue_name_of(cut_venue_info(nfkc(col_of(c))), None if title is None else col_of(title))


def legacy_venue_name(c: Column | str, title: Column | str) -> Column:
    """Cleaned venue name with known aliases resolved; empty when unusable."""
    name = cut_venue_info(or_empty(c))
    bad = (
        (F.length(name) <= 1)
        | (legacy_title_key(name) == legacy_title_key(or_empty(title)))
        | name.rlike(r"^\d{4}[.\-/]\d{1,2}[.\-/]\d{1,2}")
        | name.rlike(V.LEGACY_PRICE)
        | name.rlike(V.TICKET_GRADE)
        | name.rlike(V.TICKET_OPENING)
        | name.rlike(V.URL)
    )
    table = F.create_map(*[F.lit(x) for pair in V.VENUE_ALIASES.items() for x in pair])
    alias = F.try_element_at(table, legacy_venue_key(name))
    return F.when(bad, F.lit("")).otherwise(F.coalesce(alias, name))


def legacy_address(c: Column | str, venue: Column | str) -> Column:
    address = strip(or_empty(c))
    bad = (
        (legacy_venue_key(address) == legacy_venue_key(or_empty(venue)))
        | address.rlike(V.LEGACY_PRICE)
        | address.rlike(V.URL)
    )
    return F.when(bad, F.lit("")).otherwise(address)


def address_key(c: Column | str) -> Column:
    """Address without floor, room and basement details."""
    out = F.lower(nfkc(or_empty(c)))
    for pattern in (rf"지하[{V.SPACE}]*\d*", rf"\d+[{V.SPACE}]*층", rf"\d+[{V.SPACE}]*호", _all_but("가-힣a-z0-9")):
        out = F.regexp_replace(out, pattern, "")
    return out


def addresses_agree(keep: Column | str, other: Column | str) -> Column:
    a, b = address_key(keep), address_key(other)
    return (a == "") | (b == "") | (a == b)


def venue_key(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(nfc(or_empty(c))), _all_but("가-힣ㄱ-\u318fa-z0-9"), "")


def venue_merge_key(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(nfkc(or_empty(c))), _all_but("가-힣A-Za-z0-9"), "")


def venue_tokens(c: Column | str) -> Column:
    text = F.regexp_replace(F.lower(nfc(or_empty(c))), r"[()\[\]{}（）]", " ")
    parts = F.transform(
        F.split(text, f"[{V.SPACE}\\-·._/]+"),
        lambda t: F.regexp_replace(t, _all_but("가-힣ㄱ-\u318fa-z0-9"), ""),
    )
    return F.filter(parts, lambda t: t != "")


def is_garbage_address(name: Column | str, address: Column | str) -> Column:
    trimmed = strip(or_empty(address))
    bad = (
        (title_key(trimmed) == title_key(name))
        | (F.length(trimmed) < 5)
        | ~trimmed.rlike(V.ADDRESS_WORDS)
    )
    return (trimmed != "") & bad


def trash_venue_name(c: Column | str) -> Column:
    """What stands before the booking-button text in a mis-scraped venue name."""
    return strip(F.split_part(col_of(c), F.lit(V.TRASH_VENUE_MARK), F.lit(1)))


def hall_owner(c: Column | str) -> Column:
    """The venue a named hall belongs to, by the first rule that fits, or null."""
    name = col_of(c)
    rule = F.lit(None).cast("string")
    for pattern, owner in reversed(V.HALL_RULES):
        rule = F.when(name.rlike(pattern), F.lit(owner)).otherwise(rule)
    return F.when(name.rlike(V.HALL_SUFFIX) & (F.lower(name) != F.lower(rule)), rule)


# --- n-grams -----------------------------------------------------------------------------
def char_ngrams(c: Column | str, k: Column | int) -> Column:
    """Distinct k-grams of a string; empty when it is shorter than k."""
    c, k = col_of(c), F.lit(k) if isinstance(k, int) else k
    starts = F.sequence(F.lit(1), F.greatest(F.length(c) - k + 1, F.lit(1)))
    grams = F.transform(starts, lambda i: F.substring(c, i, k))
    return F.when(F.length(c) >= k, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))
