"""URLs, booking links, devices and other small string rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import col_of, none_if_blank, once, squeeze, strip

SOURCE_URLS_TYPE = "array<struct<site:string,url:string>>"


def http_url(c: Column | str) -> Column:
    return once(strip(c), lambda text: F.when(text.rlike(V.HTTP_URL), text))


def https_image(c: Column | str) -> Column:
    return F.regexp_replace(http_url(c), r"(?i)^http://", "https://")


def repaired_image(c: Column | str, drop_dead_host: bool = False) -> Column:
    """Stored image links: plain http is promoted, a known dead default image is dropped."""
    c = col_of(c)
    fixed = F.regexp_replace(c, "^http://", "https://")
    return F.when(~c.startswith(V.DEAD_IMAGE_PREFIX), fixed) if drop_dead_host else fixed


def source_urls_from_json(c: Column | str) -> Column:
    """A JSON list mixing plain URLs and {site, url} objects as array(struct(site, url))."""
    items = F.from_json(col_of(c), "array<string>")

    def item(x: Column) -> Column:
        is_object = x.startswith("{")
        return F.struct(
            F.when(is_object, F.get_json_object(x, "$.site")).alias("site"),
            F.when(is_object, F.get_json_object(x, "$.url")).otherwise(x).alias("url"),
        )

    return F.filter(F.transform(items, item), lambda s: s["url"].rlike(V.HTTP_URL))


def url_texts(source_urls: Column, booking_url: Column | None = None) -> Column:
    urls = F.filter(F.transform(source_urls, lambda s: s["url"]), lambda u: u.rlike(V.HTTP_URL))
    urls = F.coalesce(urls, F.array().cast("array<string>"))
    if booking_url is None:
        return urls
    first = F.when(booking_url.rlike(V.HTTP_URL), F.array(booking_url)).otherwise(
        F.array().cast("array<string>")
    )
    return F.concat(first, urls)


def booking_links(source_urls: Column, booking_url: Column | None = None) -> Column:
    """array(struct(provider, label, url)): the first link of each known seller, in fixed order."""
    urls = url_texts(source_urls, booking_url)
    claimed = None
    slots = []
    for pattern, provider, label in V.BOOKING_PROVIDERS:
        mine = (lambda p: lambda u: u.rlike(p))(pattern)
        hits = F.filter(urls, mine)
        if claimed is not None:
            hits = F.filter(hits, (lambda p: lambda u: ~u.rlike(p))(claimed))
        url = F.get(hits, F.lit(0))
        slots.append(
            F.when(
                url.isNotNull(),
                F.struct(F.lit(provider).alias("provider"), F.lit(label).alias("label"), url.alias("url")),
            )
        )
        claimed = pattern if claimed is None else f"{claimed}|{pattern.removeprefix('(?i)')}"
    return F.array_compact(F.array(*slots))


def url_host(c: Column) -> Column:
    return F.lower(F.try_parse_url(c, F.lit("HOST")))


def _host_provider(url: Column) -> Column:
    host = url_host(url)
    out = F.lit(None).cast("string")
    for pattern, name in reversed(V.PROVIDER_HOSTS):
        out = F.when(host.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def ticket_provider(urls: Column) -> Column:
    """The provider of the first URL whose host is a known seller."""
    return F.get(F.filter(F.transform(urls, _host_provider), lambda p: p.isNotNull()), F.lit(0))


def seller_url(urls: Column) -> Column:
    """The first URL whose host is a known seller."""
    return F.get(F.filter(urls, lambda u: _host_provider(u).isNotNull()), F.lit(0))


def elected_vendor_url(source_urls: Column) -> Column:
    """The best vendor URL by vendor rank, then by position in the list."""
    def ranked(s: Column, i: Column) -> Column:
        rank = F.lit(len(V.VENDOR_RANKS) + 1)
        for pattern, place in reversed(V.VENDOR_RANKS):
            rank = F.when(s["url"].rlike(pattern), place).otherwise(rank)
        return F.struct(rank.alias("rank"), i.alias("pos"), s["url"].alias("url"))

    vendors = F.filter(F.transform(source_urls, ranked), lambda r: r["url"].rlike(V.VENDOR_URL))
    return F.get(F.array_sort(vendors), F.lit(0))["url"]


def poster_from_goods(urls: Column) -> Column:
    code = F.get(
        F.filter(F.transform(urls, lambda u: F.regexp_extract(u, V.GOODS_URL, 1)), lambda x: x != ""), F.lit(0)
    )
    return F.concat(F.lit(V.POSTER_HOST), F.substring(code, 1, 2), F.lit("/"), code, F.lit("_p.gif"))


def device_label(c: Column | str) -> Column:
    """Marketing name of a device identifier; unknown devices stay as reported."""
    raw = none_if_blank(col_of(c))
    ident = F.regexp_extract(raw, V.DEVICE_ID, 1)
    table = F.create_map(*[F.lit(x) for pair in V.DEVICE_NAMES.items() for x in pair])
    name = F.try_element_at(table, ident)
    return (
        F.when(name.isNull() | F.contains(raw, name), raw)
        .otherwise(F.concat(name, F.lit(" ("), ident, F.lit(")")))
    )


def decode_entities(c: Column) -> Column:
    for entity, char in V.HTML_ENTITIES:
        c = F.regexp_replace(c, f"(?i){entity}", char)
    return c


def html_text(c: Column | str) -> Column:
    out = col_of(c)
    for pattern in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"<[^>]+>", "&nbsp;"):
        out = F.regexp_replace(out, pattern, " ")
    return squeeze(out)


def clean_description(c: Column | str) -> Column:
    out = F.regexp_replace(col_of(c), r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"<[^>]+>", " "), "&nbsp;", " ")
    out = F.regexp_replace(F.regexp_replace(out, "\r", ""), r"[ \t]+", " ")
    out = strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))
    return F.substring(none_if_blank(out), 1, 1500)


def clean_wiki_text(c: Column | str) -> Column:
    out = F.regexp_replace(col_of(c), r"\.mw-[^{]*\{[^}]*\}", "")
    out = F.regexp_replace(out, r"[^{}]*\{[^}]*\}", "")
    return squeeze(F.regexp_replace(out, r"\[.*?\]", ""))


def genre_bucket(c: Column | str) -> Column:
    return F.when(col_of(c).rlike(r"(?i)페스티벌|페스타|fest"), F.lit("축제")).otherwise(F.lit("콘서트"))


def display_name(profile_name: Column, email: Column) -> Column:
    return F.coalesce(
        none_if_blank(profile_name), none_if_blank(F.split_part(email, F.lit("@"), F.lit(1))), F.lit("이름 없음")
    )


def source_trust(c: Column | str) -> Column:
    """How far a source may overwrite others; none is 0, an unlisted one is in the middle."""
    c = col_of(c)
    table = F.create_map(*[F.lit(x) for pair in V.SOURCE_TRUST.items() for x in pair])
    known = F.coalesce(F.try_element_at(table, c), F.lit(V.UNKNOWN_SOURCE_TRUST))
    return F.when(c.isNull() | (c == ""), F.lit(0)).otherwise(known)
