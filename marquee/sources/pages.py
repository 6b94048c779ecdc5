"""What crawled pages hold: embedded JSON, anchors, meta tags, info boxes and timetable text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import fixed_values as V
from ..functions import links as L
from ..functions import text as T

# Where the pages keep what we read.
NEXT_DATA = r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>'
BANNER_ITEM = (
    "array<struct<goodsCode:string,title:string,goodsName:string,placeName:string,posterImageUrl:string,"
    "imageUrl:string,playStartDate:string,playEndDate:string,subGroupCode:string,genreCode:string,genreName:string>>"
)
PLAY_ITEM = f"array<struct<goodsInfo:{BANNER_ITEM.removeprefix('array<').removesuffix('>')},title:string,imageUrl:string>>"
BANNER_LISTS = ["bigBanner", "miniBanner", "hotItem"]
STREAM_CHUNK = r'self\.__next_f\.push\(\[1,("(?:\\.|[^"\\])*")\]\)'
LD_JSON = r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'
EVENT_LD = (
    "name string, startDate string, endDate string, image string, location struct<name:string,address:string>, "
    "performer array<struct<name:string>>, offers struct<availabilityEnds:string>"
)
SALE_TYPES = (
    "data struct<list:array<struct<pocName:string,saleTypeCodeList:array<struct<saleTypeCode:string,"
    "reserveStartDt:string,reserveEndDt:string>>>>>"
)
ANCHOR = r'(?is)<a\s([^>]*)>(.*?)</a>'
OG_IMAGE = r"""(?i)<meta[^>]+property=["']og:image["'][^>]*content=["']([^"']+)["']"""
META_DESCRIPTIONS = [
    r"""(?i)<meta[^>]+property=["']og:description["'][^>]*content=["']([^"']{10,})["']""",
    r"""(?i)<meta[^>]+content=["']([^"']{10,})["'][^>]*property=["']og:description["']""",
    r"""(?i)<meta[^>]+name=["']description["'][^>]*content=["']([^"']{10,})["']""",
]
VENUE_LABEL = r"(?i)(?:장소|venue|공연장)\s*[:：]?\s*([^\n,]{2,40})"
INFOBOX_ROW = r"(?is)<tr[^>]*>\s*<th[^>]*>(.*?)</th>\s*<td[^>]*>(.*?)</td>"
HIDDEN_MARKUP = r"(?is)<(script|style|noscript|svg)[^>]*>.*?</\1>"


# --- embedded JSON -----------------------------------------------------------------------
def banner_items(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per list item of a page's embedded state: the three banner lists, then the plays."""
    empty = F.array().cast(BANNER_ITEM)

    def play(p: Column) -> Column:
        info = p["goodsInfo"]
        return info.withField("title", F.coalesce(info["goodsName"], p["title"])).withField("imageUrl", p["imageUrl"])

    def listed(props: Column) -> Column:
        lists = [
            F.coalesce(F.from_json(F.get_json_object(props, f"$.banner.{name}"), BANNER_ITEM), empty) for name in BANNER_LISTS
        ]
        plays = F.from_json(F.get_json_object(props, "$.interparkPlay"), PLAY_ITEM)
        plays = F.filter(F.transform(plays, play), lambda x: x.isNotNull())
        return F.concat(*lists, F.coalesce(plays, empty))

    items = T.once(F.get_json_object(F.regexp_extract(html, NEXT_DATA, 1), "$.props.pageProps"), listed)
    keep = [c for c in pages.columns if c != html]
    return pages.select(*keep, F.posexplode(items).alias("pos", "item")).select(*keep, "pos", "item.*")


def listed_concerts(items: DataFrame, today: Column, order: list[str]) -> DataFrame:
    """Items that are concerts, dated, not over, and the first of their code."""
    title = F.coalesce("title", "goodsName")
    last = D.parse_compact_date(F.coalesce("playEndDate", "playStartDate"))
    blocked = F.coalesce(F.col("subGroupCode").isin(V.BLOCKED_CATEGORY_CODES), F.lit(False)) | F.coalesce(
        F.col("genreName").isin(V.BLOCKED_CATEGORY_NAMES), F.lit(False)
    )
    good = (
        (T.or_empty("goodsCode") != "") & (T.or_empty(title) != "") & (T.or_empty("playStartDate") != "")
        & (last >= today) & ~blocked
    )
    row = F.min(F.struct(*order, title.alias("title"), "placeName", "posterImageUrl", "playStartDate", "playEndDate")).alias("r")
    return items.filter(good).groupBy("goodsCode").agg(row).select(
        F.col("goodsCode").alias("goods_code"), "r.title", F.col("r.placeName").alias("venue_name"),
        L.https_image("r.posterImageUrl").alias("poster_url"),
        D.parse_compact_date("r.playStartDate").alias("start_date"),
        D.parse_compact_date("r.playEndDate").alias("end_date"),
    )


def stream_blob(html: Column | str) -> Column:
    """The text of a page's script chunks, unquoted and joined; broken chunks are skipped."""
    chunks = F.regexp_extract_all(T.col_of(html), F.lit(STREAM_CHUNK), F.lit(1))
    texts = F.transform(chunks, lambda c: F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v"))
    return F.array_join(F.array_compact(texts), "")


def blob_field(blob: Column, key: str) -> Column:
    raw = F.regexp_extract(blob, f'"{key}"\\s*:\\s*"((?:[^"\\\\]|\\\\.)*)"', 1)
    value = F.get_json_object(F.concat(F.lit('{"v":"'), raw, F.lit('"}')), "$.v")
    return F.when(raw != "", F.coalesce(value, raw))


def stream_details(pages: DataFrame, html: str = "html") -> DataFrame:
    """The show behind a chunked page: dates, venue, address, genre, description and poster."""
    keep = [c for c in pages.columns if c != html]
    blob = F.col("_blob")
    return pages.select(*keep, stream_blob(html).alias("_blob")).select(
        *keep,
        blob_field(blob, "playStartDate").substr(1, 10).try_cast("date").alias("start_date"),
        blob_field(blob, "playEndDate").substr(1, 10).try_cast("date").alias("end_date"),
        blob_field(blob, "placeName").alias("venue_name"),
        blob_field(blob, "address").alias("address"),
        L.genre_bucket(blob_field(blob, "subGenreName")).alias("genre"),
        L.clean_description(blob_field(blob, "noticeInfo")).alias("description"),
        blob_field(blob, "posterImageUrl").alias("poster_url"),
    )


def sale_window(c: Column | str) -> Column:
    """struct(opens, closes): web sale first, in it the general sale first."""
    sales = F.from_json(T.col_of(c), SALE_TYPES)["data"]["list"]
    web = F.coalesce(F.get(F.filter(sales, lambda s: s["pocName"] == "web"), F.lit(0)), F.get(sales, F.lit(0)))
    codes = web["saleTypeCodeList"]
    sale = F.coalesce(F.get(F.filter(codes, lambda s: s["saleTypeCode"] == "ST0001"), F.lit(0)), F.get(codes, F.lit(0)))
    return F.struct(
        D.parse_compact_kst(sale["reserveStartDt"]).alias("opens"), D.parse_compact_kst(sale["reserveEndDt"]).alias("closes")
    )


def ld_events(pages: DataFrame, html: str = "html") -> DataFrame:
    """Schema.org event data of a page."""
    keep = [c for c in pages.columns if c != html]
    e = F.from_json(F.regexp_extract(html, LD_JSON, 1), EVENT_LD)
    return pages.select(*keep, e.alias("e")).select(
        *keep, F.col("e.name").alias("title"),
        F.substring("e.startDate", 1, 10).try_cast("date").alias("start_date"),
        F.substring("e.endDate", 1, 10).try_cast("date").alias("end_date"),
        F.col("e.location.name").alias("venue_name"), F.col("e.location.address").alias("venue_address"),
        F.transform("e.performer", lambda p: p["name"]).alias("performers"), F.col("e.image").alias("poster_url"),
        F.col("e.offers.availabilityEnds").try_cast("timestamp").alias("ticket_close_date"),
    )


# --- anchors and meta --------------------------------------------------------------------
def _attribute(attrs: Column, name: str) -> Column:
    return T.found(attrs, rf"""(?i)(?:^|\s){name}\s*=\s*["']([^"']*)["']""", 1)


def anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per link of a page: position, address, label, title, handler, text and image."""
    keep = [c for c in pages.columns if c != html]
    attrs = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1))
    bodies = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2))
    spread = pages.select(*keep, F.posexplode(F.arrays_zip(attrs.alias("attrs"), bodies.alias("body"))).alias("pos", "a"))
    a, b = F.col("a.attrs"), F.col("a.body")
    image = F.regexp_extract(b, r"(?is)<img\s([^>]*)>", 1)
    src = F.coalesce(_attribute(image, "data-src"), _attribute(image, "src"))
    return spread.select(
        *keep, "pos", _attribute(a, "href").alias("href"), _attribute(a, "title").alias("title"),
        _attribute(a, "aria-label").alias("label"), _attribute(a, "onclick").alias("onclick"),
        T.squeeze(F.regexp_replace(b, r"<[^>]+>", " ")).alias("text"),
        F.when(src.startswith("//"), F.concat(F.lit("https:"), src)).otherwise(src).alias("image"),
    )


def shop_items(links: DataFrame, as_of: Column) -> DataFrame:
    """Shop list entries: product id from the link, title and opening from its label; first per id."""
    pid = F.regexp_extract("href", r"/products/(\d+)", 1)
    title = T.strip(F.split_part("label", F.lit(","), F.lit(1)))
    rows = links.filter(F.contains("href", F.lit("/ticket/")) & (pid != "") & (F.length(title) >= 2))
    opening = T.found(F.col("label"), r"오픈일\s*:?\s*([^,]+)", 1)
    first = F.min(F.struct("page_id", "pos", title.alias("title"), "image", opening.alias("opening_text"))).alias("r")
    return rows.groupBy(pid.alias("product_id")).agg(first).select(
        "product_id", "r.title", "r.image",
        D.parse_label_opening("r.opening_text", F.lit(None).cast("date"), as_of).alias("ticket_open_date"),
    )


def detail_items(links: DataFrame) -> DataFrame:
    """Links whose handler opens a show: (perf_id, title, image)."""
    perf = F.regexp_extract("onclick", r"GoToPerfDetail\((\d+)\)", 1)
    title = F.coalesce(T.none_if_blank(F.col("title")), T.none_if_blank(F.col("text")))
    return links.filter((perf != "") & title.isNotNull()).select("page_id", "pos", perf.alias("perf_id"), title.alias("title"), "image")


def board_items(links: DataFrame, base_url: str) -> DataFrame:
    """Board posts by link, the first per address."""
    url = F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(F.lit(base_url), "href"))
    rows = links.filter(F.contains("href", F.lit("bmode=view")) & F.contains("href", F.lit("idx=")) & (F.length("text") >= 2))
    return rows.groupBy(url.alias("url")).agg(F.min(F.struct("page_id", "pos", "text")).alias("r")).select("url", F.col("r.text").alias("title"))


def first_titles(items: DataFrame, order: list[str]) -> DataFrame:
    """The first item per trimmed lower-case title."""
    key = F.lower(T.strip("title"))
    return items.filter(key != "").groupBy(key.alias("title_key")).agg(F.min(F.struct(*order, "title")).alias("r")).select(
        "title_key", "r.title"
    )


def meta_description(html: Column | str) -> Column:
    """The page's own description: at least 20 characters once cleaned, cut at 500."""
    html = T.col_of(html)
    raw = F.coalesce(*[T.found(html, p, 1) for p in META_DESCRIPTIONS])
    text = T.squeeze(L.decode_entities(raw))
    return F.when(F.length(text) >= 20, F.substring(text, 1, 500))


def page_text(html: Column | str) -> Column:
    body = F.regexp_replace(T.col_of(html), r"(?is)^.*?<body[^>]*>|</body>.*\z", "")
    return T.squeeze(L.decode_entities(F.regexp_replace(body, r"<[^>]+>", "")))


def page_meta(pages: DataFrame, as_of: Column, html: str = "html") -> DataFrame:
    """Poster, description, show dates and venue as a detail page states them."""
    keep = [c for c in pages.columns if c != html]
    og = T.found(F.col(html), META_DESCRIPTIONS[0].replace("{10,}", "*"), 1)
    base = pages.select(*keep, F.col(html).alias("_h"), T.strip(T.or_empty(og)).alias("_og"), page_text(html).alias("_body"))
    period = D.parse_period(F.concat_ws(" ", "_og", "_body"), "festivallife", as_of)
    venue = F.coalesce(T.found(F.col("_og"), r"(?i)(?:장소|venue|공연장)\s*[:：]?\s*([^\n,]+)", 1), T.found(F.col("_body"), VENUE_LABEL, 1))
    return base.select(
        *keep, T.squeeze(L.decode_entities(F.regexp_extract("_h", r"(?is)<title>(.*?)</title>", 1))).alias("page_title"),
        T.found(F.col("_h"), OG_IMAGE, 1).alias("poster_url"),
        T.none_if_blank(F.substring("_og", 1, 500)).alias("description"),
        period["start_date"].alias("start_date"), period["end_date"].alias("end_date"),
        F.substring(T.strip(venue), 1, 100).alias("venue_name"), F.length("_body").alias("text_length"),
    )


# --- info boxes --------------------------------------------------------------------------
def infobox_fields(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """One row per page with its profile fields; the first filled row of a field wins."""
    rows = F.regexp_extract_all(html, F.lit(INFOBOX_ROW), F.lit(1))
    cells = F.regexp_extract_all(html, F.lit(INFOBOX_ROW), F.lit(2))
    spread = pages.select(key, F.posexplode(F.arrays_zip(rows.alias("th"), cells.alias("td"))).alias("pos", "x"))
    label = T.squeeze(F.regexp_replace("x.th", r"<[^>]+>", " "))
    bday = T.found(F.col("x.td"), r'(?is)class="bday"[^>]*>(.*?)<', 1)
    cell = F.regexp_replace(F.regexp_replace("x.td", r"(?is)<(style|script|sup)[^>]*>.*?</\1>", ""), r"<[^>]+>", " ")
    value = L.clean_wiki_text(L.decode_entities(cell))
    field = F.lit(None).cast("string")
    for word, name in reversed(V.INFOBOX_LABELS):
        field = F.when(F.contains(label, F.lit(word)), F.lit(name)).otherwise(field)
    found = spread.select(key, "pos", field.alias("field"), value.alias("value"), bday.alias("bday")).filter(
        F.col("field").isNotNull() & (F.col("value") != "")
    )
    birth = F.coalesce("bday", D.parse_birth_date("value"), "value")
    found = found.withColumn("value", F.when(F.col("field") == "birth_date", birth).otherwise(F.col("value")))
    names = sorted({name for _, name in V.INFOBOX_LABELS})
    first = [F.min(F.when(F.col("field") == n, F.struct("pos", "value"))).alias(n) for n in names]
    return found.groupBy(key).agg(*first).select(key, *[F.col(f"{n}.value").alias(n) for n in names])


# --- timetable text ----------------------------------------------------------------------
def _body_lines(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, _lines): cleaned non-empty body lines, numbered."""
    body = F.regexp_replace(F.regexp_replace(html, HIDDEN_MARKUP, ""), r"(?is)^.*?<body[^>]*>|</body>.*\z", "")
    rows = pages.select(key, F.regexp_replace(body, r"<[^>]+>", "").alias("_text"))
    text = F.when(F.contains("_text", F.lit("&")), L.decode_entities(F.col("_text"))).otherwise(F.col("_text"))
    return rows.select(key, F.transform(T.text_lines(text), lambda x, i: F.struct(i.alias("pos"), x.alias("line"))).alias("_lines"))


def page_lines(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Cleaned non-empty body lines of a page, numbered."""
    return _body_lines(pages, key, html).select(key, F.explode("_lines").alias("_line")).select(key, "_line.pos", "_line.line")


def page_timetable(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """The timetable lines of whole pages, found where a page is read: nothing is shuffled."""
    return _telling_lines(_body_lines(pages, key, html), key)


def timetable_lines(lines: DataFrame, key: str) -> DataFrame:
    """The timetable lines of pages that have been split into numbered lines."""
    return _telling_lines(lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("_lines")), key)


def _telling_lines(pages: DataFrame, key: str) -> DataFrame:
    """Lines that look like a timetable and what belongs to them.

    A line is in reach within 3 lines of a time range or 8 of a keyword. Inside a stretch of lines
    in reach, everything from the first telling line on is kept. A page is written as one letter per line: t has
    a time, w a keyword, c some context; then C and r are lines in reach with and without it.
    """
    kind = lambda x: F.when(x["line"].rlike(V.TIME_RANGE), "t").when(x["line"].rlike(V.TIMETABLE_WORD), "w").when(
        x["line"].rlike(V.CONTEXT_LINE), "c").otherwise(".")
    rows = pages.withColumn("_kinds", F.array_join(F.transform("_lines", kind), ""))
    reach = "(?:(?=.{0,3}t|.{0,8}w)|(?<=t.{0,2}|w.{0,7}))"
    near = F.regexp_replace(F.regexp_replace("_kinds", reach + "\\.", "r"), reach + "c", "C")
    told = F.regexp_replace(near, r"(?:(?<![rCtw])|(?!^)\G)r", ".")
    rows = rows.select(key, "_lines", F.split(told, "").alias("_kinds"))
    kept = F.filter("_lines", lambda x, i: F.get("_kinds", i).isin("t", "w", "C", "r"))
    return rows.select(key, F.explode(kept).alias("_line")).select(key, "_line.pos", "_line.line")


def timetable_images(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Images whose name or caption speaks of a timetable."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<img\s([^>]*)>"), F.lit(1))
    spread = pages.select(key, F.explode(tags).alias("img"))
    src = F.coalesce(_attribute(F.col("img"), "src"), _attribute(F.col("img"), "data-src"), _attribute(F.col("img"), "data-lazy-src"))
    label = F.concat_ws(" ", _attribute(F.col("img"), "alt"), _attribute(F.col("img"), "src"))
    return spread.filter(label.rlike(V.TIMETABLE_WORD)).select(key, src.alias("url")).filter("url IS NOT NULL").distinct()


# --- fallback for markup regular expressions cannot follow -------------------------------
class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[list[str]] = []
        self.inside = False

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.found.append([dict(attrs).get("href") or "", ""])
            self.inside = True

    def handle_endtag(self, tag):
        if tag == "a":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.found[-1][1] += data


def parsed_anchors(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Links of badly nested pages, read with a real HTML parser: (key, pos, href, text)."""
    key_type = pages.schema[key].dataType.simpleString()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, page in zip(frame[key], frame[html]):
                parser = _Links()
                parser.feed(page or "")
                rows += [(k, i, href, " ".join(text.split())) for i, (href, text) in enumerate(parser.found)]
            yield pd.DataFrame(rows, columns=[key, "pos", "href", "text"])

    return pages.select(key, html).mapInPandas(read, f"{key} {key_type}, pos int, href string, text string")
