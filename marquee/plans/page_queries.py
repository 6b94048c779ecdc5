"""Reading crawled pages: the driver's own, and pages rendered from its tables the way sites do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..sources import landing as LD
from ..sources import pages as P
from ..session import spread
from .registry import query
from .roles import AS_OF, Roles, with_roles


@query(
    "page_anchors",
    """SELECT page_id, i - 1 AS pos, regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(regexp_replace(b, '\\s+', ' ', 'g')) AS text
       FROM (SELECT page_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS a, unnest(y) AS b FROM (SELECT page_id,
         regexp_extract_all(html, '(?is)<a\\s([^>]*)>(.*?)</a>', 1) AS x, regexp_extract_all(html, '(?is)<a\\s([^>]*)>(.*?)</a>', 2) AS y FROM pages))""",
)
def page_anchors(r: Roles):
    return P.anchors(r.table("pages").select("page_id", "html")).select("page_id", "pos", "href", "text")


@query(
    "page_anchors_parsed",
    """SELECT page_id, i - 1 AS pos, regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(regexp_replace(b, '\\s+', ' ', 'g')) AS text
       FROM (SELECT page_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS a, unnest(y) AS b FROM (SELECT page_id,
         regexp_extract_all(html, '(?is)<a\\s([^>]*)>(.*?)</a>', 1) AS x, regexp_extract_all(html, '(?is)<a\\s([^>]*)>(.*?)</a>', 2) AS y FROM pages))""",
)
def page_anchors_parsed(r: Roles):
    return P.parsed_anchors(r.table("pages"), "page_id")


_ENTITIES = "replace(replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&')"


@query(
    "page_meta",
    "SELECT page_id, trim(regexp_replace(" + _ENTITIES.format("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")
    + ", '\\s+', ' ', 'g')) AS page_title, length(trim(regexp_replace("
    + _ENTITIES.format("regexp_replace(regexp_replace(regexp_replace(html, '(?is)^.*?<body[^>]*>', ''), '(?is)</body>.*$', ''), '<[^>]+>', '', 'g')")
    + ", '\\s+', ' ', 'g'))) AS text_length FROM pages",
)
def page_meta(r: Roles):
    return P.page_meta(r.table("pages").select("page_id", "html"), D.at(AS_OF)).select("page_id", "page_title", "text_length")


def list_pages(r: Roles) -> DataFrame:
    """One list page per part: its show as a banner item inside the page's embedded state."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size"))
    item = F.struct(
        F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("goodsCode"), F.col("p_name").alias("title"),
        F.col("p_brand").alias("placeName"), F.date_format(day, "yyyyMMdd").alias("playStartDate"),
        F.when(F.col("p_type") == "PROMO", "Musi").otherwise("Conc").alias("subGroupCode"),
    )
    banner = F.struct(F.array(item, item).alias("bigBanner"), F.array(item).alias("hotItem"))
    state = F.struct(F.struct(F.struct(banner.alias("banner")).alias("pageProps")).alias("props"))
    page = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), F.to_json(state), F.lit("</script></html>"))
    return spread(r.table("part")).select(F.col("p_partkey").alias("page_id"), page.alias("html"))


@query("banner_items", "SELECT p_partkey AS page_id, pos, 'G' || p_partkey AS code, p_name AS title FROM part, range(3) t(pos)")
def banner_items(r: Roles):
    return P.banner_items(list_pages(r)).select("page_id", "pos", F.col("goodsCode").alias("code"), "title")


@query(
    "listed_concerts",
    """SELECT 'G' || p_partkey AS goods_code, p_name AS title, p_brand AS venue_name, DATE '2024-01-01' + p_size AS start_date FROM part
       WHERE p_type <> 'PROMO' AND DATE '2024-01-01' + p_size >= DATE '2024-01-20'""",
)
def listed_concerts(r: Roles):
    items = P.banner_items(list_pages(r))
    shows = P.listed_concerts(items, F.lit(AS_OF[:10]).cast("date"), ["page_id", "pos"])
    return shows.select("goods_code", "title", "venue_name", "start_date")


@query(
    "stream_details",
    """SELECT p_partkey AS page_id, DATE '2024-01-01' + p_size AS start_date, p_brand AS venue_name, 'a "' || p_name || '"' AS address,
         CASE WHEN p_type = 'LARGE' THEN '축제' ELSE '콘서트' END AS genre FROM part""",
)
def stream_details(r: Roles):
    """Detail pages whose data arrives in quoted script chunks, cut in the middle of the JSON."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")), "yyyy-MM-dd")
    body = F.to_json(F.struct(
        day.alias("playStartDate"), F.col("p_brand").alias("placeName"), F.concat(F.lit('a "'), "p_name", F.lit('"')).alias("address"),
        F.when(F.col("p_type") == "LARGE", "Rock Fest").otherwise("live").alias("subGenreName"),
    ))
    half = F.floor(F.length("body") / 2).cast("int")
    def chunk(text):
        inner = F.regexp_replace(F.to_json(F.struct(text.alias("v"))), r'^\{"v":|\}$', "")
        return F.concat(F.lit("<script>self.__next_f.push([1,"), inner, F.lit("])</script>"))

    rows = r.table("part").select(F.col("p_partkey").alias("page_id"), body.alias("body"))
    page = F.concat(F.lit("<html>"), chunk(F.substring("body", F.lit(1), half)), chunk(F.substring("body", half + 1, F.length("body"))))
    details = P.stream_details(rows.select("page_id", page.alias("html")))
    return details.select("page_id", "start_date", "venue_name", "address", "genre")


@query(
    "sale_windows",
    """SELECT o_orderkey AS id, o_orderdate - INTERVAL 9 HOUR AS opens, o_orderdate + INTERVAL 1 DAY - INTERVAL 9 HOUR AS closes FROM orders""",
)
def sale_windows(r: Roles):
    stamp = lambda c: F.date_format(c, "yyyyMMddHHmmss")
    day = F.col("o_orderdate")
    sale = lambda code, at: F.struct(F.lit(code).alias("saleTypeCode"), stamp(at).alias("reserveStartDt"),
                                     stamp(at + F.make_dt_interval(F.lit(1))).alias("reserveEndDt"))
    late = day + F.make_dt_interval(F.lit(30))
    offer = lambda poc, *sales: F.struct(F.lit(poc).alias("pocName"), F.array(*sales).alias("saleTypeCodeList"))
    body = F.struct(F.struct(F.array(offer("app", sale("ST0001", late)), offer("web", sale("ST0002", late), sale("ST0001", day))).alias("list")).alias("data"))
    rows = r.table("orders").select(F.col("o_orderkey").alias("id"), F.to_json(body).alias("json"))
    w = P.sale_window("json")
    return rows.select("id", w["opens"].cast("timestamp_ntz").alias("opens"), w["closes"].cast("timestamp_ntz").alias("closes"))


@query(
    "ld_events",
    """SELECT s_suppkey AS page_id, s_name AS title, n_name AS venue_name, s_name || ';' || n_name AS performers FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
)
def ld_events(r: Roles):
    nations = r.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    act = lambda c: F.struct(F.col(c).alias("name"))
    body = F.struct(F.col("s_name").alias("name"), F.struct(F.col("n_name").alias("name")).alias("location"), F.array(act("s_name"), act("n_name")).alias("performer"))
    page = F.concat(F.lit('<html><script type="application/ld+json">'), F.to_json(body), F.lit("</script></html>"))
    rows = r.table("supplier").join(nations, "s_nationkey").select(F.col("s_suppkey").alias("page_id"), page.alias("html"))
    return P.ld_events(rows).select("page_id", "title", "venue_name", F.array_join("performers", ";").alias("performers"))


@query(
    "infobox_fields",
    """SELECT s_suppkey AS page_id, n_name AS country, '2024-03-0' || (1 + s_suppkey % 9) AS birth_date, s_name AS label FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
)
def infobox_fields(r: Roles):
    nations = r.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    day = (1 + F.col("s_suppkey") % 9).cast("string")
    page = F.concat(
        F.lit("<table class='infobox'><tr><th>국적</th><td>"), "n_name", F.lit("<sup>[1]</sup></td></tr><tr><th>국가</th><td>x</td></tr>"
              "<tr><th>출생일</th><td>2024년 3월 "), day, F.lit("일</td></tr><tr><th>소속사</th><td><b>"), "s_name", F.lit("</b></td></tr></table>"),
    )
    rows = r.table("supplier").join(nations, "s_nationkey").select(F.col("s_suppkey").alias("page_id"), page.alias("html"))
    return P.infobox_fields(rows, "page_id").select("page_id", "country", "birth_date", "label")


@query(
    "raw_records",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type = 'error' AS corrupt FROM events WHERE event_type <> 'error'
       UNION ALL SELECT event_id, NULL, TRUE FROM events WHERE event_type = 'error'""",
)
def raw_records(r: Roles):
    """Event properties as crawled JSON; records of failed calls are cut short."""
    cut = F.when(F.col("event_type") == "error", F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    rows = LD.parse_records(r.table("events").withColumn("parsed_json", cut), schema="k bigint")
    corrupt = F.col("corrupt").isNotNull()
    return rows.select("event_id", F.when(~corrupt, F.col("record.k")).alias("k"), corrupt.alias("corrupt"))


def crawled(r: Roles) -> DataFrame:
    """One crawled record per order line: the part as a show, in the source's own notation."""
    part = r.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type", "p_size")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size"))
    source = F.when(F.col("l_returnflag") == "A", "yes24").when(F.col("l_returnflag") == "N", "festivallife").otherwise("gemini-search")
    key = F.col("l_partkey").cast("string")
    record = F.struct(
        F.concat(F.lit("https://"), source, F.lit(".example.com/"), key).alias("sourceUrl"), source.alias("sourceName"),
        F.concat("p_name", F.lit(" "), key, F.lit(" - 2차 라인업")).alias("title"),
        F.concat(F.lit("http://img.example.com/"), F.col("l_suppkey").cast("string")).alias("posterUrl"),
        F.col("p_brand").alias("venueName"),
        F.concat(F.date_format(day, "yyyy.MM.dd"), F.lit(" ~ "), F.date_format(F.date_add(day, 2), "MM.dd")).alias("startDate"),
        F.col("p_type").alias("genre"),
    )
    rows = spread(r.table("lineitem")).join(part, "l_partkey")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_json(record).alias("parsed_json"))


@query(
    "normalised_records",
    """SELECT l_partkey, p_name || ' ' || l_partkey AS title, p_name || ' ' || l_partkey AS normalized_title, lower(p_brand) AS normalized_venue,
         DATE '2024-01-01' + p_size AS start_date, DATE '2024-01-03' + p_size AS end_date,
         'https://img.example.com/' || l_suppkey AS poster_url, p_type AS genre,
         substr(sha256(regexp_replace(p_name, '[^a-z]', '', 'g') || l_partkey || '|' || lower(p_brand) || '|' || strftime(DATE '2024-01-01' + p_size, '%Y-%m-%d')), 1, 32) AS dedup_key
       FROM lineitem JOIN part ON p_partkey = l_partkey""",
)
def normalised_records(r: Roles):
    rows = LD.normalise_records(LD.parse_records(crawled(r)), AS_OF)
    return rows.select("l_partkey", "title", "normalized_title", "normalized_venue", "start_date", "end_date", "poster_url", "genre", "dedup_key")


@query("unprocessed_payloads", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unprocessed_payloads(r: Roles):
    return LD.unprocessed(r.table("documents"), r.table("labels"), "doc_id").select("doc_id", "source")


@query(
    "latest_payloads",
    "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1",
)
def latest_payloads(r: Roles):
    from ..operators.listing import latest_per_key

    return latest_per_key(r.table("events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", "event_id")


@query(
    "first_items",
    "SELECT event_type || user_id AS key, min(event_id) AS event_id FROM events GROUP BY 1",
)
def first_items(r: Roles):
    from ..operators.listing import first_seen

    rows = r.table("events").select("event_id", F.concat("event_type", F.col("user_id").cast("string")).alias("key"))
    return first_seen(rows, F.col("key"), ["event_id"])


# --- timetable text ----------------------------------------------------------------------
TIMETABLE_SQL = """slots AS (
  SELECT event_id AS id, CAST(ts AS DATE) AS day, event_type AS stage, hour(ts) * 60 + minute(ts) AS s,
    least(hour(ts) * 60 + minute(ts) + 1 + CAST(floor(value / 10) AS INTEGER), 1439) AS e, user_id FROM events)"""


def slots(r: Roles) -> DataFrame:
    start = F.hour("ts") * 60 + F.minute("ts")
    end = F.least(start + 1 + F.floor(F.col("value") / 10).cast("int"), F.lit(1439))
    return r.table("events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("date").alias("day"), F.col("event_type").alias("stage"),
        start.alias("s"), end.alias("e"), "user_id",
    )


@query(
    "stage_overlaps",
    f"""WITH {TIMETABLE_SQL} SELECT * FROM (SELECT id, day, stage, s, e, user_id, max(e) OVER (PARTITION BY day, stage ORDER BY s, id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy_until FROM slots) WHERE s < busy_until""",
)
def stage_overlaps(r: Roles):
    from ..operators.timetable import stage_overlaps as overlaps

    return overlaps(slots(r), ["day", "stage"], "s", "e", "id")


def timetable_texts(r: Roles) -> DataFrame:
    """One text per event: its day, a line with stage and time, a line with the act."""
    hhmm = lambda c: F.format_string("%02d:%02d", F.floor(c / 60), c % 60)
    text = F.concat(
        F.lit("DAY "), F.dayofmonth("day").cast("string"), F.lit("\n"), F.upper("stage"), F.lit(" "), hhmm(F.col("s")), F.lit(" ~ "),
        hhmm(F.col("e")), F.lit("\nact "), F.col("id").cast("string"),
    )
    return spread(slots(r)).select(
        F.col("id").alias("event_id"), text.alias("text"), F.lit("2024-01-01").cast("date").alias("start_date"), F.lit("live").alias("genre")
    )


@query(
    "parsed_timetables",
    f"""WITH {TIMETABLE_SQL} SELECT id AS event_id, 'act ' || id AS artist_name, upper(stage) AS stage_name, day(day) AS day_number,
          strftime(day, '%Y.%m.%d') AS date_string, printf('%02d:%02d', s // 60, s % 60) AS start_time, printf('%02d:%02d', e // 60, e % 60) AS end_time,
          'live' AS genre FROM slots WHERE s < e""",
)
def parsed_timetables(r: Roles):
    from ..operators.timetable import parse_timetable

    rows, _ = parse_timetable(timetable_texts(r), AS_OF)
    return rows.drop("pos")


@query("timetable_lines", f"""WITH {TIMETABLE_SQL} SELECT id AS event_id, 5 AS n_lines FROM slots""")
def timetable_lines(r: Roles):
    """Lines kept of pages that begin and end in lines without any bearing on the timetable."""
    filler = F.array_join(F.array_repeat(F.lit("notice"), 12), "\n")
    html = F.concat(F.lit("<body>"), filler, F.lit("\n"), "text", F.lit("\n"), filler, F.lit("</body>"))
    kept = P.page_timetable(timetable_texts(r).select("event_id", html.alias("html")), "event_id")
    return kept.groupBy("event_id").agg(F.count("*").alias("n_lines"))


@query(
    "opening_days",
    with_roles("r_events", "SELECT id, date_diff('day', DATE '2024-01-20', ticket_open_date) AS d_day FROM r_events WHERE ticket_open_date BETWEEN DATE '2024-01-20' AND DATE '2024-01-27'"),
)
def opening_days(r: Roles):
    from ..operators.audits import opening_soon

    return opening_soon(r.events, AS_OF).select("id", "d_day")
