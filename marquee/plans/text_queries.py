"""Text, date, link and validation functions over whole columns of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import links as L
from ..functions import nested as K
from ..functions import text as T
from ..functions import validate as V
from ..operators import lookups as LK
from ..operators import merge_artists as MA
from ..session import spread
from .matching_queries import BAND_SQL, bands
from .registry import query
from .roles import AS_OF, Roles, with_roles

# --- normalisation over whole texts ------------------------------------------------------
ALL_TEXT_SQL = """texts AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages
  UNION ALL SELECT 'c' || conv_id || '.' || turn, text FROM conversations UNION ALL SELECT 'b' || item_id, text FROM benchmark)"""


def all_texts(r: Roles) -> DataFrame:
    text_id = lambda p, *c: F.concat(F.lit(p), F.concat_ws(".", *[F.col(x).cast("string") for x in c])).alias("id")
    return (
        r.table("documents").select(text_id("d", "doc_id"), "text")
        .unionByName(r.table("pages").select(text_id("p", "page_id"), F.col("html").alias("text")))
        .unionByName(r.table("conversations").select(text_id("c", "conv_id", "turn"), "text"))
        .unionByName(r.table("benchmark").select(text_id("b", "item_id"), "text"))
    )


@query(
    "text_keys",
    f"""WITH {ALL_TEXT_SQL} SELECT id, sha256(regexp_replace(lower(text), '[^a-z0-9가-힣]', '', 'g')) AS title_key,
          sha256(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))) AS name_key,
          sha256(regexp_replace(lower(text), '[\\s\\-_·•]', '', 'g')) AS link_text,
          sha256(regexp_replace(regexp_replace(lower(text), '\\s+', '', 'g'),
            '[!-/:-@\\[-`{{-~·…“”‘’–—「」『』【】、，。]', '', 'g')) AS unpunctuated,
          sha256(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]', '', 'g')) AS legacy_key
        FROM texts""",
)
def text_keys(r: Roles):
    digest = lambda c: F.sha2(c, 256)
    return all_texts(r).select(
        "id", digest(T.title_key("text")).alias("title_key"), digest(T.name_key("text")).alias("name_key"),
        digest(T.link_text("text")).alias("link_text"), digest(T.unpunctuated_title("text")).alias("unpunctuated"),
        digest(T.legacy_title_key("text")).alias("legacy_key"),
    )


@query(
    "text_scripts",
    f"""WITH {ALL_TEXT_SQL} SELECT id, regexp_matches(text, '[A-Za-z]') AS latin, regexp_matches(text, '[가-힣]') AS korean,
          len(list_filter(string_split_regex(regexp_replace(lower(text), '[()\\[\\]{{}}]', ' ', 'g'), '[\\s\\-·._/]+'), lambda x: x <> '')) AS n_tokens,
          regexp_matches(text, '(?i)https?://|www\\.') AS has_url,
          regexp_matches(text, '(?i)페스티벌|festival|fes([^a-z0-9_]|$)|fest([^a-z0-9_]|$)') AS festival
        FROM texts""",
)
def text_scripts(r: Roles):
    from ..functions import fixed_values as FV

    return all_texts(r).select(
        "id", T.is_latin("text").alias("latin"), T.is_korean("text").alias("korean"),
        F.size(T.name_tokens("text")).cast("long").alias("n_tokens"), F.col("text").rlike(FV.URL).alias("has_url"),
        T.is_festival_title("text").alias("festival"),
    )


TITLED_SQL = """titled AS (
  SELECT p_partkey AS id, CASE p_type WHEN 'PROMO' THEN '[' || p_brand || '] ' || p_name || ' - town' WHEN 'LARGE' THEN p_name || ' Festival - lineup ' || p_size || '차'
      WHEN 'SMALL' THEN '［vip］ ' || p_name WHEN 'MEDIUM' THEN p_name || ' Concert' ELSE p_name || ' - 2차 라인업' END AS title FROM part)"""


def titled(r: Roles) -> DataFrame:
    kind, name = F.col("p_type"), F.col("p_name")
    title = (
        F.when(kind == "PROMO", F.concat(F.lit("["), "p_brand", F.lit("] "), name, F.lit(" - town")))
        .when(kind == "LARGE", F.concat(name, F.lit(" Festival - lineup "), F.col("p_size").cast("string"), F.lit("차")))
        .when(kind == "SMALL", F.concat(F.lit("［vip］ "), name))
        .when(kind == "MEDIUM", F.concat(name, F.lit(" Concert"))).otherwise(F.concat(name, F.lit(" - 2차 라인업")))
    )
    return r.table("part").select(F.col("p_partkey").alias("id"), title.alias("title"))


@query(
    "title_forms",
    f"""WITH {TITLED_SQL}, n AS (SELECT id, title, replace(replace(title, '［', '['), '］', ']') AS t, lower(title) AS low FROM titled)
        SELECT id,
          regexp_replace(lower(regexp_replace(CASE WHEN regexp_matches(t, '^\\[') AND NOT contains(t, '[vip]') THEN regexp_replace(t, '^\\[[^\\]]*\\]\\s*', '') ELSE t END,
            '[ ]*-[ ]*[가-힣A-Za-z]{{1,6}}$', '')), '[^a-z0-9가-힣]', '', 'g') AS core_key,
          CASE WHEN contains(title, 'Festival') THEN 'festival' || CASE WHEN contains(title, 'widget') THEN 'widget' ELSE '' END
               WHEN contains(title, ' - 2차') AND contains(title, 'widget') THEN 'widget' END AS festival_key,
          CASE WHEN contains(title, ' - 2차') THEN split_part(title, ' - 2차', 1)
               WHEN contains(title, 'lineup ') AND length(split_part(title, ' - ', 1)) >= 0.3 * length(title) THEN split_part(title, ' - ', 1) ELSE title END AS display_title,
          CASE WHEN contains(title, ' Concert') THEN replace(low, ' concert', '') ELSE low END AS plain_title,
          contains(title, 'Festival') OR contains(title, '라인업') AS multi_artist
        FROM n""",
)
def title_forms(r: Roles):
    return titled(r).select(
        "id", T.core_title_key("title").alias("core_key"), T.festival_key("title").alias("festival_key"),
        T.display_title("title").alias("display_title"), T.plain_title("title").alias("plain_title"),
        T.is_multi_artist_title("title").alias("multi_artist"),
    )


@query(
    "structured_names",
    f"""WITH {BAND_SQL}, raw AS (SELECT id, CASE WHEN id % 3 = 0 THEN '밴드' || id || '(' || name || ')' WHEN id % 3 = 1 THEN name || ' 밴드' ELSE name END AS raw FROM bands)
        SELECT r.id, CASE WHEN r.id % 3 = 0 THEN '밴드' || r.id WHEN r.id % 3 = 1 THEN name ELSE raw END AS display_name,
          CASE WHEN r.id % 3 = 0 THEN name END AS name_en,
          CASE WHEN r.id % 3 = 0 THEN 2 WHEN r.id % 3 = 1 THEN 2 ELSE 0 END AS n_aliases
        FROM raw r JOIN bands b ON b.id = r.id""",
)
def structured_names(r: Roles):
    key = F.col("id")
    raw = (
        F.when(key % 3 == 0, F.concat(F.lit("밴드"), key.cast("string"), F.lit("("), "name", F.lit(")")))
        .when(key % 3 == 1, F.concat("name", F.lit(" 밴드"))).otherwise(F.col("name"))
    )
    rows = spread(bands(r)).select("id", T.structured_name(raw).alias("s"))
    return rows.select("id", "s.display_name", "s.name_en", F.size("s.aliases").alias("n_aliases"))


@query(
    "joined_records",
    """SELECT a.s_suppkey AS id, a.s_name || ';' || b.s_name AS parts FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1""",
)
def joined_records(r: Roles):
    acts = r.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("a"))
    both = acts.join(acts.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id")
    joint = F.when(F.col("id") % 2 == 0, F.lit(" X ")).otherwise(F.lit(" feat. "))
    return MA.joined_records(both.select("id", F.concat("a", joint, "b").alias("name"))).select("id", F.array_join("parts", ";").alias("parts"))


@query(
    "decided_names",
    """SELECT p_partkey AS id, CASE WHEN p_type = 'SMALL' THEN 'keep' WHEN p_type = 'LARGE' THEN 'auto' ELSE 'propose' END AS decision,
         CASE WHEN p_type = 'LARGE' THEN split_part(p_name, ' ', 2) ELSE p_name END AS name,
         CASE WHEN p_type NOT IN ('SMALL', 'LARGE') THEN 'The ' || p_name END AS name_proposal FROM part""",
)
def decided_names(r: Roles):
    kind = F.col("p_type")
    artists = r.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    proposed = (
        F.when(kind == "SMALL", F.upper("p_name")).when(kind == "LARGE", F.split_part("p_name", F.lit(" "), F.lit(2)))
        .otherwise(F.concat(F.lit("The "), "p_name"))
    )
    proposals = r.table("part").select(F.col("p_partkey").alias("id"), proposed.alias("proposed_name"), F.lit(True).alias("is_music"))
    return MA.decided_names(artists, proposals).select("id", "decision", "name", "name_proposal")


@query(
    "venue_names",
    """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN lower(o_orderpriority) WHEN 'P' THEN 'hall ' || lower(o_orderpriority) END AS plain_name,
         CASE o_orderstatus WHEN 'F' THEN regexp_replace(lower(o_orderpriority), '[^a-z0-9]', '', 'g') WHEN 'P' THEN 'hall' || regexp_replace(lower(o_orderpriority), '[^a-z0-9]', '', 'g')
           ELSE strftime(o_orderdate, '%Y%m%d') || '원' END AS venue_key FROM orders""",
)
def venue_names(r: Roles):
    status, day = F.col("o_orderstatus"), F.date_format("o_orderdate", "yyyy.MM.dd")
    raw = (
        F.when(status == "F", F.concat("o_orderpriority", F.lit("  티켓 가격: 110,000원")))
        .when(status == "P", F.concat(F.lit("Hall  "), "o_orderpriority")).otherwise(F.concat(day, F.lit("원")))
    )
    name = F.when(status == "F", F.col("o_orderpriority")).otherwise(raw)
    return r.table("orders").select(
        F.col("o_orderkey").alias("id"), T.plain_venue_name(raw).alias("plain_name"), T.venue_key(name).alias("venue_key")
    )


# --- dates -------------------------------------------------------------------------------
@query(
    "parsed_dates",
    """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS start_date,
         CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 2 END AS range_end,
         CAST(o_orderdate AS DATE) + CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END AS period_end,
         CASE WHEN o_orderstatus = 'O' THEN o_orderdate - INTERVAL 9 HOUR + INTERVAL 1 HOUR * 20 ELSE o_orderdate - INTERVAL 9 HOUR END AS opens
       FROM orders""",
)
def parsed_dates(r: Roles):
    """Order dates written the way four sites write them, and read back."""
    status, day = F.col("o_orderstatus"), F.col("o_orderdate").cast("date")
    dotted = F.date_format(day, "yyyy.MM.dd")
    text = (
        F.when(status == "F", F.concat(dotted, F.lit(" ~ "), F.date_format(F.date_add(day, 2), "yyyy.MM.dd")))
        .when(status == "P", F.date_format(day, "yyyy년 M월 d일")).otherwise(F.concat(dotted, F.lit(" 20:00")))
    )
    as_of = D.at(AS_OF)
    rows = spread(r.table("orders")).select(F.col("o_orderkey").alias("id"), text.alias("t"))
    legacy = D.parse_date_range("t", as_of)
    period = D.parse_period("t", "festivallife", as_of)
    return rows.select(
        "id", D.parse_date("t").alias("start_date"), legacy["end_date"].alias("range_end"),
        period["end_date"].alias("period_end"), D.parse_ticket_opening("t").cast("timestamp_ntz").alias("opens"),
    )


@query(
    "event_clock",
    with_roles(
        "r_events",
        """SELECT id, status, date_diff('day', start_date, end_date) + 1 AS n_days, end_date AS last_day,
             CAST(CASE WHEN status = 'ended' THEN 0 WHEN d < 0 THEN 70 WHEN d <= 14 THEN 100 WHEN d <= 30 THEN 80 WHEN d <= 60 THEN 60
               WHEN d <= 120 THEN 40 ELSE 20 END AS DOUBLE) AS freshness,
             CASE WHEN end_date < DATE '2024-01-20' THEN 'ended' WHEN start_date <= DATE '2024-01-20' THEN 'on_sale' ELSE 'upcoming' END AS legacy_status,
             CAST(CASE WHEN d < 0 THEN 0.7 WHEN d <= 14 THEN 1 WHEN d <= 30 THEN 0.8 ELSE 0.65 END AS DOUBLE) AS freshness_norm
           FROM (SELECT *, date_diff('day', DATE '2024-01-20', start_date) AS d FROM r_events)""",
    ),
)
def event_clock(r: Roles):
    start, end, now = F.col("start_date"), F.col("end_date"), D.at(AS_OF)
    days = D.day_options(start, end)
    return r.events.select(
        "id", "status", F.size(days).cast("long").alias("n_days"), F.element_at(days, -1)["date"].alias("last_day"),
        D.freshness_score(F.col("status"), start, now).alias("freshness"),
        D.legacy_status(start, end, F.lit(AS_OF[:10]).cast("date")).alias("legacy_status"),
        D.freshness_norm(start, now).alias("freshness_norm"),
    )


@query(
    "kst_times",
    """SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y.%m.%d %H:%M') AS kst, CAST(ts + INTERVAL 9 HOUR AS DATE) AS kst_day,
         hour(ts) * 60 + minute(ts) AS minutes FROM events""",
)
def kst_times(r: Roles):
    clock = F.date_format("ts", "HH.mm")
    return r.table("events").select(
        "event_id", D.format_kst("ts").alias("kst"), D.kst_day("ts").alias("kst_day"), D.clock_minutes(D.clock(clock)).cast("long").alias("minutes")
    )


# --- links -------------------------------------------------------------------------------
LINKS_SQL = """urls AS (SELECT p_partkey AS id, CASE p_type WHEN 'PROMO' THEN 'https://ticket.yes24.com/' || p_partkey WHEN 'LARGE' THEN 'http://tickets.interpark.com/goods/' || (24000000 + p_partkey)
    WHEN 'SMALL' THEN 'https://ticket.melon.com/p?i=' || p_partkey ELSE 'https://blog.example.com/' || p_partkey END AS url FROM part)"""


def shop_urls(r: Roles) -> DataFrame:
    key, kind = F.col("p_partkey").cast("string"), F.col("p_type")
    url = (
        F.when(kind == "PROMO", F.concat(F.lit("https://ticket.yes24.com/"), key))
        .when(kind == "LARGE", F.concat(F.lit("http://tickets.interpark.com/goods/"), (24000000 + F.col("p_partkey")).cast("string")))
        .when(kind == "SMALL", F.concat(F.lit("https://ticket.melon.com/p?i="), key))
        .otherwise(F.concat(F.lit("https://blog.example.com/"), key))
    )
    text = F.to_json(F.array(F.lit("https://ticket.melon.com/home"), url))
    return r.table("part").select(F.col("p_partkey").alias("id"), url.alias("url"), text.alias("json"))


@query(
    "booking_links",
    f"""WITH {LINKS_SQL}, t AS (SELECT *, contains(url, 'yes24') AS y, contains(url, 'interpark') AS i FROM urls)
        SELECT id, CASE WHEN y OR i THEN 2 ELSE 1 END AS n_links, CASE WHEN i THEN 'interpark' WHEN y THEN 'yes24' ELSE 'melon' END AS first_provider,
          'melon' AS ticket_provider, CASE WHEN y OR i THEN url ELSE 'https://ticket.melon.com/home' END AS elected,
          replace(url, 'http://', 'https://') AS https_url,
          CASE WHEN i THEN 'https://ticketimage.interpark.com/Play/image/large/24/' || split_part(url, '/', 5) || '_p.gif' END AS poster
        FROM t""",
)
def booking_links(r: Roles):
    urls = L.source_urls_from_json("json")
    links = L.booking_links(urls)
    return shop_urls(r).select(
        "id", F.size(links).cast("long").alias("n_links"), F.get(links, F.lit(0))["provider"].alias("first_provider"),
        L.ticket_provider(L.url_texts(urls)).alias("ticket_provider"), L.elected_vendor_url(urls).alias("elected"),
        L.https_image("url").alias("https_url"), L.poster_from_goods(L.url_texts(urls)).alias("poster"),
    )


@query(
    "device_labels",
    """SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'iPhone 17 Pro (iPhone18,1)' WHEN 1 THEN 'iPhone99,' || user_id ELSE 'Pixel ' || user_id END AS label,
         CASE WHEN user_id % 2 = 0 THEN 'user' || user_id ELSE event_type END AS display_name FROM events""",
)
def device_labels(r: Roles):
    user = F.col("user_id")
    text = user.cast("string")
    raw = F.when(user % 3 == 0, "iPhone18,1").when(user % 3 == 1, F.concat(F.lit("iPhone99,"), text)).otherwise(F.concat(F.lit("Pixel "), text))
    profile = F.when(user % 2 == 1, F.col("event_type"))
    return r.table("events").select(
        "event_id", L.device_label(raw).alias("label"),
        L.display_name(profile, F.concat(F.lit("user"), text, F.lit("@example.com"))).alias("display_name"),
    )


@query(
    "trusted_sources",
    """SELECT doc_id, CASE source WHEN 'src0' THEN 70 WHEN 'src1' THEN 55 WHEN 'src2' THEN 0 ELSE 50 END AS trust FROM documents""",
)
def trusted_sources(r: Roles):
    s = F.col("source")
    named = F.when(s == "src0", "yes24").when(s == "src1", "festivallife").when(s == "src2", "").otherwise(s)
    return r.table("documents").select("doc_id", L.source_trust(named).alias("trust"))


@query(
    "page_plain_text",
    """SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'),
         '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' ', 'g'), '\\s+', ' ', 'g'))) AS text_hash FROM pages""",
)
def page_plain_text(r: Roles):
    return r.table("pages").select("page_id", F.sha2(L.html_text("html"), 256).alias("text_hash"))


# --- JSON and arrays ---------------------------------------------------------------------
@query(
    "payload_names",
    """SELECT l_orderkey, l_linenumber, l_partkey, s_name || ';' || l_returnflag AS names FROM lineitem JOIN supplier ON s_suppkey = l_suppkey""",
)
def payload_names(r: Roles):
    """Crawled name lists with white space, repeats, empty names and things that are no names."""
    acts = r.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    text = F.concat(
        F.lit('{"artists":[" '), "s_name", F.lit('","'), "s_name", F.lit('","",'), F.col("l_linenumber").cast("string"),
        F.lit(',{"a":1},"'), "l_returnflag", F.lit('"]}'),
    )
    rows = spread(r.table("lineitem")).join(acts, "l_suppkey")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(K.candidate_names(text), ";").alias("names"))


@query(
    "merged_sources",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = l_linestatus THEN 1 ELSE 2 END AS n_sites, l_returnflag AS last_site FROM lineitem""",
)
def merged_sources(r: Roles):
    link = lambda c: F.struct(F.col(c).alias("site"), F.lit("u").alias("url"))
    old = F.create_map(F.lit("title"), F.struct(F.lit("old").alias("source"), D.at(AS_OF).alias("at")))
    stamp = K.stamp_sources(old, F.array(F.lit("title")), F.col("l_returnflag"), D.at(AS_OF))
    sites = K.distinct_sites(F.array(link("l_returnflag"), link("l_linestatus"), link("l_returnflag")))
    return r.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.size(sites).alias("n_sites"), stamp["title"]["source"].alias("last_site")
    )


@query(
    "child_lists",
    """SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN '' ELSE c_mktsegment END AS albums FROM customer""",
)
def child_lists(r: Roles):
    key = F.col("c_custkey")
    new = F.when(key % 3 == 1, F.array().cast("array<string>")).when(key % 3 == 2, F.array("c_mktsegment"))
    return r.table("customer").select(key.alias("id"), F.array_join(K.replaced_children(F.array(F.lit("a")), new), ";").alias("albums"))


# --- validation --------------------------------------------------------------------------
@query(
    "event_rules",
    """SELECT doc_id, array_to_string(list_filter([CASE WHEN length(text) < 2 THEN 'title: too short' END, CASE WHEN length(text) > 300 THEN 'title: too long' END,
         CASE WHEN regexp_matches(text, '(?i)https?://|www\\.') THEN 'title: has a URL' END, CASE WHEN trim(text) = '' THEN 'title: blank' END,
         CASE WHEN lang NOT IN ('en', 'fr') THEN 'status: unknown' END], lambda x: x IS NOT NULL), ';') AS errors FROM documents""",
)
def event_rules(r: Roles):
    status = F.when(F.col("lang").isin("en", "fr"), "upcoming").otherwise(F.col("lang"))
    none = F.lit(None).cast("string")
    errors = V.event_errors(F.col("text"), none, none, status, F.lit("k"), F.col("source"))
    return r.table("documents").select("doc_id", F.array_join(errors, ";").alias("errors"))


@query(
    "artist_rules",
    """SELECT item_id, array_to_string(list_filter([CASE WHEN length(text) > 100 THEN 'name: too long' END, CASE WHEN regexp_matches(text, '(?i)https?://|www\\.') THEN 'name: has a URL' END,
         CASE WHEN contains(text, '/') THEN 'name: has a slash' END], lambda x: x IS NOT NULL), ';') AS errors,
         CASE WHEN length(text) > 100 THEN 'name: too long' ELSE '' END AS legacy_errors FROM benchmark""",
)
def artist_rules(r: Roles):
    none = F.lit(None).cast("string")
    return r.table("benchmark").select(
        "item_id", F.array_join(V.artist_errors(F.col("text"), none), ";").alias("errors"),
        F.array_join(V.legacy_artist_errors(F.col("text"), none), ";").alias("legacy_errors"),
    )


@query(
    "venue_rules",
    """SELECT page_id, CASE WHEN length(url) > 200 THEN 'name: too long;' ELSE '' END || 'name: has a URL' AS errors,
         CASE WHEN length(url) > 200 THEN 'name: too long' ELSE 'name: has a URL' END AS legacy_errors FROM pages""",
)
def venue_rules(r: Roles):
    none = F.lit(None).cast("string")
    return r.table("pages").select(
        "page_id", F.array_join(V.venue_errors(F.col("url"), none), ";").alias("errors"),
        F.array_join(V.legacy_venue_errors(F.col("url"), none), ";").alias("legacy_errors"),
    )


@query(
    "non_concerts",
    with_roles(
        "r_events",
        f"""SELECT id, drop FROM (SELECT e.id, CASE WHEN contains(lower(t.title), 'concert') OR contains(lower(t.title), 'festival') THEN FALSE
             ELSE contains(e.title, 'anvil') END AS drop FROM r_events e JOIN titled t ON t.id = e.id)""",
        TITLED_SQL,
    ),
)
def non_concerts(r: Roles):
    """Titles with anvils exhibited are no concerts, unless they say so."""
    rows = r.events.drop("title").join(titled(r), "id")
    shown = F.regexp_replace("title", "anvil", "anvil exhibition")
    return rows.select("id", LK.is_non_concert(shown, F.col("start_date"), F.col("end_date")).alias("drop"))
