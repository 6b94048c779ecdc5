"""Similarity joins, duplicate detection and merging over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cluster as C
from ..operators import lookups as LK
from ..operators import merge_artists as MA
from ..operators import merge_events as ME
from ..operators import merge_venues as MV
from ..operators import similarity as S
from ..session import cut_lineage
from .registry import query
from .roles import Roles, with_roles

# --- names and titles of every table -----------------------------------------------------
_NAMED = [
    ("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"),
    ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"), ("part", "p_partkey", "p_brand"),
    ("part", "p_partkey", "p_type"),
]
NAMES_SQL = "names AS (" + " UNION ALL ".join(f"SELECT {k} AS id, {n} AS name FROM {t}" for t, k, n in _NAMED) + ")"
PAGE_TITLE = r"(?s)<title>(.*?)</title>"
TITLES_SQL = """titles AS (
  SELECT page_id AS id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages
  UNION ALL SELECT page_id, url FROM pages UNION ALL SELECT p_partkey, p_name FROM part)"""


def names(r: Roles) -> DataFrame:
    parts = [r.table(t).select(F.col(k).cast("long").alias("id"), F.col(n).alias("name")) for t, k, n in _NAMED]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def titles(r: Roles) -> DataFrame:
    pages = r.table("pages")
    return (
        pages.select(F.col("page_id").alias("id"), F.regexp_extract("html", PAGE_TITLE, 1).alias("title"))
        .unionByName(pages.select(F.col("page_id").alias("id"), F.col("url").alias("title")))
        .unionByName(r.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")))
    )


_KEY = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"


@query(
    "contains_pairs",
    f"""WITH {NAMES_SQL}, k AS (SELECT DISTINCT {_KEY.format('name')} AS s FROM names)
        SELECT a.s AS short, b.s AS long, length(a.s) / length(b.s) AS ratio FROM k a JOIN k b
          ON length(a.s) >= 2 AND length(a.s) < length(b.s) AND contains(b.s, a.s) AND length(a.s) / length(b.s) >= 0.4""",
)
def contains_pairs(r: Roles):
    keys = names(r).select(T.name_key("name").alias("k")).distinct()
    return S.containment_pairs(keys, "k", 0.4)


@query(
    "token_pairs",
    f"""WITH {NAMES_SQL}, {TITLES_SQL}, v AS (SELECT DISTINCT n FROM (SELECT name AS n FROM names UNION ALL SELECT title FROM titles)),
        t AS (SELECT n, length(n) AS len, list_distinct(list_filter(
          string_split_regex(regexp_replace(lower(n), '[()\\[\\]{{}}]', ' ', 'g'), '[\\s\\-·._/]+'), lambda x: x <> '')) AS tok
          FROM v WHERE regexp_matches(n, '[A-Za-z]')),
        p AS (SELECT a.n AS name_a, b.n AS name_b, len(list_intersect(a.tok, b.tok)) AS both_, len(a.tok) AS la, len(b.tok) AS lb
          FROM t a JOIN t b ON a.n < b.n AND abs(a.len - b.len) <= 2)
        SELECT name_a, name_b, both_ / (la + lb - both_) AS similarity FROM p WHERE both_ / (la + lb - both_) >= 0.5""",
)
def token_pairs(r: Roles):
    both = names(r).select("name").unionByName(titles(r).select(F.col("title").alias("name"))).distinct()
    sets = both.select("name", T.name_tokens("name").alias("tokens"), S.script_class(F.col("name")).alias("script"))
    return S.jaccard_pairs(sets, "name", "tokens", 0.5, script="script")


@query(
    "edit_pairs",
    f"""WITH {TITLES_SQL}, k AS (SELECT DISTINCT regexp_replace(regexp_replace(lower(title), '\\s+', '', 'g'),
          '[!-/:-@\\[-`{{-~·…“”‘’–—「」『』【】、，。]', '', 'g') AS s FROM titles)
        SELECT a.s AS a, b.s AS b, 1 - levenshtein(a.s, b.s) / greatest(length(a.s), length(b.s)) AS ratio
        FROM k a JOIN k b ON a.s < b.s AND substr(a.s, 1, 4) = substr(b.s, 1, 4)
        WHERE 1 - levenshtein(a.s, b.s) / greatest(length(a.s), length(b.s)) >= 0.88""",
)
def edit_pairs(r: Roles):
    keys = titles(r).select(T.unpunctuated_title("title").alias("k")).distinct()
    return S.edit_pairs(keys, "k")


@query(
    "gram_leaders",
    f"""WITH {TITLES_SQL}, k AS (SELECT DISTINCT regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS k FROM titles),
        g AS (SELECT DISTINCT k, substr(k, i, 6) AS gram FROM (SELECT k, unnest(range(1, length(k) - 4)) AS i FROM k WHERE length(k) >= 6)),
        m AS (SELECT gram, min(k) AS leader FROM g GROUP BY 1)
        SELECT k, min(leader) AS leader FROM g JOIN m USING (gram) GROUP BY 1""",
)
def gram_leaders(r: Roles):
    return S.gram_leaders(titles(r).select(T.title_key("title").alias("k")), "k", 6)


@query(
    "overlap_losers",
    with_roles(
        "r_events",
        """SELECT e.id FROM r_events e WHERE EXISTS (SELECT 1 FROM r_events x WHERE x.title = e.title AND x.id <> e.id
             AND (x.venue_id = e.venue_id OR (x.start_date <= e.end_date AND e.start_date <= x.end_date))
             AND (x.has_timetable > e.has_timetable OR (x.has_timetable = e.has_timetable AND x.id < e.id)))""",
    ),
)
def overlap_losers(r: Roles):
    return S.overlap_losers(
        r.events, ["title"], "venue_id", "start_date", "end_date", F.col("has_timetable").cast("int"), "id"
    ).select("id")


# --- artists in titles -------------------------------------------------------------------
ACTS_SQL = """acts AS (SELECT DISTINCT 'type' || p_type AS id, p_type AS name FROM part
    UNION SELECT DISTINCT 'lang' || lang, lang FROM documents
    UNION SELECT 'mail' || n_nationkey, 'example.' || ['com', 'net', 'org'][1 + n_nationkey % 3] FROM nation),
  shows AS (SELECT 'p' || p_partkey AS id, p_name AS title FROM part UNION ALL SELECT 'u' || page_id, url FROM pages)"""


def named_acts(r: Roles) -> DataFrame:
    kinds = r.table("part").select(F.concat(F.lit("type"), "p_type").alias("id"), F.col("p_type").alias("name"))
    langs = r.table("documents").select(F.concat(F.lit("lang"), "lang").alias("id"), F.col("lang").alias("name"))
    tld = F.get(F.array(F.lit("com"), F.lit("net"), F.lit("org")), F.col("n_nationkey") % 3)
    hosts = r.table("nation").select(
        F.concat(F.lit("mail"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("example."), tld).alias("name")
    )
    return kinds.unionByName(langs).unionByName(hosts).distinct()


def shown_titles(r: Roles) -> DataFrame:
    parts = r.table("part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"))
    return parts.unionByName(r.table("pages").select(F.concat(F.lit("u"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("title")))


NAMED_SQL = ACTS_SQL + """,
  a AS (SELECT *, regexp_replace(lower(name), '[\\s\\-_·•]', '', 'g') AS norm FROM acts),
  u AS (SELECT norm, first(id ORDER BY length(name) DESC, name, id) AS id, first(name ORDER BY length(name) DESC, name, id) AS name
    FROM a WHERE length(norm) >= 2 GROUP BY 1),
  s AS (SELECT *, regexp_replace(lower(title), '[\\s\\-_·•]', '', 'g') AS norm FROM shows),
  hit AS (SELECT s.id AS event_id, u.id AS artist_id, u.name AS artist_name FROM s JOIN u ON
    CASE WHEN length(u.norm) > 3 THEN contains(s.norm, u.norm)
    ELSE regexp_matches(lower(s.title), '(^|[^a-z가-힣])' || lower(u.name) || '([^a-z가-힣]|$)') END),
  named AS (SELECT event_id, first(artist_id ORDER BY length(artist_name) DESC, artist_name, artist_id) AS artist_id,
    first(artist_name ORDER BY length(artist_name) DESC, artist_name, artist_id) AS artist_name FROM hit GROUP BY 1)"""


@query("titles_naming_artists", f"WITH {NAMED_SQL} SELECT * FROM named")
def titles_naming_artists(r: Roles):
    return LK.titles_naming_artists(shown_titles(r), named_acts(r))


@query(
    "event_link_status",
    f"""WITH {NAMED_SQL}, m AS (SELECT id, regexp_matches(title, '(?i)festival|fest[''’\\s]|line[\\s-]?up|pre[\\s-]?sale|premium\\s?pass|conference|expo') AS multi FROM shows)
        SELECT id, CASE WHEN multi THEN 'multi_artist' WHEN artist_id IS NOT NULL THEN 'linked' ELSE 'no_artist' END AS artist_link_status,
          CASE WHEN NOT multi THEN artist_id END AS artist_id FROM m LEFT JOIN named ON event_id = id""",
)
def event_link_status(r: Roles):
    shows = shown_titles(r).withColumn("artist_id", F.lit(None).cast("string"))
    return LK.link_status(shows, named_acts(r))


# --- events ------------------------------------------------------------------------------
CATALOG_SQL = """catalog AS (
  SELECT e.id, e.title, l.artist_id, e.venue_id, e.start_date AS day, e.genre,
    CASE WHEN e.id % 2 = 0 THEN 'https://img/' || e.id END AS poster_url,
    TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (e.id * 7 % 1000) AS created_at,
    1 + CASE WHEN e.id % 2 = 0 THEN 1 ELSE 0 END + 1 + 1 AS info
  FROM r_events e LEFT JOIN (SELECT event_id, min(artist_id) AS artist_id FROM r_event_artists GROUP BY 1) l ON l.event_id = e.id)"""
_RANK = "artist_id IS NULL, -info, -length(title), created_at, id"


def catalog(r: Roles) -> DataFrame:
    """Parts as stored catalogue events: some with a poster, led by their first act, one site each."""
    led = r.event_artists.groupBy(F.col("event_id").alias("id")).agg(F.min("artist_id").alias("artist_id"))
    key = F.col("id")
    none = lambda t="string": F.lit(None).cast(t)
    created = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(key * 7 % 1000).cast("int"))
    site = F.lower("genre")
    return r.events.join(led, "id", "left").select(
        "id", "title", none().alias("normalized_title"), none().alias("dedup_key"), "artist_id", "venue_id",
        F.when(key % 2 == 0, F.concat(F.lit("https://img/"), key.cast("string"))).alias("poster_url"), "genre",
        none().alias("age_restriction"), none("timestamp").alias("ticket_open_date"), none("timestamp").alias("ticket_close_date"),
        none().alias("ticket_provider"), none().alias("notice_text"), none().alias("booking_url"), none().alias("organizer"),
        none().alias("duration"), F.col("start_date").cast("timestamp").alias("start_date"),
        F.col("end_date").cast("timestamp").alias("end_date"), created.alias("created_at"), F.lit(False).alias("is_hidden"),
        none("bigint").alias("merged_into_event_id"),
        F.array(F.struct(site.alias("site"), F.concat(F.lit("https://"), site, F.lit("/"), key.cast("string")).alias("url"))).alias("source_urls"),
    )


def venues_of(r: Roles) -> DataFrame:
    return r.table("part").select(F.col("p_brand").alias("id"), F.lower("p_brand").alias("normalized_name")).distinct()


def _survivors_sql(key: str, where: str) -> str:
    return f"""SELECT id AS old_id, keep_id FROM (SELECT id, first_value(id) OVER (PARTITION BY {key} ORDER BY {_RANK}) AS keep_id
      FROM catalog WHERE {where}) WHERE id <> keep_id"""


@query(
    "artist_day_duplicates",
    with_roles("r_events r_event_artists", _survivors_sql("artist_id, day", "artist_id IS NOT NULL"), CATALOG_SQL),
)
def artist_day_duplicates(r: Roles):
    return ME.artist_day_pass(ME.match_columns(catalog(r))).select("old_id", "keep_id")


@query("title_day_duplicates", with_roles("r_events r_event_artists", _survivors_sql("title, day", "length(title) >= 4"), CATALOG_SQL))
def title_day_duplicates(r: Roles):
    return ME.title_day_pass(ME.match_columns(catalog(r))).select("old_id", "keep_id")


@query(
    "strong_key_duplicates",
    with_roles("r_events r_event_artists", _survivors_sql("title, venue_id, day", "TRUE"), CATALOG_SQL),
)
def strong_key_duplicates(r: Roles):
    mapping, _ = ME.strong_key_mapping(catalog(r), venues_of(r))
    return mapping.select("old_id", "keep_id")


@query("event_merge_mapping")
def event_merge_mapping(r: Roles):
    merged = ME.auto_merge(catalog(r), venues_of(r))
    return merged.mapping


@query(
    "manual_merges",
    with_roles(
        "r_events r_event_artists",
        """SELECT k.id, coalesce(k.poster_url, m.poster_url) AS poster_url, coalesce(k.artist_id, m.artist_id) AS artist_id,
             1 + CASE WHEN m.id IS NULL THEN 0 ELSE 1 END AS n_links
           FROM catalog k LEFT JOIN catalog m ON m.id = k.id + 1 AND k.id % 5 = 1 WHERE k.id % 5 <> 2""",
        CATALOG_SQL,
    ),
)
def manual_merges(r: Roles):
    """Chosen pairs: every fifth event takes in the next one."""
    events = cut_lineage(catalog(r))
    ids = events.select("id")
    pairs = ids.filter("id % 5 = 1").select(F.col("id").alias("keep_id"), (F.col("id") + 1).alias("merge_id")).join(
        ids.withColumnRenamed("id", "merge_id"), "merge_id", "left_semi")
    return ME.merge_pair(events, pairs).events.select("id", "poster_url", "artist_id", F.size("source_urls").cast("long").alias("n_links"))


@query(
    "soft_merged_events",
    """SELECT p_partkey AS old_id, CASE p_partkey % 10 WHEN 4 THEN p_partkey - 2 ELSE p_partkey - 1 END AS keep_id
       FROM part WHERE p_partkey % 10 IN (3, 4, 9)""",
)
def soft_merged_events(r: Roles):
    """Soft merges of an event into the one before, a chain of two and some whose survivor is no longer there."""
    key = F.col("id")
    into = F.when((key % 10).isin(3, 4, 9), key - 1).when(key % 10 == 6, -key)
    left, mapping = ME.drop_soft_merged(catalog(r).withColumn("merged_into_event_id", into))
    return mapping.join(left.select(F.col("id").alias("keep_id")), "keep_id", "left_semi").select("old_id", "keep_id")


@query(
    "relinked_lineups",
    with_roles(
        "r_event_artists",
        """, last AS (SELECT max(s_suppkey) AS last FROM supplier),
             old AS (SELECT event_id, artist_id, event_id % 2 = 1 AND artist_id < last AS joint FROM r_event_artists, last),
             fresh AS (SELECT event_id, artist_id + k AS artist_id, min(k + 1) AS display_order FROM old, (VALUES (0), (1)) v(k) WHERE joint GROUP BY 1, 2)
           SELECT event_id, CAST(artist_id AS VARCHAR) AS artist_id, 'primary' AS role, artist_id AS display_order FROM old WHERE NOT joint
           UNION ALL SELECT event_id, CAST(artist_id AS VARCHAR), CASE display_order WHEN 1 THEN 'main' ELSE 'lineup' END, display_order FROM fresh
             WHERE (event_id, artist_id) NOT IN (SELECT (event_id, artist_id) FROM old WHERE NOT joint)""",
    ),
)
def relinked_lineups(r: Roles):
    """Half of the events were crawled with records that hold an act and its neighbour."""
    acts = r.table("supplier").select(F.col("s_suppkey").alias("n"), F.col("s_name").alias("name"))
    both = acts.join(acts.select((F.col("n") - 1).alias("n"), F.col("name").alias("other")), "n")
    pair = both.select(F.concat(F.lit("j"), F.col("n").cast("string")).alias("id"), F.concat("name", F.lit(" & "), "other").alias("name"))
    none = lambda t="string": F.lit(None).cast(t)
    artists = acts.select(F.col("n").cast("string").alias("id"), "name").unionByName(pair).select(
        "id", "name", T.name_key("name").alias("normalized_name"), none().alias("name_en"), F.lit(0).alias("followers_count"),
        F.lit(0).alias("upcoming_event_count"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    edges = r.event_artists.join(pair.select(F.substring("id", 2, 20).cast("long").alias("artist_id"), F.col("id").alias("joint")), "artist_id", "left")
    edges = cut_lineage(edges.select(
        "event_id", F.when(F.col("event_id") % 2 == 1, F.coalesce("joint", F.col("artist_id").cast("string"))).otherwise(
            F.col("artist_id").cast("string")).alias("artist_id"),
        "artist_name", F.lit("primary").alias("role"), F.col("display_order").cast("long").alias("display_order")))
    aliases = artists.limit(0).select(F.col("id").alias("artist_id"), F.col("name").alias("alias"), none().alias("source"))
    heads = edges.select("event_id", "artist_id")
    return LK.split_joined(artists, aliases, edges, heads, heads).edges.select("event_id", "artist_id", "role", "display_order")


@query(
    "absorbed_events",
    with_roles(
        "r_events r_event_artists",
        f"""SELECT keep_id AS id, count(*) AS n_links, min(created_at) AS created_at, max(artist_id) FILTER (id = keep_id) AS artist_id,
              coalesce(any_value(poster_url) FILTER (id = keep_id),
                first(poster_url ORDER BY id) FILTER (id <> keep_id AND poster_url IS NOT NULL)) AS poster_url
            FROM (SELECT *, first_value(id) OVER (PARTITION BY title, day ORDER BY {_RANK}) AS keep_id FROM catalog) GROUP BY 1""",
        CATALOG_SQL,
    ),
)
def absorbed_events(r: Roles):
    events = catalog(r)
    mapping = ME.title_day_pass(ME.match_columns(events))
    kept = ME.absorb(events, mapping).events
    return kept.select("id", F.size("source_urls").cast("long").alias("n_links"), F.col("created_at").cast("timestamp_ntz").alias("created_at"),
                       "artist_id", "poster_url")


@query(
    "repointed_interest",
    with_roles(
        "r_events r_event_artists r_interested",
        f"""SELECT DISTINCT user_id, coalesce(keep_id, event_id) AS event_id FROM r_interested
            LEFT JOIN (SELECT id, first_value(id) OVER (PARTITION BY title, day ORDER BY {_RANK}) AS keep_id FROM catalog) m ON m.id = event_id""",
        CATALOG_SQL,
    ),
)
def repointed_interest(r: Roles):
    mapping = ME.title_day_pass(ME.match_columns(catalog(r)))
    return ME.repoint(r.interested, mapping, "event_id", ["user_id", "event_id"])


@query(
    "event_review_groups",
    with_roles(
        "r_events r_event_artists",
        """SELECT regexp_replace(title, '[^a-z0-9]', '', 'g') AS title_key, id, 'same_title_diff_day' AS reason,
             CASE WHEN min(day) OVER w = max(day) OVER w THEN 0.97e0 ELSE 0.85e0 END AS similarity,
             first_value(id) OVER (PARTITION BY title ORDER BY artist_id IS NULL, -info, created_at, id) AS suggested_keep_id
           FROM catalog WINDOW w AS (PARTITION BY title) QUALIFY count(*) OVER w > 1""",
        CATALOG_SQL,
    ),
)
def event_review_groups(r: Roles):
    return ME.review_groups(catalog(r))


@query(
    "event_review_contained",
    with_roles(
        "r_events r_event_artists",
        """, c AS (SELECT DISTINCT artist_id, venue_id, regexp_replace(lower(CASE WHEN genre = 'PROMO' THEN title || ' ' || genre ELSE title END), '[^a-z0-9]', '', 'g') AS k
             FROM catalog WHERE artist_id IS NOT NULL)
           SELECT a.artist_id, a.k AS short, b.k AS long, a.venue_id AS short_venue, b.venue_id AS long_venue, 'same_artist_similar' AS reason, 0.75e0 AS similarity
           FROM c a JOIN c b ON a.artist_id = b.artist_id AND a.venue_id = b.venue_id AND length(a.k) >= 7 AND length(a.k) < length(b.k) AND contains(b.k, a.k)""",
        CATALOG_SQL,
    ),
)
def event_review_contained(r: Roles):
    longer = F.when(F.col("genre") == "PROMO", F.concat("title", F.lit(" "), "genre")).otherwise(F.col("title"))
    return ME.review_contained(catalog(r).withColumn("title", longer))


@query(
    "exact_title_venue_losers",
    with_roles(
        "r_events r_event_artists",
        """SELECT id AS old_id, keep_id FROM (SELECT id, first_value(id) OVER (PARTITION BY title, venue_id
             ORDER BY poster_url IS NULL, artist_id IS NULL, id) AS keep_id FROM catalog) WHERE id <> keep_id""",
        CATALOG_SQL,
    ),
)
def exact_title_venue_losers(r: Roles):
    return ME.exact_title_venue_losers(catalog(r))


@query(
    "same_title_day_losers",
    with_roles(
        "r_events r_event_artists",
        """SELECT id AS old_id, keep_id FROM (SELECT id, first_value(id) OVER (PARTITION BY title, day
             ORDER BY artist_id IS NULL, created_at, id) AS keep_id FROM catalog) WHERE id <> keep_id""",
        CATALOG_SQL,
    ),
)
def same_title_day_losers(r: Roles):
    return ME.same_title_day_mapping(catalog(r)).select("old_id", "keep_id")


@query(
    "event_keys",
    with_roles(
        "r_events",
        """SELECT id, regexp_replace(title, '[^a-z0-9]', '', 'g') AS title_key,
             substr(sha256(regexp_replace(title, '[^a-z0-9]', '', 'g') || '|' || lower(venue_id) || '|' || strftime(start_date, '%Y-%m-%d')), 1, 32) AS event_key,
             substr(sha256(regexp_replace(title, '[^a-z0-9_]', '', 'g') || '|' || regexp_replace(lower(venue_id), '[^a-z0-9_]', '', 'g')
               || '|' || strftime(start_date, '%Y%m%d')), 1, 32) AS legacy_key
           FROM r_events""",
    ),
)
def event_keys(r: Roles):
    return r.events.select(
        "id", T.title_key("title").alias("title_key"), T.event_key("title", F.lower("venue_id"), F.col("start_date")).alias("event_key"),
        T.legacy_event_key("title", "venue_id", F.col("start_date")).alias("legacy_key"),
    )


# --- artists -----------------------------------------------------------------------------
BAND_SQL = """bands AS (
  SELECT p_partkey AS id, CASE WHEN p_type = 'PROMO' THEN p_name || ' ' || p_brand || ' [' || p_size || ']'
      WHEN p_type = 'LARGE' THEN upper(p_name) || ' ' || p_brand ELSE p_name || ' ' || p_brand END AS name,
    CAST(floor(p_retailprice) AS BIGINT) AS followers_count,
    TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (p_partkey * 7 % 1000) AS created_at FROM part),
  plays AS (SELECT l_partkey AS artist_id, count(*) AS linked_event_count FROM lineitem GROUP BY 1),
  bk AS (SELECT b.*, coalesce(linked_event_count, 0) AS linked, regexp_replace(lower(name), '[^a-z0-9 ]', '', 'g') AS key
    FROM bands b LEFT JOIN plays ON artist_id = id)"""


def bands(r: Roles) -> DataFrame:
    """Parts as artists, named after part and brand, some annotated, some in capitals."""
    base = F.concat("p_name", F.lit(" "), "p_brand")
    name = (
        F.when(F.col("p_type") == "PROMO", F.concat(base, F.lit(" ["), F.col("p_size").cast("string"), F.lit("]")))
        .when(F.col("p_type") == "LARGE", F.concat(F.upper("p_name"), F.lit(" "), "p_brand")).otherwise(base)
    )
    none = lambda t="string": F.lit(None).cast(t)
    created = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(F.col("p_partkey") * 7 % 1000).cast("int"))
    return r.table("part").select(
        F.col("p_partkey").alias("id"), name.alias("name"), none().alias("normalized_name"), none().alias("name_en"),
        none().alias("avatar_url"), F.col("p_type").alias("occupation"), none().alias("birth_date"), none().alias("birth_place"),
        none().alias("related"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("label"), none().alias("country"),
        F.floor("p_retailprice").cast("long").alias("followers_count"), none("map<string,string>").alias("sns_links"),
        created.alias("created_at"), T.title_key(base).alias("gemini_canon"),
    )


def plays(r: Roles) -> DataFrame:
    return r.table("lineitem").groupBy(F.col("l_partkey").alias("artist_id")).agg(F.count("*").alias("linked_event_count"))


_KEEP = "first_value(id) OVER (PARTITION BY key ORDER BY -linked, -followers_count, id)"


@query(
    "exact_artist_groups",
    f"""WITH {BAND_SQL} SELECT key AS name_key, id, name, {_KEEP} AS suggested_keep_id, 'exact_normalized' AS reason, 1.0e0 AS similarity
        FROM bk QUALIFY count(*) OVER (PARTITION BY key) > 1""",
)
def exact_artist_groups(r: Roles):
    return MA.exact_groups(bands(r), plays(r))


@query(
    "annotation_merges",
    f"""WITH {BAND_SQL}, c AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '[(\\[][^)\\]]*[)\\]]?', ' ', 'g'),
          '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS core FROM bk),
        g AS (SELECT core, count(*) FILTER (key = core) AS n1, count(*) FILTER (key <> core AND contains(name, '[')) AS n2,
          min(id) FILTER (key = core) AS id1, min(id) FILTER (key <> core AND contains(name, '[')) AS id2,
          min(linked) FILTER (key = core) AS l1, min(linked) FILTER (key <> core AND contains(name, '[')) AS l2 FROM c GROUP BY 1)
        SELECT CASE WHEN l2 > l1 THEN id1 ELSE id2 END AS old_id, CASE WHEN l2 > l1 THEN id2 ELSE id1 END AS keep_id
        FROM g WHERE n1 = 1 AND n2 = 1""",
)
def annotation_merges(r: Roles):
    return MA.annotation_mapping(bands(r), plays(r))


@query(
    "canonical_merges",
    f"""WITH {BAND_SQL}, e AS (SELECT l_suppkey AS sid, count(*) AS n FROM lineitem GROUP BY 1),
        c AS (SELECT id, regexp_replace(lower(p_name || p_brand), '[^a-z0-9]', '', 'g') AS canon, coalesce(e.n, 0) AS n
          FROM bands JOIN part ON p_partkey = id LEFT JOIN e ON sid = id)
        SELECT id AS old_id, keep_id FROM (SELECT id, first_value(id) OVER (PARTITION BY canon ORDER BY n DESC, id) AS keep_id FROM c)
        WHERE id <> keep_id""",
)
def canonical_merges(r: Roles):
    led = r.table("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("artist_id"))
    return MA.canonical_mapping(bands(r), led)


@query(
    "alias_pairs",
    f"""WITH {BAND_SQL}, al AS (SELECT p_partkey AS artist_id, lower(p_type) || ' ' || split_part(p_name, ' ', 2) || ' ' || p_brand AS alias FROM part),
        own AS (SELECT lower(name) AS n, first(id ORDER BY created_at, id) AS owner FROM bands GROUP BY 1)
        SELECT DISTINCT least(artist_id, owner) AS id_a, greatest(artist_id, owner) AS id_b FROM al JOIN own ON lower(alias) = n
        WHERE artist_id <> owner""",
)
def alias_pairs(r: Roles):
    alias = F.concat(F.lower("p_type"), F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" "), "p_brand")
    aliases = r.table("part").select(F.col("p_partkey").alias("artist_id"), alias.alias("alias"))
    return MA.alias_pairs(bands(r), aliases)


@query(
    "artist_candidates",
    f"""WITH {BAND_SQL}, al AS (SELECT p_partkey AS artist_id, lower(p_type) || ' ' || split_part(p_name, ' ', 2) || ' ' || p_brand AS alias FROM part),
        own AS (SELECT lower(name) AS n, first(id ORDER BY created_at, id) AS owner FROM bands GROUP BY 1),
        t AS (SELECT id, length(n) AS len, list_distinct(list_filter(
            string_split_regex(regexp_replace(lower(n), '[()\\[\\]{{}}]', ' ', 'g'), '[\\s\\-·._/]+'), lambda x: x <> '')) AS tok
          FROM (SELECT name AS n, min(id) AS id FROM bands GROUP BY 1) WHERE regexp_matches(n, '[A-Za-z]')),
        both_ AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.tok, b.tok)) AS m, len(a.tok) + len(b.tok) AS n
          FROM t a JOIN t b ON a.id < b.id AND abs(a.len - b.len) <= 2),
        k AS (SELECT {_KEY.format('name')} AS s, min(id) AS id FROM bands GROUP BY 1),
        found AS (
          SELECT least(artist_id, owner) AS id_a, greatest(artist_id, owner) AS id_b, 0 AS place, 'alias_match' AS reason, 0.95e0 AS similarity
            FROM al JOIN own ON lower(alias) = n WHERE artist_id <> owner
          UNION ALL SELECT a, b, 2, 'token_overlap', m / (n - m) FROM both_ WHERE m / (n - m) >= 0.85
          UNION ALL SELECT least(a.id, b.id), greatest(a.id, b.id), 3, 'name_contains', length(a.s) / length(b.s) FROM k a JOIN k b
            ON length(a.s) >= 2 AND length(a.s) < length(b.s) AND contains(b.s, a.s) AND length(a.s) / length(b.s) >= 0.4)
        SELECT id_a, id_b, first(reason ORDER BY place) AS reason, first(similarity ORDER BY place) AS similarity FROM found GROUP BY 1, 2""",
)
def artist_candidates(r: Roles):
    alias = F.concat(F.lower("p_type"), F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" "), "p_brand")
    aliases = r.table("part").select(F.col("p_partkey").alias("artist_id"), alias.alias("alias"))
    return MA.duplicate_pairs(bands(r), aliases)


@query(
    "merged_artists",
    f"""WITH {BAND_SQL}, m AS (SELECT *, {_KEEP} AS keep_id FROM bk)
        SELECT keep_id AS id, any_value(name) FILTER (id = keep_id) AS name, sum(followers_count) AS followers_count FROM m GROUP BY 1""",
)
def merged_artists(r: Roles):
    artists = bands(r)
    none = r.spark.createDataFrame([], "artist_id bigint, alias string, source string")
    merged = MA.merge_artists(artists, MA.exact_mapping(artists, plays(r)), {}, none)
    return merged["artists"].select("id", "name", "followers_count")


@query(
    "merged_artist_aliases",
    f"""WITH {BAND_SQL}, m AS (SELECT *, {_KEEP} AS keep_id FROM bk)
        SELECT keep_id AS artist_id, lower(name) AS alias, 'merge' AS source FROM m WHERE id <> keep_id GROUP BY 1, 2""",
)
def merged_artist_aliases(r: Roles):
    artists = bands(r)
    none = r.spark.createDataFrame([], "artist_id bigint, alias string, source string")
    merged = MA.merge_artists(artists, MA.exact_mapping(artists, plays(r)), {}, none)
    return merged["artist_aliases"].select("artist_id", F.lower("alias").alias("alias"), "source")


RAW_NAMES_SQL = """raw AS (SELECT DISTINCT CASE l_returnflag WHEN 'A' THEN upper(s_name) WHEN 'N' THEN replace(s_name, '#', '-#!')
      ELSE 'S' || s_suppkey END AS raw_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
    UNION SELECT c_name FROM customer)"""


def raw_names(r: Roles) -> DataFrame:
    acts = r.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    spelled = (
        F.when(F.col("l_returnflag") == "A", F.upper("s_name"))
        .when(F.col("l_returnflag") == "N", F.replace("s_name", F.lit("#"), F.lit("-#!")))
        .otherwise(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))
    )
    lines = r.table("lineitem").select("l_suppkey", "l_returnflag").distinct().join(acts, "l_suppkey")
    return lines.select(spelled.alias("raw_name")).unionByName(r.table("customer").select(F.col("c_name").alias("raw_name"))).distinct()


def known_artists(r: Roles) -> tuple[DataFrame, DataFrame]:
    acts = r.artists.select(
        F.col("id").cast("string").alias("id"), "name", T.name_key("name").alias("normalized_name"),
        F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit(None).cast("string").alias("name_en"),
        F.col("followers_count").cast("int").alias("followers_count"), F.lit(0).alias("upcoming_event_count"),
    )
    aliases = r.table("supplier").select(
        F.col("s_suppkey").cast("string").alias("artist_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("alias"),
        F.lit("seed").alias("source"),
    )
    return acts, aliases


@query(
    "matched_artists",
    f"""WITH {RAW_NAMES_SQL} SELECT raw_name, CAST(coalesce(a.s_suppkey, b.s_suppkey, c.s_suppkey) AS VARCHAR) AS artist_id,
          CASE WHEN a.s_suppkey IS NOT NULL THEN 'name' WHEN b.s_suppkey IS NOT NULL THEN 'key' WHEN c.s_suppkey IS NOT NULL THEN 'alias' END AS matched_by
        FROM raw LEFT JOIN supplier a ON lower(a.s_name) = lower(raw_name)
        LEFT JOIN supplier b ON regexp_replace(lower(b.s_name), '[^a-z0-9]', '', 'g') = regexp_replace(lower(raw_name), '[^a-z0-9]', '', 'g')
        LEFT JOIN supplier c ON 's' || c.s_suppkey = lower(raw_name)""",
)
def matched_artists(r: Roles):
    acts, aliases = known_artists(r)
    return LK.match_artists(raw_names(r), acts, aliases)


@query(
    "created_artists",
    """SELECT c_name AS name, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS normalized_name FROM customer GROUP BY 1, 2""",
)
def created_artists(r: Roles):
    acts, aliases = known_artists(r)
    _, everyone, _, _ = LK.match_or_create_artists(raw_names(r), acts, aliases)
    return everyone.filter(F.col("id").startswith("artist-")).select("name", "normalized_name")


# --- venues ------------------------------------------------------------------------------
HALLS_SQL = """halls AS (
  SELECT s_suppkey AS id, 'hall ' || n_name AS name,
    CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN n_name || ' 5층' ELSE n_name || ' annex' END AS address
  FROM supplier JOIN nation ON n_nationkey = s_nationkey),
  used AS (SELECT l_suppkey AS venue_id, count(*) AS n FROM lineitem GROUP BY 1),
  hk AS (SELECT h.*, coalesce(n, 0) AS n, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key,
    regexp_replace(regexp_replace(lower(address), '\\d+\\s*층', '', 'g'), '[^a-z0-9]', '', 'g') AS addr FROM halls h LEFT JOIN used ON venue_id = id),
  kept AS (SELECT *, first_value(id) OVER w AS keep_id, first_value(addr) OVER w AS keep_addr FROM hk
    WINDOW w AS (PARTITION BY key ORDER BY n DESC, id))"""


def halls(r: Roles) -> DataFrame:
    nations = r.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    key = F.col("s_suppkey") % 3
    address = F.when(key == 0, "").when(key == 1, F.concat("n_name", F.lit(" 5층"))).otherwise(F.concat("n_name", F.lit(" annex")))
    return r.table("supplier").join(nations, "s_nationkey").select(
        F.col("s_suppkey").alias("id"), F.concat(F.lit("hall "), "n_name").alias("name"), F.lit(None).cast("string").alias("normalized_name"),
        address.alias("address"), F.lit(None).cast("string").alias("phone_number"),
    )


def hall_use(r: Roles) -> DataFrame:
    return r.table("lineitem").groupBy(F.col("l_suppkey").alias("venue_id")).agg(F.count("*").alias("linked_event_count"))


@query(
    "venue_exact_merges",
    f"""WITH {HALLS_SQL} SELECT id AS old_id, keep_id FROM kept WHERE id <> keep_id AND (addr = '' OR keep_addr = '' OR addr = keep_addr)""",
)
def venue_exact_merges(r: Roles):
    return MV.exact_merge(halls(r), hall_use(r))[0]


@query(
    "venues_held_back",
    f"""WITH {HALLS_SQL} SELECT id AS venue_id, keep_id FROM kept WHERE id <> keep_id AND NOT (addr = '' OR keep_addr = '' OR addr = keep_addr)""",
)
def venues_held_back(r: Roles):
    return MV.exact_merge(halls(r), hall_use(r))[1].select("venue_id", "keep_id")


@query(
    "venue_candidates",
    f"""WITH {HALLS_SQL}, f AS (SELECT key, min(id) AS id FROM hk GROUP BY 1),
        e AS (SELECT f.id AS id_a, hk.id AS id_b, 0 AS place, 'exact_normalized' AS reason, 1.0e0 AS similarity FROM hk JOIN f USING (key) WHERE hk.id <> f.id),
        c AS (SELECT least(a.id, b.id), greatest(a.id, b.id), 1, 'name_contains', length(a.key) / length(b.key) FROM f a JOIN f b
          ON length(a.key) < length(b.key) AND contains(b.key, a.key) AND length(a.key) / length(b.key) >= 0.5)
        SELECT id_a, id_b, first(reason ORDER BY place) AS reason, first(similarity ORDER BY place) AS similarity
        FROM (SELECT * FROM e UNION ALL SELECT * FROM c) GROUP BY 1, 2""",
)
def venue_candidates(r: Roles):
    return MV.candidate_pairs(halls(r))


@query(
    "merged_venue_events",
    f"""WITH {HALLS_SQL}, m AS (SELECT id, CASE WHEN addr = '' OR keep_addr = '' OR addr = keep_addr THEN keep_id ELSE id END AS to_id FROM kept)
        SELECT to_id AS venue_id, count(*) AS n FROM lineitem JOIN m ON id = l_suppkey GROUP BY 1""",
)
def merged_venue_events(r: Roles):
    venues = halls(r)
    mapping, _ = MV.exact_merge(venues, hall_use(r))
    held = r.table("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("venue_id"))
    links = held.select(F.col("id").alias("event_id"), "venue_id", F.lit(0).alias("display_order"))
    return MV.merge_venues(venues, mapping, held, links)["events"].groupBy("venue_id").agg(F.count("*").alias("n"))


@query(
    "chained_mapping",
    """SELECT o_orderkey AS old_id, first_id AS keep_id FROM (SELECT o_orderkey,
         first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first_id FROM orders)
       WHERE o_orderkey <> first_id""",
)
def chained_mapping(r: Roles):
    """Every order of a customer maps to their next older one; the chains end at the first."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    step = r.table("orders").select(F.col("o_orderkey").alias("old_id"), F.lag("o_orderkey").over(w).alias("keep_id"))
    return C.resolve_chains(step.filter("keep_id IS NOT NULL"))


@query(
    "unlinked_events",
    with_roles("r_events r_event_artists", "SELECT id FROM r_events WHERE id NOT IN (SELECT event_id FROM r_event_artists)"),
)
def unlinked_events(r: Roles):
    from ..operators.listing import unlinked

    return unlinked(r.events, r.event_artists, "event_id").select("id")


@query("unused_venues", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unused_venues(r: Roles):
    venues = r.table("documents").select(F.col("doc_id").alias("id"))
    return MV.unused_venues(venues, r.table("labels").select(F.col("doc_id").alias("venue_id")))
