"""Work that grows far beyond what Spark expects: what it may broadcast, what it works out twice, and that results stay."""

from pyspark.sql import functions as F

from marquee.functions import nested as K
from marquee.functions import text as T
from marquee.operators import enrich as EN
from marquee.operators import lookups as LK
from marquee.operators import similarity as S
from marquee.plans.catalogue import QUERIES
from marquee.session import cut_lineage


def planned(df) -> str:
    """The plan before its first stage runs."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_grams_are_not_broadcast(spark, table):
    names = cut_lineage(table([("abc",), ("abcdef",), ("xabcdefgh",), ("zz",)], "v string"))
    pairs = S.containment_pairs(names, "v", 0.4)
    assert "BroadcastHashJoin" not in planned(pairs)
    assert {(r.short, r.long) for r in pairs.collect()} == {("abc", "abcdef"), ("abcdef", "xabcdefgh")}


def test_titles_are_not_broadcast_gram_by_gram(spark, table):
    titles = cut_lineage(table([(1, "An evening with iu"), (2, "the big nova show"), (3, "riu live")], "id int, title string"))
    acts = cut_lineage(table([("a", "iu"), ("b", "Big Nova"), ("c", "Nova")], "id string, name string"))
    named = LK.titles_naming_artists(titles, acts)
    text = planned(named)
    assert "BroadcastHashJoin" in text and "BuildLeft" not in text
    rights = [line for line in text.splitlines() if "BroadcastHashJoin" in line and "LeftSemi" not in line]
    assert len(rights) <= 1, rights  # the names, once more, for their ids
    assert {(r.event_id, r.artist_id) for r in named.collect()} == {(1, "a"), (2, "b")}


def test_ranges_are_spread_once_whatever_the_rows(spark, table, monkeypatch):
    kept = []
    monkeypatch.setattr(S, "cut_lineage", lambda df: kept.append(cut_lineage(df)) or kept[-1])
    day = "date '2024-01-0{}'".format
    rows = spark.range(400).selectExpr(
        "id", "'t' as title", "concat('v', id) as venue", f"if(id < 200, {day(1)}, {day(5)}) as s", f"if(id < 200, {day(3)}, {day(7)}) as e", "0 as score")
    got = {r.id: r.beaten_by for r in S.overlap_losers(rows, ["title"], "venue", "s", "e", F.col("score"), "id").collect()}
    assert got == {k: 200 * (k // 200) for k in range(400) if k % 200}
    assert sorted(df.count() for df in kept)[:2] == [2, 2]  # the ranges and what they met


def test_steps_of_a_name_are_not_copied_into_each_other(spark, table):
    names = table([("아이유 (IU)",)], "v string").select(T.structured_name("v").alias("s")).select("s.*")
    assert names._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") < 100
    assert tuple(names.first()) == ("아이유", "IU", ["IU", "아이유 (IU)"], "아이유")


def test_payload_names_are_read_without_a_second_parse(spark, table):
    rows = table([(r'{"artists":["a\"b","아이유"," x ",1,null,"1","",{"a":1},["y"],true,"x"]}',), ("oops",), (None,)], "j string")
    names = rows.select(K.candidate_names(F.col("j")).alias("n"))
    assert "get_json_object" not in planned(names)
    assert [r.n for r in names.collect()] == [['a"b', "아이유", "x", "1"], [], []]


def test_acts_of_an_event_are_brought_to_form_once(spark, table):
    day = table([(1, 7, "s", "u", '{"artists":["IU"]}', True), (1, 8, "s", "u", '{"artists":["iu "]}', True)],
                "event_id int, id int, source_name string, source_url string, parsed_json string, processed boolean")
    events = table([(1, "t", None, None)], "id int, title string, artist_id string, genre string")
    audit = EN.lineup_audit(day, events, table([(1, " Zico  A")], "event_id int, artist_name string"))
    assert "_acts" in audit._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.reason, r.payload_id) for r in audit.collect()} == {("missing_artist_link", 7), ("timetable_artist_mismatch", 7)}


def test_pages_of_one_file_are_shared_over_the_cores(spark, sf_dir):
    assert QUERIES["banner_items"](spark, sf_dir).rdd.getNumPartitions() > 1
    assert QUERIES["structured_names"](spark, sf_dir).rdd.getNumPartitions() > 1


def test_order_lines_are_joined_once_for_all_scores(spark, sf_dir, monkeypatch):
    """Every role that a score counts from once joined all lines with their orders for itself."""
    from marquee.plans.roles import Roles

    joins, lines = [], Roles.lines.fget
    monkeypatch.setattr(Roles, "lines", property(lambda r: joins.append(1) or lines(r)))
    QUERIES["event_popularity"](spark, sf_dir)
    assert len(joins) == 1


def test_pairs_of_users_and_artists_are_shuffled_once(spark, table, monkeypatch):
    """Followed acts were taken out by a join of their own, and events with a single act were seen too."""
    from marquee.operators import recommend_artists as RA

    monkeypatch.setattr(RA, "cut_lineage", lambda df: df)
    follows = table([(1, 10), (1, 11), (2, 12), (3, 13)], "user_id long, artist_id long")
    acts = [(100, 10), (100, 11), (100, 12), (101, 10), (101, 12), (102, 11), (103, 13)]
    met = RA.co_performers(follows, table(acts, "event_id long, artist_id long"))
    assert sorted(tuple(r) for r in met.select("user_id", "artist_id", "shared", "event_id").collect()) == [
        (1, 12, 2, 100), (2, 10, 2, 100), (2, 11, 1, 100)]
    assert "LeftAnti" not in planned(met)
    assert sorted(r.event_id for r in RA.shared_stages(table(acts, "event_id long, artist_id long")).distinct().collect()) == [100, 100, 100, 101, 101]


def test_pairs_of_users_and_events_are_shuffled_once(spark, sf_dir, monkeypatch):
    """Links were written, read, made distinct and joined again with what they were made from."""
    from marquee.operators import recommend_events as RE

    written, cut = [], RE.cut_lineage
    monkeypatch.setattr(RE, "cut_lineage", lambda df: written.append(set(df.columns)) or cut(df))
    QUERIES["event_recommendations"](spark, sf_dir)
    assert written and not any("artist_hit" in columns for columns in written)
