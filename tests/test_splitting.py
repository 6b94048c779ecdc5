"""Records that hold several performers."""

from marquee.operators import lookups as LK

from .fixtures import ARTISTS, artist

EDGES = "event_id string, artist_id string, artist_name string, role string, display_order int, source_name string"


def test_split_joined(spark):
    artists = spark.createDataFrame([
        artist("a1", "선우정아"), artist("a2", "Jukjae", name_en="Jukjae"), artist("j1", "선우정아 X 적재"), artist("j2", "Luna & 선우정아"),
        artist("j3", "선우정아 & 선우정아"), artist("a4", "양파X존박")], ARTISTS)
    aliases = spark.createDataFrame([("a2", "적재", "seed"), ("j1", "선우정아", "seed")], "artist_id string, alias string, source string")
    edges = spark.createDataFrame([
        ("e1", "j1", "선우정아 X 적재", "primary", 1, "yes24"), ("e2", "j1", "선우정아 X 적재", "primary", 1, "yes24"),
        ("e2", "a2", "Jukjae", "primary", 7, "melon"), ("e3", "j1", None, None, None, None), ("e3", "j2", None, None, None, None),
        ("e4", "a4", "양파X존박", "primary", 1, None), ("e5", "j3", "x", "primary", 1, None)], EDGES)
    heads = spark.createDataFrame([("e1", "j1"), ("e4", "a4"), ("e6", None)], "event_id string, artist_id string")
    out = LK.split_joined(artists, aliases, edges, heads, heads)
    luna = out.artists.filter("name = 'Luna'").first().id
    got = {(r.event_id, r.artist_id): (r.role, r.display_order) for r in out.edges.collect()}
    assert got == {
        ("e1", "a1"): ("main", 1), ("e1", "a2"): ("lineup", 2), ("e2", "a1"): ("main", 1), ("e2", "a2"): ("primary", 7),
        ("e3", "a1"): ("main", 1), ("e3", "a2"): ("lineup", 2), ("e3", luna): ("main", 1), ("e4", "a4"): ("primary", 1), ("e5", "j3"): ("primary", 1)}
    assert {r.id for r in out.artists.collect()} == {"a1", "a2", "a4", "j3", luna}
    assert "j1" not in {r.artist_id for r in out.aliases.collect()}
    assert {tuple(r) for r in out.events.collect()} == {("e1", "a1"), ("e4", "a4"), ("e6", None)}
    assert out.performances.count() == 3 and out.edges.columns == edges.columns


def test_split_joined_empty(spark):
    none = spark.createDataFrame([], ARTISTS)
    aliases = spark.createDataFrame([], "artist_id string, alias string, source string")
    edges, heads = spark.createDataFrame([], EDGES), spark.createDataFrame([], "event_id string, artist_id string")
    assert all(df.count() == 0 for df in LK.split_joined(none, aliases, edges, heads, heads))
