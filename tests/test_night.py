from pyspark.sql import functions as F

from marquee.plans import nightly as N
from marquee.operators import lifecycle as LC

from .fixtures import catalogue

AS_OF = "2026-07-01T00:00:00"


def test_whole_night(spark):
    before = catalogue(spark)
    tables, logs, report = N.run_night(before, AS_OF)
    assert N.night_status(report) == "done", report
    by_step = {r["step"]: r for r in report}
    assert [r["step"] for r in report] == list(N.STEPS)
    assert by_step["crawl"]["found"] == 3 and by_step["crawl"]["rejected"] == 2
    events = {r["id"]: r for r in tables["events"].collect()}
    fresh = [e for e in events.values() if e["title"] == "새 공연"]
    assert len(fresh) == 1 and fresh[0]["venue_id"] is not None and fresh[0]["artist_id"] == "a1"
    # one show, listed twice with a city marker, under two spellings of artist and venue
    assert len({"e1", "e2"} & set(events)) == 1
    assert "e4" not in events and "e6" not in events  # an exhibition and a stub
    assert events["e5"]["title"] == "그냥 밤"
    assert events["e3"]["status"] == "ended" and events["e3"]["is_hidden"]
    artists = {r["id"]: r for r in tables["artists"].collect()}
    assert "a4" not in artists and len({"a1", "a2"} & set(artists)) == 1
    kept = artists[next(iter({"a1", "a2"} & set(artists)))]
    assert kept["label"] == "EDAM" and kept["popularity_score"] is not None and kept["followers_count"] == 1
    assert artists["a3"]["occupation"] == "힙합" and artists["a3"]["avatar_url"] == "https://m" and artists["a3"]["label"] == "KOZ"
    # nothing points at what is gone
    for child, key, parent in (("event_artists", "artist_id", "artists"), ("event_artists", "event_id", "events"),
                               ("user_interested_events", "event_id", "events"), ("event_venues", "venue_id", "venues")):
        known = tables[parent].select(F.col("id").alias(key))
        lost = tables[child].join(known, key, "left_anti").collect()
        assert not lost, (child, key, lost)
    assert tables["user_interested_events"].filter("user_id = 'u1'").count() == 1
    assert {(s, k) for s, k, _ in logs} >= {("sweep", "event_change_logs"), ("merge", "event_merge_logs"), ("fix", "fix_logs")}
    assert tables["popularity_snapshots"].count() == 1 + tables["artists"].count() + tables["events"].count()


def test_a_failing_step_is_partial(spark):
    _, _, report = N.run_night({}, AS_OF, ["sweep"])
    assert N.night_status(report) == "partial" and report[0]["status"] == "failed"


def test_sweep_edges(spark):
    from .fixtures import EVENTS, event, when

    rows = [
        event("end-null", "t", "2026-06-01"), event("ends-now", "t", "2026-06-01", "2026-07-01"),
        event("pinned", "t", "2026-06-01", locked_fields=["status"]),
        event("closed", "t", "2026-08-01", ticket_close_date=when("2026-06-01"), status="upcoming"),
        event("opens", "t", "2026-08-01", ticket_open_date=when("2026-07-05")),
        event("revived", "t", "2026-06-01", "2026-08-01", status="ended"),
        event("kept-ended", "t", "2026-08-01", status="ended"),
    ]
    events, changes = LC.sweep(spark.createDataFrame(rows, EVENTS), AS_OF)
    got = {r.id: r.status for r in events.collect()}
    assert got == {
        "end-null": "ended", "ends-now": "ongoing", "pinned": "on_sale", "closed": "upcoming", "opens": "upcoming",
        "revived": "ongoing", "kept-ended": "ended",
    }
    assert changes.count() == 4
