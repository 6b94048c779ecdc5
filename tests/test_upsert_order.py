"""Upserts in order: a batch gives what any split of it gives, and what applying row by row gives."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marquee.functions import fixed_values as V
from marquee.operators import upsert as U

from .fixtures import EVENTS, event, when
from .test_operators import AS_OF, INCOMING, crawl

SOURCES = ["yes24", "melon", "festivallife", "gemini-search", "enrich", "somebody"]


def trust(source):
    return 0 if not source else V.SOURCE_TRUST.get(source, V.UNKNOWN_SOURCE_TRUST)


def applied(value, source, rows):
    """Rows (value, source) one after another."""
    moved = False
    for new, by in rows:
        if new and new != value and (not value or trust(by) >= trust(source)):
            value, source, moved = new, by, True
    return value, source, moved


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_gives_the_same(spark, seed):
    rng = random.Random(seed)
    at = when("2026-06-01")
    start = {f"e{k}": (rng.choice([None, "", "X", "Y"]), rng.choice([*SOURCES, None])) for k in range(30)}
    events = spark.createDataFrame([
        event(k, f"Title {k}", "2026-08-01", normalized_title=f"title {k}", genre=v, field_sources={"genre": (s, at)} if s else {}) for k, (v, s) in start.items()], EVENTS)
    rows, genres = [], {k: [] for k in start}
    for n in range(300):
        k, source, genre = rng.choice(list(start)), rng.choice(SOURCES), rng.choice([None, "", "X", "Y", "Z"])
        genres[k].append((genre, source))
        rows.append(crawl(n, f"Title {k}", f"key-{k}", source, genre=genre, start_date=None, status=rng.choice(["on_sale", "upcoming", None, "ended"]),
                          venue_id=rng.choice([None, "v"]), artist_id=rng.choice([None, "a"])))
    rows += [crawl(1000 + n, "Brand new", "k-new", s, genre=g, poster_url=p, start_date=None, venue_id=v) for n, (s, g, p, v) in enumerate(
        [("gemini-search", None, "p1", None), ("melon", "G", "", "v1"), ("festivallife", "H", "p2", "v2"), ("yes24", "G", None, "v3"), ("festivallife", "I", "p3", None)])]

    def after(*cuts):
        table, a = events, 0
        for b in [*cuts, len(rows)]:
            table = U.upsert(spark.createDataFrame(rows[a:b], INCOMING), table, AS_OF)["events"]
            a = b
        keep = [c for c in table.columns if c not in ("source_urls", "booking_links")]
        return {r.id: r for r in table.select(*keep, F.size("source_urls").alias("n")).collect()}

    whole = after()
    assert whole == after(rng.randrange(20, 150), rng.randrange(150, 303))
    for k, (value, source) in start.items():
        value, source, _ = applied(value, source, genres[k])
        assert whole[k].genre == value
        assert (whole[k].field_sources["genre"].source if "genre" in (whole[k].field_sources or {}) else None) == source
    new = next(r for r in whole.values() if r.title == "Brand new")
    assert (new.genre, new.poster_url, new.venue_id) == ("G", "p3", None)


def test_hot_event_is_split_over_tasks(spark):
    rng = random.Random(9)
    rows, values = [], []
    for n in range(2000):
        values.append((rng.choice([None, "", *"ABCDE"]), rng.choice([*SOURCES[:4], None])))
        rows.append(("hot", n, values[-1][1], *[values[-1][0]] * len(U.TRACKED)))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        frame = spark.createDataFrame(rows, "event_id string, row_id long, source_name string, " + ", ".join(f"{f} string" for f in U.TRACKED))
        effect = U.steps(frame.repartition(4))
        done = effect.collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert len(done) == 1 and len(done[0].shares) > 5
    starts = [(v, s) for v in (None, "", *"ABCDEX") for s in (None, *SOURCES)]
    ends = spark.createDataFrame([("hot", k, *x) for k, x in enumerate(starts)], "event_id string, k int, v string, s string").join(
        spark.createDataFrame(done, effect.schema), "event_id").select("k", U.settled("genre", F.col("v"), F.col("s")).alias("end")).collect()
    got = {r.k: (r.end.v, r.end.s, r.end.moved) for r in ends}
    assert got == {k: applied(v, s, values) for k, (v, s) in enumerate(starts)}


def test_untouched_fields_are_not_written(monkeypatch):
    """A field that no row has is null instead of a row of blanks per trust level, and repeats change nothing."""
    monkeypatch.setattr(U.TaskContext, "get", classmethod(lambda cls: type("Task", (), {"partitionId": lambda self: 3})()))
    rows = [("a", 55, "festivallife", "X"), ("a", 20, "gemini-search", "X"), ("a", 70, "yes24", "X"), ("b", 20, "gemini-search", None)]
    schema = pa.schema([("event_id", pa.string()), ("trust", pa.int32()), ("source_name", pa.string()), *[(f, pa.string()) for f in U.TRACKED]])
    batch = pa.RecordBatch.from_pylist([{"event_id": e, "trust": t, "source_name": s, "genre": g} for e, t, s, g in rows], schema)
    out = [r for done in U._shares(iter([batch.slice(0, 2), batch.slice(2)])) for r in done.to_pylist()]
    assert [(r["event_id"], r["share"]) for r in out] == [("a", 3), ("b", 3)]
    assert all(r[f] is None for r in out for f in U.TRACKED if (r["event_id"], f) != ("a", "genre"))
    first = [(s["first"], s["source"], s["trust"], s["then_trust"]) for s in out[0]["genre"]]
    low, high = ("X", "festivallife", 55, None), ("X", "yes24", 70, None)
    assert first == [low if level <= 55 else high if level <= 70 else (None,) * 4 for level in U.LEVELS]
