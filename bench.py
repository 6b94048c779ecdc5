"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default: all) and BENCH_QUERIES
(comma-separated names, or ``all``) choose what is run. One query warms the session up, then each
runs BENCH_REPEAT times (default 1); the best time counts. Results go to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from marquee.plans.catalogue import QUERIES
from marquee.session import local_session

HEADLINE = [
    "artist_engagement", "event_engagement", "genre_profile", "upcoming_counts", "artist_popularity", "event_popularity",
    "trending", "co_performers", "artist_recommendations", "event_recommendations", "contains_pairs", "token_pairs",
    "edit_pairs", "gram_leaders", "overlap_losers", "titles_naming_artists", "event_merge_mapping", "repointed_interest",
    "merged_artists", "matched_artists", "status_sweep", "normalised_records", "upserted_events", "stage_overlaps",
    "parsed_timetables", "zero_runs", "user_rollup", "latest_payloads", "page_anchors", "text_keys",
]


def run(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    spark = local_session(cores=cpus, app="marquee-bench", shuffle=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    run(QUERIES["artist_engagement"], spark, sf_dir)
    times = {}
    for name in names:
        times[name] = round(min(run(QUERIES[name], spark, sf_dir) for _ in range(max(1, repeat))), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
