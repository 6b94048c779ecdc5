"""From landed payloads to the event table, batch by batch."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.lookups import existing_events
from ..operators.upsert import upsert, validated
from ..session import cut_lineage
from ..sources.landing import normalise_records, parse_records, record_errors

ALARM_AFTER = 3
BUCKETS = 64


def first_records(records: DataFrame, key: str = "dedup_key", time: str = "crawled_at", delay: str = "1 day") -> DataFrame:
    """Re-crawled copies of a record within the watermark are dropped."""
    return records.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


class EventStore:
    """The event table as whole files by bucket of id, and the rows that each later version changed.

    ``append`` writes the changed rows of a version and nothing else. ``read`` takes the newest whole files of each
    bucket and over them the newest changed row of an id, so the rest of the table is scanned without a shuffle.
    ``compact`` is a step of its own: it writes whole files for the buckets with changed rows and leaves the
    other buckets, and all that readers of earlier versions need, as they are. A version counts once its job has
    ended; writing it again replaces it. Rows are never taken out.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("id_bucket")

    def _path(self, kind: str, version: int) -> str:
        return f"{self.folder}/{kind}/in_version={version:012d}"

    def _found(self, pattern: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{pattern}")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return [str(f.getPath()) for f in found or []]

    def _versions(self, kind: str, upto: int) -> list[int]:
        """Complete versions, ascending."""
        done = (int(p.split("in_version=")[1].split("/")[0]) for p in self._found(f"{kind}/in_version=*/_SUCCESS"))
        return sorted(v for v in done if v <= upto)

    def _newest(self, upto: int) -> dict[int, int]:
        """bucket: the newest version that has whole files of it."""
        newest = {}
        for v in self._versions("whole", upto):
            held = self._found(f"whole/in_version={v:012d}/id_bucket=*")
            newest |= {int(p.rpartition("=")[2]): v for p in held}
        return newest

    def _schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.spark.read.text(f"{self.folder}/schema").first()[0]))

    def _whole(self, version: int, table: DataFrame) -> None:
        rows = table.select("*", self.bucket).hint("rebalance", "id_bucket")
        rows.write.mode("overwrite").partitionBy("id_bucket").parquet(self._path("whole", version))

    def write(self, version: int, table: DataFrame) -> None:
        """Put down a whole table."""
        self.spark.createDataFrame([(table.schema.json(),)], "s string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/schema")
        self._whole(version, table)

    def append(self, version: int, changed: DataFrame) -> None:
        """New and changed rows, one for an id, that make this version out of the one before."""
        rows = changed.select(*self._schema().names, self.bucket).hint("rebalance").sortWithinPartitions("id_bucket")
        rows.write.mode("overwrite").parquet(self._path("changed", version))

    def changed(self, version: int) -> DataFrame | None:
        """The newest changed row of each id that is not in whole files, with its bucket."""
        versions, newest = self._versions("changed", version), self._newest(version)
        if not versions:
            return None
        schema = self._schema()
        rows = self.spark.read.schema(StructType([*schema.fields, StructField("id_bucket", IntegerType())]).add("in_version", "long"))
        rows = rows.option("basePath", f"{self.folder}/changed").parquet(*[self._path("changed", v) for v in versions])
        since = F.lit(-1)
        if newest:
            table = F.create_map(*[F.lit(x) for pair in newest.items() for x in pair])
            since = F.coalesce(F.try_element_at(table, F.col("id_bucket")), since)
        rows = rows.filter(F.col("in_version") > since)
        return rows.groupBy("id").agg(F.max_by(F.struct(*schema.names, "id_bucket"), "in_version").alias("r")).select("r.*")

    def read(self, version: int) -> DataFrame:
        """The table at a version."""
        return self._read(version, self.changed(version)).drop("id_bucket")

    def _read(self, version: int, changed: DataFrame | None, only: list[int] | None = None) -> DataFrame:
        newest, schema = self._newest(version), self._schema()
        of: dict[int, list[int]] = {}
        for bucket, v in newest.items():
            if only is None or bucket in only:
                of.setdefault(v, []).append(bucket)
        full = StructType([*schema.fields, StructField("id_bucket", IntegerType())])
        rows = self.spark.createDataFrame([], full)
        if of:
            rows = self.spark.read.schema(full.add("in_version", "long")).option("basePath", f"{self.folder}/whole").parquet(
                *[self._path("whole", v) for v in of])
            wanted = F.lit(False)
            for v, buckets in of.items():
                wanted = wanted | ((F.col("in_version") == v) & F.col("id_bucket").isin(buckets))
            rows = rows.filter(wanted).drop("in_version")
        if changed is None:
            return rows
        return rows.join(changed.select("id"), "id", "left_anti").select(changed.columns).unionByName(changed)

    def compact(self, version: int) -> None:
        """Whole files at a version for the buckets with changed rows."""
        changed = self.changed(version)
        if changed is None:
            return
        only = [r.id_bucket for r in changed.select("id_bucket").distinct().collect()]  # at most self.buckets
        if only:
            self._whole(version, self._read(version, changed, only).drop("id_bucket"))


def ingest_batch(store: EventStore, batch: DataFrame, epoch: int, as_of: str) -> None:
    """Merge one batch of payloads into version ``epoch``, giving version ``epoch + 1``.

    Only the events that the batch is about are merged and written. The same epoch always reads and writes the
    same versions, so a repeated batch changes nothing.
    """
    parsed = parse_records(batch).withColumn("errors", record_errors())
    usable = normalise_records(parsed.filter(F.size("errors") == 0), as_of)
    none = F.lit(None).cast("string")
    rows = cut_lineage(usable.withColumn("artist_id", none).withColumn("venue_id", none).withColumnRenamed("id", "row_id"))
    table = store.read(epoch)
    meant = existing_events(validated(rows)[0], table).select(F.col("event_id").alias("id")).filter("id is not null").distinct()
    store.append(epoch + 1, upsert(rows, table.join(meant, "id", "left_semi"), as_of)["events"])


def start_ingest(payloads: DataFrame, store: EventStore, checkpoint: str, as_of: str) -> StreamingQuery:
    """Stream of (id, parsed_json, crawled_at) payloads into the store; version 0 must exist."""
    return (
        payloads.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda batch, epoch: ingest_batch(store, batch, epoch, as_of)).start()
    )


# --- empty crawls ------------------------------------------------------------------------
def _follow_crawls(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keep the time of the last crawl that found something and the empty ones since."""
    last, empty = state.get if state.exists else (-1, [])
    empty = list(empty)
    for frame in frames:
        hits = frame.loc[frame["events_found"] > 0, "at"]
        last = max(last, int(hits.max())) if len(hits) else last
        empty += [int(x) for x in frame.loc[frame["events_found"] == 0, "at"]]
    empty = sorted(x for x in empty if x > last)
    state.update((last, empty))
    yield pd.DataFrame({"source_name": [key[0]], "zero_run": [len(empty)], "alarm": [len(empty) >= ALARM_AFTER]})


def crawl_alarms(jobs: DataFrame) -> DataFrame:
    """(source_name, zero_run, alarm) after every batch of (source_name, at, events_found).

    Order inside a batch does not matter. State per source is the current run of empty crawls.
    """
    return jobs.select("source_name", "at", "events_found").groupBy("source_name").applyInPandasWithState(
        _follow_crawls, "source_name string, zero_run int, alarm boolean", "last long, empty array<long>", "update",
        GroupStateTimeout.NoTimeout,
    )
