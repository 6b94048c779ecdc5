"""The raw landing zone, raw records and snapshot storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import links as L
from ..functions import text as T

RAW_RECORD = (
    "sourceUrl string, sourceName string, title string, posterUrl string, venueName string, venueAddress string, "
    "startDate string, endDate string, ticketOpenDate string, ticketProvider string, ticketUrl string, "
    "artists array<string>, artistProfiles array<struct<name:string,sourceUrl:string,avatarUrl:string,"
    "occupation:string,birthDate:string,related:string>>, genre string, description string, status string, "
    "rawHtml string"
)


def scan(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def land(payloads: DataFrame, path: str) -> None:
    """Append raw payloads; they are partitioned by source and day and never rewritten."""
    payloads.withColumn("crawl_date", F.to_date("crawled_at")).write.mode("append").partitionBy(
        "source_name", "crawl_date"
    ).parquet(path)


def unprocessed(payloads: DataFrame, processed: DataFrame, key: str = "id") -> DataFrame:
    """Payloads no run has marked as processed; marks live in their own append-only table."""
    return payloads.join(processed.select(key), key, "left_anti")


def marks(payloads: DataFrame, event_ids: DataFrame, key: str = "id") -> DataFrame:
    """(id, event_id) rows to append to the processed table."""
    return payloads.select(key, "dedup_key").join(event_ids.select("dedup_key", "event_id"), "dedup_key").select(key, "event_id")


def parse_records(payloads: DataFrame, column: str = "parsed_json", schema: str = RAW_RECORD) -> DataFrame:
    """Payload columns plus ``record`` and ``corrupt``; unreadable JSON stays as text in corrupt."""
    typed = f"{schema}, _corrupt_record string"
    parsed = F.from_json(column, typed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return payloads.withColumn("record", parsed).withColumn("corrupt", F.col("record._corrupt_record"))


def record_errors(record: str = "record", corrupt: str = "corrupt") -> Column:
    """What keeps a raw record from being normalised."""
    r = lambda name: F.col(f"{record}.{name}")
    url_ok = lambda c: F.try_parse_url(c, F.lit("HOST")).isNotNull()
    return F.array_compact(F.array(
        F.when(F.col(corrupt).isNotNull() | F.col(record).isNull(), F.lit("json")),
        F.when(~F.coalesce(url_ok(r("sourceUrl")), F.lit(False)), F.lit("sourceUrl")),
        F.when(r("sourceName").isNull(), F.lit("sourceName")),
        F.when(T.or_empty(r("title")) == "", F.lit("title")),
        F.when(r("posterUrl").isNotNull() & ~url_ok(r("posterUrl")), F.lit("posterUrl")),
        F.when(r("status").isNotNull() & ~r("status").isin("upcoming", "on_sale", "ended"), F.lit("status")),
    ))


def normalise_records(records: DataFrame, as_of: str, record: str = "record") -> DataFrame:
    """The normalised event of each raw record; other payload columns are kept."""
    r = lambda name: F.col(f"{record}.{name}")
    # step by step: a value used by several others becomes a column first, so it is computed once
    base = records.withColumns({
        "title": T.display_title(r("title")),
        "start_date": D.parse_date(r("startDate")),
        "end_date": F.coalesce(D.parse_end_date(r("endDate")), D.parse_end_date(r("startDate"))),
        "ticket_open_date": D.parse_ticket_opening(r("ticketOpenDate")),
        "_venue": T.cut_venue_info(T.nfkc(r("venueName"))),
    })
    base = base.withColumn("normalized_venue", T.plain_venue_name_of(F.col("_venue"), r("title"))).drop("_venue")
    base = T.with_event_key(base, "title", "normalized_venue", F.col("start_date"), "dedup_key")
    return base.withColumns({
        "normalized_title": T.plain_title("title"),
        "poster_url": L.https_image(r("posterUrl")),
        "venue_name": T.strip(r("venueName")),
        "venue_address": T.strip(r("venueAddress")),
        "ticket_provider": T.strip(r("ticketProvider")),
        "booking_url": L.http_url(r("ticketUrl")),
        "source_urls": F.array(F.struct(r("sourceName").alias("site"), r("sourceUrl").alias("url"))),
        "source_name": r("sourceName"),
        "artists": F.coalesce(r("artists"), F.array().cast("array<string>")),
        "artist_profiles": r("artistProfiles"),
        "genre": T.strip(r("genre")),
        "description": T.strip(r("description")),
        "status": F.coalesce(r("status"), F.lit("upcoming")),
        "inferred_status": D.infer_status(F.col("start_date"), F.col("end_date"), F.col("ticket_open_date"), D.at(as_of)),
    }).drop(record)


def append_snapshots(rows: DataFrame, path: str) -> None:
    """Append score snapshots, one folder per day, so that trend windows prune."""
    rows.withColumn("captured_date", F.to_date("captured_at")).write.mode("append").partitionBy("captured_date").parquet(path)


def read_snapshots(spark: SparkSession, path: str, as_of: str, days: int = 30) -> DataFrame:
    """Snapshots of the last days; the folder filter prunes before any file is opened."""
    day = F.lit(as_of[:10]).cast("date")
    return spark.read.parquet(path).filter(F.col("captured_date") >= F.date_sub(day, days)).drop("captured_date")


def append_log(rows: DataFrame, path: str) -> None:
    """Change, merge, fix and error logs only ever grow."""
    rows.write.mode("append").parquet(path)


def ingestion_errors(rejected: DataFrame, step: str, kind: str) -> DataFrame:
    """Rejected rows (source_name, source_url, errors, payload) as error-log rows."""
    return rejected.select(
        "source_name", "source_url", F.lit(step).alias("step"), F.lit(kind).alias("error_type"),
        F.array_join("errors", "; ").alias("error_message"), "payload",
    )
