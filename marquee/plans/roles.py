"""The driver's tables in the roles of the catalogue.

An event is a part, an artist a supplier, a user a customer and a venue a brand. A supplier
plays an event when it sold that part to a customer of its own nation; a user follows the
suppliers of their urgent orders, is interested in the parts of open orders, books every part
they order and reviews the ones they returned. Clicks per user are the score snapshots.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import at, infer_status
from ..session import cut_lineage, spread

AS_OF = "2024-01-20T00:00:00"
SNAPSHOT_AS_OF = "2024-01-31T00:00:00"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Tables whose rows are long texts, where the work per row is what counts.
TEXT_TABLES = {"documents", "pages", "conversations", "benchmark"}


class Roles:
    """Lazily derived role tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        rows = load(self.spark, self.sf_dir, name)
        return spread(rows) if name in TEXT_TABLES else rows

    def kept(self, *names: str) -> Roles:
        """Write these roles to tables, for a query that reads them more than once."""
        for name in names:
            setattr(self, name, cut_lineage(getattr(self, name)))
        return self

    @property
    def lines(self) -> DataFrame:
        orders = self.table("orders").withColumnRenamed("o_orderkey", "l_orderkey")
        return self.table("lineitem").join(orders, "l_orderkey")

    @cached_property
    def deals(self) -> DataFrame:
        """What the user roles take from order lines."""
        return self.lines.select("l_partkey", "l_suppkey", "o_custkey", "o_orderstatus", "o_orderpriority")

    @property
    def events(self) -> DataFrame:
        start = F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size"))
        key = F.col("p_partkey")
        end = F.date_add(start, (key % 4).cast("int"))
        opening = F.date_sub(start, (key % 60).cast("int"))
        return self.table("part").select(
            key.alias("id"),
            F.col("p_name").alias("title"),
            F.col("p_type").alias("genre"),
            F.col("p_brand").alias("venue_id"),
            start.alias("start_date"),
            end.alias("end_date"),
            opening.alias("ticket_open_date"),
            infer_status(start, end, opening, at(AS_OF)).alias("status"),
            (F.col("p_type") == "LARGE").alias("has_timetable"),
            F.col("p_retailprice"),
        )

    @property
    def artists(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("id"),
            F.col("s_name").alias("name"),
            F.concat(F.lit("label"), F.col("s_nationkey").cast("string")).alias("label"),
            F.floor(F.greatest(F.col("s_acctbal"), F.lit(0.0))).cast("long").alias("followers_count"),
        )

    @cached_property
    def event_artists(self) -> DataFrame:
        buyers = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        acts = self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey", "s_name")
        return (
            self.deals.select("l_partkey", "l_suppkey", "o_custkey")
            .join(buyers, "o_custkey")
            .join(acts, "l_suppkey")
            .filter(F.col("c_nationkey") == F.col("s_nationkey"))
            .select(
                F.col("l_partkey").alias("event_id"),
                F.col("l_suppkey").alias("artist_id"),
                F.col("s_name").alias("artist_name"),
                F.col("l_suppkey").alias("display_order"),
            )
            .distinct()
        )

    @cached_property
    def followings(self) -> DataFrame:
        return (
            self.deals.filter(F.col("o_orderpriority") == "1-URGENT")
            .select(F.col("o_custkey").alias("user_id"), F.col("l_suppkey").alias("artist_id"))
            .distinct()
        )

    @cached_property
    def interested(self) -> DataFrame:
        return (
            self.deals.filter(F.col("o_orderstatus") == "O")
            .select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("event_id"))
            .distinct()
        )

    @cached_property
    def bookings(self) -> DataFrame:
        status = (
            F.when(F.col("o_orderstatus") == "F", "completed")
            .when(F.col("o_orderstatus") == "P", "active")
            .otherwise("upcoming")
        )
        return self.deals.select(
            F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("event_id"), status.alias("status")
        )

    @property
    def reviews(self) -> DataFrame:
        return self.table("lineitem").filter(F.col("l_returnflag") == "R").select(
            F.col("l_partkey").alias("event_id"), (1 + F.col("l_linenumber") % 5).alias("star_count")
        )

    @property
    def performances(self) -> DataFrame:
        """Timetable slots: accepted lines, with the line status as the stage's genre."""
        return self.table("lineitem").filter(F.col("l_returnflag") == "A").select(
            F.col("l_partkey").alias("event_id"),
            F.col("l_suppkey").alias("artist_id"),
            F.concat(F.lit("slot "), F.col("l_linestatus")).alias("genre"),
        )

    @property
    def snapshots(self) -> DataFrame:
        return self.table("events").select(
            F.lit("artist").alias("entity_type"),
            F.col("user_id").cast("string").alias("entity_id"),
            F.col("value").alias("popularity_score"),
            F.col("ts").cast("timestamp").alias("captured_at"),
        )


# The same roles for the SQL side; a query names the ones it needs.
ROLE_SQL = {
    "lines": "SELECT * FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
    "r_events": """
        SELECT id, title, genre, venue_id, start_date, end_date, ticket_open_date, has_timetable, p_retailprice,
          CASE WHEN end_date < DATE '2024-01-20' THEN 'ended'
               WHEN start_date <= DATE '2024-01-20' AND DATE '2024-01-20' <= end_date THEN 'ongoing'
               WHEN ticket_open_date > DATE '2024-01-20' THEN 'upcoming' ELSE 'on_sale' END AS status
        FROM (SELECT p_partkey AS id, p_name AS title, p_type AS genre, p_brand AS venue_id,
                DATE '2024-01-01' + p_size AS start_date,
                DATE '2024-01-01' + p_size + CAST(p_partkey % 4 AS INTEGER) AS end_date,
                DATE '2024-01-01' + p_size - CAST(p_partkey % 60 AS INTEGER) AS ticket_open_date,
                p_type = 'LARGE' AS has_timetable, p_retailprice FROM part)""",
    "r_artists": """
        SELECT s_suppkey AS id, s_name AS name, 'label' || s_nationkey AS label,
          CAST(floor(greatest(s_acctbal, 0.0)) AS BIGINT) AS followers_count FROM supplier""",
    "r_event_artists": """
        SELECT DISTINCT l_partkey AS event_id, l_suppkey AS artist_id, s_name AS artist_name,
          l_suppkey AS display_order
        FROM lines JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
        WHERE c_nationkey = s_nationkey""",
    "r_followings": """
        SELECT DISTINCT o_custkey AS user_id, l_suppkey AS artist_id FROM lines WHERE o_orderpriority = '1-URGENT'""",
    "r_interested": """
        SELECT DISTINCT o_custkey AS user_id, l_partkey AS event_id FROM lines WHERE o_orderstatus = 'O'""",
    "r_bookings": """
        SELECT o_custkey AS user_id, l_partkey AS event_id,
          CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'active' ELSE 'upcoming' END AS status
        FROM lines""",
    "r_reviews": """
        SELECT l_partkey AS event_id, 1 + l_linenumber % 5 AS star_count FROM lineitem WHERE l_returnflag = 'R'""",
    "r_performances": """
        SELECT l_partkey AS event_id, l_suppkey AS artist_id, 'slot ' || l_linestatus AS genre
        FROM lineitem WHERE l_returnflag = 'A'""",
    "r_snapshots": """
        SELECT 'artist' AS entity_type, CAST(user_id AS VARCHAR) AS entity_id, value AS popularity_score,
          ts AS captured_at FROM events""",
}
_NEEDS = {
    "r_event_artists": ["lines"], "r_followings": ["lines"], "r_interested": ["lines"], "r_bookings": ["lines"],
}


def with_roles(names: str, body: str, extra: str = "") -> str:
    """SQL text: the named role CTEs, any extra CTEs, then the body."""
    wanted: list[str] = []
    for name in names.split():
        for need in [*_NEEDS.get(name, []), name]:
            if need not in wanted:
                wanted.append(need)
    ctes = [f"{name} AS ({ROLE_SQL[name].strip()})" for name in wanted]
    if extra:
        ctes.append(extra.strip().rstrip(","))
    body = body.strip()
    joint = "" if body.startswith(",") else "\n"  # a body may go on with its own CTEs
    return ("WITH " + ",\n".join(ctes) + joint if ctes else "") + body
