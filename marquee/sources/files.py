"""CSV export and the dry-run, approve, apply exchange of JSON plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the user export, in order.
USER_EXPORT = [
    "id", "display_name", "email", "role", "last_visit_date", "booking_count", "following_count", "created_at",
    "account_status",
]


def export_users(users: DataFrame, path: str) -> None:
    """CSV with doubled quotes; the first header cell carries the byte-order mark spreadsheets expect."""
    text = users.select(*[F.col(c).cast("string").alias(c) for c in USER_EXPORT])
    marked = text.withColumnRenamed(USER_EXPORT[0], "\ufeff" + USER_EXPORT[0])
    marked.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_plan(plan: DataFrame, path: str) -> None:
    """A dry run's plan, for people to review."""
    plan.write.mode("overwrite").json(path)


def read_plan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def approved(plan: DataFrame, decisions: DataFrame, key: list[str]) -> DataFrame:
    """The part of a plan that was approved."""
    return plan.join(decisions.filter(F.col("approved")).select(*key), key, "left_semi")
