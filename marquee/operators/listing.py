"""List views: filters, sorts, pages and top-k."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, or_empty

PAGE_SIZES = (10, 20, 50)
DEFAULT_PAGE_SIZE = 20


def order_columns(keys: list[tuple[str, bool]], tie: str) -> list[Column]:
    """Sort columns from (name, ascending) pairs, nulls last, ties by the id column."""
    out = [F.asc_nulls_last(k) if ascending else F.desc_nulls_last(k) for k, ascending in keys]
    return [*out, F.asc(tie)]


def top_ranked(df: DataFrame, keys: list[tuple[str, bool]], tie: str, limit: int) -> DataFrame:
    """The first rows in order, numbered. The window sees at most ``limit`` rows."""
    order = order_columns(keys, tie)
    best = df.orderBy(*order).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def top_per_group(
    df: DataFrame, group: list[str], keys: list[tuple[str, bool]], tie: str, limit: int, rank: str = "rank"
) -> DataFrame:
    """Top rows per group. Spark limits each partition's groups before the shuffle, so a hot group
    sends at most ``limit`` rows per task."""
    window = Window.partitionBy(*group).orderBy(*order_columns(keys, tie))
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= limit)


def clamp_page_size(size: int | None) -> int:
    return size if size in PAGE_SIZES else DEFAULT_PAGE_SIZE


def page_of(df: DataFrame, keys: list[tuple[str, bool]], tie: str, page: int, page_size: int | None) -> DataFrame:
    size = clamp_page_size(page_size)
    skip = (max(1, page) - 1) * size
    return df.orderBy(*order_columns(keys, tie)).offset(skip).limit(size)


def page_meta(df: DataFrame, page: int, page_size: int | None) -> DataFrame:
    """One row: page, page_size, total, total_pages."""
    size = clamp_page_size(page_size)
    total = F.count("*")
    return df.agg(
        F.lit(max(1, page)).alias("page"),
        F.lit(size).alias("page_size"),
        total.alias("total"),
        F.greatest(F.lit(1), F.ceil(total / size)).cast("long").alias("total_pages"),
    )


def has_more(offset: int, limit: int, total: Column) -> Column:
    return F.lit(offset + limit) < total


def total_pages(total: int, page_size: int) -> int:
    return max(1, math.ceil(total / page_size))


def matches_text(columns: list[str], needle: str) -> Column:
    """Case-insensitive substring search over any of the columns."""
    test = F.lit(False)
    for c in columns:
        test = test | F.contains(F.lower(or_empty(c)), F.lit(needle.lower()))
    return test


def is_active() -> Column:
    """Neither hidden nor absorbed into another event."""
    return ~F.coalesce("is_hidden", F.lit(False)) & F.col("merged_into_event_id").isNull()


def status_filter(status: str | None, include_ended: bool, statuses: list[str]) -> Column:
    if status in statuses:
        return F.col("status") == status
    return F.lit(True) if include_ended else F.col("status") != "ended"


def is_missing(column: str, null_only: bool = False) -> Column:
    return F.col(column).isNull() if null_only else is_blank(column)


def same_day(column: str, day: str) -> Column:
    return F.col(column).cast("date") == F.lit(day).cast("date")


def repeated_values(df: DataFrame, column: str) -> DataFrame:
    """The values that occur more than once, with their counts."""
    return df.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")


def list_entities(
    df: DataFrame,
    *,
    search: tuple[list[str], str] | None = None,
    filters: list[Column] = (),
    missing: str | None = None,
    missing_allowed: list[str] = (),
    null_only: list[str] = (),
    duplicates_of: str | None = None,
    sort_by: str | None = None,
    sort_allowed: list[str] = (),
    default_sort: str = "id",
    ascending: bool = False,
    tie: str = "id",
    page: int = 1,
    page_size: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """A filtered, sorted page and its meta row; every filter applies before the page is cut."""
    rows = df
    if search:
        rows = rows.filter(matches_text(*search))
    for condition in filters:
        rows = rows.filter(condition)
    if missing in missing_allowed:
        rows = rows.filter(is_missing(missing, missing in null_only))
    if duplicates_of:
        rows = rows.join(repeated_values(df, duplicates_of).select(duplicates_of), duplicates_of, "left_semi")
    key = sort_by if sort_by in sort_allowed else default_sort
    return page_of(rows, [(key, ascending)], tie, page, page_size), page_meta(rows, page, page_size)


def unlinked(entities: DataFrame, edges: DataFrame, edge_key: str, key: str = "id") -> DataFrame:
    """Entities without any edge."""
    return entities.join(edges.select(F.col(edge_key).alias(key)), key, "left_anti")


def admitted(candidates: DataFrame, queue: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates without a pending or processing task."""
    open_tasks = queue.filter(F.col("status").isin("pending", "processing")).select(*keys)
    return candidates.join(open_tasks, keys, "left_anti")


def first_seen(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first item per key. A min over a struct reduces map-side, so repeats never travel."""
    columns = [c for c in df.columns if c not in order]
    row = F.struct(*order, *columns)
    return (
        df.withColumn("_key", key).groupBy("_key").agg(F.min(row).alias("_row")).select("_row.*")
        .select(*df.columns)
    )


def latest_per_key(df: DataFrame, key: list[str], time: str, tie: str) -> DataFrame:
    """The newest row per key, reduced map-side."""
    rest = [c for c in df.columns if c not in (*key, time, tie)]
    row = F.struct(time, tie, *rest)
    return df.groupBy(*key).agg(F.max(row).alias("_row")).select(*key, "_row.*").select(*df.columns)
