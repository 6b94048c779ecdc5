"""All named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (  # noqa: F401
    audit_queries,
    curation_queries,
    matching_queries,
    page_queries,
    recommend_queries,
    scoring_queries,
    streaming_queries,
    text_queries,
)
from .registry import ORACLES, QUERIES
from .roles import Roles

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring_queries.top_events(Roles(spark, sf_dir), 100)
