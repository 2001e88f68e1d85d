"""Queries of the general data problem: timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.instants import normalise_instants
from ..session import table


def _records(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_items").select("raw_id", "item_id", "source_id", "fetched_at", "published_at_raw")
    sources = table(spark, d, "sources").select(F.col("id").alias("source_id"), "config")
    return raw.join(sources, "source_id", "left")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Raw records whose date, as the chain of their source reads it, is an
    instant one second or more away from published_at of their item."""
    read = normalise_instants(_records(spark, d), keep="item_id").filter("by_rule").select("raw_id", "item_id", "instant")
    items = table(spark, d, "items").select(F.col("id").alias("item_id"), "published_at")
    away = F.abs(F.unix_micros("instant") - F.unix_micros("published_at")) >= 1_000_000
    return read.join(items, "item_id").filter(away).select("raw_id")


def p1_instants(spark: SparkSession, d: str) -> DataFrame:
    """Every raw record with its one UTC instant (null when unreadable)."""
    read = normalise_instants(_records(spark, d))
    return read.select(
        "raw_id",
        F.when(F.col("by_rule"), F.col("instant")).alias("published_at"),
        F.when(F.col("by_rule"), F.col("format")).alias("format"),
        F.size("instants").alias("readings"),
    )


QUERIES = {"p1_found": p1_found, "p1_instants": p1_instants}
