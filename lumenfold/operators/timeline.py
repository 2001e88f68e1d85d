"""Timelines, reading state, prefixes and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_state(log: DataFrame) -> DataFrame:
    """Last row of each (user_id, item_id) of an append log."""
    fields = [c for c in log.columns if c not in ("user_id", "item_id")]
    stamp = F.struct("updated_at", *[F.coalesce(F.col(c), F.lit(None)).alias(c) for c in fields if c != "updated_at"])
    best = log.groupBy("user_id", "item_id").agg(F.max(stamp).alias("s"))
    return best.select("user_id", "item_id", *[F.col(f"s.{c}").alias(c) for c in fields])


def patch_state(log: DataFrame, patch: DataFrame, now) -> DataFrame:
    """Append a patch (user_id, item_id, field flags: true sets, false clears,
    null keeps) to the log as full rows."""
    fields = [c for c in patch.columns if c not in ("user_id", "item_id")]
    old = latest_state(log)
    joined = patch.alias("p").join(old.alias("o"), ["user_id", "item_id"], "left")
    cols = []
    for c in log.columns:
        if c in ("user_id", "item_id"):
            cols.append(F.col(c))
        elif c == "updated_at":
            cols.append(F.lit(now).cast("timestamp").alias(c))
        elif c in fields:
            cols.append(F.when(F.col(f"p.{c}").isNull(), F.col(f"o.{c}")).when(F.col(f"p.{c}"), F.lit(now).cast("timestamp")).alias(c))
        else:
            cols.append(F.col(f"o.{c}").alias(c))
    return log.unionByName(joined.select(*cols))


def timeline(items: DataFrame, links: DataFrame, state: DataFrame, user_id: str, unread: bool = True, source_id: str | None = None, limit: int = 50) -> DataFrame:
    """Newest linked items of a user, without bodies."""
    own = state.filter(F.col("user_id") == user_id).select(F.col("item_id").alias("id"), "read_at", "starred_at")
    if source_id is not None:
        links = links.filter(F.col("source_id") == source_id)
    # distinct by id alone: the other columns depend on it, so a semi join replaces inner join and DISTINCT
    rows = items.join(links.select(F.col("item_id").alias("id")), "id", "left_semi").join(own, "id", "left")
    if unread:
        rows = rows.filter("read_at is null")
    return rows.select("id", "url", "title", "author", "published_at", "published_at_estimated", "summary", "read_at", "starred_at").orderBy(F.desc("published_at"), "id").limit(limit)


def resolve_prefix(items: DataFrame, prefix: str) -> DataFrame:
    """(outcome, id) for a shortened id: found, ambiguous, missing or short."""
    p = prefix.strip().lower()
    spark = items.sparkSession
    if not p or any(c not in "0123456789abcdef" for c in p):
        return spark.createDataFrame([("missing", None)], "outcome string, id string")
    if len(p) < 8:
        return spark.createDataFrame([("short", None)], "outcome string, id string")
    hit = items.filter(F.col("id") == p if len(p) == 64 else F.col("id").startswith(p)).select("id").limit(2)
    n = hit.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    outcome = F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "found").otherwise("ambiguous")
    return n.select(outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("id")).alias("id"))


def due_sources(sources: DataFrame, now, limit: int) -> DataFrame:
    return sources.filter(F.col("status").isin("active", "degraded") & (F.col("next_fetch_at") <= now)).orderBy("next_fetch_at", "id").limit(limit)


def delete_source(sources: DataFrame, links: DataFrame, source_id: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the source; items stay."""
    return sources.filter(F.col("id") != source_id), links.filter(F.col("source_id") != source_id)


def health_counts(sources: DataFrame, items: DataFrame) -> DataFrame:
    s = sources.agg(F.count(F.lit(1)).alias("sources"), F.count_if(F.col("status") == "degraded").alias("degraded"))
    return s.crossJoin(F.broadcast(items.agg(F.count(F.lit(1)).alias("items"))))


def source_health(outcomes: DataFrame, threshold: int = 5) -> DataFrame:
    """Fold of fetch outcomes (source_id, seq, outcome) into (failures, status):
    the streak of failures since the last success; degraded from `threshold`."""
    w = Window.partitionBy("source_id").orderBy("seq")
    streak = F.sum(F.when(F.col("outcome") == "failed", 0).otherwise(1)).over(w)
    runs = outcomes.withColumn("run", streak)
    in_run = Window.partitionBy("source_id", "run").orderBy("seq")
    failures = F.sum(F.when(F.col("outcome") == "failed", 1).otherwise(0)).over(in_run)
    return runs.withColumn("failures", failures).select("source_id", "seq", "outcome", "failures", F.when(F.col("failures") >= threshold, "degraded").otherwise("active").alias("status"))
