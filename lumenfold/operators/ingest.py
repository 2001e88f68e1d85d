"""Ingest: normalising raw records, inserting what is new, change gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, search_text
from ..functions.urls import absolutize_html, canonical_url, with_resolved


def normalize_items(raw: DataFrame, base_col: str = "base") -> DataFrame:
    """Raw records as items; records without a usable URL are dropped.  `instant`
    is the parsed date, null where there is none.  Links of a body are made
    absolute against the item's own URL."""
    rows = with_resolved(raw, "url", base_col).filter("resolved is not null").withColumn("canonical_url", canonical_url(F.col("resolved")))
    return rows.select(
        F.sha2("canonical_url", 256).alias("id"), F.col("resolved").alias("url"), "canonical_url",
        clean_text(F.col("title")).alias("title"), clean_text(F.col("author")).alias("author"), F.nullif(F.trim("guid"), F.lit("")).alias("guid"),
        F.coalesce("instant", "fetched_at").alias("published_at"), (F.col("instant").isNull() | (F.col("instant") == F.col("fetched_at"))).alias("published_at_estimated"),
        F.when(F.col("content_html") != "", absolutize_html("content_html", "resolved")).alias("content_html"), clean_text(F.col("summary")).alias("summary"),
        search_text(clean_text(F.col("title")), F.col("content_html"), F.col("summary")).alias("search_text"), "fetched_at", "source_id",
    )


def new_items(batch: DataFrame, store: DataFrame, order: list) -> DataFrame:
    """First version of every id that the store lacks."""
    first = batch.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(*order))).filter("rn = 1").drop("rn")
    return first.join(store.select("id"), "id", "left_anti")


def change_gate(snapshots: DataFrame) -> DataFrame:
    """Whether each snapshot (source_id, at, hash) differs from the one before."""
    w = Window.partitionBy("source_id").orderBy("at", "hash")
    return snapshots.withColumn("changed", F.coalesce(F.lag("hash").over(w) != F.col("hash"), F.lit(True)))


def ingest_summary(polls: DataFrame) -> DataFrame:
    return polls.agg(F.count(F.lit(1)).alias("polled"), F.coalesce(F.sum("inserted"), F.lit(0)).alias("inserted"), F.count_if(F.col("status") == "failed").alias("failed"))


def opml_import(outlines: DataFrame, sources: DataFrame, user_id: str) -> DataFrame:
    """(imported, skipped) of subscribing to outlines the user does not have."""
    own = sources.filter(F.col("user_id") == user_id).select(F.col("url").alias("xml_url"))
    new = outlines.select("xml_url").distinct().join(own, "xml_url", "left_anti").agg(F.count(F.lit(1)).alias("imported"))
    return outlines.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(new)).select("imported", (F.col("n") - F.col("imported")).alias("skipped"))


def fetch_backoff(interval, failures, permanent):
    """Seconds to wait: the interval doubled per failure, at most a day."""
    steps = F.least(failures + F.when(permanent, 2).otherwise(0), F.lit(10))
    return F.least(interval * F.pow(F.lit(2.0), steps), F.lit(86400.0)).cast("long")


def embed_backoff(failures):
    return F.least(F.lit(60.0) * F.pow(F.lit(2.0), F.greatest(F.lit(0), F.least(failures - 1, F.lit(30)))), F.lit(86400.0)).cast("long")


def fetch_outcome(status, body_hash, last_hash):
    """unchanged (304, or the body seen last time), fetched, retry or failed:
    4xx other than 429 are permanent, everything else is worth another try."""
    return (
        F.when(status == 304, "unchanged")
        .when(status.between(200, 299) & body_hash.eqNullSafe(last_hash) & body_hash.isNotNull(), "unchanged")
        .when(status.between(200, 299), "fetched")
        .when(status.between(400, 499) & (status != 429), "failed")
        .otherwise("retry")
    )


def fetch_step(responses: DataFrame, sources: DataFrame, parsed: DataFrame, now, threshold: int = 5) -> DataFrame:
    """Bookkeeping of one poll, one row per polled source: outcome, and the
    source's next state (consecutive_failures, status, content_hash, etag,
    last_modified, wait in seconds, last_fetched_at, last_success_at, last_error).

    responses: source_id, status (null where nothing came back), body_hash, etag,
    last_modified, error.  parsed: source_id, ok.  sources: id and its state.  A
    304 or a known body is unchanged; what cannot be parsed is worth a retry; a
    source degrades at `threshold` failures in a row and recovers at once.
    Validators move only with a body that was taken in, so items are to be
    written before this is."""
    s = sources.select(
        F.col("id").alias("source_id"), F.col("consecutive_failures").alias("before"), F.col("status").alias("was"), F.col("content_hash").alias("hash_before"),
        F.col("etag").alias("etag_before"), F.col("last_modified").alias("modified_before"), "fetch_interval_seconds", F.col("last_success_at").alias("success_before"),
    )
    rows = responses.join(s, "source_id").join(parsed.select("source_id", "ok"), "source_id", "left")
    answer = fetch_outcome(F.coalesce("status", F.lit(0)), F.col("body_hash"), F.col("hash_before"))
    outcome = F.when((answer == "fetched") & ~F.coalesce("ok", F.lit(False)), "retry").otherwise(answer)
    rows = rows.withColumn("outcome", outcome)
    bad = F.col("outcome").isin("failed", "retry")
    failures = F.when(bad, F.col("before") + 1).otherwise(0)
    taken = F.col("outcome") == "fetched"
    return rows.select(
        "source_id", "outcome", failures.alias("consecutive_failures"),
        F.when(bad & (failures >= threshold), "degraded").when(~bad & (F.col("was") == "degraded"), "active").otherwise(F.col("was")).alias("status"),
        F.when(taken, F.col("body_hash")).otherwise(F.col("hash_before")).alias("content_hash"),
        F.when(taken, F.coalesce("etag", "etag_before")).otherwise(F.col("etag_before")).alias("etag"),
        F.when(taken, F.coalesce("last_modified", "modified_before")).otherwise(F.col("modified_before")).alias("last_modified"),
        F.when(bad, fetch_backoff(F.col("fetch_interval_seconds"), failures, F.col("outcome") == "failed")).otherwise(F.col("fetch_interval_seconds").cast("long")).alias("wait"),
        F.lit(now).alias("last_fetched_at"), F.when(bad, F.col("success_before")).otherwise(F.lit(now)).alias("last_success_at"),
        F.when(bad, F.coalesce("error", F.when(F.col("status").between(200, 299), "parse failed").otherwise(F.concat(F.lit("HTTP "), F.col("status"))))).alias("last_error"),
    )


JITTER = 0.1


def next_fetch(now, wait, seed: int | None = None):
    """The instant of the next fetch: `wait` seconds from now, a tenth more or
    less by chance, so that sources added at once do not stay in step."""
    spread = 1 + JITTER * (F.rand(seed) * 2 - 1)
    return F.timestamp_micros((F.unix_micros(now) + wait * spread * 1_000_000).cast("long"))


def subscribe(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """(user_id, url, outcome) for each requested subscription: `created`, or
    `already subscribed` where the user has the URL or asks for it again."""
    first = F.row_number().over(Window.partitionBy("user_id", "url").orderBy(F.lit(0))) == 1
    rows = requests.select("user_id", "url").withColumn("first", first)
    known = sources.select("user_id", "url").distinct().withColumn("known", F.lit(True))
    return rows.join(known, ["user_id", "url"], "left").select(
        "user_id", "url", F.when(F.col("known").isNull() & F.col("first"), "created").otherwise("already subscribed").alias("outcome")
    )
