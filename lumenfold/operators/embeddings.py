"""Embedding backlog: pending items, upserts, failures, counts, passes."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ingest import embed_backoff

MAX_WIDTH = 2000


def check_width(width) -> int:
    if not isinstance(width, int) or isinstance(width, bool) or not 1 <= width <= MAX_WIDTH:
        raise ValueError(f"vector width must be an integer from 1 to {MAX_WIDTH}")
    return width


def model_state(configured: tuple[str, str] | None, stored: tuple[str, str] | None) -> str:
    """disabled, uninitialised, ready or mismatch, from (provider, model)."""
    if configured is None:
        return "disabled"
    if stored is None:
        return "uninitialised"
    return "ready" if configured == stored else "mismatch"


def reindex(vectors: DataFrame, root: str, version: int, model: str | None = None, configured: str | None = None) -> str:
    """Write a full set of vectors of one width as a new version of the store
    and point to it last, so that readers see either the old set or the new.
    The caller names the configured model, or the reindex is refused; the new
    version has no failures."""
    if model != configured:
        raise ValueError(f"reindex is for {configured!r}, not {model!r}")
    widths = [r[0] for r in vectors.select(F.size("embedding")).distinct().limit(2).collect()]
    if len(widths) > 1:
        raise ValueError("vectors differ in width")
    for w in widths:
        check_width(w)
    path = f"{root}/v{version}"
    vectors.write.mode("errorifexists").parquet(path)
    pointer = vectors.sparkSession.createDataFrame([(version, path)], "version int, path string")
    pointer.coalesce(1).write.mode("overwrite").json(f"{root}/current")
    return path


def current_vectors(spark, root: str) -> DataFrame:
    return spark.read.parquet(spark.read.json(f"{root}/current").head()["path"])


def pending(items: DataFrame, vectors: DataFrame, failures: DataFrame | None, now, limit: int) -> DataFrame:
    """Newest items without a vector whose retry is due."""
    rows = items.join(vectors.select(F.col("item_id").alias("id")), "id", "left_anti")
    if failures is not None:
        waiting = failures.filter(F.col("next_attempt_at") > now).select(F.col("item_id").alias("id"))
        rows = rows.join(waiting, "id", "left_anti")
    return rows.orderBy(F.desc("published_at"), "id").limit(limit)


def upsert(vectors: DataFrame, batch: DataFrame) -> DataFrame:
    """Vectors after a batch (item_id, embedding, created_at) replaced or added."""
    both = vectors.select("item_id", "embedding", "created_at", F.lit(0).alias("v")).unionByName(batch.select("item_id", "embedding", "created_at", F.lit(1).alias("v")))
    return both.groupBy("item_id").agg(F.max_by(F.struct("embedding", "created_at"), F.struct("v", "created_at")).alias("s")).select("item_id", "s.embedding", "s.created_at")


def unnest_batch(batch: DataFrame, now) -> DataFrame:
    """Rows (item_id, embedding, created_at) of a batch of two bound arrays."""
    each = batch.select(F.explode(F.arrays_zip("item_ids", "vectors")).alias("x"))
    return each.select(F.col("x.item_ids").alias("item_id"), F.col("x.vectors").alias("embedding"), F.lit(now).alias("created_at"))


def clear_failures(failures: DataFrame, batch: DataFrame) -> DataFrame:
    """Failures without those of items that a batch has given a vector."""
    return failures.join(batch.select("item_id"), "item_id", "left_anti")


def record_failures(failures: DataFrame, batch: DataFrame, now) -> DataFrame:
    """Failures after a batch (item_id, error): counted up and rescheduled by
    the count before; errors keep 1,000 characters."""
    joined = failures.join(batch, "item_id", "full_outer")
    old = F.coalesce("failures", F.lit(0))
    failed = F.col("error").isNotNull()
    wait = F.when(old == 0, F.lit(60)).otherwise(embed_backoff(old + 1))
    return joined.select(
        "item_id", F.when(failed, old + 1).otherwise(old).alias("failures"),
        F.when(failed, F.substring("error", 1, 1000)).otherwise(F.col("last_error")).alias("last_error"),
        F.when(failed, F.timestamp_seconds(F.unix_timestamp(F.lit(now)) + wait)).otherwise(F.col("next_attempt_at")).alias("next_attempt_at"),
    )


def counts(items: DataFrame, vectors: DataFrame | None, failures: DataFrame | None = None, now=None) -> DataFrame:
    """(total, embedded, failed, pending): pending items have no vector and no
    retry that lies ahead; without a vector table all are."""
    total = items.agg(F.count(F.lit(1)).alias("total"))
    zero = F.lit(0).cast("long")
    if vectors is None:
        return total.select("total", zero.alias("embedded"), zero.alias("failed"), F.col("total").alias("pending"))
    embedded = vectors.agg(F.count(F.lit(1)).alias("embedded"))
    failed = failures.agg(F.count(F.lit(1)).alias("failed")) if failures is not None else embedded.select(zero.alias("failed"))
    waiting = items.select(F.col("id").alias("item_id")).join(vectors.select("item_id"), "item_id", "left_anti")
    if failures is not None:
        waiting = waiting.join(failures.filter(F.col("next_attempt_at") > (F.current_timestamp() if now is None else now)), "item_id", "left_anti")
    one_row = [embedded, failed, waiting.agg(F.count(F.lit(1)).alias("pending"))]
    for part in one_row:
        total = total.crossJoin(F.broadcast(part))  # one row each
    return total


class Rejected(Exception):
    """A provider's lasting refusal of the texts themselves.  Anything else, an
    outage, a limit, a shutdown, says nothing about them."""


def embed_pass(rows: DataFrame, provider: Callable[[list[str]], Iterable[list[float]]], batch_size: int = 32) -> DataFrame:
    """(item_id, embedding, error): batches go to the provider.  A batch that it
    Rejected is asked again text by text, so that one bad text does not fail its
    neighbours, and the texts it rejects alone have an error.  Every other
    exception ends the pass and leaves its items pending."""

    def run(batches):
        for pdf in batches:
            ids, texts = pdf["item_id"].tolist(), pdf["text"].tolist()
            out = []
            for lo in range(0, len(ids), batch_size):
                part = list(zip(ids[lo : lo + batch_size], texts[lo : lo + batch_size]))
                try:
                    out += _vectors(part, provider)
                except Rejected as refusal:
                    if len(part) == 1:
                        out.append((part[0][0], None, str(refusal)[:1000]))
                        continue
                    for one in part:
                        try:
                            out += _vectors([one], provider)
                        except Rejected as e:
                            out.append((one[0], None, str(e)[:1000]))
            yield pd.DataFrame(out, columns=["item_id", "embedding", "error"])

    return rows.select("item_id", "text").mapInPandas(run, "item_id string, embedding array<float>, error string")


def _vectors(part, provider):
    vectors = [list(v) for v in provider([t for _, t in part])]
    if len(vectors) != len(part):
        raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
    return [(i, v, None) for (i, _), v in zip(part, vectors)]


def pass_size(batch_size: int = 32, concurrency: int = 2) -> int:
    return batch_size * concurrency


def pass_totals(done: DataFrame) -> DataFrame:
    """(embedded, failed, idle) of a pass; idle if nothing was pending."""
    return done.agg(F.count("embedding").alias("embedded"), F.count("error").alias("failed"), (F.count(F.lit(1)) == 0).alias("idle"))


IDLE_SECONDS, BUSY_SECONDS = 30.0, 0.25


def embed_loop(one_pass: Callable[[], bool], stopped: Callable[[], bool], wait: Callable[[float], None]) -> int:
    """Run passes until stopped; each returns whether it was idle.  A pass that
    raises waits as an idle one.  Returns the number of passes."""
    passes = 0
    while not stopped():
        passes += 1
        try:
            idle = one_pass()
        except Exception:
            idle = True
        if not stopped():
            wait(IDLE_SECONDS if idle else BUSY_SECONDS)
    return passes
