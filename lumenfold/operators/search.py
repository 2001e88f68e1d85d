"""Hybrid search: a text arm and a vector arm fused by reciprocal rank."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import iso_millis, snippet, term_frequency, text_score

RRF_K = 60
MAX_DISTANCE = 0.6


def depth_of(limit: int, depth: int | None = None) -> int:
    return depth if depth is not None else max(10 * limit, 200)


def restrict(items: DataFrame, since=None, links: DataFrame | None = None, source_id: str | None = None, state: DataFrame | None = None, user_id: str | None = None) -> DataFrame:
    """Filters of both arms, each added only when asked for.  Items are keyed
    by id; links and state by item_id."""
    if since is not None:
        items = items.filter(F.col("published_at") >= since)
    if source_id is not None:
        items = items.join(links.filter(F.col("source_id") == source_id).select(F.col("item_id").alias("id")), "id", "left_semi")
    if state is not None:
        read = state.filter((F.col("user_id") == user_id) & F.col("read_at").isNotNull()).select(F.col("item_id").alias("id"))
        items = items.join(read, "id", "left_anti")
    return items


def ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """Rank of at most `depth` rows that a top-k left; one task by design."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def text_arm(items: DataFrame, terms: list[str], depth: int) -> DataFrame:
    """(id, text_score, text_rank) of the best matches."""
    order = [F.desc("text_score"), F.desc("published_at"), F.asc("id")]
    top = (
        items.withColumn("text_score", text_score(F.col("search_text"), terms)).filter("text_score > 0")
        .select("id", "published_at", "text_score").orderBy(*order).limit(depth)
    )
    return ranked(top, order, "text_rank").select("id", "text_score", "text_rank")


def cosine_distance(a, b):
    """1 - cosine in double; null where a norm is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_distances(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """(id, distance) to the one query vector (a one-row frame, column qv)."""
    usable = vectors.filter("embedding is not null")
    joined = usable.crossJoin(F.broadcast(query.limit(1)))
    return joined.select(F.col("item_id").alias("id"), cosine_distance(F.col("embedding"), F.col("qv")).alias("distance")).filter("distance is not null")


def vector_arm(distances: DataFrame, depth: int, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """(id, distance, vector_rank); the ceiling is strict and commutes with the top-k."""
    order = [F.asc("distance"), F.asc("id")]
    top = distances.filter(F.col("distance") < max_distance).orderBy(*order).limit(depth)
    return ranked(top, order, "vector_rank")


def fuse(text: DataFrame, vector: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two arms; a missing rank counts nothing."""
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
    return text.join(vector, "id", "full_outer").withColumn("rrf", part("text_rank") + part("vector_rank"))


HIT_COLUMNS = ("id", "url", "title", "published_at", "summary", "snippet", "rrf", "text_rank", "vector_rank")


@dataclass
class SearchResult:
    """mode is `hybrid` or `text-only`, also where there are no hits."""

    mode: str
    hits: DataFrame


def _hits(top: DataFrame, terms: list[str]) -> DataFrame:
    """The columns of a hit; only the few hits are cut, marked and formatted."""
    return top.withColumn("snippet", snippet(F.col("search_text"), terms)).withColumn("published_at", iso_millis(F.col("published_at"))).select(*HIT_COLUMNS)


def _no_hits(items: DataFrame) -> DataFrame:
    empty = items.limit(0).withColumns({"rrf": F.lit(0.0), "text_rank": F.lit(0), "vector_rank": F.lit(0)})
    return _hits(empty, [])


def hybrid_search(
    items: DataFrame, distances: DataFrame, terms: list[str], limit: int = 20, depth: int | None = None, max_distance: float = MAX_DISTANCE, filtered: bool = True
) -> DataFrame:
    """Both arms, fused, then the wide columns joined back to the few hits.  The
    vector arm is restricted to `items` where these were `filtered`; otherwise
    its top rows find their items in the last join."""
    if not terms:
        return _no_hits(items)
    n = depth_of(limit, depth)
    inside = distances.join(items.select("id"), "id", "left_semi") if filtered else distances
    fused = fuse(text_arm(items, terms, n), vector_arm(inside, n, max_distance))
    wide = items.join(F.broadcast(fused), "id")  # at most two arms of `n` rows
    top = wide.orderBy(F.desc("rrf"), F.desc("published_at"), F.asc("id")).limit(limit)
    return _hits(top, terms).orderBy(F.desc("rrf"), F.desc("published_at"), F.asc("id"))


def text_only_search(items: DataFrame, terms: list[str], limit: int = 20, depth: int | None = None) -> DataFrame:
    """The text arm alone, in the same shape: one arm's rank orders as its fusion does."""
    if not terms:
        return _no_hits(items)
    arm = text_arm(items, terms, depth_of(limit, depth))
    top = items.join(F.broadcast(arm), "id").orderBy("text_rank").limit(limit)
    top = top.withColumn("rrf", F.lit(1.0) / (F.lit(float(RRF_K)) + F.col("text_rank"))).withColumn("vector_rank", F.lit(None).cast("int"))
    return _hits(top, terms).orderBy("text_rank")


def search(items: DataFrame, terms: list[str], distances: DataFrame | None = None, limit: int = 20, **options) -> SearchResult:
    """Hybrid where there are distances to a query vector, else text alone.  A
    query without terms has no hits, and the mode it would have with some."""
    if distances is None:
        return SearchResult("text-only", text_only_search(items, terms, limit))
    return SearchResult("hybrid", hybrid_search(items, distances, terms, limit, **options))


def text_scores(items: DataFrame, terms: list[str], limit: int = 20) -> DataFrame:
    """Raw occurrence counts, unnormalised."""
    return items.select("id", term_frequency(F.col("search_text"), terms).alias("tf")).filter("tf > 0").orderBy(F.desc("tf"), "id").limit(limit)
