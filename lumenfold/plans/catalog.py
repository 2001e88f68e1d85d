"""Driver queries of the search, serving and ingest operators, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net, text, urls
from ..functions import date_text
from ..operators import embeddings, ingest, requests, search, timeline
from ..session import table
from ..sources import feeds

TERMS = ["compiler", "database", "データベース"]
NOW = "2026-08-10 00:00:00"
SINCE = "2025-06-01 00:00:00"
LIMIT = 20
_SQL_BLANK = r"[\t\n\x0B\f\r\x20\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _now():
    return F.to_timestamp(F.lit(NOW))


def _one_source(spark, d):
    return table(spark, d, "sources").agg(F.min("id")).head()[0]


def _one_user(spark, d):
    return table(spark, d, "sources").agg(F.min("user_id")).head()[0]


# ---- SQL building blocks ----------------------------------------------------

_TF = (
    "len(list_filter(regexp_split_to_array(lower(search_text), '[^a-z0-9]+'), lambda x: x = 'compiler'))"
    " + len(list_filter(regexp_split_to_array(lower(search_text), '[^a-z0-9]+'), lambda x: x = 'database'))"
    " + CAST((length(lower(search_text)) - length(replace(lower(search_text), 'データベース', ''))) / 6 AS BIGINT)"
)
_SCORE = f"CAST({_TF} AS DOUBLE) / sqrt(CAST(greatest(length(search_text), 1) AS DOUBLE))"
_TEXT_ARM = f"""text_top AS (SELECT id, published_at, {_SCORE} AS text_score FROM base WHERE ({_TF}) > 0
 ORDER BY text_score DESC, published_at DESC, id LIMIT 200),
 text_arm AS (SELECT id, text_score, row_number() OVER (ORDER BY text_score DESC, published_at DESC, id) AS text_rank FROM text_top)"""
_DOT = "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
_QV = """qv AS (SELECT embedding AS q FROM item_embeddings WHERE item_id =
 (SELECT min(item_id) FROM item_embeddings WHERE embedding IS NOT NULL AND list_max(embedding) <> 0))"""
_DIST = f"""dist AS (SELECT item_id AS id, 1 - {_DOT.format('embedding', 'q')} / nullif(sqrt({_DOT.format('embedding', 'embedding')})
 * sqrt({_DOT.format('q', 'q')}), 0) AS distance FROM item_embeddings, qv WHERE embedding IS NOT NULL)"""


def _vector_arm_sql(ceiling: float) -> str:
    return f"""vec_top AS (SELECT id, distance FROM dist WHERE distance < {ceiling} AND id IN (SELECT id FROM base)
 ORDER BY distance, id LIMIT 200), vector_arm AS (SELECT id, distance, row_number() OVER (ORDER BY distance, id) AS vector_rank FROM vec_top)"""


_FUSED = """fused AS (SELECT coalesce(t.id, v.id) AS id, text_rank, vector_rank, coalesce(1.0::DOUBLE / (60 + text_rank), 0) + coalesce(1.0::DOUBLE / (60 + vector_rank), 0) AS rrf
 FROM text_arm t FULL OUTER JOIN vector_arm v ON t.id = v.id)"""
_BASE = "base AS (SELECT * FROM items)"


_ISO = "strftime({0} AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%gZ')"
_AT = """least(nullif(length(regexp_extract(' ' || lower(search_text) || ' ', '(?s)^(.*?[^a-z0-9])compiler[^a-z0-9]', 1)), 0),
 nullif(length(regexp_extract(' ' || lower(search_text) || ' ', '(?s)^(.*?[^a-z0-9])database[^a-z0-9]', 1)), 0), nullif(strpos(lower(search_text), 'データベース'), 0))"""
_CUT = f"substr(search_text, CAST(greatest({_AT} - 80, 1) AS BIGINT), 160)"
_SNIPPET = f"""CASE WHEN {_AT} IS NOT NULL THEN replace(replace(replace(replace(replace(replace(
 regexp_replace({_CUT}, '(?i)(データベース|\\bcompiler\\b|\\bdatabase\\b)', chr(57344) || '\\1' || chr(57345), 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'),
 chr(57344), '<span class="keyword">'), chr(57345), '</span>') END"""
_HIT = f"b.id, b.url, b.title, {_ISO.format('b.published_at')} AS published_at, b.summary, {_SNIPPET} AS snippet"


def _hybrid_sql(base: str = _BASE) -> str:
    return f"""WITH {base}, {_TEXT_ARM}, {_QV}, {_DIST}, {_vector_arm_sql(0.9)}, {_FUSED}
 SELECT {_HIT}, round(f.rrf, 6) AS rrf, text_rank, vector_rank, 'hybrid' AS mode FROM fused f JOIN base b ON b.id = f.id
 ORDER BY f.rrf DESC, b.published_at DESC, f.id LIMIT {LIMIT}"""


# ---- search -------------------------------------------------------------------

def _items(spark, d):
    return table(spark, d, "items").select("id", "url", "title", "summary", "search_text", "published_at")


def _query_vector(spark, d):
    v = table(spark, d, "item_embeddings").filter("embedding is not null").filter(F.array_max("embedding") != 0)
    return v.agg(F.min_by("embedding", "item_id").alias("qv"))


def _distances(spark, d):
    return search.vector_distances(table(spark, d, "item_embeddings"), _query_vector(spark, d))


@query(f"SELECT id, {_TF} AS tf FROM items WHERE ({_TF}) > 0")
def text_match(spark: SparkSession, d: str) -> DataFrame:
    tf = text.term_frequency(F.col("search_text"), TERMS)
    return _items(spark, d).select("id", tf.cast("long").alias("tf")).filter("tf > 0")


@query(f"SELECT id, {_TF} AS tf FROM items WHERE ({_TF}) > 0 ORDER BY tf DESC, id LIMIT {LIMIT}")
def text_scores(spark, d):
    return search.text_scores(_items(spark, d), TERMS, LIMIT).select("id", F.col("tf").cast("long").alias("tf"))


@query(f"WITH {_BASE}, {_TEXT_ARM} SELECT id, round(text_score, 6) AS text_score, text_rank FROM text_arm")
def text_arm(spark, d):
    arm = search.text_arm(_items(spark, d), TERMS, search.depth_of(LIMIT))
    return arm.select("id", F.round("text_score", 6).alias("text_score"), F.col("text_rank").cast("long").alias("text_rank"))


def _rows(result: search.SearchResult) -> DataFrame:
    ranks = {c: F.col(c).cast("long") for c in ("text_rank", "vector_rank")}
    return result.hits.withColumns({**ranks, "rrf": F.round("rrf", 6), "mode": F.lit(result.mode)})


@query(f"""WITH {_BASE}, {_TEXT_ARM} SELECT {_HIT}, round(1.0::DOUBLE / (60 + text_rank), 6) AS rrf, text_rank, CAST(NULL AS BIGINT) AS vector_rank, 'text-only' AS mode
 FROM text_arm t JOIN base b ON b.id = t.id ORDER BY text_rank LIMIT {LIMIT}""")
def text_only_search(spark, d):
    return _rows(search.search(_items(spark, d), TERMS, limit=LIMIT))


@query(f"WITH {_BASE} SELECT {_HIT}, 0.0::DOUBLE AS rrf, CAST(NULL AS BIGINT) AS text_rank, CAST(NULL AS BIGINT) AS vector_rank, 'hybrid' AS mode FROM base b LIMIT 0")
def empty_search(spark, d):
    return _rows(search.search(_items(spark, d), text.search_terms("  "), _distances(spark, d), LIMIT))


@query(f"WITH {_QV}, {_DIST} SELECT id, round(distance, 6) AS distance FROM dist WHERE distance IS NOT NULL ORDER BY dist.distance, id LIMIT 200")
def vector_topk(spark, d):
    return _distances(spark, d).orderBy("distance", "id").limit(200).select("id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_BASE}, {_QV}, {_DIST}, {_vector_arm_sql(0.9)} SELECT id, round(distance, 6) AS distance, vector_rank FROM vector_arm")
def vector_arm(spark, d):
    inside = _distances(spark, d).join(_items(spark, d).select("id"), "id", "left_semi")
    arm = search.vector_arm(inside, 200, 0.9)
    return arm.select("id", F.round("distance", 6).alias("distance"), F.col("vector_rank").cast("long").alias("vector_rank"))


@query(f"WITH {_BASE}, {_QV}, {_DIST}, {_vector_arm_sql(0.6)} SELECT id, vector_rank FROM vector_arm")
def vector_ceiling(spark, d):
    return search.vector_arm(_distances(spark, d).join(_items(spark, d).select("id"), "id", "left_semi"), 200).select("id", F.col("vector_rank").cast("long").alias("vector_rank"))


@query(f"WITH {_BASE}, {_TEXT_ARM}, {_QV}, {_DIST}, {_vector_arm_sql(0.9)}, {_FUSED} SELECT id, text_rank, vector_rank, round(rrf, 6) AS rrf FROM fused")
def rrf_fuse(spark, d):
    items = _items(spark, d)
    inside = _distances(spark, d).join(items.select("id"), "id", "left_semi")
    fused = search.fuse(search.text_arm(items, TERMS, 200), search.vector_arm(inside, 200, 0.9))
    return fused.select("id", F.col("text_rank").cast("long").alias("text_rank"), F.col("vector_rank").cast("long").alias("vector_rank"), F.round("rrf", 6).alias("rrf"))


def _hybrid(spark, d, items, filtered=True):
    return _rows(search.search(items, TERMS, _distances(spark, d), LIMIT, max_distance=0.9, filtered=filtered))


@query(_hybrid_sql())
def hybrid_search(spark, d):
    return _hybrid(spark, d, _items(spark, d), filtered=False)


@query(_hybrid_sql(f"base AS (SELECT * FROM items WHERE published_at >= TIMESTAMPTZ '{SINCE}+00')"))
def filter_since(spark, d):
    return _hybrid(spark, d, search.restrict(_items(spark, d), since=F.to_timestamp(F.lit(SINCE))))


@query(_hybrid_sql("base AS (SELECT * FROM items i WHERE EXISTS (SELECT 1 FROM item_sources s WHERE s.item_id = i.id AND s.source_id = (SELECT min(id) FROM sources)))"))
def filter_source(spark, d):
    return _hybrid(spark, d, search.restrict(_items(spark, d), links=table(spark, d, "item_sources"), source_id=_one_source(spark, d)))


@query(_hybrid_sql("base AS (SELECT * FROM items i WHERE NOT EXISTS (SELECT 1 FROM item_state s WHERE s.item_id = i.id AND s.user_id = (SELECT min(user_id) FROM sources) AND s.read_at IS NOT NULL))"))
def filter_unread(spark, d):
    return _hybrid(spark, d, search.restrict(_items(spark, d), state=table(spark, d, "item_state"), user_id=_one_user(spark, d)))


@query(f"SELECT id, {_SNIPPET} AS snippet FROM items WHERE {_AT} IS NOT NULL")
def snippet(spark, d):
    items = _items(spark, d)
    return items.select("id", text.snippet(F.col("search_text"), TERMS).alias("snippet")).filter("snippet is not null")


@query(f"SELECT id, trim(regexp_replace({_CUT}, '{_SQL_BLANK}', ' ', 'g')) AS text FROM items WHERE {_AT} IS NOT NULL")
def snippet_text(spark, d):
    return snippet(spark, d).select("id", text.snippet_text("snippet").alias("text"))


@query("SELECT unnest(['Rust', 'release', '機械学習の論文']) AS term, unnest([0, 1, 2]) AS position")
def search_terms(spark, d):
    return spark.createDataFrame([(t, i) for i, t in enumerate(text.search_terms("  Rust \n\t release 機械学習の論文 "))], "term string, position int")


@query(f"""SELECT substr(id, 1, 8) AS short_id, CASE WHEN s < 3600 THEN CAST(CAST(round(s / 60.0) AS INT) AS VARCHAR) || 'm' WHEN s < 86400 THEN CAST(CAST(round(s / 3600.0) AS INT) AS VARCHAR) || 'h'
 ELSE CAST(CAST(round(s / 86400.0) AS INT) AS VARCHAR) || 'd' END AS age, strftime(published_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%gZ') AS published
 FROM (SELECT *, CAST(floor(epoch(TIMESTAMPTZ '{NOW}+00')) AS BIGINT) - CAST(floor(epoch(published_at)) AS BIGINT) AS s FROM items)""")
def search_listing(spark, d):
    return table(spark, d, "items").select(F.substring("id", 1, 8).alias("short_id"), text.age(F.col("published_at"), _now()).alias("age"), text.iso_millis(F.col("published_at")).alias("published"))


# ---- serving --------------------------------------------------------------------

_TIMELINE = """WITH st AS (SELECT item_id, arg_max(struct_pack(r := read_at, s := starred_at), updated_at) AS v FROM item_state WHERE user_id = (SELECT min(user_id) FROM sources) GROUP BY item_id)
 SELECT DISTINCT i.id, i.url, i.title, epoch_us(i.published_at) AS published_us, i.published_at_estimated, epoch_us(v.s) AS starred_us FROM items i JOIN item_sources l ON l.item_id = i.id
 LEFT JOIN st ON st.item_id = i.id WHERE v.r IS NULL ORDER BY published_us DESC, i.id LIMIT 50"""


@query(_TIMELINE)
def timeline_unread(spark, d):
    state = timeline.latest_state(table(spark, d, "item_state"))
    rows = timeline.timeline(table(spark, d, "items"), table(spark, d, "item_sources"), state, _one_user(spark, d))
    return rows.select("id", "url", "title", F.unix_micros("published_at").alias("published_us"), "published_at_estimated", F.unix_micros("starred_at").alias("starred_us"))


@query("""WITH s AS (SELECT min(id) AS s FROM sources) SELECT i.id, i.url, i.title, i.author, epoch_us(i.published_at) AS published_us, i.published_at_estimated, i.summary FROM items i
 WHERE EXISTS (SELECT 1 FROM item_sources l, s WHERE l.item_id = i.id AND l.source_id = s.s) ORDER BY i.published_at DESC, i.id LIMIT 50""")
def timeline_source(spark, d):
    state = timeline.latest_state(table(spark, d, "item_state"))
    asked = requests.list_request(unread="false", source_id=_one_source(spark, d))
    rows = timeline.timeline(table(spark, d, "items"), table(spark, d, "item_sources"), state, _one_user(spark, d), asked.unread, asked.source_id, asked.limit)
    return rows.select("id", "url", "title", "author", F.unix_micros("published_at").alias("published_us"), "published_at_estimated", "summary")


@query("""WITH c AS (SELECT 'missing' AS outcome, NULL AS id UNION ALL SELECT 'short', NULL UNION ALL SELECT CASE WHEN count(*) > 1 THEN 'ambiguous' WHEN count(*) = 1 THEN 'found' ELSE 'missing' END, CASE WHEN count(*) = 1 THEN min(id) END
 FROM items WHERE starts_with(id, (SELECT substr(min(id), 1, 8) FROM items)) UNION ALL SELECT 'found', max(id) FROM items UNION ALL SELECT 'missing', NULL) SELECT outcome, id FROM c""")
def resolve_prefix_cases(spark, d):
    """No hex, too short, eight digits, a whole id in capitals, and no such id."""
    items = table(spark, d, "items")
    ends = items.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).head()
    out = None
    for prefix in ("xyz", ends["lo"][:7], ends["lo"][:8], f" {ends['hi'].upper()} ", "0" * 64):
        one = timeline.resolve_prefix(items, prefix)
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH p AS (SELECT substr(min(id), 1, 12) AS p FROM items), h AS (SELECT count(*) AS n, min(id) AS id FROM items, p WHERE id LIKE p || '%')
 SELECT CASE WHEN n = 0 THEN 'missing' WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS outcome, CASE WHEN n = 1 THEN id END AS id FROM h""")
def resolve_prefix(spark, d):
    items = table(spark, d, "items")
    return timeline.resolve_prefix(items, items.agg(F.min("id")).head()[0][:12])


@query("SELECT user_id, item_id, epoch_us(max(updated_at)) AS updated_us FROM item_state GROUP BY user_id, item_id")
def item_state_latest(spark, d):
    return timeline.latest_state(table(spark, d, "item_state")).select("user_id", "item_id", F.unix_micros("updated_at").alias("updated_us"))


@query("SELECT id, kind, url, title, epoch_us(created_at) AS created_us FROM sources ORDER BY created_at, id")
def list_sources(spark, d):
    return table(spark, d, "sources").orderBy("created_at", "id").select("id", "kind", "url", "title", F.unix_micros("created_at").alias("created_us"))


@query(f"SELECT id, epoch_us(next_fetch_at) AS next_us FROM sources WHERE status IN ('active', 'degraded') AND next_fetch_at <= TIMESTAMPTZ '{NOW}+00' ORDER BY next_fetch_at, id LIMIT 100")
def due_sources(spark, d):
    return timeline.due_sources(table(spark, d, "sources"), _now(), 100).select("id", F.unix_micros("next_fetch_at").alias("next_us"))


@query("SELECT (SELECT count(*) FROM sources) AS sources, (SELECT count(*) FROM sources WHERE status = 'degraded') AS degraded, (SELECT count(*) FROM items) AS items")
def health_counts(spark, d):
    return timeline.health_counts(table(spark, d, "sources"), table(spark, d, "items"))


def _failures(spark, d):
    """A failures table: items that somebody skipped, due again a year after."""
    skipped = table(spark, d, "item_state").filter("skipped_at is not null").groupBy("item_id").agg(F.max("skipped_at").alias("at"))
    return skipped.select("item_id", F.lit(1).alias("failures"), F.lit("x").alias("last_error"), F.timestamp_seconds(F.unix_timestamp("at") + 31_536_000).alias("next_attempt_at"))


_FAILED = "f AS (SELECT item_id, to_timestamp(floor(epoch(max(skipped_at))) + 31536000) AS due FROM item_state WHERE skipped_at IS NOT NULL GROUP BY item_id)"
_OPEN = f"id NOT IN (SELECT item_id FROM item_embeddings) AND id NOT IN (SELECT item_id FROM f WHERE due > TIMESTAMPTZ '{NOW}+00')"


@query(f"""WITH {_FAILED} SELECT (SELECT count(*) FROM items) AS total, (SELECT count(*) FROM item_embeddings) AS embedded, (SELECT count(*) FROM f) AS failed, (SELECT count(*) FROM items WHERE {_OPEN}) AS pending""")
def embedding_counts(spark, d):
    return embeddings.counts(table(spark, d, "items"), table(spark, d, "item_embeddings"), _failures(spark, d), _now())


@query("SELECT count(*) AS total, CAST(0 AS BIGINT) AS embedded, CAST(0 AS BIGINT) AS failed, count(*) AS pending FROM items")
def embedding_counts_without_vectors(spark, d):
    return embeddings.counts(table(spark, d, "items"), None)


@query(f"WITH {_FAILED} SELECT id, epoch_us(published_at) AS published_us FROM items WHERE {_OPEN} ORDER BY published_at DESC, id LIMIT 64")
def pending_embeddings(spark, d):
    rows = embeddings.pending(table(spark, d, "items"), table(spark, d, "item_embeddings"), _failures(spark, d), _now(), embeddings.pass_size())
    return rows.select("id", F.unix_micros("published_at").alias("published_us"))


@query(f"WITH {_FAILED} SELECT item_id, epoch_us(due) AS due_us FROM f WHERE item_id NOT IN (SELECT item_id FROM item_embeddings)")
def embedding_failures_cleared(spark, d):
    left = embeddings.clear_failures(_failures(spark, d), table(spark, d, "item_embeddings"))
    return left.select("item_id", F.unix_micros("next_attempt_at").alias("due_us"))


@query("SELECT DISTINCT item_id, 2 AS width FROM item_sources")
def unnest_batch(spark, d):
    """Batches of items with a vector each (few share six digits of their id), as rows."""
    ids = table(spark, d, "item_sources").select("item_id").distinct()
    batches = ids.groupBy(F.substring("item_id", 1, 6).alias("batch")).agg(F.collect_list("item_id").alias("item_ids"))
    batches = batches.withColumn("vectors", F.transform("item_ids", lambda x: F.array(F.lit(0.0), F.length(x).cast("double"))))
    return embeddings.unnest_batch(batches, _now()).select("item_id", F.size("embedding").alias("width"))


def _length_vector(texts):
    if any("%" in t for t in texts):
        raise embeddings.Rejected("percent sign")
    return [[float(len(t)), 1.0] for t in texts]


@query("""SELECT sum((t NOT LIKE '%\\%%' ESCAPE '\\')::BIGINT)::BIGINT AS embedded, sum((t LIKE '%\\%%' ESCAPE '\\')::BIGINT)::BIGINT AS failed, false AS idle FROM (SELECT search_text AS t FROM items)""")
def embed_pass(spark, d):
    """A pass over all items with a provider that rejects texts with a per cent sign."""
    rows = table(spark, d, "items").select(F.col("id").alias("item_id"), F.col("search_text").alias("text"))
    return embeddings.pass_totals(embeddings.embed_pass(rows, _length_vector))


@query("SELECT item_id, source_id, epoch_us(first_seen_at) AS seen_us FROM item_sources WHERE source_id <> (SELECT min(id) FROM sources)")
def source_delete(spark, d):
    _, links = timeline.delete_source(table(spark, d, "sources"), table(spark, d, "item_sources"), _one_source(spark, d))
    return links.select("item_id", "source_id", F.unix_micros("first_seen_at").alias("seen_us"))


# ---- normalisation ----------------------------------------------------------------

@query("SELECT id, sha256(search_text) AS hash FROM items")
def content_hash(spark, d):
    return table(spark, d, "items").select("id", F.sha2("search_text", 256).alias("hash"))


_NOISE = " OR ".join(["lower(split_part(p, '=', 1)) IN (" + ", ".join(f"'{n}'" for n in urls.TRACKING_NAMES) + ")"] + [f"starts_with(lower(split_part(p, '=', 1)), '{x}')" for x in urls.TRACKING_PREFIXES])
_CANON = f"""WITH u AS (SELECT id, regexp_extract(url, '^(https?)://([^/?#:]*)(:[0-9]*)?([^?#]*)(?:\\?([^#]*))?', ['scheme', 'host', 'port', 'path', 'query']) AS p FROM items),
 q AS (SELECT id, p, array_to_string(list_sort(list_filter(string_split(p.query, '&'), lambda p: p <> '' AND NOT ({_NOISE}))), '&') AS kept FROM u)
 SELECT id, 'https://' || lower(p.host) || CASE WHEN length(p.path) > 1 AND p.path LIKE '%/' THEN substr(p.path, 1, length(p.path) - 1) WHEN p.path = '' THEN '/' ELSE p.path END
 || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS canonical FROM q"""


@query(_CANON)
def canonical_url(spark, d):
    return table(spark, d, "items").select("id", urls.canonical_url(F.col("url")).alias("canonical"))


@query("SELECT id, sha256(canonical_url) AS identity FROM items")
def item_identity(spark, d):
    return table(spark, d, "items").select("id", urls.item_identity(F.col("url")).alias("identity"))


_KEPT_PARTS = f"list_filter(string_split(p.query, '&'), lambda x: x <> '')"
_CLEAN_PARTS = f"list_filter(string_split(p.query, '&'), lambda p: p <> '' AND NOT ({_NOISE}))"
_RAW_URL = f"""raw AS (SELECT r.*, coalesce(s.site_url, s.url) AS base FROM raw_items r LEFT JOIN sources s ON s.id = r.source_id),
 joined AS (SELECT *, CASE WHEN url LIKE 'http%' THEN url WHEN url LIKE '/%' THEN regexp_extract(base, '^(https?://[^/?#]+)', 1) || url ELSE regexp_extract(base, '^(https?://[^/?#]+(?:/[^?#]*/)?)', 1) || CASE WHEN regexp_matches(base, '^https?://[^/?#]+/[^?#]*/') THEN '' ELSE '/' END || url END AS whole FROM raw),
 split AS (SELECT *, regexp_extract(trim(whole), '(?i)^(https?)://([^/?#:]*)(:[0-9]*)?([^?#]*)(?:\\?([^#]*))?(#.*)?', ['scheme', 'host', 'port', 'path', 'query', 'hash']) AS p FROM joined),
 resolved AS (SELECT *, {_CLEAN_PARTS} AS clean FROM split),
 web AS (SELECT *, lower(p.scheme) || '://' || lower(p.host) || p.port || CASE WHEN p.path = '' THEN '/' ELSE p.path END
 || CASE WHEN len(clean) = len({_KEPT_PARTS}) THEN CASE WHEN p.query = '' THEN '' ELSE '?' || p.query END WHEN len(clean) = 0 THEN '' ELSE '?' || array_to_string(clean, '&') END || p.hash AS resolved FROM resolved)"""


@query(f"WITH {_RAW_URL} SELECT raw_id, resolved FROM web")
def resolve_url(spark, d):
    return urls.with_resolved(_raw_with_base(spark, d), "url", "base").select("raw_id", "resolved")


def _raw_with_base(spark, d):
    sources = table(spark, d, "sources").select(F.col("id").alias("source_id"), F.coalesce("site_url", "url").alias("base"))
    return table(spark, d, "raw_items").join(sources, "source_id", "left")


@query(f"SELECT raw_id, nullif(trim(regexp_replace(title, '{_SQL_BLANK}', ' ', 'g')), '') AS title FROM raw_items")
def clean_text(spark, d):
    return table(spark, d, "raw_items").select("raw_id", text.clean_text(F.col("title")).alias("title"))


@query(f"""SELECT id, trim(regexp_replace(concat_ws(' ', coalesce(title, ''), regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(content_html, summary, ''), '(?is)<script.*?</script>', ' ', 'g'),
 '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&(?:nbsp|amp|lt|gt|quot|#[0-9]+);', ' ', 'g')), '{_SQL_BLANK}', ' ', 'g')) AS search_text FROM items""")
def search_text(spark, d):
    return table(spark, d, "items").select("id", text.search_text(F.col("title"), F.col("content_html"), F.col("summary")).alias("search_text"))


@query(f"SELECT id, substr(trim(regexp_replace(concat_ws(chr(10) || chr(10), title, search_text), '{_SQL_BLANK}', ' ', 'g')), 1, 8000) AS input FROM items")
def embedding_input(spark, d):
    return table(spark, d, "items").select("id", text.embedding_input(F.col("title"), F.col("search_text")).alias("input"))


def _dated(spark, d, pattern: str):
    """Raw dates of one form, with what their source's config says."""
    config = table(spark, d, "sources").select(F.col("id").alias("source_id"), F.get_json_object("config", "$.date_order").alias("order"), F.get_json_object("config", "$.tz").alias("tz"))
    raw = table(spark, d, "raw_items").filter(F.col("published_at_raw").rlike(pattern)).join(config, "source_id", "left")
    instant = date_text.parse_date(F.col("published_at_raw"), F.col("fetched_at"), F.col("order"), F.col("tz"))
    return raw.select("raw_id", F.unix_micros(instant).alias("us"))


def _dated_sql(pattern: str, instant: str) -> str:
    """SQL of the same: readings before 2000 or over a day ahead are null."""
    return f"""WITH r AS (SELECT raw_id, fetched_at, trim(published_at_raw) AS t, json_extract_string(config, '$.tz') AS tz, coalesce(json_extract_string(config, '$.date_order'), 'dmy') AS o
 FROM raw_items LEFT JOIN sources ON sources.id = source_id WHERE regexp_matches(published_at_raw, '{pattern}')), i AS (SELECT raw_id, fetched_at, {instant} AS x FROM r)
 SELECT raw_id, CASE WHEN x >= TIMESTAMPTZ '2000-01-01 00:00:00+00' AND x <= fetched_at + INTERVAL 24 HOUR THEN epoch_us(x) END AS us FROM i"""


_RFC822 = r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun), [0-9]{2} (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2} (GMT|UTC|[+-][0-9]{4})\z"
_NAMED = r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun), [0-9]{2} (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2} (JST|CEST|EDT|PDT)\z"
_RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,6})?(Z|[+-][0-9]{2}:[0-9]{2})\z"
_PLAIN_DATE = r"^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}( [0-9]{2}:[0-9]{2}(:[0-9]{2})?)?\z"
_JAPANESE = r"^[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日\z"
_AGO = r"^[0-9]+ (minute|hour|day)s? ago\z"
_MAE = r"^[0-9]+(分|時間|日)前\z"
_NUMERIC = r"^[0-9]{2}/[0-9]{2}/[0-9]{4} [0-9]{2}:[0-9]{2}\z"
_LOCAL = "AT TIME ZONE coalesce(tz, 'UTC')"


@query(_dated_sql(_RFC822, "strptime(regexp_replace(regexp_replace(substr(t, 6), '(GMT|UTC)$', '+0000'), '([+-][0-9]{2})([0-9]{2})$', '\\1:\\2'), '%d %b %Y %H:%M:%S %z')"))
def date_rfc822(spark, d):
    return _dated(spark, d, _RFC822)


@query(_dated_sql(_RFC3339, "CAST(t AS TIMESTAMPTZ)"))
def date_rfc3339(spark, d):
    return _dated(spark, d, _RFC3339)


@query(_dated_sql(_NAMED, "(strptime(regexp_replace(substr(t, 6), ' [A-Z]+$', ''), '%d %b %Y %H:%M:%S') - INTERVAL 1 MINUTE * CASE regexp_extract(t, '[A-Z]+$') WHEN 'JST' THEN 540 WHEN 'CEST' THEN 120 WHEN 'EDT' THEN -240 ELSE -420 END) AT TIME ZONE 'UTC'"))
def date_named_zone(spark, d):
    return _dated(spark, d, _NAMED)


@query(_dated_sql(_PLAIN_DATE, f"TRY_CAST(replace(t, '/', '-') || CASE WHEN length(t) = 10 THEN ' 00:00:00' WHEN length(t) = 16 THEN ':00' ELSE '' END AS TIMESTAMP) {_LOCAL}"))
def date_plain(spark, d):
    return _dated(spark, d, _PLAIN_DATE)


@query(_dated_sql(_JAPANESE, f"make_timestamp(CAST(regexp_extract(t, '^([0-9]+)年', 1) AS BIGINT), CAST(regexp_extract(t, '年([0-9]+)月', 1) AS BIGINT), CAST(regexp_extract(t, '月([0-9]+)日', 1) AS BIGINT), 0, 0, 0.0) {_LOCAL}"))
def date_japanese(spark, d):
    return _dated(spark, d, _JAPANESE)


@query(_dated_sql(f"{_AGO}|{_MAE}", "fetched_at - INTERVAL 1 SECOND * (CAST(regexp_extract(t, '^[0-9]+') AS BIGINT) * CASE WHEN t LIKE '%minute%' OR t LIKE '%分%' THEN 60 WHEN t LIKE '%hour%' OR t LIKE '%時間%' THEN 3600 ELSE 86400 END)"))
def date_relative(spark, d):
    return _dated(spark, d, f"{_AGO}|{_MAE}")


@query(_dated_sql(_NUMERIC, f"CASE o WHEN 'dmy' THEN try_strptime(t, '%d/%m/%Y %H:%M') ELSE try_strptime(t, '%m/%d/%Y %H:%M') END {_LOCAL}"))
def date_numeric(spark, d):
    return _dated(spark, d, _NUMERIC)


@query()
def parse_date(spark, d):
    """All raw dates, each read on its own."""
    return _dated(spark, d, "")


@query(f"""SELECT id, json_extract_string(config, '$.tz') AS zone, CAST((epoch_us((TIMESTAMPTZ '{NOW}+00' AT TIME ZONE json_extract_string(config, '$.tz')) AT TIME ZONE 'UTC') - epoch_us(TIMESTAMPTZ '{NOW}+00')) / 60000000 AS INT) AS minutes FROM sources""")
def tz_offset(spark, d):
    zone = F.get_json_object("config", "$.tz")
    return table(spark, d, "sources").select("id", zone.alias("zone"), date_text.zone_offset_minutes(_now(), zone).alias("minutes"))


_STRIPPED = """trim(regexp_replace(concat_ws(' ', coalesce({title}, ''), regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(content_html, summary, ''), '(?is)<script.*?</script>', ' ', 'g'),
 '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&(?:nbsp|amp|lt|gt|quot|#[0-9]+);', ' ', 'g')), '{blank}', ' ', 'g'))"""
_CLEAN = "nullif(trim(regexp_replace({0}, '{1}', ' ', 'g')), '')"


@query(f"""WITH {_RAW_URL}, canon AS (SELECT *, 'https://' || lower(p.host) || CASE WHEN length(p.path) > 1 AND p.path LIKE '%/' THEN substr(p.path, 1, length(p.path) - 1) WHEN p.path = '' THEN '/' ELSE p.path END
 || CASE WHEN len(clean) = 0 THEN '' ELSE '?' || array_to_string(list_sort(clean), '&') END AS canonical_url FROM web)
 SELECT sha256(canonical_url) AS id, resolved AS url, canonical_url, {_CLEAN.format('title', _SQL_BLANK)} AS title, {_CLEAN.format('author', _SQL_BLANK)} AS author, nullif(trim(guid), '') AS guid, nullif(content_html, '') AS content_html,
 {_CLEAN.format('summary', _SQL_BLANK)} AS summary, {_STRIPPED.format(title=_CLEAN.format('title', _SQL_BLANK), blank=_SQL_BLANK)} AS search_text, epoch_us(fetched_at) AS fetched_us, source_id FROM canon""")
def normalize_items(spark, d):
    """Raw records as items; their instants are the rows of p1_instants."""
    rows = _raw_with_base(spark, d).withColumn("instant", F.lit(None).cast("timestamp"))
    items = ingest.normalize_items(rows)
    return items.select("id", "url", "canonical_url", "title", "author", "guid", "content_html", "summary", "search_text", F.unix_micros("fetched_at").alias("fetched_us"), "source_id")


@query()
def normalize_items_dated(spark, d):
    """Raw records as items, with the instants of their sources' chains."""
    from ..operators.instants import normalise_instants

    raw = _raw_with_base(spark, d).join(table(spark, d, "sources").select(F.col("id").alias("source_id"), "config"), "source_id", "left")
    instants = normalise_instants(raw).select("raw_id", "instant", "by_rule")
    return ingest.normalize_items(raw.join(instants, "raw_id").withColumn("instant", F.when(F.col("by_rule"), F.col("instant"))))


@query("""SELECT id, regexp_replace(regexp_replace(replace(content_html, 'https://', '/'), '(href|src)="(/[^"]*)"', '\\1="' || regexp_extract(url, '^(https?://[^/?#]+)', 1) || '\\2"', 'g'), '&', '&', 'g') AS content_html FROM items WHERE content_html IS NOT NULL""")
def absolutize_html(spark, d):
    """Bodies whose links lost their scheme and became paths, made absolute again."""
    rows = table(spark, d, "items").filter("content_html is not null").select("id", "url", F.replace("content_html", F.lit("https://"), F.lit("/")).alias("content_html"))
    return rows.select("id", urls.absolutize_html("content_html", "url").alias("content_html"))


@query("""SELECT id, CASE WHEN search_text <> '' THEN search_text WHEN coalesce(summary, '') <> '' THEN summary ELSE '(no body)' END AS text, coalesce(summary, '(no summary)') AS summary FROM items""")
def render_item(spark, d):
    parts = (F.col("content_html"), F.col("search_text"), F.col("summary"))
    return table(spark, d, "items").select("id", text.render(*parts, "text").alias("text"), text.render(*parts, "summary").alias("summary"))


@query()
def render_markdown(spark, d):
    return table(spark, d, "items").select("id", text.render(F.col("content_html"), F.col("search_text"), F.col("summary"), "markdown").alias("markdown"))


@query("""SELECT to_json(struct_pack(id := id, url := url, title := title, published_at := strftime(published_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%gZ'))) AS json FROM items""")
def items_json(spark, d):
    return requests.as_json(table(spark, d, "items").select("id", "url", "title", text.iso_millis(F.col("published_at")).alias("published_at")))


# ---- ingest -----------------------------------------------------------------------

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>T</title>
<item><title>Harbour opens</title><link>https://n.example/first</link><guid isPermaLink="false">tag:n.example,2026:1</guid><pubDate>Tue, 14 Jul 2026 21:40:09 GMT</pubDate>
<dc:creator>Mio Tanaka</dc:creator><description>In brief</description><content:encoded><![CDATA[<p>Full</p>]]></content:encoded></item><item><title>No link</title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Second note</title><link href="https://n.example/second"/><id>x</id><updated>2026-07-14T21:40:09Z</updated><author><name>Mio Tanaka</name></author><content type="html">&lt;p&gt;x&lt;/p&gt;</content></entry></feed>"""
JSON_FEED = '{"version": "https://jsonfeed.org/version/1.1", "items": [{"id": "1", "url": "https://n.example/third", "title": "Third note", "date_published": "2026-07-14T21:40:09Z", "author": {"name": "Mio Tanaka"}, "content_html": "<p>j</p>"}]}'
OPML = '<opml><body><outline text="Group"><outline title="A" xmlUrl="https://a.example/rss" htmlUrl="https://a.example/"/><outline text="B" xmlUrl="https://b.example/rss"/></outline><outline text="A again" xmlUrl="https://a.example/rss"/></body></opml>'


def _bodies(spark):
    rows = [(1, bytearray(RSS.encode()), "application/rss+xml"), (2, bytearray(ATOM.encode()), "application/atom+xml"), (3, bytearray(JSON_FEED.encode()), "application/feed+json"), (4, bytearray(b"<rss"), "text/xml")]
    return spark.createDataFrame(rows, "feed_id int, body binary, content_type string")


@query("""SELECT * FROM (VALUES (1, 'https://n.example/first', 'Harbour opens', 'Mio Tanaka', 'tag:n.example,2026:1', 'Tue, 14 Jul 2026 21:40:09 GMT', '<p>Full</p>', 'In brief'),
 (2, 'https://n.example/second', 'Second note', 'Mio Tanaka', 'x', '2026-07-14T21:40:09Z', '<p>x</p>', NULL), (3, 'https://n.example/third', 'Third note', 'Mio Tanaka', '1', '2026-07-14T21:40:09Z', '<p>j</p>', NULL))
 t(feed_id, url, title, author, guid, published_at_raw, content_html, summary)""")
def feed_parse(spark, d):
    return feeds.feed_items(feeds.parse_feeds(_bodies(spark))).drop("position")


@query("SELECT * FROM (VALUES (1, false), (2, false), (3, true), (4, false)) t(feed_id, is_json)")
def feed_format(spark, d):
    return _bodies(spark).select("feed_id", feeds.is_json_feed(F.col("content_type"), F.decode("body", "UTF-8")).alias("is_json"))


@query("SELECT * FROM (VALUES (1, '日本語'), (2, '日本語'), (3, 'é'), (4, 'é')) t(n, text)")
def decode_body(spark, d):
    sjis, euc = "日本語".encode("shift_jis"), "日本語".encode("euc_jp")
    rows = [(1, bytearray(b'<?xml version="1.0" encoding="Shift_JIS"?>' + sjis), "text/xml"), (2, bytearray(euc), "text/html; charset=EUC-JP"), (3, bytearray(b"\xef\xbb\xbf" + "é".encode()), None), (4, bytearray("é".encode()), "text/html; charset=X-MADE-UP")]
    df = spark.createDataFrame(rows, "n int, body binary, content_type string")
    return df.select("n", F.regexp_replace(feeds.decode_body("body", "content_type"), r"^<\?xml.*\?>", "").alias("text"))


@query("SELECT * FROM (VALUES ('x', 0, 'A', 'https://a.example/rss', 'https://a.example/'), ('x', 1, 'B', 'https://b.example/rss', NULL)) t(doc, position, title, xml_url, html_url)")
def opml_outlines(spark, d):
    return feeds.opml_outlines(spark.createDataFrame([("x", OPML), ("y", "<opml")], "doc string, xml string"))


@query("SELECT CAST(2 AS BIGINT) AS imported, CAST(1 AS BIGINT) AS skipped")
def opml_import(spark, d):
    sources = table(spark, d, "sources")
    known = sources.orderBy("id").limit(1).select("url").collect()[0][0]
    user = sources.orderBy("id").limit(1).select("user_id").collect()[0][0]
    outlines = opml_outlines(spark, d).select("xml_url").unionByName(spark.createDataFrame([(known,)], "xml_url string"))
    return ingest.opml_import(outlines, sources, user)


@query("""SELECT raw_id FROM (SELECT raw_id, item_id, row_number() OVER (PARTITION BY item_id ORDER BY fetched_at, raw_id) AS rn FROM raw_items) WHERE rn = 1
 AND item_id NOT IN (SELECT id FROM items WHERE published_at < TIMESTAMPTZ '2025-06-01 00:00:00+00')""")
def ingest_new_items(spark, d):
    batch = table(spark, d, "raw_items").select("raw_id", F.col("item_id").alias("id"), "fetched_at")
    store = table(spark, d, "items").filter(F.col("published_at") < F.to_timestamp(F.lit(SINCE)))
    return ingest.new_items(batch, store, [F.asc("fetched_at"), F.asc("raw_id")]).select("raw_id")


@query("SELECT count(*) AS polled, CAST(coalesce(sum(value > 50), 0) AS BIGINT) AS inserted, count(*) FILTER (event_type = 'error') AS failed FROM events")
def ingest_summary(spark, d):
    polls = table(spark, d, "events").select((F.col("value") > 50).cast("long").alias("inserted"), F.when(F.col("event_type") == "error", "failed").otherwise("fetched").alias("status"))
    return ingest.ingest_summary(polls)


@query("""SELECT event_id, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> event_type, true) AS changed FROM events""")
def change_gate(spark, d):
    shots = table(spark, d, "events").select(F.col("user_id").alias("source_id"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("hash"), "event_id")
    return ingest.change_gate(shots).select("event_id", "changed")


@query("""WITH r AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
 f AS (SELECT event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS failures FROM r)
 SELECT event_id, CAST(failures AS BIGINT) AS failures, CASE WHEN failures >= 2 THEN 'degraded' ELSE 'active' END AS status FROM f""")
def source_health(spark, d):
    outcomes = table(spark, d, "events").select(F.col("user_id").alias("source_id"), F.struct("ts", "event_id").alias("seq"), F.when(F.col("event_type") == "error", "failed").otherwise("fetched").alias("outcome"))
    return timeline.source_health(outcomes, 2).select(F.col("seq.event_id").alias("event_id"), "failures", "status")


@query("SELECT id, CAST(least(fetch_interval_seconds * pow(2.0, least(consecutive_failures + 2, 10)), 86400) AS BIGINT) AS seconds FROM sources")
def fetch_backoff(spark, d):
    return table(spark, d, "sources").select("id", ingest.fetch_backoff(F.col("fetch_interval_seconds"), F.col("consecutive_failures"), F.lit(True)).alias("seconds"))


@query("SELECT event_id, CAST(least(60 * pow(2.0, greatest(0, event_id % 14 - 1)), 86400) AS BIGINT) AS seconds FROM events")
def embed_backoff(spark, d):
    return table(spark, d, "events").select("event_id", ingest.embed_backoff(F.col("event_id") % 14).alias("seconds"))


@query("""SELECT e.item_id, epoch_us(CASE WHEN b.item_id IS NULL THEN e.created_at ELSE TIMESTAMPTZ '2026-08-10 00:00:00+00' END) AS created_us, len(e.embedding) AS width FROM item_embeddings e
 LEFT JOIN (SELECT item_id FROM item_embeddings WHERE embedding IS NULL) b ON b.item_id = e.item_id WHERE e.embedding IS NOT NULL
 UNION ALL SELECT item_id, epoch_us(TIMESTAMPTZ '2026-08-10 00:00:00+00'), 64 FROM item_embeddings WHERE embedding IS NULL""")
def embedding_upsert(spark, d):
    vectors = table(spark, d, "item_embeddings")
    batch = vectors.filter("embedding is null").select("item_id", F.array_repeat(F.lit(1.0).cast("float"), 64).alias("embedding"), _now().alias("created_at"))
    return embeddings.upsert(vectors, batch).select("item_id", F.unix_micros("created_at").alias("created_us"), F.size("embedding").cast("long").alias("width"))


@query("""WITH f AS (SELECT CAST(event_id AS VARCHAR) AS item_id, CAST(event_id % 12 AS INT) AS failures FROM events WHERE event_type = 'error')
 SELECT item_id, failures + 1 AS failures, CASE WHEN failures = 0 THEN 60 ELSE CAST(least(60 * pow(2.0, failures), 86400) AS BIGINT) END AS wait FROM f""")
def embedding_failures(spark, d):
    e = table(spark, d, "events").filter("event_type = 'error'").select(F.col("event_id").cast("string").alias("item_id"), (F.col("event_id") % 12).cast("int").alias("failures"))
    old = e.select("item_id", "failures", F.lit("x").alias("last_error"), _now().alias("next_attempt_at"))
    after = embeddings.record_failures(old, e.select("item_id", F.lit("timeout").alias("error")), _now())
    return after.select("item_id", "failures", (F.unix_timestamp("next_attempt_at") - F.unix_timestamp(_now())).alias("wait"))


ADDRESSES = ["127.0.0.1", "10.0.0.5", "192.168.1.1", "172.16.0.1", "::1", "169.254.169.254", "100.64.0.1", "0.0.0.0", "fe80::1", "ff02::1", "fd00::1", "::ffff:127.0.0.1", "2606:2800:220:1:248:1893:25c8:1946", "8.8.8.8", "999.1.1.1"]


@query("""SELECT * FROM (VALUES ('127.0.0.1', true, false), ('10.0.0.5', true, false), ('192.168.1.1', true, false), ('172.16.0.1', true, false), ('::1', true, false), ('169.254.169.254', true, true), ('100.64.0.1', true, true),
 ('0.0.0.0', true, true), ('fe80::1', true, true), ('ff02::1', true, true), ('fd00::1', true, false), ('::ffff:127.0.0.1', true, false), ('2606:2800:220:1:248:1893:25c8:1946', false, false), ('8.8.8.8', false, false), ('999.1.1.1', true, true)) t(address, blocked, blocked_private)""")
def ip_blocked(spark, d):
    df = spark.createDataFrame([(a,) for a in ADDRESSES], "address string")
    return df.select("address", net.ip_blocked()("address").alias("blocked"), net.ip_blocked(True)("address").alias("blocked_private"))


@query("SELECT * FROM (VALUES ('https://a.example/x', true), ('http://b.example/', false), ('ftp://a.example/', false), ('https://c.example', false)) t(url, allowed)")
def target_allowed(spark, d):
    targets = spark.createDataFrame([("https://a.example/x",), ("http://b.example/",), ("ftp://a.example/",), ("https://c.example",)], "url string")
    resolved = spark.createDataFrame([("a.example", "8.8.8.8"), ("b.example", "8.8.8.8"), ("b.example", "10.0.0.1")], "host string, address string")
    return net.target_allowed(targets, resolved)


@query("""WITH r AS (SELECT user_id, url, row_number() OVER (PARTITION BY user_id, url) AS n FROM (SELECT user_id, url FROM sources UNION ALL SELECT user_id, url || '?new' FROM sources UNION ALL SELECT user_id, url || '?new' FROM sources))
 SELECT user_id, url, CASE WHEN n = 1 AND url LIKE '%?new' THEN 'created' ELSE 'already subscribed' END AS outcome FROM r""")
def subscribe(spark, d):
    s = table(spark, d, "sources").select("user_id", "url")
    new = s.withColumn("url", F.concat("url", F.lit("?new")))
    return ingest.subscribe(s.unionByName(new).unionByName(new), s)


_STEP = """WITH r AS (SELECT *, CASE WHEN length(url) % 5 = 0 THEN 304 WHEN length(url) % 5 = 1 THEN 404 WHEN length(url) % 5 = 2 THEN 503 ELSE 200 END AS code, CASE WHEN length(url) % 2 = 0 THEN content_hash ELSE sha256(url) END AS h, length(url) % 7 <> 0 AS ok FROM sources),
 o AS (SELECT *, CASE WHEN code = 304 THEN 'unchanged' WHEN code = 200 AND h = content_hash THEN 'unchanged' WHEN code = 200 AND ok THEN 'fetched' WHEN code = 404 THEN 'failed' ELSE 'retry' END AS outcome FROM r),
 f AS (SELECT *, CASE WHEN outcome IN ('failed', 'retry') THEN consecutive_failures + 1 ELSE 0 END AS n FROM o)
 SELECT id AS source_id, outcome, n AS consecutive_failures, CASE WHEN outcome IN ('failed', 'retry') AND n >= 5 THEN 'degraded' WHEN outcome IN ('fetched', 'unchanged') AND status = 'degraded' THEN 'active' ELSE status END AS status,
 CASE WHEN outcome = 'fetched' THEN h ELSE content_hash END AS content_hash, CASE WHEN outcome = 'fetched' THEN 'new' ELSE etag END AS etag,
 CASE WHEN outcome IN ('fetched', 'unchanged') THEN CAST(fetch_interval_seconds AS BIGINT) ELSE CAST(least(fetch_interval_seconds * pow(2.0, least(n + CASE WHEN outcome = 'failed' THEN 2 ELSE 0 END, 10)), 86400) AS BIGINT) END AS wait FROM f"""


@query(_STEP)
def fetch_step(spark, d):
    """One poll of all sources, whose answers go by the length of their URL."""
    s = table(spark, d, "sources")
    n = F.length("url")
    status = F.when(n % 5 == 0, 304).when(n % 5 == 1, 404).when(n % 5 == 2, 503).otherwise(200)
    body = F.when(n % 2 == 0, F.col("content_hash")).otherwise(F.sha2("url", 256))
    answers = s.select(F.col("id").alias("source_id"), status.alias("status"), body.alias("body_hash"), F.lit("new").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("error"))
    parsed = s.select(F.col("id").alias("source_id"), (n % 7 != 0).alias("ok"))
    return ingest.fetch_step(answers, s, parsed, _now()).select("source_id", "outcome", "consecutive_failures", "status", "content_hash", "etag", "wait")


@query("SELECT id, true AS near FROM sources")
def next_fetch(spark, d):
    s = table(spark, d, "sources").withColumn("at", ingest.next_fetch(_now(), F.col("fetch_interval_seconds"), 7))
    late = F.unix_micros("at") - F.unix_micros(_now()) - F.col("fetch_interval_seconds").cast("long") * 1_000_000
    return s.select("id", (F.abs(late) <= F.col("fetch_interval_seconds").cast("long") * 100_000).alias("near"))
