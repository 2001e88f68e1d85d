"""Driver queries of the text and vector problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from .encodings import garbled_values
from .lookalikes import canonical_texts, look_alike_pairs, look_classes
from .mixing import mix_report, mix_sources
from .near_duplicates import found_pairs, groups, near_duplicates
from .packing import fill_containers, fill_report
from .repeated_lines import repeated_lines, without_lines
from .subjects import document_subjects, subject_shares
from .tokens import token_sizes
from .truncation import source_rates, truncated_values
from .vectors import nearest_vectors


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return nearest_vectors(table(spark, d, "item_embeddings"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of items one of which is among the five nearest of the other."""
    n = p6_neighbours(spark, d)
    return n.select(F.least("item_id", "near_id").alias("item_id_a"), F.greatest("item_id", "near_id").alias("item_id_b")).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of items whose search texts share 60% of their 8-grams."""
    return found_pairs(near_duplicates(table(spark, d, "items")))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Items with a near-duplicate: their group, copies and number of links."""
    return groups(near_duplicates(table(spark, d, "items"))).withColumnRenamed("id", "item_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that one of an item's sources repeats in many of its items."""
    return repeated_lines(table(spark, d, "items"), table(spark, d, "item_sources"))


def p2_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every body without the lines its sources repeat."""
    return without_lines(table(spark, d, "items"), p2_found(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Items whose titles or search texts look the same but differ."""
    return look_alike_pairs(cut(look_classes(cut(canonical_texts(table(spark, d, "items"))))))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """The members of every look that different texts share."""
    classes = look_classes(cut(canonical_texts(table(spark, d, "items"))))
    return classes.select(F.col("id").alias("item_id"), F.col("field").alias("field_name"), F.hex("canon").alias("look"), "rep", "look_rep", "copies", "texts")


def p3_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Titles and search texts that change, in their one form."""
    changed = canonical_texts(table(spark, d, "items")).filter("raw <> canon")
    return changed.select(F.col("id").alias("item_id"), F.col("field").alias("field_name"), F.col("text").alias("canonical"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Titles and bodies that were decoded in an encoding they weren't written in."""
    return garbled_values(table(spark, d, "items")).select(F.col("id").alias("item_id"), F.col("field").alias("field_name"))


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    """Those values as first written, where enough is left."""
    return garbled_values(table(spark, d, "items")).select(F.col("id").alias("item_id"), F.col("field").alias("field_name"), F.col("text").alias("restored"), "lost")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Summaries and bodies that stop before their text does."""
    return truncated_values(table(spark, d, "items"), table(spark, d, "item_sources")).select(F.col("id").alias("item_id"), "field_name")


def p7_sources(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates each field."""
    items = table(spark, d, "items")
    links = table(spark, d, "item_sources")
    return source_rates(items, links, truncated_values(items, links))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the subjects of at least a fifth of their sentences."""
    return document_subjects(table(spark, d, "documents"), table(spark, d, "doc_labels")).select("doc_id", "subject")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by subject."""
    documents = table(spark, d, "documents")
    return subject_shares(documents, document_subjects(documents, table(spark, d, "doc_labels")))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document's pieces in a container of each capacity."""
    sized = cut(token_sizes(table(spark, d, "documents")))
    return fill_containers(sized, table(spark, d, "containers"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers needed and how full they are."""
    return fill_report(p8_packed(spark, d))


def _sized_with_copies(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").withColumn("copy_of", F.md5(F.coalesce("text", F.lit(""))))
    return cut(token_sizes(documents, ("source", "copy_of")))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents drawn from each source and how often each is used."""
    return mix_sources(_sized_with_copies(spark, d), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached against the targets."""
    return mix_report(p9_mix(spark, d), table(spark, d, "mix_targets"))


QUERIES = {
    "p8_packed": p8_packed,
    "p8_fill": p8_fill,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_shares": p10_shares,
    "p7_found": p7_found,
    "p7_sources": p7_sources,
    "p4_found": p4_found,
    "p4_restored": p4_restored,
    "p2_found": p2_found,
    "p2_cleaned": p2_cleaned,
    "p3_found": p3_found,
    "p3_canonical": p3_canonical,
    "p3_classes": p3_classes,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p6_neighbours": p6_neighbours,
}

_NEAR = """WITH v AS (SELECT item_id, CAST(embedding AS DOUBLE[]) AS e FROM item_embeddings WHERE embedding IS NOT NULL AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
 u AS (SELECT item_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
 c AS (SELECT a.item_id AS q, b.item_id AS near, list_dot_product(a.e, b.e) / (a.n * b.n) AS cosine FROM u a JOIN u b ON a.item_id <> b.item_id),
 r AS (SELECT q, near, cosine, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, near) AS rank FROM c QUALIFY rank <= 5)"""

ORACLE_SQL: dict[str, str] = {
    "p6_found": _NEAR + " SELECT DISTINCT least(q, near) AS item_id_a, greatest(q, near) AS item_id_b FROM r",
}
