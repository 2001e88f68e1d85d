"""Feed files as a stream: every new file is parsed once and inserted once.

The store is partitioned by the first two digits of the id, and a batch reads
only the parts it touches.  Items are written before the bookkeeping, so a
replay after a failure inserts nothing twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import new_items, normalize_items
from ..operators.instants import normalise_instants
from ..session import cut
from ..sources.feeds import feed_items, parse_feeds


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there; any other trouble with the store is raised."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def ingest_batch(files: DataFrame, store_path: str, sources: DataFrame | None = None) -> DataFrame:
    """New items, with their part, of one batch of (path, content) files against
    the store.  A file is named after its source; `sources` (id, url, site_url,
    config) gives the base of relative links and the rules of its dates, without
    it there are none."""
    spark = files.sparkSession
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    bodies = files.select(name.alias("feed_id"), F.col("content").alias("body"), F.lit("").alias("content_type"))
    raw = feed_items(parse_feeds(bodies)).withColumnRenamed("feed_id", "source_id").withColumn("fetched_at", F.current_timestamp())
    if sources is None:
        raw = raw.withColumn("base", F.lit(None).cast("string")).withColumn("config", F.lit(None).cast("string"))
    else:
        known = sources.select(F.col("id").alias("source_id"), F.coalesce("site_url", "url").alias("base"), "config")
        raw = raw.join(known, "source_id", "left")
    raw = cut(raw.withColumn("raw_id", F.monotonically_increasing_id()))
    dates = normalise_instants(raw).select("raw_id", F.when(F.col("by_rule"), F.col("instant")).alias("instant"))
    items = normalize_items(raw.join(dates, "raw_id")).withColumn("part", F.substring("id", 1, 2))
    if not _exists(spark, store_path):
        return new_items(items, items.select("id").limit(0), [F.asc("source_id"), F.asc("url")])
    items = cut(items)
    parts = [r[0] for r in items.select("part").distinct().collect()]  # at most 256
    store = spark.read.schema("id string, part string").parquet(store_path).filter(F.col("part").isin(parts))
    return new_items(items, store, [F.asc("source_id"), F.asc("url")])


def poll_files(spark: SparkSession, directory: str, store_path: str, checkpoint: str, sources: DataFrame | None = None):
    """Start the stream over the files of a directory; it ends when all are read."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(directory)

    def write(batch: DataFrame, _epoch: int) -> None:
        ingest_batch(batch.select("path", "content"), store_path, sources).write.mode("append").partitionBy("part").parquet(store_path)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
