"""Session helpers shared by operators: table loading and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.  Where none
    is named, a temporary folder serves a master inside this process (tests,
    local runs); any other master is refused, for its nodes share no such folder."""
    shared = spark.conf.get(CHECKPOINT_CONF, None)
    current = spark.sparkContext.getCheckpointDir()
    if shared:
        if not current:
            spark.sparkContext.setCheckpointDir(shared)
        return shared
    if not current:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all nodes of {master} share")
        current = tempfile.mkdtemp(prefix="lumenfold-ckpt-")
        spark.sparkContext.setCheckpointDir(current)
    return current


_OWN: set[str] = set()


def _own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder, deleted when it ends."""
    folder = f"{ensure_checkpoint_dir(spark)}/lumenfold/{spark.sparkContext.applicationId}"
    if folder not in _OWN:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _OWN.add(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared checkpoint folder and read it.

    The lineage ends there and the files survive the loss of an executor,
    unlike localCheckpoint blocks; they are compressed, unlike checkpoint()'s.
    They are deleted when the application ends."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many tasks as there are cores, before work that is heavy
    per row: a table of one small file would else be one task.  Tables that fill
    the cores by themselves are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
