"""Staging of intermediate tables in the cluster's shared folder.

Operators that read their input more than once (ranks, scaling) need the two
reads to agree bit for bit, even when an executor is lost in between: a sum of
doubles may change in its last digit when its tasks are run again. They stage
the input as Parquet first. A staged table also has a known size, so that Spark
itself picks a broadcast join when it is small and a shuffle join when not.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local one only in local mode."""
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
    local = tempfile.mkdtemp(prefix="featwright-")
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir()


def stage(df: DataFrame, partition_by: list[str] | None = None, spread: str | None = None) -> DataFrame:
    """Write ``df`` once and return the stored table.

    ``spread`` names a column of many values by which rows are dealt to all cores, for a table that is read
    for much work again and again and may come in a single small file.
    """
    spark = df.sparkSession
    if spread:
        df = df.repartition(spark.sparkContext.defaultParallelism, spread)
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)
