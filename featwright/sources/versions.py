"""Tables that are stored whole or not at all, as versions behind a manifest.

A version is a folder for each of its parts. Only when all parts are written and checked is it published: one row
is appended to the manifest, in one file that the commit of Spark's writer puts in place. Readers go by the manifest, so that what a
broken write left behind is never seen, a repeated write is a new version, and older versions stay readable.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featwright.settings import Settings

_MANIFEST = "name string, seq bigint, version string, parts map<string,bigint>, published timestamp"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """All published versions: ``name, seq, version, parts`` (rows by part), ``published``; empty where nothing was."""
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def write_version(folder: str, parts: dict[str, DataFrame]) -> tuple[str, dict[str, DataFrame]]:
    """Write the parts of a new version, unseen by readers; its id and the stored parts, for checks."""
    version = uuid.uuid4().hex
    stored = {}
    for part, df in parts.items():
        path = f"{folder}/{part}/{version}"
        df.write.parquet(path)
        stored[part] = df.sparkSession.read.schema(df.schema).parquet(path)
    return version, stored


def publish(spark: SparkSession, folder: str, name: str, version: str, stored: dict[str, DataFrame]) -> None:
    """Make a written version the latest of ``name``. One writer per name at a time."""
    seq = (manifest(spark, folder).where(F.col("name") == name).agg(F.max("seq")).first()[0] or 0) + 1
    rows = {part: df.count() for part, df in stored.items()}
    entry = spark.createDataFrame([(name, seq, version, rows)], "name string, seq bigint, version string, parts map<string,bigint>")
    entry.withColumn("published", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def latest(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, str]:
    """The latest version of each name: one entry per name, not per row of data."""
    found = manifest(spark, folder)
    if names is not None:
        found = found.where(F.col("name").isin(names))
    newest = found.groupBy("name").agg(F.max_by("version", "seq").alias("version"))
    return {r.name: r.version for r in newest.collect()}


def read_versions(spark: SparkSession, folder: str, part: str, versions: list[str], schema) -> DataFrame:
    """One part of several versions; only their folders are listed and read."""
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/{part}/{v}" for v in versions])


def fingerprint(df: DataFrame, settings: Settings, name: str = "") -> str:
    """A key of the input files (path, length, time of change), the settings and ``name``, which stands for what is done to them."""
    spark = df.sparkSession
    configuration = spark._jsc.hadoopConfiguration()
    files = []
    for file in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        status = path.getFileSystem(configuration).getFileStatus(path)
        files.append([file, status.getLen(), status.getModificationTime()])
    if not files:
        raise ValueError("only tables that are read from files have a fingerprint")
    return hashlib.sha256(json.dumps([files, asdict(settings), name], sort_keys=True, default=str).encode()).hexdigest()
