"""The power windows as a stream over files of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from featwright.model import POWER_SAMPLES
from featwright.operators.metering import power_windows


def sample_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New Parquet files of power samples in ``folder``."""
    return spark.readStream.schema(POWER_SAMPLES).parquet(folder)


def write_power_windows(
    samples: DataFrame, seconds: Column, out: str, checkpoint: str, **options
) -> StreamingQuery:
    """Append every closed window to ``out``; stops when all present files are read."""
    return (
        power_windows(samples, seconds, **options)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
