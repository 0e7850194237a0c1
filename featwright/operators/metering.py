"""Power and duration analytics over samples of the nodes' power meters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featwright.settings import Settings


def _at_nodes(samples: DataFrame, node_ids: Sequence[str] | None) -> DataFrame:
    return samples if node_ids is None else samples.where(F.col("node_id").isin(list(node_ids)))


def _good(column: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("ok"), F.col(column))), F.lit(0.0))


def power_totals(samples: DataFrame, node_ids: Sequence[str] | None = None) -> DataFrame:
    """Summed power per workflow element and node, with the number of good and failed polls."""
    return (
        _at_nodes(samples, node_ids)
        .groupBy("workflow_element", "node_id")
        .agg(
            _good("total_w").alias("total_w"),
            _good("cpu_w").alias("cpu_w"),
            _good("peg_w").alias("peg_w"),
            F.count_if("ok").alias("number_of_measurements"),
            F.count_if(~F.col("ok")).alias("error"),
        )
    )


def sampling_seconds(settings: Settings = Settings()) -> Column:
    """Seconds between two samples of the row's workflow element."""
    seconds = F.lit(None).cast("int")
    for element, interval in settings.sampling_interval.items():
        seconds = F.when(F.col("workflow_element") == element, interval).otherwise(seconds)
    return seconds


def power_windows(
    samples: DataFrame,
    seconds: Column,
    *,
    width: str = "1 hour",
    late: str = "2 minutes",
    node_ids: Sequence[str] | None = None,
) -> DataFrame:
    """Energy per node in tumbling windows: power times the sampling interval.

    The same plan serves a batch and a stream; in a stream, rows later than the
    watermark are dropped and their windows' state is freed.
    """
    good = _at_nodes(samples, node_ids).where("ok").withColumn("_joules", F.col("total_w") * seconds)
    if samples.isStreaming:
        good = good.withWatermark("ts", late)
    return (
        good.groupBy(F.window("ts", width), "node_id")
        .agg(F.sum("_joules").alias("joules"), F.count("*").alias("n_samples"))
        .select(F.col("window.start").alias("window_start"), "node_id", "joules", "n_samples")
    )


def power_baseline(samples: DataFrame, idle: Column, node_ids: Sequence[str] | None = None) -> DataFrame:
    """Mean idle power per node over the samples where ``idle`` holds."""
    return (
        _at_nodes(samples, node_ids)
        .where(idle & F.col("ok"))
        .groupBy("node_id")
        .agg(F.avg("total_w").alias("baseline_w"), F.count("*").alias("n_samples"))
    )


def net_power(samples: DataFrame, baseline: DataFrame) -> DataFrame:
    """Samples with the idle power of their node taken off."""
    return samples.join(baseline.select("node_id", "baseline_w"), "node_id").withColumn(
        "net_w", F.col("total_w") - F.col("baseline_w")
    )


def element_durations(marks: DataFrame) -> DataFrame:
    """Seconds from the first to the last mark of every workflow element."""
    return _durations(marks, ["experiment_id", "element"])


def workflow_durations(marks: DataFrame) -> DataFrame:
    """Seconds from the first to the last mark of every experiment."""
    return _durations(marks, ["experiment_id"])


def _durations(marks: DataFrame, keys: list[str]) -> DataFrame:
    span = F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))
    return marks.groupBy(*keys).agg((span / 1e6).alias("seconds"))
