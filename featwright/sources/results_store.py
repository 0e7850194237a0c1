"""Stored results of selection runs: importances, reverse results, experiments, exports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featwright.model import IMPORTANCES, RAW_REVERSE, RAW_STANDARD
from featwright.operators.expectations import check_complete, check_names, check_reverse, check_standard, require_empty
from featwright.sources import versions as V


def store_results(importances: DataFrame, folder: str, n_inner_folds: int | None = None) -> DataFrame:
    """Write one partition per experiment and method, read back, and check what was stored.

    Partitions are replaced one by one, so storing an experiment again is safe.
    """
    (
        importances.select(*IMPORTANCES.fieldNames())
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("experiment_id", "method")
        .parquet(folder)
    )
    stored = read_results(importances.sparkSession, folder)
    if n_inner_folds is not None:
        require_empty(check_standard(stored, n_inner_folds), "incomplete results")
    return stored


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(IMPORTANCES).parquet(folder)


def load_results(spark: SparkSession, folder: str, experiment_id: int, methods: Sequence[str] | None = None) -> DataFrame:
    """Results of one experiment; only its partitions are read."""
    found = read_results(spark, folder).where(F.col("experiment_id") == experiment_id)
    return found if methods is None else found.where(F.col("method").isin(list(methods)))


_PARTS = {"importances": IMPORTANCES, "fits": RAW_STANDARD, "reverse": RAW_REVERSE}


@dataclass(frozen=True)
class Run:
    """Raw results of experiments: macro, micro and shap importances, metric and parameters per outer fold, reverse qualities."""

    importances: DataFrame
    fits: DataFrame
    reverse: DataFrame


def store_run(run: Run, folder: str, experiment_id: int, n_inner_folds: int) -> str:
    """Store one experiment's results as a new version; the version's id.

    It is published only after every part was read back and found whole: all five parts of every standard run, both
    qualities of every reverse run, a name with every value. Otherwise an error, and readers see nothing of it.
    """
    spark = run.importances.sparkSession
    own = F.col("experiment_id") == experiment_id
    parts = {}
    for part, schema in _PARTS.items():
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
        parts[part] = getattr(run, part).where(own).select(*columns)
    version, stored = V.write_version(folder, parts)
    require_empty(check_standard(stored["importances"], n_inner_folds), "incomplete importances")
    require_empty(check_complete(stored["importances"], stored["fits"]), "incomplete fits")
    require_empty(check_reverse(stored["reverse"]), "incomplete reverse results")
    for part in ("importances", "reverse"):
        require_empty(check_names(stored[part]), f"{part} without a feature name")
    V.publish(spark, folder, str(experiment_id), version, stored)
    return version


def load_run(spark: SparkSession, folder: str, experiment_ids: Sequence[int] | None = None) -> Run:
    """The latest published results of some or all experiments."""
    wanted = None if experiment_ids is None else [str(i) for i in experiment_ids]
    found = sorted(V.latest(spark, folder, wanted).values())
    return Run(**{part: V.read_versions(spark, folder, part, found, schema) for part, schema in _PARTS.items()})


_RUN = ["experiment_id", "method", "outer_fold", "kind"]


def nest_results(importances: DataFrame) -> DataFrame:
    """One row per (experiment, method, outer fold, kind, feature) with its values over the inner folds.

    A list holds one value per inner fold. Vectors over the features would put a
    whole method in one row.
    """
    return importances.groupBy(*_RUN, "feature").agg(
        F.array_sort(F.collect_list(F.struct("inner_fold", "value"))).alias("folds")
    )


def flatten_results(nested: DataFrame) -> DataFrame:
    """The reverse of :func:`nest_results`; a projection."""
    return nested.select(*_RUN, "feature", F.inline("folds"))


def next_experiment_id(experiments: DataFrame) -> DataFrame:
    """The id a new experiment gets: one above the highest, 1 in an empty catalog.

    Only one writer may register experiments at a time.
    """
    return experiments.agg((F.coalesce(F.max("experiment_id"), F.lit(0)) + 1).alias("experiment_id"))


def find_experiments(experiments: DataFrame, condition: Column) -> DataFrame:
    return experiments.where(condition)


def register_experiment(spark: SparkSession, folder: str, experiments: DataFrame, settings: dict[str, str]) -> DataFrame:
    """Append a new experiment to the catalog in ``folder``."""
    pairs = [F.lit(x) for kv in settings.items() for x in kv]
    row = next_experiment_id(experiments).select(
        F.col("experiment_id").cast("bigint"),
        F.current_timestamp().alias("created"),
        F.create_map(*pairs).cast("map<string,string>").alias("settings"),
    )
    row.write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def export_csv(scores: DataFrame, folder: str, columns: Sequence[str]) -> None:
    """Feature × method table as CSV, one folder per cross-validation aggregator."""
    wide = scores.groupBy("cv_aggregator", "feature").pivot("method", list(columns)).agg(F.first("score"))
    wide.write.mode("overwrite").partitionBy("cv_aggregator").csv(folder, header=True)


def append_log(entries: DataFrame, folder: str) -> DataFrame:
    """Append benchmark entries to the log in ``folder``, all or none of them; the whole log, older entries first by ``seq``."""
    spark = entries.sparkSession
    version, stored = V.write_version(folder, {"entries": entries})
    V.publish(spark, folder, "log", version, stored)
    written = V.manifest(spark, folder).select("seq", "version")
    rows = spark.read.schema(entries.schema).parquet(*[f"{folder}/entries/{r.version}" for r in written.select("version").collect()])
    of = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.withColumn("version", of).join(written, "version").drop("version")


def log_benchmark(durations: DataFrame, energy: DataFrame) -> DataFrame:
    """Seconds and energy of every workflow element, per node."""
    return durations.join(energy, ["experiment_id", "element"], "left").select(
        "experiment_id", "element", "seconds", "node_id", "joules"
    )
