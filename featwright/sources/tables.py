"""Reading labelled tables and turning them into long cells or row vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featwright.functions.expressions import clean


def read_labelled_csv(spark: SparkSession, path: str, feature_names: Sequence[str]) -> DataFrame:
    """A CSV whose first column is ``label``. The schema is given, so nothing is inferred."""
    schema = T.StructType(
        [T.StructField("label", T.IntegerType())] + [T.StructField(n, T.DoubleType()) for n in feature_names]
    )
    # FAILFAST with the header check: a column out of place is an error, not a shift
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False, mode="FAILFAST")


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV; reads its first line only."""
    names = spark.read.option("header", True).csv(path).columns
    if names[0] != "label":
        raise ValueError(f"the first column is {names[0]!r}, not 'label'")
    return names


def feature_catalog(names: Sequence[str], spark: SparkSession, number_of_features: int | None = None) -> DataFrame:
    """``features(feature, feature_ord)`` of a wide table's columns; the label counts as one."""
    kept = list(names)[1:number_of_features]
    return spark.createDataFrame([(n, i) for i, n in enumerate(kept)], "feature string, feature_ord int")


def cells_of(wide: DataFrame, sample_id: str, label: str, feature_columns: Sequence[str]) -> DataFrame:
    """Long cells of a wide table; a projection, nothing is shuffled."""
    cells = [
        F.struct(F.lit(name).alias("feature"), F.lit(i).alias("feature_ord"), clean(F.col(name)).alias("value"))
        for i, name in enumerate(feature_columns)
    ]
    return wide.select(
        F.col(sample_id).cast("bigint").alias("sample_id"),
        F.col(label).cast("int").alias("label"),
        F.inline(F.array(*cells)),
    )


def cells_of_vectors(vectors: DataFrame, prefix: str = "f_") -> DataFrame:
    """Long cells of ``(sample_id, label, features array)``; other columns are kept."""
    others = [c for c in vectors.columns if c != "features"]
    return vectors.select(*others, F.posexplode("features").alias("feature_ord", "value")).select(
        *others,
        F.concat(F.lit(prefix), F.col("feature_ord").cast("string")).alias("feature"),
        "feature_ord",
        clean(F.col("value")).alias("value"),
    )


def vectors_of(cells: DataFrame, keys: Sequence[str], value: str | Column = "value") -> DataFrame:
    """Row vectors ordered by ``feature_ord``. A group is one sample, so it holds one value per feature."""
    value = F.col(value) if isinstance(value, str) else value
    ordered = F.array_sort(F.collect_list(F.struct("feature_ord", value.alias("value"))))
    return cells.groupBy(*keys).agg(ordered.getField("value").alias("features"))
