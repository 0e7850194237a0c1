"""Ranks inside groups of any size.

A window over a whole group puts the group in one task, and a group may hold a
third of all rows. Here a group is cut into value buckets: equal values are
counted first (with a map-side combine, so a value shared by most rows costs
one row), a running count inside each bucket plus the count of all lower
buckets gives the rank. The only whole-group window runs over bucket totals.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from featwright.functions.expressions import LOWEST_BUCKET, order_bucket
from featwright.storage import stage


def value_ranks(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """One row per (group, value): ``n_equal``, ``n_less``, ``n_total``, ``group_max``, ``has_null``.

    ``df`` must be stored or exact (see :mod:`featwright.storage`), since callers
    join the result back on the value.
    """
    group = list(group)
    # NULL counts 0 and has a bucket of its own. Both uses of this table then read
    # the same rows, so that Spark shuffles it once.
    distinct = (
        df.groupBy(*group, value)
        .agg(F.count(value).alias("n_equal"))
        .withColumn("_bucket", F.coalesce(order_bucket(F.col(value)), F.lit(LOWEST_BUCKET)))
    )
    totals = distinct.groupBy(*group, "_bucket").agg(
        F.sum("n_equal").alias("_n"),
        F.max(value).alias("_top"),
        F.max(F.col(value).isNull()).alias("_null"),
    )
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group,
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(whole).alias("n_total"),
        F.max("_top").over(whole).alias("group_max"),
        F.max("_null").over(whole).alias("has_null"),
    )
    inside = (
        Window.partitionBy(*group, "_bucket")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    running = distinct.withColumn(
        "_below", F.coalesce(F.sum("n_equal").over(inside), F.lit(0))
    )
    return running.join(offsets, [*group, "_bucket"]).select(
        *group,
        value,
        "n_equal",
        (F.col("_offset") + F.col("_below")).alias("n_less"),
        "n_total",
        "group_max",
        "has_null",
    )


def with_ranks(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """``df`` with the columns of :func:`value_ranks` added."""
    return df.join(value_ranks(df, group, value), [*group, value], "left")


def average_ascending() -> Column:
    """Rank 1 for the lowest value; equal values share their mean rank."""
    return F.col("n_less") + (F.col("n_equal") + 1) / 2


def average_descending() -> Column:
    """Rank 1 for the highest value; equal values share their mean rank."""
    return F.col("n_total") - F.col("n_less") - (F.col("n_equal") - 1) / 2


def lowest_descending() -> Column:
    """Rank 1 for the highest value; equal values share their best rank."""
    return F.col("n_total") - F.col("n_less") - F.col("n_equal") + 1


def directed(unit: float) -> Column:
    """Descending when every value of the group is at most ``unit`` (scores), else ascending (ranks)."""
    all_scores = (F.col("group_max") <= unit) & ~F.col("has_null")
    return F.when(all_scores, average_descending()).otherwise(average_ascending())


def strict_positions(
    df: DataFrame, group: Sequence[str], value: str, tie: str, out: str = "rk"
) -> DataFrame:
    """Positions 1, 2, 3… by falling ``value``; equal values in order of the unique number ``tie``.

    Missing values (NULL or NaN) come last, in order of ``tie``. Rows equal in all of these share a position; rows without a group
    or a ``tie`` have none and are left out.

    All groups are sorted together, dealt to tasks by range: a group of any size is cut where it meets the end of a range.
    Tasks number their own part of a group; those before it are counted once more from the stored result.
    """
    group = list(group)
    missing = F.col(value).isNull() | F.isnan(value)
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in group], F.lit(True))
    # 0.0 and -0.0 are one value
    keyed = df.where(whole).withColumn("_missing", missing).withColumn("_value", F.when(missing, F.lit(0)).otherwise(F.col(value) + F.lit(0)))
    keys = [*group, F.col("_missing"), F.col("_value").desc(), F.col(tie).asc_nulls_last()]
    ranged = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = StructType([*ranged.schema.fields, StructField("_here", LongType()), StructField("_part", IntegerType())])
    compared = [*group, "_missing", "_value", tie]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: tuple | None = None
        begun = place = row = 0  # first row of the last one's group, of those equal to it, and rows so far
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            rows = np.arange(row, row + n)
            new_group = np.zeros(n, bool)
            new_value = np.zeros(n, bool)
            first = tuple(batch.column(batch.schema.get_field_index(c))[0].as_py() for c in compared)
            new_group[0] = last is None or first[: len(group)] != last[: len(group)]
            new_value[0] = last is None or first != last
            for c in compared:
                column = batch.column(batch.schema.get_field_index(c))
                other = pc.fill_null(pc.not_equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
                empty = column.is_null().to_numpy(zero_copy_only=False)
                other = other | (empty[1:] != empty[:-1])
                new_value[1:] |= other
                if c in group:
                    new_group[1:] |= other
            new_value |= new_group
            begins = np.maximum.accumulate(np.where(new_group, rows, begun))
            places = np.maximum.accumulate(np.where(new_value, rows, place))
            begun, place, row = int(begins[-1]), int(places[-1]), row + n
            last = tuple(batch.column(batch.schema.get_field_index(c))[n - 1].as_py() for c in compared)
            columns = [*batch.columns, pa.array(places - begins), pa.array(np.full(n, part, np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_here", "_part"])

    numbered = stage(ranged.mapInArrow(number, schema))
    # a row per group and task that holds a part of it
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = numbered.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(*group, "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    rows = numbered.where(F.col(tie).isNotNull()).join(offsets, [*group, "_part"])
    others = [c for c in df.columns if c not in (*group, value, tie)]
    return rows.select(
        *group, tie, value, *others, (F.col("_before") + F.col("_here") + 1).cast("bigint").alias(out)
    )
