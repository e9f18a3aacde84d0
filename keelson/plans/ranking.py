"""Global row numbers without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import input_tasks, stage


def global_row_number(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` with its row number by ``order`` (long, from 1).

    Rows are dealt out by ranges of the order; each range is numbered by itself and moved by the sizes of the ranges before it.  The window
    without partitions sees one row per range.
    """
    place, local, size, before = (_unused(df, x) for x in ("range", "local", "size", "before"))
    ranged = df.repartitionByRange(input_tasks(df.sparkSession), *order).withColumn(place, F.spark_partition_id())
    placed = stage(ranged, "ranges")
    sizes = placed.groupBy(place).agg(F.count(F.lit(1)).alias(size))
    earlier = Window.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(place, F.coalesce(F.sum(size).over(earlier), F.lit(0)).alias(before))
    number = F.row_number().over(Window.partitionBy(place).orderBy(*order))
    return placed.withColumn(local, number).join(offsets, place).withColumn(name, (F.col(local) + F.col(before)).cast("long")).drop(place, local, before)


def keyed_row_number(df: DataFrame, name: str, key: str, *order: str) -> DataFrame:
    """``df`` with the row number inside ``key`` by ``order`` (long, from 1), however many rows a key has.

    Rows are dealt out by ranges of key and order; each range is numbered by itself and moved by the sizes of the key's ranges before it: one row a key and range.
    """
    place, local, size, before = (_unused(df, x) for x in ("range", "local", "size", "before"))
    placed = stage(df.repartitionByRange(input_tasks(df.sparkSession), key, *order).withColumn(place, F.spark_partition_id()), "key-ranges")
    earlier = Window.partitionBy(key).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(key, place).agg(F.count(F.lit(1)).alias(size))
    offsets = sizes.select(F.col(key).alias(f"{key}_of"), F.col(place).alias(f"{place}_of"), F.coalesce(F.sum(size).over(earlier), F.lit(0)).alias(before))
    number = F.row_number().over(Window.partitionBy(key, place).orderBy(*order))
    joined = placed.withColumn(local, number).join(offsets, F.col(key).eqNullSafe(F.col(f"{key}_of")) & (F.col(place) == F.col(f"{place}_of")))
    return joined.withColumn(name, (F.col(local) + F.col(before)).cast("long")).drop(place, f"{place}_of", f"{key}_of", local, before)


def _unused(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name
