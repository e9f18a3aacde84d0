"""Inferred and declared constraints evaluated on data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent: referential integrity as an anti-join."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def duplicate_keys(table: DataFrame, *key: str) -> DataFrame:
    """Key values that occur more than once, with their count (n)."""
    return table.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
