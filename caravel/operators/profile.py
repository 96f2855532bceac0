"""Counts, bounds and distributions: the checks run after a load."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def n_rows() -> Column:
    return F.count(F.lit(1))


def tagged_counts(frames: dict[str, DataFrame], tag: str = "table_name") -> DataFrame:
    """Row count of each frame under its name; each branch is a partial count, one row shuffled per task."""
    one_each = [
        frame.agg(n_rows().alias("row_count")).select(F.lit(name).alias(tag), "row_count") for name, frame in frames.items()
    ]
    return reduce(DataFrame.unionByName, one_each)


def distribution(rows: DataFrame, column: Column, name: str, count_name: str = "n") -> DataFrame:
    """Number of rows per value, largest first."""
    counted = rows.groupBy(column.alias(name)).agg(n_rows().alias(count_name))
    return counted.orderBy(F.col(count_name).desc(), F.col(name).asc_nulls_last())


def bounds(rows: DataFrame, column: str, low: str, high: str) -> DataFrame:
    return rows.agg(F.min(column).alias(low), F.max(column).alias(high))


def key_uniqueness(rows: DataFrame, key: str) -> DataFrame:
    """Rows against distinct keys; equal when every key appears once."""
    return rows.agg(n_rows().alias("row_count"), F.count_distinct(F.col(key)).alias("distinct_keys"))


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    """Sorted list of the values in use."""
    return rows.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def same_counts(left: DataFrame, right: DataFrame, key: str, count_name: str) -> DataFrame:
    """Two distributions side by side, with a flag that tells whether they agree."""
    a = left.select(F.col(key), F.col(count_name).alias("left_count"))
    b = right.select(F.col(key).alias("_key"), F.col(count_name).alias("right_count"))
    both = a.join(b, F.col(key).eqNullSafe(F.col("_key")), "full_outer")
    agree = F.col("left_count").eqNullSafe(F.col("right_count"))
    return both.select(F.coalesce(key, "_key").alias(key), "left_count", "right_count", agree.alias("agree"))
