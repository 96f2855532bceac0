"""Rank and top-k without sending a whole table, or a whole tie, to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def largest(rows: DataFrame, n: int, *order) -> DataFrame:
    """Exactly the first ``n`` rows of a total order; planned as a per-task top-n and a merge."""
    return rows.orderBy(*order).limit(n)


def rank_at_most(rows: DataFrame, metric: str, k: int, rank_name: str) -> DataFrame:
    """Rows whose ``RANK() OVER (ORDER BY metric DESC)`` is at most ``k``, ties included.

    A rank is one plus the number of rows with a larger metric, so a row ranks at most ``k`` exactly
    when its metric occurs among the ``k`` largest rows, and its rank is the place where that metric
    first occurs there.  Only those ``k`` rows go through the unpartitioned window; the ranks return
    through a broadcast of at most ``k`` values, and a tie of any size stays spread over the cluster.
    The order names every column so that both branches read the same exchange, which is reused.
    """
    down = F.col(metric).desc_nulls_last()
    others = [F.col(c).asc_nulls_last() for c in rows.columns if c != metric]
    place = F.rank().over(Window.orderBy(F.col(metric).desc_nulls_last())).cast("bigint")
    first = largest(rows, k, down, *others).select(F.col(metric).alias("_level"), place.alias(rank_name))
    levels = F.broadcast(first.distinct())
    return rows.join(levels, F.col(metric).eqNullSafe(F.col("_level")), "inner").drop("_level")
