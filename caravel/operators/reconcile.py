"""Two large tables held against each other without shuffling their rows.

Rows are dealt to buckets by a hash of all their columns. A bucket's fingerprint is the number of rows and the sums of two 64-bit row hashes,
counted with the opposite sign in the other table: it is zero where both have the same rows as often, in whatever order. Only numbers
of buckets are shuffled. Buckets that differ are split finer, and only rows of the fine buckets that still differ are
compared as rows. Copies count, NULLs are equal, a hot key does not matter because whole rows are hashed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravel.workspace import scratch_folder

LEVELS = (4096, 1024)
HASH_2_SEED = 7919


def _signed(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both tables with their hashes and a sign."""
    if dict(left.dtypes) != dict(right.dtypes):
        raise ValueError(f"tables of different columns: {left.dtypes} against {right.dtypes}")
    both = left.withColumn("_sign", F.lit(1)).unionByName(right.withColumn("_sign", F.lit(-1)))
    # A NULL leaves a hash as it is, so whether a value is NULL is hashed beside it.
    values = [part for name in left.columns for part in (F.col(f"`{name}`"), F.col(f"`{name}`").isNull())]
    return both.withColumns({"_h1": F.xxhash64(*values), "_h2": F.xxhash64(F.lit(HASH_2_SEED), *values)})


def _unequal(rows: DataFrame, buckets: int) -> DataFrame:
    """Buckets whose fingerprints differ; tasks send one row a bucket."""
    total = {f"_s{i}": F.sum(F.col(h).cast("decimal(20,0)") * F.col("_sign")) for i, h in enumerate(("_h1", "_h2"))}
    sums = rows.groupBy(F.pmod("_h1", F.lit(buckets)).alias("_bucket")).agg(
        F.sum("_sign").alias("_n"), *[s.alias(name) for name, s in total.items()]
    )
    return sums.where("_n <> 0 OR _s0 <> 0 OR _s1 <> 0").select("_bucket")


def suspects(left: DataFrame, right: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Rows of both tables that lie in fine buckets that differ, with their sign.

    The list of unequal buckets is written, so that Spark knows its size: below its broadcast threshold no row is
    shuffled to be picked out; tables that differ everywhere are joined by bucket instead.
    """
    rows, of = _signed(left, right), 1
    chosen = rows
    for size in levels:
        of *= size
        path = scratch_folder(rows.sparkSession, "unequal")
        _unequal(chosen, of).write.mode("overwrite").parquet(path)
        found = rows.sparkSession.read.schema("_bucket bigint").parquet(path)
        chosen = rows.withColumn("_bucket", F.pmod("_h1", F.lit(of))).join(found, "_bucket", "left_semi").drop("_bucket")
    return chosen


def same(left: DataFrame, right: DataFrame, buckets: int = LEVELS[0]) -> bool:
    """Whether both tables hold the same rows equally often."""
    return _unequal(_signed(left, right), buckets).isEmpty()


def differences(left: DataFrame, right: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Every row that the tables hold unequally often, with its copies in each."""
    counts = {name: F.count_if(F.col("_sign") == sign).alias(name) for name, sign in (("copies_left", 1), ("copies_right", -1))}
    names = [F.col(f"`{name}`") for name in left.columns]
    return suspects(left, right, levels).groupBy(*names).agg(*counts.values()).where("copies_left <> copies_right")
