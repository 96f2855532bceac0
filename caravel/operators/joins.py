"""Joins shaped so that repeated keys do not multiply work and hot keys can be split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_join(rows: DataFrame, others: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi join whose skewed partitions AQE can split although ``others`` comes out of an aggregate.

    An aggregate leaves its rows partitioned by the key, and a join on the key alone takes that over;
    AQE splits only where both inputs were shuffled for the join. The hash as a second join column makes
    them so, at the price of shuffling the aggregated side once more.
    """
    mark = F.xxhash64(key).alias("_mark")
    return rows.select("*", mark).join(others.select("*", mark), ["_mark", key], how).drop("_mark")


# Bits of the filter of `possible_matches`: this many words of 64, at most one row each.
FILTER_WORDS = 1 << 20


def possible_matches(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be among the keys of ``others``; put before a join that drops most rows, so that those do not shuffle.

    Keys of ``others`` set one bit each by their hash, and the words that hold a bit go to every task. No match is
    missed, whatever the numbers; a few rows without one pass, more of them the more keys there are, and the join decides on these.
    """
    place = F.xxhash64(key)
    word, bit = place.bitwiseAND(F.lit(FILTER_WORDS - 1)), F.shiftrightunsigned(place, 58).cast("int")
    words = others.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("_bits"))
    set_bit = (word == F.col("_word")) & (F.getbit("_bits", bit) == 1)
    return rows.join(F.broadcast(words), set_bit, "left_semi")


def with_copies(rows: DataFrame, key: str) -> DataFrame:
    """One row per key with its number of copies.

    Joining this instead of the rows keeps the join one-to-many: a key with many copies on both
    sides would otherwise give every pair.  Multiply by ``copies`` to get the same sums.
    """
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))


def without_match(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other frame lacks (a NULL key has no match)."""
    return split_join(rows, others.select(key).distinct(), key, "left_anti")


def keep_keys(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    return split_join(rows, others.select(key).distinct(), key, "left_semi")


def first_keys(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Keys of the first ``n`` rows in key order, NULL last; at most ``n`` rows by construction."""
    return rows.select(key).orderBy(F.col(key).asc_nulls_last()).limit(n)
