"""Distinct customers of any period, exactly, from small states by day that are merged instead of counted again.

Every customer id gets a number once and keeps it: ids are dealt to slots by their hash and counted on in each slot, so numbers stay dense
without one task seeing all ids. The state of a day holds, for every chunk of 32,768 numbers, the customers with an order: as a list of
places while they are few, as a bitmap beyond. States of several days or deliveries are merged by OR, so a customer counts once
however often they appear. Orders without a date or customer are in no state. A state row is 4 KB at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 1024
FEW = 1024  # places in a list; four bytes each, so that a longer list would be larger than the bitmap

IDS = "customer_id string, number bigint"
STATE = "order_date date, chunk bigint, places array<int>, bits binary"


def new_numbers(known: DataFrame, orders: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Customers of the orders that have no number yet, with their numbers; ``slots`` stays the same for the life of the numbers."""
    ids = orders.select("customer_id").where(F.col("customer_id").isNotNull()).distinct().join(known, "customer_id", "left_anti")
    dealt = ids.withColumn("slot", F.pmod(F.xxhash64("customer_id"), F.lit(slots)))
    rank = F.expr(f"(number - 1) div {slots} + 1")
    taken = known.groupBy(F.pmod(F.col("number") - 1, F.lit(slots)).alias("slot")).agg(F.max(rank).alias("taken"))
    turn = F.row_number().over(Window.partitionBy("slot").orderBy("customer_id"))
    placed = dealt.withColumn("turn", turn).join(taken, "slot", "left")
    number = (F.coalesce("taken", F.lit(0)) + F.col("turn") - 1) * slots + F.col("slot") + 1
    return placed.select("customer_id", number.cast("bigint").alias("number"))


def day_states(orders: DataFrame, numbers: DataFrame, few: int = FEW) -> DataFrame:
    """The state of every day of the orders. Each (day, customer) travels once; a day's chunk is at most 32,768 of them."""
    seen = orders.select("order_date", "customer_id").where(F.col("order_date").isNotNull()).distinct().join(numbers, "customer_id")
    place, chunk = F.bitmap_bit_position("number").cast("int"), F.bitmap_bucket_number("number")
    dealt = seen.select("order_date", chunk.alias("chunk"), place.alias("place")).repartition("order_date", "chunk")
    both = dealt.groupBy("order_date", "chunk").agg(
        F.sort_array(F.collect_list("place")).alias("places"), F.bitmap_construct_agg(F.col("place").cast("bigint")).alias("bits")
    )
    short = F.size("places") <= few
    return both.select("order_date", "chunk", F.when(short, F.col("places")).alias("places"), F.when(~short, F.col("bits")).alias("bits"))


def unique(states: DataFrame, *keys: str) -> DataFrame:
    """Distinct customers of all the states, or of those that share the key columns.

    The states are shuffled once, as they are, by keys and chunk; both kinds become bitmaps there and are put together.
    """
    one = states.repartition(*keys, "chunk").select(*keys, "chunk", "bits", F.explode_outer("places").alias("place"))
    kinds = F.array(F.bitmap_construct_agg(F.col("place").cast("bigint")), F.bitmap_or_agg("bits"))
    apart = one.groupBy(*keys, "chunk").agg(kinds.alias("kinds")).select(*keys, "chunk", F.explode("kinds").alias("bits"))
    whole = apart.groupBy(*keys, "chunk").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    return whole.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("unique_customers"))
