"""The supplied test tables as the shop's RAW and STAGING frames.

Every row of the supplied tables is used.  Some values are deliberately spoilt (blanks around
ids, upper case, missing keys, explicit nulls, zero quantities, unknown products) so that the
clean-up rules have work to do; FIXTURES.md lists them and the oracle SQL applies the same rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of the second delivery: by key, so that days, customers and products have rows in both.
SECOND_BATCH = {"orders": ("o_orderkey", 5, 2), "order_items": ("l_partkey", 4, 1), "web_events": ("event_id", 5, 3)}

# Columns of the supplied tables that are used, so that no footer is read to find them out.
SUPPLIED = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_shipdate timestamp_ntz",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SUPPLIED[name]).parquet(f"{sf_dir}/{name}.parquet")


def _padded(prefix: Column | str, key: Column, width: int, blanks: Column | None = None) -> Column:
    """Prefix and zero-padded key; where ``blanks`` holds, with a blank before and two after."""
    digits = key.cast("string")
    number = F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0"))
    start = F.lit(prefix) if isinstance(prefix, str) else prefix
    if blanks is None:
        return F.concat(start, number)
    return F.concat(_either(blanks, " ", ""), start, number, _either(blanks, "  ", ""))


def _either(condition: Column, yes: str, no: str) -> Column:
    return F.when(condition, F.lit(yes)).otherwise(F.lit(no))


def order_id(key: Column, blanks: Column | None = None) -> Column:
    return _padded("O", key, 7, blanks)


def customer_id(key: Column, blanks: Column | None = None) -> Column:
    return _padded("C", key, 6, blanks)


def product_id(key: Column) -> Column:
    return _padded("P", key, 6)


def _with_blanks(text: Column, blanks: Column) -> Column:
    return F.concat(_either(blanks, " ", ""), text, _either(blanks, "  ", ""))


def _batch(rows: DataFrame, source: str, batch: str | None) -> DataFrame:
    """The first ("j1") or second ("j2") delivery, or both."""
    if batch is None:
        return rows
    key, of, rest = SECOND_BATCH[source]
    second = F.col(key) % of == rest
    return rows.where(second if batch == "j2" else ~second)


def raw_orders(spark: SparkSession, sf_dir: str, batch: str | None = None) -> DataFrame:
    source = _batch(table(spark, sf_dir, "orders"), "orders", batch)
    key = F.col("o_orderkey")
    return source.select(
        F.when(key % 101 != 0, order_id(key, key % 4 == 0)).alias("order_id"),
        customer_id(F.col("o_custkey"), key % 6 == 0).alias("customer_id"),
        F.col("o_orderdate").alias("order_date"),
        _with_blanks(F.col("o_orderstatus"), key % 5 == 0).alias("status"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("total_amount"),
    )


def raw_order_items(spark: SparkSession, sf_dir: str, batch: str | None = None) -> DataFrame:
    source = _batch(table(spark, sf_dir, "lineitem"), "order_items", batch)
    order, part = F.col("l_orderkey"), F.col("l_partkey")
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    return source.select(
        _padded(_either(order % 89 == 0, "Z", "O"), order, 7, order % 4 == 0).alias("order_id"),
        _padded(_either(part % 37 == 0, "X", "P"), part, 6, F.col("l_linenumber") % 2 == 0).alias("product_id"),
        F.when(part % 50 == 0, F.lit(0)).otherwise(F.col("l_quantity")).cast("bigint").alias("quantity"),
        F.when(part % 41 == 0, -price).otherwise(price).cast("decimal(12,2)").alias("unit_price"),
    )


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    email = F.concat(F.lower("c_name"), F.lit("@example.com"))
    signup = F.date_add(F.lit("1995-01-01").cast("date"), (key % 1500).cast("int"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.when(key % 89 != 0, customer_id(key, key % 4 == 0)).alias("customer_id"),
            F.when(key % 3 == 0, _with_blanks(F.upper(email), key % 2 == 0)).otherwise(email).alias("email"),
            F.col("c_name").alias("first_name"),
            F.when(key % 53 != 0, F.col("c_mktsegment")).alias("last_name"),
            F.col("n_name").alias("city"),
            F.when(key % 97 != 0, signup).alias("signup_date"),
        )
    )


def _part_tags() -> Column:
    key = F.col("p_partkey")
    words = F.split("p_name", " ")
    return F.when(key % 11 != 0, F.when(key % 7 == 0, F.array().cast("array<string>")).otherwise(words))


def product_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a product document; a NULL field is a missing key once written."""
    return table(spark, sf_dir, "part").select(
        product_id(F.col("p_partkey")).alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
        F.struct(
            F.substring_index("p_name", " ", 1).alias("color"),
            (F.lit(12) + F.col("p_partkey") % 3 * 12).alias("warranty_months"),
            (F.col("p_size") * 100).alias("weight_g"),
        ).alias("attributes"),
        _part_tags().alias("tags"),
    )


def product_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product documents as JSON text."""
    fields = product_fields(spark, sf_dir)
    return fields.select(F.to_json(F.struct(*fields.columns)).alias("value"))


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_json(spark, sf_dir).select(F.parse_json("value").alias("data"))


def _event_id() -> Column:
    return F.when(F.col("event_id") % 499 != 0, F.col("event_id").cast("string"))


def _event_source(spark: SparkSession, sf_dir: str, batch: str | None) -> DataFrame:
    source = _batch(table(spark, sf_dir, "events"), "web_events", batch)
    return source.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


_DEVICES = ("desktop", "mobile", "tablet")


def _event_device() -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in _DEVICES]), F.col("k") % 3 + 1)


def _event_product() -> Column:
    return F.when(F.col("k") % 10 != 0, product_id(F.col("k")))


def _event_session() -> Column:
    return F.concat_ws("-", F.col("user_id").cast("string"), F.col("ts").cast("date").cast("string"))


def web_event_fields(spark: SparkSession, sf_dir: str, batch: str | None = None) -> DataFrame:
    """Fields of an event document.  Of the anonymous ones half lack ``user_id``, half have ``null``."""
    source = _event_source(spark, sf_dir, batch)
    event, k = F.col("event_id"), F.col("k")
    user = F.when(F.col("user_id") % 5 != 0, customer_id(F.col("user_id")).cast("variant"))
    user = user.when(event % 2 == 0, F.parse_json(F.lit("null")))
    return source.select(
        _event_id().alias("event_id"),
        user.alias("user_id"),
        _event_session().alias("session_id"),
        F.when(k % 3 == 1, F.upper("event_type")).otherwise(F.col("event_type")).alias("event_type"),
        _event_product().alias("product_id"),
        F.translate(F.col("ts").cast("string"), " ", "T").alias("timestamp"),
        _event_device().alias("device"),
        F.struct(
            F.lit("agent").alias("user_agent"),
            F.concat(F.lit("10.0.0."), k.cast("string")).alias("ip"),
            F.when(k % 4 != 0, F.lit("search")).alias("referrer"),
        ).alias("context"),
    )


def raw_web_events(spark: SparkSession, sf_dir: str, batch: str | None = None) -> DataFrame:
    """Event documents as RAW holds them.  Here a missing field is a null one; the files have both."""
    fields = web_event_fields(spark, sf_dir, batch)
    return fields.select(F.to_variant_object(F.struct(*fields.columns)).alias("data"))
