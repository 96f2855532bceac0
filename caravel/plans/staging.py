"""RAW -> STAGING.  Pure frame-to-frame functions, used unchanged by batch and by the feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravel import schemas
from caravel.functions import documents as doc
from caravel.functions.money import line_amount
from caravel.functions.text import key_text, label_text
from caravel.lake import now


def stamped(rows: DataFrame) -> DataFrame:
    """Add the STAGING load time."""
    return rows.withColumn("stg_loaded_at", now())


def customers(raw: DataFrame) -> DataFrame:
    known = raw.where(F.col("customer_id").isNotNull())
    return known.select(
        key_text(F.col("customer_id")).alias("customer_id"),
        label_text(F.col("email")).alias("email"),
        "first_name",
        "last_name",
        "city",
        "signup_date",
    )


def products(raw: DataFrame) -> DataFrame:
    data = F.col("data")
    return raw.select(
        doc.text_at(data, "product_id").alias("product_id"),
        doc.text_at(data, "name").alias("name"),
        doc.text_at(data, "category").alias("category"),
        doc.text_at(data, "brand").alias("brand"),
        doc.price_at(data, "price").alias("price"),
        doc.text_at(data, "attributes.color").alias("color"),
        doc.whole_number_at(data, "attributes.warranty_months").alias("warranty_months"),
        doc.whole_number_at(data, "attributes.weight_g").alias("weight_g"),
        doc.element_count(data, "tags").alias("nb_tags"),
    )


def orders(raw: DataFrame) -> DataFrame:
    known = raw.where(F.col("order_id").isNotNull())
    return known.select(
        key_text(F.col("order_id")).alias("order_id"),
        key_text(F.col("customer_id")).alias("customer_id"),
        F.col("order_date").alias("order_ts"),
        F.col("order_date").cast("date").alias("order_date"),
        label_text(F.col("status")).alias("status"),
        "total_amount",
    )


def _kept_lines(raw: DataFrame) -> DataFrame:
    """Order lines with a positive quantity and a price."""
    kept = raw.where((F.col("quantity") > 0) & (F.col("unit_price") >= 0))
    return kept.select(
        key_text(F.col("order_id")).alias("order_id"),
        key_text(F.col("product_id")).alias("product_id"),
        "quantity",
        "unit_price",
    )


def _with_amount(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line_amount", line_amount(F.col("quantity"), F.col("unit_price")))


def valid_lines(raw: DataFrame) -> DataFrame:
    """Order lines with a positive quantity and a price, and their amount."""
    return _with_amount(_kept_lines(raw))


def with_product(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Add name, category and brand where the product is known.

    The catalogue is joined without a hint: Spark broadcasts it only while its measured size is
    below the broadcast threshold, and otherwise shuffles, where AQE splits a hot product.
    """
    details = catalogue.select("product_id", F.col("name").alias("product_name"), "category", "brand")
    return rows.join(details, "product_id", "left")


def order_items(raw: DataFrame, catalogue: DataFrame) -> DataFrame:
    # Amounts follow from the line, so they need not shuffle with it.
    return _with_amount(with_product(_kept_lines(raw), catalogue)).select(*schemas.STAGING["order_items"])


def web_events(raw: DataFrame) -> DataFrame:
    data = F.col("data")
    parsed = raw.select(
        doc.text_at(data, "event_id").alias("event_id"),
        doc.text_at(data, "user_id").alias("user_id"),
        doc.text_at(data, "session_id").alias("session_id"),
        F.lower(doc.text_at(data, "event_type")).alias("event_type"),
        doc.text_at(data, "product_id").alias("product_id"),
        doc.moment_at(data, "timestamp").alias("event_ts"),
        doc.text_at(data, "device").alias("device"),
        F.coalesce(doc.text_at(data, "context.referrer"), F.lit("direct")).alias("referrer"),
        doc.text_at(data, "context.ip").alias("ip"),
    ).where(F.col("event_id").isNotNull())
    derived = parsed.withColumn("is_anonymous", F.col("user_id").isNull()).withColumn(
        "event_date", F.col("event_ts").cast("date")
    )
    return derived.select(*schemas.STAGING["web_events"])
