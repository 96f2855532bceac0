"""Queries directly on product and event documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravel.functions import documents as doc
from caravel.functions.money import safe_ratio
from caravel.operators.profile import distribution
from caravel.plans import staging


def product_attributes(raw_products: DataFrame) -> DataFrame:
    """Scalar fields and the nested attributes, typed."""
    return staging.products(raw_products).drop("nb_tags")


def category_price_stats(raw_products: DataFrame) -> DataFrame:
    """Products and average price per category, dearest first."""
    data = F.col("data")
    priced = raw_products.select(
        doc.text_at(data, "category").alias("category"), doc.price_at(data, "price").alias("price")
    )
    average = safe_ratio(F.sum("price"), F.count("price"))
    stats = priced.groupBy("category").agg(F.count(F.lit(1)).alias("nb_products"), average.alias("avg_price"))
    return stats.orderBy(F.col("avg_price").desc_nulls_last(), F.col("category").asc_nulls_last())


def product_tags_outer(raw_products: DataFrame) -> DataFrame:
    """One row per product and tag; a product without tags keeps one row."""
    data = F.col("data")
    named = raw_products.select(
        doc.text_at(data, "product_id").alias("product_id"),
        doc.text_at(data, "name").alias("name"),
        doc.elements_at(data, "tags").alias("tags"),
    )
    return named.select("product_id", "name", F.explode_outer("tags").alias("tag"))


def tag_distribution(raw_products: DataFrame) -> DataFrame:
    """Products per tag; products without tags do not appear."""
    tags = raw_products.select(F.explode(doc.elements_at(F.col("data"), "tags")).alias("tag"))
    return distribution(tags, F.col("tag"), "tag", "nb_products")


def events_in_place(raw_events: DataFrame) -> DataFrame:
    """Fields of every event document, as landed."""
    data = F.col("data")
    return raw_events.select(
        *[
            doc.text_at(data, name).alias(name)
            for name in ("event_id", "user_id", "session_id", "event_type", "product_id")
        ],
        doc.moment_at(data, "timestamp").alias("event_ts"),
        doc.text_at(data, "device").alias("device"),
        doc.text_at(data, "context.referrer").alias("referrer"),
        doc.text_at(data, "context.ip").alias("ip"),
    )


def event_type_counts(raw_events: DataFrame) -> DataFrame:
    return distribution(raw_events, doc.text_at(F.col("data"), "event_type"), "event_type", "nb_events")


def event_device_counts(raw_events: DataFrame) -> DataFrame:
    return distribution(raw_events, doc.text_at(F.col("data"), "device"), "device", "nb")


def event_ts_bounds(raw_events: DataFrame) -> DataFrame:
    moment = doc.moment_at(F.col("data"), "timestamp")
    return raw_events.agg(F.min(moment).alias("first_event"), F.max(moment).alias("last_event"))


def event_null_profile(raw_events: DataFrame) -> DataFrame:
    """How many events lack a user, a product, a referrer (missing, null, or the word null)."""
    data = F.col("data")
    paths = {"user_id": "user_id", "product_id": "product_id", "referrer": "context.referrer"}
    fields = raw_events.select(*[doc.text_at(data, path).alias(name) for name, path in paths.items()])
    missing = [F.count_if(doc.says_null(F.col(name))).alias(f"{name}_null") for name in paths]
    return fields.agg(F.count(F.lit(1)).alias("total"), *missing)
