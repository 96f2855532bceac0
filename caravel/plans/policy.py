"""Views that limit what a caller may see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravel.functions.text import mask_email
from caravel.operators.joins import keep_keys


def customers_view(customers: DataFrame, may_see_email: bool) -> DataFrame:
    """Customers with the e-mail in clear only for a caller who may see it."""
    return customers if may_see_email else customers.withColumn("email", mask_email(F.col("email")))


def orders_for_cities(orders: DataFrame, customers: DataFrame, cities: tuple[str, ...]) -> DataFrame:
    """Orders of customers in the cities a caller is responsible for; no city, no orders."""
    allowed = customers.where(F.col("city").isin(*cities) if cities else F.lit(False))
    return keep_keys(orders, allowed, "customer_id")
