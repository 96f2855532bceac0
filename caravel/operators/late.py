"""Lines that came before their product, completed when they are read.

A line whose product is unknown is stored without name, category and brand, apart from the others. When the
product comes, only its label is written, with the batches of lines that it holds for: after the last batch that an earlier label
of the product covers, up to the newest one then. Lines are never rewritten, and a batch of labels takes effect as a whole.

A product without name, category and brand counts as one that has not come. Lines without a product id wait for nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DETAILS = ("product_name", "category", "brand")


def unlabelled() -> Column:
    """Whether name, category and brand are all missing."""
    return F.coalesce(*DETAILS).isNull()


def is_late() -> Column:
    """1 for lines whose product has still to come."""
    return (F.col("product_id").isNotNull() & unlabelled()).cast("int")


def _named(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("product_id").alias("_product"), "_after", "_through", *[F.col(c).alias(f"_{c}") for c in DETAILS])


def _holds() -> Column:
    """Whether a label is for the line's product and batch; both sides shuffle by product, so AQE may split a hot one."""
    within = (F.col("_after") < F.col("_src_batch")) & (F.col("_src_batch") <= F.col("_through"))
    return (F.col("product_id") == F.col("_product")) & within


def completed(late: DataFrame, labels: DataFrame) -> DataFrame:
    """Late lines with the labels that hold for them; lines without one stay as they are."""
    joined = late.join(_named(labels), _holds(), "left")
    return joined.select(*[F.col(f"_{c}").alias(c) if c in DETAILS else c for c in late.columns])


def waiting(late: DataFrame, labels: DataFrame) -> DataFrame:
    """Late lines that no label holds for."""
    return late.join(_named(labels), _holds(), "left_anti")


def new_labels(late: DataFrame, labels: DataFrame, catalogue: DataFrame, through: str) -> DataFrame:
    """Labels of the products that have come for waiting lines, for the batches that no label of theirs covers."""
    wanted = waiting(late, labels).select("product_id").distinct()
    known = catalogue.select("product_id", F.col("name").alias("product_name"), "category", "brand").where(~unlabelled())
    before = labels.groupBy("product_id").agg(F.max("_through").alias("_after"))
    found = known.join(wanted, "product_id", "left_semi").join(before, "product_id", "left")
    return found.select("product_id", *DETAILS, F.coalesce("_after", F.lit("")).alias("_after"), F.lit(through).alias("_through"))


def relabelled(sales: DataFrame, labels: DataFrame) -> DataFrame:
    """Sums by product, those without details under the labels that have come since."""
    joined = sales.join(_named(labels), (F.col("product_id") == F.col("_product")) & unlabelled(), "left")
    return joined.select(*[F.coalesce(c, f"_{c}").alias(c) if c in DETAILS else c for c in sales.columns])
