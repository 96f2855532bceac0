"""Typed access to VARIANT documents.

A JSON ``null`` and a missing key are different variants but the same thing to the business,
so every accessor casts first; null tests belong on the cast value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_at(doc: Column, path: str) -> Column:
    return F.variant_get(doc, f"$.{path}", "string")


def whole_number_at(doc: Column, path: str) -> Column:
    return F.variant_get(doc, f"$.{path}", "decimal(38,0)").cast("bigint")


def price_at(doc: Column, path: str) -> Column:
    return F.variant_get(doc, f"$.{path}", "decimal(10,2)")


def moment_at(doc: Column, path: str) -> Column:
    """Zone-less timestamp; an offset in the text is dropped, not applied."""
    return F.variant_get(doc, f"$.{path}", "timestamp_ntz")


def element_count(doc: Column, path: str) -> Column:
    """Length of an array, 0 when it is missing, null or not an array."""
    items = F.try_variant_get(doc, f"$.{path}", "array<variant>")
    return F.coalesce(F.array_size(items), F.lit(0)).cast("bigint")


def elements_at(doc: Column, path: str) -> Column:
    """Array elements as text; NULL when there is no array to explode."""
    return F.try_variant_get(doc, f"$.{path}", "array<string>")


def says_null(text: Column) -> Column:
    """True for a missing value and for the literal word ``null``."""
    return text.isNull() | (text == F.lit("null"))
