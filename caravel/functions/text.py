"""Text clean-up used on the way into STAGING and by the CSV format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokens a delimited file may use for "no value".
NULL_TOKENS = ("", "NULL", "null")


def blank_to_null(text: Column) -> Column:
    """NULL for any of the null tokens, the text itself otherwise."""
    return F.when(~text.isin(*NULL_TOKENS), text)


def key_text(text: Column) -> Column:
    """An identifier without the blanks around it."""
    return F.trim(text)


def label_text(text: Column) -> Column:
    """A label (status, e-mail) compared without blanks or case."""
    return F.lower(F.trim(text))


def strict_cast(text: Column, name: str, to_type: str) -> Column:
    """Cast that fails the job on a bad value, whatever the session's ANSI setting is.

    A NULL input stays NULL; only a value that cannot be read as ``to_type`` raises.
    """
    complaint = F.concat(F.lit(f"cannot read {name} as {to_type}: "), text)
    return F.coalesce(tolerant_cast(text, to_type), F.when(text.isNotNull(), F.raise_error(complaint).cast(to_type)))


def tolerant_cast(text: Column, to_type: str) -> Column:
    """Cast that gives NULL on a bad value.  Whole numbers round half up, as a decimal load does."""
    if to_type == "bigint":
        # Most texts are plain digits, which need no decimal in between; any other text is none to the first cast.
        return F.coalesce(text.try_cast("bigint"), text.try_cast("decimal(38,0)").try_cast("bigint"))
    return text.try_cast(to_type)


def full_name(first: Column, last: Column) -> Column:
    """First and last name; NULL when either is missing."""
    return F.concat(first, F.lit(" "), last)


def mask_email(email: Column) -> Column:
    """Keep the first letter and the domain, hide the rest."""
    shown = F.concat(F.substring(email, 1, 1), F.lit("***@"), F.substring_index(email, "@", -1))
    return F.when(email.contains("@"), shown).when(email.isNotNull(), F.lit("***"))
