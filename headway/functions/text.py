"""Blank handling and digests shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without outer spaces and tabs; NULL stays NULL."""
    return F.trim(col(c), F.lit(BLANKS))


def strip_to_null(c: Column | str) -> Column:
    """Without outer spaces and tabs; blank becomes NULL."""
    return F.nullif(strip(c), F.lit(""))


def or_empty(c: Column | str) -> Column:
    """NULL becomes the empty string."""
    return F.coalesce(col(c), F.lit(""))


def some(c: Column | str) -> Column:
    """The empty string becomes NULL, nothing is trimmed."""
    return F.nullif(col(c), F.lit(""))
