"""Text expressions shared by retrieval operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case Unicode word tokens in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w+\b"), F.lit(0))


def strip(text: Column) -> Column:
    """Without any white space at both ends (trim() takes blanks only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
