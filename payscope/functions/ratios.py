"""Guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def guarded_percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, rounded; NULL when the part is NULL or the whole is NULL or zero."""
    safe = F.nullif(whole.cast("double"), F.lit(0.0))
    return F.round(F.lit(100.0) * part.cast("double") / safe, digits)
