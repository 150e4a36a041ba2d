"""Dates as disclosed, and calendar quarters as labels (`2023Q2`) and as ordinals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from payscope.functions.text import strip

# The two accepted spellings of a date, tried in this order. There is no year 0.
DATE_SHAPES = (
    (r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/(?!0000)\d{4}$", "M/d/yyyy"),
)


def parse_date(raw: Column) -> Column:
    """The date of a raw text, NULL when it is blank, unreadable or not a calendar day."""
    text = strip(raw)
    (first_shape, first_form), (shape, form) = DATE_SHAPES
    return F.when(text.rlike(first_shape), F.try_to_date(text, first_form)).when(
        text.rlike(shape), F.try_to_date(text, form)
    )


def quarter_label(day: Column) -> Column:
    """`2023Q2`. The day appears once in the expression, as it may be a parse of a raw text."""
    return F.date_format(day, "y'Q'q")


def quarter_of(raw: Column) -> Column:
    return quarter_label(parse_date(raw))


def quarter_ordinal(label: Column) -> Column:
    """Quarters counted from year 0, so that neighbours differ by one."""
    year = F.substring(label, 1, 4).cast("int")
    return year * 4 + F.substring(label, 6, 1).cast("int") - 1


def ordinal_quarter(ordinal: Column) -> Column:
    year = F.floor(ordinal / 4).cast("int")
    nth = F.pmod(ordinal, F.lit(4)) + 1
    return F.concat(year.cast("string"), F.lit("Q"), nth.cast("string"))
