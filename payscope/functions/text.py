"""Text helpers shared by all operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when text is stripped.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Remove white space of every kind at both ends (`trim` alone removes blanks only)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def is_missing(c: Column) -> Column:
    """True for NULL and for the empty string, never NULL."""
    return c.isNull() | (c == "")


def contains_any(c: Column, phrases) -> Column:
    """Case-insensitive: does the text hold at least one phrase? NULL text gives false."""
    low = F.lower(c)
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | low.contains(phrase.lower())
    return F.coalesce(hit, F.lit(False))


def evidence_id(sql: Column) -> Column:
    """`q_` and the first 8 hex digits of the SHA-256 of the SQL text."""
    return F.concat(F.lit("q_"), F.substring(F.sha2(sql, 256), 1, 8))


def series_evidence_id(series_key: Column) -> Column:
    """`f_` and the series key with colons and blanks replaced by underscores."""
    return F.concat(F.lit("f_"), F.translate(series_key, ": ", "__"))
