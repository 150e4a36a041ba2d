"""Quarterly dollar series from payments: national and for the largest specialties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payscope.functions.calendar import quarter_ordinal

UNKNOWN = "(unknown)"
NATIONAL = "national"


def specialty_quarters(payments: DataFrame) -> DataFrame:
    """Dollars by specialty and quarter, rows without a quarter left out; NULL is `(unknown)`.

    This is the only pass over the payments. Everything else here reads this small aggregate.
    """
    return (
        payments.filter(F.col("quarter").isNotNull())
        .groupBy(F.coalesce("physician_specialty", F.lit(UNKNOWN)).alias("specialty"), "quarter")
        .agg(F.sum("amount_usd").alias("usd"))
    )


def top_specialties(aggregate: DataFrame, n: int = 5) -> DataFrame:
    """The specialties with the largest totals, ties by name."""
    return (
        aggregate.groupBy("specialty")
        .agg(F.sum("usd").alias("total"))
        .orderBy(F.col("total").desc(), "specialty")
        .limit(n)
    )


def national_series(payments: DataFrame) -> DataFrame:
    totals = specialty_quarters(payments).groupBy("quarter").agg(F.sum("usd").alias("usd"))
    return totals.select(
        F.lit(NATIONAL).alias("series_key"), "quarter", F.col("usd").cast("double").alias("value")
    )


def specialty_series(payments: DataFrame, top_n: int) -> DataFrame:
    aggregate = specialty_quarters(payments)
    top = F.broadcast(top_specialties(aggregate, top_n).select("specialty"))
    return aggregate.join(top, "specialty", "left_semi").select(
        F.concat(F.lit("specialty:"), "specialty").alias("series_key"),
        "quarter",
        F.col("usd").cast("double").alias("value"),
    )


def all_series(payments: DataFrame, top_n: int | None = None) -> DataFrame:
    """National and specialty series from one pass, as grouping sets over the small aggregate.

    Every specialty has its series unless `top_n` asks for the largest ones only.
    """
    aggregate = specialty_quarters(payments)
    cubed = aggregate.groupingSets(
        [[F.col("quarter")], [F.col("specialty"), F.col("quarter")]], "specialty", "quarter"
    ).agg(F.grouping("specialty").alias("is_national"), F.sum("usd").alias("usd"))
    if top_n is not None:
        top = top_specialties(aggregate, top_n).select("specialty", F.lit(True).alias("is_top"))
        # `top` is a limit of top_n rows, so its broadcast is bounded.
        cubed = cubed.join(F.broadcast(top), "specialty", "left").filter(
            (F.col("is_national") == 1) | F.col("is_top")
        )
    key = F.when(F.col("is_national") == 1, F.lit(NATIONAL)).otherwise(
        F.concat(F.lit("specialty:"), F.col("specialty"))
    )
    return cubed.select(
        key.alias("series_key"), "quarter", F.col("usd").cast("double").alias("value")
    )


def windows_summary(series: DataFrame, train_end: str, horizon: int = 4) -> DataFrame:
    """For each series its first and last quarter, counts, and whether quarters are missing."""
    q = quarter_ordinal(F.col("quarter"))
    end = quarter_ordinal(F.lit(train_end))
    return series.groupBy("series_key").agg(
        F.min("quarter").alias("first_quarter"),
        F.max("quarter").alias("last_quarter"),
        F.count("*").alias("n_quarters"),
        F.count_if(q <= end).alias("n_train"),
        F.count_if((q > end) & (q <= end + horizon)).alias("n_test"),
        (F.max(q) - F.min(q) + 1 != F.count("*")).alias("has_gaps"),
    )
