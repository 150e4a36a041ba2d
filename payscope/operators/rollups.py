"""Aggregates over the payments table: quarterly views, headline facts, comparisons, shares.

Dollar sums stay decimal until the last step and leave as doubles. All sums are combined before
the shuffle, so the shuffle carries one row per group and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payscope.functions.ratios import guarded_percent

def _total() -> Column:
    return F.sum("amount_usd").cast("double").alias("total_usd")


def _quarterly(payments: DataFrame, *dims: str) -> DataFrame:
    return payments.groupBy("quarter", *dims).agg(_total(), F.count("*").alias("payment_count"))


def quarterly_totals(payments: DataFrame) -> DataFrame:
    return _quarterly(payments, "product", "manufacturer")


def quarterly_by_specialty(payments: DataFrame) -> DataFrame:
    """NULL specialties and NULL quarters form groups of their own."""
    return _quarterly(payments, "physician_specialty")


def quarterly_by_state(payments: DataFrame) -> DataFrame:
    return _quarterly(payments, "physician_state")


def register_views(payments: DataFrame) -> None:
    """The table and its three views under their names, for `spark.sql`. Safe to repeat."""
    payments.createOrReplaceTempView("payments")
    quarterly_totals(payments).createOrReplaceTempView("q_totals")
    quarterly_by_specialty(payments).createOrReplaceTempView("q_by_specialty")
    quarterly_by_state(payments).createOrReplaceTempView("q_by_state")


def total_dollars(payments: DataFrame, first_year: int | None = None, last_year: int | None = None):
    """One row; NULL when no row qualifies."""
    rows = payments
    if first_year is not None:
        rows = rows.filter(F.col("program_year").between(first_year, last_year))
    return rows.agg(_total())


def top_group(payments: DataFrame, dim: str, n: int = 1) -> DataFrame:
    """The group with the most dollars; NULL groups do not compete and names break ties."""
    return (
        payments.filter(F.col(dim).isNotNull())
        .groupBy(dim)
        .agg(_total())
        .orderBy(F.col("total_usd").desc(), dim)
        .limit(n)
    )


def dollars_per_quarter(payments: DataFrame, first: int | None = None) -> DataFrame:
    series = (
        payments.filter(F.col("quarter").isNotNull())
        .groupBy("quarter")
        .agg(_total())
        .orderBy("quarter")
    )
    return series if first is None else series.limit(first)


def share_of(payments: DataFrame, condition: Column, name: str) -> DataFrame:
    """Percent of all dollars in rows that meet the condition; NULL when no row meets it."""
    part = F.sum(F.when(condition, F.col("amount_usd")))
    return payments.agg(guarded_percent(part, F.sum("amount_usd")).alias(name))


def compare_groups(payments: DataFrame, dim: str, members: Sequence[str]) -> DataFrame:
    return payments.filter(F.col(dim).isin(list(members))).groupBy(dim).agg(_total())


def not_like_any(column: str, names: Sequence[str]) -> Column:
    """Free-text name holds none of the names, whatever the case."""
    condition = F.lit(True)
    for name in names:
        condition = condition & ~F.col(column).ilike(f"%{name}%")
    return condition


def year_count(payments: DataFrame, year: int) -> DataFrame:
    return payments.filter(F.col("program_year") == year).agg(F.count("*").alias("row_count"))


def capped(result: DataFrame, cap: int) -> DataFrame:
    """At most `cap` rows of a user query that sets no limit of its own."""
    return result.limit(cap)
