"""Two-group difference-in-differences on quarterly dollar totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The manufacturers treated by default.
TREATED = ("Novo Nordisk", "Eli Lilly")


def is_treated(treated: Sequence[str], match: str = "exact") -> Column:
    """Whole names by default; `ilike` also accepts names with additions, whatever the case."""
    if match == "exact":
        return F.coalesce(F.col("manufacturer").isin(list(treated)), F.lit(False))
    if match != "ilike":
        raise ValueError(f"unknown match {match!r}")
    hit = F.lit(False)
    for name in treated:
        hit = hit | F.col("manufacturer").ilike(f"%{name}%")
    return F.coalesce(hit, F.lit(False))


def group_series(
    payments: DataFrame, treated: Sequence[str] = TREATED, match: str = "exact"
) -> DataFrame:
    """Dollars of both groups for each quarter (NULL: no row of that group in the quarter)."""
    rows = payments.filter(F.col("quarter").isNotNull())
    flag = is_treated(treated, match)
    return rows.groupBy("quarter").agg(
        F.sum(F.when(flag, F.col("amount_usd"))).alias("treated_usd"),
        F.sum(F.when(~flag, F.col("amount_usd"))).alias("control_usd"),
    )


def with_event(series: DataFrame, event_quarter: str | None = None) -> DataFrame:
    """Adds the event quarter (by default the upper median of those present) and the period.

    `series` has one row per calendar quarter, so the windows over all of it are small.
    """
    if event_quarter is not None:
        event = F.lit(event_quarter)
        placed = series.withColumn("event_quarter", event)
    else:
        everything = Window.partitionBy(F.lit(0))
        numbered = series.select(
            "*",
            F.row_number().over(everything.orderBy("quarter")).alias("_nth"),
            F.count("*").over(everything).alias("_n"),
        )
        median = F.when(F.col("_nth") == F.floor(F.col("_n") / 2) + 1, F.col("quarter"))
        placed = numbered.withColumn("event_quarter", F.max(median).over(everything)).drop(
            "_nth", "_n"
        )
    period = F.when(F.col("quarter") < F.col("event_quarter"), F.lit("before")).otherwise(
        F.lit("after")
    )
    return placed.withColumn("period", period)


def trend_table(series: DataFrame, event_quarter: str | None = None) -> DataFrame:
    """Both series side by side, for a look at whether they moved alike before the event."""
    return with_event(series, event_quarter).select(
        "quarter",
        "period",
        F.col("treated_usd").cast("double").alias("treated_usd"),
        F.col("control_usd").cast("double").alias("control_usd"),
    )


def estimate(series: DataFrame, event_quarter: str | None = None) -> DataFrame:
    """One row: four means, two changes and their difference; or why there is no estimate."""
    placed = with_event(series, event_quarter)

    def mean(group: str, period: str) -> Column:
        cell = F.when(F.col("period") == period, F.col(f"{group}_usd"))
        return F.try_divide(F.sum(cell).cast("double"), F.count(cell))

    def quarters(period: str) -> Column:
        return F.count_if(F.col("period") == period)

    cells = [(g, p) for g in ("treated", "control") for p in ("before", "after")]
    means = placed.agg(
        F.max("event_quarter").alias("event_quarter"),
        quarters("before").alias("n_before"),
        quarters("after").alias("n_after"),
        *[mean(g, p).alias(f"{g}_mean_{p}_usd") for g, p in cells],
    )
    empty = F.array_compact(
        F.array(*[F.when(F.col(f"{g}_mean_{p}_usd").isNull(), f"{g}_{p}") for g, p in cells])
    )
    ok = F.size(empty) == 0
    change = {
        g: F.when(ok, F.col(f"{g}_mean_after_usd") - F.col(f"{g}_mean_before_usd"))
        for g in ("treated", "control")
    }
    return means.select(
        ok.alias("ok"),
        F.when(F.col("n_before") + F.col("n_after") == 0, F.lit("no rows with a quarter"))
        .when(~ok, F.concat(F.lit("insufficient data for: "), F.array_join(empty, ", ")))
        .alias("reason"),
        "event_quarter",
        "n_before",
        "n_after",
        *[f"{g}_mean_{p}_usd" for g, p in cells],
        change["treated"].alias("treated_delta_usd"),
        change["control"].alias("control_delta_usd"),
        (change["treated"] - change["control"]).alias("diff_in_diff_usd"),
    )
