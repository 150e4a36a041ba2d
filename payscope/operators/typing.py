"""Landed text records to typed payments, with a stated reason for every row that cannot load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payscope import schemas as S
from payscope.functions.calendar import parse_date, quarter_label
from payscope.functions.text import blank_to_null, is_missing, strip


def _reason(record_id: Column, what: str) -> Column:
    return F.concat(F.lit("record "), record_id, F.lit(": " + what))


_TEXT_REQUIRED = ("manufacturer", "product", "matched_field", "source_year_dataset")


def _year() -> Column:
    return strip(F.col("program_year")).try_cast("int")


def _amount() -> Column:
    return strip(F.col("amount_usd")).try_cast(S.AMOUNT_TYPE)


def _reject_reason() -> Column:
    """Why a landed row cannot load, NULL when it can. Checked in the order of the columns."""
    record, amount = F.col("record_id"), F.col("amount_usd")
    number = strip(amount).try_cast("double")
    is_number = F.coalesce(~F.isnan(number) & (F.abs(number) != float("inf")), F.lit(False))
    reason = (
        F.when(is_missing(record), F.lit("row without record_id"))
        .when(is_missing(F.col("program_year")), _reason(record, "program_year is missing"))
        .when(_year().isNull(), _reason(record, "program_year is not an integer"))
        .when(is_missing(amount), _reason(record, "amount_usd is missing"))
        .when(
            _amount().isNull(),
            F.when(is_number, _reason(record, "amount_usd is out of range")).otherwise(
                _reason(record, "amount_usd is not numeric")
            ),
        )
    )
    for name in _TEXT_REQUIRED:
        reason = reason.when(is_missing(F.col(name)), _reason(record, f"{name} is missing"))
    return reason


def can_load() -> Column:
    """The same decision as a plain predicate, without building a text."""
    fits = _year().isNotNull() & _amount().isNotNull()
    for name in ("record_id", *_TEXT_REQUIRED):
        fits = fits & (F.col(name) != "")
    return fits


def _typed_columns(landed: DataFrame) -> list[Column]:
    values = {
        "program_year": _year(),
        "payment_date": parse_date(F.col("payment_date")),
        "amount_usd": _amount(),
    }
    required = ("record_id", *_TEXT_REQUIRED)
    columns = [
        values.get(n, F.col(n) if n in required else blank_to_null(F.col(n))).alias(n)
        for n in S.PAYMENT.names
    ]
    return columns + [F.col(n) for n in landed.columns if n not in S.PAYMENT.names]


def typed(landed: DataFrame) -> DataFrame:
    """Every landed row with typed values and `reject_reason` (NULL when the row can load).

    A date that cannot be read does not reject the row: it stays, without a date. Other columns
    of the input (such as an ingest sequence) are kept.
    """
    return landed.select(*_typed_columns(landed), _reject_reason().alias("reject_reason"))


def loadable(landed: DataFrame) -> DataFrame:
    """Landed rows that can load, values still as landed."""
    return landed.filter(can_load())


def as_payments(rows: DataFrame) -> DataFrame:
    """Typed values of loadable rows. Call it late: after rows have been dropped by other steps."""
    return rows.select(*_typed_columns(rows))


def good_rows(landed: DataFrame) -> DataFrame:
    return as_payments(loadable(landed))


def rejected_rows(landed: DataFrame) -> DataFrame:
    """The quarantine: rows as landed, with the reason."""
    return landed.select("*", _reject_reason().alias("reject_reason")).filter(
        F.col("reject_reason").isNotNull()
    )


def load_counts() -> dict[str, Column]:
    """What a load counts of landed rows, as aggregates that can be observed while the rows are written."""
    loads = F.coalesce(can_load(), F.lit(False))
    return {"rows_seen": F.count("*"), "rows_upserted": F.count_if(loads), "rows_rejected": F.count_if(~loads)}


def load_stats(landed: DataFrame) -> DataFrame:
    """Rows seen, loadable and rejected for each program year that loads (NULL: not readable)."""
    return (
        typed(landed)
        .groupBy("program_year")
        .agg(
            F.count("*").alias("rows_seen"),
            F.count_if(F.col("reject_reason").isNull()).alias("rows_upserted"),
            F.count_if(F.col("reject_reason").isNotNull()).alias("rows_rejected"),
        )
    )


def quarter_mismatches(payments: DataFrame) -> DataFrame:
    """Quality check: rows whose carried quarter is not that of their payment date."""
    return payments.filter(~F.col("quarter").eqNullSafe(quarter_label(F.col("payment_date"))))
