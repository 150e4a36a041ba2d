"""Last write wins on `record_id`: one current row per record, as an idempotent operation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from payscope.operators.typing import good_rows
from payscope.session import stored

KEY = "record_id"
SEQUENCE = "ingest_seq"


def latest(rows: DataFrame, key: str = KEY, sequence: str = SEQUENCE) -> DataFrame:
    """The row with the highest sequence for each key.

    Spark applies the `= 1` limit before the shuffle as well as after it, so a key that holds a
    large part of all rows reaches the shuffle as at most one row per input task.
    """
    newest_first = Window.partitionBy(key).orderBy(F.col(sequence).desc())
    return (
        rows.withColumn("_nth", F.row_number().over(newest_first)).filter("_nth = 1").drop("_nth")
    )


def latest_payments(landed: DataFrame, sequence: str = SEQUENCE) -> DataFrame:
    """Landed rows with a sequence to typed payments, one per record.

    Rows that cannot load do not take part. Rows are typed before they are sorted and shuffled: years,
    dates and amounts are smaller than their texts.
    """
    return latest(good_rows(landed), KEY, sequence)


def merge(target: DataFrame, source: DataFrame, key: str = KEY, sequence: str = SEQUENCE) -> DataFrame:
    """The target after `source` is written over it: all columns of a known key are replaced.

    The anti join is over all program years, because a correction may move a record to another
    year. `source` is reduced to one row per key and stored in the shared folder, so it is computed
    once; `target` has one row per key already. A small source is broadcast by its size, and then
    the target is not shuffled at all.
    """
    newest = stored(latest(source, key, sequence).drop(sequence), "merge")
    kept = target.join(newest.select(key), key, "left_anti")
    return kept.unionByName(newest)
