"""Continuous loading: new files are matched, typed and merged into the payments, batch by batch.

The payments are a keyed table (`payscope.sources.keyed`): a micro-batch reads and rewrites the buckets
of its own records, changes the quarterly sums by what it changed, and is published as a whole. The
batches of a stream are numbered by its checkpoint, and the table knows the last one of each stream, so a
batch that is repeated after a failure changes nothing, and streams with checkpoints of their own do not
meet, whatever their numbers. The current table is one scan; the quarterly totals are read as they are
kept.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from payscope import schemas as S
from payscope.operators.typing import good_rows, load_counts
from payscope.sources.keyed import KeyedTable

#: Sums that can be kept: those of each quarter, and the three views.
QUARTERS = {"quarters": ["quarter"]}
VIEWS = QUARTERS | {
    "q_totals": ["quarter", "product", "manufacturer"],
    "q_by_specialty": ["quarter", "physician_specialty"],
    "q_by_state": ["quarter", "physician_state"],
}


def payments_table(
    spark: SparkSession, table: str, views: Mapping[str, list[str]] = QUARTERS, n_buckets: int = 0
) -> KeyedTable:
    """The table at that place. `views` and `n_buckets` (0: shuffle partitions) are for one that begins."""
    return KeyedTable(spark, table, views, n_buckets=n_buckets)


def current(spark: SparkSession, table: str) -> DataFrame:
    """The payments table as of the last batch: one row per record."""
    rows = payments_table(spark, table).current()
    return spark.createDataFrame([], S.PAYMENT) if rows is None else rows


def kept_view(spark: SparkSession, table: str, name: str) -> DataFrame:
    """One of VIEWS as of the last batch, in the columns of the view of that name."""
    sums = payments_table(spark, table, VIEWS).view(name)
    if sums is None:
        empty = [*(T.StructField(d, T.StringType()) for d in VIEWS[name]), T.StructField("total", T.DecimalType(38, 2))]
        sums = spark.createDataFrame([], T.StructType([*empty, T.StructField("rows", T.LongType())]))
    return sums.select(
        *VIEWS[name], F.col("total").cast("double").alias("total_usd"), F.col("rows").alias("payment_count")
    )


def register_kept_views(spark: SparkSession, table: str) -> None:
    """The table and its kept views under their names, for `spark.sql`, as of the last batch."""
    current(spark, table).createOrReplaceTempView("payments")
    for name in VIEWS.keys() - QUARTERS.keys():
        kept_view(spark, table, name).createOrReplaceTempView(name)


def quarter_totals(spark: SparkSession, table: str) -> DataFrame:
    """Dollars and rows of each quarter, as of the last batch."""
    return kept_view(spark, table, "quarters")


def apply_batch(
    batch: DataFrame,
    batch_id: int,
    table: str,
    source: str,
    views: Mapping[str, list[str]] = QUARTERS,
    keep: int = 0,
) -> int:
    """Merge one batch of landed rows (with `ingest_seq`) into the table. Safe to repeat.

    `source` names whose numbers `batch_id` are; of one source they ascend. A row that is older than
    the stored one of its record does not replace it. With `keep` the files of the version that now has
    so many newer ones are deleted (`KeyedTable.retire`). Returns the version of the table.
    """
    def prepare(rows: DataFrame) -> DataFrame:
        return good_rows(rows).select(*S.PAYMENT.names, "ingest_seq")

    made = payments_table(batch.sparkSession, table, views)
    version = made.merge(batch, source, batch_id, prepare, load_counts())
    if keep:
        made.retire(version - keep)
    return version


def load_statistics(spark: SparkSession, table: str) -> DataFrame:
    """Rows seen, loadable and rejected of each source, counted while its batches were loaded."""
    names = ["rows_seen", "rows_upserted", "rows_rejected"]
    counted = payments_table(spark, table).commit().counts
    rows = [(source, *[counts.get(n, 0) for n in names]) for source, counts in counted.items()]
    return spark.createDataFrame(rows, "source string, " + ", ".join(f"{n} bigint" for n in names))


def start_ingest(
    stream: DataFrame,
    table: str,
    checkpoint: str,
    to_landed: Callable[[DataFrame], DataFrame] | None = None,
    views: Mapping[str, list[str]] = QUARTERS,
    keep: int = 0,
) -> StreamingQuery:
    """Load everything that is there now, in batches, and stop. Started again, it continues.

    `to_landed` turns a batch of source rows into landed rows with `ingest_seq` (for filings: the
    product match). `stream` decides the batch size, e.g. by `maxFilesPerTrigger`. `views` are the sums
    that a table that begins will keep. Every batch may leave a copy of the table behind: `keep` is how many
    versions keep their files (0: all), enough for readers and other writers that are at work meanwhile.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        # The checkpoint holds the stream's id, which stays the same over restarts.
        source = json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        apply_batch(to_landed(batch) if to_landed else batch, batch_id, table, source, views, keep)

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def compact(spark: SparkSession, table: str, target: str, n_buckets: int) -> None:
    """Write the current table once as a new table, with buckets for its size now.

    Streams go on with the new table, from their checkpoints or with new ones.
    """
    payments_table(spark, table).copy_to(target, n_buckets)
