"""What the training-data operators share: staged tables and work on batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from payscope.session import scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder: computed once, lineage cut."""
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, the whole text (null: empty) and the other columns asked for, nothing else."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *others)


SLICE = 1000  # rows that are turned into Python objects at once
SLICE_BYTES = 4 << 20  # and their size, unless it is one row


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most SLICE rows and SLICE_BYTES, so that long texts fit into a
    small worker."""

    def halves(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if part.num_rows < 2 or part.nbytes <= SLICE_BYTES:
            yield part
            return
        middle = part.num_rows // 2
        yield from halves(part.slice(0, middle))
        yield from halves(part.slice(middle))

    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield from halves(batch.slice(at, SLICE))


def portions(sizes: list[int], most: int) -> Iterator[range]:
    """Consecutive places whose sizes add up to at most `most`, or a single larger one."""
    first = held = 0
    for n, size in enumerate(sizes):
        if n > first and held + size > most:
            yield range(first, n)
            first, held = n, 0
        held += size
    if first < len(sizes):
        yield range(first, len(sizes))


def by_batch(
    df: DataFrame, work: Callable[[], Callable[[pa.RecordBatch], dict]], ddl: str
) -> DataFrame:
    """Apply to each batch of rows the function that `work()` makes once in each task.

    It returns lists by column name; `ddl` is the schema of the result.
    """
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = work()
        for batch in slices(batches):
            made = each(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    made[f.name].cast(f.type)
                    if isinstance(made[f.name], pa.Array)
                    else pa.array(made[f.name], type=f.type)
                    for f in arrow
                ],
                schema=arrow,
            )

    return df.mapInArrow(run, schema)


LAST_ID = (1 << 63) - 1  # where a null doc_id stands


def row_key() -> list[Column]:
    """What a decision about a document is joined back by: its id and its text."""
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("_doc"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"),
    ]


def repeated(docs: DataFrame, total: DataFrame) -> DataFrame:
    """The documents, same columns, as often as `total` says.

    It has one row (_doc, _text, _rows, _copies) per key: the rows that there are, the copies that
    shall be. Rows with equal id and text share them evenly. The documents travel as one struct each,
    so they may have columns of any name.
    """
    whole = docs.select(F.struct("*").alias("row"), *row_key())
    joined = whole.join(total.filter("_copies > 0"), ["_doc", "_text"])
    others = [F.col("row").getField(c) for c in docs.columns if c not in ("doc_id", "text")]
    place = F.row_number().over(Window.partitionBy("_doc", "_text").orderBy(F.xxhash64(F.lit(0), *others)))
    n = F.floor(F.col("_copies") * F.col("_place") / F.col("_rows")) - F.floor(
        F.col("_copies") * (F.col("_place") - 1) / F.col("_rows")
    )
    counted = joined.withColumn("_place", place).withColumn("_n", n.cast("int")).filter("_n > 0")
    return counted.select("row", F.explode(F.sequence(F.lit(1), "_n"))).select("row.*")


def ratio_up(n: int, size: int) -> int:
    """How many parts of at most `size` make up n; at least one."""
    return max(1, -(-n // size))
