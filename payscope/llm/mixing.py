"""Mixing sources to target weights by systematic sampling.

A document's size is its number of words. Sources get targets by weight, at most `most` times their
own size, and what a source cannot take goes to the others by weight. Each document expects
target / source size copies. These are prefix-summed within the source, a random offset is added,
and a document is emitted once for each integer boundary that its share of the sum crosses.

The order within a source is by size class, then by salt, then by size and doc_id: documents of
similar size lie together, so that the words taken follow the target closely. Prefix sums go over
cells (source, size class, salt) of bounded share: cell totals first, then the rows of each cell, so
a source that holds a third of all rows is never one group. Expected copies are whole multiples of
2^-24, so sums are exact and no document exceeds `most` copies.

The offset and the salt are digests, so reruns agree. Null texts have size 0; their copies count
no words. A null source is a source of its own, last in order. Repeated rows are sampled each. An empty table gives an
empty result. Columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payscope.llm.common import repeated, row_key, staged

UNIT = 1 << 24
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D."""
    spaced = F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ")
    return F.coalesce(F.size(F.filter(spaced, lambda w: w != "")), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and row key of every document."""
    size = F.when(F.col("text").isNull(), F.lit(0)).otherwise(word_count(F.col("text"))).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), *row_key())


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """source, source_size and target of each source, from (source, source_size).

    Sources that reach their cap do so in order of cap by weight; the others share what is left. The
    table has one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(w) for w in weights])
    place = F.row_number().over(by_name) - 1
    weighed = sources.withColumn("weight", F.get(listed, (place % len(weights)).cast("int")).cast("double"))
    weighed = weighed.withColumn("cap", (F.col("source_size") * most).cast("double"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    passed = F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    left = F.sum("source_size").over(every) - spent
    # What a unit of weight gets if all sources before this one are at their caps.
    level = left / (F.sum("weight").over(every) - passed)
    # It rises up to the first source that stays below its cap and falls after it.
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    target = F.coalesce(F.least("cap", F.col("shared") * F.col("weight")), F.col("cap"))
    return (
        weighed.withColumn("level", level)
        .withColumn("shared", F.max(F.when(fits, F.col("level"))).over(every))
        .select("source", "source_size", target.alias("target"))
    )


def _salt(doc_id: Column) -> Column:
    return F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 2)


def sample(documents: DataFrame, shares: DataFrame) -> DataFrame:
    """The columns of `documents` with source_size, target and copies.

    `documents` has doc_id, source, size and others; `shares` has source, source_size and target.
    """
    binary = F.bin("size")
    celled = documents.select(
        "*",
        F.length(binary).alias("bits"),
        F.substring(binary, 1, 4).alias("lead"),
        _salt(F.col("doc_id")).alias("salt"),
    )
    cell = ["source", "bits", "lead", "salt"]
    counts = celled.groupBy(*cell).agg(F.count("*").alias("n"))
    share = F.col("target") / F.col("source_size")
    expected = F.when(F.col("source_size") > 0, F.floor(share * UNIT + 0.5)).otherwise(F.lit(UNIT)).cast("long")
    offset = F.conv(F.substring(F.md5(F.coalesce("source", F.lit(""))), 1, 6), 16, 10).cast("long")
    shares = shares.select(
        F.col("source").alias("of"), "source_size", "target", expected.alias("expected"), offset.alias("offset")
    )
    ahead = Window.partitionBy("source").orderBy("bits", "lead", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.join(shares, F.col("source").eqNullSafe(F.col("of"))).select(
        *[F.col(c).alias(f"c_{c}") for c in cell],
        "source_size",
        "target",
        "expected",
        (F.coalesce(F.sum("n").over(ahead), F.lit(0)) * F.col("expected") + F.col("offset")).alias("start"),
    )
    at_cell = F.col("source").eqNullSafe(F.col("c_source"))
    for c in cell[1:]:
        at_cell = at_cell & (F.col(c) == F.col(f"c_{c}"))
    within = Window.partitionBy("source", "bits", "lead", "salt").orderBy("size", F.col("doc_id").asc_nulls_last())
    upto = F.col("start") + F.sum("expected").over(within.rowsBetween(Window.unboundedPreceding, 0))
    bits = UNIT.bit_length() - 1
    crossed = F.shiftright("upto", bits) - F.shiftright(F.col("upto") - F.col("expected"), bits)
    return (
        celled.join(starts, at_cell)
        .withColumn("upto", upto)
        .select(*documents.columns, "source_size", "target", crossed.cast("long").alias("copies"))
    )


def copies(docs: DataFrame) -> DataFrame:
    """Every document with its size, its source's size and target, and how often it is emitted."""
    documents = staged(sized(docs), "sizes")
    sources = documents.groupBy("source").agg(F.sum("size").alias("source_size"))
    return sample(documents, targets(sources))


def mix(docs: DataFrame) -> DataFrame:
    """The columns of query op5: how many words of each document the mix takes."""
    return copies(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of documents, all columns, each as often as it is emitted."""
    total = copies(docs).groupBy("_doc", "_text").agg(F.count("*").alias("_rows"), F.sum("copies").alias("_copies"))
    return repeated(docs, total)
