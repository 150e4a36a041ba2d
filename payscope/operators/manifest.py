"""What a pull reports about each program year: counts by product and payer, and shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payscope import schemas as S
from payscope.functions.text import blank_to_null
from payscope.operators.matching import mentions_any
from payscope.sources.dictionary import ProductDictionary

UNKNOWN = "(unknown)"


def payer_name(column: str = "manufacturer") -> Column:
    return F.coalesce(blank_to_null(F.col(column)), F.lit(UNKNOWN))


def counts_by_manufacturer(landed: DataFrame) -> DataFrame:
    return landed.groupBy(
        F.col("program_year").try_cast("int").alias("year"), payer_name().alias("manufacturer")
    ).agg(F.count("*").alias("rows_matched"))


def match_counts(landed: DataFrame) -> DataFrame:
    """Both counts in long form from one scan: (year, kind, name, rows_matched).

    A manifest file holds them as two maps; as rows they need no group to fit into one record.
    """
    pairs = F.array(
        F.struct(F.lit("product").alias("kind"), F.col("product").alias("name")),
        F.struct(F.lit("manufacturer").alias("kind"), payer_name().alias("name")),
    )
    return (
        landed.select(
            F.col("program_year").try_cast("int").alias("year"), F.inline(pairs)
        )
        .groupBy("year", "kind", "name")
        .agg(F.count("*").alias("rows_matched"))
    )


def counts_from_manifests(manifests: DataFrame) -> DataFrame:
    """The maps of manifests that were read from files, in the long form of `match_counts`."""

    def exploded(kind: str) -> DataFrame:
        return manifests.select(
            "year",
            F.lit(kind).alias("kind"),
            F.explode(f"matched_by_{kind}").alias("name", "rows_matched"),
        )

    return exploded("product").unionByName(exploded("manufacturer"))


def is_other_payer(of_record: Sequence[str], column: str = "manufacturer") -> Column:
    """The payer is none of the manufacturers of record (whole name, whatever the case)."""
    return ~F.lower(payer_name(column)).isin([m.lower() for m in of_record])


def other_payer_share(landed: DataFrame, dictionary: ProductDictionary) -> DataFrame:
    """Percent of matched rows of each year paid by others than the manufacturers of record."""
    other = is_other_payer(dictionary.manufacturers_of_record)
    share = F.round(F.lit(100.0) * F.count_if(other) / F.count("*"), 2)
    return (
        landed.groupBy(F.col("program_year").try_cast("int").alias("year"))
        .agg(F.count("*").alias("rows_matched"), share.alias("other_share_pct"))
        .withColumn(
            "over_threshold", F.col("other_share_pct") > dictionary.other_share_threshold_pct
        )
    )


def top_other_payers(landed: DataFrame, dictionary: ProductDictionary, n: int = 10) -> DataFrame:
    """The payers to name for the years that are over the threshold, largest first."""
    over = other_payer_share(landed, dictionary).filter("over_threshold").select("year")
    counts = counts_by_manufacturer(
        landed.filter(is_other_payer(dictionary.manufacturers_of_record))
    )
    largest = Window.partitionBy("year").orderBy(F.col("rows_matched").desc(), "manufacturer")
    return (
        counts.withColumn("nth", F.row_number().over(largest))
        .filter(F.col("nth") <= n)
        .join(over, "year", "left_semi")
    )


def manifest_rows(
    filings: DataFrame, dictionary: ProductDictionary, failed: DataFrame | None = None
) -> DataFrame:
    """The scalar part of a manifest for each year, in one pass over the filings.

    `failed` (year, error) names the years whose pull broke off: what was scanned of them is
    counted, but they are not complete, and the gate keeps them out. A failed year without any row
    has a manifest, too.
    """
    is_match = mentions_any(dictionary)
    is_other = is_match & is_other_payer(dictionary.manufacturers_of_record, S.PAYER)
    share = F.try_divide(F.lit(100.0) * F.count_if(is_other), F.count_if(is_match))
    scanned = filings.groupBy(F.col(S.PROGRAM_YEAR).try_cast("int").alias("year")).agg(
        F.count("*").alias("rows_scanned"),
        F.count_if(is_match).alias("rows_matched"),
        F.coalesce(F.round(share, 2), F.lit(0.0)).alias("non_manufacturer_of_record_share_pct"),
    )
    if failed is None:
        return scanned.select("*", F.lit(True).alias("complete"), F.lit(None).cast("string").alias("error"))
    errors = failed.groupBy("year").agg(F.min("error").alias("error"), F.lit(True).alias("broke_off"))
    return scanned.join(errors, "year", "full_outer").select(
        "year",
        F.coalesce("rows_scanned", F.lit(0)).alias("rows_scanned"),
        F.coalesce("rows_matched", F.lit(0)).alias("rows_matched"),
        F.coalesce("non_manufacturer_of_record_share_pct", F.lit(0.0)).alias(
            "non_manufacturer_of_record_share_pct"
        ),
        F.col("broke_off").isNull().alias("complete"),
        "error",
    )
