"""Gates in front of a load: completeness, resume, catalog and stored-size checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payscope.functions.text import is_missing


def complete_years(manifests: DataFrame) -> DataFrame:
    """Years of complete manifests.

    The comparison of the year is true for all of them. Spark prunes partitions at run time only
    for a join side with a comparison in its filter; a boolean column alone does not count.
    """
    return manifests.filter(F.col("complete") & (F.col("year") > 0)).select("year").distinct()


def complete_only(
    rows: DataFrame,
    manifests: DataFrame,
    year_column: str = "directory_year",
    years: Sequence[int] | None = None,
) -> DataFrame:
    """Rows of the years whose manifest says the pull is complete.

    The semi join is on the year of the directory (the partition column of the landed data), so
    Spark prunes incomplete years before reading them. Years without a manifest do not qualify.
    """
    ready = complete_years(manifests)
    year = F.col(year_column).cast("string").try_cast("int")
    kept = rows if years is None else rows.filter(year.isin(list(years)))
    return kept.join(ready, year == ready["year"], "left_semi")


def year_frame(spark: SparkSession, years: Sequence[int]) -> DataFrame:
    return spark.createDataFrame([(int(y),) for y in years], "year int")


def years_to_do(requested: DataFrame, manifests: DataFrame, force: bool = False) -> DataFrame:
    """Requested years that have no complete manifest yet, or all of them when forced."""
    wanted = requested.select("year").distinct()
    if force:
        return wanted
    return wanted.join(complete_years(manifests), "year", "left_anti")


def catalog_gate(requested: DataFrame, catalog: DataFrame) -> DataFrame:
    """For each requested year the data set of its exact title, with a status.

    `missing`: no data set has the title. `no download url`: it has nothing to fetch.
    """
    title = F.concat(F.col("year").cast("string"), F.lit(" General Payment Data"))
    first = catalog.groupBy("title").agg(
        F.min_by(F.struct("identifier", "download_url", "modified"), "position").alias("item")
    )
    found = requested.select("year").distinct().withColumn("title", title).join(first, "title", "left")
    status = (
        F.when(F.col("item").isNull(), F.lit("missing"))
        .when(is_missing(F.col("item.download_url")), F.lit("no download url"))
        .otherwise(F.lit("ok"))
    )
    return found.select("year", "title", "item.*", status.alias("status"))


def reconcile_sizes(manifests: DataFrame, stored: DataFrame) -> DataFrame:
    """Bytes a manifest states against bytes stored under its key: PASS or WARN.

    Years whose manifest states no key or no size are not checked. A missing object is a WARN.
    `stored` has (key, stored_bytes), see `payscope.sources.storage.stored_sizes`.
    """
    stated = manifests.filter(~is_missing(F.col("s3_key")) & F.col("bytes").isNotNull())
    same = F.coalesce(F.col("stored_bytes") == F.col("bytes"), F.lit(False))
    return stated.join(stored, stated["s3_key"] == stored["key"], "left").select(
        "year",
        F.col("s3_key").alias("key"),
        F.col("bytes").alias("stated_bytes"),
        "stored_bytes",
        F.when(same, F.lit("PASS")).otherwise(F.lit("WARN")).alias("status"),
    )
