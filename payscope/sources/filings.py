"""Read yearly disclosure files (wide CSV) and landed records (JSON lines)."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payscope import schemas as S
from payscope.sources.records import OPENS, quoted_records

BROKEN = "_broken_record"
SEQUENCE = "ingest_seq"


#: Paths that are tested one by one for each row; more are looked up by all folders above its file.
FEW_PATHS = 32


def _plain(path: str, encoded: bool = False) -> str:
    """The absolute path without scheme and host, whatever form it is given in; as it is, or URL-encoded."""
    spark = SparkSession.active()
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = made.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(made).toUri()
    return uri.getRawPath() if encoded else uri.getPath()


def _decoded(file: Column) -> Column:
    """A path as it was given: Spark states it URL-encoded (a space as %20, but a plus as it is)."""
    return F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))


def write_order(paths: Sequence[str] = ()) -> Column:
    """Where a row stands in its source: place of its path in `paths`, file, block, row.

    Unique for every row of a file source, and in the order in which rows are written over each
    other: later paths, later files by name, later rows win. A file belongs to the last of the paths
    that is the file or a folder above it; whole names count. A few paths are comparisons, the last
    one first. Many are one map, looked up by the folders above a file, so the plan does not grow with them.
    """
    file = F.col("_metadata.file_path")
    # scheme://host/a/b/c or scheme:/a/b/c: what follows the host.
    host = "^[A-Za-z0-9+.-]+:(//[^/]*)?/+"
    place = F.lit(-1)
    if 0 < len(paths) <= FEW_PATHS:
        plain = F.regexp_replace(file, host, "/")
        known = {_plain(path, encoded=True).rstrip("/"): n for n, path in enumerate(paths)}
        tests = [((plain == p) | plain.startswith(f"{p}/"), n) for p, n in sorted(known.items(), key=lambda i: -i[1])]
        place = F.coalesce(*[F.when(test, F.lit(n)) for test, n in tests], place)
    elif paths:
        places = {_plain(path): n for n, path in enumerate(paths)}
        # Each folder from the top.
        names = F.split(F.regexp_replace(_decoded(file), host, "/"), "/+")
        known = F.create_map(*[F.lit(x) for item in places.items() for x in item])
        above = F.transform(
            F.sequence(F.lit(1), F.size(names)), lambda n: F.array_join(F.slice(names, 1, n), "/")
        )
        place = F.coalesce(F.array_max(F.transform(above, lambda p: F.try_element_at(known, p))), F.lit(-1))
    return F.struct(
        place.alias("path"),
        file.alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def file_layouts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row per file of the paths (files or folders): its header, and whether a line break
    stands within quotes.

    One scan of all files as lines, however many there are. Up to the first line that ends within
    quotes all lines begin outside, so a file has such breaks if any of its lines would open one.
    """
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"),
        "value",
        F.col("value").rlike(OPENS).alias("opens"),
    )
    return lines.groupBy("file").agg(
        F.min_by("value", "place").alias("header"), F.max("opens").alias("has_breaks")
    )


def _wanted(names: Sequence[str]) -> list[Column]:
    """The columns of a filing; those that a layout lacks are NULL."""
    return [
        (F.col(f"`{c}`") if c in names else F.lit(None).cast("string")).alias(c) for c in S.FILING_COLUMNS
    ]


def _with_breaks(spark: SparkSession, names: Sequence[str], files: Sequence[str], order: Column) -> DataFrame:
    """Rows of files with line breaks within quotes: records first, then their cells."""
    fields = ", ".join("`" + n.replace("`", "``") + "` string" for n in [*names, BROKEN])
    options = {"escape": '"', "multiLine": "true", "columnNameOfCorruptRecord": BROKEN}
    found = quoted_records(spark, files, order)
    cells = F.when(~F.col("unclosed"), F.from_csv("record", fields, options))
    # A one-element explode: a record is parsed once, whatever is asked of its cells.
    rows = found.select("seq", "record", "unclosed", F.explode(F.array(cells)).alias("cells"))
    return rows.select("seq", "record", "unclosed", "cells.*").select(
        *_wanted(names),
        F.when(F.col("unclosed") | F.col(BROKEN).isNotNull(), F.col("record")).alias(BROKEN),
        F.col("seq").alias(SEQUENCE),
    )


def parsed_filings(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All rows of all files by column name; what is broken is in BROKEN."""
    layouts: dict[tuple[tuple[str, ...], bool], list[str]] = {}
    for file in file_layouts(spark, paths).collect():  # one row per file
        header = (file["header"] or "").lstrip("\ufeff").rstrip("\r")
        names = tuple(next(csv.reader([header]), []))
        layouts.setdefault((names, file["has_breaks"]), []).append(unquote(file["file"]))
    order = write_order(paths)
    parts = []
    for (names, has_breaks), files in layouts.items():
        if has_breaks:
            parts.append(_with_breaks(spark, names, files, order))
            continue
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, BROKEN]])
        # All cells are looked at, as a record is broken by their number.
        rows = spark.read.option("columnPruning", "false").csv(
            files, schema=schema, header=True, escape='"', encoding="UTF-8", columnNameOfCorruptRecord=BROKEN
        )
        # Spark does not read this column alone, so another one is named beside it.
        first = F.col(f"`{names[0]}`")
        broken = F.coalesce(F.col(BROKEN), F.when(first == "\0", first))
        parts.append(rows.select(*_wanted(names), broken.alias(BROKEN), order.alias(SEQUENCE)))
    if not parts:
        columns = [T.StructField(c, T.StringType()) for c in [*S.FILING_COLUMNS, BROKEN]]
        place = "path int, file string, block bigint, row bigint"
        return spark.createDataFrame([], T.StructType([*columns, T.StructField(SEQUENCE, T.StructType.fromDDL(place))]))
    return reduce(DataFrame.unionByName, parts)


def read_filings(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Filing rows of all given files and folders as text columns, with `ingest_seq`.

    Files are grouped by header, so a file with other columns, or in another order, is read by
    name, also within one folder. Line breaks within quotes are kept (`sources.records`); files with
    and without them are split into byte ranges. Records that do not fit their header are left out
    here; `broken_filings` has them.
    """
    return parsed_filings(spark, paths).filter(F.col(BROKEN).isNull()).drop(BROKEN)


def broken_filings(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Quarantine: the records that `read_filings` leaves out, (file, record)."""
    return parsed_filings(spark, paths).filter(F.col(BROKEN).isNotNull()).select(
        F.col(f"{SEQUENCE}.file").alias("file"), F.col(BROKEN).alias("record")
    )


def read_landed_json(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Landed records, one JSON object per line, plain or gzipped, with `ingest_seq`.

    Blank lines give no row. Year directories named `directory_year=2023` appear as the column
    `directory_year`. A gzipped file is one task: land it once as Parquet for repeated reads. Of
    several paths, the later ones count as written later.
    """
    paths = [path] if isinstance(path, str) else list(path)
    rows = spark.read.schema(S.LANDED).json(paths)
    return rows.select("*", write_order(paths).alias(SEQUENCE))


def write_landed(landed: DataFrame, path: str) -> None:
    """Land records as Parquet by program year; the years in `landed` are replaced whole.

    No shuffle: each task writes the years it holds, so one large year is written by many tasks.
    """
    (
        landed.withColumn("directory_year", F.col("program_year").try_cast("int"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("directory_year")
        .parquet(path)
    )


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifest files, one JSON document each."""
    return spark.read.schema(S.MANIFEST).json(path, multiLine=True)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The catalog of data sets: a JSON list of items with a title and a list of downloads."""
    schema = (
        "identifier string, title string, modified string, "
        "distribution array<struct<downloadURL string>>"
    )
    items = spark.read.schema(schema).json(path, multiLine=True)
    return items.select(
        "identifier",
        "title",
        F.try_element_at("distribution", F.lit(1))["downloadURL"].alias("download_url"),
        "modified",
        F.monotonically_increasing_id().alias("position"),
    )
