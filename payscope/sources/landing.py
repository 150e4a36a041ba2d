"""Land the filings of several years in one job, with a marker per year that is written last.

All years that are still to be done are read, matched and written together, and everything a manifest
says about them is observed by the same scan. Then each year gets its marker, a small file that names the
year's folder and appears whole. What no marker names is not there for readers, so a job that breaks off
changes nothing, a landing that is started again does the missing years only, and a year that is landed
anew replaces the old one in one step.

If a year's files are not there, or if the common job fails, the other years must not suffer: the job is
then done year by year, and a year that fails alone gets a marker that says so and is not complete.

One landing at a time may work on a folder. Readers need no care.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from decimal import ROUND_HALF_UP, Decimal

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payscope import schemas as S
from payscope.operators.gating import year_frame, years_to_do
from payscope.operators.manifest import is_other_payer
from payscope.operators.matching import land
from payscope.operators.typing import can_load, good_rows, load_counts
from payscope.sources.dictionary import ProductDictionary
from payscope.sources.filings import BROKEN, SEQUENCE, parsed_filings
from payscope.sources.keyed import KeyedTable
from payscope.sources.storage import file_at, put_text

YEAR = "directory_year"
PLACE = "run bigint, path int, file string, block bigint, row bigint"


def _title(year: int) -> str:
    return f"{year} General Payment Data"


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """The markers: one row per year that was tried."""
    fs, folder = file_at(spark, f"{root}/markers")
    if not fs.exists(folder):
        return spark.createDataFrame([], S.YEAR_LANDED)
    return spark.read.schema(S.YEAR_LANDED).json(f"{root}/markers", multiLine=True)


def _mark(spark: SparkSession, root: str, **marker) -> None:
    put_text(spark, f"{root}/markers", f"{marker['year']}.json", json.dumps(marker), replace=True)


def _missing(spark: SparkSession, paths: Sequence[str]) -> str | None:
    for path in paths:
        fs, made = file_at(spark, path)
        if not fs.exists(made):
            return f"nothing at {path}"
    return None if paths else "no paths"


def _by_year(name: str, years: Sequence[int], counted: Mapping[str, Column]) -> list[Column]:
    """Counts of each year, as aggregates over the whole: what can be observed has no groups."""
    return [
        F.count_if((F.col(name) == year) & F.coalesce(when, F.lit(False))).alias(f"{what}_{year}")
        for year in years
        for what, when in counted.items()
    ]


def _land(
    spark: SparkSession,
    sources: Mapping[int, Sequence[str]],
    datasets: Mapping[int, str],
    dictionary: ProductDictionary,
    root: str,
    run: int,
) -> None:
    """One job over all these years, then their markers."""
    years, folder = sorted(sources), f"run={run}-{uuid.uuid4().hex}"
    paths = [(year, path) for year in years for path in sources[year]]
    place = F.struct(F.lit(run).cast("long").alias("run"), f"{SEQUENCE}.*")
    rows = parsed_filings(spark, [path for _, path in paths]).withColumns(
        {YEAR: F.get(F.array(*[F.lit(year) for year, _ in paths]), F.col(f"{SEQUENCE}.path")), SEQUENCE: place}
    )
    scanned, kept = Observation(), Observation()
    is_broken = F.col(BROKEN).isNotNull()
    rows = rows.observe(scanned, *_by_year(YEAR, years, {"scanned": ~is_broken, "broken": is_broken}))
    names = F.create_map(*[F.lit(x) for year in years for x in (year, datasets.get(year, _title(year)))])
    landed = land(rows.filter(~is_broken), dictionary, names[F.col(YEAR)], keep=[SEQUENCE, YEAR])
    counted = {
        "matched": F.lit(True),
        "loadable": can_load(),
        "other": is_other_payer(dictionary.manufacturers_of_record),
    }
    landed = landed.observe(kept, *_by_year(YEAR, years, counted))
    landed.write.partitionBy(YEAR).parquet(f"{root}/data/{folder}")
    seen, found = scanned.get, kept.get
    for year in years:
        matched, loadable = found[f"matched_{year}"], found[f"loadable_{year}"]
        share = Decimal(repr(100.0 * found[f"other_{year}"] / matched)) if matched else Decimal(0)
        _mark(
            spark,
            root,
            year=year,
            complete=True,
            run=run,
            rows_scanned=seen[f"scanned_{year}"],
            rows_broken=seen[f"broken_{year}"],
            rows_matched=matched,
            rows_loadable=loadable,
            rows_rejected=matched - loadable,
            non_manufacturer_of_record_share_pct=float(share.quantize(Decimal("0.01"), ROUND_HALF_UP)),
            folder=f"{folder}/{YEAR}={year}" if matched else None,
        )


def land_years(
    spark: SparkSession,
    sources: Mapping[int, Sequence[str]],
    dictionary: ProductDictionary,
    root: str,
    datasets: Mapping[int, str] | None = None,
    force: bool = False,
) -> DataFrame:
    """Land the years of `sources` (year: files and folders of wide CSV, no patterns) that are not
    complete yet, or all of them when forced; returns the markers of all years.

    `datasets` names the data set of a year (its title by default). A year that was complete and whose
    forced landing fails keeps its rows; its marker then holds the error.
    """
    before = {m.year: m.asDict() for m in manifests(spark, root).collect()}  # one row per year
    run = 1 + max((m["run"] or 0 for m in before.values()), default=0)
    wanted = years_to_do(year_frame(spark, list(sources)), manifests(spark, root), force)
    todo = {row.year: sources[row.year] for row in wanted.collect()}
    failed = {year: error for year, paths in todo.items() if (error := _missing(spark, paths))}

    def attempt(years: Mapping[int, Sequence[str]]) -> None:
        try:
            _land(spark, years, datasets or {}, dictionary, root, run)
        except (Py4JJavaError, PySparkException) as error:
            if len(years) == 1:
                failed.update({year: str(error)[:1000] for year in years})
                return
            for year, paths in years.items():
                attempt({year: paths})

    ready = {year: paths for year, paths in todo.items() if year not in failed}
    if ready:
        attempt(ready)
    for year, error in failed.items():
        old = before.get(year, {})
        _mark(spark, root, **(old if old.get("complete") else {"year": year, "complete": False, "run": run}) | {"error": error})
    return manifests(spark, root)


def read_years(spark: SparkSession, root: str, years: Sequence[int] | None = None) -> DataFrame:
    """Landed records of all complete years, or of some of them, with `ingest_seq` and the year.

    Of rows of one record, those of a later landing are the later ones, then those of a later year.
    """
    done = [m for m in manifests(spark, root).filter("complete").collect() if m.folder]
    folders = [f"{root}/data/{m.folder}" for m in done if years is None or m.year in years]
    place = T.StructField(SEQUENCE, T.StructType.fromDDL(PLACE))
    schema = T.StructType([*S.LANDED.fields, place, T.StructField(YEAR, T.IntegerType())])
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/data").parquet(*folders).select(*schema.names)


def load_years(spark: SparkSession, root: str, table: KeyedTable) -> int:
    """Merge every complete year that the table does not have in this form yet, all in one merge.

    Returns the version of the table. What the rows were that did not load is counted with the merge.
    """
    applied = table.commit().applied
    done = {f"year {m.year}": m for m in manifests(spark, root).filter("complete").collect()}
    fresh = {name: m for name, m in done.items() if applied.get(name, -1) < m.run}
    if not fresh:
        return table.commit().version

    def prepare(rows: DataFrame) -> DataFrame:
        return good_rows(rows).select(*S.PAYMENT.names, SEQUENCE)

    rows = read_years(spark, root, [m.year for m in fresh.values()])
    batches = {name: m.run for name, m in fresh.items()}
    return table.merge_all(rows, batches, "landing", prepare, load_counts())
