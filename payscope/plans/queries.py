"""Every operator as a named query over the given tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payscope import schemas as S
from payscope.functions import calendar as C
from payscope.functions import numbers as N
from payscope.functions.text import blank_to_null, evidence_id, series_evidence_id
from payscope.operators import (
    canary,
    causal,
    claims,
    forecast,
    gating,
    manifest,
    matching,
    rollups,
    scoring,
    screening,
    series,
    typing,
    upsert,
)
from payscope.plans import testbed as tb
from payscope.session import scratch_dir, shuffles_dropped, stored
from payscope.sources import filings as filing_files
from payscope.sources import landing
from payscope.sources import traces as trace_files
from payscope.sources.dictionary import load_dictionary
from payscope.sources.storage import CODEC, stored_sizes
from payscope.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# --- matching and typing ------------------------------------------------------------------------


@_query
def filings_match(spark, d):
    found = matching.slot_matches(tb.filings(spark, d), tb.PRODUCTS)
    return found.withColumn("slot", F.col("slot").cast("long"))


@_query
def filings_match_table(spark, d):
    """The dictionary is a table: all names and types of parts, in the order of the alphabet."""
    parts = tb.table(spark, d, "part")
    words = parts.select(F.col("p_name").alias("term")).union(parts.select("p_type")).filter("length(term) > 0")
    terms = words.select(F.lower("term").alias("term")).distinct().select("term", F.col("term").alias("place"))
    found = matching.slot_matches_by_terms(tb.filings(spark, d), terms)
    return found.withColumn("slot", F.col("slot").cast("long"))


@_query
def filings_canonical(spark, d):
    return tb.landed(spark, d).withColumn(
        "matched_slot_count", F.col("matched_slot_count").cast("long")
    )


@_query
def filings_dates(spark, d):
    raw = F.col(S.PAYMENT_DATE)
    ordinal = C.quarter_ordinal(F.col("quarter"))
    return (
        tb.filings(spark, d)
        .select(
            F.col(S.RECORD_ID).alias("record_id"),
            C.parse_date(raw).alias("payment_date"),
            C.quarter_of(raw).alias("quarter"),
        )
        .select(
            "*",
            ordinal.cast("long").alias("quarter_ordinal"),
            C.ordinal_quarter(ordinal + 1).alias("next_quarter"),
        )
    )


@_query
def coerce_good(spark, d):
    rows = tb.payments(spark, d).select(*S.PAYMENT.names)
    return rows.withColumn("amount_usd", F.col("amount_usd").cast("double"))


@_query
def coerce_rejects(spark, d):
    return typing.rejected_rows(tb.landed(spark, d)).select(
        "record_id", "amount_usd", "manufacturer", "reject_reason"
    )


@_query
def load_statistics(spark, d):
    return typing.load_stats(tb.landed(spark, d))


# --- files --------------------------------------------------------------------------------------


@_query
def csv_filings(spark, d):
    """Filings written as wide CSV files by program year, read back by header, matched."""
    path = scratch_dir(spark, "csv")
    tb.filings(spark, d).write.csv(path, header=True)
    rows = filing_files.read_filings(spark, [path])
    return matching.land(rows, tb.PRODUCTS, tb.dataset_name()).select(
        "record_id",
        "program_year",
        "quarter",
        blank_to_null(F.col("manufacturer")).alias("manufacturer"),
        "product",
        "amount_usd",
    )


@_query
def csv_mixed(spark, d):
    """One folder of files with several layouts: columns in another order or missing, and line
    breaks within quotes."""
    path = scratch_dir(spark, "csv-mixed")
    rows = tb.filings(spark, d)
    year = F.col(S.PROGRAM_YEAR).cast("int") % 3
    broken_line = F.concat(F.col(S.NATURE), F.lit('\n"second", line'))
    layouts = (
        rows.filter(year == 0),
        rows.filter(year == 1).select(*reversed(rows.columns)),
        rows.filter(year == 2).withColumn(S.NATURE, broken_line).drop(S.RECIPIENT_NPI),
    )
    for layout in layouts:
        layout.write.mode("append").csv(path, header=True, escape='"')
    found = matching.land(filing_files.read_filings(spark, [path]), tb.PRODUCTS, tb.dataset_name())
    return found.select(
        "record_id",
        "program_year",
        "quarter",
        "physician_id",
        "product",
        "amount_usd",
        "nature_of_payment",
    )


@_query
def csv_quarantine(spark, d):
    """Records with too few cells, written among good ones, are kept apart; both are counted."""
    path = scratch_dir(spark, "csv-broken")
    rows = tb.filings(spark, d)
    key = F.substring_index(S.RECORD_ID, "-", 1).cast("long")
    # A header of three names: records with fewer or more cells do not fit it.
    named = rows.select(
        S.RECORD_ID, S.PROGRAM_YEAR, F.when(key % 7 == 0, F.lit("a")).otherwise("b").alias(S.NATURE)
    )
    lines = F.when(F.col(S.NATURE) == "a", F.concat_ws(",", S.RECORD_ID, S.PROGRAM_YEAR)).otherwise(
        F.concat_ws(",", S.RECORD_ID, S.PROGRAM_YEAR, S.NATURE)
    )
    header = ",".join(named.columns)
    text = stored(named.select(S.RECORD_ID, lines.alias("value")), "lines")  # counted and written
    # Files of about a thousand records, with the header in front.
    n_files = text.count() // 1000 + 1
    body = text.groupBy(F.pmod(F.xxhash64(S.RECORD_ID), F.lit(n_files)).alias("file")).agg(
        F.concat(F.lit(header + "\n"), F.array_join(F.sort_array(F.collect_list("value")), "\n")).alias("value")
    )
    body.write.partitionBy("file").text(path)
    # Both kinds come from one pass over the files.
    every = filing_files.parsed_filings(spark, [path])
    is_broken = F.col(filing_files.BROKEN).isNotNull()
    year = F.when(is_broken, F.element_at(F.split(filing_files.BROKEN, ","), 2)).otherwise(F.col(S.PROGRAM_YEAR))
    return every.groupBy(year.alias("year")).agg(
        *[F.nullif(F.count_if(c), F.lit(0)).alias(n) for n, c in (("n_good", ~is_broken), ("n_broken", is_broken))]
    )


@_query
def upsert_stamped(spark, d):
    """Two landings of records, the second with corrections: the later written row stays."""
    base = scratch_dir(spark, "landing")
    paths = [f"{base}/2023 b", f"{base}/2023"]  # the second name begins the first one
    rows = stored(tb.landed(spark, d), "landed")  # written twice
    key = F.substring_index("record_id", "-", 1).cast("long")
    rows.write.json(paths[0])
    fixed = rows.filter(key % 4 == 0).withColumn("amount_usd", F.lit("7.50")).withColumn("physician_state", F.lit("ZZ"))
    fixed.write.json(paths[1])
    landed = filing_files.read_landed_json(spark, paths)
    return _payment_columns(upsert.latest_payments(landed))


@_query
def landed_json(spark, d):
    """Landed records written as gzipped JSON lines, read back and typed."""
    path = scratch_dir(spark, "json")
    tb.landed(spark, d).write.json(path, compression="gzip")
    rows = typing.good_rows(filing_files.read_landed_json(spark, path)).select(*S.PAYMENT.names)
    return rows.withColumn("amount_usd", F.col("amount_usd").cast("double"))


def _landed_years(spark: SparkSession, d: str) -> str:
    """Filings as CSV folders by year, landed in two runs: in the first one a third of the years is
    not there yet."""
    base = scratch_dir(spark, "years")
    rows = tb.filings(spark, d).withColumn("of", F.col(S.PROGRAM_YEAR))
    rows.write.partitionBy("of").csv(f"{base}/csv", header=True, escape='"')
    years = [r.year for r in tb.manifests(spark, d).select("year").collect()]  # one row per year
    names = {y: f"set-{y}" for y in years}
    for late in ("later", "csv"):
        paths = {y: [f"{base}/{'csv' if y % 3 else late}/of={y}"] for y in years}
        landing.land_years(spark, paths, tb.PRODUCTS, f"{base}/landed", names)
    return f"{base}/landed"


@_query
def land_years(spark, d):
    """What the markers say after both runs; all counts were observed while the rows were written."""
    return landing.manifests(spark, _landed_years(spark, d)).drop("folder", "error")


@_query
def load_landed_years(spark, d):
    """The landed years, merged into the payments in one merge."""
    root = _landed_years(spark, d)
    table = ingest.payments_table(spark, f"{root}/table")
    landing.load_years(spark, root, table)
    return _payment_columns(table.current())


@_query
def landing_gate(spark, d):
    """Landed records stored by program year; only years with a complete manifest are read."""
    path = scratch_dir(spark, "landing")
    filing_files.write_landed(tb.landed(spark, d), path)
    kept = gating.complete_only(spark.read.parquet(path), tb.manifests(spark, d))
    return kept.select("record_id", "program_year", "product")


# --- gates, manifests, upsert -------------------------------------------------------------------


@_query
def completeness_gate(spark, d):
    landed = tb.landed(spark, d).withColumn("directory_year", F.col("program_year"))
    kept = gating.complete_only(landed, tb.manifests(spark, d))
    return kept.select("record_id", "program_year", "product")


@_query
def resume_years(spark, d):
    return gating.years_to_do(tb.requested_years(spark, d), tb.manifests(spark, d))


@_query
def upsert_latest(spark, d):
    return _payment_columns(upsert.latest_payments(tb.line_payments(spark, d)))


@_query
def upsert_merge(spark, d):
    rows = tb.line_payments(spark, d)
    is_correction = F.year("ingest_seq.d") >= 1999
    target = upsert.latest_payments(rows.filter(~is_correction)).drop("ingest_seq")
    source = typing.good_rows(rows.filter(is_correction))
    return _payment_columns(upsert.merge(target, source))


def _payment_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "record_id",
        "program_year",
        "payment_date",
        "quarter",
        "physician_specialty",
        "physician_state",
        "manufacturer",
        "product",
        F.col("amount_usd").cast("double").alias("amount_usd"),
    )


@_query
def manifest_counts(spark, d):
    return manifest.match_counts(tb.landed(spark, d))


@_query
def manifest_rows(spark, d):
    return manifest.manifest_rows(tb.filings(spark, d), tb.PRODUCTS).drop("error")


@_query
def manifest_failures(spark, d):
    """Manifests when the pulls of some years broke off, one of them before its first row."""
    years = tb.requested_years(spark, d).filter(F.col("year") % 3 == 0)
    failed = years.select(F.col("year").cast("int").alias("year"), F.lit("source went away").alias("error"))
    made = manifest.manifest_rows(tb.filings(spark, d), tb.PRODUCTS, failed)
    return made.select("year", "rows_scanned", "rows_matched", "complete", "error")


@_query
def manifest_files(spark, d):
    """Manifests as files, one JSON document each, read back for the gate."""
    path = scratch_dir(spark, "manifests")
    made = manifest.manifest_rows(tb.filings(spark, d), tb.PRODUCTS).withColumn("of", F.col("year"))
    made.repartition("of").write.partitionBy("of").json(path)
    return filing_files.read_manifests(spark, path).select("year", "rows_scanned", "rows_matched", "complete")


@_query
def catalog_file(spark, d):
    """The catalog as one JSON list, read back for the gate."""
    path = scratch_dir(spark, "catalog")
    download = F.when(F.col("download_url").isNotNull(), F.array(F.struct(F.col("download_url").alias("downloadURL"))))
    item = F.to_json(F.struct("title", "identifier", "modified", download.alias("distribution")))
    # A few data sets per year: one document.
    listed = F.sort_array(F.collect_list(F.struct("position", "title", item.alias("item"))))["item"]
    document = tb.catalog(spark, d).agg(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("value"))
    document.coalesce(1).write.text(path)
    return gating.catalog_gate(tb.requested_years(spark, d), filing_files.read_catalog(spark, path))


@_query
def size_files(spark, d):
    """Sizes of stored files, taken from the file system."""
    path = scratch_dir(spark, "sizes")
    years = tb.manifests(spark, d).select("year", F.expr("repeat('x', CAST(bytes AS INT))").alias("value"))
    years.repartition("year").write.partitionBy("year").text(path)
    sizes = stored_sizes(spark, path, key_depth=2).filter(F.col("key").startswith("year="))
    year = F.regexp_extract("key", r"year=(\d+)/", 1).cast("int").alias("year")
    return sizes.groupBy(year).agg(F.sum("stored_bytes").alias("stored_bytes"))


@_query
def dictionary_file(spark, d):
    """The product dictionary as a file, read back and matched."""
    path = scratch_dir(spark, "dictionary")
    p = tb.PRODUCTS
    document = json.dumps(
        {
            "generic_names": list(p.generic_names),
            "brand_names": list(p.brand_names),
            "brand_to_generic": dict(p.brand_to_generic),
            "manufacturers_of_record": list(p.manufacturers_of_record),
        }
    )
    spark.createDataFrame([(document,)], "value string").coalesce(1).write.text(path)
    words = load_dictionary(spark, path)
    return matching.land(tb.filings(spark, d), words, tb.dataset_name()).select("record_id", "product", "product_generic")


@_query
def non_record_share(spark, d):
    return manifest.other_payer_share(tb.landed(spark, d), tb.PRODUCTS)


@_query
def top_other_payers(spark, d):
    top = manifest.top_other_payers(tb.landed(spark, d), tb.PRODUCTS, 3)
    return top.withColumn("nth", F.col("nth").cast("long"))


@_query
def catalog_gate(spark, d):
    return gating.catalog_gate(tb.requested_years(spark, d), tb.catalog(spark, d))


@_query
def size_check(spark, d):
    return gating.reconcile_sizes(tb.manifests(spark, d), tb.stored_objects(spark, d))


# --- views, facts, user queries -----------------------------------------------------------------


@_query
def q_totals(spark, d):
    return rollups.quarterly_totals(tb.payments(spark, d))


@_query
def q_by_specialty(spark, d):
    return rollups.quarterly_by_specialty(tb.payments(spark, d))


@_query
def q_by_state(spark, d):
    return rollups.quarterly_by_state(tb.payments(spark, d))


@_query
def fact_total(spark, d):
    return rollups.total_dollars(tb.payments(spark, d), 1995, 1999)


@_query
def fact_total_all(spark, d):
    return rollups.total_dollars(tb.payments(spark, d))


@_query
def fact_one_quarter(spark, d):
    return rollups.total_dollars(tb.payments(spark, d).filter(F.col("quarter") == "1997Q1"))


@_query
def fact_top_specialty(spark, d):
    return rollups.top_group(tb.payments(spark, d), "physician_specialty")


@_query
def fact_top_state(spark, d):
    return rollups.top_group(tb.payments(spark, d), "physician_state")


@_query
def fact_quarters(spark, d):
    return rollups.dollars_per_quarter(tb.payments(spark, d))


@_query
def fact_first_quarters(spark, d):
    return rollups.dollars_per_quarter(tb.payments(spark, d), 4)


@_query
def fact_share(spark, d):
    return rollups.share_of(
        tb.payments(spark, d), F.col("nature_of_payment") == "1-URGENT", "urgent_share_pct"
    )


@_query
def fact_share_empty(spark, d):
    return rollups.share_of(
        tb.payments(spark, d), F.col("nature_of_payment") == "no such nature", "none_share_pct"
    )


@_query
def generic_compare(spark, d):
    return rollups.compare_groups(
        tb.payments(spark, d), "product_generic", ["red ring", "hot gizmo"]
    )


@_query
def other_maker_share(spark, d):
    others = rollups.not_like_any("manufacturer", ["SUPPLIER#00000000", "#00000001"])
    return rollups.share_of(tb.payments(spark, d), others, "pct")


@_query
def year_count(spark, d):
    return rollups.year_count(tb.payments(spark, d), 1998)


def _register_views(spark: SparkSession, d: str) -> None:
    """Views over payments that are typed and stored once, as user queries find them."""
    rollups.register_views(stored(tb.payments(spark, d), "payments"))


USER_CTE = """
WITH per_product AS (
    SELECT product_generic, program_year, SUM(amount_usd) AS usd,
           SUM(amount_usd) FILTER (WHERE nature_of_payment = '1-URGENT') AS urgent,
           COUNT(*) AS n, MIN(payment_date) AS first_day
    FROM payments WHERE quarter IS NOT NULL AND lower(manufacturer) LIKE 'supplier%'
    GROUP BY product_generic, program_year
)
SELECT p.product_generic, p.program_year, CAST(p.n AS BIGINT) AS n,
       ROUND(100.0 * CAST(p.urgent AS DOUBLE) / NULLIF(CAST(p.usd AS DOUBLE), 0), 2) AS urgent_pct,
       CAST(COALESCE(SUM(q.total_usd), 0) AS DOUBLE) AS state_usd,
       CAST(EXTRACT(MONTH FROM p.first_day) AS BIGINT) AS first_month
FROM per_product p
JOIN q_by_state q ON CAST(p.program_year AS STRING) = substring(q.quarter, 1, 4)
                 AND q.physician_state IS NOT NULL
GROUP BY p.product_generic, p.program_year, p.n, p.urgent, p.usd, p.first_day
"""


@_query
def user_select_cte(spark, d):
    _register_views(spark, d)
    return spark.sql(USER_CTE).withColumn("state_usd", F.round("state_usd", 2))


@_query
def user_functions(spark, d):
    _register_views(spark, d)
    return spark.sql(
        "SELECT CAST(date_trunc('year', payment_date) AS DATE) AS first_day, upper(nature_of_payment) AS nature, "
        "round(avg(CAST(amount_usd AS DOUBLE)), 2) AS avg_usd, CAST(max(amount_usd) AS DOUBLE) AS max_usd, "
        "CAST(abs(min(amount_usd) - max(amount_usd)) AS DOUBLE) AS span_usd "
        "FROM payments WHERE payment_date IS NOT NULL GROUP BY 1, 2"
    )


@_query
def user_union(spark, d):
    _register_views(spark, d)
    return spark.sql(
        "SELECT physician_state AS name, payment_count FROM q_by_state WHERE quarter = '1997Q1' "
        "UNION ALL SELECT physician_specialty, payment_count FROM q_by_specialty "
        "WHERE quarter = '1997Q1' UNION SELECT quarter, payment_count FROM q_by_state"
    )


@_query
def capped_select(spark, d):
    _register_views(spark, d)
    rows = spark.sql(
        "SELECT record_id, CAST(amount_usd AS DOUBLE) AS amount_usd FROM payments "
        "ORDER BY amount_usd DESC, record_id"
    )
    return rollups.capped(rows, screening.ROW_CAP)


@_query
def querylog_screen(spark, d):
    screened = screening.screen(tb.query_log(spark, d))
    return screened.select("conv_id", "turn", "accepted", "reason", "normalized")


@_query
def evidence_ids(spark, d):
    return tb.query_log(spark, d).select(
        "conv_id", "turn", evidence_id(F.col("sql")).alias("evidence_id")
    )


@_query
def series_ids(spark, d):
    keys = series.all_series(tb.order_payments(spark, d)).select("series_key").distinct()
    return keys.select("series_key", series_evidence_id(F.col("series_key")).alias("evidence_id"))


# --- series and forecasts -----------------------------------------------------------------------


@_query
def series_national(spark, d):
    return series.national_series(tb.order_payments(spark, d))


@_query
def series_top_specialty(spark, d):
    return series.specialty_series(tb.order_payments(spark, d), 3)


@_query
def series_grouping_sets(spark, d):
    return series.all_series(tb.order_payments(spark, d), 3)


def _fine(spark, d):
    return series.all_series(tb.fine_payments(spark, d), None)


@_query
def series_windows(spark, d):
    return series.windows_summary(_fine(spark, d), tb.TRAIN_END)


@_query
def seasonal_change(spark, d):
    return forecast.seasonal_changes(_fine(spark, d)).select(
        "series_key", "quarter", F.round("change", 2).alias("change")
    )


@_query
def naive_forecast(spark, d):
    out = forecast.labelled(forecast.seasonal_naive(_fine(spark, d), 6))
    return out.select("series_key", F.col("h").cast("long").alias("h"), "quarter", "point")


@_query
def naive_interval(spark, d):
    out = forecast.labelled(forecast.seasonal_naive(_fine(spark, d)))
    return out.select(
        "series_key",
        "quarter",
        F.round("lower_80", 3).alias("lower_80"),
        F.round("upper_80", 3).alias("upper_80"),
    )


_NAIVE_ONLY = {forecast.NAIVE: None}


@_query
def naive_holdout(spark, d):
    tested = forecast.holdout(_fine(spark, d), tb.TRAIN_END, models=_NAIVE_ONLY)
    return forecast.holdout_scores(tested).select(
        "series_key",
        "model",
        "n_train",
        "n_test",
        F.round("mae", 4).alias("mae"),
        "coverage_80",
    )


@_query
def series_skips(spark, d):
    return forecast.skipped(_fine(spark, d), tb.TRAIN_END)


@_query
def hw_forecast(spark, d):
    """Holt-Winters on held-out quarters, over series that follow its model exactly."""
    models = {forecast.ETS: forecast.ets_model}
    tested = forecast.holdout(tb.exact_series(spark, d), tb.TRAIN_END, models=models)
    return tested.select(
        "series_key",
        "quarter",
        F.col("n_train").cast("long").alias("n_train"),
        "actual",
        *[F.round(c, 1).alias(c) for c in ("point", "lower_80", "upper_80")],
    )


@_query
def model_choice(spark, d):
    """Which model each exact series gets, and its forecasts after the last quarter."""
    run = forecast.run_models(tb.exact_series(spark, d), tb.TRAIN_END)
    return forecast.run_forecasts(run).select(
        "series_key",
        "model",
        "n_history",
        F.col("h").cast("long").alias("h"),
        "quarter",
        F.round("point", 1).alias("point"),
    )


@_query
def forecast_run(spark, d):
    """A whole run of both models over all real series, stored as tables: window, training quarters,
    held-out actuals, the naive error, whether the chosen model is as good as any, steps and skips."""
    path = scratch_dir(spark, "forecast")
    forecast.store_run(_fine(spark, d), path, tb.TRAIN_END)
    windows = spark.read.parquet(f"{path}/windows")
    final = spark.read.parquet(f"{path}/forecasts").groupBy("series_key").agg(
        F.count("*").alias("steps"), F.countDistinct("model").alias("models")
    )
    tested = spark.read.parquet(f"{path}/runs").select("series_key", F.inline("tested"))
    held_out = tested.groupBy("series_key").agg(
        F.sum(F.when(F.col("model") == forecast.NAIVE, F.col("actual"))).alias("actuals"),
        F.sum(F.when(F.col("model") == forecast.ETS, F.col("actual"))).alias("ets_actuals"),
    )
    scores = spark.read.parquet(f"{path}/holdout").groupBy("series_key").agg(
        F.round(F.min(F.when(F.col("model") == forecast.NAIVE, F.col("mae"))), 4).alias("naive_mae"),
        F.min("mae").alias("least"),
    )
    chosen = spark.read.parquet(f"{path}/primary").select("series_key", "mae")
    skips = spark.read.parquet(f"{path}/skipped")
    return (
        windows.join(final, "series_key", "left")
        .join(scores, "series_key", "left")
        .join(chosen, "series_key", "left")
        .join(held_out, "series_key", "left")
        .join(skips, "series_key", "left")
        .select(
            "series_key",
            "n_quarters",
            "first_quarter",
            "last_quarter",
            F.when(F.col("reason").isNull(), F.col("n_train")).alias("n_train"),
            "models",
            "steps",
            "naive_mae",
            (F.col("mae") == F.col("least")).alias("chose_least"),
            F.round("actuals", 2).alias("actuals"),
            F.round("ets_actuals", 2).alias("ets_actuals"),
            "reason",
        )
    )


@_query
def own_model(spark, d):
    """A model of the user's own, run on every series: the mean of the last season."""

    def season_mean(history, horizon, season):
        if len(history) < season:
            raise ValueError(f"needs {season} values")
        mean = sum(history[-season:]) / season
        return [mean] * horizon, [mean] * horizon, [mean] * horizon

    fitted = forecast.fit_each(_fine(spark, d), {"season_mean": season_mean}, 2)
    return fitted.select(
        "series_key",
        "model",
        F.col("h").cast("long").alias("h"),
        F.round("point", 4).alias("point"),
        "error",
    )


@_query
def forecast_lookup(spark, d):
    path = scratch_dir(spark, "forecast")
    forecast.store_run(_fine(spark, d), path, tb.TRAIN_END, models={forecast.NAIVE: forecast.naive_model})
    run = {t: spark.read.parquet(f"{path}/{t}") for t in ("forecasts", "skipped", "windows", "holdout")}
    customer = tb.table(spark, d, "customer").select(
        F.col("c_custkey").alias("request_id"),
        F.col("c_nationkey").cast("string").alias("k"),
        "c_mktsegment",
    )
    key = F.col("request_id") % 10
    kinds = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    priority = F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("request_id") % 5).cast("int"))
    requests = customer.select(
        "request_id",
        F.when(key == 0, "national")
        .when(key == 1, "")
        .when(key == 2, "specialty:none")
        .otherwise(F.concat(F.lit("specialty:"), F.concat_ws(" ", "k", "c_mktsegment", priority)))
        .alias("series_key"),
        (F.col("request_id") % 6 + 1).alias("horizon"),
    )
    found = forecast.lookup(requests, run["forecasts"], run["skipped"], run["windows"], run["holdout"])
    return found.select(
        "request_id",
        "status",
        "model",
        F.col("h").cast("long").alias("h"),
        "quarter",
        "point",
        "first_quarter",
        "last_quarter",
        "n_train",
        F.round("mae", 4).alias("mae"),
    )


# --- difference-in-differences ------------------------------------------------------------------


def _groups(spark, d):
    return causal.group_series(tb.line_groups(spark, d), ["treated maker"])


@_query
def did_series(spark, d):
    return causal.trend_table(_groups(spark, d))


@_query
def did_event(spark, d):
    return causal.with_event(_groups(spark, d)).select("event_quarter").distinct()


@_query
def did_estimate(spark, d):
    return causal.estimate(_groups(spark, d))


@_query
def did_insufficient(spark, d):
    return causal.estimate(_groups(spark, d), "1990Q1")


# --- claims -------------------------------------------------------------------------------------


@_query
def claims_numbers(spark, d):
    """Numbers with positions in all given documents and answers, whole texts."""
    documents = tb.table(spark, d, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("answer_id"),
        F.col("text").alias("answer_text"),
    )
    spans = claims.number_spans(documents.unionByName(tb.answers(spark, d)))
    return (
        spans.filter("kind = 'number'")
        .select("answer_id", "raw", "start", "end")
        .withColumn("value", N.stated_value(F.col("raw")))
        .withColumn("start", F.col("start").cast("long"))
        .withColumn("end", F.col("end").cast("long"))
    )


@_query
def claims_markers(spark, d):
    spans = claims.number_spans(tb.answers(spark, d)).filter("kind = 'marker'")
    return spans.select(
        "answer_id", "raw", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")
    )


def _attribution(mode: str) -> Query:
    def run(spark, d):
        cited = claims.cited_numbers(tb.answers(spark, d), mode)
        return cited.select("answer_id", "raw", "value", "cited_id")

    return run


QUERIES["claims_attribution"] = _attribution(claims.AS_WRITTEN)
QUERIES["claims_attribution_once"] = _attribution(claims.CLAIM_ONCE)
QUERIES["claims_attribution_strict"] = _attribution(claims.STRICT)


@_query
def claims_leaves(spark, d):
    leaves = tb.evidence(spark, d).select(
        "answer_id",
        "evidence_id",
        F.col("position").cast("long").alias("position"),
        F.explode(N.numeric_leaves(F.col("payload"))).alias("leaf"),
    )
    return leaves


def _verdicts(spark, d, mode=claims.AS_WRITTEN):
    return claims.verdicts(tb.answers(spark, d), tb.evidence(spark, d), mode=mode)


@_query
def claims_verdicts(spark, d):
    return _verdicts(spark, d).select("answer_id", "raw", "cited_id", "passed", "reason")


@_query
def claims_strict(spark, d):
    return _verdicts(spark, d, claims.STRICT).select(
        "answer_id", "raw", "cited_id", "passed", "reason"
    )


@_query
def claims_answers(spark, d):
    per_answer = claims.answer_verdicts(tb.answers(spark, d), _verdicts(spark, d))
    return per_answer.withColumn("unverified", F.array_join("unverified", " | "))


@_query
def claims_derivations(spark, d):
    checked = claims.verdicts(
        tb.derived_answers(spark, d), tb.evidence(spark, d), tb.derivations(spark, d)
    )
    return checked.select("answer_id", "raw", "cited_id", "passed", "reason")


# --- scoring ------------------------------------------------------------------------------------


@_query
def eval_abstain(spark, d):
    return tb.traces(spark, d).select(
        "case_id", scoring.is_abstention(F.col("answer_text")).alias("abstained")
    )


@_query
def eval_numbers(spark, d):
    return tb.traces(spark, d).select(
        "case_id", F.posexplode(scoring.scored_numbers(F.col("answer_text"))).alias("nth", "value")
    ).withColumn("nth", F.col("nth").cast("long"))


def _scores(spark, d):
    return scoring.score(tb.cases(spark, d), tb.traces(spark, d))


@_query
def eval_scores(spark, d):
    return _scores(spark, d)


@_query
def case_files(spark, d):
    """Cases stored as JSON files and read back for the scores."""
    path = scratch_dir(spark, "cases")
    cases = tb.cases(spark, d)
    listed = F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct(*cases.columns))), ","), F.lit("]"))
    # One file per thousand cases or so, each a JSON list.
    n_files = cases.count() // 1000 + 1
    files = cases.groupBy(F.pmod(F.xxhash64("id"), F.lit(n_files)).alias("file")).agg(listed.alias("value"))
    files.write.partitionBy("file").text(path)
    return scoring.score(trace_files.read_cases(spark, path).drop("file"), tb.traces(spark, d)).select(
        "id", "passed", "latency_ms", "calls"
    )


@_query
def eval_summary(spark, d):
    return scoring.summary(_scores(spark, d)).drop("total_cost_usd")


@_query
def eval_cost(spark, d):
    cost = scoring.summary(_scores(spark, d), 0.06, 0.24)
    return cost.select("total", F.round("total_cost_usd", 6).alias("total_cost_usd"))


@_query
def trace_calls(spark, d):
    return scoring.call_rollup(tb.traces(spark, d))


@_query
def trace_read(spark, d):
    """Traces written as JSON lines, read back, and scored from the files."""
    path = scratch_dir(spark, "traces")
    trace_files.write_traces(tb.traces(spark, d), path)
    stored = trace_files.read_traces(spark, path)
    return scoring.score(tb.cases(spark, d), stored).select("id", "passed", "latency_ms", "calls")


# --- canary -------------------------------------------------------------------------------------


@_query
def canary_numbers(spark, d):
    return tb.canary_rows(spark, d).select(
        "id", F.posexplode(canary.stated_numbers(F.col("answer"))).alias("nth", "value")
    ).withColumn("nth", F.col("nth").cast("long"))


@_query
def canary_gold(spark, d):
    """The numbers of every row of the state view are gold."""
    gold = rollups.quarterly_by_state(tb.payments(spark, d))
    row_id = F.concat_ws(" ", F.coalesce("quarter", F.lit("?")), "physician_state")
    keyed = gold.select(row_id.alias("id"), "quarter", "total_usd", "payment_count")
    return canary.gold_numbers(keyed, "id").select(
        "id", F.posexplode("gold_numbers").alias("nth", "value")
    ).withColumn("nth", F.col("nth").cast("long"))


@_query
def canary_questions(spark, d):
    """Eight questions end to end: gold from the payments, recorded answers (two of them wrong), scores."""
    rows = stored(tb.payments(spark, d), "payments")
    urgent = F.col("nature_of_payment") == "1-URGENT"
    facts = {
        "years": rollups.total_dollars(rows, 1995, 1999),
        "all": rollups.total_dollars(rows),
        "quarter": rollups.total_dollars(rows.filter(F.col("quarter") == "1997Q1")),
        "specialty": rollups.top_group(rows, "physician_specialty"),
        "state": rollups.top_group(rows, "physician_state"),
        "share": rollups.share_of(rows, urgent, "pct"),
        "count": rollups.year_count(rows, 1998),
        "generics": rollups.compare_groups(rows, "product_generic", ["red ring", "hot gizmo"]),
    }
    gold = None
    for name, fact in facts.items():
        numbers = canary.gold_numbers(fact.withColumn("id", F.lit(name)), "id")
        gold = numbers if gold is None else gold.unionByName(numbers)
    # At most two rows per question.
    gold = gold.groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("gold_numbers"))).alias("gold_numbers"))
    stated = F.get("gold_numbers", F.lit(0)) * F.when(F.col("id").isin("all", "state"), 2).otherwise(1)
    answers = gold.select(
        "id",
        "gold_numbers",
        F.concat(F.lit("It comes to "), F.format_number(stated, 2), F.lit(" [q].")).alias("answer"),
        F.lit(True).alias("accepted"),
        F.array().cast("array<string>").alias("unverified"),
        F.lit(None).cast("string").alias("sql"),
        F.array().cast("array<string>").alias("expected_columns"),
        F.lit(None).cast("string").alias("error"),
    )
    return canary.score_rows(answers).select(
        "id",
        F.size("gold_numbers").cast("long").alias("n_gold"),
        F.round(F.get("gold_numbers", F.lit(0)), 2).alias("gold"),
        "correct",
        "status",
    )


def _canary(spark, d):
    return canary.score_rows(tb.canary_rows(spark, d))


@_query
def canary_scores(spark, d):
    return _canary(spark, d).select(
        "run_id", "id", "abstained", "cited", "correct", "retrieval_ok", "status"
    )


@_query
def canary_rollup(spark, d):
    return canary.rollup(_canary(spark, d), "run_id", recorded=1.0)


@_query
def canary_report(spark, d):
    return canary.report_lines(_canary(spark, d))


@_query
def canary_latency(spark, d):
    """Percentiles over all given events, one run per event type, values as latencies."""
    events = tb.table(spark, d, "events").select("event_type", "value")
    return canary.latency_percentiles(events, "event_type", "value")


@_query
def canary_record(spark, d):
    """The record of each run, with latencies and duration."""
    return canary.run_record(_canary(spark, d), "run_id", recorded=1.0)


@_query
def canary_details(spark, d):
    """The rows of each run, stored beside its record and read back."""
    path = scratch_dir(spark, "details")
    canary.append_ledger(canary.run_details(_canary(spark, d), "run_id"), path)
    kept = spark.read.parquet(path)
    return kept.withColumn("error", F.col("error").isNotNull()).withColumnRenamed("error", "failed")


@_query
def case_cover(spark, d):
    k = F.substring("id", 3, 20).cast("long")
    cases = tb.cases(spark, d).select("id").filter(k % 13 != 1)
    return canary.id_cover(tb.canary_rows(spark, d).select("id").filter(k % 17 != 2), cases)


@_query
def ledger_latest(spark, d):
    """Records appended by two runs, then the newest of each system."""
    path = scratch_dir(spark, "ledger")
    records = canary.rollup(_canary(spark, d), "run_id", recorded=1.0)
    for ts, keep in (("2026-01-01", F.lit(True)), ("2026-02-01", F.col("run_id") % 2 == 0)):
        canary.append_ledger(records.filter(keep).withColumn("ts", F.lit(ts)), path)
    return canary.latest_record(spark.read.parquet(path), ["run_id"])


# --- streaming ----------------------------------------------------------------------------------

#: Lines in a file of a landing folder, at most on average: the files grow in number, not in size.
LANDING_FILE_ROWS = 500_000


def _landing_stream(
    spark: SparkSession, d: str, dealt: Callable[[int], DataFrame], path: str, n_files: int
) -> DataFrame:
    """The rows made of all lines, dealt over that many files, read as a stream of `n_files` / 2 batches.

    More lines make `n_files` times as many files, and batches of as many more, so neither a file nor
    the number of batches, each of which may rewrite the whole table, grows with them.
    """
    times = -(-tb.table(spark, d, "lineitem").count() // (n_files * LANDING_FILE_ROWS)) or 1
    rows = dealt(n_files * times)
    with shuffles_dropped(spark):
        rows.write.parquet(path, compression=CODEC)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2 * times).parquet(path)


def _ingested(spark: SparkSession, d: str, views=ingest.QUARTERS) -> str:
    """All lines as files of a landing folder, loaded from there as a stream in several batches.

    The rows of a record are spread over the files, so batches correct each other, and some rows
    arrive after newer ones of their record.
    """
    base = scratch_dir(spark, "stream")
    stream = _landing_stream(spark, d, lambda n: tb.line_payments(spark, d, n), f"{base}/landing", 6)
    run = ingest.start_ingest(stream, f"{base}/table", f"{base}/checkpoint", views=views, keep=1)
    run.awaitTermination()
    return f"{base}/table"


@_query
def stream_upsert(spark, d):
    return _payment_columns(ingest.current(spark, _ingested(spark, d)))


@_query
def stream_quarter_totals(spark, d):
    return ingest.quarter_totals(spark, _ingested(spark, d))


@_query
def kept_specialty_view(spark, d):
    """A kept view, changed batch by batch, equals the view over the current table."""
    return ingest.kept_view(spark, _ingested(spark, d, ingest.VIEWS), "q_by_specialty")


def _ingested_filings(spark: SparkSession, d: str) -> str:
    """Filings as files of a landing folder; the product match runs inside the stream."""
    base = scratch_dir(spark, "stream-filings")
    rows = tb.filings(spark, d).withColumn("ingest_seq", F.col(S.RECORD_ID))
    stream = _landing_stream(spark, d, lambda n: rows.repartition(n, S.RECORD_ID), f"{base}/landing", 4)

    def to_landed(batch: DataFrame) -> DataFrame:
        found = matching.land(batch, tb.PRODUCTS, tb.dataset_name())
        return found.withColumn("ingest_seq", F.col("record_id"))

    ingest.start_ingest(stream, f"{base}/table", f"{base}/checkpoint", to_landed, keep=1).awaitTermination()
    return f"{base}/table"


@_query
def stream_filings(spark, d):
    return _payment_columns(ingest.current(spark, _ingested_filings(spark, d)))


@_query
def stream_load_statistics(spark, d):
    """Rows seen, loaded and rejected, counted while the stream loaded them."""
    names = ("rows_seen", "rows_upserted", "rows_rejected")
    counted = ingest.load_statistics(spark, _ingested_filings(spark, d))
    return counted.select(*names)
