"""Forecast every quarterly series, score models on held-out quarters, choose and refit.

The seasonal-naive model alone is windows and joins. Holt-Winters has no built-in form, so it runs
in a pandas function, over all series of one length in a batch together, where a series is one row of a
few values per year. `run_models` does a whole run that way, in one pass. The rows are dealt over tasks
by number, as a model takes long for few bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payscope.functions.calendar import ordinal_quarter, quarter_ordinal
from payscope.functions.smoothing import holt_winters, holt_winters_many
from payscope.session import stored

# The 80 % two-sided normal quantile, the season and the default holdout.
Z_80 = 1.2816
SEASON = 4
HORIZON = 4
TRAIN_END = "2024Q4"
NAIVE = "seasonal_naive"
ETS = "ets"

# (history values in order, horizon, season) -> (point, lower, upper); ValueError: cannot fit.
SeriesModel = Callable[[list, int, int], tuple]


def _with_ordinal(series: DataFrame) -> DataFrame:
    return series.select("series_key", "value", quarter_ordinal(F.col("quarter")).alias("q"))


def _interval(point: Column, spread: Column) -> list[Column]:
    return [
        point.alias("point"),
        (point - F.lit(Z_80) * spread).alias("lower_80"),
        (point + F.lit(Z_80) * spread).alias("upper_80"),
    ]


def seasonal_changes(series: DataFrame, season: int = SEASON) -> DataFrame:
    """Each value less the value one season earlier, in rows of the sorted series."""
    by_time = Window.partitionBy("series_key").orderBy("quarter")
    return series.select(
        "series_key",
        "quarter",
        "value",
        (F.col("value") - F.lag("value", season).over(by_time)).alias("change"),
    )


def seasonal_naive(history: DataFrame, horizon: int = HORIZON, season: int = SEASON) -> DataFrame:
    """The last season repeated, for series with at least one season of values.

    The season is counted in rows, so a missing quarter shifts it. The spread is that of the
    differences to the value one season earlier, 0 for fewer than two of them. One shuffle.
    """
    by_time = Window.partitionBy("series_key").orderBy("q")
    from_end = Window.partitionBy("series_key").orderBy(F.col("q").desc())
    marked = _with_ordinal(history).select(
        "series_key",
        "q",
        "value",
        (F.col("value") - F.lag("value", season).over(by_time)).alias("change"),
        F.row_number().over(from_end).alias("back"),
    )
    fitted = marked.groupBy("series_key").agg(
        F.count("*").alias("n_history"),
        F.max("q").alias("last_q"),
        F.coalesce(F.stddev_samp("change"), F.lit(0.0)).alias("spread"),
        F.array(
            *[
                F.max(F.when(F.col("back") == season - i, F.col("value")))
                for i in range(season)
            ]
        ).alias("last_season"),
    )
    steps = fitted.filter(F.col("n_history") >= season).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")
    )
    point = F.get("last_season", F.pmod(F.col("h") - 1, F.lit(season)))
    return steps.select(
        "series_key",
        F.lit(NAIVE).alias("model"),
        "n_history",
        "last_q",
        "h",
        *_interval(point, F.col("spread")),
    )


def ets_model(history: list, horizon: int, season: int) -> tuple:
    point, spread = holt_winters(history, horizon, season)
    return point, point - Z_80 * spread, point + Z_80 * spread


def _ets_many(histories: list[list], horizon: int, season: int) -> list[tuple]:
    points, spreads = holt_winters_many(np.array(histories), horizon, season)
    return [(p, p - Z_80 * s, p + Z_80 * s) for p, s in zip(points, spreads, strict=True)]


#: A model may have a form for many histories of one length at once.
ets_model.many = _ets_many


def _fit_all(model: SeriesModel, histories: list[list], horizon: int, season: int) -> list:
    """The model on every history, in their order; the error itself where it cannot fit."""
    made: list = [None] * len(histories)
    by_length: dict[int, list[int]] = {}
    for n, history in enumerate(histories):
        by_length.setdefault(len(history), []).append(n)
    many = getattr(model, "many", None)
    for places in by_length.values():
        try:
            if many:
                together = many([histories[n] for n in places], horizon, season)
                for n, result in zip(places, together, strict=True):
                    made[n] = result
                continue
        except ValueError as problem:
            for n in places:
                made[n] = problem
            continue
        for n in places:
            try:
                made[n] = model(histories[n], horizon, season)
            except ValueError as problem:
                made[n] = problem
    return made


def _dealt(series: DataFrame) -> DataFrame:
    """Rows of one series each, dealt evenly over many tasks: models cost time, their rows few bytes.

    A given number of partitions is left alone by adaptive execution, which goes by bytes.
    """
    spark = series.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return series.repartition(tasks, "series_key")


def _compact(series: DataFrame) -> DataFrame:
    """One row per series: its points (q, value), in no order. A series is a few values per year."""
    points = F.collect_list(F.struct(quarter_ordinal(F.col("quarter")).alias("q"), "value"))
    return series.groupBy("series_key").agg(points.alias("points"))


def _in_order(points) -> tuple[list[int], list]:
    ordered = sorted((p["q"], p["value"]) for p in points)
    return [p[0] for p in ordered], [p[1] for p in ordered]


_MODEL_ROWS = (
    "series_key string, model string, n_history long, last_q int, h int, "
    "point double, lower_80 double, upper_80 double, error string"
)


def fit_each(
    history: DataFrame,
    models: Mapping[str, SeriesModel],
    horizon: int = HORIZON,
    season: int = SEASON,
) -> DataFrame:
    """Run own models on every series. A model that cannot fit gives one row with its error."""
    models = dict(models)
    columns = [field.split()[0] for field in _MODEL_ROWS.split(", ")]

    def run(batches):
        for batch in batches:
            ordered = [_in_order(points) for points in batch["points"]]
            rows = []
            for name, model in models.items():
                fitted = _fit_all(model, [values for _, values in ordered], horizon, season)
                for key, (q, values), made in zip(batch["series_key"], ordered, fitted, strict=True):
                    base = {"series_key": key, "model": name, "n_history": len(values), "last_q": q[-1]}
                    if isinstance(made, ValueError):
                        rows.append({**base, "error": str(made)})
                        continue
                    point, lower, upper = made
                    rows += [
                        {
                            **base,
                            "h": i + 1,
                            "point": float(point[i]),
                            "lower_80": float(lower[i]),
                            "upper_80": float(upper[i]),
                        }
                        for i in range(horizon)
                    ]
            yield pd.DataFrame({c: pd.Series([row.get(c) for row in rows], dtype=object) for c in columns})

    return _dealt(_compact(history)).mapInPandas(run, _MODEL_ROWS)


def labelled(forecasts: DataFrame, after: Column | None = None) -> DataFrame:
    """Adds the calendar quarter of each step, counted from the last quarter of the history."""
    start = F.col("last_q") if after is None else after
    return forecasts.withColumn("quarter", ordinal_quarter(start + F.col("h")))


def skipped(
    series: DataFrame,
    train_end: str = TRAIN_END,
    horizon: int = HORIZON,
    season: int = SEASON,
    models: tuple[str, ...] = (NAIVE, ETS),
) -> DataFrame:
    """Series that cannot be scored, with the reason. No value is made up for them."""
    q = F.col("q")
    end = quarter_ordinal(F.lit(train_end))
    wanted = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: end + h)
    facts = _with_ordinal(series).groupBy("series_key").agg(
        F.count("*").alias("n"),
        F.count_if(q <= end).alias("n_train"),
        F.collect_set(F.when((q > end) & (q <= end + horizon), q)).alias("tested"),
    )
    missing = F.transform(F.array_except(wanted, F.col("tested")), ordinal_quarter)
    reason = (
        F.when(
            F.col("n") < 2 * season,
            F.concat(
                F.lit("only "),
                F.col("n").cast("string"),
                F.lit(f" quarters of data, need at least {2 * season}"),
            ),
        )
        .when(F.col("n_train") == 0, F.lit(f"no training data at or before {train_end}"))
        .when(
            F.size(missing) > 0,
            F.concat(F.lit("missing actuals for "), F.array_join(missing, ", ")),
        )
    )
    if NAIVE in models:
        reason = reason.when(
            F.col("n_train") < season, F.lit(f"{NAIVE} needs at least {season} observations")
        )
    if ETS in models:
        reason = reason.when(
            F.col("n_train") < 2 * season, F.lit(f"{ETS} needs at least {2 * season} observations")
        )
    return facts.select("series_key", reason.alias("reason")).filter(F.col("reason").isNotNull())


def _forecast(history: DataFrame, models, horizon: int, season: int) -> DataFrame:
    """All given models on the history: the naive one by windows, others series by series."""
    own = {n: m for n, m in models.items() if m is not None}
    parts = []
    if any(m is None for m in models.values()):
        parts.append(seasonal_naive(history, horizon, season))
    if own:
        fitted = fit_each(history, own, horizon, season)
        parts.append(fitted.filter(F.col("error").isNull()).drop("error"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


# The model table; None stands for the model that is built from windows.
MODELS: dict[str, SeriesModel | None] = {NAIVE: None, ETS: ets_model}


def holdout(
    series: DataFrame,
    train_end: str = TRAIN_END,
    horizon: int = HORIZON,
    season: int = SEASON,
    models: Mapping[str, SeriesModel | None] | None = None,
) -> DataFrame:
    """Forecast each held-out quarter from the quarters up to `train_end`, next to its actual.

    Only series with all actuals have rows. Test quarters are calendar quarters after `train_end`.
    """
    models = MODELS if models is None else dict(models)
    usable = series.join(
        skipped(series, train_end, horizon, season, tuple(models)), "series_key", "left_anti"
    )
    end = quarter_ordinal(F.lit(train_end))
    train = usable.filter(quarter_ordinal(F.col("quarter")) <= end)
    forecasts = labelled(_forecast(train, models, horizon, season), end)
    actuals = usable.select("series_key", "quarter", F.col("value").alias("actual"))
    return forecasts.join(actuals, ["series_key", "quarter"]).select(
        "series_key",
        "model",
        F.col("n_history").alias("n_train"),
        "quarter",
        "actual",
        "point",
        "lower_80",
        "upper_80",
    )


def mean_absolute_error(actual: str = "actual", point: str = "point") -> Column:
    return F.avg(F.abs(F.col(actual) - F.col(point)))


def coverage(actual: str = "actual", lower: str = "lower_80", upper: str = "upper_80") -> Column:
    return F.avg(F.col(actual).between(F.col(lower), F.col(upper)).cast("double"))


def holdout_scores(tested: DataFrame) -> DataFrame:
    return tested.groupBy("series_key", "model").agg(
        F.max("n_train").alias("n_train"),
        F.count("*").alias("n_test"),
        mean_absolute_error().alias("mae"),
        coverage().alias("coverage_80"),
    )


def primary_models(scores: DataFrame, order: tuple[str, ...] = (NAIVE, ETS)) -> DataFrame:
    """The model with the lowest error for each series; the earlier in `order` wins ties."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    return scores.groupBy("series_key").agg(
        F.min_by("model", F.struct("mae", place.alias("place"))).alias("primary_model"),
        F.min("mae").alias("mae"),
    )


def final_forecasts(
    series: DataFrame,
    primary: DataFrame,
    horizon: int = HORIZON,
    season: int = SEASON,
    models: Mapping[str, SeriesModel | None] | None = None,
) -> DataFrame:
    """Refit each series' primary model on all of its quarters. Other models are not run on it."""
    models = MODELS if models is None else dict(models)
    chosen = series.join(primary.select("series_key", "primary_model"), "series_key")
    parts = []
    for name, model in models.items():
        mine = chosen.filter(F.col("primary_model") == name)
        parts.append(labelled(_forecast(mine, {name: model}, horizon, season)))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.select(
        "series_key", "model", "n_history", "h", "quarter", "point", "lower_80", "upper_80"
    )


def naive_model(history: list, horizon: int, season: int) -> tuple:
    """The last season repeated; the spread is that of the differences to one season earlier."""
    values = np.asarray(history, dtype="float64")
    if len(values) < season:
        raise ValueError(f"{NAIVE} needs at least {season} observations")
    changes = values[season:] - values[:-season]
    spread = float(np.std(changes, ddof=1)) if len(changes) > 1 else 0.0
    point = values[-season:][np.arange(horizon) % season]
    return point, point - Z_80 * spread, point + Z_80 * spread


_STEP = "h int, q int, point double, lower_80 double, upper_80 double"
_RUN = f"""series_key string, reason string, n_quarters long, first_q int, last_q int, n_train long,
    tested array<struct<model string, actual double, {_STEP}>>,
    scores array<struct<model string, n_train long, n_test long, mae double, coverage_80 double>>,
    primary_model string, mae double,
    forecasts array<struct<model string, n_history long, {_STEP}>>"""


def run_models(
    series: DataFrame,
    train_end: str = TRAIN_END,
    horizon: int = HORIZON,
    season: int = SEASON,
    models: Mapping[str, SeriesModel] | None = None,
) -> DataFrame:
    """Skip, test, score, choose and refit in one pass: one row per series.

    The series is read once and shuffled once; a series is a few values per year, so one group is
    small. The reasons for skipping, the scores and the choice are those of `skipped`,
    `holdout_scores` and `primary_models`; a model that is not chosen is not refitted.
    """
    chosen = dict(IN_ONE_PASS if models is None else models)
    columns = T.StructType.fromDDL(_RUN).names
    year, quarter = train_end.split("Q")
    end = int(year) * 4 + int(quarter) - 1

    def steps(made: tuple, start: int) -> list[dict]:
        point, lower, upper = made
        return [
            {
                "h": h + 1,
                "q": start + h + 1,
                "point": float(point[h]),
                "lower_80": float(lower[h]),
                "upper_80": float(upper[h]),
            }
            for h in range(horizon)
        ]

    def of_batch(ordered: list[tuple[list[int], list]]) -> list[dict]:
        """What the models make of some series, each (quarters, values)."""
        trains = [[v for at, v in zip(q, value, strict=True) if at <= end] for q, value in ordered]
        results = [{"tested": [], "scores": [], "primary_model": None, "mae": None, "forecasts": []} for _ in ordered]
        for name, model in chosen.items():
            fitted = _fit_all(model, trains, horizon, season)
            for (q, value), train, made, result in zip(ordered, trains, fitted, results, strict=True):
                if isinstance(made, ValueError):
                    continue
                by_quarter = dict(zip(q, value, strict=True))
                pairs = [{"model": name, "actual": by_quarter[s["q"]], **s} for s in steps(made, end)]
                mae = float(np.mean([abs(p["actual"] - p["point"]) for p in pairs]))
                inside = [p["lower_80"] <= p["actual"] <= p["upper_80"] for p in pairs]
                result["tested"] += pairs
                result["scores"].append(
                    {
                        "model": name,
                        "n_train": len(train),
                        "n_test": len(pairs),
                        "mae": mae,
                        "coverage_80": float(np.mean(inside)),
                    }
                )
                if result["mae"] is None or mae < result["mae"]:
                    result["primary_model"], result["mae"] = name, mae
        for name, model in chosen.items():
            mine = [n for n, r in enumerate(results) if r["primary_model"] == name]
            for n, made in zip(mine, _fit_all(model, [ordered[n][1] for n in mine], horizon, season), strict=True):
                if isinstance(made, ValueError):
                    raise made
                q, value = ordered[n]
                results[n]["forecasts"] = [
                    {"model": name, "n_history": len(value), **s} for s in steps(made, q[-1])
                ]
        return results

    def run(batches):
        for batch in batches:
            ordered = [_in_order(points) for points in batch["points"]]
            rows = [
                {
                    "series_key": key,
                    "reason": reason,
                    "n_quarters": len(q),
                    "first_q": q[0],
                    "last_q": q[-1],
                    "n_train": sum(x <= end for x in q),
                }
                for key, reason, (q, _) in zip(batch["series_key"], batch["reason"], ordered, strict=True)
            ]
            usable = [n for n, row in enumerate(rows) if row["reason"] is None]
            for n, result in zip(usable, of_batch([ordered[n] for n in usable]), strict=True):
                rows[n] |= result
            yield pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in columns})

    compact = stored(_compact(series), "series")
    opened = compact.select("series_key", F.inline("points")).select(
        "series_key", ordinal_quarter(F.col("q")).alias("quarter"), "value"
    )
    reasons = skipped(opened, train_end, horizon, season, tuple(chosen))
    return _dealt(compact.join(reasons, "series_key", "left")).mapInPandas(run, _RUN)


#: Models for one pass over short series, in the order that decides ties.
IN_ONE_PASS: dict[str, SeriesModel] = {NAIVE: naive_model, ETS: ets_model}


def run_holdout(run: DataFrame) -> DataFrame:
    """Each held-out quarter of a run next to its forecast, as `holdout` gives it."""
    return run.select("series_key", "n_train", F.inline("tested")).select(
        "series_key",
        "model",
        "n_train",
        ordinal_quarter(F.col("q")).alias("quarter"),
        "actual",
        "point",
        "lower_80",
        "upper_80",
    )


def run_forecasts(run: DataFrame) -> DataFrame:
    """The final forecasts of a run, as `final_forecasts` gives them."""
    return run.select("series_key", F.inline("forecasts")).select(
        "series_key",
        "model",
        "n_history",
        "h",
        ordinal_quarter(F.col("q")).alias("quarter"),
        "point",
        "lower_80",
        "upper_80",
    )


def store_run(
    series: DataFrame,
    path: str,
    train_end: str = TRAIN_END,
    horizon: int = HORIZON,
    season: int = SEASON,
    models: Mapping[str, SeriesModel] | None = None,
) -> None:
    """Score, choose, refit and store: tables runs, forecasts, holdout, primary, windows, skipped.

    Each series is in either forecasts or skipped. The run is computed once and stored; the other
    tables are parts of it.
    """
    spark = series.sparkSession
    run_models(series, train_end, horizon, season, models).write.mode("overwrite").parquet(f"{path}/runs")
    run = spark.read.parquet(f"{path}/runs")
    quarters = (ordinal_quarter(F.col("first_q")), ordinal_quarter(F.col("last_q")))
    parts = {
        "skipped": run.filter(F.col("reason").isNotNull()).select("series_key", "reason"),
        "holdout": run.select("series_key", F.inline("scores")),
        "primary": run.filter(F.col("primary_model").isNotNull()).select("series_key", "primary_model", "mae"),
        "forecasts": run_forecasts(run),
        "windows": run.select(
            "series_key",
            quarters[0].alias("first_quarter"),
            quarters[1].alias("last_quarter"),
            "n_quarters",
            "n_train",
            (F.col("last_q") - F.col("first_q") + 1 != F.col("n_quarters")).alias("has_gaps"),
        ),
    }
    for name, rows in parts.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def lookup(
    requests: DataFrame,
    forecasts: DataFrame,
    skips: DataFrame,
    windows: DataFrame | None = None,
    scores: DataFrame | None = None,
) -> DataFrame:
    """Answer requests (request_id, series_key, horizon) from stored forecasts, with a status.

    A request that cannot be met gives one row without values: the series was skipped, is
    unknown, or has fewer stored quarters than asked for. Requests without a series are answered
    at once and meet no join. With `windows` and `scores` (the stored tables of a run) each answer
    also states the training window and how its model did on the held-out quarters.
    """
    nothing = F.coalesce(F.col("series_key"), F.lit("")) == ""
    stored_steps = forecasts.groupBy("series_key").agg(F.max("h").alias("available"))
    status = (
        F.when(F.col("reason").isNotNull(), F.concat(F.lit("no forecast: "), "reason"))
        .when(F.col("available").isNull(), F.lit("unknown series"))
        .when(F.col("horizon") > F.col("available"), F.lit("horizon too long"))
        .otherwise(F.lit("ok"))
    )
    judged = (
        requests.filter(~nothing)
        .join(stored_steps, "series_key", "left")
        .join(skips, "series_key", "left")
        .select("request_id", "series_key", "horizon", status.alias("status"))
    )
    columns = ["model", "h", "quarter", "point", "lower_80", "upper_80"]
    facts = forecasts.select("series_key", *columns)
    if windows is not None:
        facts = facts.join(windows.select("series_key", "first_quarter", "last_quarter", "n_train"), "series_key")
        columns += ["first_quarter", "last_quarter", "n_train"]
    if scores is not None:
        facts = facts.join(scores.select("series_key", "model", "mae", "coverage_80"), ["series_key", "model"])
        columns += ["mae", "coverage_80"]
    rows = facts.withColumnRenamed("series_key", "_of")
    wanted = (
        (F.col("series_key") == F.col("_of")) & (F.col("status") == "ok") & (F.col("h") <= F.col("horizon"))
    )
    found = judged.join(rows, wanted, "left").select("request_id", "series_key", "status", *columns)
    unnamed = requests.filter(nothing).select(
        "request_id", "series_key", F.lit("series is required").alias("status")
    )
    return found.unionByName(unnamed, allowMissingColumns=True)
