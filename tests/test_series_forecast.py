import random

import pytest

from payscope.functions.smoothing import holt_winters
from payscope.operators import causal, forecast, series

PAYMENTS = "quarter string, physician_specialty string, manufacturer string, amount_usd decimal(14,2)"


def payments(spark, rows):
    from decimal import Decimal

    return spark.createDataFrame([(q, s, m, Decimal(str(a))) for q, s, m, a in rows], PAYMENTS)


def by_key(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.series_key, {})[r.quarter] = r.value
    return out


ROWS = [
    ("2023Q1", "Endo", "Novo Nordisk", 100), ("2023Q1", None, "Acme", 50), ("2023Q2", "Endo", "Acme", 200),
    ("2023Q2", "Aa", "Acme", 300), (None, "Endo", "Acme", 999), ("2023Q3", "Zz", "Eli Lilly", 300),
]


def test_national_and_specialties(spark):
    rows = payments(spark, ROWS)
    assert by_key(series.national_series(rows)) == {"national": {"2023Q1": 150.0, "2023Q2": 500.0, "2023Q3": 300.0}}
    top = by_key(series.specialty_series(rows, 2))
    assert list(sorted(top)) == ["specialty:Aa", "specialty:Endo"]
    everything = by_key(series.all_series(rows, None))
    assert everything["specialty:(unknown)"] == {"2023Q1": 50.0}
    one_pass = by_key(series.all_series(rows, 2))
    assert one_pass == {**by_key(series.national_series(rows)), **top}


def long_series(spark, values, start="2020Q1", key="s"):
    year, nth = int(start[:4]), int(start[5])
    first = year * 4 + nth - 1
    rows = [(key, f"{(first + i) // 4}Q{(first + i) % 4 + 1}", float(v)) for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, "series_key string, quarter string, value double")


TREND = [100 + 2 * t + [10, -5, 15, -20][t % 4] for t in range(24)]


def test_naive_repeats_the_last_season(spark):
    out = forecast.labelled(forecast.seasonal_naive(long_series(spark, range(1, 9)), 6)).orderBy("h").collect()
    assert [r.point for r in out] == [5, 6, 7, 8, 5, 6]
    assert [r.quarter for r in out][:2] == ["2022Q1", "2022Q2"]
    assert all(r.lower_80 == r.point == r.upper_80 for r in out)  # all changes are 4: no spread
    assert forecast.seasonal_naive(long_series(spark, [1, 2, 3])).count() == 0


def test_naive_interval(spark):
    history = [1, 5, 2, 8, 3, 4, 9, 7, 5, 5]
    changes = [b - a for a, b in zip(history, history[4:])]
    mean = sum(changes) / len(changes)
    spread = (sum((c - mean) ** 2 for c in changes) / (len(changes) - 1)) ** 0.5
    row = forecast.seasonal_naive(long_series(spark, history)).filter("h = 1").first()
    assert row.upper_80 - row.point == pytest.approx(1.2816 * spread)


def test_measures(spark):
    frame = spark.createDataFrame(
        [(10.0, 12.0, 5.0, 15.0), (20.0, 18.0, 25.0, 35.0), (30.0, 30.0, 25.0, 35.0), (40.0, 40.0, 35.0, 45.0)],
        "actual double, point double, lower_80 double, upper_80 double",
    )
    assert frame.agg(forecast.coverage()).first()[0] == 0.75
    assert frame.limit(2).agg(forecast.mean_absolute_error()).first()[0] == 2


def test_holt_winters_beats_naive_on_trend_and_season(spark):
    tested = forecast.holdout(long_series(spark, TREND), "2024Q4")
    rows = tested.orderBy("model", "quarter").collect()
    assert [r.quarter for r in rows if r.model == "ets"] == ["2025Q1", "2025Q2", "2025Q3", "2025Q4"]
    assert {r.n_train for r in rows} == {20}
    scores = {r.model: r for r in forecast.holdout_scores(tested).collect()}
    assert scores["seasonal_naive"].mae == 8.0
    assert scores["ets"].mae < 1e-6
    primary = forecast.primary_models(forecast.holdout_scores(tested))
    assert primary.first().primary_model == "ets"
    final = forecast.final_forecasts(long_series(spark, TREND), primary).orderBy("h").collect()
    assert [r.quarter for r in final] == ["2026Q1", "2026Q2", "2026Q3", "2026Q4"]
    want = [100 + 2 * t + [10, -5, 15, -20][t % 4] for t in range(24, 28)]
    assert [r.point for r in final] == pytest.approx(want, abs=1e-6)


def test_holt_winters_is_deterministic_and_sane():
    rng = random.Random(5)
    noisy = [v + rng.uniform(-3, 3) for v in TREND]
    point, spread = holt_winters(noisy, 4)
    again, _ = holt_winters(noisy, 4)
    assert list(point) == list(again) and 0 < spread < 10
    want = [100 + 2 * t + [10, -5, 15, -20][t % 4] for t in range(24, 28)]
    assert max(abs(p - w) for p, w in zip(point, want)) < 12
    scaled, wide = holt_winters([v * 1e6 for v in noisy], 4)
    assert list(scaled) == pytest.approx([p * 1e6 for p in point], rel=1e-6)
    assert wide == pytest.approx(spread * 1e6, rel=1e-6)
    with pytest.raises(ValueError):
        holt_winters(range(7), 4)
    flat, none = holt_winters([5.0] * 10, 2)
    assert list(flat) == pytest.approx([5, 5]) and none == pytest.approx(0, abs=1e-9)


def test_ties_go_to_the_naive_model(spark):
    scores = spark.createDataFrame(
        [("s", "ets", 1.0), ("s", "seasonal_naive", 1.0)], "series_key string, model string, mae double"
    )
    assert forecast.primary_models(scores).first().primary_model == "seasonal_naive"


@pytest.mark.parametrize(
    "values,start,reason",
    [
        ([1] * 7, "2023Q1", "only 7 quarters of data, need at least 8"),
        ([1] * 9, "2025Q1", "no training data at or before 2024Q4"),
        ([1] * 20 + [1, None, 1, 1], "2020Q1", "missing actuals for 2025Q2"),
        ([1] * 20, "2020Q1", "missing actuals for 2025Q1, 2025Q2, 2025Q3, 2025Q4"),
        ([1] * 8, "2024Q2", "seasonal_naive needs at least 4 observations"),
        ([1] * 10, "2023Q3", "ets needs at least 8 observations"),
        ([1] * 12, "2023Q1", None),
    ],
)
def test_skips(spark, values, start, reason):
    rows = long_series(spark, values, start)
    got = [r.reason for r in forecast.skipped(rows).collect()]
    assert got == ([] if reason is None else [reason])
    assert (forecast.holdout(rows).count() == 0) == (reason is not None)


def test_gaps_are_flagged(spark):
    row = series.windows_summary(long_series(spark, [1, None, 2, 3]), "2020Q3").first()
    assert (row.first_quarter, row.last_quarter, row.n_quarters, row.n_train, row.n_test, row.has_gaps) == (
        "2020Q1", "2020Q4", 3, 2, 1, True)


def test_own_models_and_errors(spark):
    def last(history, horizon, season):
        if len(history) < 2:
            raise ValueError("too short")
        return [history[-1]] * horizon, [0] * horizon, [1] * horizon

    both = long_series(spark, [1, 2, 3], key="long").union(long_series(spark, [1], key="short"))
    rows = forecast.fit_each(both, {"last": last}, 2).orderBy("series_key", "h").collect()
    assert [(r.series_key, r.h, r.point, r.error) for r in rows] == [
        ("long", 1, 3.0, None), ("long", 2, 3.0, None), ("short", None, None, "too short")]


def test_lookup(spark):
    history = long_series(spark, TREND, key="national").union(long_series(spark, [1], key="short"))
    skips = forecast.skipped(history)
    stored = forecast.labelled(forecast.seasonal_naive(history))
    asked = spark.createDataFrame(
        [(1, "national", 2), (2, "national", 5), (3, "nobody", 1), (4, "short", 1), (5, "", 1)],
        "request_id int, series_key string, horizon int",
    )
    rows = forecast.lookup(asked, stored, skips).orderBy("request_id", "h").collect()
    assert [(r.request_id, r.status, r.quarter) for r in rows] == [
        (1, "ok", "2026Q1"), (1, "ok", "2026Q2"), (2, "horizon too long", None), (3, "unknown series", None),
        (4, "no forecast: only 1 quarters of data, need at least 8", None), (5, "series is required", None)]


GROUPS = [("2023Q1", None, "Novo Nordisk", 100), ("2023Q2", None, "Novo Nordisk", 200),
          ("2023Q1", None, "Acme", 50), ("2023Q2", None, "Acme", 60)]


def test_did_arithmetic(spark):
    groups = causal.group_series(payments(spark, GROUPS))
    row = causal.estimate(groups, "2023Q2").first()
    assert row.ok and row.reason is None and row.diff_in_diff_usd == 90.0
    assert (row.treated_delta_usd, row.control_delta_usd) == (100.0, 10.0)


def test_did_split_is_exact_unless_asked(spark):
    rows = payments(spark, [*GROUPS, ("2023Q2", None, "Novo Nordisk Inc.", 7), ("2023Q2", None, "eli lilly", 3)])
    exact = {r.quarter: r for r in causal.group_series(rows).collect()}["2023Q2"]
    loose = {r.quarter: r for r in causal.group_series(rows, match="ilike").collect()}["2023Q2"]
    assert (exact.treated_usd, exact.control_usd) == (200, 70)
    assert (loose.treated_usd, loose.control_usd) == (210, 60)


def test_did_insufficient_and_empty(spark):
    groups = causal.group_series(payments(spark, GROUPS))
    row = causal.estimate(groups, "2030Q1").first()
    assert not row.ok and row.reason == "insufficient data for: treated_after, control_after"
    assert row.diff_in_diff_usd is None and (row.n_before, row.n_after) == (2, 0)
    none = causal.estimate(groups.limit(0)).first()
    assert not none.ok and none.reason == "no rows with a quarter" and none.event_quarter is None


def test_default_event_is_the_upper_median(spark):
    rows = payments(spark, [*GROUPS, ("2023Q3", None, "Acme", 5)])
    assert causal.estimate(causal.group_series(rows)).first().event_quarter == "2023Q2"
    assert causal.estimate(causal.group_series(payments(spark, GROUPS))).first().event_quarter == "2023Q2"
    trend = causal.trend_table(causal.group_series(rows)).orderBy("quarter").collect()
    assert [(r.quarter, r.period, r.treated_usd, r.control_usd) for r in trend] == [
        ("2023Q1", "before", 100.0, 50.0), ("2023Q2", "after", 200.0, 60.0), ("2023Q3", "after", None, 5.0)]
