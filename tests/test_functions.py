import json
import random

import pytest
from pyspark.sql import functions as F

from payscope.functions import calendar as C
from payscope.functions import numbers as N
from payscope.functions.arithmetic import STEPS, recomputed
from payscope.functions.ratios import guarded_percent
from payscope.functions.text import evidence_id, series_evidence_id, strip


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_dates(spark):
    raw = ["2023-04-15", " 2023-4-5\t", "04/15/2023", "4/5/2023", "2023-02-30", "23-4-5", "", None,
           "n/a", "0000-01-01", "12023-01-01", "2023-04-15x", "13/1/2023", " 2023-12-31 "]
    got = column(spark, raw, C.quarter_of)
    assert got == ["2023Q2", "2023Q2", "2023Q2", "2023Q2"] + [None] * 9 + ["2023Q4"]


@pytest.mark.parametrize("month", range(1, 13))
def test_quarter_boundaries(spark, month):
    assert column(spark, [f"2023-{month:02d}-28"], C.quarter_of) == [f"2023Q{(month + 2) // 3}"]


def test_ordinals(spark):
    assert column(spark, ["2024Q4", "2021Q1"], C.quarter_ordinal) == [8099, 8084]
    assert column(spark, [8099, 8100, 8084], C.ordinal_quarter, "int") == ["2024Q4", "2025Q1", "2021Q1"]


def test_ids(spark):
    import hashlib

    sql = "SELECT 1"
    assert column(spark, [sql], evidence_id) == ["q_" + hashlib.sha256(sql.encode()).hexdigest()[:8]]
    assert column(spark, ["specialty:Internal Medicine"], series_evidence_id) == [
        "f_specialty_Internal_Medicine"
    ]


def test_strip_is_unicode_wide(spark):
    values = [" \t\n x y　\x1f ", " ", "z"]
    assert column(spark, values, strip) == [v.strip() for v in values]


def test_guarded_percent(spark):
    row = spark.sql("select 1 a, 3 b, 0 z, cast(null as int) n").select(
        guarded_percent(F.col("a"), F.col("b")),
        guarded_percent(F.col("a"), F.col("z")),
        guarded_percent(F.col("n"), F.col("b")),
    ).first()
    assert tuple(row) == (33.33, None, None)


#: Texts with the numbers that they hold; years are none.
TEXTS = {
    'a "quoted" $1,234.5 \\ 7': [1234.5, 7.0],
    "line\n5": [5.0],
    "in 2023 12%": [12.0],
    'back\\"9': [9.0],
    "\\": [],
    '"': [],
    "{3: [4]}": [3.0, 4.0],
    "": [],
}


def test_leaves_of_any_json(spark):
    """Documents are made together with the numbers that must be found in them, in order."""
    rng = random.Random(7)
    payloads, wanted = [{"a": {"b": [{"c": {"d": [[{"e": 1.5}]]}}]}}], [[1.5]]
    for _ in range(150):
        # Leaves first; then neighbours are wrapped up, again and again, until one value is left.
        nodes = []
        for _ in range(rng.randrange(1, 12)):
            text = rng.choice(list(TEXTS))
            flag = rng.choice([True, False, None])
            plain = rng.choice([0, -5, 3.25, 1e-7, 2023, 12345678901])
            nodes.append(rng.choice([(text, TEXTS[text]), (flag, []), (plain, [float(plain)])]))
        while len(nodes) > 1 or not isinstance(nodes[0][0], (list, dict)):
            at, n = rng.randrange(len(nodes)), rng.randrange(1, 4)
            taken = nodes[at : at + n]
            values = [v for v, _ in taken]
            names = ['q"7', "b\\8", "n: 9"]  # numbers in names do not count
            whole = values if rng.random() < 0.5 else dict(zip(names, values))
            nodes[at : at + n] = [(whole, [x for _, found in taken for x in found])]
        payloads.append(nodes[0][0])
        wanted.append(nodes[0][1])
    got = column(spark, [json.dumps(p) for p in payloads], N.numeric_leaves)
    for payload, leaves, want in zip(payloads, got, wanted):
        assert leaves == want, payload


def test_long_texts_do_not_overflow(spark):
    long_text = '\\"' * 60_000 + " 42 "
    payload = json.dumps({"doc": long_text, "n": 7})
    assert column(spark, [payload], N.numeric_leaves) == [[42.0, 7.0]]


def test_whole_number_leaves(spark):
    payload = json.dumps([{"a": "34.05", "b": "1,000", "c": "about 5", "d": 6, "e": True}])
    assert column(spark, [payload], N.whole_number_leaves) == [[34.05, 1000.0, 6.0]]


def test_close_agrees_with_rounding(spark):
    rng = random.Random(3)
    cases = [(1234.56, 1234.56, 2), (2.67, 2.675, 2), (2.68, 2.675, 2), (2.0, 2.5, 0), (3.0, 2.5, 0),
             (0.0, 0.004, 2), (0.0, 0.4, 0), (0.12, 0.125, 2), (0.13, 0.125, 2), (-3.0, -2.5, 0)]
    for _ in range(3000):
        decimals = rng.randrange(0, 4)
        candidate = round(rng.uniform(-20, 20), rng.randrange(0, 6))
        claim = round(candidate + rng.uniform(-1, 1) * 10**-decimals, decimals)
        cases.append((claim, candidate, decimals))
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, c double, v double, d int")
    got = frame.orderBy("i").select(N.close(F.col("c"), F.col("v"), F.col("d"))).collect()
    for (claim, candidate, decimals), (is_close,) in zip(cases, got):
        tolerance = 0.005 * abs(candidate or claim or 1)
        want = abs(candidate - claim) <= tolerance or round(candidate, decimals) == claim
        assert is_close == want, (claim, candidate, decimals)


def number(x):
    return (x, None)


def step(n):
    return (None, n)


@pytest.mark.parametrize(
    "steps,value",
    [
        ([("/", number(1234.56), number(5000.0)), ("*", step(0), number(100.0))], 24.6912),
        ([("-", number(120.0), number(100.0)), ("/", step(0), number(100.0)), ("*", step(1), number(100.0))], 20.0),
        ([("+", number(2.0), number(3.0)), ("-", number(0.0), step(0)), ("*", step(0), step(1))], -25.0),
        ([("%", number(7.0), number(4.0))], 3.0),
        ([("%", number(-7.0), number(4.0))], 1.0),
        ([("/", number(1.0), number(0.0))], None),
        ([("%", number(1.0), number(0.0))], None),
        ([("^", number(2.0), number(3.0))], None),
        ([("+", number(2.0), number(None))], None),
        ([("+", step(0), number(1.0))], None),
        ([("+", number(2.0), step(5))], None),
        ([("*", number(1e300), number(1e300))], None),
        ([], None),
        (None, None),
    ],
)
def test_derivation_steps(spark, steps, value):
    rows = None if steps is None else [(op, *left, *right) for op, left, right in steps]
    frame = spark.createDataFrame([(rows,)], f"steps {STEPS}")
    assert frame.select(recomputed(F.col("steps"))).first()[0] == pytest.approx(value)
