import pytest
from pyspark.sql import functions as F

from payscope import schemas as S
from payscope.operators import canary, scoring
from payscope.session import scratch_dir
from payscope.sources import traces as files

SQL = "SELECT physician_state, SUM(amount_usd) FROM payments GROUP BY 1"
GOLD = {"value": 1000.0, "unit": "USD", "tolerance": 0.005, "expected_table": "payments",
        "expected_columns": ["amount_usd"]}
FAILED = ("SELECT wrong FROM payments", False)
RAN = (SQL, True)


def case(id="c", gold=None, expect_abstain=False, parts=()):
    gold = None if gold is None else tuple(gold.get(k) for k in S.GOLD.names)
    return (id, "?", gold, expect_abstain, None, list(parts))


def trace(answer, queries=(RAN,), id="c", calls=()):
    steps = [("plan", (None, None, None, None))] + [
        ("tool_call", ("query_tool", ok, None, (sql, 1, 1.0) if sql else None)) for sql, ok in queries
    ]
    calls = [("a", i, o, ms, 200, 0, None) for i, o, ms in calls]
    return (id, "?", "m", "a", answer, True, [], None, sum(c[1] for c in calls), sum(c[2] for c in calls), steps, calls)


def scored(spark, cases, traces):
    frame = scoring.score(spark.createDataFrame(cases, S.CASE), spark.createDataFrame(traces, S.TRACE))
    return {r.id: r for r in frame.collect()}


@pytest.mark.parametrize(
    "answer,gold,parts,expect,queries,want",
    [  # want: correct, complete, retrieval_ok, abstained, passed
        ("It was $1,004.99 [q].", GOLD, [], False, (RAN,), (True, True, True, False, True)),
        ("It was $1,005.01 [q].", GOLD, [], False, (RAN,), (False, True, True, False, False)),
        ("It was 1000%", {**GOLD, "tolerance": None}, [], False, (RAN,), (True, True, True, False, True)),
        ("It was -1000", GOLD, [], False, (RAN,), (False, True, True, False, False)),
        ("none at all", GOLD, [], False, (RAN,), (False, False, True, False, False)),
        (None, GOLD, [], False, (RAN,), (False, False, True, False, False)),
        ("", GOLD, [], False, (RAN,), (False, False, True, False, False)),
        ("It was 1000", None, [], False, (RAN,), (None, None, None, False, None)),
        ("NO MATCHING DATA yet", None, [], True, (RAN,), (None, None, None, True, True)),
        ("No data available.", None, [], False, (RAN,), (None, None, None, True, None)),
        ("Food AND beverage: 1000", GOLD, ["food and beverage"], False, (RAN,), (True, True, True, False, True)),
        ("Semaglutide 1000", GOLD, ["semaglutide", "tirzepatide"], False, (RAN,), (True, False, True, False, True)),
        ("about food", None, ["food"], False, (RAN,), (None, True, None, False, None)),
        ("1000", GOLD, [], False, (FAILED,), (True, True, None, False, None)),
        ("7", GOLD, [], False, (FAILED,), (False, True, None, False, False)),
        ("1000", GOLD, [], False, (FAILED, RAN), (True, True, True, False, True)),
        ("1000", GOLD, [], False, (("SELECT x FROM other", True), RAN), (True, True, False, False, False)),
        ("1000", {**GOLD, "expected_columns": ["nope"]}, [], False, (RAN,), (True, True, False, False, False)),
        ("1000", {**GOLD, "expected_columns": None}, [], False, (RAN,), (True, True, True, False, True)),
        ("1000", {**GOLD, "expected_table": None}, [], False, (RAN,), (True, True, None, False, None)),
        ("1000", GOLD, [], False, ((None, True),), (True, True, None, False, None)),
    ],
)
def test_scores(spark, answer, gold, parts, expect, queries, want):
    row = scored(spark, [case(gold=gold, parts=parts, expect_abstain=expect)], [trace(answer, queries)])["c"]
    assert (row.correct, row.complete, row.retrieval_ok, row.abstained, row.passed) == want


def test_summary_and_missing_trace(spark):
    cases = [case("a", GOLD), case("b", GOLD), case("c", GOLD)]
    traces = [trace("1000", id="a", calls=[(100, 10, 5.5), (50, 5, 4.5)]), trace("7", id="b", calls=[(1, 1, 1.0)])]
    rows = scored(spark, cases, traces)
    assert (rows["c"].passed, rows["c"].error, rows["c"].calls) == (None, "no trace", 0)
    assert (rows["a"].latency_ms, rows["a"].calls) == (10.0, 2)
    frame = scoring.score(spark.createDataFrame(cases, S.CASE), spark.createDataFrame(traces, S.TRACE))
    total = scoring.summary(frame, 0.06, 0.24).first()
    assert (total.passed, total.failed, total.not_scored, total.total) == (1, 1, 1, 3)
    assert (total.total_input_tokens, total.total_output_tokens, total.total_latency_ms) == (151, 16, 11.0)
    assert total.total_cost_usd == pytest.approx((151 * 0.06 + 16 * 0.24) / 1e6)
    assert scoring.summary(frame).first().total_cost_usd is None
    calls = {r.case_id: tuple(r)[1:] for r in scoring.call_rollup(spark.createDataFrame(traces, S.TRACE)).collect()}
    assert calls["a"] == (2, 150, 15, 10.0)


def test_trace_files(spark, tmp_path):
    path = scratch_dir(spark, "test-traces")
    stored = spark.createDataFrame([trace("1000", id="a")], S.TRACE)
    files.write_traces(stored, path)
    assert files.read_traces(spark, path).collect() == stored.collect()
    (tmp_path / "top-state.json").write_text(
        '{\n "answer_text": "5",\n "steps": [{"kind": "tool_call", "detail": {"tool": "query_tool",'
        ' "args": {"question": "x"}, "ok": false, "error": "e", "data": null}}], "calls": []\n}'
    )
    row = files.read_traces(spark, str(tmp_path), one_per_file=True).first()
    assert (row.case_id, row.answer_text, row.steps[0].detail.tool) == ("top-state", "5", "query_tool")


def test_case_files(spark, tmp_path):
    (tmp_path / "cases.json").write_text(
        '[{"id": "a", "question": "?", "gold": {"value": 5, "expected_table": "payments"}, "parts": ["x"]},'
        ' {"id": "b", "question": "?", "gold": null, "expect_abstain": true}]'
    )
    rows = {r.id: r for r in files.read_cases(spark, str(tmp_path / "cases.json")).collect()}
    assert rows["a"].gold.value == 5.0 and rows["b"].gold is None and rows["b"].expect_abstain


ROWS = (
    "run_id int, id string, answer string, accepted boolean, unverified array<string>, sql string, "
    "expected_columns array<string>, gold_numbers array<double>, error string"
)


@pytest.mark.parametrize(
    "answer,accepted,unverified,gold,error,want",
    [  # want: correct, cited, abstained, status
        ("$1,000.02 [q_web] for GLP-1 in 2021", True, [], [1000.0], None, (True, True, False, "OK")),
        ("$500.00 [q_web]", True, [], [1000.0], None, (False, True, False, "MISS")),
        ("$1,000.00", False, [], [1000.0], None, (False, False, False, "MISS")),
        ("$1,000.00 and 7", True, ["7"], [1000.0, 7.0], None, (False, False, False, "MISS")),
        ("$1,000.00 and 7", True, [], [1000.0, 7.0], None, (True, True, False, "OK")),
        ("$1,000.00 and 8", True, [], [1000.0, 7.0], None, (False, True, False, "MISS")),
        ("no number", True, [], [1000.0], None, (False, True, False, "MISS")),
        ("No matching data", True, [], [], None, (True, None, True, "OK")),
        ("$5", True, [], None, None, (False, None, False, "MISS")),
        (None, None, None, [1.0], "HTTP 500", (False, None, False, "ERR")),
    ],
)
def test_canary_rows(spark, answer, accepted, unverified, gold, error, want):
    rows = spark.createDataFrame([(1, "i", answer, accepted, unverified, SQL, ["amount_usd"], gold, error)], ROWS)
    row = canary.score_rows(rows).first()
    assert (row.correct, row.cited, row.abstained, row.status) == want and row.retrieval_ok


def test_canary_numbers(spark):
    text = "GLP-1, Q3, v12, x-5, -7, 1,234.50, 2021, 2150, 5-6, 1.5"
    frame = spark.createDataFrame([(text,), (None,)], "t string").select(canary.stated_numbers(F.col("t")))
    assert [r[0] for r in frame.collect()] == [[-7.0, 1234.5, 2150.0, 5.0, 1.5], []]


def test_gold_numbers(spark):
    gold = spark.sql("select 'a' id, 'CA' state, cast(2.5 as decimal(14,2)) usd, null n, 3 k union all "
                     "select 'b', 'NY', null, null, null")
    rows = {r.id: r.gold_numbers for r in canary.gold_numbers(gold, "id").collect()}
    assert rows == {"a": [2.5, 3.0], "b": []}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 10, 20, 21, 40, 101])
def test_percentiles_are_exact(spark, n):
    import random

    rng = random.Random(n)
    values = [rng.choice([30_000.0, rng.uniform(0, 900), 5.0]) for _ in range(n)]
    frame = spark.createDataFrame([("run", v) for v in values] + [("none", None)], "run_id string, latency_ms double")
    row = canary.latency_percentiles(frame, "run_id").first()
    ordered = sorted(values)
    place = max(0, min(n - 1, int(round(n * 0.95 - 0.5))))
    assert (row.p50_ms, row.p95_ms) == (ordered[n // 2], ordered[place])


def test_rollup_and_ledger(spark):
    rows = [(1, str(i), "No matching data", True, [], None, [], [], None) for i in range(8)]
    rows += [(2, "x", "5", True, [], None, [], [], None), (2, "y", None, True, [], None, [], [], "timeout")]
    scored_rows = canary.score_rows(spark.createDataFrame(rows, ROWS))
    records = canary.rollup(scored_rows, "run_id")
    got = {r.run_id: (r.n, r.observed, r.errors, r.match) for r in records.collect()}
    assert got == {1: (8, 8.0, 0, True), 2: (2, 0.0, 1, False)}
    lines = [r.line for r in canary.report_lines(scored_rows.filter("run_id = 2")).collect()]
    assert sorted(lines) == ["x MISS", "y ERR"]
    path = scratch_dir(spark, "test-ledger")
    for ts in ("2026-01-02", "2026-01-01"):
        canary.append_ledger(records.withColumn("ts", F.lit(ts)), path)
    assert {r.ts for r in canary.latest_record(spark.read.parquet(path), ["run_id"]).collect()} == {"2026-01-02"}


def test_cover(spark):
    left = spark.createDataFrame([("a",), ("b",)], "id string")
    right = spark.createDataFrame([("b",), ("c",)], "id string")
    assert {tuple(r) for r in canary.id_cover(left, right).collect()} == {("a", "canary only"), ("c", "cases only")}
    assert canary.id_cover(left, left).count() == 0
