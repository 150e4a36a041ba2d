"""All registered queries against their SQL, and the shape of their plans."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from payscope.operators import canary, rollups, screening
from payscope import schemas as S
from payscope.plans import testbed as tb
from payscope.plans.oracle import ORACLE
from payscope.plans.queries import QUERIES
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_against_sql(spark, con, name):
    problem, *_ = compare(spark, con, SF, name, QUERIES[name], ORACLE.get(name))
    assert problem is None


def test_registered_queries_hold_these():
    assert QUERIES.items() <= contract.queries().items()
    assert ORACLE.items() <= contract.oracle_sql().items() and set(QUERIES) == set(ORACLE)


def test_all_lines_reach_the_filings(spark):
    names = [F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in S.NAME_FIELDS]
    cells = tb.filings(spark, SF).agg(F.sum(sum(names[1:], names[0]))).first()[0]
    assert cells == tb.table(spark, SF, "lineitem").count()


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) > 1 and rows[0].total_usd == max(r.total_usd for r in rows)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


NOT_PURELY_BUILT_IN = ["hw_forecast", "model_choice", "own_model"]
RUNS_A_STREAM = ["stream_upsert", "stream_quarter_totals", "stream_filings", "kept_specialty_view", "stream_load_statistics"]
PLANNED = [n for n in QUERIES if n not in NOT_PURELY_BUILT_IN + RUNS_A_STREAM]


@pytest.mark.parametrize("name", PLANNED)
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    for word in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan


def test_land_is_one_narrow_stage(spark, tmp_path):
    tb.filings(spark, SF).write.parquet(str(tmp_path / "f"))
    from payscope.operators.matching import land
    from payscope.operators.typing import good_rows

    filings = spark.read.parquet(str(tmp_path / "f"))
    plan = plan_of(good_rows(land(filings, tb.PRODUCTS, F.lit("s"))))
    assert "Exchange" not in plan and "Join" not in plan


def test_percentiles_read_their_input_once(spark):
    events = tb.table(spark, SF, "events").select("event_type", "value")
    frame = canary.latency_percentiles(events, "event_type", "value")
    plan = plan_of(frame)
    assert "events.parquet" not in plan and plan.count("Scan parquet") > 0  # only the stored counts


def test_scans_are_pruned(spark):
    plan = plan_of(contract.queries()["did_estimate"](spark, SF))
    assert "l_comment" not in plan and "l_shipdate" not in plan and "o_totalprice" not in plan


def test_gate_prunes_year_partitions(spark):
    plan = plan_of(contract.queries()["landing_gate"](spark, SF))
    assert "dynamicpruning" in plan


SCREENED = [
    ("SELECT COUNT(*) FROM payments", None, "SELECT COUNT(*) FROM payments LIMIT 5000"),
    ("SELECT 1 FROM payments limit 7 ;", None, "SELECT 1 FROM payments limit 7"),
    ("", "empty query", None),
    (None, "empty query", None),
    ("SELECT 1 FROM payments; TRUNCATE q_totals", "multiple statements", None),
    ("DELETE FROM payments", "not a single SELECT", None),
    ("SELECTED FROM payments", "not a single SELECT", None),
    ("SELECT 1 FROM payments WHERE x IN (DELETE)", "write keyword", None),
    ("SELECT created_at FROM payments", None, "SELECT created_at FROM payments LIMIT 5000"),
    ("SELECT 1 FROM payments -- x", "comment", None),
    ("SELECT 1", "no FROM clause", None),
    ("SELECT 1 FROM Users JOIN payments ON true", "table not allowed: users", None),
    ("SELECT SUM(x) FILTER (WHERE y = 1) / NULLIF(SUM(x), 0) FROM q_totals LIMIT 5", None,
     "SELECT SUM(x) FILTER (WHERE y = 1) / NULLIF(SUM(x), 0) FROM q_totals LIMIT 5"),
]


def test_screen(spark):
    frame = spark.createDataFrame([(i, s[0]) for i, s in enumerate(SCREENED)], "i int, sql string")
    rows = screening.screen(frame).orderBy("i").collect()
    assert [(r.reason, r.normalized) for r in rows] == [s[1:] for s in SCREENED]
    assert [r.accepted for r in rows] == [s[1] is None for s in SCREENED]


def test_cap(spark):
    assert rollups.capped(spark.range(6000), 5000).count() == 5000


def test_broken_and_good_records_come_from_one_pass(spark):
    assert plan_of(QUERIES["csv_quarantine"](spark, SF)).count("FileScan csv") == 1


def test_records_that_are_landed_twice_are_made_once(spark, monkeypatch):
    landed, inputs = tb.landed, []

    def seen(*args):
        rows = landed(*args)
        monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.json", noting)
        return rows

    from pyspark.sql.readwriter import DataFrameWriter

    json = DataFrameWriter.json

    def noting(self, path, **options):
        inputs.append(self._df.inputFiles())
        return json(self, path, **options)

    monkeypatch.setattr(tb, "landed", seen)
    QUERIES["upsert_stamped"](spark, SF)
    assert len(inputs) == 2 and not any("lineitem" in f for files in inputs for f in files)
