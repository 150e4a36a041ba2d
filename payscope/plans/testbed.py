"""The reference's record shapes derived from the given tables (see FIXTURES.md, part B).

Every view is one declarative plan over whole tables; `payscope/plans/oracle.py` states the same
views in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from payscope import schemas as S
from payscope.functions.calendar import ordinal_quarter
from payscope.operators.matching import land
from payscope.operators.typing import good_rows
from payscope.sources.dictionary import ProductDictionary

PRODUCTS = ProductDictionary(
    generic_names=["red ring", "hot gizmo"],
    brand_names=["cold anvil", "old bolt", "new gear", "blue rod", "small plate"],
    brand_to_generic={
        "cold anvil": "red ring",
        "old bolt": "red ring",
        "new gear": "red ring",
        "blue rod": "hot gizmo",
        "small plate": "hot gizmo",
    },
    manufacturers_of_record=["Supplier#000000007", "SUPPLIER#000000011"],
)


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Its schema is read from the file once; later plans need no job for it."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide all-text rows: five lines of an order fill one, so an order has as many as it needs."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_shipdate",
        "l_extendedprice",
        "l_returnflag",
    )
    order = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"
    )
    at = F.row_number().over(order) - 1
    slots = len(S.SLOTS)
    placed = lines.select(
        "*", F.floor(at / slots).cast("int").alias("chunk"), (at % slots + 1).alias("slot")
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    flag = F.col("l_returnflag")
    cells = placed.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey",
        "chunk",
        "l_suppkey",
        "slot",
        F.when(flag == "R", "")
        .when(flag == "A", F.upper("p_name"))
        .otherwise(F.col("p_name"))
        .alias("name"),
        F.when(flag == "R", F.concat_ws(" ", "p_type", "p_name"))
        .otherwise(F.col("p_type"))
        .alias("category"),
    )

    def cell(slot: int, column: str) -> Column:
        return F.max(F.when(F.col("slot") == slot, F.col(column)))

    wide = cells.groupBy("l_orderkey", "chunk").agg(
        cell(1, "l_suppkey").alias("first_suppkey"),
        *[cell(n, "name").alias(S.NAME_FIELDS[n - 1]) for n in S.SLOTS],
        *[cell(n, "category").alias(S.CATEGORY_FIELDS[n - 1]) for n in S.SLOTS],
    )
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    joined = (
        wide.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(supplier, F.col("first_suppkey") == F.col("s_suppkey"))
    )
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    us_date = F.concat_ws(
        "/", F.month(day).cast("string"), F.dayofmonth(day).cast("string"), F.year(day).cast("string")
    )
    return joined.select(
        F.concat_ws("-", key.cast("string"), F.col("chunk").cast("string")).alias(S.RECORD_ID),
        F.year(day).cast("string").alias(S.PROGRAM_YEAR),
        F.when(key % 97 == 0, "")
        .when(key % 101 == 0, "n/a")
        .when(key % 2 == 0, F.date_format(day, "yyyy-MM-dd"))
        .otherwise(us_date)
        .alias(S.PAYMENT_DATE),
        F.col("o_custkey").cast("string").alias(S.RECIPIENT_NPI),
        F.when(F.col("o_custkey") % 13 == 0, "")
        .otherwise(F.col("c_mktsegment"))
        .alias(S.RECIPIENT_SPECIALTY),
        F.col("n_name").alias(S.RECIPIENT_STATE),
        F.when(key % 89 == 0, "").otherwise(F.col("s_name")).alias(S.PAYER),
        F.col("o_orderpriority").alias(S.NATURE),
        F.when(key % 83 == 0, "abc")
        .otherwise(F.col("o_totalprice").cast("decimal(14,2)").cast("string"))
        .alias(S.AMOUNT),
        *S.NAME_FIELDS,
        *S.CATEGORY_FIELDS,
    )


def dataset_name() -> Column:
    return F.concat(F.lit("set-"), F.col(S.PROGRAM_YEAR))


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return land(filings(spark, sf_dir), PRODUCTS, dataset_name())


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed good rows; one row per record already."""
    return good_rows(landed(spark, sf_dir))


def line_payments(spark: SparkSession, sf_dir: str, n_parts: int = 0) -> DataFrame:
    """Upsert input: one landed row per lineitem with repeated keys and a total write order.

    With `n_parts` the lines are dealt over so many partitions by their part, before they are made wide.
    """
    lines = table(spark, sf_dir, "lineitem")
    if n_parts:
        lines = lines.repartition(n_parts, "l_partkey")
    day = F.to_date("l_shipdate")
    return lines.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias(
            "record_id"
        ),
        F.year(day).cast("string").alias("program_year"),
        F.date_format(day, "yyyy-MM-dd").alias("payment_date"),
        F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string")).alias(
            "quarter"
        ),
        F.lit(None).cast("string").alias("physician_id"),
        F.col("l_returnflag").alias("physician_specialty"),
        F.col("l_linestatus").alias("physician_state"),
        F.concat(F.lit("maker "), F.col("l_suppkey").cast("string")).alias("manufacturer"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("product"),
        F.lit(None).cast("string").alias("product_generic"),
        F.lit("line").alias("nature_of_payment"),
        F.col("l_extendedprice").cast("decimal(14,2)").cast("string").alias("amount_usd"),
        F.lit(S.NAME_FIELDS[0]).alias("matched_field"),
        F.concat(F.lit("set-"), F.year(day).cast("string")).alias("source_year_dataset"),
        F.struct(
            F.col("l_shipdate").alias("d"),
            F.col("l_partkey").alias("p"),
            F.col("l_suppkey").alias("s"),
            F.col("l_extendedprice").alias("x"),
        ).alias("ingest_seq"),
    )


# --- ingest gates -------------------------------------------------------------------------------


def _order_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(
        F.sum(F.length("o_orderpriority")).alias("bytes")
    )


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.col("year")
    return _order_years(spark, sf_dir).select(
        "year",
        (year % 3 != 0).alias("complete"),
        F.when(year % 5 != 0, F.concat(F.lit("raw/"), year.cast("string"), F.lit(".csv"))).alias(
            "s3_key"
        ),
        "bytes",
    )


def requested_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = _order_years(spark, sf_dir).select("year")
    return years.union(years.select(F.col("year") + 2)).distinct()


def stored_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.col("year")
    return (
        _order_years(spark, sf_dir)
        .filter(year % 7 != 0)
        .select(
            F.concat(F.lit("raw/"), year.cast("string"), F.lit(".csv")).alias("key"),
            (F.col("bytes") + F.when(year % 3 == 0, 1).otherwise(0)).alias("stored_bytes"),
        )
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.col("year")
    items = F.array(
        *[
            F.struct(
                F.concat(F.lit(f"{prefix}-"), year.cast("string")).alias("identifier"),
                F.when(year % 5 != 0, F.concat(F.lit(f"{prefix}/"), year.cast("string"))).alias(
                    "download_url"
                ),
                F.lit("2026-01-01").alias("modified"),
                F.lit(position).alias("position"),
            )
            for position, prefix in ((1, "set"), (2, "later"))
        ]
    )
    return (
        _order_years(spark, sf_dir)
        .filter(year % 4 != 0)
        .select(
            F.concat(year.cast("string"), F.lit(" General Payment Data")).alias("title"),
            F.inline(items),
        )
    )


# --- series and groups --------------------------------------------------------------------------

TRAIN_END = "2000Q3"


def order_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as payments: market segment as specialty, order price as amount."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    day = F.col("o_orderdate")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string")).alias(
            "quarter"
        ),
        F.when(F.col("o_custkey") % 13 != 0, F.col("c_mktsegment")).alias("physician_specialty"),
        F.col("o_totalprice").cast("decimal(14,2)").alias("amount_usd"),
    )


def line_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines as payments of their supplier, by quarter of the order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    day = F.col("o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string")).alias(
            "quarter"
        ),
        F.when(F.col("l_suppkey") % 10 == 0, "treated maker")
        .otherwise("other maker")
        .alias("manufacturer"),
        F.col("l_extendedprice").cast("decimal(14,2)").alias("amount_usd"),
    )


def exact_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series that follow level + trend + season exactly, one per fine group of orders.

    A group's series runs from its first to its last quarter; level and trend come from its number
    of orders.
    """
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    day = F.col("o_orderdate")
    q = (F.year(day) * 4 + F.quarter(day) - 1).cast("int")
    group = F.concat_ws(
        " ", F.col("c_nationkey").cast("string"), F.col("c_mktsegment"), F.col("o_orderpriority")
    )
    groups = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(group.alias("series_key"))
        .agg(F.count("*").alias("n"), F.min(q).alias("first"), F.max(q).alias("last"))
    )
    points = groups.select("*", F.explode(F.sequence("first", "last")).alias("q"))
    season = F.element_at(F.array(*[F.lit(x) for x in (0, 7, 3, 11)]), (F.col("q") % 4 + 1).cast("int"))
    value = F.col("n") * 1000 + F.col("n") % 3 * 10 * (F.col("q") - F.col("first")) + season * (1 + F.col("n") % 5)
    return points.select("series_key", ordinal_quarter(F.col("q")).alias("quarter"), value.cast("double").alias("value"))


# --- answers, evidence, traces ------------------------------------------------------------------


def maker_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales, returned sales and line count of each supplier that has lines."""
    usd = F.col("l_extendedprice").cast("decimal(14,2)")
    facts = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("k"))
        .agg(
            F.sum(usd).alias("sales"),
            F.sum(F.when(F.col("l_returnflag") == "R", usd).otherwise(F.lit(0))).alias("returned"),
            F.count("*").alias("n_lines"),
        )
    )
    share = F.col("returned").cast("double") / F.col("sales").cast("double")
    return facts.select(
        "k",
        F.col("sales").cast("decimal(18,2)").alias("sales"),
        F.col("returned").cast("decimal(18,2)").alias("returned"),
        "n_lines",
        share.alias("raw_share"),
        F.round(share, 6).cast("decimal(10,6)").alias("share"),
        F.round(share * 100, 2).cast("decimal(7,2)").alias("pct"),
    )


def _id(prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.col("k").cast("string"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON payloads; every fifth supplier also has an outdated one under the same id."""

    def payload(sales: Column) -> Column:
        return F.concat(
            F.lit('{"rows": [{"maker": "the \\"maker\\"", "sales": '),
            sales.cast("string"),
            F.lit(', "share": '),
            F.col("share").cast("string"),
            F.lit(', "lines": '),
            F.col("n_lines").cast("string"),
            F.lit(', "open": true}], "meta": {"note 3": "about 7.5 in 2001", "caps": [{"n": 5000}]}}'),
        )

    versions = F.filter(
        F.array(
            F.struct(F.lit(1).alias("position"), payload(F.lit(1)).alias("payload")),
            F.struct(F.lit(2).alias("position"), payload(F.col("sales")).alias("payload")),
        ),
        lambda v: (v["position"] == 2) | (F.col("k") % 5 == 0),
    )
    return maker_facts(spark, sf_dir).select(
        _id("a_").alias("answer_id"), _id("q_").alias("evidence_id"), F.inline(versions)
    )


def _answer_text() -> Column:
    k = F.col("k")
    gap = F.when(F.floor(k / 6) % 2 == 0, " ").otherwise("")
    stated = F.col("sales") * F.when(k % 10 == 9, 2).otherwise(1)
    money = F.format_number(stated, 2)
    marker = F.concat(F.lit("["), _id("q_"), F.lit("]"))
    lines = F.col("n_lines").cast("string")
    return (
        F.when(k % 6 == 0, F.concat(F.lit("In 2001 the GLP-1 maker sold $"), money, gap, marker, F.lit(".")))
        .when(
            k % 6 == 1,
            F.concat(F.lit("It sold $"), F.format_number(stated, 0), gap, marker, F.lit(" in 2001.")),
        )
        .when(
            k % 6 == 2,
            F.concat(
                F.col("pct").cast("string"),
                F.lit("% of what was sold came back to this GLP-1 maker by 2001 "),
                marker,
                F.lit("."),
            ),
        )
        .when(
            k % 6 == 3,
            F.concat(F.lit("It sold $"), money, F.lit(" in 2001, GLP-1 goods were 12% of it.")),
        )
        .when(
            k % 6 == 4,
            F.concat(F.lit("It sold $"), money, gap, F.lit("["), _id("q_none_"), F.lit("] in 2001.")),
        )
        .when(
            k % 12 == 5,
            F.concat(lines, F.lit(" lines and $"), money, F.lit(" come from one query "), marker),
        )
        .otherwise(F.concat(lines, F.lit(" lines sold for $"), money, gap, marker, F.lit(" by 2001.")))
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maker_facts(spark, sf_dir).select(
        _id("a_").alias("answer_id"), _answer_text().alias("answer_text")
    )


def derived_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maker_facts(spark, sf_dir).select(
        _id("a_").alias("answer_id"),
        F.concat(
            F.lit("Returns were "), F.col("pct").cast("string"), F.lit("% ["), _id("d_"), F.lit("] of sales.")
        ).alias("answer_text"),
    )


def derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """returned / sales * 100, or (sales - kept) / sales * 100; every ninth lacks an operand."""
    k = F.col("k")
    sales = F.col("sales").cast("double")
    returned = F.when(k % 9 != 8, F.col("returned").cast("double"))
    kept = F.when(k % 9 != 8, (F.col("sales") - F.col("returned")).cast("double"))

    def step(op: str, left: Column | int, right: Column) -> Column:
        earlier = isinstance(left, int)
        return F.struct(
            F.lit(op).alias("op"),
            (F.lit(None).cast("double") if earlier else left).alias("left"),
            (F.lit(left) if earlier else F.lit(None).cast("int")).alias("left_step"),
            right.alias("right"),
            F.lit(None).cast("int").alias("right_step"),
        )

    hundred = F.lit(100.0)
    steps = F.when(k % 2 == 0, F.array(step("/", returned, sales), step("*", 0, hundred))).otherwise(
        F.array(step("-", sales, kept), step("/", 0, sales), step("*", 1, hundred))
    )
    return maker_facts(spark, sf_dir).select(
        _id("a_").alias("answer_id"),
        _id("d_").alias("derivation_id"),
        F.lit(1).alias("position"),
        steps.alias("steps"),
        F.when(k % 4 == 3, F.lit(30.5)).otherwise(F.col("raw_share") * 100).alias("result"),
    )


def _recorded_answer() -> Column:
    k = F.col("k")
    return (
        F.when(k % 19 == 0, F.lit(None).cast("string"))
        .when(
            (k % 11 == 0) | (k % 17 == 0),
            F.lit("No matching data is AVAILABLE: not available yet for GLP-1 records."),
        )
        .otherwise(_answer_text())
    )


def _recorded_sql() -> Column:
    k = F.col("k")
    return (
        F.when(k % 5 == 0, F.lit(None).cast("string"))
        .when(k % 5 == 1, F.lit("SELECT sum(AMOUNT_USD) FROM Payments"))
        .otherwise(F.lit("SELECT manufacturer, sum(amount_usd) FROM payments GROUP BY 1"))
    )




def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return maker_facts(spark, sf_dir).select(
        _id("c_").alias("id"),
        F.concat(F.lit("How much did maker "), k.cast("string"), F.lit(" sell?")).alias("question"),
        F.struct(
            F.when(k % 7 != 0, F.col("sales").cast("double")).alias("value"),
            F.lit("USD").alias("unit"),
            F.when(k % 3 == 0, 0.005).otherwise(0.0).alias("tolerance"),
            F.when(k % 29 != 0, "payments").alias("expected_table"),
            F.array(F.lit("amount_usd"), F.lit("manufacturer")).alias("expected_columns"),
        ).alias("gold"),
        (k % 11 == 0).alias("expect_abstain"),
        F.lit("checked").alias("status"),
        F.when(k % 3 == 0, F.array(F.lit("SOLD")))
        .otherwise(F.array().cast("array<string>"))
        .alias("parts"),
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")

    def step(kind: str, tool: str | None, ok: bool, sql: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            F.struct(
                F.lit(tool).cast("string").alias("tool"),
                F.lit(ok).alias("ok"),
                F.lit(None).cast("string").alias("error"),
                F.struct(
                    sql.alias("sql"),
                    F.lit(1).cast("long").alias("row_count"),
                    F.lit(2.0).alias("execution_ms"),
                ).alias("data"),
            ).alias("detail"),
        )

    def call(n: int) -> Column:
        return F.struct(
            F.lit("model").alias("adapter"),
            (k % 100 + n).cast("long").alias("input_tokens"),
            (k % 10 + n).cast("long").alias("output_tokens"),
            ((k * 37 % 1000) / 4.0 + n).alias("latency_ms"),
            F.lit(200).alias("http_status"),
            F.lit(0).alias("retries"),
            F.lit(None).cast("string").alias("error"),
        )

    return (
        maker_facts(spark, sf_dir)
        .filter(k % 13 != 0)
        .select(
            _id("c_").alias("case_id"),
            F.lit("?").alias("question"),
            F.lit("model-1").alias("model_id"),
            F.lit("adapter").alias("adapter"),
            _recorded_answer().alias("answer_text"),
            (k % 4 != 0).alias("accepted"),
            F.array().cast("array<string>").alias("unverified"),
            F.lit(None).cast("string").alias("error"),
            (k % 100 * 2 + 3).cast("long").alias("input_tokens"),
            (k % 10 * 2 + 3).cast("long").alias("output_tokens"),
            F.array(
                step("plan", None, True, F.lit("SELECT planned FROM payments")),
                step("tool_call", "query_tool", False, F.lit("SELECT failed FROM payments")),
                step("tool_call", "forecast_tool", True, F.lit("SELECT other FROM payments")),
                step("tool_call", "query_tool", True, _recorded_sql()),
            ).alias("steps"),
            F.array(call(1), call(2)).alias("calls"),
        )
    )


def canary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded answers of one run per nation of the supplier."""
    k = F.col("k")
    home = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey")
    return maker_facts(spark, sf_dir).join(home, "k").select(
        F.col("s_nationkey").cast("long").alias("run_id"),
        _id("c_").alias("id"),
        _recorded_answer().alias("answer"),
        (k % 4 != 0).alias("accepted"),
        F.when(k % 8 == 1, F.array(F.lit("12%")))
        .otherwise(F.array().cast("array<string>"))
        .alias("unverified"),
        _recorded_sql().alias("sql"),
        F.array(F.lit("manufacturer")).alias("expected_columns"),
        F.when(k % 7 != 0, F.array(F.col("sales").cast("double"), F.col("n_lines").cast("double")))
        .otherwise(F.array().cast("array<double>"))
        .alias("gold_numbers"),
        F.when(k % 23 == 0, "timeout").alias("error"),
        ((k * 37 % 1000) / 4.0 - 20).alias("latency_ms"),
    )


# --- query log ----------------------------------------------------------------------------------

SQL_TEXTS = [
    "SELECT max(amount_usd) FROM payments",
    "SELECT quarter, avg(total_usd) FROM q_by_state GROUP BY quarter ORDER BY 2 LIMIT 7;",
    "\t ",
    "TRUNCATE q_totals",
    "SELECT 2; INSERT INTO payments VALUES (1)",
    "SELECT owner FROM information_schema_tables",
    "SELECT a.quarter FROM q_totals a JOIN q_by_state b ON a.quarter = b.quarter",
    "SELECT a.quarter FROM q_totals a join suppliers s ON true",
    "select payment_count from Q_BY_SPECIALTY limit 12",
    "WITH best AS (SELECT 3) SELECT * FROM best",
    "SELECT 40 + 2",
    "SELECT product FROM payments -- remarks are refused",
    "SELECT product /* here as well */ FROM payments",
    "SELECT merged, 'y' FROM payments WHERE remark = 'please merge'",
    "SELECT count(*) FILTER (WHERE quarter >= '1995Q1') FROM q_totals;;",
    "ALTER TABLE payments ADD COLUMN z INT",
    "SELECT dropped FROM q_by_specialty ; ",
    "SELECT product FROM payments WHERE manufacturer = 'one;two'",
    "DESCRIBE payments",
]


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per conversation turn: the turn's own words, or one of the fixed SQL texts."""
    at = F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(SQL_TEXTS) + 1))
    listed = F.array(*[F.lit(t) for t in SQL_TEXTS])
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.when(at == len(SQL_TEXTS), F.col("text"))
        .otherwise(F.get(listed, at.cast("int")))
        .alias("sql"),
    )


def fine_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as payments of many small groups, so that many short series have gaps."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    day = F.col("o_orderdate")
    group = F.concat_ws(
        " ", F.col("c_nationkey").cast("string"), F.col("c_mktsegment"), F.col("o_orderpriority")
    )
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string")).alias(
            "quarter"
        ),
        group.alias("physician_specialty"),
        F.col("o_totalprice").cast("decimal(14,2)").alias("amount_usd"),
    )
