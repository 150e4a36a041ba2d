"""Score stored answers against gold values, with three-valued results (NULL: cannot be told)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payscope.functions import numbers as N
from payscope.functions.text import contains_any, is_missing

# Phrases that say there is no data, in lower case.
ABSTENTION_PHRASES = ("no matching data", "no data available", "not available yet")


def is_abstention(answer: Column) -> Column:
    return contains_any(answer, ABSTENTION_PHRASES)


def scored_numbers(answer: Column) -> Column:
    """Every number of the answer, years and digits inside names included."""
    found = F.transform(N.all_numbers(answer, N.SCORED_NUMBER), N.stated_value)
    return F.filter(found, lambda v: v.isNotNull())


def correct(answer: Column, gold: Column) -> Column:
    """Does the answer state the gold value within its tolerance? NULL without a gold value."""
    target = gold["value"]
    stated_tolerance = F.abs(target) * F.coalesce(gold["tolerance"], F.lit(0.0))
    allowed = F.when(stated_tolerance > 0, stated_tolerance).otherwise(F.lit(1e-9))
    return (
        F.when(target.isNull(), F.lit(None).cast("boolean"))
        .when(is_missing(answer), F.lit(False))
        .otherwise(F.exists(scored_numbers(answer), lambda v: F.abs(v - target) <= allowed))
    )


def complete(answer: Column, gold: Column, parts: Column) -> Column:
    """Does the answer hold a number, when gold has one, and every named part of the question?

    NULL when there is neither a gold value nor a part to look for.
    """
    named = F.coalesce(parts, F.array().cast("array<string>"))
    has_value = F.coalesce(gold["value"].isNotNull(), F.lit(False))
    low = F.lower(answer)
    return (
        F.when(~has_value & (F.size(named) == 0), F.lit(None).cast("boolean"))
        .when(is_missing(answer), F.lit(False))
        .otherwise(
            (~has_value | (F.size(scored_numbers(answer)) > 0))
            & F.forall(named, lambda part: low.contains(F.lower(part)))
        )
    )


def executed_sql(steps: Column) -> Column:
    """The SQL of the first query step that succeeded and recorded its SQL."""
    ran = F.filter(
        steps,
        lambda s: (s["kind"] == "tool_call")
        & (s["detail"]["tool"] == "query_tool")
        & s["detail"]["ok"]
        & ~is_missing(s["detail"]["data"]["sql"]),
    )
    return F.get(ran, F.lit(0))["detail"]["data"]["sql"]


def retrieval_ok(sql: Column, gold: Column) -> Column:
    """Does the executed SQL name the expected table and columns? NULL when either is unknown."""
    low = F.lower(sql)
    columns = F.coalesce(gold["expected_columns"], F.array().cast("array<string>"))
    table = gold["expected_table"]
    names_all = low.contains(F.lower(table)) & F.forall(columns, lambda c: low.contains(F.lower(c)))
    return F.when(~is_missing(table) & sql.isNotNull(), names_all)


def score(cases: DataFrame, traces: DataFrame) -> DataFrame:
    """Every case with the scores of its stored trace; a case without one stays unknown.

    `passed` is (correct and retrieval_ok) or (abstained and expected to abstain), in the
    three-valued logic of SQL.
    """
    known = traces.select(
        F.col("case_id"),
        "answer_text",
        "accepted",
        "error",
        "input_tokens",
        "output_tokens",
        executed_sql(F.col("steps")).alias("executed_sql"),
        F.transform("calls", lambda c: F.coalesce(c["latency_ms"], F.lit(0.0))).alias("latencies"),
        F.lit(True).alias("_found"),
    )
    joined = cases.join(known, cases["id"] == known["case_id"], "left")
    answer, gold = F.col("answer_text"), F.col("gold")
    found = F.coalesce("_found", F.lit(False))
    expected = F.coalesce("expect_abstain", F.lit(False))
    none = F.lit(None).cast("boolean")
    scored = joined.select(
        "id",
        expected.alias("expect_abstain"),
        F.coalesce("accepted", F.lit(False)).alias("accepted"),
        F.when(found, F.col("error")).otherwise(F.lit("no trace")).alias("error"),
        F.coalesce("input_tokens", F.lit(0)).cast("long").alias("input_tokens"),
        F.coalesce("output_tokens", F.lit(0)).cast("long").alias("output_tokens"),
        F.coalesce(
            F.aggregate("latencies", F.lit(0.0), lambda total, ms: total + ms), F.lit(0.0)
        ).alias("latency_ms"),
        F.greatest(F.size("latencies"), F.lit(0)).cast("long").alias("calls"),
        F.when(found, correct(answer, gold)).otherwise(none).alias("correct"),
        F.when(found, complete(answer, gold, F.col("parts"))).otherwise(none).alias("complete"),
        F.when(found, retrieval_ok(F.col("executed_sql"), gold)).otherwise(none).alias(
            "retrieval_ok"
        ),
        is_abstention(answer).alias("abstained"),
        found.alias("_found"),
    )
    right = F.col("correct") & F.col("retrieval_ok")
    rightly_silent = F.col("abstained") & F.col("expect_abstain")
    return scored.withColumn(
        "passed", F.when(F.col("_found"), right | rightly_silent)
    ).drop("_found")


def summary(
    scores: DataFrame,
    input_price_per_1m: float | None = None,
    output_price_per_1m: float | None = None,
) -> DataFrame:
    """One row: passed, failed, not scored, total, and what the model calls took and cost."""
    cost = F.lit(None).cast("double")
    if input_price_per_1m is not None and output_price_per_1m is not None:
        cost = (
            F.coalesce(F.sum("input_tokens"), F.lit(0)) * F.lit(float(input_price_per_1m))
            + F.coalesce(F.sum("output_tokens"), F.lit(0)) * F.lit(float(output_price_per_1m))
        ) / F.lit(1_000_000.0)
    return scores.agg(
        F.count_if(F.col("passed")).alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.count_if(F.col("passed").isNull()).alias("not_scored"),
        F.count("*").alias("total"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("total_input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("total_output_tokens"),
        F.coalesce(F.sum("latency_ms"), F.lit(0.0)).alias("total_latency_ms"),
        cost.alias("total_cost_usd"),
    )


def call_rollup(traces: DataFrame) -> DataFrame:
    """Model calls, tokens and time of each trace, summed over its list of calls."""

    def over_calls(field: str, zero) -> Column:
        values = F.transform("calls", lambda c: F.coalesce(c[field], zero))
        return F.coalesce(F.aggregate(values, zero, lambda total, v: total + v), zero)

    return traces.select(
        "case_id",
        F.greatest(F.size("calls"), F.lit(0)).cast("long").alias("calls"),
        over_calls("input_tokens", F.lit(0).cast("long")).alias("input_tokens"),
        over_calls("output_tokens", F.lit(0).cast("long")).alias("output_tokens"),
        over_calls("latency_ms", F.lit(0.0)).alias("latency_ms"),
    )
