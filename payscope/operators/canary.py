"""Score recorded answers of a live system against gold queries, and roll runs up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payscope.functions import numbers as N
from payscope.functions.text import is_missing
from payscope.operators.scoring import is_abstention
from payscope.session import stored


SPLIT = 4096  # even parts of a bucket of latencies


def stated_numbers(answer: Column) -> Column:
    """Numbers that stand alone: none glued to a letter, digit or hyphen, and no bare years."""
    found = N.all_numbers(F.coalesce(answer, F.lit("")), N.CANARY_NUMBER)
    claims = F.filter(
        F.transform(found, lambda raw: F.replace(raw, F.lit(","))),
        lambda bare: ~bare.rlike(r"^(?:19|20)\d\d$"),
    )
    return F.transform(claims, lambda bare: bare.try_cast("double"))


def gold_numbers(gold: DataFrame, key: str) -> DataFrame:
    """Every non-NULL numeric cell of each gold row, in column order: (key, gold_numbers)."""
    numeric = [
        f.name
        for f in gold.schema
        if isinstance(f.dataType, T.NumericType) and f.name != key
    ]
    cells = F.array(*[F.col(c).cast("double") for c in numeric])
    return gold.select(key, F.array_compact(cells).alias("gold_numbers"))


def score_rows(rows: DataFrame) -> DataFrame:
    """Adds cited, abstained, correct, retrieval_ok and status to each recorded answer.

    Reads answer, accepted, unverified, sql, expected_columns, gold_numbers and error. Without
    gold numbers the right answer is to abstain. With them every stated number must be within
    half a percent of some gold number, at least one must be stated, and all must be cited.
    """
    answer = F.coalesce("answer", F.lit(""))
    gold = F.coalesce("gold_numbers", F.array().cast("array<double>"))
    failed = ~is_missing(F.col("error"))
    cited = F.coalesce("accepted", F.lit(False)) & (
        F.coalesce(F.size("unverified"), F.lit(0)) <= 0
    )
    has_gold = F.size(gold) > 0

    def near_gold(n: Column) -> Column:
        return F.exists(gold, lambda g: F.abs(n - g) <= F.abs(g) * N.RELATIVE_TOLERANCE + 1e-9)

    numbers = F.col("_numbers")
    low = F.lower(F.col("sql"))
    scored = (
        rows.withColumn("_numbers", stated_numbers(F.col("answer")))
        .withColumn("abstained", ~failed & is_abstention(answer))
        .withColumn("cited", F.when(~failed & has_gold, cited))
        .withColumn(
            "correct",
            F.when(failed, False)
            .when(~has_gold, F.col("abstained"))
            .otherwise((F.size(numbers) > 0) & F.forall(numbers, near_gold) & cited),
        )
        .withColumn(
            "retrieval_ok",
            F.when(
                ~is_missing(F.col("sql")),
                F.forall(
                    F.coalesce("expected_columns", F.array().cast("array<string>")),
                    lambda c: low.contains(F.lower(c)),
                ),
            ),
        )
    )
    status = (
        F.when(failed, F.lit("ERR")).when(F.col("correct"), F.lit("OK")).otherwise(F.lit("MISS"))
    )
    return scored.withColumn("status", status).drop("_numbers")


def _holding_place(cells: DataFrame, run: str, by: str) -> DataFrame:
    """The one cell per run and target that holds the wanted place, counting in order of `by`.

    Reads (run, which, place, `by`, n). The place that is returned counts from that cell's start.
    """
    so_far = (
        Window.partitionBy(run, "which").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    )
    start = F.col("_upto") - F.col("n")
    return (
        cells.withColumn("_upto", F.sum("n").over(so_far))
        .filter((F.col("place") >= start) & (F.col("place") < F.col("_upto")))
        .select(run, "which", by, (F.col("place") - start).alias("place"))
    )


def latency_percentiles(rows: DataFrame, run: str, latency: str = "latency_ms") -> DataFrame:
    """Exact p50 and p95 of each run: the values at fixed places of the sorted latencies.

    p50 is at place n div 2 and p95 at place round(0.95 n - 0.5), halves to even, both from 0 and
    p95 no further than n - 1.

    No run is sorted as one group. Equal latencies are counted first and the counts stored, so the
    rows are read once. The place is then looked for in ever finer buckets: those of a scale that
    is logarithmic on both sides of zero (at most some 1,400,000 for any double), then `SPLIT`
    even parts of the bucket that holds the place, and again of that part. Only the values of the
    last part are put in order.
    """
    value = F.col(latency).cast("double")
    coarse = F.signum("v") * F.log1p(F.abs("v")) * 1e3
    counts = stored(
        rows.filter(value.isNotNull())
        .groupBy(run, value.alias("v"))
        .agg(F.count("*").alias("n"))
        .withColumn("cell", F.floor(coarse)),
        "latencies",
    )
    buckets = counts.groupBy(run, "cell").agg(F.sum("n").alias("n"))
    total = F.col("total")
    place95 = F.least(total - 1, F.bround(total * 0.95 - 0.5).cast("long"))
    targets = buckets.groupBy(run).agg(F.sum("n").alias("total")).select(
        run,
        F.inline(
            F.array(
                F.struct(F.lit("p50").alias("which"), F.floor(total / 2).alias("place")),
                F.struct(
                    F.lit("p95").alias("which"),
                    F.greatest(place95, F.lit(0).cast("long")).alias("place"),
                ),
            )
        ),
    )
    found = _holding_place(buckets.join(targets, run), run, "cell")
    inside = counts.join(found, [run, "cell"]).select(run, "which", "place", "v", "n")
    for _ in range(2):
        inside = _narrowed(inside, run)
    hits = _holding_place(inside, run, "v")
    return hits.groupBy(run).agg(
        F.max(F.when(F.col("which") == "p50", F.col("v"))).alias("p50_ms"),
        F.max(F.when(F.col("which") == "p95", F.col("v"))).alias("p95_ms"),
    )


def _narrowed(inside: DataFrame, run: str) -> DataFrame:
    """Of the values (run, which, place, v, n), those in the even part that holds the place."""
    ends = inside.groupBy(run, "which").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    width = F.col("high") - F.col("low")
    part = F.when(width > 0, F.floor((F.col("v") - F.col("low")) / width * SPLIT)).otherwise(F.lit(0))
    parts = inside.join(ends, [run, "which"]).withColumn("cell", part.cast("long")).drop("low", "high")
    sums = parts.groupBy(run, "which", "place", "cell").agg(F.sum("n").alias("n"))
    found = _holding_place(sums, run, "cell")
    return parts.drop("place").join(found, [run, "which", "cell"]).drop("cell")


def rollup(scored: DataFrame, run: str, recorded: float = 8.0, tolerance: float = 0.0) -> DataFrame:
    """One record per run: rows, correct rows, errors, and whether the count is as recorded."""
    observed = F.count_if(F.col("correct"))
    return scored.groupBy(run).agg(
        F.count("*").alias("n"),
        observed.cast("double").alias("observed"),
        F.lit(float(recorded)).alias("recorded"),
        F.count_if(F.col("status") == "ERR").alias("errors"),
        (F.abs(observed.cast("double") - F.lit(float(recorded))) <= tolerance).alias("match"),
    )


def run_record(
    scored: DataFrame, run: str, latency: str = "latency_ms", recorded: float = 8.0, tolerance: float = 0.0
) -> DataFrame:
    """The record of each run: `rollup` with p50, p95 and sum of the latencies."""
    took = scored.groupBy(run).agg(F.sum(F.col(latency).cast("double")).alias("duration_ms"))
    percentiles = latency_percentiles(scored, run, latency)
    return rollup(scored, run, recorded, tolerance).join(took, run).join(percentiles, run, "left")


def run_details(scored: DataFrame, run: str, row_id: str = "id", latency: str = "latency_ms") -> DataFrame:
    """What a run's record says of each of its rows; latencies in whole milliseconds, halves to even.

    They are rows beside the record, stored by `append_ledger` in a folder of their own, so a run of any
    number of rows needs no list in one record. A blank error is none.
    """
    return scored.select(
        run,
        row_id,
        "cited",
        "retrieval_ok",
        "abstained",
        F.bround(F.col(latency).cast("double")).cast("long").alias(latency),
        F.when(~is_missing(F.col("error")), F.col("error")).alias("error"),
    )


def report_lines(scored: DataFrame, row_id: str = "id") -> DataFrame:
    return scored.select(row_id, F.concat_ws(" ", F.col(row_id), "status").alias("line"))


def id_cover(canary: DataFrame, cases: DataFrame, key: str = "id") -> DataFrame:
    """Ids on one side only; empty when the canary covers the cases exactly."""
    left = canary.select(F.col(key).alias("canary_id")).distinct()
    right = cases.select(F.col(key).alias("case_id")).distinct()
    return left.join(right, left["canary_id"] == right["case_id"], "full_outer").filter(
        F.col("canary_id").isNull() | F.col("case_id").isNull()
    ).select(
        F.coalesce("canary_id", "case_id").alias("id"),
        F.when(F.col("case_id").isNull(), F.lit("canary only"))
        .otherwise(F.lit("cases only"))
        .alias("side"),
    )


def latest_record(ledger: DataFrame, by: Sequence[str], ts: str = "ts") -> DataFrame:
    """The newest record of each system; combined before the shuffle."""
    rest = [c for c in ledger.columns if c not in by]
    newest = ledger.groupBy(*by).agg(F.max_by(F.struct(*rest), ts).alias("r"))
    return newest.select(*by, "r.*")


def append_ledger(records: DataFrame, path: str) -> None:
    records.write.mode("append").parquet(path)
