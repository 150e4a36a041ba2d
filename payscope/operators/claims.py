"""Check every number stated in a text against the evidence that the text cites.

Giving stated numbers their markers is row-local and needs no shuffle (only `number_spans`, which
states character positions, puts the tokens of a text in order). A text is cut at its markers; each piece ends with the marker that may speak for the numbers in it. Only the short
rows (answer, number, cited id) are shuffled, to meet the evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payscope.functions import numbers as N
from payscope.functions.arithmetic import STEPS, recomputed

AS_WRITTEN = "as_written"
CLAIM_ONCE = "claim_once"
STRICT = "strict"


def number_spans(texts: DataFrame, key: str = "answer_id", text: str = "answer_text") -> DataFrame:
    """Numbers and markers with their character positions: (key, kind, raw, start, end).

    Digits inside a marker are part of the marker. Years are left out.
    """
    pieces = F.arrays_zip(
        F.split(text, N.FAST_TOKEN, -1).alias("gap"),
        N.all_numbers(F.col(text), N.FAST_TOKEN).alias("raw"),
    )
    worth_reading = texts.filter(F.col(text).rlike(N.HAS_DIGIT_OR_MARKER))
    tokens = worth_reading.select(key, F.posexplode(pieces).alias("pos", "piece")).select(
        key,
        "pos",
        F.length("piece.gap").alias("gap"),
        F.col("piece.raw").alias("raw"),
        F.coalesce(F.length("piece.raw"), F.lit(0)).alias("width"),
    )
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = tokens.withColumn("end", F.sum(F.col("gap") + F.col("width")).over(so_far))
    is_marker = F.col("raw").startswith("[")
    return placed.filter(
        F.col("raw").isNotNull() & (is_marker | ~N.is_year(F.col("raw")))
    ).select(
        key,
        F.when(is_marker, F.lit("marker")).otherwise(F.lit("number")).alias("kind"),
        "raw",
        (F.col("end") - F.col("width")).alias("start"),
        "end",
    )


def cited_numbers(
    answers: DataFrame, mode: str = AS_WRITTEN, key: str = "answer_id", text: str = "answer_text"
) -> DataFrame:
    """Every stated number with the id it cites, or NULL.

    A marker right after a number belongs to it. A marker that no number claims that way belongs
    to the only number since the marker before it; with none or several, it belongs to none.

    Modes differ in one case, a marker after white space:
    - `as_written`: its number gets it, and one lone other number before it gets it as well;
    - `claim_once`: its number gets it and no other does;
    - `strict`: (web variant) it counts as any later marker does.
    """
    if mode not in (AS_WRITTEN, CLAIM_ONCE, STRICT):
        raise ValueError(f"unknown mode {mode!r}")
    is_year = N.is_year_strict if mode == STRICT else N.is_year
    pieces = F.arrays_zip(
        F.split(text, r"\[[A-Za-z0-9_-]+\]", -1).alias("words"),
        F.regexp_extract_all(text, F.lit(N.MARKER), F.lit(1)).alias("marker"),
    )
    worth_reading = answers.filter(F.col(text).rlike(N.HAS_DIGIT))
    segments = worth_reading.select(key, F.posexplode(pieces).alias("segment", "piece")).select(
        key, "segment", F.col("piece.words").alias("words"), F.col("piece.marker").alias("marker")
    )
    counted = (
        segments.filter(F.col("words").rlike(N.HAS_DIGIT))
        .select(
            key,
            "segment",
            "marker",
            N.all_numbers(F.col("words"), N.FAST_NUMBER).alias("found"),
            F.element_at(F.split("words", N.FAST_NUMBER, -1), -1).alias("rest"),
        )
        .select(
            key,
            "segment",
            "marker",
            "rest",
            F.filter("found", lambda raw: ~is_year(raw)).alias("stated"),
            (~is_year(F.try_element_at("found", F.lit(-1)))).alias("last_counts"),
        )
    )
    touching = F.col("last_counts") & (F.col("rest") == "")
    adjacent = F.col("last_counts") & N.is_blank(F.col("rest"))
    count = F.size("stated")
    last = F.col("number") == count - 1
    if mode == AS_WRITTEN:
        owns = (
            F.when(adjacent & last, True)
            .when(touching, False)
            .when(adjacent, count == 2)
            .otherwise(count == 1)
        )
    elif mode == CLAIM_ONCE:
        owns = F.when(adjacent, last).otherwise(count == 1)
    else:
        owns = F.when(touching, last).otherwise(count == 1)
    raw = F.col("raw")
    return counted.select("*", F.posexplode("stated").alias("number", "raw")).select(
        key,
        "segment",
        "number",
        "raw",
        N.stated_value(raw).alias("value"),
        N.stated_decimals(raw).alias("decimals"),
        raw.endswith("%").alias("is_percent"),
        F.when(owns, F.col("marker")).alias("cited_id"),
    )


def _citable(
    evidence: DataFrame, derivations: DataFrame | None, strict: bool, key: str
) -> DataFrame:
    """One row per id that an answer may cite: evidence before derivations, later before earlier."""

    def candidates(frame: DataFrame, source_id: str, rank: int, payload: Column, result: Column, steps: Column):
        return frame.select(
            key,
            F.col(source_id).alias("source_id"),
            F.lit(rank).alias("rank"),
            F.col("position").cast("long").alias("position"),
            payload.cast("string").alias("payload"),
            result.cast("double").alias("result"),
            steps.cast(STEPS).alias("steps"),
        )

    nothing = F.lit(None)
    rows = candidates(evidence, "evidence_id", 1, F.col("payload"), nothing, nothing)
    if derivations is not None and not strict:
        rows = rows.unionByName(
            candidates(derivations, "derivation_id", 0, nothing, F.col("result"), F.col("steps"))
        )
    best = Window.partitionBy(key, "source_id").orderBy(
        F.col("rank").desc(), F.col("position").desc()
    )
    # Payloads and steps are read for the rows that win only.
    return (
        rows.withColumn("nth", F.row_number().over(best))
        .filter("nth = 1")
        .select(
            key,
            F.col("source_id").alias("cited_id"),
            "rank",
            "payload",
            "result",
            recomputed(F.col("steps")).alias("recomputed"),
        )
    )


ALWAYS = -(1 << 20)  # level of leaves and claims that meet in any case
REACH = 1000.0  # cells from zero that a claim can be away from it on its level, at most


def _probes(strict: bool) -> Column:
    """The cells in which a number that matches the claim can lie, as (level, cell).

    Cells of level L are 2^L wide. A claim looks on the level where a cell is at least as wide as its
    band, which then meets two cells at most. A percent looks for its number times and over 100 too.
    """
    claim = F.col("value")
    band = F.abs(claim) * (N.RELATIVE_TOLERANCE * 1.02) + 1e-300
    if not strict:  # also what rounds to the claim
        band = F.greatest(band, F.pow(F.lit(10.0), -F.col("decimals").cast("double")) * 0.51)

    def around(scale: float) -> Column:
        centre, half = claim * scale, band * scale
        level = F.ceil(F.log2(half * 2)).cast("int")
        width = F.pow(F.lit(2.0), level)
        ends = F.array_distinct(F.array(F.floor((centre - half) / width), F.floor((centre + half) / width)))
        return F.transform(ends, lambda cell: F.struct(level.alias("level"), cell.alias("cell")))

    in_any_case = F.array(F.struct(F.lit(ALWAYS).alias("level"), F.lit(0).cast("long").alias("cell")))
    scaled = F.concat(around(1.0), around(0.01), around(100.0))
    return F.concat(F.when(F.col("is_percent"), scaled).otherwise(around(1.0)), in_any_case)


def _in_evidence(stated: DataFrame, sources: DataFrame, strict: bool, key: str) -> DataFrame:
    """The different claims (key, cited_id, value, decimals, is_percent) that their evidence holds.

    Claims and leaves are rows, each different one once, and meet in an equi-join on cells of values,
    so an evidence with very many leaves is spread over its cells and no list of leaves is joined.
    """
    leaves = N.whole_number_leaves if strict else N.numeric_leaves
    claim = [key, "cited_id", "value", "decimals", "is_percent"]
    claims = stated.filter(F.col("cited_id").isNotNull() & F.col("value").isNotNull()).select(*claim).distinct()
    probes = claims.select(*claim, F.inline(_probes(strict)))
    levels = probes.groupBy(key, "cited_id").agg(F.collect_set("level").alias("levels"))
    held = (
        sources.filter("rank = 1")
        .select(key, "cited_id", F.explode(F.array_distinct(leaves(F.col("payload")))).alias("leaf"))
        .filter("leaf IS NOT NULL")
        .join(levels, [key, "cited_id"])
    )
    leaf = F.col("leaf")
    is_finite = F.abs(leaf) < float("inf")
    near = F.filter(
        "levels",
        lambda n: F.when(is_finite, (n > ALWAYS) & (F.abs(leaf) < F.pow(F.lit(2.0), n) * REACH)).otherwise(n == ALWAYS),
    )
    celled = held.select(key, "cited_id", "leaf", F.explode(near).alias("level")).withColumn(
        "cell",
        F.when(F.col("level") == ALWAYS, F.lit(0).cast("long")).otherwise(
            F.floor(leaf / F.pow(F.lit(2.0), F.greatest("level", F.lit(-1070))))
        ),
    )
    stated_value, decimals, percent = F.col("value"), F.col("decimals"), F.col("is_percent")

    def same(candidate: Column) -> Column:
        return N.close_strict(stated_value, candidate) if strict else N.close(stated_value, candidate, decimals)

    holds = same(leaf) | (percent & (same(leaf * 100) | same(leaf / 100)))
    return probes.join(celled, [key, "cited_id", "level", "cell"]).filter(holds).select(*claim).distinct()


def verdicts(
    answers: DataFrame,
    evidence: DataFrame,
    derivations: DataFrame | None = None,
    mode: str = AS_WRITTEN,
    key: str = "answer_id",
    text: str = "answer_text",
) -> DataFrame:
    """Every stated number with `passed` and a reason.

    `evidence` is (key, evidence_id, position, payload JSON) and `derivations` is (key,
    derivation_id, position, steps, result); both are scoped by answer.
    """
    strict = mode == STRICT
    stated = cited_numbers(answers, mode, key, text)
    sources = _citable(evidence, derivations, strict, key)
    found = _in_evidence(stated, sources, strict, key).withColumn("held", F.lit(True))
    joined = stated.join(sources.drop("payload"), [key, "cited_id"], "left").join(
        found, [key, "cited_id", "value", "decimals", "is_percent"], "left"
    )
    claim, decimals = F.col("value"), F.col("decimals")

    def same(candidate: Column) -> Column:
        if strict:
            return N.close_strict(claim, candidate)
        return N.close(claim, candidate, decimals)

    in_evidence = F.col("held")
    result, again = F.col("result"), F.col("recomputed")
    recomputes = F.abs(again - result) <= F.greatest(
        F.abs(result), F.lit(1e-9)
    ) * F.lit(N.DERIVATION_TOLERANCE)
    reason = (
        F.when(F.col("cited_id").isNull(), F.lit("no marker"))
        .when(F.col("rank").isNull(), F.lit("unknown id"))
        .when(
            F.col("rank") == 1,
            F.when(F.coalesce(in_evidence, F.lit(False)), F.lit("matches evidence")).otherwise(
                F.lit("not in evidence")
            ),
        )
        .when(again.isNull(), F.lit("derivation invalid"))
        .when(~F.coalesce(recomputes, F.lit(False)), F.lit("derivation recomputes differently"))
        .when(same(result), F.lit("matches derivation"))
        .otherwise(F.lit("derivation gives another number"))
    )
    return joined.select(
        key, "segment", "number", "raw", "value", "cited_id", reason.alias("reason")
    ).withColumn("passed", F.col("reason").isin("matches evidence", "matches derivation"))


def answer_verdicts(answers: DataFrame, numbers: DataFrame, key: str = "answer_id") -> DataFrame:
    """One row per answer: accepted when no number failed, and the failed numbers in text order.

    The list is no longer than the answer has numbers, so a group is bounded by one text.
    """
    failed = F.when(~F.col("passed"), F.struct("segment", "number", "raw"))
    per_answer = numbers.groupBy(key).agg(
        F.count("*").alias("n_numbers"),
        F.sort_array(F.collect_list(failed)).alias("failed"),
    )
    return answers.join(per_answer, key, "left").select(
        key,
        F.coalesce("n_numbers", F.lit(0)).cast("long").alias("n_numbers"),
        (F.coalesce(F.size("failed"), F.lit(0)) <= 0).alias("accepted"),
        F.coalesce(F.col("failed.raw"), F.array().cast("array<string>")).alias("unverified"),
    )
