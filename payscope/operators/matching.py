"""Find the filing rows that mention a product, and project them to landed records.

The dictionary is part of the plan as literals, so the scan is one narrow stage: no join, no
shuffle, no Python. Rows without a match are dropped first, by one generated-code test over the
joined text of all ten fields; the per-field work runs on the few rows that are left.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payscope import schemas as S
from payscope.functions.calendar import quarter_of
from payscope.functions.text import WHITE_SPACE, blank_to_null, strip
from payscope.sources.dictionary import ProductDictionary

# A character that no term may hold, so that no term can match across two fields.
_BETWEEN_FIELDS = "\x01"

_FIELDS = [
    (slot, field)
    for slot, pair in zip(S.SLOTS, zip(S.NAME_FIELDS, S.CATEGORY_FIELDS))
    for field in pair
]


def _has_plain_terms(dictionary: ProductDictionary) -> bool:
    """Terms that a text contains exactly when its stripped form does."""
    return all(
        t and t == t.strip(WHITE_SPACE) and _BETWEEN_FIELDS not in t for t in dictionary.terms
    )


def mentions_any(dictionary: ProductDictionary) -> Column:
    """Does any of the ten product fields contain any term?"""
    if not _has_plain_terms(dictionary):
        return F.size(matches_column(dictionary)) > 0
    text = F.lower(F.concat_ws(_BETWEEN_FIELDS, *[F.col(field) for _, field in _FIELDS]))
    return text.rlike("|".join(re.escape(t) for t in dictionary.terms))


def matches_column(dictionary: ProductDictionary) -> Column:
    """One (slot, field, term) for each field that matches.

    The array is in canonical order: by slot, and the name field before the category field. A
    field counts once, with the first term in dictionary order that its stripped text contains.
    """
    terms = dictionary.terms
    if not terms:
        raise ValueError("the dictionary has no terms")
    listed = F.array(*[F.lit(t) for t in terms])
    cells = F.array(
        *[
            F.struct(
                F.lit(slot).alias("slot"),
                F.lit(field).alias("field"),
                F.lower(strip(F.col(field))).alias("text"),
            )
            for slot, field in _FIELDS
        ]
    )
    found = F.transform(
        cells,
        lambda cell: F.struct(
            cell["slot"].alias("slot"),
            cell["field"].alias("field"),
            F.when(
                cell["text"] != "",
                F.try_element_at(F.filter(listed, lambda t: cell["text"].contains(t)), F.lit(1)),
            ).alias("term"),
        ),
    )
    return F.filter(found, lambda m: m["term"].isNotNull())


def with_matches(filings: DataFrame, dictionary: ProductDictionary) -> DataFrame:
    """Relevant rows only, with their `matches`.

    The array comes out of a one-element explode. Conditions on it, or on what is derived from it,
    are not copied below that step, so each row is matched once whatever is asked later.
    """
    return filings.filter(mentions_any(dictionary)).select(
        "*", F.explode(F.array(matches_column(dictionary))).alias("matches")
    )


def slot_matches(filings: DataFrame, dictionary: ProductDictionary) -> DataFrame:
    """Audit form: one row for every field that matched (record_id, slot, field, term)."""
    return (
        with_matches(filings, dictionary)
        .select(F.col(S.RECORD_ID).alias("record_id"), F.explode("matches").alias("m"))
        .select("record_id", "m.slot", "m.field", "m.term")
    )


GRAM = 3  # characters of a term that the index holds


def text_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """For each different text the first term (by `place`) that it contains: (text, term).

    `texts` has text (lower case, stripped), `terms` has place and term; both may be large. A term is
    indexed by one of its runs of GRAM characters, the one that the fewest terms share (a shorter term by
    itself), and a text looks up its own runs: an equi-join, then the exact test. Only what shares a
    term's run is tested, and the plan is the same for any number of terms. Empty texts contain nothing.
    """
    def runs(of: Column, size: Column) -> Column:
        count = F.greatest(F.length(of) - size + 1, F.lit(0))
        return F.array_distinct(
            F.transform(
                F.filter(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda n: n <= count),
                lambda n: F.substring(of, n, size),
            )
        )

    size = F.least(F.length("term"), F.lit(GRAM))
    known = terms.filter(F.col("term").isNotNull()).groupBy("term").agg(F.min("place").alias("place"))
    spread = known.select("term", "place", F.explode(runs(F.col("term"), size)).alias("gram"))
    shared = spread.groupBy("gram").agg(F.count("*").alias("n"))
    index = (
        spread.join(shared, "gram")
        .groupBy("term", "place")
        .agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    )
    own = F.flatten(F.array(*[runs(F.col("text"), F.lit(n)) for n in range(1, GRAM + 1)], F.array(F.lit(""))))
    looked_up = texts.select("text").filter("text != ''").distinct().select("text", F.explode(own).alias("gram"))
    return (
        looked_up.join(index, "gram")
        .filter(F.col("text").contains(F.col("term")))
        .groupBy("text")
        .agg(F.min_by("term", "place").alias("term"))
    )


def slot_matches_by_terms(filings: DataFrame, terms: DataFrame) -> DataFrame:
    """`slot_matches` for a dictionary that is a table (place, term), of any size.

    Different texts are matched once and joined back; product names are few beside the rows that hold
    them. Small sides are broadcast by their size, and a text that very many rows hold is a skewed join,
    which Spark splits.
    """
    cells = F.array(
        *[
            F.struct(F.lit(slot).alias("slot"), F.lit(field).alias("field"), F.lower(strip(F.col(field))).alias("text"))
            for slot, field in _FIELDS
        ]
    )
    every = filings.select(F.col(S.RECORD_ID).alias("record_id"), F.inline(cells)).filter("text != ''")
    return every.join(text_terms(every, terms), "text").select("record_id", "slot", "field", "term")


def _generic(term: Column, dictionary: ProductDictionary) -> Column:
    pairs = [F.lit(text) for pair in dictionary.generic_of().items() for text in pair]
    return F.try_element_at(F.create_map(*pairs), term)


def land(
    filings: DataFrame, dictionary: ProductDictionary, dataset: Column, keep: Sequence[str] = ()
) -> DataFrame:
    """Filing rows to landed records: relevant rows, canonical match, derived quarter. Columns of the
    filings that are named in `keep` stay.

    The canonical match is that of the lowest slot, and the name field comes before the category
    field. Its product is the stripped name in that slot, or the term when the name is blank.
    """
    names = F.array(*[F.coalesce(strip(F.col(n)), F.lit("")) for n in S.NAME_FIELDS])
    first = F.get("matches", F.lit(0))
    matched = with_matches(filings, dictionary).select(
        "*",
        first.alias("_first"),
        F.element_at(names, first["slot"]).alias("_name"),
        F.size("matches").alias("_count"),
    )
    return matched.select(
        F.col(S.RECORD_ID).alias("record_id"),
        F.col(S.PROGRAM_YEAR).alias("program_year"),
        F.col(S.PAYMENT_DATE).alias("payment_date"),
        quarter_of(F.col(S.PAYMENT_DATE)).alias("quarter"),
        blank_to_null(F.col(S.RECIPIENT_NPI)).alias("physician_id"),
        blank_to_null(F.col(S.RECIPIENT_SPECIALTY)).alias("physician_specialty"),
        blank_to_null(F.col(S.RECIPIENT_STATE)).alias("physician_state"),
        F.col(S.PAYER).alias("manufacturer"),
        F.when(F.col("_name") != "", F.col("_name")).otherwise(F.col("_first.term")).alias("product"),
        _generic(F.col("_first.term"), dictionary).alias("product_generic"),
        F.col(S.NATURE).alias("nature_of_payment"),
        F.col(S.AMOUNT).alias("amount_usd"),
        F.col("_first.field").alias("matched_field"),
        F.col("_count").alias("matched_slot_count"),
        dataset.alias("source_year_dataset"),
        *keep,
    )
