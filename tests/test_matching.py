import pytest
from pyspark.sql import functions as F

from payscope import schemas as S
from payscope.operators import manifest, matching, typing
from payscope.sources.dictionary import GLP1, ProductDictionary

BASE = {
    S.RECORD_ID: "r",
    S.PROGRAM_YEAR: "2023",
    S.PAYMENT_DATE: "2023-04-15",
    S.PAYER: "Novo Nordisk",
    S.NATURE: "Consulting Fee",
    S.AMOUNT: "100.50",
}


def filings(spark, *rows):
    full = [{**dict.fromkeys(S.FILING_COLUMNS), **BASE, **r} for r in rows]
    return spark.createDataFrame([tuple(r[c] for c in S.FILING_COLUMNS) for r in full], S.FILING)


def name(n):
    return S.NAME_FIELDS[n - 1]


def category(n):
    return S.CATEGORY_FIELDS[n - 1]


def landed(spark, *rows, dictionary=GLP1):
    return matching.land(filings(spark, *rows), dictionary, F.lit("set"))


def four(spark):
    return filings(
        spark,
        {S.RECORD_ID: "1", S.RECIPIENT_SPECIALTY: "Endocrinology", name(1): "Ozempic"},
        {S.RECORD_ID: "2", S.PAYMENT_DATE: "2023-07-01", S.PAYER: "Eli Lilly", name(1): "Mounjaro"},
        {S.RECORD_ID: "3", S.PAYMENT_DATE: "01/10/2023", S.PAYER: "Acme Distributors", name(1): "Wegovy"},
        {S.RECORD_ID: "4", S.PAYER: "AbbVie", name(1): "Humira"},
    )


def test_four_rows(spark):
    rows = matching.land(four(spark), GLP1, F.lit("set")).orderBy("record_id").collect()
    assert [(r.record_id, r.quarter, r.product_generic) for r in rows] == [
        ("1", "2023Q2", "semaglutide"),
        ("2", "2023Q3", "tirzepatide"),
        ("3", "2023Q1", "semaglutide"),
    ]
    assert rows[1].physician_specialty is None and rows[0].physician_specialty == "Endocrinology"


def test_manifest_of_four_rows(spark):
    row = manifest.manifest_rows(four(spark), GLP1).first()
    assert (row.rows_scanned, row.rows_matched) == (4, 3)
    assert row.non_manufacturer_of_record_share_pct == 33.33
    share = manifest.other_payer_share(matching.land(four(spark), GLP1, F.lit("s")), GLP1).first()
    assert share.other_share_pct == 33.33 and share.over_threshold


def test_no_match_gives_zero_share(spark):
    row = manifest.manifest_rows(filings(spark, {name(1): "Humira"}), GLP1).first()
    assert (row.rows_matched, row.non_manufacturer_of_record_share_pct) == (0, 0.0)


@pytest.mark.parametrize("brand,generic", GLP1.brand_to_generic.items())
def test_brands_resolve(spark, brand, generic):
    assert landed(spark, {name(1): brand}).first().product_generic == generic


def test_case_category_and_slots(spark):
    row = landed(spark, {name(3): "  SEMAGLUTIDE Injection "}).first()
    assert (row.product, row.matched_field) == ("SEMAGLUTIDE Injection", name(3))
    row = landed(spark, {category(2): "about tirzepatide"}).first()
    assert (row.product, row.product_generic, row.matched_field) == (
        "tirzepatide",
        "tirzepatide",
        category(2),
    )
    row = landed(spark, {name(4): "Wegovy", category(2): "Ozempic use", name(2): "other"}).first()
    assert (row.product, row.matched_field, row.matched_slot_count) == ("other", category(2), 2)
    row = landed(spark, {name(1): "Zepbound", category(1): "Zepbound"}).first()
    assert (row.matched_field, row.matched_slot_count) == (name(1), 2)


def test_no_false_hits(spark):
    assert landed(spark, {name(1): "Humira (adalimumab)"}, {name(1): "Ozem", name(2): "pic"}).count() == 0


def test_dictionary_order_wins_in_a_field(spark):
    found = matching.slot_matches(filings(spark, {name(1): "Wegovy or Ozempic, semaglutide"}), GLP1)
    assert [tuple(r)[1:] for r in found.collect()] == [(1, name(1), "semaglutide")]


def test_terms_with_blanks_at_their_ends(spark):
    words = ProductDictionary([" pad"], ["pen "], {"pen ": "x"})
    rows = landed(
        spark,
        {S.RECORD_ID: "a", name(1): " pad"},
        {S.RECORD_ID: "b", name(1): "pen "},
        {S.RECORD_ID: "c", name(1): "one pad"},
        {S.RECORD_ID: "d", name(1): "pen one"},
        dictionary=words,
    )
    assert sorted(r.record_id for r in rows.collect()) == ["c", "d"]


LANDED = {
    "record_id": "r1",
    "program_year": "2023",
    "payment_date": "04/15/2023",
    "quarter": "2023Q2",
    "manufacturer": "Novo Nordisk",
    "product": "Ozempic",
    "amount_usd": "100.505",
    "matched_field": name(1),
    "source_year_dataset": "set",
}


def landed_rows(spark, *changes):
    rows = [{**dict.fromkeys(S.LANDED.names), **LANDED, **c} for c in changes]
    return spark.createDataFrame([tuple(r[c] for c in S.LANDED.names) for r in rows], S.LANDED)


def test_typed_values(spark):
    row = typing.good_rows(landed_rows(spark, {"physician_state": ""})).first()
    assert str(row.payment_date) == "2023-04-15" and str(row.amount_usd) == "100.51"
    assert row.physician_state is None and row.program_year == 2023


@pytest.mark.parametrize(
    "change,reason",
    [
        ({"record_id": ""}, "row without record_id"),
        ({"record_id": None}, "row without record_id"),
        ({"program_year": "20x3"}, "record r1: program_year is not an integer"),
        ({"program_year": None}, "record r1: program_year is missing"),
        ({"amount_usd": "not-a-number"}, "record r1: amount_usd is not numeric"),
        ({"amount_usd": "NaN"}, "record r1: amount_usd is not numeric"),
        ({"amount_usd": ""}, "record r1: amount_usd is missing"),
        ({"amount_usd": "1e30"}, "record r1: amount_usd is out of range"),
        ({"manufacturer": ""}, "record r1: manufacturer is missing"),
        ({"product": None}, "record r1: product is missing"),
        ({"source_year_dataset": None}, "record r1: source_year_dataset is missing"),
    ],
)
def test_rejects(spark, change, reason):
    rows = landed_rows(spark, change)
    assert typing.good_rows(rows).count() == 0
    assert [r.reject_reason for r in typing.rejected_rows(rows).collect()] == [reason]
    assert typing.typed(rows).first().reject_reason == reason


def test_unreadable_date_stays(spark):
    row = typing.good_rows(landed_rows(spark, {"payment_date": "not-a-date", "quarter": None})).first()
    assert row.payment_date is None and row.quarter is None
    assert typing.quarter_mismatches(typing.good_rows(landed_rows(spark, {"quarter": "2023Q3"}))).count() == 1


def test_load_stats(spark):
    stats = typing.load_stats(landed_rows(spark, {}, {"amount_usd": "x"}, {"program_year": "2024"}))
    assert {r.program_year: tuple(r)[1:] for r in stats.collect()} == {2023: (2, 1, 1), 2024: (1, 1, 0)}


def matched_by_hand(rows, terms):
    """(record_id, slot, field, term) by trying every term on every field."""
    found = []
    for r in rows:
        for slot in S.SLOTS:
            for field in (name(slot), category(slot)):
                text = (r.get(field) or "").strip().lower()
                hits = [t for t in terms if text and t in text]
                found += [(r[S.RECORD_ID], slot, field, hits[0])] if hits else []
    return sorted(found)


def test_dictionary_as_a_table(spark):
    terms = ["ozempic", "zem", "xi", "q", "wegovy pen", "aaaa", "zzzz none", "é!"]
    rows = [
        {S.RECORD_ID: "1", name(1): " OZEMPIC pen ", category(1): "Taxis", name(2): "aaa", category(5): "xaaaax"},
        {S.RECORD_ID: "1", name(3): "Zemex"},
        {S.RECORD_ID: "2", name(1): "Wegovy  pen", name(2): "wegovy pen", name(5): "caFÉ!q", category(2): "  "},
        {S.RECORD_ID: "3", name(1): "none of them", name(2): None, category(3): ""},
    ]
    for listed in (terms, terms[::-1], [*terms, ""], ["zem", *terms]):
        table = spark.createDataFrame(list(enumerate(listed)), "place int, term string")
        got = matching.slot_matches_by_terms(filings(spark, *rows), table).collect()
        assert sorted(map(tuple, got)) == matched_by_hand(rows, listed)
    nothing = spark.createDataFrame([], "place int, term string")
    assert matching.slot_matches_by_terms(filings(spark, *rows), nothing).collect() == []


def test_dictionary_of_a_hundred_thousand_terms(spark):
    n = 100_000
    table = spark.range(n).select(F.col("id").alias("place"), F.concat(F.lit("drug "), F.hex(F.col("id") * 7919), F.lit("x")).alias("term"))
    small = spark.range(3).select(F.col("id").alias("place"), F.lit("drug").alias("term"))
    rows = [{S.RECORD_ID: str(k), name(1): f"Drug {k * 7919:X}X forte", name(2): f"Drug {k * 7919 + 1:X}X"} for k in (0, 5, 99_999)]
    frame = matching.slot_matches_by_terms(filings(spark, *rows), table.withColumn("term", F.lower("term")))
    got = sorted((r.record_id, r.slot, r.term) for r in frame.collect())
    assert got == [(str(k), 1, f"drug {k * 7919:x}x") for k in (0, 5, 99_999)]
    plans = [f._jdf.queryExecution().optimizedPlan().toString() for f in (
        frame, matching.slot_matches_by_terms(filings(spark, *rows), small.withColumn("term", F.lower("term"))))]
    assert len(plans[0]) < 2 * len(plans[1]) and "drug 7919" not in plans[0]
