"""Record shapes. Names are those of the public data set and of the reference tables."""

from __future__ import annotations

from pyspark.sql import types as T

SLOTS = (1, 2, 3, 4, 5)

# Column names of the yearly disclosure files.
NAME_FIELDS = [f"Name_of_Drug_or_Biological_or_Device_or_Medical_Supply_{n}" for n in SLOTS]
CATEGORY_FIELDS = [f"Product_Category_or_Therapeutic_Area_{n}" for n in SLOTS]
RECORD_ID = "Record_ID"
PROGRAM_YEAR = "Program_Year"
PAYMENT_DATE = "Date_of_Payment"
RECIPIENT_NPI = "Covered_Recipient_NPI"
RECIPIENT_SPECIALTY = "Covered_Recipient_Specialty_1"
RECIPIENT_STATE = "Recipient_State"
PAYER = "Applicable_Manufacturer_or_Applicable_GPO_Making_Payment_Name"
NATURE = "Nature_of_Payment_or_Transfer_of_Value"
AMOUNT = "Total_Amount_of_Payment_USDollars"

FILING_COLUMNS = [
    RECORD_ID,
    PROGRAM_YEAR,
    PAYMENT_DATE,
    RECIPIENT_NPI,
    RECIPIENT_SPECIALTY,
    RECIPIENT_STATE,
    PAYER,
    NATURE,
    AMOUNT,
    *NAME_FIELDS,
    *CATEGORY_FIELDS,
]

FILING = T.StructType([T.StructField(c, T.StringType()) for c in FILING_COLUMNS])


def _text(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


# A filing row that mentions a product, values as received.
LANDED = T.StructType(
    [
        *_text(
            "record_id",
            "program_year",
            "payment_date",
            "quarter",
            "physician_id",
            "physician_specialty",
            "physician_state",
            "manufacturer",
            "product",
            "product_generic",
            "nature_of_payment",
            "amount_usd",
            "matched_field",
        ),
        T.StructField("matched_slot_count", T.IntegerType()),
        *_text("source_year_dataset"),
    ]
)

AMOUNT_TYPE = T.DecimalType(14, 2)

# The typed table with one current row per record_id.
PAYMENT = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("program_year", T.IntegerType()),
        T.StructField("payment_date", T.DateType()),
        *_text(
            "quarter",
            "physician_id",
            "physician_specialty",
            "physician_state",
            "manufacturer",
            "product",
            "product_generic",
            "nature_of_payment",
        ),
        T.StructField("amount_usd", AMOUNT_TYPE),
        *_text("matched_field", "source_year_dataset"),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("year", T.IntegerType()),
        T.StructField("complete", T.BooleanType()),
        T.StructField("rows_scanned", T.LongType()),
        T.StructField("rows_matched", T.LongType()),
        T.StructField("matched_by_product", T.MapType(T.StringType(), T.LongType())),
        T.StructField("matched_by_manufacturer", T.MapType(T.StringType(), T.LongType())),
        T.StructField("non_manufacturer_of_record_share_pct", T.DoubleType()),
        *_text(
            "error",
            "program_year_dataset_identifier",
            "download_url",
            "dataset_modified",
            "pulled_at",
        ),
        T.StructField("bytes", T.LongType()),
        *_text("s3_bucket", "s3_key"),
        T.StructField("rows_upserted", T.LongType()),
    ]
)

# What the landing of a year leaves; the gates read `year` and `complete` of it as of any manifest.
YEAR_LANDED = T.StructType(
    [
        T.StructField("year", T.IntegerType()),
        T.StructField("complete", T.BooleanType()),
        T.StructField("run", T.LongType()),
        *[
            T.StructField(n, T.LongType())
            for n in ("rows_scanned", "rows_broken", "rows_matched", "rows_loadable", "rows_rejected")
        ],
        T.StructField("non_manufacturer_of_record_share_pct", T.DoubleType()),
        *_text("folder", "error"),
    ]
)

# `detail.args` and `answer` keep whatever JSON they hold as text.
TRACE_STEP = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField(
            "detail",
            T.StructType(
                [
                    T.StructField("tool", T.StringType()),
                    T.StructField("ok", T.BooleanType()),
                    T.StructField("error", T.StringType()),
                    T.StructField(
                        "data",
                        T.StructType(
                            [
                                T.StructField("sql", T.StringType()),
                                T.StructField("row_count", T.LongType()),
                                T.StructField("execution_ms", T.DoubleType()),
                            ]
                        ),
                    ),
                ]
            ),
        ),
    ]
)

TRACE_CALL = T.StructType(
    [
        T.StructField("adapter", T.StringType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("retries", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)

TRACE = T.StructType(
    [
        T.StructField("case_id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("model_id", T.StringType()),
        T.StructField("adapter", T.StringType()),
        T.StructField("answer_text", T.StringType()),
        T.StructField("accepted", T.BooleanType()),
        T.StructField("unverified", T.ArrayType(T.StringType())),
        T.StructField("error", T.StringType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("steps", T.ArrayType(TRACE_STEP)),
        T.StructField("calls", T.ArrayType(TRACE_CALL)),
    ]
)

GOLD = T.StructType(
    [
        T.StructField("value", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("tolerance", T.DoubleType()),
        T.StructField("expected_table", T.StringType()),
        T.StructField("expected_columns", T.ArrayType(T.StringType())),
    ]
)

CASE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("gold", GOLD),
        T.StructField("expect_abstain", T.BooleanType()),
        T.StructField("status", T.StringType()),
        T.StructField("parts", T.ArrayType(T.StringType())),
    ]
)
