"""Screen a log of SQL texts against the read-only query surface.

This is a filter over a table of texts, with the reason why a text is refused and the text as it
would run. It is a keyword screen; access rights of the database are what protects the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payscope.functions.text import strip

# The surface and the rules of the screen.
ALLOWED_TABLES = ["payments", "q_totals", "q_by_specialty", "q_by_state"]
WRITE_WORDS = [
    "INSERT",
    "UPDATE",
    "DELETE",
    "DROP",
    "ALTER",
    "TRUNCATE",
    "GRANT",
    "REVOKE",
    "CREATE",
    "CALL",
    "EXECUTE",
    "COPY",
    "MERGE",
]
ROW_CAP = 5000

_WORD = r"(?i)\b(?:" + "|".join(WRITE_WORDS) + r")\b"
_TARGET = r"(?i)\b(?:FROM|JOIN)\s+([A-Za-z_][A-Za-z0-9_]*)"


def screen(queries: DataFrame, sql: str = "sql", row_cap: int = ROW_CAP) -> DataFrame:
    """Adds `accepted`, `reason` (NULL when accepted) and `normalized` (NULL when refused).

    Common table expressions are refused, as is any comment. One `;` at the end is dropped. A
    text without LIMIT gets `row_cap`.
    """
    text = strip(F.coalesce(F.col(sql), F.lit("")))
    body = F.when(F.col("_text").endswith(";"), strip(F.expr("left(_text, length(_text) - 1)")))
    targets = F.transform(F.regexp_extract_all("_body", F.lit(_TARGET), F.lit(1)), F.lower)
    refused = F.array_except("_targets", F.array(*[F.lit(t) for t in ALLOWED_TABLES]))
    first_refused = F.get(
        F.filter("_targets", lambda t: F.array_contains(F.col("_refused"), t)), F.lit(0)
    )
    body_column = F.col("_body")
    reason = (
        F.when(F.col("_text") == "", F.lit("empty query"))
        .when(body_column.contains(";"), F.lit("multiple statements"))
        .when(~body_column.rlike(r"(?i)^SELECT\b"), F.lit("not a single SELECT"))
        .when(body_column.rlike(_WORD), F.lit("write keyword"))
        .when(body_column.contains("--") | body_column.contains("/*"), F.lit("comment"))
        .when(F.size("_targets") == 0, F.lit("no FROM clause"))
        .when(
            F.size("_refused") > 0,
            F.concat(F.lit("table not allowed: "), first_refused),
        )
    )
    capped = F.when(body_column.rlike(r"(?i)\bLIMIT\s+\d+"), body_column).otherwise(
        F.concat(body_column, F.lit(f" LIMIT {row_cap}"))
    )
    return (
        queries.withColumn("_text", text)
        .withColumn("_body", F.coalesce(body, F.col("_text")))
        .withColumn("_targets", targets)
        .withColumn("_refused", refused)
        .withColumn("reason", reason)
        .withColumn("accepted", F.col("reason").isNull())
        .withColumn("normalized", F.when(F.col("reason").isNull(), capped))
        .drop("_text", "_body", "_targets", "_refused")
    )
