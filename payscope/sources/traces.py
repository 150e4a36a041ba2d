"""Stored traces of answered questions, and cases with their gold values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payscope import schemas as S


def read_traces(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """Traces as JSON: one per line, or one document per file named after its case.

    Many small files cost more than their rows; write large sets by `write_traces`.
    """
    rows = spark.read.schema(S.TRACE).json(path, multiLine=one_per_file)
    if not one_per_file:
        return rows
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return rows.withColumn("case_id", F.coalesce("case_id", F.url_decode(name)))


def write_traces(traces: DataFrame, path: str) -> None:
    traces.write.mode("overwrite").json(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.CASE).json(path, multiLine=True)
