"""Stored objects by path and size; small files that appear whole."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of stored Parquet files that are as large as the tables.
CODEC = "zstd"


def stored_sizes(spark: SparkSession, path: str, key_depth: int = 1) -> DataFrame:
    """(key, stored_bytes) of every file below `path`; the contents are not read.

    The key is the last `key_depth` parts of the file's path.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(
        F.substring_index("path", "/", -key_depth).alias("key"),
        F.col("length").alias("stored_bytes"),
    )


def file_at(spark: SparkSession, path: str):
    """The file system of a path and the path in its form."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()), made


def put_text(spark: SparkSession, folder: str, name: str, text: str, replace: bool) -> None:
    """A complete file takes its name in the folder, over one of that name or only where there is none.

    Raises FileExistsError where there is one that must stay; then nothing has changed.
    """
    jvm = spark._jvm
    fs, draft = file_at(spark, f"{folder.rstrip('/')}/.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    _, path = file_at(spark, f"{folder.rstrip('/')}/{name}")
    kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kinds, 1)
    how[0] = kinds.OVERWRITE if replace else kinds.NONE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        files.rename(fs.makeQualified(draft), fs.makeQualified(path), how)
    except Py4JJavaError as error:
        fs.delete(draft, False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            raise FileExistsError(name) from error
        raise
