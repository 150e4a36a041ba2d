"""Session settings and the shared scratch folder.

Operators never need these settings to be right; they are what we run tests and the bench with.
On a cluster the submitter owns the configuration.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, app: str = "payscope") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for tables that cut lineage, under the folder named in spark.checkpoint.dir.

    A cluster must name a shared folder there. Only a local-mode session that names none (tests)
    uses one of this machine, because there driver and executors are one process; such folders
    are deleted when the process ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or None
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        root = _own_root()
    return f"{root.rstrip('/')}/payscope-{purpose}-{uuid.uuid4().hex}"


_DROPS_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files behind: they go when the write has ended.

    Otherwise they stay until the driver's garbage collector meets the plan, which may be never. A plan
    that runs again shuffles again.
    """
    before = spark.conf.get(_DROPS_SHUFFLES, "false")
    spark.conf.set(_DROPS_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROPS_SHUFFLES, before)


@functools.cache
def _own_root() -> str:
    root = tempfile.mkdtemp(prefix="payscope-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def stored(rows: DataFrame, purpose: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder: computed once, lineage cut."""
    path = scratch_dir(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
