"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings the results depend on. All can be changed on a running session.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    # objects with a repeated key are legal JSON: the last value counts
    "spark.sql.variant.allowDuplicateKeys": "true",
    # rows may be blocks of several MB: a batch for Python is bounded by its bytes too
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}

# Spark deletes the shuffle files of a query at its end.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "fieldloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on. Partition counts are left to the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # no Python call sites for every column: they cost more than the column itself
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **REQUIRED,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the required settings to a session made elsewhere."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only where none is set, as on a laptop, a folder of this process is used.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is not None:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    global _LOCAL_DIR
    if _LOCAL_DIR is None:
        _LOCAL_DIR = tempfile.mkdtemp(prefix="fieldloom-")
    return _LOCAL_DIR


_LOCAL_DIR: str | None = None
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and the path for it."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def delete(spark: SparkSession, path: str) -> None:
    fs, there = file_system(spark, path)
    fs.delete(there, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialise`` writes inside are deleted at the end, also after an error.

    What is to outlive the block has to be written elsewhere in it: a table that is still lazy would miss its files.
    Scopes may be nested; a job that ends without one leaves its tables to the owner of the shared folder.
    """
    held: list[str] = []
    token = _WRITTEN.set(held)
    try:
        yield
    finally:
        _WRITTEN.reset(token)
        for path in held:
            delete(spark, path)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a written table.

    A lost executor costs nothing but a re-read, and unlike a checkpoint the
    table has a known size, so the planner can choose the join by it. Only the
    table is read again, so the shuffle files of its query go when it is written.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/fieldloom/{uuid.uuid4().hex}"
    held = _WRITTEN.get()
    if held is not None:
        held.append(path)
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)
