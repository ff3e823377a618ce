"""Small DataFrame helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def free_name(taken: DataFrame | list[str], wish: str) -> str:
    """``wish``, or with underscores appended until no column has that name (Spark compares without case)."""
    have = {c.lower() for c in (taken if isinstance(taken, list) else taken.columns)}
    while wish.lower() in have:
        wish += "_"
    return wish


#: Bytes of an Arrow batch between the JVM and a Python worker.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session was told to send Arrow batches of at most ``BATCH_BYTES``.

    The default, 64 MB for each task on both sides, is more than executors of a few GB can
    spare.  The setting is the session's, so later queries of the session have it too.  A setting of
    the user's stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not df.sparkSession.conf.get(key, None):
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def plain(df: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """``df`` with columns ``c0``, ``c1`` ... and the new names of the ``wanted`` ones.

    Operators work on that and name columns of their own with a leading underscore, so that no name of the
    input clashes with them; :func:`restored` puts the names back.
    """
    have = [c.lower() for c in df.columns]
    return df.toDF(*(f"c{i}" for i in range(len(have)))), [f"c{df.columns.index(c) if c in df.columns else have.index(c.lower())}" for c in wanted]


def restored(df: DataFrame, names: list[str], *more: Column) -> DataFrame:
    """The columns of :func:`plain` under their ``names``, and ``more``."""
    return df.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), *more)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local one does if the executors are threads of the driver; it is an error otherwise.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{tempfile.gettempdir()}/sonoquery-checkpoints"
    return found.rstrip("/")


#: Settings while an intermediate table is written.  Its shuffle files go when it stands, not when the driver
#: happens to collect garbage.  Files of compressed rows count as four times their bytes, so that the threshold of
#: broadcasts is held against about what the rows take in memory.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.sources.fileCompressionFactor": "4.0",
}

_written: ContextVar[list[DataFrame] | None] = ContextVar("written", default=None)


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """The settings ``wanted`` within the block; those that were set before stay."""
    new = [k for k in wanted if spark.conf.get(k, None) is None]
    for k in new:
        spark.conf.set(k, wanted[k])
    try:
        yield
    finally:
        for k in new:
            spark.conf.unset(k)


def cut(df: DataFrame, row_group: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: short lineage that survives lost executors.

    ``row_group``: bytes of a row group, for tables of large rows, as readers hold a row group's batch at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sonoquery-{uuid.uuid4().hex}"
    with _settings(spark, WRITING):
        (df.write.option("parquet.block.size", str(row_group)) if row_group else df.write).parquet(path)
    done = spark.read.schema(df.schema).parquet(path)
    if (written := _written.get()) is not None:
        written.append(done)
    return done


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables that :func:`cut` writes within the block; they are deleted at its end, but for those taken out of the list."""
    written: list[DataFrame] = []
    before = _written.set(written)
    try:
        yield written
    finally:
        _written.reset(before)
        for df in written:
            drop_cut(df)


def spread(df: DataFrame, salts: int, name: str = "salt") -> DataFrame:
    """``df`` once for each of the numbers 0 .. ``salts`` - 1 in the column ``name``, for joins to rows dealt by salt.

    Spark's size estimate counts these rows (it doesn't count those of ``explode``), so what is broadcast is within the threshold
    with its copies.
    """
    numbers = [free_name(df, f"_{name}{i}") for i in range(salts)]
    rows = df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(numbers)))
    of = free_name(df, f"_of_{name}")
    return rows.unpivot(df.columns, numbers, of, name).drop(of)


def drop_cut(df: DataFrame) -> None:
    """Delete what :func:`cut` wrote for ``df``, once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        if "/sonoquery-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def named(df: DataFrame, column: str):
    return F.col(quoted(column))
