"""Stored tables: line items by month, and intermediate tables that several steps read."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.filters import date_range
from .losses import written_rows

MONTH = "order_month"
SEGMENT = "RFM_Segment"

# Of the codecs of Parquet that Spark brings along, the one that takes the fewest bytes.
SMALL = "zstd"

_FACTOR = "spark.sql.sources.fileCompressionFactor"
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_line_items(lines: DataFrame, path: str, losses: Observation | None = None) -> None:
    """Write the line-item table by order month; months that ``lines`` has no row of stay.

    Months are cut in UTC, whatever the session's zone. The rebalance hint lets Spark split
    months that are too large for one task and merge the small ones. ``losses`` count the rows, those
    without a date and those without a product.
    """
    if losses is not None:
        nulls = {"without_date": "order_date", "without_product": "product_sku"}
        lines = written_rows(lines, losses, **nulls)
    write_by(lines.withColumn(MONTH, month_of(lines, "order_date")), MONTH, path)


def write_by(df: DataFrame, column: str, path: str, codec: str | None = None) -> None:
    """Write ``df`` by the values of a column; stored values that it has no row of stay."""
    write_parts(df.hint("rebalance", column), column, path, codec)


def write_parts(df: DataFrame, column: str, path: str, codec: str | None = None) -> None:
    """``write_by`` with the rows in the tasks they are in, for rows that are dealt already."""
    writer = df.write.mode("overwrite")
    if codec is not None:
        writer = writer.option("compression", codec)
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def month_of(df: DataFrame, name: str) -> Column:
    """The first day of a time's month, in UTC."""
    clock = F.col(name)
    if isinstance(df.schema[name].dataType, T.TimestampType):
        clock = F.convert_timezone(F.current_timezone(), F.lit("UTC"), clock.cast("timestamp_ntz"))
    return F.to_date(F.date_trunc("month", clock))


def read_line_items(
    spark: SparkSession, path: str, start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    """The stored line items; a date range prunes months first, then rows.

    A day of the session's zone lies within a day of the same date in UTC, so the pruned range
    is one day wider on both sides.
    """
    lines = spark.read.parquet(path)
    if start is not None and end is not None and start <= end:
        day = dt.timedelta(days=1)
        first, last = (start - day).replace(day=1), end + day
        lines = lines.where(F.col(MONTH).between(F.lit(first), F.lit(last)))
    return date_range(lines, "order_date", start, end).drop(MONTH)


def write_rfm(customers: DataFrame, path: str) -> None:
    """Write the customers with their scores by segment, as one refresh of the whole table."""
    rows = customers.hint("rebalance", SEGMENT)
    rows.write.mode("overwrite").partitionBy(SEGMENT).parquet(path)


def read_rfm(spark: SparkSession, path: str, segment: str | None = None) -> DataFrame:
    """The stored customers, all or of one segment, of which alone the files are read."""
    rows = spark.read.parquet(path)
    return rows if segment is None else rows.where(F.col(SEGMENT) == segment)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a checkpoint: a file in the folder of ``spark.checkpoint.dir``.

    It outlives lost executors, and Spark's cleaner removes it when the frame is no longer
    used (``spark.cleaner.referenceTracking.cleanCheckpoints``). A session of one machine that
    has no such folder gets one; on a cluster it has to be set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint().alias(name)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold within it."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def shuffles_freed(spark: SparkSession) -> AbstractContextManager[None]:
    """Within it, the shuffle files of a query go when it ends, not when the driver next collects its
    garbage; so steps that are stored one after another do not keep those of all steps at once."""
    return settings(spark, {_FREED: "true"})


def rows_weighed(spark: SparkSession) -> AbstractContextManager[None]:
    """Within it, Spark takes stored tables for as large as their rows are in memory, not for what
    ``SMALL`` files of keys take; else it broadcasts tables of many more bytes than it may."""
    return settings(spark, {_FACTOR: "8"})


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a table of this run in the folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tillwise-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
