"""Counts of what typing and storing lose, taken while the rows pass: no scan and no job of their own.

A counter belongs to a ``pyspark.sql.Observation``, which holds its numbers after the first action
on the frame. Spark counts a task's rows once it succeeds; where a stage is computed again after an
executor was lost, its rows may be counted again, so these are figures to report, not to compute
with. Filters are not pushed below a counter, as it counts all rows: load with it, query without.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.binding import free_name


def typed_with_losses(
    df: DataFrame, typed: Mapping[str, Column], losses: Observation, required: Sequence[str] = ()
) -> DataFrame:
    """``df`` with the columns ``typed``, less rows in which a ``required`` one is null.

    Counted are ``rows_read`` and ``rows_dropped``, and per typed column ``unreadable_<name>``,
    values that became null, and for text ``blank_<name>``, texts of nothing but blanks. Values
    that were null before are not counted. Of an array its items are counted.
    """
    raw = free_name([*df.columns, *typed], "_raw")
    kept = df.withColumn(raw, F.struct(*[F.col(f"`{name}`") for name in typed])) if typed else df
    kept = kept.withColumns(dict(typed))
    counts = {"rows_read": F.count(F.lit(1))}
    for name in typed:
        counts |= _lost(name, F.col(f"`{raw}`.`{name}`"), df.schema[name].dataType)
    missing = F.lit(False)
    for name in required:
        missing |= F.col(f"`{name}`").isNull()
    counts["rows_dropped"] = F.count_if(missing)
    counted = kept.observe(losses, *[count.alias(name) for name, count in counts.items()])
    return counted.drop(raw).where(~missing)


def _lost(name: str, raw: Column, kind: T.DataType) -> dict[str, Column]:
    now = F.col(f"`{name}`")
    if isinstance(kind, T.ArrayType):
        before, after = (F.size(F.filter(a, lambda item: item.isNotNull())) for a in (raw, now))
        items = F.when(raw.isNotNull(), before - F.when(now.isNull(), 0).otherwise(after))
        return {f"unreadable_{name}": F.coalesce(F.sum(items), F.lit(0))}
    gone = raw.isNotNull() & now.isNull()
    if not isinstance(kind, T.StringType):
        return {f"unreadable_{name}": F.count_if(gone)}
    blank = F.trim(raw) == ""
    return {f"unreadable_{name}": F.count_if(gone & ~blank), f"blank_{name}": F.count_if(blank)}


def written_rows(df: DataFrame, losses: Observation, **nulls: str) -> DataFrame:
    """``df``, counting ``rows_written`` and, under each name given, the nulls of a column."""
    counts = {"rows_written": F.count(F.lit(1))}
    counts |= {name: F.count_if(F.col(f"`{column}`").isNull()) for name, column in nulls.items()}
    return df.observe(losses, *[count.alias(name) for name, count in counts.items()])


def loss_table(spark: SparkSession, losses: Observation) -> DataFrame:
    """One row ``counter, n`` per counter, once an action has run."""
    return spark.createDataFrame(list(losses.get.items()), "counter string, n bigint")
