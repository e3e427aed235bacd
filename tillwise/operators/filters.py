"""Row filters, the values they can take, and the bounds of date ranges."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import free_name
from ..functions.numbers import as_timestamp

ALL = "All"


def date_range(
    df: DataFrame,
    column: str,
    start: dt.date | None = None,
    end: dt.date | None = None,
    strict: bool = False,
) -> DataFrame:
    """Rows whose day lies between ``start`` and ``end``, both included; null days fail.

    An incomplete or reversed range filters nothing, or raises with ``strict``. The bounds
    are literals of the column's own type, so that the filter reaches the file scan.
    """
    condition = date_condition(df, column, start, end)
    if condition is None:
        if strict:
            raise ValueError(f"not a date range: {start} to {end}")
        return df
    return df.where(condition)


def date_condition(
    df: DataFrame, column: str, start: dt.date | None, end: dt.date | None
) -> Column | None:
    """What ``date_range`` asks of a row; ``None`` for an incomplete or reversed range."""
    if start is None or end is None or start > end:
        return None
    kind = df.schema[column].dataType
    first = F.lit(start.isoformat()).cast(kind)
    after = F.lit((end + dt.timedelta(days=1)).isoformat()).cast(kind)
    return (F.col(column) >= first) & (F.col(column) < after)


def keep_equal(df: DataFrame, **values: object) -> DataFrame:
    """Rows with the given values; ``None`` and ``'All'`` stand for no filter."""
    for column, value in values.items():
        if value is not None and value != ALL:
            df = df.where(F.col(column) == value)
    return df


def filter_rows(
    df: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
    date_column: str = "order_date",
    **values: object,
) -> DataFrame:
    """``date_range`` and ``keep_equal`` in one call."""
    return keep_equal(date_range(df, date_column, start, end), **values)


def filter_values(df: DataFrame, column: str) -> DataFrame:
    """The values one can filter by: distinct, not null, sorted."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def product_name_choices(lines: DataFrame, returns: DataFrame) -> DataFrame:
    """Product names of sales and returns together."""
    both = lines.select("product_name").distinct().union(returns.select("product_name"))
    return filter_values(both, "product_name")


def date_bounds(
    *columns: tuple[DataFrame, str],
    fixed_start: dt.date | None = None,
    within_data: bool = False,
    fallback: tuple[DataFrame, str] | None = None,
) -> DataFrame:
    """One row ``min_date, max_date`` over all the given date columns.

    ``fixed_start`` replaces the smallest day; with ``within_data`` it does so only where
    the data begin earlier. Where the columns hold no date at all, those of ``fallback`` count.
    """
    bounds = [_bounds(*column) for column in columns]
    rows = bounds[0]
    for other in bounds[1:]:
        rows = rows.union(other)
    if fallback is not None:
        found = rows.agg(F.min("low").alias("low"), F.max("high").alias("high"))
        both = found.withColumn("turn", F.lit(0)).union(_bounds(*fallback).withColumn("turn", F.lit(1)))
        first = F.min_by(F.struct("low", "high"), F.when(F.col("low").isNotNull(), F.col("turn")))
        rows = both.agg(first.alias("row")).select("row.*")
    low = F.min("low")
    if fixed_start is not None:
        fixed = F.lit(fixed_start)
        low = F.greatest(fixed, low) if within_data else fixed
    return rows.agg(low.alias("min_date"), F.max("high").alias("max_date"))


def _bounds(df: DataFrame, column: str) -> DataFrame:
    day = F.to_date(column)
    return df.agg(F.min(day).alias("low"), F.max(day).alias("high"))


# How far the presets of a daily series reach back from its last day.
TRAILING_MONTHS = {"1m": 1, "6m": 6, "1y": 12}


def trailing(series: DataFrame, preset: str, column: str = "date") -> DataFrame:
    """The end of a daily series: ``1m``, ``6m``, ``YTD``, ``1y`` or ``all``."""
    if preset == "all":
        return series
    last = series.agg(F.max(column)).scalar()
    if preset == "YTD":
        first = F.trunc(last, "year")
    else:
        first = F.add_months(last, -TRAILING_MONTHS[preset])
    return series.where(F.col(column) >= first)


def search(df: DataFrame, column: str, term: str) -> DataFrame:
    """Distinct values containing ``term`` in any case, sorted."""
    hits = df.where(F.lower(column).contains(term.lower()))
    return filter_values(hits, column)


def drop_unreadable(df: DataFrame, times: Sequence[str]) -> DataFrame:
    """Rows whose time columns can all be read."""
    typed = df.withColumns({name: as_timestamp(df, name) for name in times})
    return typed.dropna(subset=list(times))


def semi_join(df: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """Rows whose value occurs in ``other``; a null occurs if ``other`` has a null."""
    key = free_name(df.columns, "_key")
    keys = other.select(F.col(column).alias(key)).distinct()
    return df.join(keys, F.col(column).eqNullSafe(F.col(key)), "left_semi")
