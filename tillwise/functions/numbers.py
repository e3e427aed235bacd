"""Typing of numbers and times, exact sums, safe ratios."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as a number in a text cell, and the date formats tried in order.
# Of two short numbers before a year, the first is the month.
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
DATE_FORMATS = (
    "yyyy-M-d",
    "yyyy-M-d H:mm[:ss][.SSSSSSSSS][.SSSSSS][.SSS][.SS][.S][XXX][X]",
    "yyyy-M-d'T'H:mm[:ss][.SSSSSSSSS][.SSSSSS][.SSS][.SS][.S][XXX][X]",
    "M/d/yyyy",
    "M/d/yyyy H:mm[:ss]",
    "yyyy/M/d",
    "yyyy/M/d H:mm[:ss]",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "d-MMM-yyyy",
    "yyyyMMdd",
)


# Values below this many units have millionths that a double holds exactly.
SMALL = 2.0**33
HALF = 26
SUM_PARTS = ("high", "low", "beyond", "large", "values")


def as_double(df: DataFrame, name: str) -> Column:
    """The column, or the elements of an array column, as double.

    Text that is no number and NaN become null.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, T.ArrayType):
        return F.transform(name, lambda item: _double(item, kind.elementType)).alias(name)
    return _double(F.col(name), kind).alias(name)


def _double(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        # Spark's own cast would also take "5d"; the pattern keeps that out.
        column = F.when(column.rlike(NUMBER_TEXT), F.trim(column).try_cast("double"))
    elif not isinstance(kind, T.DoubleType):
        column = column.cast("double")
    return F.when(~F.isnan(column), column)


def as_timestamp(df: DataFrame, name: str, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """The column as a timestamp; text in none of ``formats`` becomes null."""
    kind = df.schema[name].dataType
    column = F.col(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return column
    if isinstance(kind, T.StringType):
        text = F.trim(column)
        column = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])
    else:
        column = column.cast("timestamp")
    return column.alias(name)


def as_flag(df: DataFrame, name: str) -> Column:
    """Truth of a flag column: a boolean as it is, any non-empty text is true."""
    if isinstance(df.schema[name].dataType, T.BooleanType):
        flag = F.col(name)
    else:
        flag = F.length(F.col(name).cast("string")) > 0
    return F.coalesce(flag, F.lit(False)).alias(name)


def sum_parts(name: str) -> dict[str, Column]:
    """The aggregates that make up the exact sum of a column, each of which can be added up again.

    Millionths are added up as long integers, in two parts so that no total overflows. What a
    value has beyond its millionths is added up as doubles, 0 for money and pieces, and so
    are values too large for millionths, and infinities. ``values`` counts what was added.
    """
    value = F.col(name).cast("double")
    small = F.abs(value) < SMALL
    millionths = F.when(small, F.rint(value * 1e6).cast("bigint"))
    beyond = F.when(small, value - F.rint(value * 1e6) / 1e6)
    return {
        "high": F.sum(F.shiftright(millionths, HALF)),
        "low": F.sum(millionths.bitwiseAND(F.lit((1 << HALF) - 1))),
        "beyond": F.sum(beyond),
        "large": F.sum(F.when(~small, value)),
        "values": F.count(value),
    }


def sum_of_parts(parts: Mapping[str, Column] | None = None) -> Column:
    """The sum as double that ``sum_parts`` make up, or columns of their names; null without values."""
    held = parts or {name: F.col(name) for name in SUM_PARTS}
    high = held["high"].cast("decimal(20,0)") * F.lit(Decimal(1 << HALF))
    exact = ((high + held["low"].cast("decimal(20,0)")) * F.lit(Decimal("0.000001"))).cast("double")
    added = [F.coalesce(part, F.lit(0.0)) for part in (exact, held["beyond"], held["large"])]
    return F.when(held["values"] > 0, added[0] + added[1] + added[2])


def exact_sum(name: str) -> Column:
    """Sum of a numeric column as double; null without values.

    Exact in millionths, the same for any order of the rows, and several times faster than a
    decimal sum: see ``sum_parts``. Nothing is cut off or rounded.
    """
    return sum_of_parts(sum_parts(name))


def total(name: str) -> Column:
    """``exact_sum``, 0.0 where there is nothing to add."""
    return F.coalesce(exact_sum(name), F.lit(0.0))


def mean(name: str) -> Column:
    """Mean over the non-null values, null where there are none."""
    return exact_sum(name) / F.nullif(F.count(name), F.lit(0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``, 0 where the denominator is not positive."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def percentage(numerator: Column, denominator: Column) -> Column:
    """``ratio`` times 100."""
    return F.when(denominator > 0, numerator / denominator * 100).otherwise(F.lit(0.0))


def round_half_even(value: Column, digits: int) -> Column:
    """Scale, round to the nearest (ties to even), scale back."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale
