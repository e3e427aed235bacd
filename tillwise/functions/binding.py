"""A choice among cases, and column names that are free."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(cases: Sequence[tuple[Column, Column | object]], default: Column | object) -> Column:
    """The value of the first case whose condition holds, else ``default``."""
    (condition, value), *rest = cases
    column = F.when(condition, value)
    for condition, value in rest:
        column = column.when(condition, value)
    return column.otherwise(default)


def free_name(columns: Iterable[str], name: str) -> str:
    """``name``, with so many underscores ahead that no column has it, in upper case or lower."""
    taken = {column.lower() for column in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
