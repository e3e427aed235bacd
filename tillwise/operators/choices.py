"""All choice lists of filters that narrow one another, in one pass over the rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import ALL, date_condition


@dataclass(frozen=True)
class Cascade:
    """Filters in the order in which they apply: columns with the value chosen of each, ``None``
    or ``'All'`` for none, after a range of days."""

    name: str
    chosen: Mapping[str, object] = field(default_factory=dict)
    start: dt.date | None = None
    end: dt.date | None = None
    date_column: str = "order_date"


def cascading_choices(df: DataFrame, cascades: Sequence[Cascade]) -> DataFrame:
    """``cascade``, ``turn`` (from 1), ``filter`` and ``value`` (as text), sorted: what can be chosen in
    each filter of each cascade, given the choices before it.

    The list of a filter has the distinct values, without null, of the rows in the range that pass all
    filters before it; its own choice and later ones do not narrow it. Filters on columns
    that ``df`` lacks are left out and take no turn. Each row finds the first filter that it fails and
    goes to the lists up to this one, so all lists come from one scan; repeated values
    collapse before the shuffle.
    """
    names = [cascade.name for cascade in cascades]
    if not names or len(set(names)) < len(names):
        raise ValueError("cascades need names, each another one")
    ranges = [date_condition(df, c.date_column, c.start, c.end) for c in cascades]
    if all(condition is not None for condition in ranges):
        df = df.where(reduce(lambda a, b: a | b, ranges))
    offers: list[Column] = []
    for cascade, in_range in zip(cascades, ranges, strict=True):
        reached = F.lit(True) if in_range is None else F.coalesce(in_range, F.lit(False))
        present = [name for name in cascade.chosen if name in df.columns]
        for turn, name in enumerate(present, 1):
            value = F.col(f"`{name}`")
            offer = F.struct(
                F.lit(cascade.name).alias("cascade"),
                F.lit(turn).alias("turn"),
                F.lit(name).alias("filter"),
                value.cast("string").alias("value"),
            )
            offers.append(F.when(reached & value.isNotNull(), offer))
            choice = cascade.chosen[name]
            if choice is not None and choice != ALL:
                reached = reached & F.coalesce(value == choice, F.lit(False))
    if not offers:
        raise ValueError("no cascade has a filter on a column of the rows")
    lists = df.select(F.inline(F.array_compact(F.array(*offers))))
    return lists.distinct().orderBy("cascade", "turn", "value")
