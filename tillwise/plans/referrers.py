"""Raw referring URLs, before any cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import filter_values, search
from ..operators.ranking import value_counts
from ..schemas import require_columns

RAW = "raw_referring_site"


def _raw(lines: DataFrame) -> DataFrame:
    require_columns(lines, ("referring_site",), "lines")
    return lines.select(F.col("referring_site").cast("string").alias(RAW))


def raw_referrer_counts(lines: DataFrame) -> DataFrame:
    """Line-item rows per raw URL, most frequent first; summed lines carry ``line_rows``."""
    if "line_rows" not in lines.columns:
        return value_counts(_raw(lines), RAW)
    known = lines.where(F.col("referring_site").isNotNull())
    counted = known.groupBy(F.col("referring_site").alias(RAW))
    return counted.agg(F.sum("line_rows").alias("count")).orderBy(F.desc("count"), RAW)


def raw_referrer_total(lines: DataFrame) -> DataFrame:
    """How many different raw URLs there are."""
    return _raw(lines).agg(F.count_distinct(RAW).alias("unique_referring_sites"))


def raw_referrers(lines: DataFrame, contains: str | None = None) -> DataFrame:
    """The different raw URLs, sorted; on request those containing a word."""
    if contains:
        return search(_raw(lines), RAW, contains)
    return filter_values(_raw(lines), RAW)
