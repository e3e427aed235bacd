"""Return comments brought to one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_comment(comment: Column) -> Column:
    """Lower case; slashes, commas and blanks become one ``-``; none left at the ends.

    Null stays null and an empty comment stays empty. ``(?U)`` makes ``\\s`` cover all
    Unicode blanks.
    """
    joined = F.regexp_replace(F.lower(comment), r"(?U)\s*[/,]\s*", "-")
    return F.btrim(F.regexp_replace(joined, r"(?U)\s+", "-"), F.lit("- "))
