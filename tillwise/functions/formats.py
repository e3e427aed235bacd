"""Text forms of numbers for reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import first_match

CURRENCY = "₹ "


def fixed_point(value: Column, digits: int, thousands: bool = False) -> Column:
    """``value`` with a fixed number of digits after the point.

    ``format_number`` rounds the binary number itself, ties to even; ``format_string`` would
    round its decimal print and move some ties.
    """
    text = F.format_number(value, digits)
    return text if thousands else F.translate(text, ",", "")


def short_number(value: Column) -> Column:
    """A number shortened with K, M or B; ``N/A`` for null and NaN, other text as it is."""
    number = value.try_cast("double")
    size = F.abs(number)

    def shortened(least: float, digits: int, suffix: str) -> Column:
        return F.concat(fixed_point(size / least, digits), F.lit(suffix))

    # From which size on a number is shortened, and how.
    text = first_match(
        [
            (size >= 1e9, shortened(1e9, 2, "B")),
            (size >= 1e6, shortened(1e6, 2, "M")),
            ((size >= 1e3) & (size % 1000 == 0), shortened(1e3, 0, "K")),
            (size >= 1e3, shortened(1e3, 1, "K")),
            (size == F.floor(size), fixed_point(size, 0, thousands=True)),
        ],
        fixed_point(size, 2, thousands=True),
    )
    return first_match(
        [
            (value.isNull() | F.isnan(number), F.lit("N/A")),
            (number.isNull(), value.cast("string")),
            (number < 0, F.concat(F.lit("-"), text)),
        ],
        text,
    )


def currency(value: Column, symbol: str = CURRENCY) -> Column:
    """``short_number`` behind a currency symbol."""
    return F.concat(F.lit(symbol), short_number(value))


def amount(value: Column, symbol: str = CURRENCY, thousands: bool = False) -> Column:
    """Two digits behind a currency symbol."""
    return F.concat(F.lit(symbol), fixed_point(value, 2, thousands))


def percent_text(value: Column) -> Column:
    """Two digits and a percent sign."""
    return F.concat(fixed_point(value, 2), F.lit("%"))


def count_text(value: Column) -> Column:
    """No digits after the point, thousands separated."""
    return fixed_point(value, 0, thousands=True)
