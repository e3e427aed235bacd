"""Daily facts: sums and exact order counts per day and filter values, stored by month.

Two tables hold the cells. One has a row per day and values of the dimensions, where each order
counts once. The other has a row per day, values and product, where an order counts once for each
of its products: the sums for one product, and the orders as bits, so that the orders with any
of several products are counted exactly, however many of these they have.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import SUM_PARTS, ratio, sum_of_parts, sum_parts
from ..operators.filters import ALL, keep_equal
from ..operators.ranking import global_rank
from ..schemas import require_columns
from ..sources.store import MONTH, month_of, write_by, write_parts

MEASURES = ("total_order_value", "discount_amount", "tax_amount", "shipping_cost")
OWN = ("date", "orders", "bucket", "bits", "number", MONTH)
# Orders whose bits are one long integer: two to this power.
WORD = 6


def write_cube(
    orders: DataFrame,
    order_products: DataFrame,
    path: str,
    dimensions: Sequence[str],
    measures: Sequence[str] = MEASURES,
    product: str = "product_name",
) -> None:
    """Store the cells of ``orders``, one row each, at ``path``.

    ``order_products`` holds pairs of ``order_id`` and ``product``; repeated pairs count once, and
    pairs without a product or an order not at all. Orders without an id add to the sums of all
    orders but are not counted, and belong to no product. A null dimension or day is a value of
    its own, which no filter finds. Months that ``orders`` has rows of are replaced as a whole, all
    others stay, so a late order asks for its month again. Without orders nothing is written.

    The orders are numbered by time: those of a day are neighbours and fill few bitmaps. Numbers
    are compared within a month only, and a month is always written in one go.

    A cell of products has a row for each ``number`` of 64 neighbours it holds an order of, so a row is
    as large for a cell of one order as it needs to be. All rows of a ``bucket`` of 32,768 orders
    are summed and written by one task: the tasks grow in number with the orders, not in size, and
    rows of a month lie in few files without another shuffle.
    """
    require_columns(orders, ("order_id", "order_date", *dimensions, *measures), "orders")
    require_columns(order_products, ("order_id", product), "products of orders")
    if taken := {name.lower() for name in (*dimensions, product)} & set(OWN):
        raise ValueError(f"names that the cells have themselves: {sorted(taken)}")
    needed = orders.select("order_id", "order_date", *dimensions, *measures)
    dated = needed.withColumns({"date": F.to_date("order_date"), MONTH: month_of(needed, "order_date")})
    numbered = global_rank(dated, ["order_date", "order_id"], "number")
    sums = [
        part.alias(f"{measure}_{name}")
        for measure in measures
        for name, part in sum_parts(measure).items()
    ]
    per_day = numbered.groupBy(MONTH, "date", *dimensions)
    cells = per_day.agg(F.count("order_id").alias("orders"), *sums)
    write_by(cells, MONTH, f"{path}/orders")

    pairs = order_products.select("order_id", product).dropna().distinct()
    place = F.col("number") - 1
    bought = numbered.join(pairs, "order_id").withColumns(
        {
            "bucket": F.bitmap_bucket_number("number"),
            "bits": F.expr(f"shiftleft(1L, cast((number - 1) % {1 << WORD} as int))"),
            "number": F.shiftright(place, WORD),
        }
    )
    per_bucket = bought.repartition(max(_buckets(numbered), 1), "bucket")
    per_product = per_bucket.groupBy(MONTH, "date", *dimensions, product, "bucket", "number")
    cells = per_product.agg(F.count("order_id").alias("orders"), F.bit_or("bits").alias("bits"), *sums)
    write_parts(cells, MONTH, f"{path}/products")


def _buckets(numbered: DataFrame) -> int:
    """How many buckets the numbers from 1 without gaps fill."""
    return numbered.agg(F.bitmap_bucket_number(F.max("number"))).first()[0] or 0


def read_cells(
    spark: SparkSession,
    path: str,
    start: dt.date | None = None,
    end: dt.date | None = None,
    product: str | None = None,
    product_column: str = "product_name",
    **values: object,
) -> DataFrame:
    """The cells of a period, of orders with a product if one is named, and with the given values.

    ``None`` and ``'All'`` filter nothing, and neither does an incomplete or reversed range. Only
    the files of the period's months are read, and only the columns that are then used.
    """
    if product is None or product == ALL:
        return keep_equal(_within(spark.read.parquet(f"{path}/orders"), start, end), **values)
    cells = _within(spark.read.parquet(f"{path}/products"), start, end)
    return keep_equal(cells.where(F.col(product_column) == product), **values)


def read_product_cells(
    spark: SparkSession, path: str, start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    """The cells per product of a period, for ``distinct_orders`` of any set of products."""
    return _within(spark.read.parquet(f"{path}/products"), start, end)


def _within(cells: DataFrame, start: dt.date | None, end: dt.date | None) -> DataFrame:
    if start is None or end is None or start > end:
        return cells
    # A day of the session's zone may lie in the month before or after it in UTC.
    day = dt.timedelta(days=1)
    first, last = (start - day).replace(day=1), end + day
    months = F.col(MONTH).between(F.lit(first), F.lit(last))
    return cells.where(months & F.col("date").between(F.lit(start), F.lit(end)))


def _total(measure: str) -> Column:
    parts = {name: F.sum(f"{measure}_{name}") for name in SUM_PARTS}
    return F.coalesce(sum_of_parts(parts), F.lit(0.0))


def _orders() -> Column:
    return F.coalesce(F.sum("orders"), F.lit(0)).alias("total_orders")


def cube_kpis(cells: DataFrame) -> DataFrame:
    """What ``sales_kpis`` gives for the orders in these cells of all orders or of one product."""
    sums = cells.agg(
        _total("total_order_value").alias("total_revenue"),
        _orders(),
        _total("discount_amount").alias("total_discount_amount"),
        _total("tax_amount").alias("total_tax_amount"),
        _total("shipping_cost").alias("total_shipping_cost"),
    )
    average = ratio(F.col("total_revenue"), F.col("total_orders"))
    return sums.withColumn("average_order_value", average)


def cube_daily(cells: DataFrame) -> DataFrame:
    """Order value and orders per day, ascending, from cells of all orders or of one product."""
    days = cells.where(F.col("date").isNotNull()).groupBy("date")
    revenue = _total("total_order_value").alias("revenue")
    return days.agg(revenue, F.sum("orders").alias("orders")).orderBy("date")


def cube_by(cells: DataFrame, column: str) -> DataFrame:
    """Order value and orders per value of a dimension, largest value first."""
    known = cells.where(F.col(column).isNotNull()).groupBy(column)
    value = _total("total_order_value").alias("total_order_value")
    return known.agg(value, F.sum("orders").alias("orders")).orderBy(
        F.desc("total_order_value"), column
    )


def distinct_orders(cells: DataFrame, *columns: str) -> DataFrame:
    """Orders in these cells of products, each once: in all, or per values of ``columns``.

    Bits of the same orders are united where the cells are, so a shuffle moves one long integer for
    each value, month and 64 orders, whatever the number of products and days.
    """
    united = cells.groupBy(*columns, MONTH, "bucket", "number").agg(F.bit_or("bits").alias("bits"))
    counted = united.select(*columns, F.bit_count("bits").alias("n")).groupBy(*columns)
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orders"))
