"""Order grain: one row per order, for all results on order-level columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import require_columns
from .line_items import line_count, product_skus


def one_row_per_order(
    rows: DataFrame, columns: Sequence[str] | None = None, unique: bool = False
) -> DataFrame:
    """One row per ``order_id`` with its order-level ``columns``.

    Where an order occurs in several versions, one row is taken as a whole: the one updated
    last (``updated_at`` or ``order_updated_at``, null first), among these the one with the
    largest ``columns``, compared in turn. Rows without an order id make one row together.
    Copies of an order collapse before the shuffle. A table known to have one row per order is
    ``unique`` and only projected, unless it has rows without an id, which then stay apart.
    """
    require_columns(rows, ("order_id",), "order rows")
    names = [c for c in (rows.columns if columns is None else columns) if c != "order_id"]
    if unique:
        return rows.select("order_id", *names)
    if not names:
        return rows.select("order_id").distinct()
    updated = [c for c in ("updated_at", "order_updated_at") if c in rows.columns]
    whole = F.struct(*[F.col(name) for name in names])
    newest = F.max(F.struct(*updated, whole.alias("_row")))
    chosen = rows.groupBy("order_id").agg(newest.getField("_row").alias("_row"))
    return chosen.select("order_id", "_row.*")


def order_rows(
    orders: DataFrame,
    columns: Sequence[str],
    lines: DataFrame | None = None,
    unique: bool = False,
) -> DataFrame:
    """One row per order that has at least one line, straight from the orders table.

    Equal to ``one_row_per_order`` of the line-item table, without exploding or joining
    anything. Where the lines are a table of their own instead of arrays, give it as ``lines``.
    """
    if lines is None:
        return one_row_per_order(orders.where(line_count() > 0), columns, unique)
    return with_lines(one_row_per_order(orders, columns, unique), lines)


def lines_of_product(lines: DataFrame, products: DataFrame, product_name: str) -> DataFrame:
    """Order lines of the products with a name."""
    named = product_skus(products).where(F.col("product_name") == product_name)
    same = F.col("order_product_sku") == F.col("product_sku")
    return lines.join(named.select("product_sku"), same, "left_semi")


def with_lines(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Those orders, one row each, that occur in ``lines``; a null id occurs if lines have one.

    Both sides are distinct, so this is an inner join; Spark would move a semi join below
    the de-duplication of ``orders`` and shuffle all copies of an order.
    """
    ids = lines.select(F.col("order_id").alias("_order_id")).distinct()
    return orders.join(ids, F.col("order_id").eqNullSafe(F.col("_order_id"))).drop("_order_id")
