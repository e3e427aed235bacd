"""Product results at line grain: a line counts once per tag of its product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio, total
from ..operators.ranking import top_k, with_share

LOW_STOCK = 20


def product_kpis(lines: DataFrame) -> DataFrame:
    """Units, revenue, distinct SKUs and revenue per unit."""
    return lines.agg(
        total("quantity").alias("total_products_sold"),
        total("line_item_revenue").alias("total_product_revenue"),
        F.count_distinct("product_sku").alias("unique_products_sold"),
    ).withColumn(
        "avg_product_price",
        ratio(F.col("total_product_revenue"), F.col("total_products_sold")),
    )


def _sum_by(lines: DataFrame, column: str, measure: str) -> DataFrame:
    known = lines.where(F.col(column).isNotNull())
    return known.groupBy(column).agg(total(measure).alias(measure))


def _top_by(lines: DataFrame, column: str, measure: str, k: int) -> DataFrame:
    return top_k(_sum_by(lines, column, measure), measure, k, column)


def top_products_revenue(lines: DataFrame, k: int = 10) -> DataFrame:
    """Product names with the largest revenue."""
    return _top_by(lines, "product_name", "line_item_revenue", k)


def top_products_quantity(lines: DataFrame, k: int = 10) -> DataFrame:
    """Product names with the most units."""
    return _top_by(lines, "product_name", "quantity", k)


def top_tags_revenue(lines: DataFrame, k: int = 15) -> DataFrame:
    """Tags with the largest revenue."""
    return _top_by(lines, "product_tags_compound", "line_item_revenue", k)


def top_tags_quantity(lines: DataFrame, k: int = 15) -> DataFrame:
    """Tags with the most units."""
    return _top_by(lines, "product_tags_compound", "quantity", k)


def tag_revenue_share(lines: DataFrame, k: int = 15) -> DataFrame:
    """Revenue of the top tags with the share among them."""
    top = top_tags_revenue(lines, k).withColumnRenamed("line_item_revenue", "value")
    return with_share(top, "value")


def tag_quantity_share(lines: DataFrame) -> DataFrame:
    """Units of all tags with the share in the whole."""
    tags = _sum_by(lines, "product_tags_compound", "quantity")
    return with_share(tags.withColumnRenamed("quantity", "value"), "value")


def _daily(lines: DataFrame, measure: str, name: str) -> DataFrame:
    days = lines.withColumn("date", F.to_date("order_date"))
    known = days.where(F.col("date").isNotNull())
    return known.groupBy("date").agg(total(measure).alias(name)).orderBy("date")


def daily_product_revenue(lines: DataFrame) -> DataFrame:
    """Line revenue per day, ascending."""
    return _daily(lines, "line_item_revenue", "revenue")


def daily_quantity(lines: DataFrame) -> DataFrame:
    """Units per day, ascending."""
    return _daily(lines, "quantity", "quantity_sold")


def low_stock(lines: DataFrame, threshold: int = LOW_STOCK) -> DataFrame:
    """SKUs whose stock on their newest line is at most ``threshold``, smallest first.

    Newest by date, then order id, product name and stock; null stock counts as 0. Lines
    without a product make one nameless SKU.
    """
    newest = F.max(F.struct("order_date", "order_id", "product_name", "stock_available"))
    last = lines.groupBy("product_sku").agg(newest.alias("_newest"))
    stock = F.coalesce(F.col("_newest.stock_available"), F.lit(0.0)).cast("int")
    listed = last.select(
        F.col("_newest.product_name"), "product_sku", stock.alias("stock_available")
    )
    return listed.where(F.col("stock_available") <= threshold).orderBy(
        "stock_available", "product_sku"
    )
