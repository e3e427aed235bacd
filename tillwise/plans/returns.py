"""Returns against sales, and return reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.comments import normal_comment
from ..functions.numbers import percentage, ratio, total
from ..operators.ranking import top_k, value_counts

DAY_PRODUCT = ["date", "product_name"]


def daily_sales(lines: DataFrame) -> DataFrame:
    """Units and revenue per day and product name."""
    days = lines.withColumn("date", F.to_date("order_date")).dropna(subset=DAY_PRODUCT)
    return days.groupBy(*DAY_PRODUCT).agg(
        total("quantity").alias("total_sold_quantity"),
        total("line_item_revenue").alias("total_sales_revenue"),
    )


def daily_product_returns(returns: DataFrame) -> DataFrame:
    """Returned units per day and product name."""
    days = returns.withColumn("date", F.to_date("return_date")).dropna(subset=DAY_PRODUCT)
    quantity = total("returned_quantity").alias("total_returned_quantity")
    return days.groupBy(*DAY_PRODUCT).agg(quantity)


def returns_vs_sales(lines: DataFrame, returns: DataFrame) -> DataFrame:
    """Sales and returns of every day and product that has either.

    Rate and value use the sales of the same day, so returns on a day without sales of the
    product have rate and value 0.
    """
    both = daily_sales(lines).join(daily_product_returns(returns), DAY_PRODUCT, "full")
    measures = ("total_sold_quantity", "total_sales_revenue", "total_returned_quantity")
    filled = both.select(
        *DAY_PRODUCT, *[F.coalesce(F.col(name), F.lit(0.0)).alias(name) for name in measures]
    )
    sold, returned = F.col("total_sold_quantity"), F.col("total_returned_quantity")
    return filled.withColumns(
        {
            "return_rate_percentage": percentage(returned, sold),
            "estimated_unit_price": ratio(F.col("total_sales_revenue"), sold),
        }
    ).withColumn("estimated_returned_value", returned * F.col("estimated_unit_price"))


def return_kpis(rvs: DataFrame) -> DataFrame:
    """Totals and overall return rate of ``returns_vs_sales``."""
    totals = rvs.agg(
        total("total_sold_quantity").alias("total_sold"),
        total("total_returned_quantity").alias("total_returned"),
        total("total_sales_revenue").alias("total_sales_value"),
        total("estimated_returned_value").alias("total_estimated_returned_value"),
    )
    rate = percentage(F.col("total_returned"), F.col("total_sold"))
    return totals.withColumn("overall_return_rate", rate)


def _rollup(rvs: DataFrame, key: str) -> DataFrame:
    measures = ("total_returned_quantity", "total_sold_quantity", "estimated_returned_value")
    summed = rvs.groupBy(key).agg(*[total(name).alias(name) for name in measures])
    rate = percentage(F.col("total_returned_quantity"), F.col("total_sold_quantity"))
    return summed.withColumn("return_rate_percentage", rate)


def product_returns(rvs: DataFrame) -> DataFrame:
    """Returns per product name, the rate taken from the sums."""
    return _rollup(rvs, "product_name")


def daily_returns(rvs: DataFrame) -> DataFrame:
    """Returns per day, the rate taken from the sums, ascending."""
    return _rollup(rvs, "date").orderBy("date")


def top_returned_qty(rvs: DataFrame, k: int = 10) -> DataFrame:
    """Products with the most returned units."""
    return top_k(product_returns(rvs), "total_returned_quantity", k, "product_name")


def top_return_rate(rvs: DataFrame, k: int = 10) -> DataFrame:
    """Products with the highest return rate, leaving out returns without any sale."""
    sold, returned = F.col("total_sold_quantity"), F.col("total_returned_quantity")
    rated = product_returns(rvs).where((sold > 0) | (returned == 0))
    return top_k(rated, "return_rate_percentage", k, "product_name")


def top_return_comments(returns: DataFrame, k: int = 10) -> DataFrame:
    """The most frequent return reasons in their normal spelling."""
    comments = returns.select(normal_comment(F.col("return_comments")).alias("comment"))
    return value_counts(comments, "comment").limit(k)
