"""Sales results at order grain."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio, total
from ..operators.filters import date_range
from ..operators.ranking import top_k
from ..schemas import require_columns


def sales_kpis(orders: DataFrame) -> DataFrame:
    """One row of order totals; zeros for no orders. A missing order id is not counted."""
    require_columns(orders, ("order_id",), "orders")
    sums = orders.agg(
        total("total_order_value").alias("total_revenue"),
        F.count("order_id").alias("total_orders"),
        total("discount_amount").alias("total_discount_amount"),
        total("tax_amount").alias("total_tax_amount"),
        total("shipping_cost").alias("total_shipping_cost"),
    )
    return sums.select(
        "total_revenue",
        "total_orders",
        ratio(F.col("total_revenue"), F.col("total_orders")).alias("average_order_value"),
        "total_discount_amount",
        "total_tax_amount",
        "total_shipping_cost",
    )


def home_kpis(
    orders: DataFrame, customers: DataFrame, start: dt.date | None, end: dt.date | None
) -> DataFrame:
    """Revenue, orders, and customers of the master who ordered, in a period."""
    period = date_range(orders.dropna(subset=["order_date"]), "order_date", start, end)
    # Orders are added up per customer, then each sum learns whether the master has them.
    per_customer = period.groupBy("customer_id").agg(
        total("total_order_value").alias("value"), F.count("order_id").alias("orders")
    )
    known = customers.select(F.col("customer_id").alias("_known")).distinct()
    joined = per_customer.join(known, F.col("customer_id") == F.col("_known"), "left")
    return joined.agg(
        total("value").alias("total_revenue"),
        F.coalesce(F.sum("orders"), F.lit(0)).alias("total_orders"),
        F.count("_known").alias("total_customers"),
    )


def _by_day(orders: DataFrame):
    days = orders.withColumn("date", F.to_date("order_date"))
    return days.where(F.col("date").isNotNull()).groupBy("date")


def daily_revenue(orders: DataFrame) -> DataFrame:
    """Order value per day, ascending."""
    require_columns(orders, ("order_date", "total_order_value"), "orders")
    revenue = total("total_order_value").alias("revenue")
    return _by_day(orders).agg(revenue).orderBy("date")


def daily_orders(orders: DataFrame) -> DataFrame:
    """Orders per day, ascending."""
    return _by_day(orders).agg(F.count("order_id").alias("orders")).orderBy("date")


def _revenue_by(orders: DataFrame, column: str) -> DataFrame:
    known = orders.where(F.col(column).isNotNull())
    value = total("total_order_value").alias("total_order_value")
    return known.groupBy(column).agg(value)


def revenue_by_channel(orders: DataFrame) -> DataFrame:
    """Order value per sales channel, largest first."""
    result = _revenue_by(orders, "order_channel")
    return result.orderBy(F.desc("total_order_value"), "order_channel")


def revenue_by_status(orders: DataFrame) -> DataFrame:
    """Order value per order status, largest first."""
    result = _revenue_by(orders, "order_status_from_tag")
    return result.orderBy(F.desc("total_order_value"), "order_status_from_tag")


def revenue_by_site(orders: DataFrame) -> DataFrame:
    """Order value per raw referring URL: far fewer rows to find the source names for."""
    value = total("total_order_value").alias("total_order_value")
    return orders.groupBy("referring_site").agg(value)


def top_referrers(orders: DataFrame, k: int = 10) -> DataFrame:
    """Sources with the largest order value."""
    result = _revenue_by(orders, "cleaned_referring_site")
    return top_k(result, "total_order_value", k, "cleaned_referring_site")


def _discounts(orders: DataFrame) -> DataFrame:
    if dict(orders.dtypes)["discount_applied"] != "string":
        coded = orders.where(F.lit(False))
    else:
        coded = orders.where(F.col("discount_applied") != "")
    return coded.groupBy("discount_applied").agg(
        total("discount_amount").alias("total_discount_amount"),
        F.count("order_id").alias("number_of_uses"),
    )


def discount_summary(orders: DataFrame) -> DataFrame:
    """Discount and number of orders per discount code, largest discount first."""
    return _discounts(orders).orderBy(F.desc("total_discount_amount"), "discount_applied")


def top_discounts(
    orders: DataFrame, k: int = 10, by: str = "total_discount_amount"
) -> DataFrame:
    """The first codes of the summary; by amount unless told otherwise."""
    return top_k(_discounts(orders), by, k, "discount_applied")
