"""Customer results from the customer master."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import mean, total
from ..operators.ranking import top_k, value_counts, with_share

# Groups by number of orders; every other number, 0 included, is in the last.
FIRST_TIME = "1 (First-time Buyer)"
SECOND_TIME = "2 (Second-time Buyer)"
REPEAT = "3+ (Repeat Buyer)"


def customer_kpis(customers: DataFrame) -> DataFrame:
    """Customers, money spent, and means of the orders and of the order value per customer."""
    return customers.agg(
        F.count_distinct("customer_id").alias("total_customers"),
        total("total_spent").alias("total_lifetime_spent"),
        mean("orders_count").alias("avg_lifetime_orders"),
        mean("aov").alias("avg_lifetime_aov"),
    )


def daily_signups(customers: DataFrame) -> DataFrame:
    """New customers per signup day, ascending."""
    days = customers.withColumn("date", F.to_date("signup_date"))
    counted = days.where(F.col("date").isNotNull()).groupBy("date")
    return counted.agg(F.count_distinct("customer_id").alias("new_customers")).orderBy("date")


def customer_type_mix(customers: DataFrame) -> DataFrame:
    """Customers per type with their share."""
    return with_share(value_counts(customers, "imputed_customer_type"), "count")


def order_count_mix(customers: DataFrame) -> DataFrame:
    """Customers per number of orders, ascending."""
    known = customers.where(F.col("orders_count").isNotNull())
    counted = known.groupBy(F.col("orders_count").alias("number_of_orders"))
    counted = counted.agg(F.count(F.lit(1)).alias("number_of_customers"))
    return counted.orderBy("number_of_orders")


def repeat_buyer_mix(customers: DataFrame) -> DataFrame:
    """Customers per order-count group, in group order."""
    orders = F.col("orders_count")
    group = F.when(orders == 1, FIRST_TIME).when(orders == 2, SECOND_TIME).otherwise(REPEAT)
    known = customers.where(orders.isNotNull()).groupBy(group.alias("order_group"))
    # The labels start with their rank, so they sort in group order.
    return known.agg(F.count(F.lit(1)).alias("number_of_customers")).orderBy("order_group")


def _customers_by(customers: DataFrame, column: str, k: int) -> DataFrame:
    known = customers.where(F.col(column).isNotNull()).groupBy(column)
    counted = known.agg(F.count_distinct("customer_id").alias("number_of_customers"))
    return top_k(counted, "number_of_customers", k, column)


def customers_by_state(customers: DataFrame, k: int = 10) -> DataFrame:
    """States with the most customers."""
    return _customers_by(customers, "state", k)


def customers_by_city(customers: DataFrame, k: int = 10) -> DataFrame:
    """Cities with the most customers."""
    return _customers_by(customers, "city", k)


def top_customers(customers: DataFrame, k: int = 10) -> DataFrame:
    """Customers who spent the most."""
    columns = customers.select("customer_id", "total_spent", "orders_count", "aov")
    return top_k(columns, "total_spent", k, "customer_id")
