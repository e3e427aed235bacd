"""Geographic results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import fixed_point
from ..functions.numbers import exact_sum, mean, total
from ..operators.ranking import top_k

# Fixed value: where the map is centered when there is nothing to show.
DEFAULT_CENTER = (20.5937, 78.9629)
POINT = ["shipping_address_latitude", "shipping_address_longitude", "geography_city"]


def geo_kpis(orders: DataFrame) -> DataFrame:
    """Order value, orders, states and cities, from one row per order."""
    # Summed per place first, so that the distinct counts only see the places.
    places = orders.groupBy("geography_state", "geography_city").agg(
        exact_sum("total_order_value").alias("value"),
        F.count("order_id").alias("orders"),
    )
    return places.agg(
        total("value").alias("total_revenue"),
        F.coalesce(F.sum("orders"), F.lit(0)).alias("total_orders"),
        F.count_distinct("geography_state").alias("unique_states"),
        F.count_distinct("geography_city").alias("unique_cities"),
    )


def map_points(rows: DataFrame) -> DataFrame:
    """Revenue, units and orders per place, from rows with a position and a revenue."""
    located = rows.dropna(subset=[*POINT, "line_item_revenue"])
    points = located.groupBy(*POINT).agg(
        total("line_item_revenue").alias("total_revenue"),
        total("quantity").alias("total_quantity"),
        F.count_distinct("order_id").alias("order_count"),
    )
    return points.withColumn("tooltip_text", _tooltip())


def _tooltip() -> Column:
    # A whole quantity shows one zero after the point.
    quantity = F.col("total_quantity").cast("decimal(28,6)").cast("string")
    quantity = F.regexp_replace(quantity, r"(\.\d+?)0*$", "$1")
    return F.concat(
        F.lit("City: "),
        "geography_city",
        F.lit("<br>Revenue: ₹"),
        fixed_point(F.col("total_revenue"), 2, thousands=True),
        F.lit("<br>Orders: "),
        F.col("order_count").cast("string"),
        F.lit("<br>Quantity: "),
        quantity,
    )


def map_center(points: DataFrame, default: tuple[float, float] = DEFAULT_CENTER) -> DataFrame:
    """The plain mean of the points' positions, or ``default`` without points."""
    return points.agg(
        F.coalesce(mean(POINT[0]), F.lit(default[0])).alias("center_lat"),
        F.coalesce(mean(POINT[1]), F.lit(default[1])).alias("center_lon"),
    )


def _revenue_by(lines: DataFrame, column: str, k: int) -> DataFrame:
    known = lines.where(F.col(column).isNotNull()).groupBy(column)
    summed = known.agg(total("line_item_revenue").alias("line_item_revenue"))
    return top_k(summed, "line_item_revenue", k, column)


def _orders_by(rows: DataFrame, column: str, k: int) -> DataFrame:
    known = rows.where(F.col(column).isNotNull()).groupBy(column)
    counted = known.agg(F.count_distinct("order_id").alias("orders"))
    return top_k(counted, "orders", k, column)


def state_revenue(lines: DataFrame, k: int = 10) -> DataFrame:
    """States with the largest line revenue."""
    return _revenue_by(lines, "geography_state", k)


def city_revenue(lines: DataFrame, k: int = 10) -> DataFrame:
    """Cities with the largest line revenue."""
    return _revenue_by(lines, "geography_city", k)


def state_orders(rows: DataFrame, k: int = 10) -> DataFrame:
    """States with the most orders; ``rows`` at line or order grain."""
    return _orders_by(rows, "geography_state", k)


def city_orders(rows: DataFrame, k: int = 10) -> DataFrame:
    """Cities with the most orders; ``rows`` at line or order grain."""
    return _orders_by(rows, "geography_city", k)
