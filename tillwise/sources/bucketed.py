"""Orders and their lines stored side by side, so that joining them moves nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import exact_sum
from ..schemas import require_columns


def store_by_order(
    orders: DataFrame, lines: DataFrame, name: str, path: str, buckets: int | None = None
) -> None:
    """Store both as tables ``<name>_orders`` and ``<name>_lines`` of the catalog, under ``path``.

    Both are dealt into the same number of buckets by ``order_id`` and sorted by it there: one
    shuffle when they are written, none when they are joined or summed by that column. A bucket is
    one file and one task, so take as many ``buckets`` as make a bucket of lines some 100 to 200
    MB; without a number it is that of the shuffle partitions. Tables of the name are replaced.
    All rows without an id are in one bucket.
    """
    spark = orders.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    for part, rows in (("orders", orders), ("lines", lines)):
        require_columns(rows, ("order_id",), part)
        # Dealt as the buckets are, so that each task writes one file.
        dealt = rows.withColumn("order_id", F.col("order_id").cast("bigint")).repartition(count, "order_id")
        writer = dealt.write.mode("overwrite").bucketBy(count, "order_id").sortBy("order_id")
        writer.option("path", f"{path}/{part}").saveAsTable(f"{name}_{part}")


def read_by_order(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame]:
    """The stored orders and lines."""
    return spark.table(f"{name}_orders"), spark.table(f"{name}_lines")


def orders_with_lines(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """The orders that occur in ``lines``; orders without an id do not, unlike in ``with_lines``.

    Plain equality of the column itself is what buckets serve.
    """
    return orders.join(lines.select("order_id"), "order_id", "left_semi")


def lines_per_order(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """The orders with ``n_lines`` and the ``quantity`` of their lines; 0 lines and null for none."""
    summed = lines.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_lines"), exact_sum("quantity").alias("quantity")
    )
    joined = orders.join(summed, "order_id", "left")
    return joined.fillna(0, "n_lines")
