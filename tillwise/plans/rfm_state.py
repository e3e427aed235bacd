"""Customer metrics kept up to date by batches of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import SUM_PARTS
from ..schemas import require_columns
from ..sources.refresh import refresh_by_month
from ..sources.store import MONTH, materialize
from .rfm import clock, customer_partials, metrics_of, scores_of

ORDER = ("customer_id", "order_id", "order_date", "total_order_value", "updated_at")
ADDED = ("orders", *SUM_PARTS)


def update_rfm(orders: DataFrame, path: str) -> None:
    """Merge a batch of orders into the metrics stored at ``path``.

    An order that is stored already is replaced by the batch's version unless that is older, as
    ``refresh_by_month`` says: what the old version added is taken back, what the new one adds is
    added. Sums are whole numbers of millionths, so both are exact. The newest order of a customer
    cannot be taken back from a maximum: customers whose newest order went are looked up
    among the stored orders, all others are merged. Other columns of ``orders`` are not kept.
    """
    require_columns(orders, ORDER, "orders")
    spark = orders.sparkSession
    change = refresh_by_month(orders.select(*ORDER), f"{path}/orders", updated="updated_at")
    come, gone = customer_partials(change.come), customer_partials(change.gone)
    minus = {name: -F.col(name) for name in ADDED}
    delta = come.withColumn("went", F.lit(None).cast("bigint")).unionByName(
        gone.withColumns(minus | {"went": F.col("last"), "last": F.lit(None).cast("bigint")})
    )
    if not change.months:
        change.remove()
        return
    if (stored := _stored(spark, path)) is not None:
        delta = delta.unionByName(stored.withColumn("went", F.lit(None).cast("bigint")))
    merged = delta.groupBy("customer_id").agg(
        F.max("last").alias("last"), F.max("went").alias("went"),
        *[F.sum(name).alias(name) for name in ADDED],
    )
    merged = materialize(merged.where("orders > 0"), "merged")
    change.remove()
    stale = merged.where("went >= last").select("customer_id")
    again = spark.read.parquet(f"{path}/orders").dropna(subset=list(ORDER[:4]))
    again = again.join(stale, "customer_id", "left_semi").groupBy("customer_id")
    newest = again.agg(F.max(clock("order_date")).alias("found"))
    whole = merged.join(newest, "customer_id", "left")
    whole = whole.withColumn("last", F.coalesce("found", "last")).drop("went", "found")
    materialize(whole, "rfm-state").write.mode("overwrite").parquet(f"{path}/customers")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    name = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/customers")
    if not name.getFileSystem(spark._jsc.hadoopConfiguration()).exists(name):
        return None
    return spark.read.parquet(f"{path}/customers")


def read_rfm_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Recency, frequency and money of every customer with orders, from the stored state."""
    return metrics_of(spark.read.parquet(f"{path}/customers"))


def read_rfm_scores(spark: SparkSession, path: str) -> DataFrame:
    """``rfm_scores`` of all orders merged so far."""
    return scores_of(read_rfm_metrics(spark, path))


def read_rfm_orders(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of every order merged so far."""
    return spark.read.parquet(f"{path}/orders").drop(MONTH)
