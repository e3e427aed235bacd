"""Tables bucketed by order: nothing moves when they are joined or summed by it."""

import pytest
from pyspark.sql import functions as F

from tests.shop import rows
from tillwise.operators.orders import with_lines
from tillwise.sources.bucketed import lines_per_order, orders_with_lines, read_by_order, store_by_order


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    # No side small enough to be sent around: what a plan for large tables looks like.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    orders = spark.range(2000).select(
        F.when(F.col("id") % 50 != 0, F.col("id")).cast("int").alias("order_id"), (F.col("id") / 4).alias("value")
    )
    lines = spark.range(5000).select(
        F.when(F.col("id") % 70 != 0, F.col("id") % 1500).alias("order_id"), (F.col("id") % 9.0).alias("quantity")
    )
    path = str(tmp_path_factory.mktemp("by-order"))
    store_by_order(orders, lines, "bucket_test", path, 6)
    yield orders, lines, *read_by_order(spark, "bucket_test")
    spark.sql("drop table bucket_test_orders")
    spark.sql("drop table bucket_test_lines")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_exchange_above_the_scans(stored):
    _, _, orders, lines = stored
    assert "Exchange" not in _plan(lines_per_order(orders, lines))
    assert "Exchange" not in _plan(orders_with_lines(orders, lines))
    assert "SelectedBucketsCount: 6 out of 6" in _plan(orders_with_lines(orders, lines))


def test_rows_equal_those_of_plain_tables(stored):
    plain_orders, plain_lines, orders, lines = stored
    named = plain_orders.where("order_id is not null")
    assert rows(orders_with_lines(orders, lines), "order_id", "value") == rows(
        with_lines(named, plain_lines), "order_id", "value"
    )
    found = lines_per_order(orders, lines)
    assert found.count() == plain_orders.count()
    known = plain_lines.where("order_id is not null and order_id % 50 <> 0")
    counted = found.agg(F.sum("n_lines"), F.sum("quantity"))
    assert rows(counted) == rows(known.agg(F.count("*"), F.sum("quantity")))
    assert found.where("order_id is null").agg(F.max("n_lines")).first()[0] == 0


def test_tables_are_replaced_and_may_be_empty(spark, tmp_path):
    some = spark.range(10).select(F.col("id").alias("order_id"), F.lit(1.0).alias("quantity"))
    store_by_order(some, some, "bucket_again", str(tmp_path), 3)
    store_by_order(some.limit(0), some.where("order_id < 4"), "bucket_again", str(tmp_path), 3)
    orders, lines = read_by_order(spark, "bucket_again")
    assert (orders.count(), lines.count()) == (0, 4)
    assert lines_per_order(orders, lines).count() == 0
    with pytest.raises(ValueError, match="order_id"):
        store_by_order(some.drop("order_id"), some, "bucket_again", str(tmp_path))
    spark.sql("drop table bucket_again_orders")
    spark.sql("drop table bucket_again_lines")
