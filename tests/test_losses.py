"""Counters of what typing and storing lose, beside the rows that they leave."""

import datetime as dt

from pyspark.sql import Observation
from pyspark.sql import functions as F

from tests.shop import order, rows, table
from tillwise import schemas
from tillwise.sources.losses import loss_table, typed_with_losses
from tillwise.sources.store import write_line_items
from tillwise.sources.tables import read_orders, typed_customers, typed_returns


def test_cells_of_a_sheet(spark):
    cells = [("2025-07-13", "Tea", "3", ""), ("n/a", "Tea", "1", ""), ("", "", " ", "")]
    cells += [(None, "Tea", "1,234", ""), ("07/13/2025", "Tea", "x", "")]
    sheet = spark.createDataFrame(cells, "Date string, `Product Name` string, Quantity string, Comments string")
    losses = Observation()
    typed = typed_returns(sheet, losses=losses)
    assert rows(typed) == rows(typed_returns(sheet)) and typed.columns == typed_returns(sheet).columns
    assert losses.get == {
        "rows_read": 5, "rows_dropped": 4, "unreadable_return_date": 1, "blank_return_date": 1,
        "unreadable_returned_quantity": 2, "blank_returned_quantity": 1,
    }


def test_items_of_arrays_and_a_name_that_clashes(spark):
    frame = spark.createDataFrame(
        [(["1", "x", None], 1), ([], 2), (None, 3)], "quantities array<string>, _raw int"
    )
    losses = Observation()
    number = F.transform("quantities", lambda item: item.try_cast("double"))
    typed = typed_with_losses(frame, {"quantities": number}, losses)
    assert sorted(typed.collect(), key=lambda r: r["_raw"])[0] == ([1.0, None, None], 1)
    assert losses.get == {"rows_read": 3, "unreadable_quantities": 1, "rows_dropped": 0}


def test_no_rows_and_nothing_to_type(spark):
    losses = Observation()
    empty = schemas.empty(spark, schemas.RETURNS_SHEET)
    assert typed_returns(empty, losses=losses).count() == 0
    assert set(losses.get.values()) == {0}
    losses = Observation()
    assert typed_with_losses(spark.range(4), {}, losses).count() == 4
    assert rows(loss_table(spark, losses)) == [("rows_dropped", 0), ("rows_read", 4)]


def test_readers_and_customers(spark, tmp_path):
    raw = table(spark, schemas.ORDERS, order(1, ["a"], [1.0]), order(2, ["b"], [2.0]))
    raw = raw.withColumn("total_order_value", F.when(F.col("order_id") == 1, "12.5").otherwise("12 or so"))
    raw.write.parquet(str(tmp_path / "orders"))
    losses = Observation()
    read = read_orders(spark, str(tmp_path / "orders"), losses=losses)
    assert rows(read, "order_id", "total_order_value") == rows(
        read_orders(spark, str(tmp_path / "orders")), "order_id", "total_order_value"
    )
    assert losses.get["unreadable_total_order_value"] == 1
    assert losses.get["rows_read"] == 2
    losses = Observation()
    people = spark.createDataFrame([("1", "no date"), ("2", None)], "customer_id string, signup_date string")
    assert typed_customers(people, losses).count() == 2
    assert losses.get["unreadable_signup_date"] == 1


def test_written_line_items_are_counted_in_the_job_that_writes(spark, tmp_path):
    day = dt.datetime(2024, 5, 1)
    data = [(1, day, "a"), (2, None, "b"), (3, day, None), (4, day, None)]
    items = spark.createDataFrame(data, "order_id long, order_date timestamp, product_sku string")
    losses = Observation()
    write_line_items(items, str(tmp_path / "items"), losses)
    assert losses.get == {"rows_written": 4, "without_date": 1, "without_product": 2}
    assert spark.read.parquet(str(tmp_path / "items")).count() == 4
