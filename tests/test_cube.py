"""Daily facts against the same results from orders, on rows with nulls, repeats and many products."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.shop import rows
from tillwise.operators.filters import filter_rows
from tillwise.plans.cube import (
    MEASURES,
    cube_by,
    cube_daily,
    cube_kpis,
    distinct_orders,
    read_cells,
    read_product_cells,
    write_cube,
)
from tillwise.plans.sales import daily_revenue, sales_kpis

SCHEMA = "order_id long, order_date timestamp, order_channel string, " + ", ".join(
    f"{name} double" for name in MEASURES
)
START, END = dt.date(2024, 1, 20), dt.date(2024, 3, 5)


def _tables(spark, n=3000, names=12):
    pick = random.Random(7)
    orders, pairs = [], []
    for i in range(n):
        order_id = None if i % 400 == 0 else i * 1_000_003
        day = None if i % 97 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(hours=pick.randrange(2400))
        money = [pick.choice([None, 0.1, 19.99, 1e10, -3.333333]) for _ in MEASURES]
        orders.append((order_id, day, pick.choice(["web", "app", None]), *money))
        pairs += [(order_id, f"p{pick.randrange(names)}") for _ in range(pick.randrange(5))]
    pairs += [(None, "p1"), (pairs[0][0], None)]
    return (
        spark.createDataFrame(orders, SCHEMA).repartition(7),
        spark.createDataFrame(pairs, "order_id long, product_name string"),
    )


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    orders, pairs = _tables(spark)
    path = str(tmp_path_factory.mktemp("cube"))
    write_cube(orders, pairs, path, ["order_channel"])
    return orders, pairs, path


@pytest.mark.parametrize("start, end", [(None, None), (START, END), (END, START)])
@pytest.mark.parametrize("channel", [None, "All", "web", "none such"])
def test_kpis_equal_those_of_orders(spark, shop, start, end, channel):
    orders, _, path = shop
    plain = filter_rows(orders, start, end, order_channel=channel)
    cells = read_cells(spark, path, start, end, order_channel=channel)
    columns = sales_kpis(plain).columns
    assert rows(cube_kpis(cells), *columns) == rows(sales_kpis(plain), *columns)
    assert rows(cube_daily(cells), "date", "revenue") == rows(daily_revenue(plain))


@pytest.mark.parametrize("product", ["p1", "none such"])
def test_kpis_of_a_product(spark, shop, product):
    orders, pairs, path = shop
    bought = pairs.where(F.col("product_name") == product).select("order_id")
    plain = filter_rows(orders, START, END).join(bought, "order_id", "left_semi")
    cells = read_cells(spark, path, START, END, product)
    columns = sales_kpis(plain).columns
    assert rows(cube_kpis(cells), *columns) == rows(sales_kpis(plain), *columns)
    counted = plain.where("order_channel is not null").groupBy("order_channel").count()
    assert rows(cube_by(cells, "order_channel"), "order_channel", "orders") == rows(counted)


def test_orders_of_several_products_count_once(spark, shop):
    orders, pairs, path = shop
    some = F.col("product_name").isin("p1", "p2", "p3", "p4")
    both = orders.join(pairs.where(some), "order_id")
    cells = read_product_cells(spark, path).where(some)
    assert rows(distinct_orders(cells)) == rows(both.agg(F.count_distinct("order_id")))
    per = both.groupBy("order_channel").agg(F.count_distinct("order_id"))
    assert rows(distinct_orders(cells, "order_channel")) == rows(per)
    assert rows(distinct_orders(cells.where("false"))) == [(0,)]
    assert cells.agg(F.sum("orders")).first()[0] > rows(distinct_orders(cells))[0][0]


def test_more_orders_than_one_bitmap_holds(spark, tmp_path):
    n = 70_000
    orders = spark.range(n).select(
        F.col("id").alias("order_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 50_000).alias("order_date"),
        F.lit("web").alias("order_channel"),
        *[F.lit(1.5).alias(name) for name in MEASURES],
    )
    names = F.explode(F.array(F.lit("a"), F.concat(F.lit("p"), F.col("id") % 3)))
    pairs = spark.range(n).select(F.col("id").alias("order_id"), names.alias("product_name"))
    write_cube(orders, pairs, str(tmp_path), ["order_channel"])
    cells = read_product_cells(spark, str(tmp_path))
    assert rows(distinct_orders(cells)) == [(n,)]
    assert cells.select("bucket").distinct().count() == 3
    assert cells.groupBy("date", "product_name").count().count() <= 8


def test_a_month_is_written_anew_and_others_keep_their_files(spark, tmp_path):
    orders, pairs = _tables(spark, 600)
    path = str(tmp_path / "cube")

    def files():
        return {f.name for f in Path(path).rglob("*.parquet") if "-02-01" not in str(f)}

    early = "coalesce(order_id % 2, 0) = 0 or coalesce(month(order_date), 0) <> 2"
    write_cube(orders.where(early), pairs, path, ["order_channel"])
    before = files()
    write_cube(orders.where("month(order_date) = 2"), pairs, path, ["order_channel"])
    assert files() == before
    columns = sales_kpis(orders).columns
    assert rows(cube_kpis(read_cells(spark, path)), *columns) == rows(sales_kpis(orders), *columns)
    counted = orders.join(pairs, "order_id").dropna(subset=["product_name"])
    found = distinct_orders(read_product_cells(spark, path))
    assert rows(found) == rows(counted.agg(F.count_distinct("order_id")))


def test_no_orders_and_names_that_clash(spark, tmp_path):
    orders, pairs = _tables(spark, 5)
    write_cube(orders.limit(0), pairs, str(tmp_path), ["order_channel"])
    with pytest.raises(ValueError, match="bucket"):
        write_cube(orders.withColumn("Bucket", F.lit(1)), pairs, str(tmp_path), ["Bucket"])


def test_only_the_months_of_a_period_are_read(spark, shop):
    _, _, path = shop
    plan = cube_kpis(read_cells(spark, path, START, END))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(order_month" in plan
    assert "bits" not in plan


def test_a_cell_is_as_large_as_its_orders_need(spark, shop):
    orders, pairs, path = shop
    cells = read_product_cells(spark, path)
    assert dict(cells.dtypes)["bits"] == "bigint"
    assert cells.where(F.bit_count("bits") != F.col("orders")).count() == 0
    sold = orders.join(pairs.dropna().distinct(), "order_id")
    assert cells.agg(F.sum("orders")).first()[0] == sold.count()


def test_buckets_are_summed_and_written_without_another_shuffle(spark, tmp_path):
    n = 70_000
    clock = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)
    money = [F.lit(0.5).alias(name) for name in MEASURES]
    orders = spark.range(n).select(F.col("id").alias("order_id"), clock.alias("order_date"), F.lit("w").alias("c"), *money)
    pairs = orders.select("order_id", F.lit("a").alias("product_name"))
    write_cube(orders, pairs, str(tmp_path), ["c"])
    placed = read_product_cells(spark, str(tmp_path)).select("order_month", "bucket", F.input_file_name().alias("file"))
    per_month = placed.distinct().groupBy("order_month")
    files = per_month.agg(F.count_distinct("file").alias("files"), F.count_distinct("bucket").alias("buckets"))
    assert all(row.files <= row.buckets for row in files.collect())
    # Every bucket of a month is whole in one file.
    assert placed.distinct().groupBy("order_month", "bucket").count().where("count > 1").count() == 0
