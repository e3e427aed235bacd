"""Stored tables, and what the physical plans must and must not hold."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tillwise.registry.queries import all_queries as queries
from tests.shop import order, orders, product, products, rows
from tillwise.operators.filters import date_range
from tillwise.operators.line_items import line_items, order_lines, order_totals
from tillwise.sources.store import materialize, read_line_items, read_rfm, write_line_items, write_rfm
from tillwise.sources.tables import read_customers, read_orders, read_products

FOLDER = "/root/testdata/sf0.001"
START, END = dt.date(2025, 2, 10), dt.date(2025, 3, 5)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def shop(spark):
    days = [dt.datetime(2025, 1, 1) + dt.timedelta(days=i, hours=i % 24) for i in range(120)]
    raw = orders(spark, *[order(f"o{i}", ["a"], [1.0], order_date=d) for i, d in enumerate(days)])
    return raw, products(spark, product("p", ["a"], ["t"]))


def test_stored_line_items(spark, shop, tmp_path):
    items = line_items(*shop)
    path = str(tmp_path / "items")
    write_line_items(items, path)
    assert rows(read_line_items(spark, path), *items.columns) == rows(items)
    part = read_line_items(spark, path, START, END)
    assert rows(part, "order_id") == rows(date_range(items, "order_date", START, END), "order_id")
    plan = _plan(part)
    assert re.search(r"PartitionFilters: \[[^\]]*order_month", plan)
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(order_date", plan)
    assert read_line_items(spark, path, END, START).count() == 120


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata", "America/Los_Angeles"])
def test_stored_months_in_any_zone(spark, shop, tmp_path, zone):
    path = str(tmp_path / "items")
    write_line_items(line_items(*shop), path)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for start, end in [(START, END), (dt.date(2025, 2, 1), dt.date(2025, 2, 28))]:
            want = date_range(spark.read.parquet(path), "order_date", start, end)
            assert rows(read_line_items(spark, path, start, end), "order_id") == rows(want, "order_id")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_a_refresh_keeps_other_months(spark, shop, tmp_path):
    items, path = line_items(*shop), str(tmp_path / "items")
    write_line_items(items, path)
    write_line_items(items.where("order_date >= '2025-03-01' and order_date < '2025-03-11'"), path)
    kept = "order_date < '2025-03-11' or order_date >= '2025-04-01'"
    assert rows(read_line_items(spark, path), "order_id") == rows(items.where(kept), "order_id")


def test_stored_rfm(spark, tmp_path):
    customers = spark.range(9).selectExpr("id as customer_id", "concat('s', id % 3) as RFM_Segment")
    path = str(tmp_path / "rfm")
    write_rfm(customers, path)
    assert rows(read_rfm(spark, path), "customer_id", "RFM_Segment") == rows(customers)
    one = read_rfm(spark, path, "s1")
    assert rows(one, "customer_id") == [(1,), (4,), (7,)]
    assert re.search(r"PartitionFilters: \[[^\]]*RFM_Segment", _plan(one))


def test_readers_pick_columns(spark, shop, tmp_path):
    raw, catalog = shop
    raw.withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "orders"))
    catalog.write.parquet(str(tmp_path / "products"))
    raw.selectExpr("customer_id", "email").write.parquet(str(tmp_path / "customers"))
    assert read_orders(spark, str(tmp_path / "orders")).columns == raw.columns
    assert read_products(spark, str(tmp_path / "products")).columns == catalog.columns
    assert "imputed_customer_type" in read_customers(spark, str(tmp_path / "customers")).columns
    with pytest.raises(ValueError, match="order_date"):
        read_orders(spark, str(tmp_path / "products"))


def test_readers_type_text(spark, tmp_path):
    raw = orders(spark, order("o", ["a", "b"], [1.0, 2.0], total_order_value=5.0))
    text = raw.withColumn("quantities", F.array(F.lit("2"), F.lit("5d")))
    text = text.withColumn("total_order_value", F.lit(" 7.5 "))
    text = text.withColumn("order_date", F.lit("2025-07-13"))
    text.write.parquet(str(tmp_path / "text"))
    got = read_orders(spark, str(tmp_path / "text"))
    assert rows(got, "quantities", "total_order_value", "order_date") == [
        ([2.0, None], 7.5, dt.datetime(2025, 7, 13))
    ]


def test_materialize_reads_a_stored_table(spark):
    stored = materialize(spark.range(10).withColumn("v", F.col("id") * 2), "test")
    assert "Scan ExistingRDD" in _plan(stored)
    assert stored.agg(F.sum("v")).first()[0] == 90


def test_date_filter_passes_the_explode_and_the_join(spark, shop, tmp_path):
    raw, catalog = shop
    raw.write.parquet(str(tmp_path / "o"))
    items = line_items(spark.read.parquet(str(tmp_path / "o")), catalog)
    plan = _plan(date_range(items, "order_date", START, END).select("order_id", "quantity"))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(order_date", plan)
    schema = re.search(r"ReadSchema: struct<([^\n]*)", plan).group(1)
    assert "email" not in schema and "referring_site" not in schema


def test_referrers_are_named_in_generated_code(spark):
    result = queries()["referrer_names"](spark, FOLDER)
    result.collect()
    last = _plan(result).split("== Initial Plan ==")[0]
    assert re.search(r"\*\(\d+\) Project \[[^\n]*cleaned_referring_site", last)


def test_orders_are_read_once(spark):
    plan = _plan(queries()["home_kpis"](spark, FOLDER))
    assert len(re.findall(r"FileScan parquet [^\n]*o_orderkey", plan)) == 1


def test_period_reaches_the_scan(spark):
    plan = _plan(queries()["sales_kpis_period"](spark, FOLDER))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", plan)


@pytest.mark.parametrize(
    "name", ["top_products_revenue", "state_revenue", "top_customers", "top_return_comments"]
)
def test_top_k_is_no_global_sort(spark, name):
    plan = _plan(queries()[name](spark, FOLDER))
    assert "TakeOrderedAndProject" in plan
    assert "rangepartitioning" not in plan


def test_only_totals_go_through_one_partition(spark):
    # The queries that gather everything do so on aggregated rows.
    for name in ("daily_revenue", "map_points", "top_tags_revenue", "returns_vs_sales"):
        assert "SinglePartition" not in _plan(queries()[name](spark, FOLDER)), name
    for name in ("sales_kpis", "product_kpis", "geo_kpis", "return_kpis"):
        plan = _plan(queries()[name](spark, FOLDER))
        for below in re.findall(r"Exchange SinglePartition[^\n]*\n([^\n]*)", plan):
            assert "Aggregate" in below, name


def test_no_cross_joins_and_no_python(spark):
    for name, query in queries().items():
        if name.startswith("rfm") and name != "rfm_segment_averages":
            continue
        plan = _plan(query(spark, FOLDER))
        for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
            assert word not in plan, (name, word)


@pytest.fixture
def skew_settings(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "20",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.fixture(scope="module")
def hot_shop(spark):
    """A third of all lines have one SKU, which several products share."""
    sku = F.when(F.col("id") % 3 == 0, "s0").otherwise(F.concat(F.lit("s"), F.col("id") % 997))
    lines = spark.range(0, 300_000, 1, 12).select(
        (F.col("id") / 5).cast("long").alias("order_id"),
        sku.alias("order_product_sku"),
        F.col("id").alias("order_product_id"),
        F.lit(1.0).alias("quantity"),
    )
    shared = F.when(F.col("id") < 20, "s0").otherwise(F.concat(F.lit("s"), F.col("id")))
    catalog = spark.range(1000).select(
        F.array(shared).alias("product_sku"),
        F.array(F.lit("t"), F.lit("u")).alias("product_tags"),
        F.concat(F.lit("p"), F.col("id")).alias("product_name"),
        F.lit(2.0).alias("price"),
    )
    return lines, catalog


def test_hot_sku_does_not_multiply_rows(spark, hot_shop, skew_settings):
    lines, catalog = hot_shop
    totals = order_totals(lines, catalog)
    got = totals.agg(F.sum("quantity"), F.sum("line_item_revenue"), F.sum("line_rows"), F.count("*"))
    hot = lines.where("order_product_sku = 's0'").count()
    known = lines.join(
        catalog.where("product_sku[0] <> 's0'").selectExpr("product_sku[0] as order_product_sku"),
        "order_product_sku",
    ).count()
    unknown = 300_000 - hot - known
    quantity = hot * 40 + known * 2 + unknown
    # The hot SKU has 20 products with 2 tags each.
    assert tuple(got.first()) == (quantity, (hot * 40 + known * 2) * 2.0, quantity, 60_000)


def test_hot_sku_is_split_in_the_join(spark, hot_shop, skew_settings):
    totals = order_totals(*hot_shop)
    totals.collect()
    assert "skew=true" in _plan(totals)


def test_order_lines_stay_narrow(spark, shop):
    plan = _plan(order_lines(shop[0]).select("order_id"))
    assert "Exchange" not in plan
