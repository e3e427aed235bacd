import contextlib
import datetime as dt
import io
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.shop import order, orders, product, products, rows
from tillwise import schemas
from tillwise.functions.numbers import exact_sum
from tillwise.operators.line_items import (
    derived_columns,
    join_orders_and_products,
    join_products,
    last_sku_lines,
    line_items,
    order_lines,
    order_totals,
    sku_sales,
)
from tillwise.operators.orders import lines_of_product, one_row_per_order, order_rows
from tillwise.plans import geo, products as product_plans, referrers, sales

LINE = ("order_id", "order_product_sku", "order_product_id", "quantity")


def test_shortest_array_decides(spark):
    raw = orders(
        spark,
        {
            "order_id": "o",
            "product_sku": ["a", "b", "c"],
            "product_ids": ["1", "2"],
            "quantities": [5.0, 6.0, 7.0],
        },
    )
    assert rows(order_lines(raw), *LINE) == [("o", "a", "1", 5.0), ("o", "b", "2", 6.0)]


def test_orders_without_lines_disappear(spark):
    raw = orders(spark, order("a", [], []), order("b", None, [1.0]), order("c", ["x"], [1.0]))
    assert rows(order_lines(raw), "order_id") == [("c",)]
    assert rows(order_rows(raw, ["total_order_value"]), "order_id") == [("c",)]


def test_line_item_columns(spark):
    items = line_items(orders(spark), products(spark))
    derived = [
        "line_item_revenue",
        "extracted_status",
        "cleaned_referring_site",
        "product_tags_list",
        "product_tags_compound",
        "imputed_customer_type",
    ]
    assert sorted(items.columns) == sorted([*schemas.LINE_ITEM_COLUMNS, *derived])
    assert len(schemas.LINE_ITEM_COLUMNS) == 39
    assert items.count() == 0


def test_product_without_tags_or_sku_matches_nothing(spark):
    items = line_items(
        orders(spark, order("o", ["a", "b"], [1.0, 2.0])),
        products(spark, product("no tags", ["a"], []), product("no sku", [], ["t"])),
    )
    got = rows(items, "order_product_sku", "product_name", "product_sku", "product_tags_compound")
    assert got == [("a", None, None, "Unknown Tag"), ("b", None, None, "Unknown Tag")]
    assert [r[0] for r in rows(items, "product_tags_list")] == [[], []]


def test_shared_sku_and_tags_fan_out(spark):
    items = line_items(
        orders(spark, order("o", ["a"], [2.0], order_status_from_tag="sent", customer_type="new")),
        products(spark, product("p", ["a", "z"], ["t", ""]), product("q", ["a"], ["u"], 3.0)),
    )
    got = rows(items, "product_name", "individual_product_tag", "line_item_revenue")
    assert got == [("p", "", 20.0), ("p", "t", 20.0), ("q", "u", 6.0)]
    assert rows(items, "product_tags_compound", "product_tags_list")[0] == ("", [])
    assert set(rows(items, "extracted_status", "imputed_customer_type")) == {("sent", "new")}


def test_fallbacks_for_missing_columns(spark):
    bare = spark.createDataFrame([("o",)], "order_id string")
    row = derived_columns(bare).first()
    assert row.line_item_revenue == 0
    assert row.extracted_status == "N/A (Status Tag Missing)"
    assert row.cleaned_referring_site == "N/A (Site Data Missing)"
    assert row.product_tags_compound == "N/A (Tags Missing)"
    assert row.imputed_customer_type == "N/A (Customer Type Missing)"
    assert row.product_tags_list == []


def test_three_tags_count_three_times(spark):
    raw = orders(spark, order("o", ["a"], [2.0], total_order_value=25.0))
    catalog = products(spark, product("p", ["a"], ["t", "u", "v"]))
    kpis = product_plans.product_kpis(line_items(raw, catalog)).first()
    assert (kpis.total_products_sold, kpis.total_product_revenue) == (6.0, 60.0)
    orders_kpis = sales.sales_kpis(one_row_per_order(line_items(raw, catalog))).first()
    assert (orders_kpis.total_revenue, orders_kpis.total_orders) == (25.0, 1)


def test_null_order_ids_are_one_row(spark):
    raw = orders(
        spark,
        order(None, ["a"], [1.0], total_order_value=5.0),
        order(None, ["b"], [1.0], total_order_value=5.0),
        order("o", ["a"], [1.0], total_order_value=7.0),
    )
    grain = one_row_per_order(line_items(raw, products(spark)))
    assert grain.count() == 2
    kpis = sales.sales_kpis(grain).first()
    assert (kpis.total_revenue, kpis.total_orders, kpis.average_order_value) == (12.0, 1, 12.0)


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="product_ids"):
        order_lines(orders(spark).drop("product_ids"))
    with pytest.raises(ValueError, match="order_id"):
        sales.sales_kpis(orders(spark).drop("order_id"))


@pytest.fixture(scope="module")
def random_shop(spark):
    """Shared, unknown and null SKUs, null quantities and prices, products without tags."""
    pick = random.Random(7)
    skus = ["s1", "s2", "s3", "s4", "s5", "none", None]
    day = dt.datetime(2025, 1, 1)
    raw = []
    for i in range(200):
        n = pick.randint(0, 5)
        city = pick.choice(["A", "B", None])
        raw.append(
            order(
                f"o{i}",
                [pick.choice(skus) for _ in range(n)],
                [pick.choice([None, 1.0, 2.0, 2.5]) for _ in range(n)],
                order_date=day + dt.timedelta(hours=pick.randint(0, 200)),
                total_order_value=float(pick.randint(1, 50)),
                geography_city=city,
                geography_state="S",
                shipping_address_latitude=pick.choice([1.0, 2.0, None]),
                shipping_address_longitude=3.0,
                referring_site=pick.choice([None, "", "https://a.com", "https://b.com"]),
            )
        )
    catalog = [
        product("p1", ["s1", "s2"], ["t", "u"], 9.99, stock_available=5.0),
        product("p2", ["s1"], ["t"], None, stock_available=50.0),
        product("p2", ["s3"], ["u", "v", "w"], 1.25),
        product("p4", ["s4"], [], 7.0),
        product("p5", ["s5"], ["t"], 0.1, stock_available=21.0),
    ]
    return orders(spark, *raw).repartition(5).cache(), products(spark, *catalog)


def test_sku_sales_give_the_line_item_sums(spark, random_shop):
    raw, catalog = random_shop
    full = line_items(raw, catalog)
    lines = order_lines(raw)
    for plan in (product_plans.top_products_revenue, product_plans.top_products_quantity):
        assert rows(plan(sku_sales(lines, catalog))) == rows(plan(full))
    by_tag = sku_sales(lines, catalog, per_tag=True)
    for plan in (
        product_plans.top_tags_revenue,
        product_plans.tag_quantity_share,
        product_plans.product_kpis,
    ):
        assert rows(plan(by_tag)) == rows(plan(full))
    by_city = sku_sales(lines, catalog, ["geography_city"])
    assert rows(geo.city_revenue(by_city)) == rows(geo.city_revenue(full))


def test_order_totals_give_the_line_item_sums(spark, random_shop):
    raw, catalog = random_shop
    full = line_items(raw, catalog)
    lines = order_lines(raw)
    columns = ["order_date", "referring_site", "geography_state", *geo.POINT]
    head = order_rows(raw, columns)
    totals = head.join(order_totals(lines, catalog), "order_id")
    for plan in (
        product_plans.daily_product_revenue,
        product_plans.daily_quantity,
        geo.city_revenue,
        geo.state_revenue,
        geo.state_orders,
        geo.city_orders,
        referrers.raw_referrer_counts,
        referrers.raw_referrers,
    ):
        assert rows(plan(totals)) == rows(plan(full)), plan.__name__
    priced = head.join(order_totals(lines, catalog, priced_only=True), "order_id")
    assert rows(geo.map_points(priced)) == rows(geo.map_points(full))


def test_order_rows_equal_the_line_item_route(spark, random_shop):
    raw, catalog = random_shop
    columns = ["total_order_value", "geography_city"]
    wide = one_row_per_order(line_items(raw, catalog), columns)
    assert rows(order_rows(raw, columns)) == rows(wide)
    lines = order_lines(raw).select(*LINE)
    assert rows(order_rows(raw, columns, lines)) == rows(wide)


def test_orders_with_a_product(spark, random_shop):
    raw, catalog = random_shop
    full = line_items(raw, catalog).where(F.col("product_name") == "p2")
    hits = lines_of_product(order_lines(raw), catalog, "p2").select(*LINE)
    got = order_rows(raw, ["total_order_value"], hits)
    assert rows(got) == rows(one_row_per_order(full, ["total_order_value"]))


def test_low_stock(spark, random_shop):
    raw, catalog = random_shop
    short = last_sku_lines(order_lines(raw), catalog)
    assert rows(product_plans.low_stock(short)) == rows(
        product_plans.low_stock(line_items(raw, catalog))
    )


def test_stock_limits(spark):
    stock = [("a", None), ("b", 20.0), ("c", 20.9), ("d", 21.0)]
    raw = orders(spark, *[order(sku, [sku], [1.0]) for sku, _ in stock])
    catalog = products(
        spark, *[product(sku, [sku], ["t"], stock_available=left) for sku, left in stock]
    )
    listed = product_plans.low_stock(line_items(raw, catalog))
    assert [tuple(r) for r in listed.collect()] == [("a", "a", 0), ("b", "b", 20), ("c", "c", 20)]


def test_shares_and_days_add_up(spark, random_shop):
    raw, catalog = random_shop
    full = line_items(raw, catalog)
    shares = product_plans.tag_quantity_share(full).agg(F.sum("share_pct")).first()[0]
    assert shares == pytest.approx(100)
    grain = one_row_per_order(full)
    daily = sales.daily_revenue(grain).agg(exact_sum("revenue")).first()[0]
    assert daily == pytest.approx(sales.sales_kpis(grain).first().total_revenue, rel=1e-12)


def test_result_does_not_depend_on_row_order(spark, random_shop):
    raw, catalog = random_shop
    shuffled = raw.orderBy(F.xxhash64("order_id")).repartition(3, "geography_city")
    a, b = line_items(raw, catalog), line_items(shuffled, catalog)
    for plan in (product_plans.low_stock, product_plans.top_tags_revenue, geo.map_points):
        assert rows(plan(a)) == rows(plan(b))


def _split(lines):
    """Orders and lines as two tables; an order that has no line, and lines without an order."""
    orders = lines.drop("order_product_sku", "order_product_id", "quantity").distinct()
    orders = orders.withColumn("order_id", F.nullif("order_id", F.lit("o7")))
    return orders, lines.select("order_id", "order_product_sku", "order_product_id", "quantity")


def test_lines_that_meet_products_first_give_the_same_table(spark, random_shop):
    raw, catalog = random_shop
    orders_, lines = _split(order_lines(raw))
    # Orders that come twice, tags that are null, SKUs that come twice.
    orders_ = orders_.union(orders_.where("order_id = 'o3'"))
    catalog = catalog.union(catalog.where("product_name = 'p2'").withColumn("product_tags", F.array(F.lit(None), F.lit(""))))
    got = join_orders_and_products(orders_, lines, catalog)
    want = join_products(orders_.join(lines, "order_id"), catalog)
    assert got.columns == want.columns and got.count() > 100
    assert Counter(map(str, got.collect())) == Counter(map(str, want.collect()))


def test_no_line_is_shuffled_with_the_columns_of_its_order(spark, random_shop):
    raw, catalog = random_shop
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        items = join_orders_and_products(*_split(order_lines(raw)), catalog)
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            items.explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    shuffled = [part for part in plan.getvalue().split("\n\n") if re.match(r"\s*\(\d+\) Exchange", part)]
    assert len(shuffled) >= 4
    assert not any("geography_city" in part and "order_product_sku" in part for part in shuffled)
