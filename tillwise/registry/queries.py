"""Every operator as a query over the tables of one folder.

Sums over lines go through ``sku_sales`` or ``order_totals``; order-level results start from
the orders table. All give what the full line-item table gives, without building it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formats import amount, count_text, currency, percent_text, short_number
from ..operators import filters
from ..operators.choices import Cascade, cascading_choices
from ..operators.hot_keys import frequent_keys
from ..operators.line_items import (
    derived_columns,
    join_orders_and_products,
    last_sku_lines,
    order_lines,
    order_tasks,
    order_totals,
    product_skus,
    sku_sales,
    with_source,
)
from ..operators.line_items import line_items as build_line_items
from ..operators.orders import lines_of_product, one_row_per_order, order_rows
from ..plans import cube, customers, geo, products, referrers, returns, rfm, sales
from ..plans.rfm_state import read_rfm_scores, update_rfm
from ..sources.bucketed import (
    lines_per_order,
    orders_with_lines,
    read_by_order,
    store_by_order,
)
from ..sources.losses import loss_table
from ..sources.refresh import refresh_by_month
from ..sources.star import STORES, StarShop
from ..sources.store import SMALL, new_path, read_line_items, shuffles_freed, write_line_items
from ..sources.tables import (
    read_orders,
    read_products,
    read_returns,
    typed_returns,
    unreadable_returns,
)

Query = Callable[[SparkSession, str], DataFrame]
START, END = dt.date(1996, 1, 1), dt.date(1998, 12, 31)
PRODUCT = "red widget"
TAG = "ECONOMY"
MONEY = ("total_order_value", "discount_amount", "tax_amount", "shipping_cost")
# Orders a turn holds at least, and the most turns: each reads the tables anew.
ORDERS_A_TURN = 1_000_000
MOST_TURNS = 2

_registry: dict[str, Query] = {}


def _query(plan: Callable[[StarShop], DataFrame]) -> Callable[[StarShop], DataFrame]:
    """Register a query under the name of its function, with its doubles rounded.

    The operators round nothing on the way; 6 digits of a result are what two engines that add
    up in different orders agree on.
    """
    _registry[plan.__name__] = lambda spark, folder: _rounded(plan(StarShop(spark, folder)))
    return plan


def _rounded(df: DataFrame) -> DataFrame:
    doubles = [field.name for field in df.schema if field.dataType == T.DoubleType()]
    return df.withColumns({name: F.round(name, 6) for name in doubles})


def _orders(shop: StarShop, *columns: str, **options) -> DataFrame:
    """One row per order that has lines; the table of orders has one row for each."""
    return order_rows(shop.orders(**options), columns, shop.lines(), unique=True)


def _sales(shop: StarShop, *keys: str, per_tag: bool = False, **options) -> DataFrame:
    """Line sums per SKU and order columns; order dates are cut to days first."""
    if not keys:
        return sku_sales(shop.lines(), shop.products(), per_tag=per_tag)
    lines = shop.order_lines(**options).withColumn("order_date", F.to_date("order_date"))
    return sku_sales(lines, shop.products(), keys, per_tag)


def _order_totals(
    shop: StarShop, *columns: str, priced_only: bool = False, **options
) -> DataFrame:
    """Line sums per order next to order columns."""
    tasks = order_tasks(shop.table("orders"))
    totals = order_totals(shop.lines(), shop.products(), priced_only, tasks=tasks)
    orders = one_row_per_order(shop.orders(**options), columns, unique=True)
    return orders.join(totals, "order_id")


def _line_items(shop: StarShop) -> DataFrame:
    """The full line-item table."""
    orders = with_source(shop.orders(geography=True, referrers=True), STORES)
    return join_orders_and_products(orders, shop.lines(), shop.products(), STORES)


# Line items


@_query
def line_items(shop):
    return _line_items(shop).drop("product_tags_list")


@_query
def order_lines_from_arrays(shop):
    # Arrays of different lengths, some empty or null, made within each row.
    part, number = F.col("l_partkey"), F.col("l_linenumber") % 4
    skus = F.transform(
        F.sequence(F.lit(1), number), lambda i: F.concat(F.lit("SKU-"), (part + i).cast("string"))
    )
    quantities = F.array(*[F.col("l_quantity") + i for i in range(3)])
    orders = shop.table("lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.when(number > 0, skus).alias("product_sku"),
        F.array(part + 1, part + 2).alias("product_ids"),
        F.when(F.col("l_suppkey") % 5 != 0, quantities)
        .otherwise(F.array().cast("array<double>"))
        .alias("quantities"),
    )
    return order_lines(orders)


def _written(shop: StarShop, rows: DataFrame, name: str, turns: int = 1) -> DataFrame:
    """``rows`` as a stored table, for batches that are parts of it and are read several times.

    All rows of an order are written in one of ``turns``, each a query of its own, so that only what
    one of them shuffles is on disk at a time.
    """
    path = new_path(shop.spark, name)
    place = F.pmod(F.xxhash64("order_id"), F.lit(turns))
    with shuffles_freed(shop.spark):
        for turn in range(turns):
            part = rows if turns == 1 else rows.where(place == turn)
            part.write.mode("append").option("compression", SMALL).parquet(path)
    return shop.spark.read.parquet(path)


def _turns(shop: StarShop) -> int:
    """In how many turns a table of all lines is made; the rows of a stored table cost no scan."""
    return min(MOST_TURNS, 1 + shop.table("orders").count() // ORDERS_A_TURN)


def _shop_of_arrays(shop: StarShop) -> tuple[DataFrame, DataFrame]:
    """Orders with arrays and products with several SKUs, written and read as tables."""
    paths = [new_path(shop.spark, name) for name in ("orders", "products")]
    shop.array_orders().write.parquet(paths[0])
    shop.two_sku_products().write.parquet(paths[1])
    return read_orders(shop.spark, paths[0]), read_products(shop.spark, paths[1])


@_query
def line_items_of_arrays(shop):
    items = build_line_items(*_shop_of_arrays(shop), STORES)
    joined = F.array_join("product_tags_list", "|").alias("tags")
    names = ("order_id", "order_product_sku", "order_product_id", "quantity", "product_sku")
    derived = ("line_item_revenue", "extracted_status", "cleaned_referring_site")
    last = ("product_tags_compound", "imputed_customer_type", "total_order_value")
    return items.select(*names, "product_name", *derived, *last, joined)


@_query
def sales_kpis_of_arrays(shop):
    return sales.sales_kpis(order_rows(_shop_of_arrays(shop)[0], MONEY))


@_query
def line_items_by_line(shop):
    items = build_line_items(*_shop_of_arrays(shop), STORES, grain="line")
    names = ("order_id", "line_number", "order_product_sku", "quantity", "product_name", "price")
    return items.select(
        *names, "line_item_revenue", "cleaned_referring_site", "product_tags_compound"
    )


# Stored tables


@_query
def line_items_refreshed(shop):
    # Some orders are stored in an older form first, some come late, some come again from before.
    items = _line_items(shop).select(
        "order_id", "order_date", "order_updated_at", "order_product_sku", "quantity",
        "total_order_value", "line_item_revenue", "product_tags_compound",
    )
    items = _written(shop, items, "batches", _turns(shop))
    path = new_path(shop.spark, "line-items")
    late, changed, stale = (F.col("order_id") % n == 0 for n in (5, 7, 11))
    older = items.withColumns(
        {
            "order_date": F.expr("order_date - interval 40 days"),
            "order_updated_at": F.expr("order_updated_at - interval 1 day"),
            "total_order_value": F.col("total_order_value") / 2,
        }
    )
    first = items.where(~late & ~changed).union(older.where(~late & changed))
    for batch in (first, items.where(late | changed), older.where(stale)):
        refresh_by_month(batch, path).remove()
    return read_line_items(shop.spark, path)


@_query
def line_items_written(shop):
    losses = Observation("line items")
    items = _line_items(shop).select("order_id", "order_date", "product_sku", "quantity")
    write_line_items(items, new_path(shop.spark, "line-items"), losses)
    return loss_table(shop.spark, losses)


def _by_order(shop: StarShop) -> tuple[DataFrame, DataFrame]:
    """Orders and lines, written as bucketed tables and read again."""
    path = new_path(shop.spark, "by-order")
    name = "by_order_" + path.rsplit("-", 1)[-1]
    orders = shop.orders().select("order_id", "order_channel", *MONEY)
    store_by_order(orders, shop.lines(), name, path)
    return read_by_order(shop.spark, name)


@_query
def sales_kpis_by_order(shop):
    return sales.sales_kpis(orders_with_lines(*_by_order(shop)))


@_query
def lines_of_orders(shop):
    orders, lines = _by_order(shop)
    return lines_per_order(orders.select("order_id", "total_order_value"), lines)


@_query
def rfm_of_batches(shop):
    # Some orders come first with another customer and a later date than they have.
    orders = _orders(shop, "customer_id", "order_date", "total_order_value", "updated_at")
    orders = _written(shop, orders, "batches")
    path = new_path(shop.spark, "rfm-state")
    late, changed = F.col("order_id") % 3 == 0, F.col("order_id") % 7 == 0
    before = orders.withColumns(
        {
            "customer_id": F.lit(1).cast("bigint"),
            "order_date": F.expr("order_date + interval 400 days"),
            "updated_at": F.expr("updated_at - interval 1 day"),
        }
    )
    update_rfm(orders.where(~late & ~changed).unionByName(before.where(~late & changed)), path)
    update_rfm(orders.where(late & ~changed), path)
    update_rfm(orders.where(changed), path)
    update_rfm(before.where(late), path)
    return read_rfm_scores(shop.spark, path).drop("RFM_Score", "RFM_Segment")


@_query
def line_items_without_columns(shop):
    # What stands for columns that the source lacks.
    lacking = shop.lines().select("order_id", "quantity")
    return derived_columns(lacking).withColumn(
        "product_tags_list", F.array_join("product_tags_list", "|")
    )


@_query
def product_tags_by_sku(shop):
    return product_skus(shop.products()).select(
        "product_sku", "product_name", F.explode("product_tags").alias("individual_product_tag")
    )


@_query
def orders_in_scope(shop):
    scope = filters.filter_rows(_line_items(shop), START, END, product_tags_compound=TAG)
    return one_row_per_order(scope, ["customer_id", "geography_city", "total_order_value"])


# Sales


@_query
def sales_kpis(shop):
    return sales.sales_kpis(_orders(shop, *MONEY))


@_query
def sales_kpis_period(shop):
    orders = _orders(shop, "order_date", *MONEY, start=START, end=END)
    return sales.sales_kpis(filters.filter_rows(orders, START, END))


@_query
def sales_kpis_reversed_range(shop):
    orders = _orders(shop, "order_date", *MONEY)
    return sales.sales_kpis(filters.filter_rows(orders, END, START))


@_query
def sales_kpis_empty(shop):
    orders = _orders(shop, "order_channel", *MONEY)
    return sales.sales_kpis(filters.keep_equal(orders, order_channel="no such channel"))


@_query
def sales_kpis_filtered(shop):
    orders = _orders(
        shop, "order_channel", "discount_applied", "referring_site", *MONEY, referrers=True
    )
    orders = with_source(orders, STORES)
    return sales.sales_kpis(
        filters.filter_rows(
            orders,
            product=None,
            order_channel="web",
            cleaned_referring_site="Example",
            discount_applied=filters.ALL,
        )
    )


@_query
def sales_kpis_product(shop):
    lines = lines_of_product(shop.lines(), shop.products(), PRODUCT)
    return sales.sales_kpis(order_rows(shop.orders(), MONEY, lines))


@_query
def home_kpis(shop):
    orders = _orders(
        shop, "order_date", "customer_id", "total_order_value", start=START, end=END
    )
    return sales.home_kpis(orders, shop.customers(), START, END)


@_query
def daily_revenue(shop):
    return sales.daily_revenue(_orders(shop, "order_date", "total_order_value"))


@_query
def daily_orders(shop):
    return sales.daily_orders(_orders(shop, "order_date"))


@_query
def revenue_by_channel(shop):
    return sales.revenue_by_channel(_orders(shop, "order_channel", "total_order_value"))


@_query
def revenue_by_status(shop):
    return sales.revenue_by_status(_orders(shop, "order_status_from_tag", "total_order_value"))


@_query
def top_referrers(shop):
    orders = _orders(shop, "referring_site", "total_order_value", referrers=True)
    sites = sales.revenue_by_site(orders)
    return sales.top_referrers(with_source(sites, STORES))


@_query
def discount_summary(shop):
    return sales.discount_summary(_orders(shop, "discount_applied", "discount_amount"))


@_query
def top_discounts(shop):
    return sales.top_discounts(_orders(shop, "discount_applied", "discount_amount"))


@_query
def top_discounts_by_uses(shop):
    orders = _orders(shop, "discount_applied", "discount_amount")
    return sales.top_discounts(orders, by="number_of_uses")


# Products


@_query
def product_kpis(shop):
    return products.product_kpis(_sales(shop))


@_query
def product_kpis_tag(shop):
    lines = _sales(shop, "order_date", per_tag=True, start=START, end=END)
    return products.product_kpis(
        filters.filter_rows(lines, START, END, product_tags_compound=TAG)
    )


@_query
def top_products_revenue(shop):
    return products.top_products_revenue(_sales(shop))


@_query
def top_products_quantity(shop):
    return products.top_products_quantity(_sales(shop))


@_query
def top_tags_revenue(shop):
    return products.top_tags_revenue(_sales(shop, per_tag=True))


@_query
def top_tags_quantity(shop):
    return products.top_tags_quantity(_sales(shop, per_tag=True))


@_query
def tag_revenue_share(shop):
    return products.tag_revenue_share(_sales(shop, per_tag=True))


@_query
def tag_quantity_share(shop):
    return products.tag_quantity_share(_sales(shop, per_tag=True))


@_query
def daily_product_revenue(shop):
    return products.daily_product_revenue(_sales(shop, "order_date"))


@_query
def daily_quantity(shop):
    return products.daily_quantity(_sales(shop, "order_date"))


@_query
def low_stock(shop):
    return products.low_stock(last_sku_lines(shop.order_lines(), shop.products()))


# Customers


@_query
def customers_typed(shop):
    return shop.customers()


@_query
def customer_kpis(shop):
    return customers.customer_kpis(shop.customers())


@_query
def customer_kpis_filtered(shop):
    chosen = filters.filter_rows(
        shop.customers(),
        dt.date(1995, 3, 1),
        dt.date(1996, 3, 1),
        date_column="signup_date",
        imputed_customer_type="Returning Customer",
        state="NATION_3",
    )
    return customers.customer_kpis(chosen)


def _with_lost_dates(df: DataFrame, column: str, key: str) -> DataFrame:
    return df.withColumn(column, F.when(F.col(key) % 10 != 3, F.col(column)))


@_query
def customer_kpis_readable(shop):
    # A page leaves out rows without a readable date before it counts anything.
    lost = _with_lost_dates(shop.customers(), "signup_date", "customer_id")
    return customers.customer_kpis(filters.drop_unreadable(lost, ["signup_date"]))


@_query
def product_kpis_readable(shop):
    lines = _with_lost_dates(shop.order_lines(), "order_date", "order_id")
    dated = filters.drop_unreadable(lines, ["order_date"])
    return products.product_kpis(sku_sales(dated, shop.products()))


@_query
def date_bounds_without_signups(shop):
    master = shop.customers().withColumn("signup_date", F.lit(None).cast("timestamp"))
    orders = _orders(shop, "order_date")
    return filters.date_bounds((master, "signup_date"), fallback=(orders, "order_date"))


@_query
def daily_signups(shop):
    return customers.daily_signups(shop.customers())


@_query
def customer_type_mix(shop):
    return customers.customer_type_mix(shop.customers())


@_query
def order_count_mix(shop):
    return customers.order_count_mix(shop.customers())


@_query
def repeat_buyer_mix(shop):
    return customers.repeat_buyer_mix(shop.customers())


@_query
def customers_by_state(shop):
    return customers.customers_by_state(shop.customers())


@_query
def customers_by_city(shop):
    return customers.customers_by_city(shop.customers())


@_query
def top_customers(shop):
    return customers.top_customers(shop.customers())


@_query
def orders_of_customers(shop):
    chosen = filters.keep_equal(shop.customers(), state="NATION_3")
    orders = _orders(shop, "customer_id", "total_order_value")
    return filters.semi_join(orders, chosen, "customer_id")


# Geography


@_query
def geo_kpis(shop):
    columns = ("geography_state", "geography_city", "total_order_value")
    return geo.geo_kpis(_orders(shop, *columns, geography=True))


@_query
def geo_kpis_state(shop):
    columns = ("geography_state", "geography_city", "total_order_value")
    orders = _orders(shop, *columns, geography=True)
    return geo.geo_kpis(filters.keep_equal(orders, geography_state="NATION_3"))


def _map_points(shop: StarShop) -> DataFrame:
    return geo.map_points(_order_totals(shop, *geo.POINT, geography=True, priced_only=True))


@_query
def map_points(shop):
    return _map_points(shop)


@_query
def map_center(shop):
    return geo.map_center(_map_points(shop))


@_query
def state_revenue(shop):
    return geo.state_revenue(_sales(shop, "geography_state", geography=True))


@_query
def city_revenue(shop):
    return geo.city_revenue(_sales(shop, "geography_city", geography=True))


@_query
def state_orders(shop):
    return geo.state_orders(_orders(shop, "geography_state", geography=True))


@_query
def city_orders(shop):
    return geo.city_orders(_orders(shop, "geography_city", geography=True))


# Orders in several versions, and without an id


def _versions(shop: StarShop) -> DataFrame:
    """Every third order twice, the later version cheaper but taxed higher; some ids lost."""
    orders = shop.orders().withColumn(
        "order_id", F.when(F.col("order_id") % 97 != 0, F.col("order_id"))
    )
    later = orders.where(F.col("order_number") % 3 == 0).withColumns(
        {
            "updated_at": F.expr("updated_at + interval 1 day"),
            "total_order_value": F.col("total_order_value") / 2,
            "tax_amount": F.col("tax_amount") + 5,
        }
    )
    return orders.unionByName(later)


@_query
def orders_in_versions(shop):
    columns = ["order_number", "total_order_value", "tax_amount"]
    return one_row_per_order(_versions(shop), columns)


@_query
def sales_kpis_versions(shop):
    lost = F.when(F.col("order_id") % 97 != 0, F.col("order_id")).alias("order_id")
    return sales.sales_kpis(order_rows(_versions(shop), MONEY, shop.lines().select(lost)))


# Recency, frequency, monetary value


def _rfm(shop: StarShop) -> DataFrame:
    orders = _orders(shop, "customer_id", "order_date", "total_order_value")
    return rfm.rfm_customers(orders, shop.customers())


@_query
def rfm_customers(shop):
    return _rfm(shop)


@_query
def rfm_ranks(shop):
    return rfm.rfm_ranks(_orders(shop, "customer_id", "order_date", "total_order_value"))


@_query
def rfm_segment_counts(shop):
    return rfm.rfm_segment_counts(_rfm(shop))


@_query
def rfm_score_hist(shop):
    return rfm.rfm_score_hist(_rfm(shop))


@_query
def rfm_segment_averages(shop):
    return rfm.rfm_segment_averages(_rfm(shop))


@_query
def rfm_top_customers(shop):
    return rfm.rfm_top_customers(_rfm(shop))


@_query
def rfm_top_customers_segment(shop):
    return rfm.rfm_top_customers(_rfm(shop), "Needs Attention")


# Returns


def _returns_vs_sales(shop: StarShop, **values) -> DataFrame:
    sold = filters.keep_equal(_sales(shop, "order_date"), **values)
    return returns.returns_vs_sales(sold, filters.keep_equal(shop.returns(), **values))


@_query
def returns_sheet(shop):
    return shop.returns_sheet()


@_query
def returns_typed(shop):
    return typed_returns(shop.returns_sheet())


@_query
def returns_from_csv(shop):
    # A sheet as people type it, through a written file: quotes, line breaks, kinds of dates.
    path = new_path(shop.spark, "returns-sheet")
    shop.typed_in_sheet().write.csv(path, header=True, escape='"')
    return read_returns(shop.spark, path)


@_query
def returns_unreadable(shop):
    return unreadable_returns(shop.returns_sheet())


@_query
def returns_losses(shop):
    losses = Observation("returns")
    typed = typed_returns(shop.returns_sheet(), losses=losses)
    typed.write.parquet(new_path(shop.spark, "returns"))
    return loss_table(shop.spark, losses)


@_query
def returns_vs_sales(shop):
    return _returns_vs_sales(shop)


@_query
def return_kpis(shop):
    return returns.return_kpis(_returns_vs_sales(shop))


@_query
def return_kpis_period(shop):
    lines = filters.date_range(
        _sales(shop, "order_date", start=START, end=END), "order_date", START, END
    )
    returned = filters.date_range(shop.returns(), "return_date", START, END)
    return returns.return_kpis(returns.returns_vs_sales(lines, returned))


@_query
def return_kpis_product(shop):
    return returns.return_kpis(_returns_vs_sales(shop, product_name=PRODUCT))


@_query
def product_returns(shop):
    return returns.product_returns(_returns_vs_sales(shop))


@_query
def daily_returns(shop):
    return returns.daily_returns(_returns_vs_sales(shop))


@_query
def top_returned_qty(shop):
    return returns.top_returned_qty(_returns_vs_sales(shop))


@_query
def top_return_rate(shop):
    return returns.top_return_rate(_returns_vs_sales(shop))


@_query
def top_return_comments(shop):
    return returns.top_return_comments(shop.returns())


# Referring sites


@_query
def referrer_names(shop):
    sites = shop.orders(referrers=True).select("referring_site").distinct()
    return with_source(sites, STORES)


@_query
def referrer_names_by_rules(shop):
    sites, rules = shop.sites_under_rules()
    return with_source(sites, STORES, rules)


@_query
def raw_referrer_counts(shop):
    totals = _order_totals(shop, "referring_site", referrers=True)
    return referrers.raw_referrer_counts(totals)


@_query
def raw_referrer_total(shop):
    return referrers.raw_referrer_total(_orders(shop, "referring_site", referrers=True))


@_query
def raw_referrers(shop):
    return referrers.raw_referrers(_orders(shop, "referring_site", referrers=True))


@_query
def raw_referrer_search(shop):
    orders = _orders(shop, "referring_site", referrers=True)
    return referrers.raw_referrers(orders, contains="GOOGLE")


# Filters and presentation


@_query
def filter_values_tag(shop):
    return filters.filter_values(_sales(shop, per_tag=True), "product_tags_compound")


@_query
def filter_values_city(shop):
    orders = _orders(shop, "geography_state", "geography_city", geography=True)
    chosen = filters.keep_equal(orders, geography_state="NATION_3")
    return filters.filter_values(chosen, "geography_city")


@_query
def product_name_choices(shop):
    return filters.product_name_choices(_sales(shop), shop.returns())


@_query
def date_bounds_orders(shop):
    orders = _orders(shop, "order_date")
    return filters.date_bounds(
        (orders, "order_date"), fixed_start=dt.date(1994, 1, 1), within_data=True
    )


@_query
def date_bounds_signups(shop):
    return filters.date_bounds((shop.customers(), "signup_date"))


@_query
def date_bounds_returns(shop):
    orders = _orders(shop, "order_date")
    return filters.date_bounds(
        (orders, "order_date"), (shop.returns(), "return_date"), fixed_start=START
    )


@_query
def daily_revenue_last_6m(shop):
    daily = sales.daily_revenue(_orders(shop, "order_date", "total_order_value"))
    return filters.trailing(daily, "6m")


@_query
def daily_signups_ytd(shop):
    return filters.trailing(customers.daily_signups(shop.customers()), "YTD")


@_query
def number_texts(shop):
    value = F.col("total_order_value")
    return shop.orders().select(
        "order_id",
        short_number(value).alias("plain"),
        short_number(-value / 1000).alias("small"),
        short_number(value * 100).alias("millions"),
        short_number(value * 100000).alias("billions"),
        short_number(F.floor(value / 1000) * 1000).alias("thousands"),
        currency(F.col("discount_amount")).alias("money"),
        amount(F.col("tax_amount")).alias("two_digits"),
        count_text(value / 7).alias("count"),
        percent_text(value / 7000).alias("percent"),
    )


def _hot_lines(shop: StarShop) -> DataFrame:
    """The order lines, a third of them with one SKU and some with none."""
    at = F.col("order_id") % 9
    sku = F.when(at < 3, F.lit("SKU-1")).when(at > 3, F.col("order_product_sku"))
    return shop.lines().withColumn("order_product_sku", sku)


@_query
def frequent_skus(shop):
    return frequent_keys(_hot_lines(shop), "order_product_sku", 0.0005)


@_query
def hot_sku_order_totals(shop):
    lines = _hot_lines(shop)
    frequent = frequent_keys(lines, "order_product_sku")
    # Orders without a priced line: a sum of nothing is 0 in a result.
    totals = order_totals(lines, shop.products(), frequent=frequent, tasks=order_tasks(shop.table("orders")))
    return totals.fillna(0.0, "line_item_revenue")


@_query
def hot_sku_line_items(shop):
    lines = _hot_lines(shop)
    orders = with_source(shop.orders(geography=True, referrers=True), STORES)
    frequent = frequent_keys(lines, "order_product_sku")
    items = join_orders_and_products(orders, lines, shop.products(), STORES, frequent=frequent)
    names = ("order_id", "order_product_sku", "quantity", "product_name", "product_sku")
    return items.select(*names, "product_tags_compound", "line_item_revenue", "order_channel")


@_query
def choices_of_pages(shop):
    overview = {
        "product_name": filters.ALL,
        "order_channel": "web",
        "cleaned_referring_site": "Google Direct",
        "discount_applied": None,
    }
    pages = [
        Cascade("overview", overview, START, END),
        Cascade("products", {"product_name": PRODUCT, "product_tags_compound": None}, START, END),
        Cascade("customers", {"imputed_customer_type": "new"}),
        Cascade("geography", {"geography_state": "NATION_3", "geography_city": None}),
    ]
    return cascading_choices(_line_items(shop), pages)


# Daily facts


CUBE = ("order_channel", "discount_applied", "geography_state", "geography_city")
SEVERAL = ("red widget", "red plate", "blue ring", "hot bolt")


def _cube(shop: StarShop) -> str:
    """The path of the stored facts of all orders."""
    path = new_path(shop.spark, "cube")
    orders = _orders(shop, "order_date", *CUBE, *MONEY, geography=True)
    same = F.col("order_product_sku") == F.col("product_sku")
    pairs = shop.lines().join(product_skus(shop.products()), same)
    cube.write_cube(orders, pairs.select("order_id", "product_name"), path, CUBE)
    return path


@_query
def cube_kpis_filtered(shop):
    cells = cube.read_cells(shop.spark, _cube(shop), START, END, order_channel="web")
    return cube.cube_kpis(cells)


@_query
def cube_kpis_product(shop):
    return cube.cube_kpis(cube.read_cells(shop.spark, _cube(shop), START, END, PRODUCT))


@_query
def cube_daily_product(shop):
    return cube.cube_daily(cube.read_cells(shop.spark, _cube(shop), product=PRODUCT))


@_query
def cube_by_channel(shop):
    cells = cube.read_cells(shop.spark, _cube(shop), geography_state="NATION_3")
    return cube.cube_by(cells, "order_channel")


@_query
def cube_orders_of_products(shop):
    cells = cube.read_product_cells(shop.spark, _cube(shop), START, END)
    chosen = cells.where(F.col("product_name").isin(*SEVERAL) & F.col("geography_state").isNotNull())
    return cube.distinct_orders(chosen, "geography_state")


def all_queries() -> dict[str, Query]:
    return dict(_registry)
