"""Every result of empty tables: its columns, and zeros instead of missing totals."""

import pytest

from tillwise import schemas
from tillwise.operators.line_items import line_items
from tillwise.operators.orders import one_row_per_order, order_rows
from tillwise.plans import customers, geo, products, referrers, returns, rfm, sales
from tillwise.schemas import empty
from tillwise.sources.tables import typed_customers, typed_returns


@pytest.fixture(scope="module")
def nothing(spark):
    orders = empty(spark, schemas.ORDERS)
    return {
        "lines": line_items(orders, empty(spark, schemas.PRODUCTS)),
        "orders": one_row_per_order(line_items(orders, empty(spark, schemas.PRODUCTS))),
        "customers": typed_customers(empty(spark, schemas.CUSTOMERS)),
        "returns": typed_returns(empty(spark, schemas.RETURNS_SHEET)),
    }


TOTALS = [sales.sales_kpis, products.product_kpis, geo.geo_kpis]
BY_INPUT = {
    "orders": [
        sales.daily_revenue,
        sales.daily_orders,
        sales.revenue_by_channel,
        sales.revenue_by_status,
        sales.top_referrers,
        sales.discount_summary,
        sales.top_discounts,
    ],
    "lines": [
        products.top_products_revenue,
        products.top_tags_quantity,
        products.tag_revenue_share,
        products.tag_quantity_share,
        products.daily_product_revenue,
        products.daily_quantity,
        products.low_stock,
        geo.map_points,
        geo.state_revenue,
        geo.city_orders,
        referrers.raw_referrer_counts,
        referrers.raw_referrers,
    ],
    "customers": [
        customers.daily_signups,
        customers.customer_type_mix,
        customers.order_count_mix,
        customers.repeat_buyer_mix,
        customers.customers_by_state,
        customers.top_customers,
    ],
    "returns": [returns.top_return_comments, returns.daily_product_returns],
}


@pytest.mark.parametrize("name", BY_INPUT)
def test_no_rows(nothing, name):
    for plan in BY_INPUT[name]:
        result = plan(nothing[name])
        assert result.columns and result.count() == 0, plan.__name__


def test_totals_are_zero(nothing):
    for plan in TOTALS:
        source = "lines" if plan is products.product_kpis else "orders"
        assert set(plan(nothing[source]).first()) == {0}, plan.__name__
    rvs = returns.returns_vs_sales(nothing["lines"], nothing["returns"])
    assert set(returns.return_kpis(rvs).first()) == {0}
    assert referrers.raw_referrer_total(nothing["lines"]).first()[0] == 0


def test_segments_of_nobody(nothing):
    result = rfm.rfm_customers(nothing["orders"], nothing["customers"])
    for plan in (rfm.rfm_segment_counts, rfm.rfm_score_hist, rfm.rfm_segment_averages):
        assert plan(result).count() == 0
    assert rfm.rfm_top_customers(result).columns == list(rfm.DISPLAY_COLUMNS)


def test_empty_schemas_match_the_readers(spark):
    assert empty(spark, schemas.RETURNS).columns == typed_returns(
        empty(spark, schemas.RETURNS_SHEET)
    ).columns
    rows = order_rows(empty(spark, schemas.ORDERS), ["order_date"])
    assert rows.columns == ["order_id", "order_date"]
