import datetime as dt

from tests.shop import orders, rows, table
from tillwise import schemas
from tillwise.plans import customers as plans
from tillwise.plans import geo, rfm, sales
from tillwise.sources.tables import typed_customers


def _customers(spark, *records):
    return typed_customers(table(spark, schemas.CUSTOMERS, *records))


def _order(order_id, customer, when, value):
    return {
        "order_id": order_id,
        "customer_id": customer,
        "order_date": dt.datetime.fromisoformat(when),
        "total_order_value": value,
    }


def test_customer_types(spark):
    counts = [None, 0.0, 1.0, 2.0, 3.0]
    df = _customers(spark, *[{"customer_id": str(i), "orders_count": c} for i, c in enumerate(counts)])
    kinds = [r[0] for r in df.orderBy("customer_id").select("imputed_customer_type").collect()]
    assert kinds == ["New/One-Time Customer"] * 3 + ["Returning Customer"] * 2
    assert [tuple(r) for r in plans.repeat_buyer_mix(df).collect()] == [
        ("1 (First-time Buyer)", 1),
        ("2 (Second-time Buyer)", 1),
        ("3+ (Repeat Buyer)", 2),
    ]
    assert rows(plans.order_count_mix(df)) == [(0.0, 1), (1.0, 1), (2.0, 1), (3.0, 1)]
    without = typed_customers(df.drop("orders_count", "imputed_customer_type"))
    assert without.first().imputed_customer_type == "Unknown (Orders Count Missing)"


def test_text_columns_are_typed(spark):
    raw = spark.createDataFrame(
        [("1", "2025-01-02", "7.5", "false"), ("2", "soon", "1,5", "")],
        "customer_id string, signup_date string, total_spent string, marketing_opt_in string",
    )
    typed = rows(typed_customers(raw).drop("imputed_customer_type"))
    assert typed[0] == ("1", dt.datetime(2025, 1, 2), 7.5, True)
    assert typed[1] == ("2", None, None, False)


def test_kpis_of_nobody(spark):
    kpis = plans.customer_kpis(_customers(spark)).first()
    assert tuple(kpis) == (0, 0.0, None, None)
    kpis = geo.geo_kpis(orders(spark)).first()
    assert tuple(kpis) == (0.0, 0, 0, 0)
    assert tuple(sales.sales_kpis(orders(spark)).first()) == (0.0, 0, 0.0, 0.0, 0.0, 0.0)


def test_map_center_of_nothing(spark):
    empty = spark.createDataFrame([], "shipping_address_latitude double, shipping_address_longitude double")
    assert tuple(geo.map_center(empty).first()) == (20.5937, 78.9629)


def test_home_counts_known_buyers(spark):
    day = dt.date(2025, 7, 13)
    ordered = orders(
        spark,
        _order("a", "1", "2025-07-13", 5.0),
        _order("b", None, "2025-07-13 12:00:00", 6.0),
        _order("c", "9", "2025-07-13 23:59:59", 7.0),
        _order("d", "2", "2025-07-14", 8.0),
    )
    master = _customers(spark, {"customer_id": "1"}, {"customer_id": "2"}, {"customer_id": None})
    assert tuple(sales.home_kpis(ordered, master, day, day).first()) == (18.0, 3, 1)


def test_discounts(spark):
    coded = [("a", "X", 2.0), ("b", "", 9.0), ("c", None, 9.0), ("d", "Y", 5.0), ("e", "X", 1.0)]
    df = spark.createDataFrame(coded, "order_id string, discount_applied string, discount_amount double")
    assert [tuple(r) for r in sales.discount_summary(df).collect()] == [("Y", 5.0, 1), ("X", 3.0, 2)]
    assert sales.top_discounts(df, 1, "number_of_uses").first().discount_applied == "X"
    numbers = df.selectExpr("order_id", "1 as discount_applied", "discount_amount")
    assert sales.discount_summary(numbers).count() == 0


def test_recency_counts_full_days(spark):
    ordered = orders(
        spark,
        _order("a", "1", "2025-01-02 02:00:00", 10.0),
        _order("b", "2", "2025-01-03 01:00:00", 20.0),
    )
    metrics = rows(rfm.customer_metrics(ordered))
    assert metrics == [("1", 1, 1, 10.0), ("2", 1, 1, 20.0)]


def test_segments_of_customers(spark):
    ordered = orders(
        spark,
        _order("a", "1", "2025-01-01", 10.0),
        _order("b", "2", "2025-01-09", 20.0),
        _order("c", "2", "2025-01-09", 20.0),
        _order("d", "3", "2025-01-05", 5.0),
        _order("e", "stranger", "2024-01-05", 5.0),
        _order("f", None, "2025-02-05", 5.0),
        _order("g", "4", "2025-01-05", None),
    )
    master = _customers(spark, *[{"customer_id": c} for c in ("1", "2", "2", "3", "4", "5")])
    result = rfm.rfm_customers(ordered, master)
    columns = ("customer_id", "Recency", "Frequency", "Monetary", "RFM_Score", "RFM_Segment")
    assert rows(result, *columns) == [
        ("1", 9, 1, 10.0, "214", "Other"),
        ("2", 1, 2, 40.0, "555", "Champions"),
        ("2", 1, 2, 40.0, "555", "Champions"),
        ("3", 5, 1, 5.0, "421", "Needs Attention"),
        ("4", 39, 0, 0.0, "111", "New/Inactive"),
        ("5", 39, 0, 0.0, "111", "New/Inactive"),
    ]
    top = rfm.rfm_top_customers(result, "New/Inactive", k=1).first()
    assert top.customer_id == "4"
    assert top.Proposed_Action == rfm.NO_ACTION
    assert rfm.rfm_top_customers(result, "Champions").first().Proposed_Action.startswith("Reward")
    assert rows(rfm.rfm_segment_averages(result))[0] == ("Champions", 1.0, 2.0, 40.0, 1)


def test_nobody_ordered(spark):
    result = rfm.rfm_customers(orders(spark), _customers(spark, {"customer_id": "1"}))
    assert rows(result, "Recency", "Frequency", "RFM_Segment") == [(None, 0, "New/Inactive")]


def test_needs_attention_has_the_default_action(spark):
    schema = "customer_id string, RFM_Segment string, Monetary double"
    df = spark.createDataFrame([("1", "Needs Attention", 1.0)], schema)
    assert rfm.rfm_top_customers(df).first().Proposed_Action == rfm.NO_ACTION
