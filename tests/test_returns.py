import datetime as dt

import pytest

from tests.shop import rows
from tillwise.plans import returns as plans
from tillwise.sources.tables import read_returns, typed_returns

CSV = '''Date,Product Name,Quantity,Comments
2025-07-13,Tea,3,"Damaged / Late"
07/13/2025,Tea,2,
n/a,Tea,1,x
2025-07-14,,1," "
2025-07-14,Rice,,x
2025-07-14,Rice,"1,234",x
2025-07-15,Rice, 4 ,"damaged , late"
'''


@pytest.fixture(scope="module")
def returned(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sheet") / "returns.csv"
    path.write_text(CSV)
    return read_returns(spark, str(path))


@pytest.fixture(scope="module")
def sold(spark):
    data = [
        (dt.datetime(2025, 7, 13, 9), "Tea", 10.0, 50.0),
        (dt.datetime(2025, 7, 13, 21), "Tea", 10.0, 70.0),
        (dt.datetime(2025, 7, 14), "Rice", 5.0, 20.0),
        (None, "Rice", 1.0, 1.0),
    ]
    schema = "order_date timestamp, product_name string, quantity double, line_item_revenue double"
    return spark.createDataFrame(data, schema)


def test_sheet_is_typed(returned):
    day = dt.datetime(2025, 7, 13)
    assert rows(returned) == [
        (day, "Tea", 2.0, ""),
        (day, "Tea", 3.0, "Damaged / Late"),
        (dt.datetime(2025, 7, 14), "", 1.0, " "),
        (dt.datetime(2025, 7, 15), "Rice", 4.0, "damaged , late"),
    ]


def test_sheet_without_a_column(spark):
    with pytest.raises(ValueError, match="return_comments"):
        typed_returns(spark.createDataFrame([("a", "b", "c")], ["Date", "Product Name", "Quantity"]))


def test_sales_and_returns_of_a_day(sold, returned):
    first, second, third = (dt.date(2025, 7, d) for d in (13, 14, 15))
    got = rows(plans.returns_vs_sales(sold, returned))
    assert got == [
        (first, "Tea", 20.0, 120.0, 5.0, 25.0, 6.0, 30.0),
        (second, "", 0.0, 0.0, 1.0, 0.0, 0.0, 0.0),
        (second, "Rice", 5.0, 20.0, 0.0, 0.0, 4.0, 0.0),
        (third, "Rice", 0.0, 0.0, 4.0, 0.0, 0.0, 0.0),
    ]


def test_rollups(sold, returned):
    rvs = plans.returns_vs_sales(sold, returned)
    assert tuple(plans.return_kpis(rvs).first()) == (25.0, 10.0, 140.0, 30.0, 40.0)
    assert rows(plans.product_returns(rvs)) == [
        ("", 1.0, 0.0, 0.0, 0.0),
        ("Rice", 4.0, 5.0, 0.0, 80.0),
        ("Tea", 5.0, 20.0, 30.0, 25.0),
    ]
    assert [r.product_name for r in plans.top_returned_qty(rvs, 2).collect()] == ["Tea", "Rice"]
    # Returned but never sold: not eligible.
    assert [r.product_name for r in plans.top_return_rate(rvs).collect()] == ["Rice", "Tea"]
    assert [r.total_returned_quantity for r in plans.daily_returns(rvs).collect()] == [5.0, 1.0, 4.0]


def test_comments_are_counted(returned):
    got = [tuple(r) for r in plans.top_return_comments(returned).collect()]
    assert got == [("", 2), ("damaged-late", 2)]


def test_no_sales_at_all(spark, sold, returned):
    rvs = plans.returns_vs_sales(sold.limit(0), returned.limit(0))
    assert tuple(plans.return_kpis(rvs).first()) == (0.0, 0.0, 0.0, 0.0, 0.0)
