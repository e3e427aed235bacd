import datetime as dt

import pytest

from tests.shop import rows
from tillwise.operators import filters

START, END = dt.date(2025, 7, 13), dt.date(2025, 7, 31)


@pytest.fixture(scope="module", params=["timestamp", "timestamp_ntz"])
def events(spark, request):
    times = ["2025-07-12 23:59:59", "2025-07-13", "2025-07-31 23:59:59.999999", "2025-08-01", None]
    df = spark.createDataFrame(list(enumerate(times)), "i int, t string")
    return df.selectExpr("i", f"cast(t as {request.param}) as t")


def test_both_ends_are_included(events):
    assert rows(filters.date_range(events, "t", START, END), "i") == [(1,), (2,)]


def test_dates_work_too(spark):
    df = spark.createDataFrame([(dt.date(2025, 7, d),) for d in (12, 13, 31)], "t date")
    assert filters.date_range(df, "t", START, END).count() == 2


@pytest.mark.parametrize("start, end", [(END, START), (START, None), (None, END), (None, None)])
def test_odd_ranges_filter_nothing(events, start, end):
    assert filters.date_range(events, "t", start, end).count() == 5
    with pytest.raises(ValueError):
        filters.date_range(events, "t", start, end, strict=True)


def test_equal_values(spark):
    df = spark.createDataFrame([("x", 1), ("y", 1), (None, 2)], "a string, b int")
    assert rows(filters.filter_rows(df, a="x", b=None)) == [("x", 1)]
    assert filters.keep_equal(df, a=filters.ALL, b=1).count() == 2


def test_choices_are_sorted_and_known(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "v string")
    assert [r[0] for r in filters.filter_values(df, "v").collect()] == ["a", "b"]


def test_names_of_both_tables(spark):
    sold = spark.createDataFrame([("b",), (None,)], "product_name string")
    back = spark.createDataFrame([("a",), ("b",)], "product_name string")
    got = filters.product_name_choices(sold, back).collect()
    assert [r[0] for r in got] == ["a", "b"]


def test_bounds(spark, events):
    low, high = dt.date(2025, 7, 12), dt.date(2025, 8, 1)
    assert tuple(filters.date_bounds((events, "t")).first()) == (low, high)
    fixed = filters.date_bounds((events, "t"), fixed_start=START)
    assert tuple(fixed.first()) == (START, high)
    early = dt.date(2020, 1, 1)
    clamped = filters.date_bounds((events, "t"), fixed_start=early, within_data=True)
    assert tuple(clamped.first()) == (low, high)
    later = spark.createDataFrame([(dt.datetime(2026, 1, 1),)], "t timestamp")
    both = filters.date_bounds((events, "t"), (later, "t"))
    assert tuple(both.first()) == (low, dt.date(2026, 1, 1))


def test_trailing_presets(spark):
    days = ["2024-03-30", "2024-03-31", "2024-09-30", "2024-12-31", "2025-01-01", "2025-02-28", "2025-03-31"]
    series = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "date date")
    kept = {p: filters.trailing(series, p).count() for p in ("1m", "6m", "YTD", "1y", "all")}
    assert kept == {"1m": 2, "6m": 5, "YTD": 3, "1y": 6, "all": 7}


def test_search_is_case_blind(spark):
    df = spark.createDataFrame([("Google",), ("google",), ("x",), (None,), ("Google",)], "v string")
    assert [r[0] for r in filters.search(df, "v", "GOO").collect()] == ["Google", "google"]


def test_null_matches_null_in_semi_joins(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    b = spark.createDataFrame([(1,), (None,), (None,)], "id int")
    assert rows(filters.semi_join(a, b, "id")) == [(1,), (None,)]
    assert rows(filters.semi_join(a, b.dropna(), "id")) == [(1,)]


def test_unreadable_dates_go(spark):
    df = spark.createDataFrame([("2025-01-01",), ("soon",), (None,)], "t string")
    assert filters.drop_unreadable(df, ["t"]).count() == 1
