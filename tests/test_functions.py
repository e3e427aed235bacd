import pytest
from pyspark.sql import functions as F

from tillwise.functions.comments import normal_comment
from tillwise.functions.formats import (
    amount,
    count_text,
    currency,
    fixed_point,
    percent_text,
    short_number,
)
from tillwise.functions.numbers import as_double, as_flag, as_timestamp, exact_sum, mean
from tillwise.functions.referrers import Store, Suffixes, clean_referrer, site_label


def _map(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    result = df.select("i", expression(F.col("v")).alias("o")).orderBy("i")
    return [row.o for row in result.collect()]


def test_text_to_number(spark):
    texts = [" 5 ", "1,234", "1e3", "", "5d", "0x1f", "-.5", "+7.", None, "nan"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = [r[0] for r in df.select(as_double(df, "v")).collect()]
    assert got == [5.0, None, 1000.0, None, None, None, -0.5, 7.0, None, None]


def test_nan_is_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.5,)], "v double")
    assert [r[0] for r in df.select(as_double(df, "v")).collect()] == [None, 1.5]


def test_text_to_time(spark):
    df = spark.createDataFrame([("2025-07-13",), ("07/14/2025",), ("n/a",), ("",)], "v string")
    got = [r[0] and r[0].date().isoformat() for r in df.select(as_timestamp(df, "v")).collect()]
    assert got == ["2025-07-13", "2025-07-14", None, None]


def test_flags(spark):
    df = spark.createDataFrame([("false", True), ("", False), (None, None)], "t string, b boolean")
    got = [tuple(r) for r in df.select(as_flag(df, "t"), as_flag(df, "b")).collect()]
    assert got == [(True, True), (False, False), (False, False)]


def test_exact_sum_does_not_depend_on_order(spark):
    values = [0.1] * 10 + [1e9 + 0.25, -1e9, -0.35, 123456.78]
    results = set()
    for parts, data in [(1, values), (5, values[::-1]), (7, sorted(values))]:
        df = spark.createDataFrame([(v,) for v in data], "v double").repartition(parts)
        results.add(df.agg(exact_sum("v")).first()[0])
    assert results == {123457.68}


def test_sums_drop_nothing(spark):
    small = spark.range(1_000_000).select(F.lit(4e-7).alias("v"))
    assert abs(small.agg(exact_sum("v")).first()[0] - 0.4) < 1e-12
    thirds = spark.range(3).select(F.lit(1 / 3).alias("v"))
    assert abs(thirds.agg(mean("v")).first()[0] - 1 / 3) < 1e-15
    for values, want in [
        ([1e19], 1e19),
        ([6e18, 6e18], 1.2e19),
        ([float("inf"), 1.0], float("inf")),
        ([2.0**40] * 3 + [0.25], 3 * 2.0**40 + 0.25),
        ([-0.5, -1e-9], -0.500000001),
        ([8.5e9] * 2000, 1.7e13),
    ]:
        df = spark.createDataFrame([(v,) for v in values], "v double")
        assert df.agg(exact_sum("v")).first()[0] == pytest.approx(want, rel=1e-15)


def test_dates_as_people_type_them(spark):
    texts = ["7/13/2025", "2025-07-13T10:00:00", "2025-07-13T10:00:00Z", "2025-07-13 10:00:00.5", "2025/07/13"]
    texts += ["Jul 13, 2025", "July 13, 2025", "13 Jul 2025", "2025-7-13", " 2025-07-13 10:00 ", "07/13/2025 9:30"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = [r[0] and r[0].date().isoformat() for r in df.select(as_timestamp(df, "v")).collect()]
    assert got == ["2025-07-13"] * len(texts)


def test_sum_and_mean_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert tuple(df.agg(exact_sum("v"), mean("v")).first()) == (None, None)


NUMBERS = [
    (None, "N/A"),
    (float("nan"), "N/A"),
    (0.0, "0"),
    (999.0, "999"),
    (999.5, "999.50"),
    (999.996, "1,000.00"),
    (1000.0, "1K"),
    (1500.0, "1.5K"),
    (2500000.0, "2.50M"),
    (3e9, "3.00B"),
    (1.5e12, "1500.00B"),
    (-1500.0, "-1.5K"),
    (-2.5, "-2.50"),
    # Exact ties go to the even digit, others to the side the binary number is on.
    (0.125, "0.12"),
    (0.375, "0.38"),
    (2.675, "2.67"),
    (1.005, "1.00"),
    (0.005, "0.01"),
    (0.015, "0.01"),
    (1250.0, "1.2K"),
    (1150.0, "1.1K"),
    (1350.0, "1.4K"),
    (999999.0, "1000.0K"),
]


def test_short_numbers(spark):
    got = _map(spark, [n for n, _ in NUMBERS], "double", short_number)
    assert got == [text for _, text in NUMBERS]


def test_short_numbers_of_text(spark):
    assert _map(spark, ["1500", "many", None], "string", short_number) == ["1.5K", "many", "N/A"]


def test_fixed_texts_match_python(spark):
    values = [0.5, 1.5, 2.5, 1234567.891, 0.045, 33.335, 1e12 + 0.5, 0.0, 99.995, -3.145]
    assert _map(spark, values, "double", amount) == [f"₹ {v:.2f}" for v in values]
    assert _map(spark, values, "double", percent_text) == [f"{v:.2f}%" for v in values]
    assert _map(spark, values, "double", count_text) == [f"{v:,.0f}" for v in values]
    grouped = _map(spark, values, "double", lambda v: amount(v, "$", thousands=True))
    assert grouped == [f"${v:,.2f}" for v in values]
    assert _map(spark, [1500.0], "double", currency) == ["₹ 1.5K"]


def test_comments(spark):
    texts = ["Damaged , Late", "Bad / taste", " - x - ", "", "A B", "a b", None]
    want = ["damaged-late", "bad-taste", "x", "", "a-b", "a-b", None]
    assert _map(spark, texts, "string", normal_comment) == want


REFERRERS = [
    (None, "Direct/Unknown"),
    ("", "Direct/Unknown"),
    (" \t", "Direct/Unknown"),
    ("android-app://com.google.android.gm/", "Google Mail App"),
    ("android-app://com.google.android.googlequicksearchbox/x", "Google Search App"),
    ("Android-App://com.facebook.katana", "Facebook App"),
    ("android-app://com.instagram.android", "Instagram App"),
    ("android-app://org.telegram", "Other Mobile App"),
    ("https://shop.example/cart/1", "My Shop (Internal)"),
    ("https://shop.example/collections/all?fbclid=1", "My Shop (Internal)"),
    ("https://shop.example/?fbclid=abc", "My Shop (Paid Ads)"),
    ("https://shop.example/?utm_source=facebook", "My Shop (Paid Ads)"),
    ("shop.example", "My Shop"),
    ("https://l.instagram.com/", "Instagram"),
    ("https://m.facebook.com/", "Facebook"),
    ("https://t.co/abc", "Twitter"),
    ("https://www.reddit.com/", "Twitter"),
    ("https://chatgpt.com/", "Twitter"),
    ("https://youtu.be/x", "YouTube"),
    ("https://www.linkedin.com/feed", "LinkedIn"),
    ("https://meta.com/x", "Meta"),
    ("https://www.google.com/aclk?u=googlesyndication.com", "Google Ads"),
    ("https://google.com/search?q=a|b", "Google Search"),
    ("https://google.com/?x=1&s=2#q=1", "Google Search"),
    ("https://google.com/?q=", "Google Direct"),
    ("https://google.com/?aq=1", "Google Direct"),
    ("https://google.com/#?q=1", "Google Direct"),
    ("http://[google.com/", "Other (Error)"),
    ("https://search.brave.com/", "Brave"),
    ("https://www.bing.com/", "Bing"),
    ("https://www.ecosia.org/", "Ecosia"),
    ("https://admin.shopify.com/", "Shopify Platform"),
    ("https://webinvoke.paytmpayments.com/", "Webinvoke"),
    ("http://l.wl.co/l?u=x", "WL Link"),
    ("https://links.rediff.com/", "Rediff Links"),
    ("https://www.idevaffiliate.com/", "iDevAffiliate"),
    ("https://a.my-shop.co.uk/x", "My Shop"),
    ("42my-blog2go.org:8080/p", "My Blog2Go"),
    ("https://user@news.o'neil.net./", "O'Neil"),
    ("http://10.0.0.1/", "10.0.0.1"),
    ("http://intranet/", "Intranet"),
    ("https://co.uk/", "Co"),
    ("https://com/", "Other (Generic Domain Fallback)"),
    ("12345", "Other (No Domain)"),
]


def test_referrers(spark):
    stores = [Store("My Shop", ("shop.example",))]
    got = _map(
        spark, [url for url, _ in REFERRERS], "string", lambda c: clean_referrer(c, stores)
    )
    assert list(zip([url for url, _ in REFERRERS], got)) == REFERRERS


def test_suffix_rules(spark):
    rules = ["// comment", "", "ck", "*.ck", "!www.ck", "com", "a.b.com"]
    suffixes = Suffixes.from_rules(rules)
    hosts = ["x.y.ck", "www.ck", "x.www.ck", "y.ck", "q.a.b.com", "z.b.com", "b.com"]
    got = _map(spark, hosts, "string", lambda c: site_label(c, suffixes))
    assert got == ["x", "www", "www", "", "q", "b", "b"]


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_rounding_is_pythons(spark, digits):
    values = [k / 8 + j * 0.005 for k in range(40) for j in range(4)]
    got = _map(spark, values, "double", lambda v: fixed_point(v, digits))
    assert got == [f"{v:.{digits}f}" for v in values]
