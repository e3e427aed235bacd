"""Frequent keys and the join that splits them; choice lists that narrow one another."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.shop import order, orders, product, products
from tillwise.operators.choices import Cascade, cascading_choices
from tillwise.operators.filters import ALL, filter_rows, filter_values
from tillwise.operators.hot_keys import frequent_keys, hot_join
from tillwise.operators import line_items as line_items_module
from tillwise.operators.line_items import line_items, order_lines, order_tasks, order_totals


@pytest.mark.parametrize("share", [0.02, 0.1, 0.5])
def test_frequent_keys_are_exact(spark, share):
    pick = random.Random(3)
    values = ["hot"] * 900 + [f"mid{i % 7}" for i in range(500)] + [None] * 100
    values += [f"k{pick.randrange(4000)}" for _ in range(1500)]
    pick.shuffle(values)
    rows = spark.createDataFrame([(v,) for v in values], "`a b` string").repartition(9)
    found = {r["key"]: r["n"] for r in frequent_keys(rows, "a b", share).collect()}
    counts = Counter(v for v in values if v is not None)
    assert found == {v: n for v, n in counts.items() if n >= share * len(values)}


def test_nothing_is_frequent_in_no_rows(spark):
    assert frequent_keys(spark.createDataFrame([], "k long"), "k").count() == 0
    nulls = spark.createDataFrame([(None,), (None,)], "k long")
    assert frequent_keys(nulls, "k").count() == 0
    with pytest.raises(ValueError, match="share"):
        frequent_keys(nulls, "k", 0)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_a_split_join_is_a_join(spark, how):
    pick = random.Random(5)
    keys = [pick.choice(["a", "a", "a", "b", "c", "d", None]) for _ in range(300)]
    left = spark.createDataFrame([(k, i % 50) for i, k in enumerate(keys)], "k string, _place int")
    right = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("e", 4), (None, 5)], "r string, _copy int")
    plain = left.join(right, F.col("k") == F.col("r"), how)
    split = hot_join(left, right, "k", "r", frequent_keys(left, "k", 0.1), how)
    assert split.columns == plain.columns
    assert Counter(split.collect()) == Counter(plain.collect())


def test_other_joins_are_refused(spark):
    one = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError, match="full"):
        hot_join(one, one, "k", "k", frequent_keys(one, "k"), "full")


def test_a_hot_key_is_dealt_evenly_and_others_are_not_copied(spark):
    n = 60_000
    left = spark.range(n).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k")
    )
    right = left.select(F.col("k").alias("r")).distinct()
    frequent = frequent_keys(left, "k")
    keep = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {name: spark.conf.get(name) for name in keep}
    try:
        for name, value in keep.items():
            spark.conf.set(name, value)
        joined = hot_join(left, right, "k", "r", frequent)
        sizes = joined.groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    sizes = sorted(row["count"] for row in sizes)
    assert sum(sizes) == n and len(sizes) == 8
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_line_items_and_totals_with_hot_skus(spark):
    pick = random.Random(7)
    made = []
    for i in range(60):
        skus = [pick.choice(["s", "s", "s", "t", "u", None, "none"]) for _ in range(pick.randint(0, 5))]
        made.append(order(f"o{i}", skus, [float(pick.randint(1, 4)) for _ in skus]))
    raw = orders(spark, *made)
    catalog = products(
        spark, product("p", ["s", "t"], ["x", "y"]), product("q", ["s"], ["z"], 3.0), product("r", ["u"], [])
    )
    lines = order_lines(raw)
    frequent = frequent_keys(lines, "order_product_sku", 0.05)
    assert Counter(map(str, line_items(raw, catalog, frequent=frequent).collect())) == Counter(
        map(str, line_items(raw, catalog).collect())
    )
    for priced in (False, True):
        split = order_totals(lines, catalog, priced, frequent)
        assert sorted(split.collect()) == sorted(order_totals(lines, catalog, priced).collect())


DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(6)]


@pytest.fixture(scope="module")
def sold(spark):
    pick = random.Random(9)
    rows = [
        (pick.choice([None, *DAYS]), pick.choice(["a", "b", None]), pick.choice([1, 2, None]), pick.choice("xyz"))
        for _ in range(40)
    ]
    return spark.createDataFrame(rows, "order_date date, name string, size int, `odd.name` string")


@pytest.mark.parametrize("name", [None, ALL, "a", "absent"])
@pytest.mark.parametrize("size", [None, 2])
@pytest.mark.parametrize("end", [None, DAYS[3], DAYS[0] - dt.timedelta(days=9)])
def test_lists_equal_one_query_each(sold, name, size, end):
    chosen = {"name": name, "missing": "m", "size": size}
    lists = cascading_choices(
        sold, [Cascade("one", chosen, DAYS[1], end), Cascade("two", {"size": size, "name": name})]
    )
    expected = []
    for cascade, order_, start in (("one", ["name", "size"], DAYS[1]), ("two", ["size", "name"], None)):
        left = filter_rows(sold, start, end) if start else sold
        for turn, column in enumerate(order_, 1):
            values = [str(r[0]) for r in filter_values(left, column).collect()]
            expected += [(cascade, turn, column, value) for value in values]
            left = filter_rows(left, **{column: chosen[column]})
    assert [tuple(r) for r in lists.collect()] == sorted(expected)


def test_lists_of_odd_rows(spark, sold):
    got = cascading_choices(sold, [Cascade("c", {"odd.name": "x"})]).collect()
    assert [r.value for r in got] == ["x", "y", "z"]
    empty = spark.createDataFrame([], sold.schema)
    assert cascading_choices(empty, [Cascade("c", {"name": "a"})]).count() == 0
    with pytest.raises(ValueError, match="no cascade"):
        cascading_choices(sold, [Cascade("c", {"missing": 1})])
    with pytest.raises(ValueError, match="names"):
        cascading_choices(sold, [Cascade("c", {"name": 1}), Cascade("c", {"size": 1})])


def test_totals_in_as_many_tasks_as_their_orders_need(spark, monkeypatch):
    monkeypatch.setattr(line_items_module, "ORDERS_PER_TASK", 10)
    assert order_tasks(spark.range(500)) == 50
    assert order_tasks(spark.range(0)) == spark.sparkContext.defaultParallelism
    lines = spark.range(900).select(
        (F.col("id") % 300).alias("order_id"),
        F.concat(F.lit("s"), F.col("id") % 7).alias("order_product_sku"),
        (F.col("id") % 5).cast("double").alias("quantity"),
    )
    catalog = products(spark, product("p", ["s1", "s2"], ["x", "y"]), product("q", ["s3"], ["z"], None))
    for priced in (False, True):
        plain = order_totals(lines, catalog, priced)
        dealt = order_totals(lines, catalog, priced, tasks=50)
        assert sorted(dealt.collect(), key=str) == sorted(plain.collect(), key=str)
        assert dealt.rdd.getNumPartitions() == 50
