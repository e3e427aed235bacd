"""Refreshes of stored tables against full rebuilds, and ranks against a plain window."""

import datetime as dt
import random
import time
import uuid
from pathlib import Path
from types import SimpleNamespace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tests.shop import order, orders, product, products, rows
from tillwise.functions.referrers import Store, Suffixes, clean_referrer, with_referrer
from tillwise.functions.suffix_rules import host_labels, read_suffix_rules
from tillwise.operators.line_items import line_items, products_by_sku
from tillwise.operators.ranking import global_rank
from tillwise.plans.rfm import customer_metrics, rfm_scores
from tillwise.plans.rfm_state import read_rfm_metrics, read_rfm_scores, update_rfm
from tillwise.registry import queries
from tillwise.sources import refresh
from tillwise.sources.refresh import refresh_by_month
from tillwise.sources.store import read_line_items, rows_weighed

ORDERS = "order_id string, customer_id string, order_date timestamp, updated_at timestamp, total_order_value double"


def _files(path):
    return {file: file.stat().st_mtime_ns for file in Path(path).rglob("*.parquet")}


def _item(order_id, day, updated, sku="a", n=1.0):
    return (order_id, sku, n, day and dt.datetime(2025, *day), updated and dt.datetime(2025, 1, updated))


def _items(spark, *given):
    schema = "order_id string, sku string, quantity double, order_date timestamp, order_updated_at timestamp"
    return spark.createDataFrame(list(given), schema)


def test_refresh_equals_a_rebuild(spark, tmp_path):
    path = str(tmp_path / "items")
    first = [_item("a", (1, 5), 1), _item("a", (1, 5), 1, "b"), _item("b", (2, 9), 2), _item("c", (3, 3), 1)]
    first += [_item("d", (4, 4), 3), _item(None, (1, 7), None), _item("e", None, 1)]
    refresh_by_month(_items(spark, *first), path)
    before = _files(path)
    # A moves month and loses a line, b is older than what is stored, c leaves March without rows.
    batch = [_item("a", (2, 1), 2, "z"), _item("b", (5, 5), 1), _item("c", (4, 1), 1), _item("f", (2, 2), None)]
    batch += [_item("f", (6, 6), 4), _item(None, (1, 8), 1)]
    change = refresh_by_month(_items(spark, *batch), path)
    assert rows(change.gone, "order_id", "sku") == rows(_items(spark, first[0], first[1], first[3], first[5]), "order_id", "sku")
    want = [batch[0], first[2], batch[2], first[4], first[6], batch[4], batch[5]]
    columns = ("order_id", "sku", "quantity", "order_date", "order_updated_at")
    assert rows(read_line_items(spark, path), *columns) == rows(_items(spark, *want), *columns)
    after = _files(path)
    touched = {str(month)[:7] for month in change.months}
    assert touched == {"2025-01", "2025-02", "2025-03", "2025-04", "2025-06"}
    kept = {f: t for f, t in before.items() if "HIVE_DEFAULT" in str(f)}
    assert kept and kept.items() <= after.items()
    assert not list(Path(path).glob("order_month=2025-03-01"))


def test_untouched_months_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "items")
    refresh_by_month(_items(spark, *[_item(f"o{i}", (1 + i % 6, 2), 1) for i in range(60)]), path)
    before = _files(path)
    refresh_by_month(_items(spark, _item("o1", (2, 20), 2), _item("new", (4, 1), 1)), path)
    after = _files(path)
    months = lambda files: {f.parent.name for f in files}
    assert months(set(before) & set(after)) == {f"order_month=2025-0{m}-01" for m in (1, 3, 5, 6)}
    assert refresh_by_month(_items(spark), path).months == ()
    assert _files(path) == after


def test_three_batches_equal_one_run(spark, tmp_path):
    pick = random.Random(3)
    versions = {}
    path = str(tmp_path / "state")
    for turn in range(3):
        batch = []
        for i in pick.sample(range(60), 40):
            day = dt.datetime(2025, 1 + pick.randrange(4), 1 + pick.randrange(28), pick.randrange(24))
            updated = dt.datetime(2025, 6, 1 + turn + pick.randrange(3))
            customer = pick.choice(["x", "y", None, *[f"c{j}" for j in range(12)]])
            row = (f"o{i}", customer, pick.choice([day, day, day, None]), updated, round(pick.random() * 99, 2))
            batch.append(row)
            if i not in versions or versions[i][3] <= updated:
                versions[i] = row
        update_rfm(spark.createDataFrame(batch, ORDERS), path)
        whole = spark.createDataFrame(list(versions.values()), ORDERS)
        assert rows(read_rfm_metrics(spark, path)) == rows(customer_metrics(whole))
    assert rows(read_rfm_scores(spark, path)) == rows(rfm_scores(whole))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    values=st.lists(st.sampled_from([None, 0, 1, 2, 7, -3]), max_size=40),
    buckets=st.integers(1, 50),
)
def test_global_rank_is_row_number(spark, values, buckets):
    df = spark.createDataFrame(list(enumerate(values)), "id int, v int").repartition(3)
    got = {r.id: r.place for r in global_rank(df, ["v", "id"], "place", buckets).collect()}
    ordered = sorted(enumerate(values), key=lambda row: (row[1] is not None, row[1] or 0, row[0]))
    assert got == {i: place for place, (i, _) in enumerate(ordered, 1)}


def test_global_rank_with_many_ties(spark):
    df = spark.range(20_000).selectExpr("id", "case when id % 3 = 0 then 5 else id % 4 end as v", "1 as rank_")
    ranked = global_rank(df, [-F.col("v"), "id"], buckets=13)
    plain = df.withColumn("rank", F.row_number().over(Window.orderBy(-F.col("v"), "id")))
    assert ranked.exceptAll(plain).count() == 0 and ranked.columns == plain.columns
    assert "SinglePartition" not in ranked._jdf.queryExecution().executedPlan().toString()
    # Ties on the whole order are cut into several buckets as well, and every number occurs.
    tied = global_rank(df, [F.lit(1)], buckets=13)
    assert tied.agg(F.count_distinct("rank"), F.min("rank"), F.max("rank")).first() == (20_000, 1, 20_000)


def test_names_by_rules_as_by_the_list(spark, tmp_path):
    rules = ["// comment", "", "ck", "*.ck", "!www.ck", "com  // and a note", "a.b.com", "COM", "co.uk", "uk"]
    (tmp_path / "rules.dat").write_text("\n".join(rules))
    table = read_suffix_rules(spark, str(tmp_path / "rules.dat"))
    assert table.count() == 7
    hosts = ["x.y.ck", "www.ck", "x.www.ck", "y.ck", "q.a.b.com", "z.b.com", "b.com", "com", "", "..", "10.0.0.1"]
    hosts += ["intranet", "a.b.c.d.e.f.co.uk", None, "b.com"]
    got = host_labels(spark.createDataFrame([(h,) for h in hosts], "host string"), table).collect()
    want = ["x", "www", "www", "", "q", "b", "b", "", "", "", "10.0.0.1", "intranet", "f"]
    assert {r.host: r.label for r in got} == dict(zip(hosts, want))
    stores = [Store("My Shop", ("shop.example",))]
    urls = [f"https://m.{h}:80/x?q=1" for h in hosts if h] + ["", " ", None, "shop.example/cart", "android-app://x"]
    urls += ["https://google.com/?q=", "42my-blog2go.com", "http://[x", urls[0], None]
    sites = spark.createDataFrame([(u, i, "k") for i, u in enumerate(urls)], "site string, _host int, _key string")
    listed = Suffixes.from_rules([*rules[:7], "co.uk", "uk"])
    joined = with_referrer(sites, "site", "named", stores, table)
    assert rows(joined, "_host", "site", "_key", "named") == rows(
        sites.withColumn("named", clean_referrer(F.col("site"), stores, listed)), "_host", "site", "_key", "named"
    )
    assert rows(with_referrer(sites, "site", "named", stores, listed)) == rows(
        sites.withColumn("named", clean_referrer(F.col("site"), stores, listed))
    )


def test_line_grain(spark):
    raw = orders(
        spark, order("o1", ["a", "b", "a"], [1.0, 2.0, 3.0]), order("o2", ["none"], [4.0]), order("o3", [None], [5.0])
    )
    catalog = products(
        spark,
        product("first", ["a"], ["t", "u"], 10.0, product_id="1"),
        product("second", ["a", "b"], ["u", "s"], 20.0, product_id="2"),
        product("untagged", ["none"], [], product_id="0"),
    )
    got = line_items(raw, catalog, grain="line")
    assert rows(got, "order_id", "line_number", "product_name", "line_item_revenue", "product_tags_compound") == [
        ("o1", 1, "first", 10.0, "s, t, u"),
        ("o1", 2, "second", 40.0, "s, u"),
        ("o1", 3, "first", 30.0, "s, t, u"),
        ("o2", 1, None, None, "Unknown Tag"),
        ("o3", 1, None, None, "Unknown Tag"),
    ]
    assert got.columns[0] == "line_number" and "individual_product_tag" not in got.columns
    assert products_by_sku(catalog).count() == 2
    with pytest.raises(ValueError, match="grain"):
        line_items(raw, catalog, grain="order")


def test_line_sums_are_fan_out_sums_by_tags(spark):
    raw = orders(spark, *[order(f"o{i}", [f"s{i % 4}"], [float(i)]) for i in range(20)])
    catalog = products(spark, *[product(f"p{i}", [f"s{i}"], ["t", "u", "v"][: i + 1], 3.0) for i in range(3)])
    lines = line_items(raw, catalog, grain="line").withColumn("n", F.greatest(F.size("product_tags_list"), F.lit(1)))
    fan_out = line_items(raw, catalog).groupBy("order_id").agg(F.sum("quantity").alias("whole"))
    both = lines.join(fan_out, "order_id")
    assert both.count() == 20 and both.where("whole <> quantity * n").count() == 0


def test_rows_that_go_and_rows_that_stay_come_from_one_join(spark, tmp_path, monkeypatch):
    """Each batch is shuffled for its times and for its versions, the stored months once."""
    path, made = str(tmp_path / "items"), []
    refresh_by_month(_items(spark, *[_item(f"o{i}", (1 + i % 3, 2), 1) for i in range(30)]), path)
    real = refresh.materialize
    monkeypatch.setattr(refresh, "materialize", lambda df, name: made.append((name, df)) or real(df, name))
    change = refresh_by_month(_items(spark, _item("o1", (2, 20), 2), _item("o2", (1, 1), None)), path)
    assert [name for name, _ in made] == ["accepted", "come", "touched"]
    assert rows(change.gone, "order_id") == [("o1",)] and "_went" not in change.gone.columns
    # Times are added up as plain values: a maximum of structs would sort all rows of a batch.
    plans = [df._jdf.queryExecution().toString() for _, df in made]
    assert not any("max(struct" in plan for plan in plans)


def test_null_times_are_the_oldest(spark, tmp_path):
    path = str(tmp_path / "items")
    refresh_by_month(_items(spark, _item("a", (1, 1), None), _item("b", (1, 1), 1), _item(None, (1, 1), None)), path)
    batch = [_item("a", (1, 2), None), _item("b", (1, 2), None), _item(None, (1, 3), None), _item("c", (1, 4), None)]
    batch += [_item("c", (1, 5), 2), _item("c", (1, 6), 2, "b")]
    refresh_by_month(_items(spark, *batch), path)
    want = [batch[0], _item("b", (1, 1), 1), batch[2], batch[4], batch[5]]
    columns = ("order_id", "sku", "order_date", "order_updated_at")
    assert rows(read_line_items(spark, path), *columns) == rows(_items(spark, *want), *columns)


def _left(path):
    return sorted(name.name for name in Path(path).glob("*"))


@pytest.fixture
def shared(tmp_path, monkeypatch):
    """The folder of the steps of a refresh, empty at first."""
    folder = tmp_path / "shared"
    monkeypatch.setattr(refresh, "new_path", lambda _, name: f"{folder}/{name}-{uuid.uuid4().hex}")
    return folder


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {name for name in names if name.startswith("shuffle_")}


def test_a_refresh_leaves_no_shuffle_files_and_no_steps(spark, tmp_path, shared):
    path = str(tmp_path / "items")
    before = _shuffle_files(spark)
    refresh_by_month(_items(spark, *[_item(f"o{i}", (1 + i % 3, 2), 1) for i in range(30)]), path).remove()
    change = refresh_by_month(_items(spark, _item("o1", (2, 20), 2), _item("o2", (5, 1), 3)), path)
    until = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before
    # What stays are the rows that went and came, until they are removed.
    assert [name.split("-")[0] for name in _left(shared)] == ["come", "gone"]
    assert rows(change.gone, "order_id") == rows(change.come, "order_id") == [("o1",), ("o2",)]
    change.remove()
    assert not _left(shared) and not [name for name in _left(tmp_path) if "new" in name]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_a_batch_is_not_shuffled_where_no_key_loses_rows(spark, tmp_path, monkeypatch):
    path, plans = str(tmp_path / "items"), {}
    real = refresh.materialize
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(refresh, "materialize", lambda df, name: plans.update({name: plan(df)}) or real(df, name))
    refresh_by_month(_items(spark, *[_item(f"o{i}", (1 + i % 3, 2), 1) for i in range(30)]), path)
    assert "hashpartitioning" not in plans["come"]
    refresh_by_month(_items(spark, _item("o1", (2, 20), 2), _item("o2", (1, 1), 3)), path)
    assert "hashpartitioning" not in plans["come"]


def test_refreshes_in_turns_equal_a_plain_merge(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(refresh, "TURN_ROWS", 3)
    real, made = refresh.materialize, []
    monkeypatch.setattr(refresh, "materialize", lambda df, name: made.append(name) or real(df, name))
    pick, path, table = random.Random(5), str(tmp_path / "items"), {}
    columns = ("order_id", "sku", "quantity", "order_date", "order_updated_at")
    for _ in range(4):
        versions = {}
        for _ in range(30):
            key, at = pick.choice([None, *[f"o{i}" for i in range(25)]]), pick.choice([None, 1, 2, 3, 4])
            days = [pick.choice([None, (1 + pick.randrange(9), 1 + pick.randrange(28))]) for _ in range(1 + pick.randrange(3))]
            versions.setdefault(key, {}).setdefault(at, []).extend(_item(key, day, at, pick.choice("xyz")) for day in days)
        change = refresh_by_month(_items(spark, *[row for v in versions.values() for some in v.values() for row in some]), path)
        gone, come = [], []
        for key, v in versions.items():
            at = max(v, key=lambda at: at or 0)
            if key not in table or (table[key][0] or 0) <= (at or 0):
                gone += table[key][1] if key in table else []
                come += v[at]
                table[key] = (at, v[at])
        whole = [row for _, some in table.values() for row in some]
        assert rows(read_line_items(spark, path), *columns) == rows(_items(spark, *whole), *columns)
        assert rows(change.gone, *columns) == rows(_items(spark, *gone), *columns)
        assert rows(change.come, *columns) == rows(_items(spark, *come), *columns)
        assert set(change.months) == {row[3] and row[3].date().replace(day=1) for row in gone + come}
    assert made.count("touched") > 6


def test_a_refresh_that_fails_leaves_the_table(spark, tmp_path, monkeypatch, shared):
    path, batch = str(tmp_path / "items"), _items(spark, _item("o1", (2, 20), 2), _item("new", (6, 1), 1))
    refresh_by_month(_items(spark, *[_item(f"o{i}", (1 + i % 6, 2), 1) for i in range(60)]), path).remove()
    before, files = rows(read_line_items(spark, path)), _files(path)
    monkeypatch.setattr(refresh, "TURN_ROWS", 1)
    real, turns = refresh.write_by, []

    def failing(*given):
        turns.append(given)
        if len(turns) == 2:
            raise OSError("the disk is full")
        return real(*given)

    with monkeypatch.context() as patch:
        patch.setattr(refresh, "write_by", failing)
        with pytest.raises(OSError, match="full"):
            refresh_by_month(batch, path)
    assert _files(path) == files and rows(read_line_items(spark, path)) == before
    assert not [name for name in _left(tmp_path) if "new" in name]
    assert {name.split("-")[0] for name in _left(shared)} <= {"come", "gone"}
    refresh_by_month(batch, path)
    assert read_line_items(spark, path).where("order_id in ('o1', 'new')").count() == 2


def test_batches_written_in_turns_have_every_row(spark):
    given = _items(spark, *[_item(None if i % 9 == 0 else f"o{i % 20}", (1 + i % 3, 2), 1) for i in range(60)])
    stored = queries._written(SimpleNamespace(spark=spark), given, "batches", 3)
    assert rows(stored) == rows(given)


def test_stored_keys_are_weighed_as_rows(spark, tmp_path):
    path = str(tmp_path / "keys")
    spark.range(100_000).write.option("compression", "zstd").parquet(path)
    size = lambda: spark.read.parquet(path)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    plain = size()
    with rows_weighed(spark):
        assert size() == 8 * plain
    assert size() == plain
