import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillwise.operators.ranking import rank_scores, top_k, value_counts, with_share


def _quantile_scores(values, ids):
    """Scores by the definition: the row at place r of n, from 1, lies in the first fifth whose
    upper edge, 1 + k (n - 1) / 5, is not below r; ties in id order."""
    ordered = sorted(zip(values, ids, strict=True))
    n, scores = len(ordered), {}
    for place, (_, id_) in enumerate(ordered, 1):
        scores[id_] = next(k for k in range(1, 6) if 5 * place <= 5 + k * (n - 1))
    return scores


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 7, 8, 9, 11, 12])
def test_scores_of_few_rows(spark, n):
    values = [float(i * 7 % n) for i in range(n)]
    df = spark.createDataFrame(list(zip(range(n), values)), "id long, v double")
    got = dict(rank_scores(df, "id", {"s": "v"}).select("id", "s").collect())
    assert got == _quantile_scores(values, range(n))


def test_known_scores(spark):
    for n, want in [(1, [1]), (2, [1, 5]), (3, [1, 3, 5]), (7, [1, 1, 2, 3, 4, 5, 5])]:
        df = spark.range(n).withColumn("v", F.col("id") * 2)
        got = rank_scores(df, "id", {"s": "v"}).orderBy("id").collect()
        assert [r.s for r in got] == want
    assert rank_scores(spark.range(0).withColumn("v", F.lit(1)), "id", {"s": "v"}).count() == 0


@pytest.mark.parametrize("buckets", [2, 7, 50])
@pytest.mark.parametrize("text_ids", [False, True])
def test_scores_with_many_ties(spark, buckets, text_ids):
    pick = random.Random(buckets)
    n = 3001
    ids = [f'c"{i:05d}' if text_ids else i * 3 for i in range(n)]
    pick.shuffle(ids)
    # A third of the rows share one value.
    few = [1 if pick.random() < 0.34 else pick.randint(1, 4) for _ in ids]
    many = [round(pick.random() * 100, 2) for _ in ids]
    kind = "string" if text_ids else "long"
    data = list(zip(ids, few, many))
    df = spark.createDataFrame(data, f"id {kind}, few int, many double").repartition(6)
    scored = rank_scores(df, "id", {"a": "few", "b": "many"}, buckets=buckets, rows_per_bucket=40)
    got = scored.select("id", "a", "b").collect()
    assert {r.id: r.a for r in got} == _quantile_scores(few, ids)
    assert {r.id: r.b for r in got} == _quantile_scores(many, ids)


def test_scores_equal_a_plain_window(spark):
    df = spark.range(5000).selectExpr("id", "id * 7919 % 101 as v")
    order = Window.orderBy("v", "id")
    rank, n = F.row_number().over(order), 5000
    plain = df.select("id", F.greatest(F.lit(1), F.ceil(5 * (rank - 1) / (n - 1))).alias("p"))
    both = rank_scores(df, "id", {"s": "v"}, buckets=16).join(plain, "id")
    assert both.where("s <> p").count() == 0


def test_decimal_ids(spark):
    df = spark.range(500).selectExpr("cast(id as decimal(20,2)) as id", "id % 3 as v")
    plain = spark.range(500).selectExpr("id", "id % 3 as v")
    got, want = (
        [r.s for r in rank_scores(x, "id", {"s": "v"}, buckets=9).orderBy("id").collect()]
        for x in (df, plain)
    )
    assert got == want


def test_top_k_ties_and_nulls(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", None), ("d", 1.0)], "k string, m double")
    assert [r.k for r in top_k(df, "m", 1, "k").collect()] == ["a"]
    assert [r.k for r in top_k(df, "m", 9, "k").collect()] == ["a", "b", "d", "c"]


def test_value_counts(spark):
    df = spark.createDataFrame([("x",), ("y",), ("y",), ("a",), (None,), ("",)], "v string")
    got = [tuple(r) for r in value_counts(df, "v").collect()]
    assert got == [("y", 2), ("", 1), ("a", 1), ("x", 1)]


def test_share_of_nothing_is_zero(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "k string, m double")
    assert [r.share_pct for r in with_share(df, "m").collect()] == [0.0, 0.0]
