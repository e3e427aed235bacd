"""Graph search against all cosines."""

import math

import numpy as np
import pytest

from tillwise.llm import neighbours
from tillwise.llm.neighbours import beam_search, build_graph, nearest, robust_prune


def by_all_pairs(rows, k, every):
    usable = [
        (i, np.array(v, np.float32).astype(float))
        for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows if i is not None and v is not None)
        if len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    found = []
    for q, a in usable:
        if q % every:
            continue
        near = []
        for i, b in usable:
            if i != q and len(a) == len(b):
                near.append((-(a @ b) / (np.sqrt(a @ a) * np.sqrt(b @ b)), i))
        near = sorted((round(s, 12), i) for s, i in near)[:k]
        found += [(q, rank, i, -s) for rank, (s, i) in enumerate(near, 1)]
    return sorted(found)


def table(spark, rows):
    return spark.createDataFrame(
        [(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, id int, vector string"
    )


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [-1.0, 1.0])]
    rows += [(100, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0])]
    rows += [(None, [1.0, 1.0]), (8, []), (150, [1.0, 2.0, 3.0]), (9, [1.0, 2.0, 2.0]), (1, [1.0, 0.0])]
    rows += [(i, [1.0, 0.0]) for i in range(200, 230)]
    got = sorted(tuple(r) for r in nearest(table(spark, rows)).collect())
    got = [(q, r, i, round(s, 12)) for q, r, i, s in got]
    assert got == by_all_pairs(rows, 5, 50)
    assert nearest(table(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("shard_rows", [300, 5000])
def test_recall(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", shard_rows)
    random = np.random.default_rng(2)
    centres = random.normal(size=(8, 24))
    vectors = (centres[random.integers(0, 8, 2000)] + 0.5 * random.normal(size=(2000, 24))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    got = [tuple(r) for r in nearest(table(spark, rows)).collect()]
    want = by_all_pairs(rows, 5, 50)
    assert len(got) == len(want)
    right = {(q, i) for q, _, i, _ in want} & {(q, i) for q, _, i, _ in got}
    assert len(right) >= 0.9 * len(want)
    scores = {(q, i): s for q, _, i, s in want}
    assert all(abs(scores[q, i] - s) < 1e-11 for q, _, i, s in got if (q, i) in scores)


def test_pruning_keeps_diverse_edges():
    line = np.array([[1.0, 0], [0.99, 0.14107], [0.98, 0.199], [0.0, -1.0]], dtype=np.float32)
    line /= np.linalg.norm(line, axis=1, keepdims=True)
    kept = robust_prune(line, np.array([0]), np.array([[2, 1, 3, 1, -1, 0]]), 4, 1.0)
    assert kept[0].tolist() == [1, 3, -1, -1]


def test_small_graphs():
    for n in (1, 2, 5, 40):
        vectors = np.random.default_rng(n).normal(size=(n, 6)).astype(np.float32)
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        ids, _ = beam_search(vectors, build_graph(vectors), vectors, 10)
        assert (ids[:, 0] == np.arange(n)).all()


def test_multiples_of_one_vector(spark):
    """Cosines that are equal to the last bit go to the smallest ids."""
    base = np.random.default_rng(1).normal(size=16).astype(np.float32)
    rows = [(i, (base * np.float32(2.0 ** ((i * 7) % 28 - 14))).tolist()) for i in range(28)]
    got = sorted(tuple(r) for r in nearest(table(spark, rows)).collect())
    assert [i for _, _, i, _ in got] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("noise", [1e-2, 1e-3, 3e-4, 1e-4])
def test_tight_clusters(spark, noise):
    random = np.random.default_rng(7)
    centres = random.normal(size=(6, 64))
    vectors = centres[random.integers(0, 6, 1500)] + noise * random.normal(size=(1500, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors.astype(np.float32))]
    got = {(q, i) for q, _, i, _ in nearest(table(spark, rows)).collect()}
    want = {(q, i) for q, _, i, _ in by_all_pairs(rows, 5, 50)}
    assert len(got & want) >= 0.95 * len(want)


def test_recall_of_the_query(spark):
    from tillwise.llm.registry import llm_queries

    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = {(q, i) for q, _, i, _ in by_all_pairs(rows, 5, 50)}
    got = {(r.query_id, r.vec_id) for r in llm_queries()["op3_neighbours"](spark, folder).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.95 * len(want)
