"""Approximate nearest neighbours by cosine, from robust-pruned graphs.

Vectors are dealt into shards. A shard's graph starts at random; a greedy search for each vector
then proposes neighbours, of which robust pruning keeps those that no kept one is much
nearer to, so some edges lead far. A query goes through every shard's graph with a beam,
and the best of all shards are its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import store

SHARD_ROWS = 8192
QUERY_ROWS = 2048
DEGREE = 32
BUILD_BEAM = 48
BEAM = 128
RELAXED = 1.2
BATCH = 512
ENTRIES = 8


def _distances(vectors: np.ndarray, rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of unit vectors: of each point to its row of vectors. Differences are
    squared, as a product near 1 cannot tell near vectors apart."""
    between = vectors[rows] - points[:, None, :]
    return np.einsum("brd,brd->br", between, between)


def beam_search(
    vectors: np.ndarray, graph: np.ndarray, points: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest found of each point and their squared distances, nearest first.

    All points go at once: each takes the nearest vector it has not been at, and holds the best of
    what its edges lead to. -1 stands where fewer are found.
    """
    n, count = len(vectors), len(points)
    entries = np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(np.int64))
    ids = np.full((count, beam), -1, dtype=np.int64)
    far = np.full((count, beam), np.inf, dtype=np.float32)
    width = min(beam, len(entries))
    start = np.broadcast_to(entries[:width], (count, width))
    first = _distances(vectors, start, points)
    order = np.argsort(first, axis=1, kind="stable")
    ids[:, :width], far[:, :width] = np.take_along_axis(start, order, 1), np.take_along_axis(first, order, 1)
    been = np.zeros((count, beam), dtype=bool)
    seen = np.zeros((count, n + 1), dtype=bool)
    seen[:, entries] = True
    active = np.arange(count)
    while len(active):
        waiting = ~been[active] & (ids[active] >= 0)
        any_left = waiting.any(axis=1)
        active = active[any_left]
        if not len(active):
            break
        at = waiting[any_left].argmax(axis=1)
        here = ids[active, at]
        been[active, at] = True
        near = graph[here]
        new = (near >= 0) & ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        away = np.where(new, _distances(vectors, np.maximum(near, 0), points[active]), np.inf)
        all_ids = np.concatenate([ids[active], near], axis=1)
        all_far = np.concatenate([far[active], away], axis=1)
        all_been = np.concatenate([been[active], np.zeros(near.shape, bool)], axis=1)
        order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        far[active] = np.take_along_axis(all_far, order, 1)
        ids[active] = np.where(np.isfinite(far[active]), np.take_along_axis(all_ids, order, 1), -1)
        been[active] = np.take_along_axis(all_been, order, 1)
    return ids, far


def robust_prune(
    vectors: np.ndarray, points: np.ndarray, ids: np.ndarray, degree: int, relaxed: float
) -> np.ndarray:
    """Of each point's candidates, up to ``degree`` diverse ones: the nearest is kept, and what is
    ``relaxed`` times nearer to it than to the point goes; then the nearest of the rest."""
    far = np.where(ids >= 0, _distances(vectors, np.maximum(ids, 0), vectors[points]), np.inf)
    far = np.where(ids == points[:, None], np.inf, far)
    order = np.argsort(far, axis=1, kind="stable")
    ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
    same = np.sort(ids, axis=1)
    if (same[:, 1:] == same[:, :-1]).any():  # a candidate may be named twice
        twice = (ids[:, :, None] == ids[:, None, :]) & np.tri(ids.shape[1], k=-1, dtype=bool)
        far = np.where(twice.any(axis=2), np.inf, far)
    kept = np.full((len(points), degree), -1, dtype=np.int64)
    rows = np.arange(len(points))
    for place in range(degree):
        best = far.argmin(axis=1)
        open_ = np.isfinite(far[rows, best])
        if not open_.any():
            break
        chosen = np.where(open_, ids[rows, best], -1)
        kept[:, place] = chosen
        between = _distances(vectors, np.maximum(ids, 0), vectors[np.maximum(chosen, 0)])
        gone = (relaxed**2) * between <= far
        gone[rows, best] = True
        far = np.where(gone & open_[:, None], np.inf, far)
    return kept


def build_graph(vectors: np.ndarray, seed: int = 1) -> np.ndarray:
    """Up to ``DEGREE`` edges from each unit vector, -1 where there are fewer."""
    n = len(vectors)
    random = np.random.default_rng(seed)
    graph = np.full((n, DEGREE), -1, dtype=np.int64)
    if n <= DEGREE + 1:
        for i in range(n):
            graph[i, : n - 1] = np.delete(np.arange(n), i)
        return graph
    some = random.integers(0, n - 1, (n, DEGREE // 2))
    graph[:, : DEGREE // 2] = some + (some >= np.arange(n)[:, None])
    order = random.permutation(n)
    for start in range(0, n, BATCH):
        points = order[start : start + BATCH]
        found, _ = beam_search(vectors, graph, vectors[points], BUILD_BEAM)
        candidates = np.concatenate([found, graph[points]], axis=1)
        graph[points] = robust_prune(vectors, points, candidates, DEGREE, RELAXED)
        _add_reverse(vectors, graph, points)
    return graph


def _add_reverse(vectors: np.ndarray, graph: np.ndarray, points: np.ndarray) -> None:
    """An edge back along each edge of ``points``; a full vector is pruned anew."""
    ends, begins = graph[points].ravel(), np.repeat(points, graph.shape[1])
    begins, ends = begins[ends >= 0], ends[ends >= 0]
    order = np.argsort(ends, kind="stable")
    ends, begins = ends[order], begins[order]
    nodes, first, sizes = np.unique(ends, return_index=True, return_counts=True)
    # So many edges at once that each vector's fit in a row; the rest come in the next turn.
    for turn in range(0, int(sizes.max(initial=0)), DEGREE):
        left = np.flatnonzero(sizes > turn)
        place = first[left][:, None] + turn + np.arange(DEGREE)
        within = turn + np.arange(DEGREE) < sizes[left][:, None]
        more = np.where(within, begins[np.minimum(place, len(begins) - 1)], -1)
        owners = nodes[left]
        more = np.where((more[:, :, None] == graph[owners][:, None, :]).any(axis=2), -1, more)
        room = (graph[owners] < 0).sum(axis=1)
        fits = (more >= 0).sum(axis=1) <= room
        for owner, extra in zip(owners[fits].tolist(), more[fits], strict=True):
            extra = extra[extra >= 0]
            graph[owner, np.flatnonzero(graph[owner] < 0)[: len(extra)]] = extra
        full = np.flatnonzero(~fits)
        for i in range(0, len(full), BATCH):
            some = full[i : i + BATCH]
            both = np.concatenate([graph[owners[some]], more[some]], axis=1)
            graph[owners[some]] = robust_prune(vectors, owners[some], both, DEGREE, RELAXED)


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return finite & F.exists(vector, lambda x: x != 0)


def direction(vector: Column) -> Column:
    """A vector divided by the power of two that brings its largest component to 1 or more and
    below 2. Nothing is rounded, so vectors that are such multiples of one another have one
    direction, and equal cosines to the last bit."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    largest = F.array_max(F.transform(wide, lambda x: F.abs(x)))
    # The addend makes up for a logarithm that falls short of a whole number by its last bit.
    scale = F.pow(F.lit(2.0), F.floor(F.log2(largest) + 1e-9).cast("double"))
    return F.transform(wide, lambda x: x / scale)


def _dealt(df: DataFrame, rows: int, name: str, by: str) -> DataFrame:
    """Add ``name``, a number by hash so that about ``rows`` rows of one length share it, and
    ``{name}s``, how many numbers there are."""
    counts = df.groupBy("length").agg(F.ceil(F.count("*") / rows).cast("int").alias(f"{name}s"))
    numbered = df.join(counts, "length")
    return numbered.withColumn(name, F.pmod(F.xxhash64(by), F.col(f"{name}s")).cast("int"))


def _tasks(df: DataFrame, name: str) -> int:
    """Twice as many tasks as there are numbers, so that few of these share one."""
    sizes = df.groupBy("length").agg(F.max(f"{name}s").alias("n"))
    return 2 * (sizes.agg(F.sum("n")).first()[0] or 1)


def build_index(vectors: DataFrame) -> DataFrame:
    """One row per shard: ``length``, ``shard``, ``shards`` (how many of this length) and, as bytes, its
    ``ids``, ``vectors`` and ``graph``.

    ``vectors`` has ``id``, ``vector`` and ``length``. A shard has about ``SHARD_ROWS`` rows however many
    there are, and is rebuilt alike if a task is run again. There are as many tasks as shards: the
    work is in the graphs, not in the bytes.
    """

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        own = np.stack(rows["vector"].to_numpy()).astype(np.float32)
        graph = build_graph(_unit(own)).astype(np.int32)
        cells = [rows[name].iloc[0] for name in ("length", "shard", "shards")]
        cells.append(rows["id"].to_numpy(np.int64).tobytes())
        return pd.DataFrame(
            [[*cells, own.tobytes(), graph.tobytes()]],
            columns=["length", "shard", "shards", "ids", "vectors", "graph"],
        )

    dealt = _dealt(vectors, SHARD_ROWS, "shard", "id")
    dealt = store(dealt.select("length", "shard", "shards", "id", "vector"), "dealt-vectors")
    spread = dealt.repartition(_tasks(dealt, "shard"), "length", "shard")
    return spread.groupBy("length", "shard").applyInPandas(
        build, "length int, shard int, shards int, ids binary, vectors binary, graph binary"
    )


def _best(
    sought: np.ndarray, vectors: np.ndarray, found: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All found vectors ranked by their cosines: of each query the ``k`` nearest, and what ties
    with the last of them. Gives the query's place, the vector's, and the cosine."""
    rows, hits, scores = [], [], []
    step = max(1, (1 << 22) // (found.shape[1] * sought.shape[1]))
    for start in range(0, len(sought), step):
        row, place = np.nonzero(found[start : start + step] >= 0)
        hit = found[start + row, place]
        score = np.full(found[start : start + step].shape, -np.inf)
        score[row, place] = cosines(sought[start + row], vectors[hit])
        last = -np.sort(-score, axis=1)[:, min(k, score.shape[1]) - 1]
        kept = score[row, place] >= last[row]
        rows.append(start + row[kept])
        hits.append(hit[kept])
        scores.append(score[row, place][kept])
    return np.concatenate(rows), np.concatenate(hits), np.concatenate(scores)


def search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each query in each shard, and those that tie: ``query``, ``id``, ``score``.

    Queries (``query``, ``vector``, ``length``) come in blocks, and every block goes to every shard of
    its length. A shard moves once and the blocks pass by it one at a time, so a task holds one
    of each. All ids in the beam are ranked by their cosines.
    """

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("query")
        own = np.stack(rows["vector"].to_numpy()).astype(np.float32)
        cells = [rows["length"].iloc[0], rows["block"].iloc[0]]
        cells += [rows["query"].to_numpy(np.int64).tobytes(), own.tobytes()]
        return pd.DataFrame([cells], columns=["length", "block", "queries", "sought"])

    dealt = _dealt(queries, QUERY_ROWS, "block", "query")
    packed = dealt.select("length", "block", "query", "vector").groupBy("length", "block")
    blocks = packed.applyInPandas(pack, "length int, block int, queries binary, sought binary")
    numbers = index.select("length", "shard")
    sent = store(blocks, "query-blocks").join(numbers, "length")
    kinds = ("length", "shard", "block", "names", "vectors", "graph")
    sent = sent.select("length", "shard", "block", "queries", "sought", F.lit(None).cast("binary"))
    shards = index.select("length", "shard", F.lit(-1), "ids", "vectors", "graph")
    both = shards.toDF(*kinds).union(sent.toDF(*kinds))
    laid = both.repartition(_tasks(index, "shard"), "length", "shard")
    laid = laid.sortWithinPartitions("length", "shard", "block")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = vectors = unit = graph = None
        for batch in batches:
            for i in range(batch.num_rows):
                length, _, block, names, held, edges = (column[i].as_py() for column in batch.columns)
                names = np.frombuffer(names, np.int64)
                held = np.frombuffer(held, "f4").reshape(-1, length)
                if block < 0:
                    ids, vectors, unit = names, held, _unit(held)
                    graph = np.frombuffer(edges, np.int32).reshape(-1, DEGREE).astype(np.int64)
                    continue
                for start in range(0, len(names), BATCH):
                    own, named = held[start : start + BATCH], names[start : start + BATCH]
                    found, _ = beam_search(unit, graph, _unit(own), BEAM)
                    row, hit, score = _best(own, vectors, found, k)
                    made = [pa.array(column) for column in (named[row], ids[hit], score)]
                    yield pa.RecordBatch.from_arrays(made, names=["query", "id", "score"])

    return laid.mapInArrow(run, "query bigint, id bigint, score double")


def nearest(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The ``k`` nearest found of each query: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``.

    Queries are the rows whose ``vec_id`` is divisible by ``every``; candidates are all rows of other
    ids. Nearness is the cosine in double precision, ties go to the smaller id; fewer candidates
    than ``k`` are all returned. A vector that is null, all zeros, or has a null or non-finite
    component takes no part, nor does a null id; vectors of different lengths do not meet. Rows
    repeated with id and vector count once, and rows of one id with other vectors are
    queries each. Other columns are not read.

    Vectors of one direction, that is equal but for a power of two, are one point of the graph. Of
    the ids at a point, the ``k + 1`` smallest can be among the ``k`` nearest of any query, so these
    are kept with it. Points and queries are told apart by 64-bit hashes of what they are.
    """
    vector = F.col("embedding").cast("array<float>")
    rows = embeddings.select(embeddings["vec_id"].cast("bigint").alias("id"), vector.alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).where(_usable(F.col("vector")))
    once = rows.groupBy("id", "vector").agg(F.size("vector").alias("length"))
    by_id = Window.partitionBy("direction").orderBy("id", "vector")
    directed = once.withColumn("direction", direction(F.col("vector")))
    first = directed.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1)
    points = first.groupBy("direction").agg(
        F.min_by("vector", "place").alias("vector"),
        F.min("length").alias("length"),
        F.collect_list("id").alias("same"),
    )
    # A point is named by a number of its own, as rows of one id may have several vectors.
    points = points.select(F.xxhash64("direction").alias("id"), "vector", "length", "same")
    points = store(points, "points")
    index = store(build_index(points.select("id", "vector", "length")), "graphs")
    queries = once.where(F.col("id") % every == 0)
    queries = store(queries.withColumn("query", F.xxhash64("id", "vector")), "queries")
    # First the points, of which the query's own may be one, then the ids at them.
    found = search(index, queries.select("query", "vector", "length"), k + 1)
    near = Window.partitionBy("query").orderBy(F.desc("score"))
    near = found.withColumn("place", F.rank().over(near)).where(F.col("place") <= k + 1)
    named = near.join(points.select("id", "same"), "id").select(
        "query", "score", F.explode("same").alias("vec_id")
    )
    named = named.join(queries.select("query", F.col("id").alias("query_id")), "query")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = named.where("vec_id <> query_id").withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
