"""Top-n, value counts, shares, and scores by global rank."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.binding import first_match, free_name
from ..functions.numbers import exact_sum
from ..sources.store import materialize


def top_k(df: DataFrame, measure: str, k: int, *tie: str) -> DataFrame:
    """The ``k`` rows with the largest measure, nulls last, ties by the smaller ``tie`` key."""
    return df.orderBy(F.desc_nulls_last(measure), *[F.asc(name) for name in tie]).limit(k)


def value_counts(df: DataFrame, column: str, count: str = "count") -> DataFrame:
    """Rows per non-null value, most frequent first, ties by value."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column)
    return counted.agg(F.count(F.lit(1)).alias(count)).orderBy(F.desc(count), F.asc(column))


def with_share(df: DataFrame, measure: str, share: str = "share_pct") -> DataFrame:
    """Add each row's percentage of the column total, which is a scalar subquery."""
    total = df.agg(exact_sum(measure)).scalar()
    return df.withColumn(
        share, F.when(total > 0, F.col(measure) * 100.0 / total).otherwise(F.lit(0.0))
    )


# Rows that one task may sort, the buckets a range of ranks is cut into at a time, and the
# sampled rows per bucket that place the cuts.
ROWS_PER_BUCKET = 250_000
BUCKETS = 64
SAMPLE_PER_BUCKET = 32
HASH_RANGE = 2**30

Key = tuple[float, object]


@dataclass(frozen=True)
class Span:
    """A range of keys, low included and high not, with its rows and the ranks sought there."""

    score: str
    low: Key | None
    high: Key | None
    before: int
    size: int
    ranks: tuple[int, ...]


def rank_scores(
    df: DataFrame,
    id_column: str,
    metrics: Mapping[str, str],
    bins: int = 5,
    buckets: int = BUCKETS,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Score every row 1..``bins`` by its rank in each metric.

    ``metrics`` maps a score column to the numeric column it ranks, ascending; equal values
    rank by the unique ``id_column``. With n rows, rank r scores
    ``ceil(bins * (r - 1) / (n - 1))``, at least 1: the quantile bins of the ranks, closed on
    the right.

    No rank is ever computed for all rows. A score only changes at ``bins - 1`` ranks, so it
    is enough to find the rows that hold those ranks. Sampled cut points split the (value, id)
    keys into buckets; their sizes tell which few buckets hold the wanted ranks. A bucket with
    more than ``rows_per_bucket`` rows is cut again in the same way, and only what is small
    enough is sorted. The driver sees samples, sizes and wanted rows, the same number of them
    for any number of rows. ``df`` is read several times and should be a stored table.
    """
    n = df.count()
    id_type = df.schema[id_column].dataType
    keys = {
        score: F.struct(F.col(column).cast("double").alias("value"), F.col(id_column).alias("id"))
        for score, column in metrics.items()
    }
    ranks = [(score - 1) * (n - 1) // bins + 2 for score in range(2, bins + 1)]
    wanted = tuple(rank for rank in ranks if rank <= n)
    spans = [Span(score, None, None, 0, n, wanted) for score in keys if wanted]
    rows = _per_metric(df, {score: [key.alias("key")] for score, key in keys.items()})
    found: dict[tuple[str, int], Key] = {}
    while spans:
        cut = _cut_again(rows, spans, id_type, buckets)
        small = [span for span in cut if span.size <= rows_per_bucket or span in spans]
        found |= _keys_at_ranks(rows, small, id_type)
        spans = [span for span in cut if span not in small]
    edges = {score: [found[score, rank] for rank in wanted] for score in keys}
    return df.withColumns(
        {
            score: F.lit(1) + _position(key, edges[score], id_type)
            for score, key in keys.items()
        }
    )


def _position(key: Column, sorted_keys: Sequence[Key], id_type: T.DataType) -> Column:
    """How many of the sorted keys are not above ``key``."""
    if not sorted_keys:
        return F.lit(0)
    edges = _constant(sorted_keys, id_type)
    return F.size(F.filter(edges, lambda edge: edge <= key))


def _constant(keys: Sequence[Key], id_type: T.DataType) -> Column:
    kind = T.StructType([T.StructField("value", T.DoubleType()), T.StructField("id", id_type)])
    rows = [{"value": value, "id": id_} for value, id_ in keys]
    return F.from_json(F.lit(json.dumps(rows, default=str)), T.ArrayType(kind))


def _numbered(rows: DataFrame, spans: Sequence[Span], id_type: T.DataType) -> DataFrame:
    """The rows that lie in a span, with its number."""
    cases = []
    for number, span in enumerate(spans):
        within = F.col("score") == span.score
        if span.low is not None:
            within &= F.col("key") >= _constant([span.low], id_type)[0]
        if span.high is not None:
            within &= F.col("key") < _constant([span.high], id_type)[0]
        cases.append((within, F.lit(number)))
    held = rows.withColumn("span", first_match(cases, F.lit(None).cast("int")))
    return held.where(F.col("span").isNotNull())


def _cut_again(
    rows: DataFrame, spans: Sequence[Span], id_type: T.DataType, buckets: int
) -> list[Span]:
    """The parts of the spans that hold the sought ranks, after cutting each into buckets."""
    held = _numbered(rows, spans, id_type)
    # Rows with a small hash are a uniform sample, picked in each task by itself.
    share = [min(1.0, buckets * SAMPLE_PER_BUCKET / span.size) * HASH_RANGE for span in spans]
    shares = F.array(*[F.lit(s) for s in share])
    picked = F.pmod(F.xxhash64("key.id", "score"), F.lit(HASH_RANGE)) < F.get(shares, F.col("span"))
    sampled: dict[int, list[Key]] = {number: [] for number in range(len(spans))}
    for row in held.where(picked).select("span", "key").collect():
        sampled[row["span"]].append((row["key"]["value"], row["key"]["id"]))
    cuts = {}
    for number, found in sampled.items():
        ordered = sorted(found, key=lambda key: (key[0] is not None, key[0] or 0.0, key[1]))
        step = max(1, len(ordered) // buckets)
        cuts[number] = ordered[step::step]
    cases = [(F.col("span") == i, _position(F.col("key"), cuts[i], id_type)) for i in cuts]
    sizes: dict[int, dict[int, int]] = {number: {} for number in cuts}
    placed = held.select("span", first_match(cases, F.lit(0)).alias("place"))
    for number, place, count in placed.groupBy("span", "place").count().collect():
        sizes[number][place] = count
    parts: list[Span] = []
    for number, span in enumerate(spans):
        before = span.before
        edges = [span.low, *cuts[number], span.high]
        for place in sorted(sizes[number]):
            size = sizes[number][place]
            ranks = tuple(rank for rank in span.ranks if before < rank <= before + size)
            if ranks:
                parts.append(Span(span.score, edges[place], edges[place + 1], before, size, ranks))
            before += size
    return parts


def _keys_at_ranks(
    rows: DataFrame, spans: Sequence[Span], id_type: T.DataType
) -> dict[tuple[str, int], Key]:
    """The keys at the sought ranks of spans that are small enough to sort."""
    if not spans:
        return {}
    order = Window.partitionBy("span").orderBy("key")
    ranked = _numbered(rows, spans, id_type).withColumn("rank", F.row_number().over(order))
    spots = [(i, rank - span.before) for i, span in enumerate(spans) for rank in span.ranks]
    picked = ranked.where(_one_of(["span", "rank"], spots)).select("span", "rank", "key").collect()
    return {
        (spans[r["span"]].score, spans[r["span"]].before + r["rank"]): tuple(r["key"]) for r in picked
    }


def _per_metric(df: DataFrame, fields: Mapping[str, Sequence[Column]]) -> DataFrame:
    """One row per input row and metric, with the metric's name and its fields."""
    entries = [F.struct(F.lit(score).alias("score"), *cols) for score, cols in fields.items()]
    return df.select(F.inline(F.array(*entries)))


def _one_of(columns: Sequence[str], rows: Iterable[tuple]) -> Column:
    equal = [
        reduce(and_, [F.col(name) == value for name, value in zip(columns, row, strict=True)])
        for row in sorted(rows)
    ]
    return reduce(or_, equal)


def global_rank(
    df: DataFrame, order: Sequence[str | Column], name: str = "rank", buckets: int | None = None
) -> DataFrame:
    """Add ``name``, the number of each row from 1 in ascending order of ``order``, nulls first.

    The same numbers as ``row_number`` over all rows, without gathering them in one task. Rows
    are dealt into ``buckets`` ranges by sampled cut points and sorted there; the sorted buckets are
    stored, so cut points and places stay as they are whatever is computed again, and a bucket's
    rows come after those of all buckets before it, whose sizes are all that is added up. A hash
    of the whole row comes after ``order``: rows that tie are numbered the same way in every run,
    and very many ties are cut into several buckets as well. Rows that are equal in all columns are
    numbered as they come. Other columns are kept, also such with the names used here.
    """
    spark = df.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = free_name([*df.columns, name], "_place")
    # The upper bits of the number are the bucket's, the lower 33 the row's within it.
    keys = [*order, F.xxhash64(*[F.col(f"`{column}`") for column in df.columns])]
    ranges = df.repartitionByRange(count, *keys).sortWithinPartitions(*keys)
    stored = materialize(ranges.withColumn(place, F.monotonically_increasing_id()), "ranked")
    bucket = F.shiftright(place, IN_BUCKET)
    sizes = stored.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("size"))
    # One number for each bucket, however many rows there are.
    before, starts = 0, []
    for number, size in sorted(sizes.collect()):
        starts += [0] * (number - len(starts)) + [before]
        before += size
    offsets = F.array(*[F.lit(start).cast("bigint") for start in starts or [0]])
    row = F.col(place).bitwiseAND(F.lit((1 << IN_BUCKET) - 1))
    return stored.withColumn(name, F.get(offsets, bucket.cast("int")) + row + 1).drop(place)


IN_BUCKET = 33
