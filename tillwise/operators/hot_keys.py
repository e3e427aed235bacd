"""Very frequent keys of a table, and joins that split only these.

A shuffle join sends all rows of a key to one task. ``hot_join`` deals the rows of each frequent
key to several tasks and copies only what the other side has under these keys; ordinary keys are
neither split nor copied. The frequent keys come from ``frequent_keys``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binding import free_name

# A key is frequent from this share of all rows on.
SHARE = 0.001
# Pieces per task into which a key with all rows would be dealt.
PIECES = 4
JOINS = ("inner", "left", "left_semi", "left_anti")
# Types that have no hash.
_UNHASHED = ("map", "variant")


def frequent_keys(df: DataFrame, column: str, share: float = SHARE) -> DataFrame:
    """``key``, ``n`` and ``share`` of each value that at least ``share`` of all rows have.

    A first pass keeps a bounded number of counters per task and merges them. What it can miss is
    below a third of ``share``, so its ``2 / share`` largest hold every frequent value; a
    second pass counts these exactly. Nulls count as rows, not as a value. An empty table has no
    frequent values. Meant to be stored if it is used more than once.
    """
    if not 1e-5 <= share <= 1:
        raise ValueError(f"a share of rows is between 0.00001 and 1, not {share!r}")
    least = math.ceil(1 / share)
    keys = df.select(F.col(f"`{column}`").alias("key"))
    tops = keys.agg(
        F.expr(f"approx_top_k(key, {2 * least}, {10 * least}) FILTER (WHERE key IS NOT NULL)").alias("tops"),
        F.count(F.lit(1)).alias("total"),
    )
    candidates = tops.select("total", F.explode("tops.item").alias("candidate"))
    # At most 2 / share rows, whatever the table.
    met = keys.join(F.broadcast(candidates), F.col("key") == F.col("candidate"))
    counted = met.groupBy("key", "total").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.select("key", "n", (F.col("n") / F.col("total")).alias("share"))
    return counted.where(F.col("share") >= share)


def hot_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    frequent: DataFrame,
    how: str = "left",
    spread: Sequence[str] = (),
) -> DataFrame:
    """``left`` joined with ``right`` on equal keys; the columns of both, as a plain join gives them.

    ``frequent`` is what ``frequent_keys`` finds for ``left_key``. A frequent key with a share s of the
    rows is dealt to s x ``PIECES`` x (shuffle partitions) places, so the copies of right rows under
    all keys together are as many as the shuffle has tasks, times ``PIECES``, for each right
    row of a key. Rows without a key match nothing and are dealt to all tasks. The place of a row is
    a hash of its ``spread`` columns, by default all; equal rows share a place.
    """
    if how not in JOINS:
        raise ValueError(f"a split join is one of {', '.join(JOINS)}, not {how!r}")
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    used = [*left.columns, *right.columns]
    key, pieces, place, copy = (free_name(used, name) for name in ("_hot", "_pieces", "_place", "_copy"))
    parts = F.ceil(F.col("share") * PIECES * tasks).cast("int")
    # Bounded by 1 / share rows.
    hot = F.broadcast(frequent.select(F.col("key").alias(key), parts.alias(pieces)))
    each = F.coalesce(F.col(pieces), F.lit(1))

    hashed = spread or [f.name for f in left.schema if f.dataType.typeName() not in _UNHASHED]
    number = F.xxhash64(*[F.col(f"`{name}`") for name in hashed])
    dealt = left.join(hot, F.col(f"`{left_key}`") == F.col(key), "left")
    among = F.when(F.col(f"`{left_key}`").isNull(), F.lit(tasks)).otherwise(each)
    dealt = dealt.withColumn(place, F.pmod(number, among).cast("int")).drop(key, pieces)

    copied = right.join(hot, F.col(f"`{right_key}`") == F.col(key), "left")
    copies = F.explode(F.sequence(F.lit(0), each - 1))
    copied = copied.withColumn(copy, copies).drop(key, pieces)
    same = (dealt[f"`{left_key}`"] == copied[f"`{right_key}`"]) & (F.col(place) == F.col(copy))
    return dealt.join(copied, same, how).drop(place, copy)
