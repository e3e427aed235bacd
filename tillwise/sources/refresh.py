"""Refreshing stored tables by batches of changed orders."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import ExitStack
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import free_name
from ..schemas import require_columns
from .store import MONTH, SMALL, month_of, new_path, rows_weighed, shuffles_freed, write_by


# A refresh rewrites its months in turns: so many, unless a turn would have fewer rows than this.
TURNS = 8
TURN_ROWS = 4_000_000


class Stored(NamedTuple):
    """Rows as a Parquet table of their own."""

    rows: DataFrame
    path: str

    def remove(self) -> None:
        """Remove the table, once nothing is read from it any more."""
        _remove(self.rows.sparkSession, self.path)


@dataclass(frozen=True)
class Change:
    """What a refresh did: the rows that went, the rows that came, and the months rewritten.

    The rows are tables in the shared folder; ``remove`` removes them, and what is left of them when the
    session's process ends goes then.
    """

    gone: DataFrame
    come: DataFrame
    months: tuple[object, ...]
    stored: tuple[Stored, ...] = ()

    def remove(self) -> None:
        """Remove the rows that went and came, once nothing is read from them any more."""
        for table in self.stored:
            table.remove()


def refresh_by_month(
    rows: DataFrame,
    path: str,
    key: str = "order_id",
    updated: str = "order_updated_at",
    date: str = "order_date",
) -> Change:
    """Merge a batch of changed ``key`` values into the table stored by month at ``path``.

    ``rows`` hold whole versions: all rows of a key that were updated at one time replace all of
    its stored rows, if these are not newer. Of several versions in a batch the newest counts, a
    null time being the oldest; a null key is a key as any other. Where nothing is stored
    yet, the batch is the table.

    Only months that lose or gain rows are written anew, from their other stored rows and the
    batch's; all others keep their files. A key that moved to another month leaves the one it
    was in, and a month without rows left is removed. Stored rows are searched for the batch's keys
    by three columns alone. Rows that go and come are stored before anything is overwritten.

    On disk there are at once, beside the table and the batch, the rows that come, the rows that go, the
    new months, and what is shuffled for some of them: months are rewritten in ``TURNS`` turns beside the
    table, and take the place of the old ones when all are written. The batch's rows are shuffled only
    where very many of its keys lose rows, being older than stored ones or in several versions.
    """
    require_columns(rows, (key, updated, date), "refreshed rows")
    with ExitStack() as scratch:
        scratch.enter_context(shuffles_freed(rows.sparkSession))
        scratch.enter_context(rows_weighed(rows.sparkSession))
        batch = rows.withColumn(MONTH, month_of(rows, date))
        return _merge(batch, path, key, updated, scratch)


def materialize(rows: DataFrame, name: str) -> Stored:
    """A step of a refresh as Parquet in the shared folder: less than half the bytes of a checkpoint."""
    return _appended(rows, new_path(rows.sparkSession, name))


def _appended(rows: DataFrame, path: str) -> Stored:
    """The table at ``path``, if there is one, and ``rows``."""
    spark = rows.sparkSession
    rows.write.mode("append").option("compression", SMALL).parquet(path)
    name, files = _path(spark, path)
    files.deleteOnExit(name)
    return Stored(spark.read.schema(rows.schema).parquet(path), path)


def _merge(batch: DataFrame, path: str, key: str, updated: str, scratch: ExitStack) -> Change:
    spark = batch.sparkSession
    stored = spark.read.parquet(path) if _exists(spark, path) else None
    newest = _newest(batch, key, updated)
    if stored is None:
        accepted = newest.withColumns({"_in": F.lit(None), "_taken": F.lit(True)})
    else:
        accepted = materialize(_judged(newest, stored, key, updated), "accepted")
        scratch.callback(accepted.remove)
        accepted = accepted.rows
    dropped = accepted.where(~F.col("_taken") | F.col("_several")).select("_of", "_at", "_taken")
    # Stored by themselves, so that Spark knows how few they are.
    dropped = _appended(dropped, new_path(spark, "dropped"))
    scratch.callback(dropped.remove)
    come = materialize(_versions(batch, dropped.rows, key, updated), "come")
    kept = come.rows.select(MONTH)
    if stored is not None:
        left = accepted.where("_taken").select(F.inline("_in")).union(kept)
        months = [row[0] for row in left.distinct().collect()]
        kept = kept.unionByName(stored.where(_in_months(months)).select(MONTH))
    counts = dict(kept.groupBy(MONTH).count().collect())
    new = _beside(spark, path, "new")
    scratch.callback(_remove, spark, new)
    gone = Stored(come.rows.limit(0), new_path(spark, "gone"))
    for turn in _turns(counts):
        table = come.rows.where(_in_months(turn))
        if stored is None:
            write_by(table, MONTH, new, SMALL)
            continue
        marked = _marked(stored.where(_in_months(turn)), accepted, turn, key)
        went = marked.columns[-1]
        # One join tells the rows that go from those that stay, and one table holds both.
        marked = materialize(marked, "touched")
        scratch.callback(marked.remove)
        gone = _appended(marked.rows.where(F.col(went)).select(*come.rows.columns), gone.path)
        staying = marked.rows.where(F.col(went).isNull()).drop(went)
        write_by(staying.unionByName(table.select(*stored.columns)), MONTH, new, SMALL)
        marked.remove()
    if counts:
        _replace_months(spark, path, new, counts)
        spark.catalog.refreshByPath(path)
    return Change(gone.rows, come.rows, tuple(counts), (come, gone))


def _newest(batch: DataFrame, key: str, updated: str) -> DataFrame:
    """Each key of a batch, the time of its newest version, and whether it has several versions."""
    # A maximum passes over nulls, so it is null where all times are: the oldest.
    newest = batch.groupBy(F.col(key).alias("_of")).agg(
        F.max(updated).alias("_at"), F.min(updated).alias("_first"),
        F.max(F.col(updated).isNull()).alias("_untimed"),
    )
    several = F.col("_at").isNotNull() & (F.col("_untimed") | (F.col("_first") != F.col("_at")))
    return newest.select("_of", "_at", several.alias("_several"))


def _judged(newest: DataFrame, stored: DataFrame, key: str, updated: str) -> DataFrame:
    """The keys of a batch with the months they are stored in, and whether the batch's version is taken."""
    held = stored.select(F.col(key).alias("_held"), F.col(updated).alias("_when"), MONTH)
    same = F.col("_held").eqNullSafe(F.col("_of"))
    known = held.join(newest, same, "left_semi").groupBy("_held").agg(
        F.max("_when").alias("_stored"), F.collect_set(F.struct(MONTH)).alias("_in")
    )
    # Times are compared within structs, where a null comes before all others.
    not_older = F.struct(F.col("_at").alias("at")) >= F.struct(F.col("_stored").alias("at"))
    taken = (F.col("_in").isNull() | not_older).alias("_taken")
    return newest.join(known, same, "left").select("_of", "_at", "_several", "_in", taken)


def _versions(rows: DataFrame, dropped: DataFrame, key: str, updated: str) -> DataFrame:
    """The rows without those of keys that are not taken, and without older versions of the others."""
    names = ("_of", "_at", "_taken")
    of, at, taken = free = [free_name(rows.columns, name) for name in names]
    dropped = dropped.withColumnsRenamed(dict(zip(names, free, strict=True)))
    older = ~F.col(taken) | ~F.col(updated).eqNullSafe(F.col(at))
    return rows.join(dropped, F.col(key).eqNullSafe(F.col(of)) & older, "left_anti")


def _marked(touched: DataFrame, accepted: DataFrame, months: Iterable[object], key: str) -> DataFrame:
    """Stored rows of some months, and in a last column true for those that go, else null."""
    of, went = (free_name(touched.columns, name) for name in ("_of", "_went"))
    here = F.exists("_in", lambda held: _in_months(months, held[MONTH]))
    ids = accepted.where(F.col("_taken") & here)
    ids = ids.select(F.col("_of").alias(of), F.lit(True).alias(went))
    return touched.join(ids, F.col(key).eqNullSafe(F.col(of)), "left").drop(of)


def _turns(rows: dict[object, int]) -> Iterator[list[object]]:
    """Months in turns of at most a share of all rows, or of one month."""
    most = max(TURN_ROWS, -(-sum(rows.values()) // TURNS))
    turn, held = [], 0
    for month in sorted(rows, key=lambda month: (month is not None, month)):
        if turn and held + rows[month] > most:
            yield turn
            turn, held = [], 0
        turn.append(month)
        held += rows[month]
    if turn:
        yield turn


def _in_months(months: Iterable[object], month: Column | None = None) -> Column:
    month = F.col(MONTH) if month is None else month
    known = [value for value in months if value is not None]
    found = month.isin(known)
    return found | month.isNull() if None in months else found


def _path(spark: SparkSession, path: str):
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name, name.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    name, files = _path(spark, path)
    return files.exists(name)


def _beside(spark: SparkSession, path: str, name: str) -> str:
    """A path next to ``path``, so that a rename is none between file systems; readers pass over it."""
    table, _ = _path(spark, path)
    return f"{table.getParent()}/_{table.getName()}-{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    name, files = _path(spark, path)
    files.delete(name, True)


def _replace_months(spark: SparkSession, path: str, new: str, months: Iterable[object]) -> None:
    """Put the months at ``new`` in the place of those at ``path``; months that are not there go."""
    table, files = _path(spark, path)
    source, _ = _path(spark, new)
    if not files.exists(table):
        _rename(files, source, table)
        return
    for month in months:
        value = "__HIVE_DEFAULT_PARTITION__" if month is None else month.isoformat()
        old, _ = _path(spark, f"{table}/{MONTH}={value}")
        found, _ = _path(spark, f"{source}/{MONTH}={value}")
        files.delete(old, True)
        if files.exists(found):
            _rename(files, found, old)


def _rename(files, source, target) -> None:
    if not files.rename(source, target):
        raise OSError(f"could not rename {source} to {target}")
