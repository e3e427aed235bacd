"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_RANGE = 1 << 30


def held_out(doc_id: Column) -> Column:
    """Documents no label of which is ever used: crc32 of the id as text is 0 modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``text`` and ``label`` (0.0 to 1.0) of about ``rows`` labelled documents at most that are
    not held out, with ``half``, a fair coin of 0 and 1.

    Labels of one id are averaged; null ids and labels are left out. A hash of the id decides
    which documents belong, so the sample is the same in every run. It is bounded by ``rows``,
    so its labels, an id and a number each, may be broadcast to the documents.
    """
    known = labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels[label].alias("label"))
    known = known.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(~held_out(F.col("doc_id")))
    averaged = known.groupBy("doc_id").agg(F.avg(F.col("label").cast("double")).alias("label"))
    n = averaged.count()
    share = min(1.0, rows / max(n, 1))
    place = F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(HASH_RANGE))
    chosen = averaged.where(place < int(share * HASH_RANGE))
    chosen = chosen.withColumn("half", (F.xxhash64("doc_id", F.lit("half")) % 2 == 0).cast("int"))
    texts = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text")
    return texts.join(F.broadcast(chosen), "doc_id").select("text", "label", "half")
