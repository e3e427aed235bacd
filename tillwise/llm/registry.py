"""The operators as queries over the tables of a folder, and as SQL where that can be said."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment,
    byte_bpe,
    chat,
    decontamination,
    direct_codes,
    language_id,
    licenses,
    near_dedup,
    neighbours,
    prefix_trie,
    quality,
    simhash,
    toxicity,
)
from .sql import SQL
from .stored import new_path, store

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}


def _query(plan: Query) -> Query:
    """Register a query under the name of its function."""
    _queries[plan.__name__] = plan
    return plan


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def llm_queries() -> dict[str, Query]:
    return dict(_queries)


def llm_sql() -> dict[str, str]:
    return dict(SQL)


@_query
def op1_quality(spark, folder):
    labels = _table(spark, folder, "labels")
    return quality.fit_and_score(_table(spark, folder, "documents"), labels)


@_query
def op2_decontamination(spark, folder):
    benchmark = _table(spark, folder, "benchmark")
    return decontamination.contamination(_table(spark, folder, "documents"), benchmark)


@_query
def op3_neighbours(spark, folder):
    return neighbours.nearest(_table(spark, folder, "embeddings"))


@_query
def op4_language_id(spark, folder):
    return language_id.fit_and_predict(_table(spark, folder, "documents"))


@_query
def op5_licenses(spark, folder):
    return licenses.scan(_table(spark, folder, "documents"), "doc_id")


@_query
def op6_direct_codes(spark, folder):
    path = new_path(spark, "token-ids")
    direct_codes.write(_table(spark, folder, "documents"), path)
    return direct_codes.read(spark.read.parquet(path), F.crc32("ids").alias("ids_crc32"))


@_query
def op7_byte_bpe(spark, folder):
    docs = _table(spark, folder, "documents")
    return byte_bpe.encode(docs, "doc_id", decoded=True).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query
def op8_near_dedup(spark, folder):
    return near_dedup.near_duplicates(_table(spark, folder, "documents"))


@_query
def op9_toxicity(spark, folder):
    labels = _table(spark, folder, "labels")
    return toxicity.fit_and_score(_table(spark, folder, "documents"), labels)


@_query
def op10_chat(spark, folder):
    said = "\\### Assistant: </turn> ok"
    more = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    schema = "conv_id bigint, turn bigint, role string, text string"
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    formatted = chat.format_conversations(turns.union(spark.createDataFrame(more, schema)))
    return chat.digests(store(formatted, "formatted"))


@_query
def op11_simhash(spark, folder):
    return simhash.near_duplicates(_table(spark, folder, "documents"))


@_query
def op12_prefix_trie(spark, folder):
    turns = prefix_trie.turns_of(_table(spark, folder, "conversations"))
    return prefix_trie.trie(prefix_trie.rebuilt(turns))


@_query
def op13_alignment(spark, folder):
    return alignment.align(_table(spark, folder, "documents"))
