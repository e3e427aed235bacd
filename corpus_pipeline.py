"""From raw documents to token ids: each stage takes what the one before it kept.

``STAGES`` are (name, function) pairs. A function takes (spark, docs, folder of tables) and returns a
frame, which is written and read again as the next one's ``docs``. All but the last return the
columns of ``docs``. Null texts go at the language stage, as they have none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.llm import byte_bpe, decontamination, language_id, near_dedup, toxicity
from tillwise.llm.stored import store

# SQL can express neither the fitted models nor the tokenizer.
ORACLE_SQL = None

# The stage's shingles; the query ``op8_near_dedup`` has four words by its contract.
NEAR_DUPLICATE_WORDS = 5


def _whole_rows(docs: DataFrame, of_text: Callable[[Column], Column]) -> DataFrame:
    """Each row as one value beside what is found of its text, so that no name can clash. Only
    texts go to Python, and only what is found comes back."""
    row = F.struct(*[docs[name] for name in docs.columns]).alias("row")
    return docs.select(row, of_text(F.coalesce(docs["text"], F.lit(""))).alias("found"))


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that are not scored as toxic; labels fit the model, ids and labels score nothing.
    Null texts count as empty, and without labels none is toxic; repeated rows go or stay alike."""
    model = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = _whole_rows(docs, toxicity.score_udf(model))
    return scored.where(F.col("found") < toxicity.THRESHOLD).select("row.*")


def drop_without_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language can be told: those with a letter in them. Null and empty texts
    have none; where no document names a language, none can be learnt, and letters alone count."""
    out = F.coalesce(language_id.held_out(), F.lit(False))
    code = language_id.learn(docs.where(~out).select("text", "lang"))
    if not code.languages:
        return docs.where(F.coalesce(docs["text"].rlike(r"\p{L}"), F.lit(False)))
    told = _whole_rows(docs, language_id.language_udf(code))
    return told.where(F.col("found") != language_id.UNDETERMINED).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates, at 0.8 on sets of five words."""
    return near_dedup.without_duplicates(docs, NEAR_DUPLICATE_WORDS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    return decontamination.without_contaminated(docs, benchmark)


def tokenize(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of each row, and a digest of the text that they decode to; null texts have none."""
    keys = ("doc_id", "lang", "source")
    encoded = byte_bpe.encode(docs, *keys, decoded=True)
    return encoded.select(*keys, "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_without_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokenize),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, folder), f"stage-{name}")
    return STAGES[-1][1](spark, docs, folder)
