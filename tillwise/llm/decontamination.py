"""Benchmark passages in training texts, found by winnowing.

Of every ``WINDOW`` successive words, the least hash of the runs of ``GRAM`` words in it is kept as a
fingerprint. Two texts that share a window keep the same one there, so joining fingerprints
finds every shared window; from each hit, the windows around it are compared word by word.
All of it is column expressions and joins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import free_name
from .stored import store

WINDOW = 10
GRAM = 5
# What parts words, after A-Z are lower-cased.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased and no other letters; none if it is null."""
    plain = F.octet_length(text) == F.char_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), SEPARATOR), "")


def _shifted(array: str, by: int) -> Column:
    return F.slice(array, by + 1, F.greatest(F.size(array), F.lit(1)))


def _joined(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _lesser(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _run_print(n: int) -> Callable[[Column], Column]:
    """The fingerprint of a run as long as a short item of ``n`` words."""
    return lambda gram: F.xxhash64(gram, F.lit(n))


def _cut(array: str | Column, length: Column) -> Column:
    return F.slice(array, 1, F.greatest(length, F.lit(0)))


def with_grams(df: DataFrame, sizes: set[int]) -> DataFrame:
    """Add ``gram_n``, the hashes of the runs of n words by their first word, for n in ``sizes``.

    ``df`` has ``words`` and ``n_words``. Each step is a projection of its own, so that none is
    worked out twice.
    """
    kept = [*df.columns]
    df = df.withColumn("gram_1", F.transform("words", lambda word: F.xxhash64(word)))
    for n in range(2, max(sizes, default=1) + 1):
        longer = F.zip_with(f"gram_{n - 1}", _shifted("gram_1", n - 1), _joined)
        # What is behind the last whole run is cut off below.
        df = df.withColumn(f"gram_{n}", longer)
    cut = [_cut(f"gram_{n}", F.col("n_words") - (n - 1)).alias(f"gram_{n}") for n in sorted(sizes)]
    return df.select(*kept, *cut)


def _winnowed(df: DataFrame) -> DataFrame:
    """Add ``least``: the least hash of the runs in each window of ``WINDOW`` words."""
    within = WINDOW - GRAM + 1
    df = df.withColumn("least", F.col(f"gram_{GRAM}"))
    covered = 1
    while covered < within:
        step = min(covered, within - covered)
        df = df.withColumn("least", F.zip_with("least", _shifted("least", step), _lesser))
        covered += step
    return df.withColumn("least", _cut("least", F.col("n_words") - (WINDOW - 1)))


def _with_prints(df: DataFrame, short: list[int]) -> DataFrame:
    """Add ``prints``: the fingerprints, and the hashes of all runs as long as a short item."""
    df = _winnowed(with_grams(df, {GRAM, *short}))
    runs = [F.transform(f"gram_{n}", _run_print(n)) for n in short]
    return df.withColumn("prints", F.array_distinct(F.concat("least", *runs)))


def _read_items(benchmark: DataFrame) -> DataFrame:
    rows = benchmark.select(
        benchmark["item_id"].cast("string").alias("item_id"),
        _words(benchmark["text"].cast("string")).alias("words"),
    )
    rows = rows.withColumn("n_words", F.size("words"))
    return rows.where(F.col("item_id").isNotNull() & (F.col("n_words") > 0))


def _text_at(start: Column, length: Column) -> Column:
    return F.concat_ws(" ", F.slice("words", start + 1, length))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """How much of each document stands in ``benchmark``, one row per document: ``doc_id``,
    ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``.

    A window is ``WINDOW`` successive words of an item, or all words of a shorter one. A document's
    word is hit if it lies in an occurrence of any window; ``n_items`` counts the items that have
    one. Null and empty texts have no words. An item without an id or words is left out, and
    one id counts once. Repeated rows each have a row; other columns are not read.
    """
    found = by_text(docs, benchmark)
    copies = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    return found.select("*", copies).drop("copy", "copies", "text_key")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, with all their columns, whatever their names.

    Null and empty texts have none and stay, repeated rows stay or go together, and an empty
    benchmark keeps all rows.
    """
    id_, key = (free_name(docs.columns, name) for name in ("_id", "_key"))
    bad = store(by_text(docs, benchmark).where("contaminated"), "contaminated")
    bad = bad.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key))
    same = docs["doc_id"].eqNullSafe(F.col(id_)) & F.xxhash64(docs["text"]).eqNullSafe(F.col(key))
    return docs.join(bad, same, "left_anti")


def by_text(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``contamination`` with one row for rows that share id and text: ``text_key`` is xxhash64 of
    the text, ``copies`` the number of such rows."""
    items = store(_read_items(benchmark), "items")
    lengths = items.where(F.col("n_words") < WINDOW).select("n_words").distinct()
    short = sorted(row["n_words"] for row in lengths.collect())  # less than WINDOW of them
    printed = _with_prints(items, short)
    # A short item has no window, and only the run that is all of it counts.
    own = [
        F.when(F.col("n_words") == n, F.transform(f"gram_{n}", _run_print(n)))
        for n in short
    ]
    wanted = F.coalesce(*own, F.col("least")) if own else F.col("least")
    prints = store(printed.select(F.explode(wanted).alias("print")).distinct(), "item-prints")
    starts = F.sequence(F.lit(0), F.greatest(F.col("n_words") - WINDOW, F.lit(0)))
    length = F.least(F.col("n_words"), F.lit(WINDOW))
    texts = F.transform(starts, lambda s: _text_at(s, length))
    windows = items.select("item_id", F.explode(texts).alias("window")).groupBy("window")
    windows = store(windows.agg(F.collect_set("item_id").alias("items")), "item-windows")

    rows = docs.select(docs["doc_id"], docs["text"].cast("string").alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    counted = rows.select("doc_id", "text_key", _words(F.col("text")).alias("words"))
    counted = _with_prints(counted.withColumn("n_words", F.size("words")), short)
    exploded = counted.select(
        "doc_id", "text_key", "n_words", F.size("prints").alias("n_prints"),
        F.explode_outer("prints").alias("print"),
    )
    matched = exploded.join(prints.withColumn("hit", F.lit(1)), "print", "left")
    per_text = matched.groupBy("doc_id", "text_key", "n_words", "n_prints").agg(
        F.count("*").alias("rows"), F.count("hit").alias("hits")
    )
    per_text = store(per_text, "document-prints")
    found = _hits(rows, per_text.where("hits > 0").select("doc_id", "text_key"), prints, windows, short)
    joined = per_text.alias("t").join(
        found.alias("f"),
        F.col("t.doc_id").eqNullSafe(F.col("f.doc_id"))
        & F.col("t.text_key").eqNullSafe(F.col("f.text_key")),
        "left",
    )
    copies = F.expr("rows div greatest(n_prints, 1)").cast("int")
    names = F.coalesce("names", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return joined.select(
        F.col("t.doc_id").alias("doc_id"),
        F.col("n_words").cast("bigint").alias("n_words"),
        hit.alias("n_hit"),
        F.size(names).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.col("t.text_key").alias("text_key"),
        copies.alias("copies"),
    )


def _spot(n: int, of: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    def spot(gram: Column, at: Column) -> Column:
        return F.struct(F.lit(n).alias("n"), at.alias("at"), of(gram).alias("print"))

    return spot


def _hits(
    rows: DataFrame, chosen: DataFrame, prints: DataFrame, windows: DataFrame, short: list[int]
) -> DataFrame:
    """``n_hit`` and the sorted item ``names`` of the chosen texts that have occurrences."""
    key = ["doc_id", "text_key"]
    some = chosen.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("text_key").eqNullSafe(F.col("key"))
    texts = rows.join(some, same, "left_semi").dropDuplicates(key)
    texts = texts.select(*key, _words(F.col("text")).alias("words"))
    texts = store(texts.withColumn("n_words", F.size("words")), "suspect-texts")

    grams = with_grams(texts, {GRAM, *short})
    places = [F.transform(f"gram_{GRAM}", _spot(WINDOW, lambda gram: gram))]
    places += [F.transform(f"gram_{n}", _spot(n, _run_print(n))) for n in short]
    spots = grams.select(*key, F.inline(F.concat(*places))).join(prints, "print")
    spots = spots.groupBy(*key).agg(F.collect_set(F.struct("n", "at")).alias("spots"))
    again = [F.col(name).alias(f"_{name}") for name in key]
    spots = spots.select(*again, "spots")
    same = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in key]
    near = texts.join(spots, same[0] & same[1])

    def around(spot: Column) -> Column:
        """The windows that a hit may lie in: for a short item, the run itself."""
        first = F.greatest(spot["at"] - (WINDOW - GRAM), F.lit(0))
        last = F.least(spot["at"], F.col("n_words") - WINDOW)
        begins = F.when(spot["n"] < WINDOW, F.array(spot["at"])).when(
            first <= last, F.sequence(first, F.greatest(first, last))
        )
        begins = F.coalesce(begins, F.array().cast("array<int>"))
        return F.transform(begins, lambda s: F.struct(spot["n"].alias("n"), s.alias("at")))

    spans = near.withColumn("spans", F.array_distinct(F.flatten(F.transform("spots", around))))
    seen = F.transform(
        "spans", lambda s: F.struct(s["at"].alias("at"), s["n"].alias("n"), _text_at(s["at"], s["n"]).alias("window"))
    )
    hits = spans.select(*key, F.inline(seen)).join(windows, "window")
    hits = store(hits.select(*key, "at", "n", "items"), "hits")
    covered = hits.select(*key, F.explode(F.sequence("at", F.expr("at + n - 1"))).alias("word"))
    covered = covered.distinct().groupBy(*key).agg(F.count("*").alias("n_hit"))
    names = hits.select(*key, F.explode("items").alias("item")).distinct().groupBy(*key)
    names = names.agg(F.array_sort(F.collect_list("item")).alias("names")).select(*again, "names")
    return covered.join(names, same[0] & same[1]).select(*key, "n_hit", "names")
