"""Language identification with error-correcting output codes.

Every language has a codeword. For each of its bits, a binary classifier over byte n-grams tells
the languages with a 1 there from those with a 0. A text takes the language whose codeword has
the least loss over all bits, each loss weighted by how well the bit's classifier does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import schema_of, slices, text_rows, utf8

UNDETERMINED = "und"
# An n-gram of n bytes goes to one of this many bins.
BINS = {1: 256, 2: 1 << 13, 3: 1 << 15}
OFFSETS = {1: 0, 2: 256, 3: 256 + (1 << 13)}
SIZE = sum(BINS.values())
SMOOTHING = 0.5
# Below this gap between the two nearest codewords, a decision is flagged as ambiguous.
AMBIGUOUS_GAP = 0.05
# Up to this many languages the code is exhaustive; beyond, 8 columns per doubling.
EXHAUSTIVE = 5

# Bytes that part words: all of ASCII but its letters. Bytes of other letters stay.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_PLAIN = np.where(_LETTER, np.arange(256), 32).astype(np.uint8)


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bins of all n-grams of the lower-cased texts, and the text of each.

    Runs of other characters are one space, and no n-gram spans two texts.
    """
    lowered = pa.array([(t or "").lower() for t in texts.to_pylist()], pa.large_string())
    data, bounds = utf8(lowered)
    data = _PLAIN[data]
    text = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    space = data == 32
    keep = np.ones(len(data), dtype=bool)
    if len(data):
        keep[1:] = ~(space[1:] & space[:-1] & (text[1:] == text[:-1]))
    data, text = data[keep].astype(np.uint32), text[keep]
    bins, owners = [data[data != 32]], [text[data != 32]]
    code = data
    for n in (2, 3):
        if len(data) < n:
            break
        code = code[:-1] << np.uint32(8) | data[n - 1 :]
        spread = code * np.uint32(2654435761) >> np.uint32(32 - BINS[n].bit_length() + 1)
        inside = text[n - 1 :] == text[: len(data) - n + 1]
        bins.append(spread[inside] + np.uint32(OFFSETS[n]))
        owners.append(text[n - 1 :][inside])
    return np.concatenate(bins), np.concatenate(owners)


@dataclass(frozen=True)
class LanguageCode:
    """Languages, their codewords of -1 and 1, and a weight per bin and bit."""

    languages: tuple[str, ...]
    words: np.ndarray
    weights: np.ndarray
    bit_weights: np.ndarray


def codewords(n: int) -> np.ndarray:
    """One row per language. Few languages get every split of them once; many get random
    splits, of which the set with the largest least distance in a fixed series is taken."""
    if n < 2:
        return np.ones((n, 1), dtype=np.int8)
    if n <= EXHAUSTIVE:
        masks = range(1, 2 ** (n - 1))
        return np.array([[1 if i and m >> (i - 1) & 1 else -1 for m in masks] for i in range(n)], np.int8)
    length = 8 * int(np.ceil(np.log2(n)))
    best, best_gap = None, -1
    for seed in range(50):
        words = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (n, length))
        words = words[:, np.abs(words.sum(axis=0)) < n]
        agree = words.astype(int) @ words.T
        gap = (words.shape[1] - (agree - np.diag([10**6] * n)).max()) // 2
        if gap > best_gap:
            best, best_gap = words, gap
    return best


def count_grams(labelled: DataFrame) -> DataFrame:
    """How often each bin occurs per language: ``lang``, ``bin``, ``n``.

    Every labelled text is counted whole; rows of a task are summed before they are shuffled.
    """
    rows = text_rows(labelled, "lang")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                some = batch.slice(start, stop - start)
                bins, owners = _grams(some.column(1))
                names, codes = np.unique(some.column(0).to_numpy(False), return_inverse=True)
                flat = np.bincount(codes[owners] * SIZE + bins, minlength=len(names) * SIZE)
                for name, counts in zip(names, flat.reshape(-1, SIZE), strict=True):
                    held[name] = held.get(name, 0) + counts
        for name, counts in held.items():
            bins = np.flatnonzero(counts)
            columns = [pa.array([name] * len(bins)), pa.array(bins), pa.array(counts[bins])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "bin", "n"])

    counted = rows.mapInArrow(run, "lang string, bin bigint, n bigint")
    return counted.groupBy("lang", "bin").agg(F.sum("n").alias("n"))


def learn(labelled: DataFrame) -> LanguageCode:
    """Fit the classifiers to all rows of ``labelled`` (``text``, ``lang``) with a language.

    What comes to the driver is a count per language and bin, whatever the number of rows.
    A bit's classifier is the log ratio of the n-gram shares of its two sides, in which every
    language counts the same; its weight is how far the sides' own means lie apart.
    """
    known = labelled.where(F.col("lang").isNotNull() & (F.col("lang") != ""))
    rows = count_grams(known).toPandas()
    languages = tuple(sorted(rows["lang"].unique()))
    counts = np.zeros((len(languages), SIZE))
    places = {name: i for i, name in enumerate(languages)}
    counts[rows["lang"].map(places).to_numpy(dtype=int), rows["bin"].to_numpy(dtype=int)] = rows["n"]
    shares = np.zeros_like(counts)
    for n, first in OFFSETS.items():
        part = counts[:, first : first + BINS[n]] + SMOOTHING
        shares[:, first : first + BINS[n]] = part / part.sum(axis=1, keepdims=True)
    words = codewords(len(languages))
    if len(languages) < 2:
        return LanguageCode(languages, words, np.zeros((SIZE, 1), np.float32), np.ones(1))
    weights, bit_weights = [], []
    for bit in words.T:
        ratio = np.log(shares[bit > 0].mean(axis=0)) - np.log(shares[bit < 0].mean(axis=0))
        means = (shares / len(BINS)) @ ratio
        upper, lower = means[bit > 0].min(), means[bit < 0].max()
        middle, half = (upper + lower) / 2, max((upper - lower) / 2, 1e-6)
        # A text made as its language's own n-grams are gets at least 1 or at most -1.
        weights.append((ratio - middle) / half)
        bit_weights.append(min(1.0, half / 0.1))
    bit_weights = np.array(bit_weights)
    return LanguageCode(
        languages, words, np.array(weights, np.float32).T.copy(), bit_weights / bit_weights.sum()
    )


def decode(code: LanguageCode, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest codeword of each row of bit margins, its score, and the gap to the next.

    The loss of a bit is exp(-margin), the margin taken within -2 and 2 and by the codeword's sign.
    """
    held = np.clip(margins, -2, 2)
    losses = np.stack([np.exp(-held * word) @ code.bit_weights for word in code.words], axis=1)
    best = losses.argmin(axis=1)
    near = np.exp(-4 * (losses - losses.min(axis=1, keepdims=True)))
    score = 1 / near.sum(axis=1)
    ordered = np.sort(losses, axis=1)
    gap = ordered[:, 1] - ordered[:, 0] if losses.shape[1] > 1 else np.full(len(best), np.inf)
    return best, score, gap


def predict(docs: DataFrame, code: LanguageCode, *keys: str) -> DataFrame:
    """``keys`` with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous`` of every whole text.

    A text that is null or has no letter is ``und`` with score 0, and so is any text if no
    language was learnt. Equal losses go to the language first in order. Each row stands by
    itself: repeated rows and null keys come out as they are, other columns are not read.
    """
    rows = text_rows(docs, *keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(len(keys))):
                part = batch.slice(start, stop - start)
                names, score, ambiguous = _told(code, part.column(len(keys)))
                columns = [*part.columns[: len(keys)], pa.array(names, pa.string())]
                columns += [pa.array(score), pa.array(ambiguous)]
                yield pa.RecordBatch.from_arrays(
                    columns, names=[*keys, "lang_pred", "score", "ambiguous"]
                )

    made = {"lang_pred": "string", "score": "double", "ambiguous": "boolean"}
    return rows.mapInArrow(run, schema_of(rows, keys, **made))


def language_udf(code: LanguageCode) -> Callable[[Column], Column]:
    """The language of a column of texts, none of them null, as a column."""

    @F.arrow_udf("string")
    def of_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [_told(code, texts[i:j])[0] for i, j in slices(texts)]
            yield pa.array([name for names in found for name in names], pa.string())

    return of_texts


def _told(code: LanguageCode, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and ambiguity of each text."""
    lettered = np.array([any(map(str.isalpha, t)) for t in texts.to_pylist()], dtype=bool)
    if not code.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
    best, score, gap = decode(code, _margins(code, texts))
    names = [
        code.languages[i] if known else UNDETERMINED
        for i, known in zip(best.tolist(), lettered.tolist(), strict=True)
    ]
    return names, np.where(lettered, score, 0.0), lettered & (gap < AMBIGUOUS_GAP)


def _margins(code: LanguageCode, texts: pa.Array) -> np.ndarray:
    """Each bit's classifier on each text: its mean weight over the n-grams of each length."""
    bins, owners = _grams(texts)
    counts = np.bincount(owners, minlength=len(texts))
    out = np.zeros((len(texts), code.words.shape[1]))
    for i, column in enumerate(code.weights.T):
        out[:, i] = np.bincount(owners, weights=column[bins], minlength=len(texts))
    return out / np.maximum(counts, 1)[:, None]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def fit_and_predict(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, and predict all: ``doc_id``,
    ``held_out``, ``lang_pred``, ``score``, ``ambiguous``. A null id is never held out."""
    out = F.coalesce(held_out(), F.lit(False))
    code = learn(docs.where(~out).select("text", "lang"))
    return predict(docs, code, "doc_id").select(
        "doc_id", out.alias("held_out"), "lang_pred", "score", "ambiguous"
    )
