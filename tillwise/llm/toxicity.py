"""Toxicity of texts after undoing disguise.

A disguised word is a plain one sent over a noisy channel: letters became signs that look
alike, were spaced out or said again and again. The possible originals of a suspect word form
a lattice of characters, and the Viterbi path through it under a character model of the
corpus is the restored word. Restored texts are scored by a lexicon learnt from labels: words,
and beginnings of words, that occur more often in toxic texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, sample
from .stored import store
from .texts import schema_of, slices, text_rows, utf8

# Letters that a sign may stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
    "*": "aeiou",
}
SEPARATORS = ".-_~·,'’*"
# Log probabilities of the channel: a sign for a letter, a letter said more than once, a
# separator put in or meant, a sign that ends or opens what is said, and another sign that means
# itself.
DISGUISED, REPEATED, SPREAD, PARTING, PUNCTUATION, ITSELF = -1.5, -1.0, -1.0, -3.0, -1.0, -6.0

SYMBOLS = 28  # no letter, a to z, any other letter
OTHER = 27
SAMPLE_ROWS = 20_000
LEXICON_TERMS = 5_000
LEAST_DOCS = 5
PREFIXES = (4, 5, 6, 7)
STRONG = 2.0
THRESHOLD = 0.5
CACHED_TOKENS = 400_000

_SYMBOL = np.zeros(256, dtype=np.int32)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[192:] = OTHER
_CONTINUES = (np.arange(256) >= 128) & (np.arange(256) < 192)


def count_letters(docs: DataFrame) -> DataFrame:
    """How often each three symbols follow one another over all whole texts: ``gram``, ``n``."""
    rows = text_rows(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            for start, stop in slices(batch.column(0)):
                data, bounds = utf8(batch.column(0)[start:stop])
                data = np.insert(data, bounds[1:], 32)
                symbols = _SYMBOL[data[~_CONTINUES[data]]]
                twice = (symbols[1:] == 0) & (symbols[:-1] == 0)
                symbols = symbols[np.concatenate([[True], ~twice])]
                if len(symbols) > 2:
                    grams = (symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:]
                    total += np.bincount(grams, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["gram", "n"])

    counted = rows.mapInArrow(run, "gram bigint, n bigint")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def letter_model(docs: DataFrame) -> np.ndarray:
    """Log probability of each symbol after two others, smoothed by shorter contexts."""
    found = count_letters(docs).toPandas()  # at most SYMBOLS ** 3 rows
    counts = np.zeros(SYMBOLS**3)
    counts[found["gram"].to_numpy(dtype=int)] = found["n"]
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    one = (three.sum(axis=(0, 1)) + 1) / (three.sum() + SYMBOLS)
    two = three.sum(axis=0)
    two = (two + 5 * one) / (two.sum(axis=1, keepdims=True) + 5)
    full = (three + 5 * two[None]) / (three.sum(axis=2, keepdims=True) + 5)
    return np.log(full).ravel()


class Restorer:
    """Restores disguised words by the likeliest path through their lattices."""

    def __init__(self, letters: np.ndarray):
        self.logs = letters.tolist()

    @staticmethod
    def suspect(word: str) -> bool:
        """Whether a lower-case word has another reading than itself."""
        return bool(_SUSPECT.search(word)) and bool(_HAS_LETTER.search(word))

    def doubled(self, word: str) -> bool:
        """Whether a letter is said twice and may be meant once. In a word of letters only, each
        such choice changes but the terms compared here, so False means that the path keeps it."""
        if not _TWICE.search(word):
            return False
        if not word.isalpha():
            return True
        logs, all_ = self.logs, f" {word} "
        for run in _TWICE.finditer(word):
            p, c, n = (_symbol(all_[run.start() + i]) for i in (0, 1, 3))
            once, cc = (p * SYMBOLS + c) * SYMBOLS, (c * SYMBOLS + c) * SYMBOLS
            if REPEATED + logs[once + n] > logs[once + c] + logs[cc + n]:
                return True
        return False

    def restore(self, word: str, literal: bool = False) -> str:
        """The likeliest original; one space where the path has no letter. A ``literal`` one has two
        letters for a sign said twice, which the model, fond of short words, seldom prefers."""
        logs = self.logs
        # By the last two symbols: the best log probability, and the way to it.
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for _, options in _lattice(word, literal):
            following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, way) in states.items():
                for cost, made in options:
                    total, path, x, y = score + cost, way, a, b
                    for symbol, char in made:
                        if symbol or y:
                            total += logs[(x * SYMBOLS + y) * SYMBOLS + symbol]
                            path, x, y = (path, char), y, symbol
                    held = following.get((x, y))
                    if held is None or total > held[0]:
                        following[x, y] = (total, path)
            states = following
        ends = ((s + logs[(a * SYMBOLS + b) * SYMBOLS], w) for (a, b), (s, w) in states.items())
        _, way = max(ends, key=lambda end: end[0])
        chars = []
        while way:
            way, char = way
            chars.append(char)
        return "".join(reversed(chars)).strip()


_SUSPECT = re.compile(r"[0-9@$!|+(€£*._~·\-]|(.)\1\1|(?:^|\s)\S\s")
_HAS_LETTER = re.compile(r"[^\W\d_]")
_TWICE = re.compile(r"([^\W\d_])\1")
_SIGN_TWICE = re.compile(r"([^a-z\s])\1")
_RUN = re.compile(r"(.)\1*", re.S)


def _once(word: str) -> str:
    """A word with every letter that is said again said once."""
    return _RUN.sub(r"\1", word)


def _symbol(char: str) -> int:
    if "a" <= char <= "z":
        return ord(char) - 96
    return OTHER if char.isalpha() else 0


def _lattice(word: str, literal: bool = False) -> Iterator[tuple[int, list[tuple[float, tuple]]]]:
    """For each run of one character, its end and what it may have been: a cost and the symbols
    with their characters."""
    for run in _RUN.finditer(word):
        n, last = len(run[0]), run.end() == len(word)
        yield run.end(), _options(run[1], min(n, 3), run.start() == 0, last, literal)


@lru_cache(maxsize=10_000)
def _options(char: str, n: int, first: bool, last: bool, literal: bool) -> list[tuple[float, tuple]]:
    options = []
    if char.isalpha():
        letter = (_symbol(char), char)
        if n < 3:
            options.append((0.0, (letter,) * n))
            if n > 1:
                options.append((REPEATED, (letter,)))
        else:
            options += [(REPEATED, (letter,)), (REPEATED, (letter, letter))]
    for letter in LOOKS_LIKE.get(char, ""):
        cost = DISGUISED - math.log(len(LOOKS_LIKE[char]))
        options.append((cost, ((_symbol(letter), letter),) * min(n, 2)))
        if n > 1 and not literal:
            options.append((cost + REPEATED, ((_symbol(letter), letter),)))
    if char in SEPARATORS or char.isspace():
        options.append((SPREAD, ()))
    if not char.isalpha():
        options.append((_meant(char, n, first, last), ((0, " "),)))
    return options


def _meant(char: str, n: int, first: bool, last: bool) -> float:
    """The cost of a run of signs that are no letters: an exclamation at the end or a bracket at
    the beginning is common, other signs said again at the end are so less than once."""
    if (last and char == "!") or (first and char == "("):
        return PUNCTUATION
    if char in SEPARATORS or char.isspace():
        return PARTING
    return ITSELF * min(n, 2) if last and not char.isdigit() else ITSELF


def _spaced_out(tokens: list[str]) -> Iterator[str]:
    """Runs of three and more single characters, each as one word with its spaces. Signs that may
    be letters are such characters; lone separators part them as spaces do."""
    held: list[str] = []
    for token in chain(tokens, [""]):
        if len(token) > 1 and token[:2].isalpha():
            if len(held) > 2:
                yield " ".join(held)
            held = []
            continue
        bare = token.strip(_EDGES)
        if not bare:
            bare = token.strip(_NEVER_LETTERS)
            if not bare and len(token) == 1 and token in SEPARATORS:
                continue
        if len(bare) == 1:
            held.append(bare)
            continue
        if len(held) > 2:
            yield " ".join(held)
        held = []


_EDGES = ".,;:?!\"'()[]{}<>#%&*$/\\^=`|~-_+@«»“”„"
_NEVER_LETTERS = "".join(set(_EDGES) - set(LOOKS_LIKE))


class Sought:
    """The terms of a lexicon, and whether any reading of a form can hold one of them.

    A form is restored to a single reading, whatever its costs, so one of whose readings none
    holds a term need not be restored: an exact bound, found by going through the lattice with
    the beginnings of terms alone.
    """

    def __init__(self, terms: Iterable[str]):
        terms = list(terms)
        self.wholes = {term[:-1] for term in terms if term.endswith("$")}
        self.prefixes = {term for term in terms if not term.endswith("$")}
        self.begins = {t[:n] for t in self.wholes | self.prefixes for n in range(1, len(t) + 1)}
        self.once = {_once(t) for t in self.wholes | self.prefixes}
        self.once_begun = {t[:n] for t in self.once for n in range(1, len(t) + 1)}

    def holds(self, word: str) -> bool:
        """Whether a word has a term at all, by what it begins with."""
        return word[: PREFIXES[0]] in self.begins

    def in_reading(self, form: str) -> bool:
        states = {""}
        # After this place no other word can begin: the last sign but for those that end the form.
        inner = form if form.isalpha() or form[-1:].isalpha() else form.rstrip(form[-1:])
        if inner.isalpha():
            # All readings are one word, and equal but for letters said again and what ends them.
            once = _once(inner)
            if once[:3] not in self.once_begun and not self.once & {once[:1], once[:2]}:
                return False
            if once not in self.once_begun and not any(once[:n] in self.once for n in range(1, len(once))):
                return False
        restart = -1 if inner.isalpha() else max((i for i, c in enumerate(inner) if not c.isalpha()), default=-1)
        for end, options in _lattice(form):
            following = set()
            for state in states:
                for _, made in options:
                    at = state
                    for _, char in made:
                        if char == " ":
                            if at in self.wholes:
                                return True
                            at = ""
                        elif at is not None:
                            at += char
                            if at in self.prefixes:
                                return True
                            if at not in self.begins:
                                at = None  # until the next word begins
                    following.add(at)
            states = following
            if end > restart and states == {None}:
                return False
        return any(state in self.wholes for state in states)


class Parts:
    """Whether a reading of a form can be a part of some words, in one piece."""

    def __init__(self, words: Iterable[str]):
        self.pieces = {w[i:j] for w in words for i in range(len(w)) for j in range(i + 1, len(w) + 1)}

    def in_reading(self, form: str) -> bool:
        states = {""}
        for _, options in _lattice(form):
            following = set()
            for state in states:
                for _, made in options:
                    at: str | None = state
                    for _, char in made:
                        if char == " ":
                            # Spaces around a reading are cut off; none can be inside.
                            at = at if not at or at.endswith(" ") else f"{at} "
                        else:
                            at += char
                            if at not in self.pieces:
                                at = None
                                break
                    if at is not None:
                        following.add(at)
            states = following
            if not states:
                return False
        return any(states)


class Reader:
    """Turns tokens into the words they may be: as they stand, and restored.

    With ``sought`` and ``parts``, forms are restored only if a reading matters to these.
    """

    def __init__(self, letters: np.ndarray, sought: Sought | None = None, parts: Parts | None = None):
        self.restorer = Restorer(letters)
        self.sought, self.parts = sought, parts
        self.restored: dict[str, str] = {}

    def restore(self, form: str) -> str:
        """The restored form; the last ones are kept, as words and pieces ask for the same."""
        if (said := self.restored.get(form)) is None:
            if len(self.restored) > 1000:
                self.restored.clear()
            said = self.restored[form] = self.restorer.restore(form)
        return said

    def tokens(self, text: str) -> list[str]:
        """White-space tokens; spelled-out words are added as tokens with spaces inside."""
        tokens = text.split()
        if list(map(len, tokens)).count(1) > 2:
            tokens.extend(_spaced_out(tokens))
        return tokens

    def words(self, token: str) -> list[str]:
        lower = token.lower()
        if lower.isalpha() and not _TWICE.search(lower):
            return [lower]
        plain = lower.strip(_EDGES)
        found = [plain] if plain and " " not in plain else []
        # Signs at the ends may be letters too; the path says whether they are.
        whole = lower.strip("\"')[]{}<>#%&/\\^=`~,;:?.").rstrip("(")
        if ")" in token:
            whole = whole.lstrip("(")
        forms = [plain] if whole == plain else [plain, whole]
        if " " in whole:
            # A letter said twice stands in one run again.
            forms += [f for f in (whole.replace(" ", ""),) if self.restorer.doubled(f)]
        for form in forms:
            if self.sought and not self.sought.in_reading(form):
                continue
            if " " in form or self.restorer.suspect(form) or self.restorer.doubled(form):
                found += self.restore(form).split()
                if _SIGN_TWICE.search(form):
                    found += self.restorer.restore(form, literal=True).split()
        return list(dict.fromkeys(found)) if len(found) > 1 else found

    def piece(self, token: str) -> str:
        """What a token adds to a word that is written in parts; no text if it is no part."""
        whole = token.lower()
        if whole.isalpha():
            return whole
        whole = whole.strip(_NEVER_LETTERS)
        if " " in token or not _HAS_LETTER.search(whole):
            return ""
        if self.restorer.suspect(whole):
            said = self.restore(whole) if not self.parts or self.parts.in_reading(whole) else ""
        else:
            said = whole.strip(_EDGES)
        return "" if " " in said else said


def _terms(word: str) -> list[str]:
    return [f"{word}$", *[word[:n] for n in PREFIXES if len(word) >= n]]


@dataclass(frozen=True)
class Model:
    """Letters, the lexicon's log odds, and the weights that turn evidence into a score."""

    letters: np.ndarray
    lexicon: dict[str, float]
    weights: np.ndarray


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.cache: dict[str, float] = {}
        # Words in parts are sought by strong terms only, as chance makes weak ones.
        strong = (t for t, odds in model.lexicon.items() if odds >= STRONG)
        self.sought = {term[:-1] for term in strong if term.endswith("$")}
        self.begun = {word[:n] for word in self.sought for n in range(1, len(word))}
        self.terms = Sought(model.lexicon)
        self.reader = Reader(model.letters, self.terms, Parts(self.sought))
        self.pieces: dict[str, str] = {}
        self.starts: set[str] = set()

    def weight(self, token: str) -> float:
        words = [word for word in self.reader.words(token) if self.terms.holds(word)]
        get = self.model.lexicon.get
        return max((get(t, 0.0) for w in words for t in _terms(w)), default=0.0)

    def in_parts(self, tokens: list[str]) -> list[str]:
        """Neighbouring tokens that make a strong term together, as tokens with spaces inside."""
        starts, pieces, found = self.starts, self.pieces, []
        for i in [i for i, token in enumerate(tokens) if token in starts]:
            said = pieces[tokens[i]]
            for j in range(i + 1, len(tokens)):
                more = pieces[tokens[j]]
                said += more
                if more and said in self.sought:
                    found.append(" ".join(t.strip(_NEVER_LETTERS) for t in tokens[i : j + 1]))
                if not more or said not in self.begun:
                    break
        return found

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Per text: strongest term, strong terms, sum of all, and words."""
        tokens = [self.reader.tokens(text) for text in texts]
        if len(self.cache) > CACHED_TOKENS:
            self.cache.clear()
            self.pieces.clear()
            self.starts.clear()
        for token in set().union(*tokens).difference(self.cache):
            self.cache[token] = self.weight(token)
            piece = self.pieces[token] = self.reader.piece(token)
            if piece in self.begun:
                self.starts.add(token)
        for some in tokens:
            parts = self.in_parts(some)
            some += parts
            for token in parts:
                if token not in self.cache:
                    self.cache[token], self.pieces[token] = self.weight(token), ""
        counts = np.array([len(some) for some in tokens], dtype=np.int64)
        flat = map(self.cache.__getitem__, chain.from_iterable(tokens))
        weights = np.fromiter(flat, dtype=np.float64, count=int(counts.sum()))
        out = np.zeros((len(texts), 5))
        full = np.flatnonzero(counts)
        if len(full):
            starts = (np.cumsum(counts) - counts)[full]
            strong = np.add.reduceat((weights >= STRONG).astype(float), starts)
            out[full, 0] = np.maximum.reduceat(weights, starts)
            out[full, 1] = np.log1p(strong)
            out[full, 2] = np.log1p(np.add.reduceat(np.maximum(weights, 0), starts))
            out[full, 3] = strong / np.sqrt(counts[full])
        out[:, 4] = np.log1p(counts)
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        return _logistic(_with_one(self.evidence(texts)) @ self.model.weights)


def _with_one(rows: np.ndarray) -> np.ndarray:
    return np.hstack([rows, np.ones((len(rows), 1))])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def count_terms(labelled: DataFrame, letters: np.ndarray) -> DataFrame:
    """Occurrences of terms in toxic and in other texts, and the toxic texts that have them."""
    toxic = (F.col("label") >= 0.5).alias("toxic")
    rows = labelled.select(F.coalesce("text", F.lit("")).alias("text"), toxic)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(letters)
        in_docs: Counter[str] = Counter()
        times: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        known: dict[str, list[str]] = {}
        for batch in batches:
            for text, toxic in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                tokens = reader.tokens(text)
                here: Counter[str] = Counter()
                for token, n in Counter(tokens).items():
                    if token not in known:
                        words = set(reader.words(token))
                        known[token] = list({t for word in words for t in _terms(word)})
                    for term in known[token]:
                        here[term] += n
                times[toxic].update(here)
                if toxic:
                    in_docs.update(here.keys())
                if len(known) > CACHED_TOKENS // 8:
                    known.clear()
        terms = list(times[True].keys() | times[False].keys())
        for start in range(0, len(terms), 100_000):
            some = terms[start : start + 100_000]
            columns = [
                pa.array(some, pa.string()),
                pa.array([times[True][t] for t in some], pa.int64()),
                pa.array([times[False][t] for t in some], pa.int64()),
                pa.array([in_docs[t] for t in some], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "toxic", "clean", "docs"])

    counted = rows.mapInArrow(run, "term string, toxic bigint, clean bigint, docs bigint")
    sums = [F.sum(name).alias(name) for name in ("toxic", "clean", "docs")]
    return counted.groupBy("term").agg(*sums)


def learn_lexicon(labelled: DataFrame, letters: np.ndarray, terms: int) -> dict[str, float]:
    """Log odds of the ``terms`` surest signs of toxic texts, from labelled ones."""
    counted = store(count_terms(labelled, letters), "toxic-terms")
    whole = counted.where(F.col("term").endswith("$"))
    totals = whole.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
    toxic, clean = totals["toxic"] or 0, totals["clean"] or 0
    if not toxic:
        return {}
    share = [(F.col(name) + 0.5) / (n + 1.0) for name, n in (("toxic", toxic), ("clean", clean))]
    odds = F.log(share[0] / share[1])
    sure = odds / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    signs = counted.where(F.col("docs") >= LEAST_DOCS).select("term", odds.alias("odds"), sure.alias("sure"))
    best = signs.where("odds > 0.5 and sure > 3").orderBy(F.desc("sure"), "term").limit(terms)
    return {row["term"]: row["odds"] for row in best.collect()}


def _fit(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method, with a small ridge."""
    x = _with_one(rows)
    weights = np.zeros(x.shape[1])
    for _ in range(30):
        p = _logistic(x @ weights)
        slope = x.T @ (p - labels) + 1e-2 * weights
        bend = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        weights = weights - np.linalg.solve(bend, slope)
    return weights


def learn(
    docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, terms: int = LEXICON_TERMS
) -> Model:
    """Fit the character model to all of ``docs``, and the rest to a sample of labelled ones.

    ``rows`` bounds the labelled texts used and ``terms`` the lexicon. One half of the sample
    makes the lexicon, the other weighs its evidence, so the weights see terms as new texts have
    them. Without any label the score is 0 for all.
    """
    letters = letter_model(docs)
    labelled = store(sample(docs, labels, "toxic", rows), "labelled-toxic")
    lexicon = learn_lexicon(labelled.where("half = 0"), letters, terms)
    model = Model(letters, lexicon, np.zeros(6))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = scorer.evidence([text or "" for text in batch.column(0).to_pylist()])
            columns = [batch.column(1), *[pa.array(column) for column in found.T]]
            yield pa.RecordBatch.from_arrays(columns, names=["label", *"abcde"])

    other_half = labelled.where("half = 1").select("text", "label")
    kinds = ", ".join(f"{name} double" for name in ("label", *"abcde"))
    evidence = other_half.mapInArrow(run, kinds).toPandas().to_numpy()  # at most ``rows``
    evidence = evidence[np.lexsort(evidence.T)]
    if not len(evidence):
        return Model(letters, lexicon, np.array([0.0] * 5 + [-30.0]))
    return Model(letters, lexicon, _fit(evidence[:, 1:], evidence[:, 0]))


def score(docs: DataFrame, model: Model, *keys: str) -> DataFrame:
    """``keys`` with ``score``, 0 to 1, of every whole text: how likely it is labelled toxic.

    A null text counts as empty, and empty texts have a score as well. Rows are scored one by
    one: repeated rows and null keys come out as they are, other columns are not read.
    """
    rows = text_rows(docs, *keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for start, stop in slices(batch.column(len(keys))):
                part = batch.slice(start, stop - start)
                found = scorer.score(part.column(len(keys)).to_pylist())
                columns = [*part.columns[: len(keys)], pa.array(found)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "score"])

    return rows.mapInArrow(run, schema_of(rows, keys, score="double"))


def score_udf(model: Model) -> Callable[[Column], Column]:
    """The score of a column of texts, none of them null, as a column."""

    @F.arrow_udf("double")
    def of_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model)
        for texts in batches:
            found = [scorer.score(texts[i:j].to_pylist()) for i, j in slices(texts)]
            yield pa.array(np.concatenate([np.zeros(0), *found]))

    return of_texts


def fit_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    return score(docs, learn(docs, labels), "doc_id").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
