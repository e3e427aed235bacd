"""Quality scores from document statistics.

Random Fourier features approximate a Gaussian kernel over the statistics; sums over partitions
make the normal equations of ridge regression, and isotonic regression on texts that these
have not seen turns scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, sample
from .stored import store
from .texts import schema_of, slices, text_rows, utf8

SAMPLE_ROWS = 20_000
FEATURES = 256
KERNEL_WIDTH = 4.0
RIDGE = 1e-2
THRESHOLD = 0.3

# Classes of bytes, each a share of the text.
_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "newline": [10],
    "space": [9, 11, 12, 13, 32],
    "stop": b".,;:",
    "exclaim": b"!?",
    "bar": b"|",
    "sign": b"#$%&*+<=>@^_~\\/",
    "bracket": b"()[]{}\"'`-",
    "other": range(128, 256),
}
_CLASS = np.full(256, len(_CLASSES), dtype=np.int64)
for _i, _some in enumerate(_CLASSES.values()):
    _CLASS[list(_some)] = _i
_WORD_STATISTICS = 9
STATISTICS = len(_CLASSES) + 1 + _WORD_STATISTICS


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of statistics per whole text; an empty text has all zeros."""
    data, bounds = utf8(texts)
    n, classes = len(texts), len(_CLASSES) + 1
    owners = np.repeat(np.arange(n) * classes, np.diff(bounds))
    counts = np.bincount(owners + _CLASS[data], minlength=n * classes).reshape(n, classes)
    sizes = np.diff(bounds)
    out = np.zeros((n, STATISTICS))
    out[:, :classes] = counts / np.maximum(sizes, 1)[:, None]
    for i, text in enumerate(texts.to_pylist()):
        words = text.split() if text else ()
        if not words:
            continue
        lines = [line for line in text.split("\n") if line]
        lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words))
        distinct, total = len(set(words)), len(words)
        followed = sum(map(str.__eq__, words, words[1:]))
        last = words[-1] if total == 1 else words[total // 2]
        out[i, classes:] = (
            np.log1p(total),
            distinct / total,
            distinct / total**0.9,
            lengths.mean(),
            lengths.std(),
            followed / total,
            words.count(last) / total,
            1 - len(set(lines)) / max(len(lines), 1),
            np.log1p(total / max(len(lines), 1)),
        )
    out[:, :classes] = np.sqrt(out[:, :classes])
    return out


def _statistics_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    for start, stop in slices(texts):
        yield start, stop, statistics(texts[start:stop])


@dataclass(frozen=True)
class Model:
    """Scaling, the random waves, ridge weights, and the steps of the calibration."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    calibrated: np.ndarray

    def features(self, rows: np.ndarray) -> np.ndarray:
        scaled = np.clip((rows - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(scaled @ self.waves + self.phases)
        return np.hstack([waves, np.ones((len(rows), 1))])

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.interp(self.features(rows) @ self.weights, self.raw, self.calibrated)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing fit by pooling adjacent violators: block means of x, and values.

    Equal x are pooled first. One row more on either side keeps values off 0 and 1.
    """
    order = np.argsort(x, kind="stable")
    places, first = np.unique(x[order], return_index=True)
    sizes = np.diff([*first, len(x)]).astype(float)
    sums = np.add.reduceat(y[order], first)
    blocks: list[list[float]] = []
    for place, size, total in zip(places, sizes, sums, strict=True):
        blocks.append([place * size, size, total])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    means = np.array([b[0] / b[1] for b in blocks])
    values = np.array([(b[2] + 0.5 * y.mean()) / (b[1] + 0.5) for b in blocks])
    return means, np.maximum.accumulate(values)


def _sums(rows: DataFrame, of: Callable, size: int) -> np.ndarray:
    """Per partition one row with a sum of arrays of ``size`` doubles; added up here.

    The labelled sample that is summed has a bounded number of rows in a bounded number of
    partitions, so what arrives is bounded as well.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(0).to_pylist())).reshape(-1, STATISTICS)
            total += of(values, batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = [np.frombuffer(row["sums"]) for row in rows.mapInArrow(run, "sums binary").collect()]
    return np.sum(parts, axis=0) if parts else np.zeros(size)


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 7) -> Model:
    """Fit to a sample of at most about ``rows`` labelled documents that are not held out.

    One half of the sample makes the normal equations, the other the calibration. Without labels
    every score is 0.5.
    """
    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, found in _statistics_of(batch.column(0)):
                rest = batch.slice(start, stop - start)
                cells = pa.array([row.tobytes() for row in found], pa.binary())
                names = ["statistics", "label", "half"]
                yield pa.RecordBatch.from_arrays([cells, rest.column(1), rest.column(2)], names=names)

    texts = sample(docs, labels, "quality", rows)
    measured = texts.mapInArrow(measure, "statistics binary, label double, half int")
    held = store(measured.repartition(8), "quality-sample")
    fitted = held.where("half = 0").select("statistics", "label")

    n = STATISTICS
    moments = _sums(fitted, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 2 * n + 1)
    count = max(moments[0], 1)
    mean = moments[1 : n + 1] / count
    scale = np.sqrt(np.maximum(moments[n + 1 :] / count - mean**2, 1e-8))
    random = np.random.default_rng(seed)
    waves = random.normal(size=(n, FEATURES)) / KERNEL_WIDTH
    phases = random.uniform(0, 2 * np.pi, FEATURES)
    none = np.zeros(0)
    model = Model(mean, scale, waves, phases, none, none, none)

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    size = FEATURES + 1
    sums = _sums(fitted, equations, size * size + size)
    left = sums[: size * size].reshape(size, size) + RIDGE * np.eye(size)
    weights = np.linalg.solve(left, sums[size * size :])
    rest = held.where("half = 1").select("statistics", "label").collect()  # at most ``rows``
    if not rest:
        return Model(mean, scale, waves, phases, weights, np.zeros(1), np.full(1, 0.5))
    x = np.frombuffer(b"".join(row["statistics"] for row in rest)).reshape(-1, n)
    raw, calibrated = isotonic(model.features(x) @ weights, np.array([r["label"] for r in rest]))
    return Model(mean, scale, waves, phases, weights, raw, calibrated)


def score(docs: DataFrame, model: Model, *keys: str) -> DataFrame:
    """``keys`` with ``score``, 0 to 1, of every whole text: how likely it is of good quality.

    A null text counts as empty, and empty texts have a score as well. Rows are scored one by
    one: repeated rows and null keys come out as they are, other columns are not read.
    """
    rows = text_rows(docs, *keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, found in _statistics_of(batch.column(len(keys))):
                part = batch.slice(start, stop - start)
                columns = [*part.columns[: len(keys)], pa.array(model.score(found))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "score"])

    return rows.mapInArrow(run, schema_of(rows, keys, score="double"))


def fit_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    return score(docs, learn(docs, labels), "doc_id").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
