"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidelog.functions.session import ship_package
from tidelog.llm.common import lean, spare, texts

#: Most labelled rows that are fitted on; beyond it those with the smallest hash of their id.
SAMPLE = 20_000
N_FEATURES = 16

_SYMBOLS, _MARKS = b"#*$%&|<>{}[]\\^~=@_/", b"!?"
_PUNCTUATION = bytes(c for c in range(128) if not (0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A))
_UPPER, _LOWER, _DIGITS = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)), bytes(range(0x30, 0x3A))


def _count(data: bytes, which: bytes) -> int:
    return len(data) - len(data.translate(None, which))


def features(text: bytes) -> list[float]:
    """Transformed statistics of UTF-8 text: log counts, square roots of shares. All finite, empty text included."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * N_FEATURES
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = set(zip(words, words[1:]))
    triples = max(0, n - 2)
    kinds = len(set(words))
    letters = _count(text, _LOWER) + _count(text, _UPPER)
    widths = np.fromiter(map(len, words), np.float64, n)
    shares = [
        _count(text, _SYMBOLS) / size * 5, _count(text, _MARKS) / size * 5, text.count(b"|") / n, _count(text, _UPPER) / max(1, letters),
        _count(text, _DIGITS) / size, 1 - len(set(zip(words, words[1:], words[2:]))) / triples if triples else 0.0,
        1 - len(pairs) / (n - 1) if n > 1 else 0.0, sum(map(bytes.__eq__, map(bytes.lower, words), map(bytes.lower, words[1:]))) / n,
        1 - len(set(lines)) / len(lines), _count(text, b".,;:") / size * 5, sum(1 for w in words if not w.translate(None, _PUNCTUATION)) / n,
    ]
    return [
        np.log1p(n), np.log(widths.mean()), np.log1p(widths.std()), np.log1p(n / len(lines)), np.log(kinds) / np.log(n + 1),
        *(float(np.sqrt(min(1.0, max(0.0, s)))) for s in shares),
    ]


def _logistic(d: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-d)), where beyond 20 d counts by its logarithm."""
    size = np.abs(d)
    return 1 / (1 + np.exp(-np.sign(d) * np.where(size > 20, 20 + np.log(np.maximum(size, 20) / 20), size)))


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussians with shrunk covariances; what scoring needs of each is cached: mean, inverse Cholesky factor, log weight."""

    means: np.ndarray
    inverses: np.ndarray
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    temper: float = 1.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, shrink: float = 0.3, ridge: float = 0.05) -> Discriminant:
        """Class covariances: (1 - shrink) own + shrink pooled, plus ridge on the standardised diagonal."""
        return _fitted(x, y, shrink, ridge)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, from halved Mahalanobis distances."""
        z = (x - self.centre) / self.scale
        d = [self.weights[k] - 0.5 * (((z - self.means[k]) @ self.inverses[k].T) ** 2).sum(1) for k in (0, 1)]
        return d[1] - d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1; far outliers stay a little off 0 and 1, so that thresholds can tell any two."""
        return _logistic(self.temper * self.difference(x))


def _fitted(x: np.ndarray, y: np.ndarray, shrink: float = 0.3, ridge: float = 0.05) -> Discriminant:
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - centre) / scale
    own = [np.cov(z[y == k].T, bias=True) if (y == k).sum() > 1 else np.zeros((x.shape[1],) * 2) for k in (0, 1)]
    share = np.array([(y == k).mean() for k in (0, 1)])
    pooled = share[0] * own[0] + share[1] * own[1]
    means, inverses, weights = [], [], []
    for k in (0, 1):
        factor = np.linalg.cholesky((1 - shrink) * own[k] + shrink * pooled + ridge * np.eye(x.shape[1]))
        means.append(z[y == k].mean(0))
        inverses.append(np.linalg.inv(factor))
        weights.append(np.log(share[k]) - np.log(np.diag(factor)).sum())
    return Discriminant(np.array(means), np.array(inverses), np.array(weights), centre, scale)


def temper(x: np.ndarray, y: np.ndarray, folds: int = 4) -> float:
    """What density differences are multiplied by to be log odds: least log loss over rows that a fit on the other folds has not seen.

    The statistics of a document are not independent Gaussians, so the differences themselves are far
    too sure. Signs, and with them decisions, don't change. Too few rows of a class: 1.
    """
    if min((y == 0).sum(), (y == 1).sum()) < 4 * folds:
        return 1.0
    place = np.zeros(len(y), int)
    for k in (0, 1):
        place[y == k] = np.arange((y == k).sum()) % folds
    d = np.zeros(len(y))
    for f in range(folds):
        d[place == f] = _fitted(x[place != f], y[place != f]).difference(x[place == f])
    signed = np.where(y == 1, d, -d)
    rates = 2.0 ** np.arange(-8, 1, 0.5)
    return float(rates[np.argmin([np.logaddexp(0, -r * signed).mean() for r in rates])])


@dataclass(frozen=True)
class Constant:
    """Stands in where the labels have one class or none."""

    value: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])


def held_out(doc_id="doc_id", folds: int = 3, fold: int = 1):
    """True for rows that are not learned from: crc32 of the id's text, modulo folds. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """The model, from labelled rows that are not held out, ``sample`` of them at most.

    Only their ids and labels (bounded) are broadcast, and only their features come to the driver.
    Rows with a null label, or one other than 0 and 1, are no examples; a document labelled twice
    is two examples. Without both classes the score is a constant: the only label, or a half.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("d"), F.col("quality").cast("int").alias("y"))
    known = known.where("y in (0, 1) and d is not null").where(~held_out("d")).orderBy(F.xxhash64("d"), "d", "y").limit(sample)
    rows = texts(docs)
    chosen = rows.join(F.broadcast(known), rows.doc_id == known.d).select(F.col("y"), "text")
    got = chosen.mapInArrow(lean(_features, "quality_model"), "y int, x array<double>").toArrow()
    y = got.column("y").to_numpy()
    if len(set(y.tolist())) < 2:
        return Constant(float(y[0]) if len(y) else 0.5)
    x = np.array(got.column("x").to_pylist())
    order = np.lexsort((*x.T, y))  # the same sums whatever order the rows came in
    x, y = x[order], y[order]
    return replace(Discriminant.fit(x, y), temper=temper(x, y))


def _score(shared, text: str, score: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names = batch.schema.names
            raw = batch.column(names.index(text)).cast(pa.binary()).to_pylist()
            x = np.array([features(t or b"") for t in raw]).reshape(-1, N_FEATURES)
            kept = [n for n in names if n not in (score,)]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(n)) for n in kept), pa.array(model.score(x), pa.float64())], names=[*kept, score])

    return run


def _only_score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id and score, the probability of label 1, for every row of docs; null text counts as empty.

    The text alone decides: labels, lang, source and doc_id are no inputs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    return texts(docs).mapInArrow(lean(_only_score(shared), "quality_model"), "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that score at least threshold, all columns unchanged."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    name = spare(docs.columns, "score")
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.mapInArrow(lean(_score(shared, "text", name), "quality_model"), schema).where(F.col(name) >= threshold).drop(name)
