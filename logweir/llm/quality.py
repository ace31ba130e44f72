"""Quality by regularised quadratic discriminant analysis (operator 9).

Each class has a Gaussian over transformed statistics of a whole text. Its
covariance is shrunk towards the pooled one and that towards a multiple of the
identity; scores are differences of Mahalanobis log densities by Cholesky
factors that are computed once, mapped to 0..1 by a logistic curve fitted on
training rows that the densities were not fitted on.

The model is fitted on a bounded sample: at most ``limit`` labelled rows in
hash order of doc_id, the same on reruns. Null texts count as empty; every row
gets a score. With no labelled rows of one of the classes the score is 0.5.
"""

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logweir.llm.common import held_out, small_batches, training_rows
from logweir.llm.tokens import slices

TRAINING_ROWS = 12_000
THRESHOLD = 0.7

_SPACE, _UPPER, _LOWER, _DIGIT, _STOP, _MARK = (np.zeros(256, bool) for _ in range(6))
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_UPPER[65:91] = True
_LOWER[97:123] = True
_DIGIT[48:58] = True
_STOP[[44, 46]] = True
_MARK[33:127] = True
_MARK &= ~(_UPPER | _LOWER | _DIGIT | _STOP)
_CLASSES = np.stack([_SPACE, _UPPER, _LOWER, _DIGIT, _STOP, _MARK]).astype(np.float64)


def features(text: str | None) -> list[float]:
    """Statistics of a whole text, on scales where classes are nearly Gaussian."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = (_CLASSES @ counts) / max(1, n)
    wide = counts[128:].sum() / max(1, n)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    nw, uniq = len(words), len(set(words))
    again = sum(map(bytes.__eq__, words, words[1:])) / max(1, nw - 1)
    size = sum(map(len, words)) / max(1, nw)
    marked = sum(1 for w in words if w[-1] in b"!#$%&*|?~^=@<>") / max(1, nw)
    p = counts[counts > 0] / max(1, n)
    packed = len(zlib.compress(raw, 1)) / (n + 20) if n else 1.0
    small = lambda x: math.log(x + 0.003)
    return [
        math.log1p(n),
        math.log1p(nw),
        *map(small, share.tolist()),
        wide,
        small(counts[33] / max(1, n)),
        small(counts[124] / max(1, n)),
        small(again),
        small(marked),
        math.log1p(size),
        uniq / max(1, nw),
        small(1 - len(set(lines)) / max(1, len(lines))),
        small(len(lines) / max(1, nw)),
        packed * math.log1p(n),
        packed,
        float(-(p * np.log(p)).sum()) if n else 0.0,
    ]


N_FEATURES = len(features(""))


@dataclass
class Quadratic:
    """Two Gaussians with inverse Cholesky factors, and the logistic map of their difference."""

    mean: np.ndarray
    scale: np.ndarray
    centers: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        d = [self.offsets[c] - 0.5 * (((z - self.centers[c]) @ self.factors[c].T) ** 2).sum(axis=1) for c in (0, 1)]
        return d[1] - d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.shift, -50, 50)))


def _densities(x, y, shrink, ridge) -> Quadratic:
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    centers = np.stack([z[y == c].mean(axis=0) for c in (0, 1)])
    own = [np.cov(z[y == c].T, bias=True) if (y == c).sum() > 1 else np.zeros((x.shape[1],) * 2) for c in (0, 1)]
    pooled = sum(o * (y == c).mean() for c, o in enumerate(own))
    factors, offsets = [], []
    for c in (0, 1):
        s = (1 - shrink) * own[c] + shrink * pooled
        s = (1 - ridge) * s + ridge * max(np.trace(s) / len(s), 1e-3) * np.eye(len(s))
        chol = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(chol))
        offsets.append(-np.log(np.diag(chol)).sum() + math.log(max((y == c).mean(), 1e-6)))
    return Quadratic(mean, scale, centers, np.stack(factors), np.array(offsets))


def _logistic(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """slope and shift by damped Newton steps, with a weak pull to slope 1 and shift 0."""
    x, start = np.stack([np.clip(d, -40, 40), np.ones_like(d)], axis=1), np.array([1.0, 0.0])

    def loss(w):
        z = x @ w
        return (np.logaddexp(0, z) - y * z).sum() + 0.5 * ((w - start) ** 2).sum()

    w = start
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (p - y) + (w - start))
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return max(0.02, float(w[0])), float(w[1])


def fit(x: np.ndarray, y: np.ndarray) -> Quadratic | None:
    """Shrinkage by validated log loss over a small grid; None if a class is missing."""
    if len(set(y.tolist())) < 2 or min(np.bincount(y)) < 2:
        return None
    fold = np.arange(len(y)) % 5
    best = None
    for shrink in (0.05, 0.2, 0.5, 0.8):
        for ridge in (0.01, 0.05, 0.2):
            d = np.zeros(len(y))
            for k in range(5):
                if len(set(y[fold != k].tolist())) < 2:
                    return None
                d[fold == k] = _densities(x[fold != k], y[fold != k], shrink, ridge).difference(x[fold == k])
            slope, shift = _logistic(d, y)
            p = 1 / (1 + np.exp(-np.clip(slope * d + shift, -50, 50)))
            loss = -np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-9, 1)).mean()
            if best is None or loss < best[0] - 1e-4:
                best = loss, shrink, ridge, slope, shift
    model = _densities(x, y, *best[1:3])
    model.slope, model.shift = best[3:]
    return model


def map_texts(df: DataFrame, work, fields: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with ``fields`` that ``work(list of texts)`` gives as columns, a few MB of text at a time."""
    schema = StructType([*df.select(*keep).schema.fields, *StructType.fromDDL(fields).fields])
    names = schema.names

    place = keep.index(text) if text in keep else len(keep)

    def run(batches):
        for batch in batches:
            texts = batch.column(place)
            for a, b in slices(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist(), 2_000_000):
                cols = work(texts.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(keep))), *cols], names)

    read = df.select(*keep) if text in keep else df.select(*keep, F.col(text).cast("string"))
    return small_batches(read).mapInArrow(run, schema)


def train_quality(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> Quadratic | None:
    """The model from at most ``limit`` labelled rows; their features come to the driver, bounded by it."""
    rows = training_rows(labels, "quality", limit)
    some = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    got = map_texts(some, lambda t: [pa.array([features(x) for x in t], pa.list_(pa.float64()))], "x array<double>", ["doc_id", "y"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()
    if not got:
        return None
    return fit(np.array([r["x"] for r in got]), np.array([r["y"] for r in got], np.int64))


def score_quality(docs: DataFrame, model: Quadratic | None, keep: list[str]) -> DataFrame:
    """``keep`` columns with score: how likely label 1 is."""

    def work(texts):
        if model is None:
            return [pa.array([0.5] * len(texts))]
        return [pa.array(model.score(np.array([features(x) for x in texts])))]

    return map_texts(docs, work, "score double", keep)


def quality(docs: DataFrame, labels: DataFrame, keep: list[str], limit: int = TRAINING_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns (doc_id among them) with held_out, score and predicted for every row."""
    scored = score_quality(docs, train_quality(docs, labels, limit), keep)
    return scored.select(*keep, F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
