"""Document quality by Bradley-Terry pairwise ranking.

Pairs of a good and a bad labelled document are preferences. A score linear in dense text features is learnt by
logistic loss on the feature differences of the pairs. The cut is a quantile of the scores of all documents, from a
histogram: that of the share of bad documents. The share is that of labelled rows below the place of least misjudged
label weight, so that mislabelled rows don't add to it; it is known to two standard errors, and between the quantiles
of its bounds the cut falls where scores are least dense. Scores are brought to 0..1 so that the cut lies at the threshold.

Bounds: at most `per_class` labelled rows of either class, outside the held-out fold, come to the driver, as some
thirty numbers each, and `pairs` preferences for each of them; of all other scores a histogram of `bins` counts.

Nulls and odd rows: a null text counts as empty, and an empty text has features of zeros; long texts are measured
whole; equal texts score alike; without labels of both classes the score is the constant label rate; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import class_rates, fold, labelled_sample, small_batches
from .toxicity import platt

FOLDS, HELD_OUT = 5, 0
KINDS = 10


def _kinds() -> np.ndarray:
    """Character classes below code point 0x250: other, lower, upper, digit, blank, line end, stop, comma, loud, symbol."""
    out = np.zeros(0x250, dtype=np.uint8)
    for i in range(0x250):
        c = chr(i)
        out[i] = (1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 5 if c == "\n" else 4 if c.isspace()
                  else 6 if c in ".;:" else 7 if c == "," else 8 if c in "!?" else 9 if 32 < i < 127 or 160 < i < 192 else 0)
    return out


KIND_OF = _kinds()


def text_features(text: str | None) -> np.ndarray:
    """Dense features of a whole text; zeros for an empty one."""
    text = text or ""
    if not text:
        return np.zeros(26)
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    kind = np.where(codes < 0x250, KIND_OF[np.minimum(codes, 0x24F)], 0)
    share = np.bincount(kind, minlength=KINDS) / len(kind)
    same = kind[1:] == kind[:-1]
    runs = [float((same & (kind[1:] == k)).sum()) / len(kind) for k in (2, 3, 8, 9)]
    words = text.split()
    n = max(1, len(words))
    distinct = len(set(words))
    lines = [x for x in text.split("\n") if x]
    m = max(1, len(lines))
    raw = text.encode()
    packed = len(zlib.compress(raw, 1))
    letters = share[1] + share[2]
    return np.array([
        *share, *runs, np.log1p(n), letters, sum(map(len, words)) / n / 10, distinct / n, (n - distinct) / np.sqrt(n),
        1 - len(set(lines)) / m, np.log1p(m), n / m / 50, packed / (len(raw) + 20), share[6] * len(kind) / n, share[9] * len(kind) / n, share[2] / max(letters, 1e-9),
    ])


def expand(x: np.ndarray) -> np.ndarray:
    """Features, their squares and their square roots."""
    return np.concatenate([x, x * x, np.sqrt(np.abs(x))], axis=-1)


@dataclass(frozen=True)
class QualityParams:
    per_class: int = 4000
    pairs: int = 6
    l2: float = 1e-3
    steps: int = 40
    bins: int = 4096
    threshold: float = 0.3


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float

    def utility(self, x: np.ndarray) -> np.ndarray:
        return ((expand(x) - self.mean) / self.scale) @ self.weights

    def utility_column(self, text):
        """Utility as a column expression."""
        model = self

        @F.pandas_udf("double")
        def quality_utility(texts: pd.Series) -> pd.Series:
            return pd.Series(model.utility(np.stack([text_features(t) for t in texts])) if len(texts) else [], dtype="float64")
        return quality_utility(text)

    def column(self, text):
        """Score as a column expression."""
        model = self

        @F.pandas_udf("double")
        def quality_score(texts: pd.Series) -> pd.Series:
            if not len(texts):
                return pd.Series([], dtype="float64")
            z = model.slope * model.utility(np.stack([text_features(t) for t in texts])) + model.shift
            return pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))))
        return quality_score(text)


def bradley_terry(good: np.ndarray, bad: np.ndarray, p: QualityParams, seed: int = 5) -> np.ndarray:
    """Weights that put good rows above bad ones: logistic loss on differences, by Newton steps."""
    rng = np.random.default_rng(seed)
    n = max(len(good), len(bad)) * p.pairs
    diff = good[rng.integers(0, len(good), n)] - bad[rng.integers(0, len(bad), n)]
    w = np.zeros(diff.shape[1])
    for _ in range(p.steps):
        prob = 1 / (1 + np.exp(np.clip(diff @ w, -40, 40)))  # of the pair being ranked the wrong way
        grad = -(diff.T @ prob) / n + p.l2 * w
        hess = (diff * (prob * (1 - prob))[:, None]).T @ diff / n + p.l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_quality(docs: DataFrame, labels: DataFrame, params: QualityParams | None = None) -> QualityModel:
    with small_batches(docs.sparkSession):
        return _fit(docs, labels, params or QualityParams())


def _fit(docs: DataFrame, labels: DataFrame, p: QualityParams) -> QualityModel:
    n0, n1 = class_rates(labels, "quality", FOLDS, HELD_OUT)
    prior = (n1 + 0.5) / (n0 + n1 + 1)

    def measure(batches):
        for pdf in batches:
            yield pd.DataFrame({"label": pdf["label"], "x": [text_features(t).tolist() for t in pdf["text"]]})

    got = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, p.per_class).mapInPandas(measure, "label int, x array<double>").toPandas()
    y = got["label"].to_numpy()
    if len(set(y.tolist())) < 2:
        return QualityModel(np.zeros(78), np.ones(78), np.zeros(78), 1.0, float(np.log(prior / (1 - prior))))
    x = expand(np.stack(got["x"].to_numpy()))
    order = np.lexsort((*x.T[::-1], y))  # one order, whatever the partitions
    x, y = x[order], y[order]
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    x = (x - mean) / scale
    w = bradley_terry(x[y == 1], x[y == 0], p)
    u = x @ w
    weight = np.where(y == 1, n1 / max(1, (y == 1).sum()), n0 / max(1, (y == 0).sum()))
    slope, _ = platt(u, y.astype(float), weight)
    model = QualityModel(mean, scale, w, max(slope, 0.05), 0.0)
    share, error = bad_share(u, y, weight)
    low, width = float(u.min()), max(float(np.ptp(u)), 1e-9)
    bin_ = F.least(F.greatest(F.floor((model.utility_column(F.col("text")) - (low - width / 4)) / (1.5 * width) * p.bins), F.lit(0)), F.lit(p.bins - 1))
    counts = np.zeros(p.bins)
    for r in docs.select(bin_.cast("int").alias("bin")).groupBy("bin").count().collect():  # at most p.bins rows
        counts[r["bin"]] = r["count"]
    cut = low - width / 4 + quantile_cut(counts, share, error) / p.bins * 1.5 * width
    model.shift = float(np.log(p.threshold / (1 - p.threshold)) - model.slope * cut)
    return model


def bad_share(u: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Share of bad rows by the utility below which the least label weight is misjudged, and two standard errors of it."""
    order = np.argsort(u, kind="stable")
    wrong = np.cumsum(np.where(y[order] == 1, weight[order], -weight[order]))
    share = float(weight[order][: int(np.argmin(wrong)) + 1].sum() / weight.sum()) if wrong.min() < 0 else 0.0
    return share, float(2 * np.sqrt(max(share * (1 - share), 1e-9) / len(u)))


def quantile_cut(counts: np.ndarray, share: float, error: float, blur: int = 33) -> float:
    """The place, in bins, of least density between the quantiles share - error and share + error of a histogram."""
    below = np.append(0, np.cumsum(counts)) / max(1, counts.sum())
    first = int(np.searchsorted(below, max(share - error, 0.0), side="left"))
    last = max(first, int(np.searchsorted(below, min(share + error, 1.0), side="right")) - 1)
    dense = np.convolve(np.append(counts, 0), np.ones(blur), "same")[first : last + 1]
    least = np.flatnonzero(dense == dense.min())
    return float(first + least[len(least) // 2])


def score_quality(docs: DataFrame, labels: DataFrame, params: QualityParams | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    p = params or QualityParams()
    model = fit_quality(docs, labels, p)
    out = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), model.column(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= p.threshold).cast("int"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, params: QualityParams | None = None) -> DataFrame:
    """The documents that score at least the threshold, with their columns."""
    p = params or QualityParams()
    model = fit_quality(docs, labels, p)
    return docs.where(model.column(F.col("text")) >= p.threshold)
