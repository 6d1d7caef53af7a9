"""Quality classifier: Bradley-Terry pairwise ranking over text statistics.

Scores are learned from preference pairs (a document of label 1 over one of label 0) by logistic loss on the
difference of their features; the cut is a quantile of the training scores, and scores are mapped to 0..1 so that
the cut lies at THRESHOLD. Features are statistics of the text, and what each of them has beyond quantiles of the training rows,
so that a statistic may count for more above some level. No id, language, source or label is an input.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlight.llm.common import map_rows

THRESHOLD = 0.7
#: Bounds of what is learned from: labelled rows of each label, chosen by hash, and preference pairs.
SAMPLE, PAIRS = 2000, 40_000
_SPACE = " \t\n\x0b\x0c\r"
_SIGNS = re.compile(r"[^\w\s.,;:'\"()?-]")
_UPPER, _LOWER, _DIGIT = re.compile(r"[A-ZÀ-Þ]+"), re.compile(r"[a-zß-ÿ]+"), re.compile(r"[0-9]+")
_MARK = re.compile(rb"[*#$%&!|<>=_~^@+]+[\x20\x09-\x0D]")
NAMES = (
    "bias_empty", "log_words", "few_words", "word_length", "signs", "marked_words", "upper", "no_lower", "digits", "distinct_words",
    "repeated_windows", "dup_lines", "line_words", "sentence_ends", "most_common",
)
#: Quantiles of the training rows at which a statistic may begin to count for more or less.
KNOTS = (0.1, 0.25, 0.5, 0.75, 0.9)


def features(text: str | None) -> list[float]:
    """Statistics of one whole text, in the order of NAMES; null counts as empty."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return [1.0] + [0.0] * (len(NAMES) - 1)
    total = sum(map(len, words))
    kinds = set(words)
    windows = len(set(zip(words, words[1:], words[2:]))) if n > 2 else 0  # noqa: B905
    repeated = 1 - windows / (n - 2) if n > 2 else 0.0
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    upper, lower = (sum(map(len, p.findall(text))) for p in (_UPPER, _LOWER))
    letters = max(1, upper + lower)
    signs = len(_SIGNS.findall(text)) / n
    marked = len(_MARK.findall(b" ".join(words) + b" ")) / n
    digits = sum(map(len, _DIGIT.findall(text))) / total
    common = Counter(words).most_common(1)[0][1] / n
    return [
        0.0, math.log1p(n) / 8, float(n < 20), min(total / n, 30) / 10, min(signs, 3), min(marked, 1), upper / letters, float(lower < upper),
        min(digits, 1), len(kinds) / n, repeated, 1 - len(set(lines)) / len(lines), min(n / len(lines), 100) / 100,
        min((text.count(".") + text.count("?")) / n, 1), common,
    ]


def beyond(x: np.ndarray, knots: tuple[tuple[float, ...], ...]) -> np.ndarray:
    """The columns of x, and for each knot what its column has beyond it."""
    return np.concatenate([x, *[np.maximum(x[:, [i]] - np.array(k), 0) for i, k in enumerate(knots)]], axis=1)


@dataclass(frozen=True)
class Model:
    """Score of x: logistic of ``slope * (weights . (x - mean) / scale - cut)``, shifted so that the cut scores THRESHOLD."""

    weights: tuple[float, ...]
    knots: tuple[tuple[float, ...], ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    cut: float
    slope: float
    constant: float | None = None  # the score of all texts where nothing could be learned

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        raw = ((beyond(x, self.knots) - np.array(self.mean)) / np.array(self.scale)) @ np.array(self.weights)
        z = self.slope * (raw - self.cut) + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, penalty: float = 1e-3, steps: int = 30, seed: int = 7) -> Model:
    """Bradley-Terry weights by Newton's method on the logistic loss of preference pairs; the cut is the score quantile
    that parts the two labels best (mean of both rates of right answers), halfway to the next score above."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model((), (), (), (), 0.0, 0.0, 1.0 if len(good) else 0.0 if len(bad) else 0.5)
    knots = tuple(tuple(np.unique(np.quantile(x[:, i], KNOTS)).tolist()) for i in range(x.shape[1]))
    x = beyond(x, knots)
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))  # chance of the wrong order
        grad = -(d * p[:, None]).mean(0) + penalty * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + penalty * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    raw = z @ w
    order = np.sort(raw)
    levels = np.unique(np.quantile(order, np.linspace(0, 1, 401)))
    right = [(raw[good] >= t).mean() + (raw[bad] < t).mean() for t in levels]
    best = levels[int(np.argmax(right))]
    below = order[order < best]
    cut = float((best + below[-1]) / 2) if len(below) else float(best)
    spread = float(raw[good].mean() - raw[bad].mean())
    return Model(tuple(w), knots, tuple(mean), tuple(scale), cut, 6 / max(spread, 1e-6))


def held_out(key: Column) -> Column:
    """Rows whose label is never learned from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Texts with labels to learn from: of each label at most ``sample`` rows, the first by hash of the id. Rows that repeat an id are
    all taken."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    order = F.xxhash64("doc_id")
    picked = known.where("quality = 0").orderBy(order, "doc_id").limit(sample).union(known.where("quality = 1").orderBy(order, "doc_id").limit(sample))
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").withColumn("place", order)  # at most 2 * sample ids


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model learned from training_rows(). Null texts count as empty; an id that documents or labels repeat gives a row for each
    pair; where that makes more than 8 * sample rows, the first by hash of the id are learned from. Without rows of both labels
    all texts get one score."""
    rows = training_rows(docs, labels, sample).select("place", "text", "quality")
    made = map_rows(rows, lambda c: [c[0], list(map(features, c[1])), c[2]], "place long, x array<double>, y int").orderBy("place", "y", "x").limit(8 * sample).collect()
    x = np.array([r.x for r in made], dtype=float).reshape(len(made), len(NAMES))
    order = np.lexsort(x.T[::-1])  # the same pairs whatever the order of the rows
    return fit_pairs(x[order], np.array([r.y for r in made])[order])


def classify(docs: DataFrame, model: Model, score_as: str = "score", predicted_as: str = "predicted") -> DataFrame:
    """All columns of docs, and those two, by the whole text; null and empty texts are scored as empty ones."""
    from pyspark.sql.types import DoubleType

    @F.pandas_udf(DoubleType())
    def score(texts):
        import pandas as pd

        x = np.array([features(t) for t in texts], dtype=float).reshape(len(texts), len(NAMES))
        return pd.Series(model.score(x), dtype="float64")

    return docs.withColumn(score_as, score(F.col("text"))).withColumn(predicted_as, (F.col(score_as) >= THRESHOLD).cast("int"))
