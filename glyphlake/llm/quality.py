"""Quality classifier: linear hinge loss over n-gram indicators scaled by Naive Bayes log-count ratios.

The indicators of a text's character n-grams (hashed) are multiplied by the log of the ratio of the
smoothed class frequencies, scaled to unit length, and separated by a linear support vector machine
that is fitted by dual coordinate descent. A logistic curve over the margin gives the score.

Cases: a null text counts as empty and is scored by the bias alone. Repeated rows get equal scores.
An empty table gives an empty result. Columns named like the answers are replaced; others are kept.
Without labels of both classes every score is the share of label 1 (0.5 without any label). Several
labels of one document: the lowest counts. Rows with a null label or key teach nothing,
and of documents that repeat a key one teaches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm import textvec
from glyphlake.llm.shared import OWN

#: Bound of the fitting sample: labelled documents, those whose hashed key is lowest.
SAMPLE_ROWS = 4_000
BITS = 16
ORDERS = (1, 2, 3)
THRESHOLD = 0.3
#: Documents that are scored together, as rows of a dense table of indicators.
BLOCK = 64


@dataclass
class QualityModel:
    ratio: np.ndarray  # log-count ratio of each hashed n-gram
    weight: np.ndarray
    bias: float
    slope: float  # of the logistic curve
    shift: float


def hashed(flat: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Of each order n: the hashed n-grams that start at each position."""
    grams = flat.astype(np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            grams = grams[:-1] * np.uint64(1000003) + flat[n - 1 :]
        if n in ORDERS and len(grams):
            yield n, (((grams + np.uint64(n * 7919)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
        if len(grams) < 2:
            return


def indicators(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The (row, feature) pairs that occur, each once, by row and feature."""
    seen = np.zeros((len(texts), 1 << BITS), dtype=bool)
    for a, b in textvec.slices(texts):
        flat = textvec.codes("".join(texts[a:b]))
        lengths = np.fromiter(map(len, texts[a:b]), dtype=np.int64, count=b - a)
        row, left = np.repeat(np.arange(a, b), lengths), np.repeat(np.cumsum(lengths), lengths) - np.arange(len(flat))
        for n, grams in hashed(flat):
            whole = left[: len(grams)] >= n
            seen.ravel()[(row[: len(grams)][whole] << BITS) + grams[whole]] = True
    at = np.flatnonzero(seen.ravel())
    return at >> BITS, at & ((1 << BITS) - 1)


def descend(rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, cost: float = 10.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss; each row has a constant 1 for the bias."""
    weight, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    square = [float(v @ v) + 1.0 for v in values]
    random = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in random.permutation(len(rows)):
            slope = sign[i] * (values[i] @ weight[rows[i]] + bias) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), cost)
            change = (new - alpha[i]) * sign[i]
            if change:
                weight[rows[i]] += change * values[i]
                bias += change
                alpha[i] = new
                moved = max(moved, abs(change))
        if moved < 1e-4:
            break
    return weight, bias


def logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """The curve that fits label 1 over the margin, with Platt's targets, by Newton's method."""
    up, down = label.sum(), len(label) - label.sum()
    target = np.where(label > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum() + 1e-3 * a, (p - target).sum()])
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * margin**2).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = max(a - step[0], 1e-3), b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def train(texts: list[str], labels: list[int]) -> QualityModel:
    label, size = np.array(labels, dtype=np.int64), 1 << BITS
    if not len(label) or label.min() == label.max():
        share = float(label.mean()) if len(label) else 0.5
        return QualityModel(np.zeros(size), np.zeros(size), 0.0, 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    rows: list[np.ndarray] = []
    for a in range(0, len(texts), BLOCK):
        row, feature = indicators(texts[a : a + BLOCK])
        rows += np.split(feature, np.searchsorted(row, np.arange(1, min(BLOCK, len(texts) - a))))
    count = np.ones((2, size))
    for t, row in zip(label, rows, strict=True):
        count[t, row] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    values = [ratio[r] / max(float(np.linalg.norm(ratio[r])), 1e-12) for r in rows]
    # The curve is fitted on margins of rows that the separating plane did not see.
    fold = np.arange(len(rows)) % 4
    margin = np.zeros(len(rows))
    for k in range(4):
        own = np.flatnonzero(fold != k)
        w, b = descend([rows[i] for i in own], [values[i] for i in own], 2.0 * label[own] - 1, rounds=6)
        for i in np.flatnonzero(fold == k):
            margin[i] = values[i] @ w[rows[i]] + b
    weight, bias = descend(rows, values, 2.0 * label - 1)
    return QualityModel(ratio, weight, bias, *logistic(margin, label))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", learn: Column | None = None) -> QualityModel:
    """Learns from at most ``SAMPLE_ROWS`` labelled documents, the same ones at each run."""
    use = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & (F.lit(True) if learn is None else learn))
    place = F.xxhash64(F.col(key)).bitwiseAND(F.lit((1 << 40) - 1))
    n = use.agg(F.approx_count_distinct(place)).first()[0]
    picked = use.where(place < min(1.0, 1.2 * SAMPLE_ROWS / max(n, 1)) * float(1 << 40)).groupBy(key).agg(F.min(label).alias("y"), F.min(place).alias("h"))
    # At most about 1.2 * SAMPLE_ROWS keys are sent out: their number is known before.
    joined = docs.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("x")).join(F.broadcast(picked), key)
    # Of documents that repeat a key one is learnt from, however many there are.
    once = joined.groupBy("h").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    rows = sorted((r["h"], r["x"], r["y"]) for r in once.collect())[:SAMPLE_ROWS]
    return train([r[1] for r in rows], [r[2] for r in rows])


def scores(model: QualityModel, texts: list[str]) -> np.ndarray:
    """The probability of label 1, of whole texts."""
    own, square = model.ratio * model.weight, model.ratio**2
    margin = np.zeros(len(texts))
    for a in range(0, len(texts), BLOCK):
        block = texts[a : a + BLOCK]
        row, feature = indicators(block)
        dot = np.bincount(row, weights=own[feature], minlength=len(block))
        norm = np.sqrt(np.bincount(row, weights=square[feature], minlength=len(block)))
        margin[a : a + len(block)] = dot / np.maximum(norm, 1e-12)
    return 1 / (1 + np.exp(-np.clip(model.slope * (margin + model.bias) + model.shift, -30, 30)))


def classify(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from ``THRESHOLD`` on) to each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(scores(sent.value, [x or "" for x in batch.tolist()]))

    got = docs.withColumn("score", judge(F.col(text).cast("string")))
    return got.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
