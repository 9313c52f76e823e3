"""Quality by ordinal cumulative-link regression on hashed words.

Ratings are ordered grades. One weight vector over hashed words and shape features is shared by all grades, and
ordered thresholds cut the line: ``P(grade > k) = sigmoid(w x - theta_k)``. The model gives the expected grade and the
tail probability of reaching a grade, by which documents are selected. It is fitted by gradient descent on a bounded
sample of labelled rows (a documented parameter); every document is scored whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, small_batches, worker_cache

BUCKETS = 1 << 16
SHAPES = 12
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]{2}").search
_SIGNS = re.compile(r"[#*$%&|<>={}\[\]\\~^]").search
_END = re.compile(r"[.!?]$").search
_DOUBLE = re.compile(r"[!?]{2}|\.{3}").search


def _features_of_word(word: str) -> tuple[int, ...]:
    """Bucket of the word, and its shape: capitals, signs, an end of sentence, doubled marks, a digit, its length."""
    bare = word.lower().strip(".,;:!?")
    at = zlib.crc32(bare.encode("utf-8", "surrogatepass")) % BUCKETS
    return (at, _UPPER(word) is not None, _SIGNS(word) is not None, _END(word) is not None, _DOUBLE(word) is not None, any(map(str.isdigit, word)), min(len(word), 40))


def shape(n: int, sums: np.ndarray, distinct: int, lines: int, distinct_lines: int) -> np.ndarray:
    """Dense features of a text from the sums over its words; all lie near 0 to 1."""
    if not n:
        return np.r_[1.0, np.zeros(SHAPES - 1)]
    up, signs, ends, doubled, digits, length = sums / n
    few, repeats = max(0.0, 1 - n / 50), 1 - distinct / n
    return np.array([0.0, up, signs, min(1.0, 8 * ends), doubled, digits, length / 10, few, repeats, (1 - distinct_lines / lines) if lines else 0.0, min(1.0, np.log1p(n) / 10), float(n < 10)])


def _describe(text: str | None, cache: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, their values and the shape of one text. Word counts are damped and normalized to unit length."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0), shape(0, np.zeros(6), 0, 0, 0)
    seen = Counter(words)
    table = np.array([cache[w] for w in seen], dtype=np.int64)
    often = np.fromiter(seen.values(), np.int64, len(seen))
    at, place = np.unique(table[:, 0], return_inverse=True)
    value = np.log1p(np.bincount(place, often))
    lines = [x for x in text.split("\n") if x]
    dense = shape(n, (often @ table[:, 1:]).astype(float), len(at), len(lines), len(set(lines)))
    return at, value / np.sqrt((value**2).sum()), dense


@dataclass
class OrdinalModel:
    weights: np.ndarray  # BUCKETS hashed words, then SHAPES
    thresholds: np.ndarray  # one fewer than grades, ascending
    grades: list[int]

    def tails(self, at: np.ndarray, value: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """P(grade > grades[k]) for each k but the last."""
        line = float(self.weights[at] @ value + self.weights[BUCKETS:] @ dense)
        return 1 / (1 + np.exp(-np.clip(line - self.thresholds, -30, 30)))


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray, grades: list[int], steps: int = 400, ridge: float = 1e-3, rate: float = 0.05) -> OrdinalModel:
    """Full-batch Adam on the proportional-odds likelihood; thresholds stay ordered by their increments.

    ``y`` are indices into ``grades``. With fewer than two grades every text has that grade for certain.
    """
    if not rows:
        return _fit(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros((0, SHAPES)), y, grades, steps, ridge, rate)
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    at, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    return _fit(owner, at, value, np.stack([r[2] for r in rows]), y, grades, steps, ridge, rate)


def _fit(owner: np.ndarray, at: np.ndarray, value: np.ndarray, dense: np.ndarray, y: np.ndarray, grades: list[int], steps: int = 400, ridge: float = 1e-3, rate: float = 0.05) -> OrdinalModel:
    n, k = len(dense), len(grades) - 1
    if k < 1 or not n:
        return OrdinalModel(np.zeros(BUCKETS + SHAPES), np.zeros(max(k, 0)), grades or [0])
    share = np.array([(y > j).mean() for j in range(k)]).clip(0.01, 0.99)
    theta0 = np.log((1 - share) / share)
    # First threshold, then logarithms of the steps between thresholds.
    cuts = np.r_[theta0[0], np.log(np.maximum(np.diff(theta0), 0.05))]
    w = np.zeros(BUCKETS + SHAPES)
    moments = [[np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(cuts), np.zeros_like(cuts)]]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    row = np.arange(n)
    for t in range(1, steps + 1):
        theta = np.r_[cuts[0], cuts[0] + np.cumsum(np.exp(cuts[1:]))]
        line = np.bincount(owner, w[at] * value, n) + dense @ w[BUCKETS:]
        above = np.c_[np.ones(n), sigmoid(line[:, None] - theta[None, :]), np.zeros(n)]  # P(index >= j)
        chance = np.maximum(above[row, y] - above[row, y + 1], 1e-9)
        slope = above * (1 - above)
        grad_line = -(slope[row, y] - slope[row, y + 1]) / chance / n
        grad_theta = np.zeros(k + 2)
        np.add.at(grad_theta, y, slope[row, y] / chance / n)
        np.add.at(grad_theta, y + 1, -slope[row, y + 1] / chance / n)
        grad_theta = grad_theta[1:-1]
        grad_w = np.r_[np.bincount(at, grad_line[owner] * value, BUCKETS), dense.T @ grad_line] + ridge * w / 10
        grad_cuts = np.r_[grad_theta.sum(), np.cumsum(grad_theta[::-1])[::-1][1:] * np.exp(cuts[1:])]
        for x, g, (m, v) in ((w, grad_w, moments[0]), (cuts, grad_cuts, moments[1])):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return OrdinalModel(w, np.r_[cuts[0], cuts[0] + np.cumsum(np.exp(cuts[1:]))], grades)


def fit(docs: DataFrame, labels: DataFrame, grade: str = "quality", max_fit_rows: int = 8_000, **how) -> OrdinalModel:
    """Fit on at most about ``max_fit_rows`` labelled rows outside the held-out fold (see ``labelled_sample``).

    Only the hashed features of that bounded sample reach the driver.
    """
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, grade, max_fit_rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = worker_cache("quality words", _features_of_word)
        for batch in batches:
            out = [(i, g, *(x.tolist() for x in _describe(t, cache))) for i, g, t in zip(batch["doc_id"], batch["grade"], batch["text"])]
            yield pd.DataFrame(out, columns=["doc_id", "grade", "at", "value", "dense"])

    sample = sample.withColumn("doc_id", F.col("doc_id").cast("string"))
    table = sample.mapInPandas(run, "doc_id string, grade int, at array<int>, value array<float>, dense array<double>")
    # As Arrow columns: the sample's features stay flat, with no object for each row.
    found = table.toArrow().combine_chunks()
    found = found.take(pc.sort_indices(found, [("doc_id", "ascending"), ("grade", "ascending")]))
    grades = sorted(set(found["grade"].to_pylist()))
    flat = lambda name: pc.list_flatten(found[name]).to_numpy()
    owner = np.repeat(np.arange(found.num_rows), pc.list_value_length(found["at"]).to_numpy())
    y = np.searchsorted(grades, found["grade"].to_numpy()) if grades else np.zeros(0, int)
    return _fit(owner, flat("at"), flat("value"), flat("dense").reshape(-1, SHAPES), y, grades, **how)


def score(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """``docs`` with ``expected_grade`` and ``tail`` (probability of each grade but the lowest) added or replaced.

    A null text is an empty one and gets a grade like any other. Rows stay as they are, repeated ones too.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    @F.pandas_udf("struct<expected_grade:double,tail:array<double>>")
    def rated(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = OrdinalModel(**shared.value)
        cache = worker_cache("quality words", _features_of_word)
        grades = np.array(of.grades, float)
        for texts in batches:
            expected, tails = [], []
            for body in texts:
                tail = of.tails(*_describe(body, cache)) if len(grades) > 1 else np.zeros(0)
                tails.append(tail.tolist())
                expected.append(float(grades[0] + tail @ np.diff(grades)))
            yield pd.DataFrame({"expected_grade": expected, "tail": pd.Series(tails, dtype=object)})

    out = docs.drop("expected_grade", "tail", "_rated").withColumn("_rated", rated(F.col(text)))
    return out.withColumn("expected_grade", F.col("_rated.expected_grade")).withColumn("tail", F.col("_rated.tail")).drop("_rated")


def select_documents(docs: DataFrame, model: OrdinalModel, min_grade: int = 1, min_tail: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` with the two scores and ``selected``: the probability of ``min_grade`` or more is ``min_tail`` or more."""
    place = [k for k, g in enumerate(model.grades) if g >= min_grade]
    out = score(docs.drop("selected"), model, text)
    if not place:
        return out.withColumn("selected", F.lit(False))
    if place[0] == 0:
        return out.withColumn("selected", F.lit(True))
    return out.withColumn("selected", F.get("tail", place[0] - 1) >= min_tail)
