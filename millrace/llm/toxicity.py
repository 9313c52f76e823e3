"""Toxicity by maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

A token's score is its log-odds between toxic and other labelled texts under informative Dirichlet priors, less a
multiple of its standard error and a small drift, so that ordinary text has a negative expected score. A linear scan
finds all maximal-scoring segments of a text. By the extreme-value law of such segments, a text of ``m`` tokens holds
a segment of score ``S`` by chance ``K m exp(-lambda S)`` times; segments below ``max_e`` expected times are
significant passages. A text's statistic is the sum of their scores in excess of chance, and a logistic curve fitted
to the labelled sample turns it into a probability.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache, is_held_out, labelled_sample, materialize, small_batches, worker_cache

BUCKETS = 1 << 18
#: Tasks that read the bounded sample; it is small, however many files it was gathered from.
SAMPLE_TASKS = 8
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def buckets(word: str) -> tuple[int, ...]:
    """Buckets of a token: of the word (lower-cased, without signs at its ends) and of its first four and five letters.

    The beginnings let words of one family, each too rare to be sure of, speak for one another.
    """
    bare = _EDGE.sub("", word.lower())
    names = (bare, *(f"{bare[:k]}-" for k in (4, 5) if len(bare) > k))
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names)


def token_score(score: np.ndarray, word: str) -> float:
    """The largest score among the buckets of a token."""
    return float(score[list(buckets(word))].max())


@dataclass
class ToxicityModel:
    score: np.ndarray  # by bucket
    lam: float
    k: float
    bias: float
    slope: float
    max_e: float
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def cache(self) -> WordCache:
        return worker_cache(self.name, lambda w: token_score(self.score, w))

    def segments(self, text: str | None, cache: dict) -> tuple[int, list[tuple[int, int, float, float]]]:
        """Number of tokens, and significant passages as (first token, end, score, expected number by chance)."""
        words = text.split() if text else ()
        n = len(words)
        if not n:
            return 0, []
        s = np.fromiter(map(cache.__getitem__, words), np.float64, n)
        hits = np.flatnonzero(s > 0)
        if not len(hits):
            return n, []
        out = []
        for start, end, value in maximal_segments(s, hits):
            expected = self.k * n * math.exp(-self.lam * value)
            if expected <= self.max_e:
                out.append((start, end, value, expected))
        return n, out

    def statistic(self, segments: list[tuple[int, int, float, float]]) -> float:
        return math.log1p(sum(math.log(self.max_e) - math.log(max(e, 1e-300)) for *_, e in segments))

    def probability(self, statistic: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * statistic))))


def maximal_segments(s: np.ndarray, hits: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score), left to right, in time linear in the text.

    ``hits`` are the places of positive scores. A candidate has the running sums before and after it; a new one is
    joined with an earlier one to its left whose left sum is lower and whose right sum is not above its own.
    """
    after = np.cumsum(s)
    right = after[hits]
    left = right - s[hits]
    stack: list[list] = []  # [first, end, left sum, right sum, index of the nearest candidate with a lower left sum]
    for at, lo, hi in zip(hits.tolist(), left.tolist(), right.tolist()):
        new = [at, at + 1, lo, hi, -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                new[4] = j
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3], -1]
            del stack[j:]
    return [(first, end, hi - lo) for first, end, lo, hi, _ in stack]


def _solve_lambda(score: np.ndarray, weight: np.ndarray) -> float:
    """The positive root of sum(p exp(lambda s)) = 1; the mean score must be negative and some score positive."""
    p = weight / weight.sum()
    lo, hi = 0.0, 1.0
    excess = lambda x: float((p * np.exp(np.minimum(x * score, 500))).sum()) - 1
    while excess(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    return max(hi, 1e-3)


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and slope of a logistic curve by Newton steps with a small ridge; the slope is not negative."""
    w, design = np.zeros(2), np.c_[np.ones(len(x)), x]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + 1e-2 * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), max(float(w[1]), 0.0)


def _counts(sample: DataFrame) -> np.ndarray:
    """In how many toxic and other texts a token's bucket occurs; at most BUCKETS rows reach the driver, as Arrow columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, cache = np.zeros((2, BUCKETS), dtype=np.int32), WordCache(buckets)
        for batch in batches:
            for label, text in zip(batch["grade"], batch["text"]):
                seen[int(label > 0), list({k for w in set(text.split()) for k in cache[w]})] += 1
        at = np.flatnonzero(seen.sum(0))
        yield pd.DataFrame({"bucket": at, "toxic": seen[1, at].astype(np.int64), "other": seen[0, at].astype(np.int64)})

    rows = sample.mapInPandas(run, "bucket long, toxic long, other long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    found, out = rows.toArrow(), np.zeros((2, BUCKETS))
    for k, name in enumerate(("toxic", "other")):
        out[k, found["bucket"].to_numpy()] = found[name].to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame, max_fit_rows: int = 20_000, prior: float = 500.0, sure: float = 2.0, drift: float = 0.5, cap: float = 6.0, max_e: float = 0.5) -> ToxicityModel:
    """Learn from at most about ``max_fit_rows`` labelled rows outside the held-out fold.

    ``prior`` is the weight of the Dirichlet prior (shaped like all labelled texts), ``sure`` the multiple of the
    standard error taken off a score, ``drift`` what every token costs and ``cap`` the largest score of a token.
    Without toxic or without other rows no text is told apart and every score is the base rate.
    """
    small_batches(docs.sparkSession)
    sample = materialize(labelled_sample(docs, labels, "toxic", max_fit_rows), "toxic_sample").coalesce(SAMPLE_TASKS)
    toxic, other = _counts(sample)
    both = toxic + other
    score = np.full(BUCKETS, -drift)
    if toxic.sum() and other.sum():
        alpha = prior * (both + 0.01) / (both + 0.01).sum()
        rate = lambda y: np.log((y + alpha) / (y.sum() + prior - y - alpha))
        delta = rate(toxic) - rate(other)
        error = np.sqrt(1 / (toxic + alpha) + 1 / (other + alpha))
        score = np.minimum(np.maximum(delta - sure * error, np.minimum(delta + sure * error, 0)), cap) - drift
    weight = other if other.sum() else both + 1
    # Buckets that no clean text has still have the chance of the prior.
    weight = weight + 0.01 * (both + 0.01) / (both + 0.01).max()
    lam = _solve_lambda(score, weight) if (score > 0).any() else 1.0
    model = ToxicityModel(score, lam, 1.0, 0.0, 0.0, max_e)

    def measure(of: ToxicityModel, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = of.cache()
        for batch in batches:
            rows = []
            for label, text in zip(batch["grade"], batch["text"]):
                s = np.fromiter(map(cache.__getitem__, words := text.split()), np.float64, len(words)) if text else np.zeros(0)
                hits = np.flatnonzero(s > 0)
                best = max((v for *_, v in maximal_segments(s, hits)), default=0.0) if len(hits) else 0.0
                _, found = of.segments(text, cache)
                rows.append((int(label > 0), len(s), best, of.statistic(found)))
            yield pd.DataFrame(rows, columns=["toxic", "m", "best", "statistic"])

    def measured(of: ToxicityModel) -> pd.DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(vars(of))
        rows = sample.mapInPandas(lambda b: measure(ToxicityModel(**shared.value), b), "toxic int, m long, best double, statistic double")
        # A few numbers for each row of the bounded sample.
        return rows.toPandas()

    if (score > 0).any():
        found = measured(model)
        clean = found[(found.toxic == 0) & (found.m > 0)]
        chance = float((clean.m * np.exp(-model.lam * clean.best)).sum())
        model.k = min(max(len(clean) / chance, 1e-6), 10.0) if chance else 1.0
        found = measured(model)
        # Ties in order: the fit does not depend on how rows were dealt.
        found = found.sort_values(["statistic", "toxic", "m"])
        model.bias, model.slope = _fit_curve(found.statistic.to_numpy(), found.toxic.to_numpy(float))
    else:
        share = (toxic.sum() + 0.5) / (both.sum() + 1)
        model.bias = math.log(share / (1 - share)) if 0 < share < 1 else 0.0
    return model


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``passages`` added, in place of such columns.

    ``passages`` lists each significant passage: first token, end (exclusive), score and expected number by chance,
    over tokens between white space. Null and empty texts have no passage and the score of a text without one. Rows
    stay as they are, repeated ones too, and an empty table stays empty; equal texts have equal scores.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    kind = "struct<score:double,passages:array<struct<first:int,end:int,score:double,expected:double>>>"

    @F.pandas_udf(kind)
    def rated(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = ToxicityModel(**shared.value)
        cache = of.cache()
        names = ("first", "end", "score", "expected")
        for texts in batches:
            scores, passages = [], []
            for body in texts:
                _, found = of.segments(body, cache)
                scores.append(of.probability(of.statistic(found)))
                passages.append([dict(zip(names, x)) for x in found])
            yield pd.DataFrame({"score": scores, "passages": pd.Series(passages, dtype=object)})

    out = docs.drop("score", "passages", "_rated").withColumn("_rated", rated(F.col(text)))
    return out.withColumn("score", F.col("_rated.score")).withColumn("passages", F.col("_rated.passages")).drop("_rated")


def predictions(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The contract's columns: ``doc_id, held_out, score, predicted`` and the number of passages."""
    rated = score(docs.select("doc_id", "text"), fit(docs, labels, **how))
    return rated.select(
        "doc_id",
        is_held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        F.size("passages").cast("long").alias("n_passages"),
    )
