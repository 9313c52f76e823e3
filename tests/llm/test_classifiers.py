import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import quality_classifier as Q
from millrace.llm import toxicity as T

from .data import frame, sentence, with_clashes


def test_segments_are_maximal():
    def brute(s):
        """Maximal segments by their definition: the best segment, then the same on what is left at its sides."""
        if not len(s) or max(s) <= 0:
            return []
        best = max(((sum(s[i:j]), -(j - i), -i) for i in range(len(s)) for j in range(i + 1, len(s) + 1)))
        i = -best[2]
        j = i - best[1]
        return brute(s[:i]) + [(i, j)] + [(a + j, b + j) for a, b in brute(s[j:])]

    rng = random.Random(2)
    for _ in range(300):
        s = np.array([rng.choice([-3.5, -1.25, -0.5, 0.75, 1.5, 4.125]) + rng.random() * 1e-3 for _ in range(rng.randint(1, 14))])
        assert [(a, b) for a, b, _ in T.maximal_segments(s, np.flatnonzero(s > 0))] == brute(list(s))


def test_lambda_solves_its_equation():
    s, p = np.array([-1.0, 2.0]), np.array([0.8, 0.2])
    lam = T._solve_lambda(s, p)
    assert abs(float((p * np.exp(lam * s)).sum()) - 1) < 1e-9


def toxic_corpus(spark):
    rng, rows, labels = random.Random(4), [], []
    for i in range(700):
        words = sentence(rng, 60).split()
        toxic = i % 4 == 0
        if toxic:
            at = rng.randint(0, 50)
            words[at : at + 5] = [rng.choice(["vileword", "nastyword", "grimword"]) for _ in range(5)]
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((a, c) for a, _, c in labels)


def test_toxicity(spark):
    docs, labels, truth = toxic_corpus(spark)
    out = T.predictions(docs, labels).collect()
    held = [r for r in out if r["held_out"]]
    assert len(held) > 100 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.98
    model = T.fit(docs, labels)
    passages = T.score(with_clashes(docs, "score", "passages"), model).where("doc_id = 4").first()["passages"]
    assert len(passages) == 1 and passages[0]["end"] - passages[0]["first"] >= 3


def test_toxicity_without_labels_or_rows(spark):
    docs, labels, _ = toxic_corpus(spark)
    none = T.fit(docs, labels.where("false"))
    odd = frame(spark, [(None, None, None, None, None), (1, "", "en", "s", 1), (1, "  ", "en", "s", 1), (2, "w " * 30_000, "en", "s", 1)])
    assert len({r["score"] for r in T.score(odd, none).collect()}) == 1
    assert T.score(odd.where("false"), none).count() == 0
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one = {r["doc_id"]: r["score"] for r in T.predictions(docs, labels).collect()}
    assert one == {r["doc_id"]: r["score"] for r in T.predictions(docs.withColumn("source", F.lit("other")), flipped).collect()}


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(600):
        g = int(rng.integers(4))
        at = np.array([10, 20])
        value = np.array([g + rng.normal() * 0.3, rng.normal()])
        rows.append((at, value, np.zeros(Q.SHAPES)))
        y.append(g)
    m = Q.fit_ordinal(rows, np.array(y), [0, 1, 2, 3])
    assert (np.diff(m.thresholds) > 0).all() and m.weights[10] > 1
    expected = [m.tails(*r).sum() for r in rows]
    assert np.corrcoef(expected, y)[0, 1] > 0.9
    assert np.mean(np.round(expected) == y) > 0.8


def test_ordinal_gradient():
    rng = np.random.default_rng(1)
    rows = [(np.array([3]), np.array([rng.normal()]), np.zeros(Q.SHAPES)) for _ in range(50)]
    y = np.array([0, 1, 2, 1, 2] * 10)
    loss = lambda m: -np.mean([np.log(np.r_[1, m.tails(*r), 0][k] - np.r_[1, m.tails(*r), 0][k + 1]) for r, k in zip(rows, y)])
    assert loss(Q.fit_ordinal(rows, y, [0, 1, 2], steps=300)) < loss(Q.fit_ordinal(rows, y, [0, 1, 2], steps=1))


def test_quality(spark):
    rng, rows, labels = random.Random(6), [], []
    for i in range(500):
        good = i % 3 > 0
        text = sentence(rng, 50) + "." if good else " ".join(w.upper() + "!!" for w in sentence(rng, 20).split()) if i % 2 else "### " * 20
        rows.append((i, text, "en", "s", 1))
        labels.append((i, int(good), 0))
    docs, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = Q.fit(docs, lab)
    out = Q.select_documents(with_clashes(docs, "tail", "selected"), model).collect()
    assert np.mean([r["selected"] == (r["doc_id"] % 3 > 0) for r in out]) >= 0.98
    odd = frame(spark, [(None, None, None, None, None), (1, "", "en", "s", 1), (2, "w " * 30_000, "en", "s", 1)])
    assert Q.select_documents(odd, model).count() == 3 and Q.select_documents(odd.where("false"), model).count() == 0
    assert {r["expected_grade"] for r in Q.score(odd, Q.fit(docs, lab.where("false"))).collect()} == {0.0}
