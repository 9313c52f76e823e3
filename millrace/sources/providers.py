"""Embedders, rerankers and summarizers behind one interface, with deterministic ones that need no service."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def hashing_embedding(text: Column, dim: int = 64) -> Column:
    """Signed counts of hashed lower-case words, at unit length: an embedding from built-in functions alone."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def slot(k: Column) -> Column:
        return F.aggregate(hashed, F.lit(0.0), lambda a, h: a + F.when(F.pmod(h, F.lit(dim)) == k, F.when(h < 0, -1.0).otherwise(1.0)).otherwise(0.0))

    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), slot)

    def unit(v: Column) -> Column:
        size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(0.0).cast("float"))

    return F.transform(F.array(raw), unit)[0]


def embed(df: DataFrame, text: str, out: str, provider: Callable[[list[str]], list[list[float]]] | None = None, dim: int = 64) -> DataFrame:
    """A vector column: from a batch provider (in Arrow batches) or from hashed words."""
    if provider is None:
        return df.withColumn(out, hashing_embedding(F.coalesce(F.col(text), F.lit("")), dim))

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(provider(texts.fillna("").tolist()), dtype=object)

    return df.withColumn(out, vectors(F.col(text)))


def summarize(df: DataFrame, text: str, out: str, provider: Callable[[str], str] | None = None) -> DataFrame:
    """A summary column. A provider that fails leaves null, so that an earlier summary can be kept; without one the
    first line is the summary."""
    if provider is None:
        return df.withColumn(out, F.substring(F.trim(F.get(T.lines(F.col(text)), 0)), 1, 200))

    @F.pandas_udf("string")
    def answers(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return provider(t)
            except Exception:
                return None

        return texts.map(one)

    return df.withColumn(out, answers(F.col(text)))
