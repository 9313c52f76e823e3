"""Retrieval metrics: ranks of the first expected hit, recall, reciprocal rank and latency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def first_hits(probes: DataFrame, results: DataFrame, expected: DataFrame, symbols: bool = False) -> DataFrame:
    """``(probe, rank)``: the rank from 1 of the first expected result, -1 if none is found.

    Files match exactly. Symbols also match where the result ends in the last name of the expected one, which is
    an equality of last names and so an equi-join.
    """
    hits = results.join(expected.select("probe", F.col("doc")), ["probe", "doc"]).select("probe", "rank")
    if symbols:
        name = T.terminal_name(F.col("doc"))
        loose = results.withColumn("_t", name).join(expected.select("probe", name.alias("_t")).distinct(), ["probe", "_t"]).select("probe", "rank")
        hits = hits.unionByName(loose)
    best = hits.groupBy("probe").agg(F.min("rank").alias("rank"))
    return probes.select("probe").join(best, "probe", "left").select("probe", F.coalesce("rank", F.lit(-1)).cast("int").alias("rank"))


def metrics(ranks: DataFrame) -> DataFrame:
    """Recall at 1, 5 and 10 and the mean reciprocal rank over all probes; zeros without probes."""
    hit = lambda k: F.coalesce(F.avg(F.when(F.col("rank").between(1, k), 1.0).otherwise(0.0)), F.lit(0.0))
    mrr = F.coalesce(F.avg(F.when(F.col("rank") > 0, 1.0 / F.col("rank")).otherwise(0.0)), F.lit(0.0))
    return ranks.agg(
        F.count(F.lit(1)).cast("long").alias("n"), *(F.round(hit(k), 6).alias(f"recall_{k}") for k in (1, 5, 10)), F.round(mrr, 6).alias("mrr")
    )


def latency(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Upper median, 95th percentile (elements, not interpolated) and mean of each group."""
    w = Window.partitionBy(*by).orderBy(value)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    d = df.select(*by, F.col(value).alias("_v")).withColumn("_i", F.row_number().over(w.orderBy("_v")) - 1).withColumn("_n", n)
    p95 = F.greatest(F.lit(0), F.floor(F.col("_n") * 0.95) - 1)
    return d.groupBy(*by).agg(
        F.max(F.when(F.col("_i") == F.floor(F.col("_n") / 2), F.col("_v"))).alias("p50"),
        F.max(F.when(F.col("_i") == p95, F.col("_v"))).alias("p95"),
        F.round(F.avg("_v"), 6).alias("mean"),
    )
