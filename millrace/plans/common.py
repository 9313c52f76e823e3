"""Shared helpers of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = tuple[Callable[[SparkSession, str], DataFrame], str | None]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> Column:
    """One stored vector as a literal: the query of a search."""
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return F.array(*(F.lit(float(x)) for x in row[0])) if row else F.array().cast("array<double>")
