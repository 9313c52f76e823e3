"""Connected components of an edge table, without gathering any component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialize


def _least(edges: DataFrame) -> DataFrame:
    """``(id, label)``: the smallest id among each id of ``edges(a, b)`` and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("label"))


def _flat(labels: DataFrame, max_rounds: int, scratch: Scratch, name: str) -> DataFrame:
    """Follow labels to the end of their chains, twice as far in each round. Ends are ids that label themselves."""
    for _ in range(max_rounds):
        jump = labels.where("label < id").select(F.col("id").alias("label"), F.col("label").alias("next"))
        moved = labels.join(jump, "label", "left").select("id", F.coalesce("next", "label").alias("label"), F.col("next").isNotNull().alias("moved"))
        moved = scratch.write(moved, name)
        labels = moved.select("id", "label")
        if moved.where("moved").isEmpty():
            return labels
    raise RuntimeError(f"labels did not settle in {max_rounds} rounds")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for each id of ``edges(a, b)``; a component is named by its smallest id.

    In each round an id takes the smallest label of its neighbours and labels are followed to the ends of their
    chains; then edges are drawn between ends alone, and those within one are gone. Each round at least halves the ids that
    still have edges. Only minima are aggregated (combined before the shuffle), so a hub with many neighbours is no
    larger a row than any other. Each round is written to the shared folder. No edges give an empty table.
    """
    scratch = Scratch(edges.sparkSession)
    edges = scratch.write(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    out = None
    for k in range(max_rounds):
        labels = _flat(scratch.write(_least(edges), f"labels{k}"), max_rounds, scratch, f"labels{k}")
        if out is None:
            out = labels
        else:
            step = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
            out = scratch.write(out.join(step, "label", "left").select("id", F.coalesce("next", "label").alias("label")), "joined")
        ends = [labels.select(F.col("id").alias(x), F.col("label").alias(f"end_{x}")) for x in ("a", "b")]
        drawn = edges.join(ends[0], "a").join(ends[1], "b").where("end_a <> end_b")
        edges = scratch.write(drawn.select(F.least("end_a", "end_b").alias("a"), F.greatest("end_a", "end_b").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = materialize(out.withColumnRenamed("label", "component"), "components")
    scratch.drop()
    return out
