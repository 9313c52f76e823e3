"""Memory nodes: decisions, observations, notes and documents of a project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import delta, graph, search

LABELS = ("Decision", "Observation", "Note", "Doc")


def check_label(label: str) -> str:
    if label not in LABELS:
        raise ValueError(f"unknown label {label!r}; one of {', '.join(LABELS)}")
    return label


def remember(memory: DataFrame, rows: DataFrame) -> DataFrame:
    """Upsert by id; ``created_at`` stays as first written. A row that supersedes another turns its status."""
    out = delta.upsert(memory, rows.drop("supersedes", "refs").select(*memory.columns), ["id"], create_only=("created_at",))
    return supersede(out, rows.where("supersedes is not null").select(F.col("supersedes").alias("id"))) if "supersedes" in rows.columns else out


def supersede(memory: DataFrame, old_ids: DataFrame) -> DataFrame:
    flagged = memory.join(old_ids.select("id").distinct().withColumn("_s", F.lit(True)), "id", "left")
    return flagged.withColumn("status", F.when(F.col("_s"), F.lit("superseded")).otherwise(F.col("status"))).drop("_s").select(*memory.columns)


def mentions(rows: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(node, kind, target)`` for each ref that names a known symbol (it holds ``::``) or file; blanks are skipped."""
    refs = rows.select(F.col("id").alias("node"), F.explode(F.transform("refs", lambda x: F.trim(x))).alias("target")).where("target <> ''").distinct()
    to_symbol = refs.where(F.col("target").contains("::")).join(symbols.select(F.col("fqname").alias("target")).distinct(), "target", "left_semi")
    to_file = refs.where(~F.col("target").contains("::")).join(files.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    return to_symbol.withColumn("kind", F.lit("symbol")).unionByName(to_file.withColumn("kind", F.lit("file"))).select("node", "kind", "target")


def forget(memory: DataFrame, id: str, repo: str, label: str) -> DataFrame:
    check_label(label)
    return memory.where(~((F.col("id") == id) & (F.col("repo") == repo) & (F.col("label") == label)))


def list_memory(memory: DataFrame, repo: str, label: str | None = None, most: int = 50) -> DataFrame:
    """Newest first, undated last; ties by id."""
    out = memory.where(F.col("repo") == repo)
    if label is not None:
        out = out.where(F.col("label") == check_label(label))
    return out.orderBy(F.desc_nulls_last("created_at"), F.asc("id")).limit(most)


def recall(memory: DataFrame, repo: str, query_vec: Column, k: int) -> DataFrame:
    rows = memory.where((F.col("label") == "Observation") & (F.col("repo") == repo))
    return search.vector_topk(rows, query_vec, k, id="id", vector="embed_vec")


def decisions_for(memory: DataFrame, links: DataFrame, targets: DataFrame, most: int = 5) -> DataFrame:
    """Active or superseded decisions about the wanted files or symbols, or about nothing in particular."""
    nodes = memory.where("label = 'Decision' and status in ('active', 'superseded')").withColumnRenamed("id", "node")
    return graph.mentioned_or_unlinked(nodes, links, targets).orderBy(F.desc_nulls_last("created_at"), "node").limit(most)


def observations_for(memory: DataFrame, links: DataFrame, targets: DataFrame, most: int = 5) -> DataFrame:
    nodes = memory.where("label = 'Observation'").withColumnRenamed("id", "node")
    return graph.mentioned_or_unlinked(nodes, links, targets, keep_unlinked=False).orderBy(F.desc_nulls_last("created_at"), "node").limit(most)
