"""Links between projects from overlapping evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import evidence as E

MOST_EVIDENCE = 10


def scan(chunks: DataFrame, repo: str = "repo", text: str = "text") -> DataFrame:
    """Distinct ``(repo, channel, token)`` of all chunks."""
    per = [F.transform(E.tokens(F.coalesce(F.col(text), F.lit("")), c), _tagged(c)) for c in E.PATTERNS]
    rows = chunks.select(F.col(repo).alias("repo"), F.explode(F.flatten(F.array(*per))).alias("e"))
    return rows.select("repo", "e.channel", "e.token").distinct()


def _tagged(channel: str):
    return lambda x: F.struct(F.lit(channel).alias("channel"), x.alias("token"))


def overlap_edges(emits: DataFrame, consumes: DataFrame, via: str) -> DataFrame:
    """``(src, dst, via, evidence, n, confidence)`` for each emitter and other consumer that share tokens.

    Both sides are distinct ``(repo, token)``. Confidence is the overlap by the size of the emitter's set.
    """
    sizes = emits.groupBy("repo").agg(F.count(F.lit(1)).alias("size"))
    pairs = emits.select(F.col("repo").alias("src"), "token").join(consumes.select(F.col("repo").alias("dst"), "token"), "token").where("src <> dst")
    return _edges(pairs, via).join(sizes.withColumnRenamed("repo", "src"), "src").transform(_confident)


def shared_edges(sets: DataFrame, via: str = "shared_collection") -> DataFrame:
    """The same for one set a side, once for each pair (smaller name first); confidence is overlap by union."""
    sizes = sets.groupBy("repo").agg(F.count(F.lit(1)).alias("size"))
    pairs = sets.select(F.col("repo").alias("src"), "token").join(sets.select(F.col("repo").alias("dst"), "token"), "token").where("src < dst")
    e = _edges(pairs, via)
    e = e.join(sizes.select(F.col("repo").alias("src"), F.col("size").alias("_a")), "src").join(sizes.select(F.col("repo").alias("dst"), F.col("size").alias("_b")), "dst")
    return _confident(e.withColumn("size", F.col("_a") + F.col("_b") - F.col("n")).drop("_a", "_b"))


def _edges(pairs: DataFrame, via: str) -> DataFrame:
    # Numbered in a sort that spills: of a pair with many shared tokens only the first few are gathered.
    numbered = pairs.select("src", "dst", "token", F.row_number().over(Window.partitionBy("src", "dst").orderBy("token")).alias("_r"))
    first = F.collect_list(F.when(F.col("_r") <= MOST_EVIDENCE, F.col("token")))
    grouped = numbered.groupBy("src", "dst").agg(F.array_sort(first).alias("evidence"), F.max("_r").cast("long").alias("n"))
    return grouped.withColumn("via", F.lit(via))


def _confident(e: DataFrame) -> DataFrame:
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("n") / F.greatest(F.col("size"), F.lit(1))))
    return e.select("src", "dst", "via", "evidence", "n", F.round(share, 6).alias("confidence"))


def link_projects(chunks: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """All edges between the projects of ``chunks(repo, text)`` at or above a confidence."""
    found = scan(chunks)
    of = lambda c: found.where(F.col("channel") == c).select("repo", "token")
    edges = overlap_edges(of("http_emits"), of("http_consumes"), "http")
    edges = edges.unionByName(overlap_edges(of("nats_emits"), of("nats_consumes"), "nats")).unionByName(shared_edges(of("collections")))
    return edges.where(F.col("confidence") >= min_confidence)


def edges_of(edges: DataFrame, repo: str, most: int | None = None) -> DataFrame:
    """Edges at either end of a project, surest first."""
    out = edges.where((F.col("src") == repo) | (F.col("dst") == repo)).orderBy(F.desc("confidence"), "src", "dst")
    return out.limit(most) if most else out
