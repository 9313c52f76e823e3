"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, with DataFrame operations only.

A document's key hashes to one of ``SLOTS`` slots of a ring, and goes to the shard of the first virtual node at or
after its slot. Shards are bounded: a key that finds its shard full continues clockwise. The bound here is the tight
one, the mean number of rows rounded up or down, so row counts differ by at most one. Which ranks of a slot go where
follows from the slots' counts alone, a table of fixed size, and so does each document's place in its shard.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS, NODES = 8192, 32


def ring(spark: SparkSession, shards: int, nodes: int = NODES, slots: int = SLOTS) -> list[tuple[int, int]]:
    """The virtual nodes as ``(slot, shard)`` in clockwise order; ``shards * nodes`` of them."""
    node = spark.range(shards * nodes).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("node"))
    place = F.xxhash64(F.lit("node"), "shard", "node")
    rows = node.select(F.pmod(place, F.lit(slots)).alias("slot"), place.alias("place"), "shard").collect()
    return [(r["slot"], r["shard"]) for r in sorted(rows, key=lambda r: (r["slot"], r["place"], r["shard"]))]


def flow(counts: dict[int, int], nodes: list[tuple[int, int]], capacity: list[int]) -> list[dict]:
    """Where the ranks of each slot go when no shard holds more than its capacity (their sum must suffice).

    Rounds: in each, what is pending at a node fills its shard in ring order, and the rest moves one node on.
    """
    if sum(capacity) < sum(counts.values()):
        raise ValueError("capacities are below the number of rows")
    free, out, used = list(capacity), [], [0] * len(capacity)
    at, pending = 0, []
    for slot in sorted(counts):
        while at < len(nodes) and nodes[at][0] < slot:
            at += 1
        pending.append((slot, 0, counts[slot], at % len(nodes)))
    while pending:
        moved = []
        for slot, lo, hi, v in pending:
            shard = nodes[v][1]
            take = min(free[shard], hi - lo)
            if take:
                out.append({"s": slot, "lo": lo, "hi": lo + take, "shard": shard, "at": used[shard]})
                free[shard] -= take
                used[shard] += take
            if lo + take < hi:
                moved.append((slot, lo + take, hi, (v + 1) % len(nodes)))
        pending = moved
    return out


def row_capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def shard(docs: DataFrame, shards: int, text: str = "text") -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes and 16), ``text_crc32``, ``shard`` and ``slot`` (its place there) added.

    The key is the id with the text's checksum, so that one id on many rows does not make one slot large; rows that are
    equal in both are interchangeable. A null text has no bytes and a null id is a key of its own. An empty table
    gives an empty table; columns of the names added are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("size", "text_crc32", "shard", "slot", "_h", "_slot", "_rank", "_runs", "_run", "_of")
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumn("size", (F.octet_length(body) + 16).cast("long")).withColumn("text_crc32", F.crc32(body.cast("binary")))
    keyed = keyed.withColumn("_h", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_crc32"))
    keyed = keyed.withColumn("_slot", F.pmod(F.col("_h"), F.lit(SLOTS)).cast("int"))
    counts = {r["_slot"]: r["n"] for r in keyed.groupBy("_slot").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = flow(counts, ring(spark, shards), row_capacities(sum(counts.values()), shards))
    kind = "array<struct<s:int,lo:bigint,hi:bigint,shard:int,at:bigint>>"
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(runs)), kind))).withColumnRenamed("s", "_of")
    table = table.groupBy("_of").agg(F.collect_list(F.struct("lo", "hi", "shard", "at")).alias("_runs"))
    w = Window.partitionBy("_slot").orderBy("_h", "doc_id", "text_crc32", "size")
    ranked = keyed.withColumn("_rank", F.row_number().over(w) - 1)
    # At most SLOTS rows of a few runs each.
    placed = ranked.join(F.broadcast(table), F.col("_slot") == F.col("_of"))
    run = F.filter("_runs", lambda r: (r["lo"] <= F.col("_rank")) & (F.col("_rank") < r["hi"]))[0]
    placed = placed.withColumn("_run", run)
    placed = placed.withColumn("shard", F.col("_run.shard")).withColumn("slot", F.col("_run.at") + F.col("_rank") - F.col("_run.lo"))
    return placed.drop("_h", "_slot", "_rank", "_runs", "_run", "_of")
