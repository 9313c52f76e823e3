"""Joins over a code graph: hierarchy, enclosing intervals, tiered name resolution, imports, existence predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def hierarchy_counts(parent: DataFrame, child: DataFrame, on: tuple[str, str], by: list[str], name: str = "n") -> DataFrame:
    """Children counted for each parent, zero where there are none; the child is aggregated before the join."""
    left, right = on
    counts = child.groupBy(F.col(right).alias("_k")).agg(F.count(F.lit(1)).alias(name))
    out = parent.join(counts, F.col(left) == F.col("_k"), "left")
    return out.select(*by, F.coalesce(name, F.lit(0)).cast("long").alias(name))


def innermost(points: DataFrame, intervals: DataFrame, on: list[str], at: str, start: str, end: str, point_key: list[str], ties: list[Column], bucket: int | None = None) -> DataFrame:
    """For each point the smallest interval of the same ``on`` keys that holds it, if any.

    ``bucket`` cuts the axis into pieces: an interval is dealt to the pieces it covers and a point to its own, so that
    a key with many points and intervals is no single group. Leave it None where keys are small (lines of a file).
    """
    p, i, keys = points, intervals, list(on)
    if bucket:
        p = p.withColumn("_b", F.floor(F.col(at) / bucket))
        i = i.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
        keys.append("_b")
    found = p.join(i, keys).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end)))
    w = Window.partitionBy(*point_key).orderBy((F.col(end) - F.col(start)).asc(), *ties)
    return found.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_b")


def first_enclosing(points: DataFrame, intervals: DataFrame, on: list[str], at: str, start: str, end: str, point_key: list[str], order: list[Column]) -> DataFrame:
    """For each point the first interval (in a given order) that holds it: the outer type of a member."""
    found = points.join(intervals, on).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end)))
    w = Window.partitionBy(*point_key).orderBy(*order)
    return found.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Callees of ``calls(call_id, file, caller, name)``, one row a call: ``(call_id, caller, callee, confidence)``.

    Three tiers, the first with a candidate other than the caller wins: the last definition of the name in the same
    file (1.0), the last one in the first imported file that has it (0.7), the first one anywhere (0.4).
    ``symbols(file, name, fqname, ord)`` carry their walk order; ``imports(file, target, pos)`` theirs.

    A caller rules out one candidate of a tier at most, so a name needs two from the imports of a file and one from
    the other tiers. These are looked up for each file and name before the calls, the largest table, are joined.
    """
    by_file = symbols.groupBy("file", "name").agg(F.max_by("fqname", "ord").alias("callee"))
    anywhere = symbols.groupBy("name").agg(F.min_by("fqname", "ord").alias("loose"))
    away = imports.join(by_file.withColumnRenamed("file", "target"), "target").groupBy("file", "name", "callee").agg(F.min("pos").alias("pos"))
    away = away.withColumn("nth", F.row_number().over(Window.partitionBy("file", "name").orderBy("pos", "callee"))).where("nth <= 2")
    near = by_file.select("file", "name", "callee", F.lit(0).alias("nth")).unionByName(away.select("file", "name", "callee", "nth"))
    near = near.groupBy("file", "name").agg(*(F.max(F.when(F.col("nth") == n, F.col("callee"))).alias(c) for n, c in enumerate(("same", "first", "second"))))
    found = calls.join(near, ["file", "name"], "left").join(anywhere, "name", "left")
    tiers = (("same", 1.0), ("first", 0.7), ("second", 0.7), ("loose", 0.4))
    best = F.coalesce(*(F.when(F.col(c) != F.col("caller"), F.struct(F.col(c).alias("callee"), F.lit(sure).alias("confidence"))) for c, sure in tiers))
    return found.select("call_id", "caller", best.alias("b")).where("b is not null").select("call_id", "caller", "b.callee", "b.confidence")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports(file, name)`` to paths that exist: the first candidate path found wins (``candidate`` is its place)."""
    folder = F.regexp_replace(F.regexp_extract("file", r"^(.*)/[^/]*$", 1), "/$", "")
    cand = imports.select("file", "name", F.posexplode(T.import_candidates(F.col("name"), folder)).alias("candidate", "path"))
    hit = cand.join(files.select("path").distinct(), "path").where("path <> file")
    return hit.groupBy("file", "name").agg(F.min_by("path", "candidate").alias("target"), F.min("candidate").alias("candidate"))


def mentioned_or_unlinked(nodes: DataFrame, mentions: DataFrame, targets: DataFrame, symbols: DataFrame | None = None, keep_unlinked: bool = True) -> DataFrame:
    """Nodes with a mention of a wanted file or symbol, and if asked those without any mention.

    The mention table is reduced to one flag row for each node before the join.
    """
    wanted = targets.select(F.col("target"), F.lit(True).alias("_hit")).distinct()
    if symbols is not None:
        wanted = wanted.unionByName(symbols.select("target", F.lit(True).alias("_hit"))).distinct()
    flags = mentions.join(wanted, "target", "left").groupBy("node").agg(F.bool_or(F.coalesce("_hit", F.lit(False))).alias("_hit"))
    out = nodes.join(flags, "node", "left")
    keep = F.coalesce("_hit", F.lit(keep_unlinked))
    return out.where(keep).drop("_hit")


def merge_edges(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Edges ``(caller, callee, confidence)`` of both, the surest for each pair; the primary one on ties."""
    both = primary.withColumn("_o", F.lit(0)).unionByName(secondary.withColumn("_o", F.lit(1)))
    best = both.groupBy("caller", "callee").agg(F.max(F.struct("confidence", -F.col("_o"))).alias("b"))
    return best.select("caller", "callee", F.col("b.confidence").alias("confidence"))


def merge_overrides(drafts: DataFrame, overrides: DataFrame, key: str, order: str) -> DataFrame:
    """Overrides replace drafts of the same name whole; new names come after, in order of name."""
    value = [c for c in drafts.columns if c not in (key, order)]
    d = drafts.select(F.col(key).alias("_dk"), F.col(order).alias("_do"), F.struct(*value).alias("_d"))
    o = overrides.select(F.col(key).alias("_ok"), F.struct(*value).alias("_o"))
    both = d.join(o, F.col("_dk") == F.col("_ok"), "full_outer")
    picked = F.coalesce("_o", "_d")
    return both.select(
        F.coalesce("_ok", "_dk").alias(key), F.col("_do").alias(order), *(picked[c].alias(c) for c in value), F.col("_ok").isNotNull().alias("overridden")
    )


def census(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts for each kind and their share of all."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).cast("long").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))
