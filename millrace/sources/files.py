"""Source trees as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

SKIP_DIRS = (".git", ".hg", ".svn", ".venv", "venv", "node_modules", "target", "build", "dist", "out", "__pycache__", ".idea", ".gradle", ".mypy_cache", ".pytest_cache")


def walk(spark: SparkSession, root: str, repo: str, ignored: DataFrame | None = None) -> DataFrame:
    """``(repo, path, lang, content, hash, lines)`` of a tree's code, documents and manifests.

    Folders to skip are tested on the path below the root; ``ignored(path)`` are left out. Bytes that are no UTF-8 are
    replaced. Files without a known language are dropped.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root if "://" in root or root.startswith("file:") else f"file:{root}"), "/+$", "")
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), F.concat(F.lit("^\\Q"), F.regexp_replace(base, "^file:/+", "/"), F.lit("\\E/")), "")
    out = files.select(path.alias("path"), F.col("content").alias("_bytes"))
    out = out.where(~F.exists(F.split("path", "/"), lambda x: x.isin(*SKIP_DIRS)))
    out = out.withColumn("lang", T.language(F.col("path"))).where("lang <> 'other'")
    if ignored is not None:
        out = out.join(ignored.select("path"), "path", "left_anti")
    content = F.try_validate_utf8(F.col("_bytes").cast("string"))
    content = F.coalesce(content, F.make_valid_utf8(F.col("_bytes").cast("string")))
    return out.select(F.lit(repo).alias("repo"), "path", "lang", content.alias("content"), F.sha2("_bytes", 256).alias("hash")).withColumn("lines", T.line_count(F.col("content")))


def pack(files: DataFrame) -> DataFrame:
    """One row ``(repo, pack, sha)``: all files in order of path under headings, and the digest of that text."""
    section = F.concat(F.lit("## File: "), F.col("path"), F.lit("\n"), F.col("content"), F.lit("\n"))
    parts = files.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("path", section.alias("s")))).alias("_s"))
    return parts.select("repo", F.array_join(F.col("_s.s"), "\n").alias("pack")).withColumn("sha", F.sha2("pack", 256))


def digest(files: DataFrame) -> DataFrame:
    """``(repo, sha)`` from paths and hashes alone: whether anything changed, without the texts."""
    w = F.array_sort(F.collect_list(F.concat_ws(":", "path", "hash")))
    return files.groupBy("repo").agg(F.sha2(F.array_join(w, "\n"), 256).alias("sha"))


def expand_globs(globs: DataFrame, files: DataFrame) -> DataFrame:
    """``globs(service, glob)`` to the files they match; ``**`` crosses folders, ``*`` and ``?`` do not."""
    escaped = F.regexp_replace("glob", r"([.+^$(){}|\[\]\\])", r"\\$1")
    for sign, to in ((r"\*\*/", "\x01"), (r"\*\*", "\x02"), (r"\*", "[^/]*"), (r"\?", "[^/]"), ("\x01", "(?:.*/)?"), ("\x02", ".*")):
        escaped = F.regexp_replace(escaped, sign, to)
    pattern = globs.select("service", F.concat(F.lit("^"), escaped, F.lit("$")).alias("_re"))
    if pattern.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 globs")
    return files.select("path").join(F.broadcast(pattern), F.expr("path rlike _re")).select("service", "path").distinct()


def valid_paths(drafts: DataFrame, files: DataFrame) -> DataFrame:
    """``drafts(service, path)`` that name a known file inside the tree, once ``./`` and doubled slashes are dropped."""
    path = F.regexp_replace(F.regexp_replace(F.trim("path"), r"^(?:\./)+", ""), "/+", "/")
    out = drafts.withColumn("path", path).where(~F.col("path").startswith("/") & ~F.array_contains(F.split("path", "/"), ".."))
    return out.join(files.select("path"), "path", "left_semi").select(*drafts.columns).distinct()


def newest(df: DataFrame, keep: int, by: list[str], stamp: str) -> DataFrame:
    """The ``keep`` newest rows of each group."""
    w = Window.partitionBy(*by).orderBy(F.desc(stamp))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")
