"""Full and incremental ingest of source trees, and streams of changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import chunk, delta, graph
from ..sources import files as files_source
from ..sources import parsers, providers
from ..sources.store import Store


def tables_of(files: DataFrame, known_symbols: DataFrame | None = None, known_files: DataFrame | None = None, store: Store | None = None) -> dict[str, DataFrame]:
    """Every derived table of ``files(repo, path, lang, content, hash, lines)``.

    ``known_*`` are rows of files that did not change, so that calls and imports into them resolve as well. With a
    store the parsed rows are written there once instead of being parsed for each table.
    """
    parsed = parsers.parse(files)
    if store is not None:
        parsed = store.scratch("parsed", parsed)
    symbols = parsers.symbols(parsed)
    own = symbols.select("repo", F.col("file_path").alias("file"), "name", "fqname", F.concat_ws(" ", "file_path", F.lpad(F.col("ord").cast("string"), 6, "0")).alias("ord"), "line_start", "line_end")
    walk = own.select("repo", "file", "name", "fqname", "ord")
    if known_symbols is not None:
        known = known_symbols.select("repo", F.col("file_path").alias("file"), T.terminal_name(F.col("fqname")).alias("name"), "fqname", F.concat_ws(" ", "file_path", F.lpad(F.col("line_start").cast("string"), 6, "0")).alias("ord"))
        walk = walk.unionByName(known)
    paths = files.select("path")
    if known_files is not None:
        paths = paths.unionByName(known_files.select("path")).distinct()
    names = parsers.imports(parsed)
    targets = graph.resolve_imports(names.select("file", "name"), paths)
    edges = names.join(targets, ["file", "name"]).select("repo", "file", "target", "pos")
    sites = parsers.call_sites(parsed)
    inside = graph.innermost(
        sites.withColumnRenamed("name", "called"), own.withColumnsRenamed({"name": "own_name", "ord": "own_ord"}), ["repo", "file"], "line", "line_start", "line_end", ["call_id"], [F.col("own_ord").asc()]
    )
    calls = inside.select("call_id", "file", F.col("fqname").alias("caller"), F.col("called").alias("name"))
    resolved = graph.resolve_calls(calls, walk.drop("repo"), edges.select("file", "target", "pos"))
    call_edges = resolved.groupBy("caller", "callee").agg(F.max("confidence").alias("confidence"))
    ok = files.join(parsed.select("repo", "path", "parse_error"), ["repo", "path"])
    pieces = chunk.chunk_lines(ok.where(chunk.eligible(F.col("path"), F.col("content"), F.col("parse_error"))).select("repo", F.col("path").alias("file_path"), F.col("content").alias("text")), "text")
    chunks = pieces.select(T.chunk_id(F.col("repo"), F.col("file_path"), F.col("idx")).alias("id"), "repo", "file_path", "idx", F.col("chunk").alias("text"), T.token_count(F.col("chunk")).alias("token_count"), "line_start", "line_end")
    repo = F.first("repo").alias("repo")
    return {
        "file": ok.select("repo", "path", "hash", "lang", "lines", "parse_error", F.current_timestamp().alias("indexed_at")),
        "symbol": symbols.withColumn("doc_first_line", F.lit("")).drop("ord"),
        "import_edge": edges.select("repo", F.col("file").alias("from_path"), F.col("target").alias("to_path")).distinct(),
        "call_edge": call_edges.join(own.select(F.col("fqname").alias("caller"), "repo").groupBy("caller").agg(repo), "caller"),
        "chunk": providers.embed(chunks, "text", "embed_vec"),
        "merkle_files": files.select("repo", "path", "hash", F.current_timestamp().alias("last_indexed")),
    }


def apply_changes(store: Store, repo: str, files: DataFrame, removed: DataFrame) -> dict[str, int]:
    """Write changed files and drop removed ones: rows of touched files go, new rows come; summaries of symbols that
    stay are carried over. All tables are computed before the first is replaced, since they read one another."""
    touched = files.select("path").unionByName(removed.select("path")).distinct()
    known_symbols = store.read("symbol").where(F.col("repo") == repo).join(touched.withColumnRenamed("path", "file_path"), "file_path", "left_anti")
    known_files = store.read("file").where(F.col("repo") == repo).join(touched, "path", "left_anti")
    new = tables_of(files, known_symbols, known_files, store)
    before = store.read("symbol").select("repo", "fqname", F.col("summary").alias("_s"), F.col("summary_at").alias("_at"))
    new["symbol"] = new["symbol"].join(before, ["repo", "fqname"], "left").withColumnsRenamed({"_s": "summary", "_at": "summary_at"})
    parent = {"file": "path", "symbol": "file_path", "chunk": "file_path", "import_edge": "from_path", "merkle_files": "path"}
    counts, ready = {}, {}
    for table in ("file", "symbol", "chunk", "import_edge", "call_edge", "merkle_files"):
        old = store.read(table)
        if table == "call_edge":
            keep = _edges_kept(old, repo, touched, new["symbol"])
        else:
            other = old.where(~F.col("repo").eqNullSafe(repo))
            mine = old.where(F.col("repo") == repo).join(touched.withColumnRenamed("path", parent[table]), parent[table], "left_anti")
            keep = other.unionByName(mine)
        rows = new[table]
        for c in old.columns:
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast(old.schema[c].dataType))
        rows = rows.select(*(F.col(c).cast(old.schema[c].dataType).alias(c) for c in old.columns))
        ready[table] = store.scratch(table, keep.select(*old.columns).unionByName(rows))
    for table, rows in ready.items():
        store.write(table, rows)
        counts[table] = rows.where(F.col("repo") == repo).count()
    return counts


def _edges_kept(old: DataFrame, repo: str, touched: DataFrame, parsed: DataFrame) -> DataFrame:
    """Call edges that a change leaves: those of other projects, and of this one those whose caller's file is not
    touched and whose callee's file is not touched either or still has that symbol."""
    mine = F.col("repo").eqNullSafe(repo)
    paths = touched.select(F.col("path").alias("_f"))
    stay = old.where(mine).withColumn("_f", F.element_at(F.split("caller", "::"), 1)).join(paths, "_f", "left_anti")
    stay = stay.withColumn("_f", F.element_at(F.split("callee", "::"), 1))
    known = parsed.where(mine).select(F.col("fqname").alias("callee")).distinct()
    there = stay.join(paths, "_f", "left_semi").join(known, "callee", "left_semi")
    kept = stay.join(paths, "_f", "left_anti").select(*old.columns).unionByName(there.select(*old.columns))
    return old.where(~mine).unionByName(kept)


def ingest(store: Store, repo: str, root: str, force: bool = False) -> dict:
    """Bring a tree's tables up to date. Nothing is done when its digest is unchanged; else only files whose hash
    changed are parsed again."""
    found = files_source.walk(store.spark, root, repo).cache()
    try:
        return _ingest(store, repo, found, force)
    finally:  # else a later walk of the same tree would see these files
        found.unpersist()


def _ingest(store: Store, repo: str, found: DataFrame, force: bool) -> dict:
    spark = store.spark
    sha = files_source.digest(found).first()
    sha = sha["sha"] if sha else ""
    known = store.read("merkle_repo").where(F.col("repo") == repo).first()
    if known and known["pack_sha"] == sha and not force:
        return {"changed": False}
    prev = store.read("merkle_files").where(F.col("repo") == repo).select("path", "hash")
    diff = delta.snapshot_diff(prev, found.select("path", "hash"))
    # Written out: the snapshot that the difference was taken from is replaced on the way, and every table below reads
    # these rows.
    touched = found if force else found.join(delta.to_index(diff), "path", "left_semi").select(*found.columns)
    changed = store.scratch("changed", touched)
    n = {r["change"]: r["n"] for r in diff.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
    gone = [r["path"] for r in diff.where("change = 'deleted'").select("path").collect()]
    counts = apply_changes(store, repo, changed, spark.createDataFrame([(p,) for p in gone], "path string"))
    row = spark.createDataFrame([(repo, sha)], "repo string, pack_sha string").withColumn("last_packed", F.current_timestamp())
    store.upsert("merkle_repo", row)
    return {"changed": True, "changes": n, "rows": counts}


def stream_upserts(source: DataFrame, store: Store, table: str, checkpoint: str, key: list[str], order: str, once: bool = True, every: str = "10 seconds") -> StreamingQuery:
    """Keep a table at the newest row of each key of a stream by ``order``, within a batch and across batches: a late
    row changes nothing. A row with the stored row's ``order`` replaces it, so a repeated batch gives the same table."""

    def batch(rows: DataFrame, _: int) -> None:
        newest = delta.last_write(rows, key, [F.col(order)])
        stored = store.read(table).select(*key, F.col(order).alias("_stored"))
        newest = newest.join(stored, key, "left").where(F.col("_stored").isNull() | (F.col(order) >= F.col("_stored")))
        store.upsert(table, newest.drop("_stored"))

    writer = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def activity(events: DataFrame, window: str = "1 hour", late: str = "2 hours", stamp: str = "ts", kind: str = "event_type") -> DataFrame:
    """Counts of events in windows of time; works on a stream (late rows are dropped behind the watermark) and on a
    table."""
    rows = events.withWatermark(stamp, late) if events.isStreaming else events
    return rows.groupBy(F.window(stamp, window).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def on_schedule(spark: SparkSession, jobs: dict[str, Callable[[], dict]]) -> DataFrame:
    """Run jobs in turn and journal them: ``(repo, ok, error)``; one that fails does not stop the others."""
    out = []
    for name, job in jobs.items():
        try:
            job()
            out.append((name, True, None))
        except Exception as e:
            out.append((name, False, f"{type(e).__name__}: {str(e)[:200]}"))
    return spark.createDataFrame(out, "repo string, ok boolean, error string")
