"""Retrieval: vector and full-text rankings, fusion, priors and graph expansion, for one query or many at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V

#: Query vectors that are broadcast at once.
QUERY_BLOCK = 5_000
#: Numbers of a product that a task holds at once.
CELLS = 1 << 19
#: Ids of a hop that the driver holds.
HELD = 100_000
RRF_K, HEAD, CANDIDATES, EXPAND_FROM, NEIGHBOURS = 60, 30, 40, 5, 20


def vector_topk(vectors: DataFrame, query: Column, k: int, where: Column | None = None, post_filter: bool = False, id: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """The ``k`` rows most similar to a literal query vector, with ``score``; ties by id.

    ``where`` restricts the rows before the ranking; with ``post_filter`` after it, so that fewer than k may come back.
    """
    rows = vectors if where is None or post_filter else vectors.where(where)
    rows = rows.withColumn("score", F.round(V.cosine(F.col(vector), query), digits)).where("score is not null")
    top = rows.orderBy(F.desc("score"), F.asc(id)).limit(k)
    return top.where(where) if where is not None and post_filter else top


def _units(vectors: pa.Array, width: int) -> np.ndarray:
    """Unit vectors as rows; those of another width, zero, null or with a component that is no finite number are NaN."""
    out = np.full((len(vectors), width), np.nan)
    right = [i for i, n in enumerate(vectors.value_lengths().to_pylist()) if n == width]
    if right and width:
        flat = vectors.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False)
        x = np.asarray(flat, dtype=np.float64).reshape(-1, width)
        with np.errstate(all="ignore"):
            x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        out[right] = np.where(np.isfinite(x).all(axis=1, keepdims=True), x, np.nan)
    return out


def vector_topk_batch(vectors: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding", within: str | None = None) -> DataFrame:
    """Top k for each row of ``queries(query_id, query_vec)``: ``(query_id, id, score, rank)``, ties by id.

    ``within`` names a column that must be equal on both sides. Queries go to the tasks in blocks of about
    ``QUERY_BLOCK``; a task multiplies some vectors with some of a block, about ``CELLS`` products at once, and passes on
    each query's best k of them, no more in ties, so that its memory depends on neither table. Vectors that are null,
    zero, of another length or not finite have no score.
    """
    q = queries.select("query_id", "query_vec", *([F.col(within).alias("_q")] if within else []))
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    q = q.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    rows = vectors.select(id, vector, *([F.col(within).alias("_q")] if within else []))
    fields = [f"query_id {q.schema['query_id'].dataType.simpleString()}", f"`{id}` {rows.schema[id].dataType.simpleString()}", "score double"]
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id))
    out = None
    for block in range(blocks):
        part = q.where(F.col("_block") == block).toArrow().combine_chunks()
        if part.num_rows:
            top = rows.mapInArrow(_best_of(rows.sparkSession.sparkContext.broadcast(part), k), ", ".join(fields))
            out = top if out is None else out.unionByName(top)
    if out is None:
        out = rows.sparkSession.createDataFrame([], ", ".join(fields))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best_of(block, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best ``k`` rows of each batch for every query of a broadcast block."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.Table.from_batches(block.value.to_batches()).combine_chunks()
        ids, given = asked.column("query_id").combine_chunks(), asked.column("query_vec").combine_chunks()
        label = asked.column("_q").to_pylist() if "_q" in asked.column_names else None
        lengths = np.array([n or 0 for n in given.value_lengths().to_pylist()])
        widths = [(n, np.flatnonzero(lengths == n)) for n in np.unique(lengths[lengths > 0]).tolist()]
        units = {n: _units(given.take(pa.array(at)), n) for n, at in widths}
        step = max(1000, CELLS // max((n for n, _ in widths), default=1))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                some = batch.slice(start, step)
                some = some.take(pc.array_sort_indices(some.column(0), null_placement="at_start"))  # so the first of a tie is the one to keep
                mine = some.column(2).to_pylist() if label is not None else None
                for width, at in widths:
                    given = _units(some.column(1), width)
                    for rows, cols in [(np.arange(len(given)), at)] if label is None else _alike(mine, label, at):
                        tile = max(1, CELLS // len(rows))
                        for c in range(0, len(cols), tile):
                            j, i, score = _largest(units[width][np.searchsorted(at, cols[c : c + tile])] @ given[rows].T, k)
                            yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[c + j])), some.column(0).take(pa.array(rows[i])), pa.array(score)], names=["query_id", some.schema.names[0], "score"])

    return best


def _alike(mine: list, label: list, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``mine``, and those of ``at``, of each label that both sides have; null is like nothing."""
    places = [{}, {}]
    for group, of in zip(places, (enumerate(mine), ((j, label[j]) for j in at.tolist())), strict=True):
        for place, value in of:
            if value is not None:
                group.setdefault(value, []).append(place)
    yield from ((np.array(rows), np.array(places[1][value])) for value, rows in places[0].items() if value in places[1])


def _largest(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the ``k`` largest numbers of each row, rounded; the first columns of a tie."""
    score = np.round(score, 6)
    score[np.isnan(score)] = -np.inf
    if score.shape[1] > k:
        least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k, None]
        keep = score >= least
        many = np.flatnonzero(keep.sum(axis=1) > k)
        if len(many):
            above, tied = score[many] > least[many], score[many] == least[many]
            keep[many] = above | (tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= k - above.sum(axis=1, keepdims=True)))
    else:
        keep = np.ones(score.shape, dtype=bool)
    j, i = np.nonzero(keep & (score > -np.inf))
    return j, i, score[j, i]


def best_per_file(hits: DataFrame, file: str, score: str = "score", rank: str = "rank") -> DataFrame:
    """Files in order of their best hit, with that hit's score."""
    return hits.groupBy(file).agg(F.max(score).alias("score"), F.min(rank).alias("rank"))


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), "")


def postings(docs: DataFrame, id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``(id, term, tf)`` and ``(id, dl)`` of lower-cased words; one pass each, combined before the shuffle."""
    words = docs.select(id, F.explode(_words(text)).alias("term"))
    sizes = docs.select(id, F.size(_words(text)).alias("dl"))
    return words.groupBy(id, "term").agg(F.count(F.lit(1)).alias("tf")), sizes


def bm25(docs: DataFrame, terms: list[str], k: int, id: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The ``k`` documents that rank best for any of ``terms``; ties by id.

    Only postings of the asked terms are built: the terms are counted inside each text, so a query reads the table
    once and shuffles a row for each term, not for each word.
    """
    # Behind an explode of one element the optimizer can't repeat the split for each use of the words.
    base = docs.select(id, F.explode(F.array(_words(text))).alias("_w"))
    tf = [(F.size("_w") - F.size(F.array_remove("_w", t))).alias(f"tf{i}") for i, t in enumerate(terms)]
    counted = base.select(id, F.size("_w").alias("dl"), *tf)
    stats = counted.agg(
        F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms)))
    )
    rows = counted.join(F.broadcast(stats))
    total = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        total = total + idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return rows.where(total > 0).select(id, F.round(total, 6).alias("score")).orderBy(F.desc("score"), F.asc(id)).limit(k)


def fulltext_symbols(symbols: DataFrame, terms: list[str], k: int) -> DataFrame:
    """``(fqname, file_path, score, rank)``: the ``k`` symbols whose name, signature, first line of documentation or
    summary match ``terms`` best. Names count whole and by their parts."""
    name = T.terminal_name(F.col("fqname"))
    have = [F.col(c) for c in ("signature", "doc_first_line", "summary") if c in symbols.columns]
    said = F.concat_ws(" ", "fqname", F.regexp_replace(name, f"{T.CAMEL_EDGE}|_", " "), *have)
    keyed = symbols.select(F.struct("fqname", "file_path").alias("_key"), said.alias("_said"))
    hits = bm25(keyed, terms, k, id="_key", text="_said").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc("_key"))))
    return hits.select("_key.fqname", "_key.file_path", "score", "rank")


def short(df: DataFrame, most: int = 1000) -> DataFrame:
    """A result of a few rows, computed once for all its uses; one of more than ``most`` is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows in a list that ought to be short")
    return df.sparkSession.createDataFrame(rows, df.schema)


def ranked(df: DataFrame, id: str, list_no: int, score: str = "score") -> DataFrame:
    """A short ordered result as ``(doc, list_no, rank)`` with ranks from 1."""
    w = Window.orderBy(F.desc(score), F.asc(id))
    return df.select(F.col(id).alias("doc"), F.lit(list_no).alias("list_no"), F.row_number().over(w).alias("rank"))


def rrf_fuse(lists: DataFrame, prior: DataFrame | None = None, k: int = RRF_K, by: list[str] | None = None) -> DataFrame:
    """``(by…, doc, score, rank)``: reciprocal ranks of ``lists(by…, doc, list_no, rank)`` summed, plus a prior.

    A prior ``(by…, doc, bonus)`` counts only for documents of some list. Ties go to the earlier list, then rank.
    """
    by = by or []
    fused = lists.groupBy(*by, "doc").agg(
        F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"), F.min(F.struct("list_no", "rank")).alias("_first")
    )
    if prior is not None:
        fused = fused.join(prior.select(*by, "doc", "bonus"), [*by, "doc"], "left").withColumn("score", F.col("score") + F.coalesce("bonus", F.lit(0.0)))
    fused = fused.withColumn("score", F.round("score", 6))
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("_first"), F.asc("doc"))
    return fused.select(*by, "doc", "score", F.row_number().over(w).alias("rank"))


def rerank(ranking: DataFrame, scorer: Callable[[Column], Column] | None, head: int = HEAD) -> DataFrame:
    """The first ``head`` ranks reordered by a scorer (ties keep their order), the tail after them unchanged."""
    if scorer is None:
        return ranking
    score = F.when(F.col("rank") <= head, scorer(F.col("doc")))
    w = Window.orderBy((F.col("rank") > head).asc(), F.desc_nulls_last("_score"), F.asc("rank"))
    return ranking.withColumn("_score", score).withColumn("rank", F.row_number().over(w)).drop("_score")


def one_hop(edges: DataFrame, seeds: DataFrame, most: int = NEIGHBOURS) -> DataFrame:
    """Neighbours of ``seeds(id)`` over ``edges(src, dst)`` in both directions, distinct, the first ``most`` by id."""
    return _neighbours(edges, seeds).distinct().orderBy("id").limit(most)


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """``(id, hop)``: the fewest hops (both directions) from the seeds, seeds themselves at 0.

    Edges may repeat: they are cut to those at the last hop's ids before anything else, and only neighbours are made
    distinct. A hop of at most ``HELD`` ids is computed once and held by the driver; a larger one stays a plan.
    """
    last = _held(seeds.select("id").distinct())
    seen = last.withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        last = _neighbours(edges, last).distinct().join(seen.select("id"), "id", "left_anti")
        last = _held(last) if hop < hops else last
        seen = seen.unionByName(last.withColumn("hop", F.lit(hop)))
    return seen


def _held(ids: DataFrame) -> DataFrame:
    """The same rows, computed if they are few."""
    rows = ids.limit(HELD + 1).toArrow()
    return ids if rows.num_rows > HELD else ids.sparkSession.createDataFrame(rows, ids.schema)


def _neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The other ends of all edges at ``ids(id)``, with repeats."""
    outs = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    ins = edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    return outs.unionByName(ins)


def append_unseen(first: DataFrame, more: DataFrame, most: int) -> DataFrame:
    """``(doc, rank)`` lists in turn, each document at its first place, at most ``most`` of them."""
    both = first.select("doc", F.lit(0).alias("_part"), "rank").unionByName(more.select("doc", F.lit(1).alias("_part"), "rank"))
    once = both.groupBy("doc").agg(F.min(F.struct("_part", "rank")).alias("_at"))
    w = Window.orderBy("_at", "doc")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("doc", "rank")


def query_terms(text: str) -> list[str]:
    """Tokens of one query on the driver, by the same rules as :func:`millrace.functions.text.search_tokens`."""
    import re

    out: dict[str, str] = {}
    for piece in re.split(T.PIECE_EDGE, text):
        for word in piece.split("_") if "_" in piece else re.split(T.CAMEL_EDGE, piece):
            if len(word.strip()) >= T.MIN_TOKEN:
                out.setdefault(word.strip().lower(), word.strip())
    return list(out.values())


def decorate(rows: DataFrame, scores: DataFrame, on: str, score: str = "score") -> DataFrame:
    """Rows with their ``score`` from ``scores(on, score)``, zero where there is none."""
    return rows.join(scores.select(on, F.col(score).alias("score")), on, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def place_score(rank: Column) -> Column:
    """The score of the place in a list, from 1: its reciprocal."""
    return F.round(1.0 / rank, 4)


def known_only(named: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """Rows whose name is known; made-up names go."""
    return named.join(known.select(on), on, "left_semi")
