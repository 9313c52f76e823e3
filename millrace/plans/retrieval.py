"""Queries of retrieval: vectors, full text, fusion, priors, expansion, evaluation and packing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bundle, evaluate, search
from .common import Query, query_vector, table

QUERIES: dict[str, Query] = {}
TERMS = ["worthless", "idiot", "thanea", "erea", "onthat"]

_COS = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.v), 6)"
_Q0 = "q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)"
_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')"


def _bm25_sql(k: int) -> str:
    terms = ", ".join(f"'{t}'" for t in TERMS)
    return f"""
      w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
      st AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM w),
      post AS (SELECT doc_id, len(ws) AS dl, t AS term, len(list_filter(ws, lambda x: x = t)) AS tf FROM w, (SELECT unnest([{terms}]) AS t)),
      hit AS (SELECT * FROM post WHERE tf > 0),
      df AS (SELECT term, count(*) AS df FROM hit GROUP BY term),
      bm AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
             FROM hit JOIN df USING (term), st GROUP BY doc_id),
      ft AS (SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT {k})"""


def vector_topk(spark, sf):
    return search.vector_topk(table(spark, sf, "embeddings"), query_vector(spark, sf), 60).select("vec_id", "score")


QUERIES["vector_topk"] = (vector_topk, f"WITH {_Q0} SELECT vec_id, {_COS} AS score FROM embeddings e, q ORDER BY score DESC, vec_id LIMIT 60")


def vector_topk_by_repo(spark, sf):
    return search.vector_topk(table(spark, sf, "embeddings"), query_vector(spark, sf), 20, where=F.col("label") == 3).select("vec_id", "score")


QUERIES["vector_topk_by_repo"] = (
    vector_topk_by_repo,
    f"WITH {_Q0} SELECT vec_id, {_COS} AS score FROM embeddings e, q WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 20",
)


def vector_topk_postfilter(spark, sf):
    return search.vector_topk(table(spark, sf, "embeddings"), query_vector(spark, sf), 60, where=F.col("label") == 3, post_filter=True).select("vec_id", "score")


QUERIES["vector_topk_postfilter"] = (
    vector_topk_postfilter,
    f"WITH {_Q0}, t AS (SELECT vec_id, label, {_COS} AS score FROM embeddings e, q ORDER BY score DESC, vec_id LIMIT 60) SELECT vec_id, score FROM t WHERE label = 3",
)


def _batch(spark, sf, k, within=None):
    v = table(spark, sf, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), "label")
    return search.vector_topk_batch(v, q, k, within=within)


def vector_topk_batch(spark, sf):
    return _batch(spark, sf, 10).withColumn("rank", F.col("rank").cast("long"))


_BATCH = """
  SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score,
         e.label AS label, q.label AS qlabel
  FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0"""
QUERIES["vector_topk_batch"] = (
    vector_topk_batch,
    f"SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({_BATCH}) QUALIFY rank <= 10",
)


def vector_topk_batch_by_repo(spark, sf):
    return _batch(spark, sf, 5, within="label").withColumn("rank", F.col("rank").cast("long"))


QUERIES["vector_topk_batch_by_repo"] = (
    vector_topk_batch_by_repo,
    f"SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({_BATCH} AND q.label = e.label) QUALIFY rank <= 5",
)


def file_best_chunk(spark, sf):
    hits = search.vector_topk(table(spark, sf, "embeddings"), query_vector(spark, sf), 60)
    hits = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")))
    return search.best_per_file(hits, "label").withColumn("rank", F.col("rank").cast("long"))


QUERIES["file_best_chunk"] = (
    file_best_chunk,
    f"""WITH {_Q0}, t AS (SELECT vec_id, label, {_COS} AS score FROM embeddings e, q ORDER BY score DESC, vec_id LIMIT 60),
      r AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM t)
    SELECT label, max(score) AS score, min(rank) AS rank FROM r GROUP BY label""",
)


def fulltext_bm25(spark, sf):
    return search.bm25(table(spark, sf, "documents"), TERMS, 60)


QUERIES["fulltext_bm25"] = (fulltext_bm25, f"WITH {_bm25_sql(60)} SELECT doc_id, score FROM ft")


def fulltext_postings(spark, sf):
    posting, _ = search.postings(table(spark, sf, "documents"), "doc_id", "text")
    return posting.groupBy("term").agg(F.count(F.lit(1)).cast("long").alias("df"), F.sum("tf").cast("long").alias("cf"))


QUERIES["fulltext_postings"] = (
    fulltext_postings,
    f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY term",
)


def _lists(spark, sf):
    ft = search.bm25(table(spark, sf, "documents"), TERMS, 60)
    vec = search.vector_topk(table(spark, sf, "embeddings"), query_vector(spark, sf), 60)
    return search.ranked(vec, "vec_id", 1).unionByName(search.ranked(ft, "doc_id", 2))


_RRF = f"""WITH {_Q0}, vt AS (SELECT vec_id AS doc_id, {_COS} AS score FROM embeddings e, q ORDER BY score DESC, vec_id LIMIT 60), {_bm25_sql(60)},
  l AS (SELECT doc_id AS doc, 1 AS list_no, row_number() OVER (ORDER BY score DESC, doc_id) AS rk FROM vt
        UNION ALL SELECT doc_id, 2, row_number() OVER (ORDER BY score DESC, doc_id) FROM ft),
  f AS (SELECT doc, sum(1.0::DOUBLE / (60 + rk)) AS s, min(list_no * 1000000 + rk) AS first FROM l GROUP BY doc)"""


def rrf_fuse(spark, sf):
    return search.rrf_fuse(_lists(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


QUERIES["rrf_fuse"] = (rrf_fuse, f"{_RRF} SELECT doc, round(s, 6) AS score, row_number() OVER (ORDER BY round(s, 6) DESC, first, doc) AS rank FROM f")


def hybrid_retrieval(spark, sf):
    """The flagship: vector and full-text rankings fused with a prior, the best twenty hydrated."""
    docs = table(spark, sf, "documents")
    lists = search.short(_lists(spark, sf))
    # At most 120 documents are in the lists: their rows are looked up once, for the prior and for the answer.
    listed = F.broadcast(lists.select("doc").distinct())
    prior = docs.where("lang = 'en'").select(F.col("doc_id").alias("doc")).join(listed, "doc", "left_semi").withColumn("bonus", F.lit(0.002))
    top = search.rrf_fuse(lists, prior).where("rank <= 20")
    return docs.join(F.broadcast(top), F.col("doc_id") == F.col("doc")).select("doc_id", "score", F.col("rank").cast("long").alias("rank"), "lang", "source", "n_chars")


QUERIES["hybrid_retrieval"] = (
    hybrid_retrieval,
    f"""{_RRF}, p AS (SELECT f.doc, f.first, round(f.s + CASE WHEN d.doc_id IS NULL THEN 0.0::DOUBLE ELSE 0.002::DOUBLE END, 6) AS score
             FROM f LEFT JOIN (SELECT doc_id FROM documents WHERE lang = 'en') d ON d.doc_id = f.doc),
      r AS (SELECT *, row_number() OVER (ORDER BY score DESC, first, doc) AS rank FROM p)
    SELECT d.doc_id, r.score, r.rank, d.lang, d.source, d.n_chars FROM r JOIN documents d ON d.doc_id = r.doc WHERE r.rank <= 20""",
)


def rerank_head(spark, sf):
    fused = search.rrf_fuse(_lists(spark, sf))
    return search.rerank(fused, lambda doc: -(doc % 7).cast("double")).select("doc", F.col("rank").cast("long").alias("rank"))


QUERIES["rerank_head"] = (
    rerank_head,
    f"""{_RRF}, r AS (SELECT doc, row_number() OVER (ORDER BY round(s, 6) DESC, first, doc) AS rank FROM f)
    SELECT doc, row_number() OVER (ORDER BY (rank > 30)::INT, CASE WHEN rank <= 30 THEN doc % 7 END, rank) AS rank FROM r""",
)

_PATH = "'src/test/' || p_name || CASE WHEN p_size > 25 THEN 'Controller' ELSE 'Service' END || '.java'"


def path_prior(spark, sf):
    p = table(spark, sf, "part").withColumn("path", F.expr(_PATH)).withColumn("query", F.concat(F.lit("Rapid tests of the "), F.lower("p_type"), F.lit(" service")))
    return p.select("p_partkey", F.round(T.path_prior(F.col("query"), F.col("path")), 6).alias("bonus"))


QUERIES["path_prior"] = (path_prior, "SELECT p_partkey, round(0.04::DOUBLE + CASE WHEN p_size > 25 THEN 0.03::DOUBLE ELSE 0.02::DOUBLE END, 6) AS bonus FROM part")


def _trade(spark, sf):
    return (
        table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 10_000_000).alias("dst"))
    )


_EDGES = "e AS (SELECT DISTINCT o_custkey AS src, l_suppkey + 10000000 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def one_hop(spark, sf):
    seeds = spark.range(0, 5).select("id")
    return search.one_hop(_trade(spark, sf), seeds)


QUERIES["one_hop"] = (one_hop, f"WITH {_EDGES} SELECT DISTINCT dst AS id FROM e WHERE src < 5 UNION SELECT src FROM e WHERE dst < 5 ORDER BY id LIMIT 20")


def k_hop(spark, sf):
    return search.k_hop(_trade(spark, sf), spark.range(0, 1).select("id"), 2).withColumn("hop", F.col("hop").cast("long"))


QUERIES["k_hop"] = (
    k_hop,
    f"""WITH {_EDGES}, a AS (SELECT DISTINCT dst AS id FROM e WHERE src = 0), b AS (SELECT DISTINCT src AS id FROM e WHERE dst IN (SELECT id FROM a) AND src <> 0)
    SELECT 0::BIGINT AS id, 0::BIGINT AS hop UNION ALL SELECT id, 1 FROM a UNION ALL SELECT id, 2 FROM b""",
)


def append_unseen(spark, sf):
    o = table(spark, sf, "orders")
    top = lambda c: o.orderBy(F.desc(c), "o_orderkey").limit(30).select(F.col("o_orderkey").alias("doc"), F.row_number().over(Window.orderBy(F.desc(c), "o_orderkey")).alias("rank"))
    return search.append_unseen(top("o_totalprice"), top("o_orderdate"), 40).withColumn("rank", F.col("rank").cast("long"))


QUERIES["append_unseen"] = (
    append_unseen,
    """WITH a AS (SELECT o_orderkey AS doc, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders QUALIFY rk <= 30),
      b AS (SELECT o_orderkey AS doc, 1000 + row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS rk FROM orders QUALIFY rk <= 1030),
      u AS (SELECT doc, min(rk) AS rk FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc)
    SELECT doc, row_number() OVER (ORDER BY rk, doc) AS rank FROM u QUALIFY rank <= 40""",
)


def eval_metrics(spark, sf):
    v = table(spark, sf, "embeddings")
    hits = _batch(spark, sf, 11).where("vec_id <> query_id")
    results = hits.join(v.select("vec_id", F.col("label").alias("doc")), "vec_id").select(F.col("query_id").alias("probe"), "doc", "rank")
    probes = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("probe"), F.col("label").alias("doc"))
    return evaluate.metrics(evaluate.first_hits(probes, results, probes))


QUERIES["eval_metrics"] = (
    eval_metrics,
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({_BATCH}) QUALIFY rank <= 11),
      h AS (SELECT query_id, min(rank) AS rank FROM r WHERE vec_id <> query_id AND label = qlabel GROUP BY query_id),
      p AS (SELECT coalesce(rank, -1) AS rank FROM embeddings LEFT JOIN h ON query_id = vec_id WHERE vec_id % 20 = 0)
    SELECT count(*) AS n, round(avg(CASE WHEN rank BETWEEN 1 AND 1 THEN 1.0 ELSE 0 END), 6) AS recall_1,
      round(avg(CASE WHEN rank BETWEEN 1 AND 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN rank BETWEEN 1 AND 10 THEN 1.0 ELSE 0 END), 6) AS recall_10,
      round(avg(CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr FROM p""",
)


def first_hit_ranks(spark, sf):
    o = table(spark, sf, "orders")
    probes = table(spark, sf, "customer").select(F.col("c_custkey").alias("probe"))
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    results = o.select(F.col("o_custkey").alias("probe"), F.col("o_orderstatus").alias("doc"), F.row_number().over(w).alias("rank"))
    return evaluate.first_hits(probes, results, probes.withColumn("doc", F.lit("P"))).withColumn("rank", F.col("rank").cast("long"))


QUERIES["first_hit_ranks"] = (
    first_hit_ranks,
    """WITH r AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders),
      h AS (SELECT o_custkey, min(rk) AS rk FROM r WHERE o_orderstatus = 'P' GROUP BY o_custkey)
    SELECT c_custkey AS probe, coalesce(rk, -1)::BIGINT AS rank FROM customer LEFT JOIN h ON o_custkey = c_custkey""",
)


def latency_percentiles(spark, sf):
    return evaluate.latency(table(spark, sf, "events"), ["event_type"], "value")


QUERIES["latency_percentiles"] = (
    latency_percentiles,
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, max(value) FILTER (WHERE i = n // 2) AS p50, max(value) FILTER (WHERE i = greatest(0, floor(n * 0.95::DOUBLE) - 1)) AS p95, round(avg(value), 6) AS mean
    FROM r GROUP BY event_type""",
)


def token_budget_pack(spark, sf):
    d = table(spark, sf, "documents")
    w = Window.partitionBy("source").orderBy("n_chars", "doc_id")
    ranked = d.select("doc_id", "source", "text", F.row_number().over(w).alias("rank"))
    return bundle.pack_to_budget(ranked, "text", "rank", 1000, by=["source"]).select("doc_id", "source", F.col("used").cast("long").alias("used"))


QUERIES["token_budget_pack"] = (
    token_budget_pack,
    """SELECT doc_id, source, (sum(length(text)) OVER (PARTITION BY source ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS used
    FROM documents QUALIFY used <= 4000""",
)


def symbol_score(spark, sf):
    p = table(spark, sf, "part")
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return p.select("p_partkey", search.place_score(rank).alias("score"))


QUERIES["symbol_score"] = (symbol_score, "SELECT p_partkey, round(1.0::DOUBLE / row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey), 4) AS score FROM part")
